"""Endpoint inventory from recorded browser traffic; values are never kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.functions.text import path_template, url_part

# Path words of map services.
PATH_WORDS = ("api", "geoportal", "aeggis", "wms", "wfs", "wmts", "feature", "layer", "search", "map")


def endpoints(entries: DataFrame, hosts) -> DataFrame:
    """``entries(ord, method, url, headers, observed_at)`` to one row per method and templated url; the last entry wins."""
    e = entries.where(url_part(F.col("url"), "HOST").isin(*hosts) & F.lower(url_part(F.col("url"), "PATH")).rlike("|".join(PATH_WORDS)))
    safe = F.concat(F.lit("https://"), url_part(F.col("url"), "HOST"), path_template(url_part(F.col("url"), "PATH")))
    names = F.filter(F.transform(F.split(F.coalesce(url_part(F.col("url"), "QUERY"), F.lit("")), "&"), lambda kv: F.substring_index(kv, "=", 1)), lambda k: k != "")
    signed = F.exists("headers", lambda h: F.lower(h).isin("authorization", "cookie"))
    rows = e.select("ord", "method", safe.alias("url"), F.array_join(names, ",").alias("parameters"), signed.alias("auth_seen"))
    return (rows.groupBy("method", "url").agg(F.max_by(F.struct("parameters", "auth_seen"), "ord").alias("v"), F.count("*").alias("seen"))
            .select(F.substring(F.sha2(F.concat_ws(" ", "method", "url"), 256), 1, 12).alias("id"), "method", "url", "v.parameters", "v.auth_seen", "seen"))


def merge_registry(old: DataFrame, new: DataFrame, columns) -> DataFrame:
    """Registry after a merge, with what changed: added, changed, kept."""
    o = old.select("id", F.struct(*columns).alias("before"))
    n = new.select("id", F.struct(*columns).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "kept").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return o.join(n, "id", "full").select("id", change.alias("change"), F.coalesce("after", "before").alias("v")).select("id", "change", "v.*")
