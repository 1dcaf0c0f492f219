"""Document fingerprints: a Merkle tree over paragraphs and sections.  DataFrame functions only.

A text is cut into sections at empty lines, into paragraphs at line ends and into
phrases at some blanks; joining them again gives the text, so the tree is the
text's own.  A phrase, the tree's leaf, has the SHA-256 of its bytes; a
paragraph's digest is that of its phrases' digests, a section's that of its
paragraphs', the root's that of its sections'.  Equal roots mean equal texts;
where roots differ, the branches that differ locate the edit.

A phrase ends behind a word whose last character is one of a fixed half of the
letters and digits, a mark, or not ASCII: about every second word in any
language, wherever it stands, so that an edit moves no other cut.  The likeness
of two fingerprints is the share of the leaves of either tree that both hold;
between tasks a leaf goes by 64 bits.

A null text is empty; a very long one is one row of one task, whatever its
length.  Other columns are not read.  Rows that are equal in id and text are one node of the
order and are returned as often as they come; rows that share an id but not the
text follow each other by hash.  Null ids come first.  An empty table gives an
empty result; with one document the next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import cut
from groundsift.operators.ranking import global_rank

#: a phrase ends behind these, at the blank
PHRASE_ENDS = r"[acegikmoqsuwyACEGIKMOQSUWY02468.,;:!?]|[^\x00-\x7F]"
_PHRASE = f"(?<={PHRASE_ENDS}) "


def tree(text: Column) -> Column:
    """Sections (digest, paragraphs) of a text, digests in hex."""
    def section(s: Column) -> Column:
        leaves = lambda p: F.transform(F.split(p, _PHRASE, -1), lambda x: F.sha2(x, 256))
        paragraphs = F.transform(F.split(s, "\n", -1), lambda p: F.sha2(F.array_join(leaves(p), ""), 256))
        return F.struct(F.sha2(F.array_join(paragraphs, ""), 256).alias("digest"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, "\n\n", -1), section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)


def phrases(text: Column) -> Column:
    """The different leaves of a text's tree, by 64 bits each."""
    return F.array_distinct(F.transform(F.split(text, _PHRASE + "|\n", -1), lambda p: F.xxhash64(p)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the leaves of either that both hold; arrays of different ones, never empty."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def differing(a: Column, b: Column) -> Column:
    """(section, paragraph) places, from 0, where two trees differ; branches with equal digests are not entered."""
    def inside(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        empty = F.array().cast("array<string>")
        p, q = F.coalesce(x["paragraphs"], empty), F.coalesce(y["paragraphs"], empty)
        places = F.sequence(F.lit(0), F.greatest(F.size(p), F.size(q)) - 1)
        return F.when(x["digest"].eqNullSafe(y["digest"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(F.filter(places, lambda j: ~F.get(p, j).eqNullSafe(F.get(q, j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))

    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), inside)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` to ``(doc_id, n_chars, fingerprint, sections)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id"), text.alias("_text")).withColumn("sections", tree(F.col("_text")))
    return made.select("doc_id", F.char_length("_text").cast("long").alias("n_chars"), root(F.col("sections")).alias("fingerprint"), "sections")


def edited(docs: DataFrame) -> DataFrame:
    """Each document beside an edited copy and the next document.

    The copy's last quarter is the start of the next document in order of id.
    Texts are shuffled once; what goes on from there to the document before is
    the start that it needs and the phrase hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h")).alias("key")
    # neighbours by rank, over ids and lengths only
    nodes = rows.groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.max(F.char_length("text")).cast("long").alias("n"))
    ranked = cut(global_rank(nodes, ["doc_id", "h"], "place").select("place", key, "times", "n"))
    total = ranked.count()
    before = ranked.select(((F.col("place") % F.lit(max(total, 1))) + 1).alias("place"), F.col("key").alias("for_key"), F.floor(F.col("n") / 4).alias("need"))
    order = cut(ranked.join(before, "place").select("key", "times", "for_key", "need"))
    one = rows.select(key, "text").join(order.select("key", "for_key", "need"), "key")
    # texts lie by key now; only starts and hashes move on, to the key before
    heads = one.select(F.col("for_key").alias("key"), F.substring("text", F.lit(1), F.col("need").cast("int")).alias("head"), phrases(F.col("text")).alias("next_phrases"))
    if not order.where("times > 1").isEmpty():
        heads = heads.groupBy("key").agg(F.min(F.struct("head", "next_phrases")).alias("m")).select("key", "m.*")
    both = one.select("key", "text").join(heads, "key")
    n = F.char_length("text")
    copy = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    both = both.select("key", "text", copy.alias("copy"), "next_phrases", phrases(F.col("text")).alias("phrases"))
    both = both.select("*", phrases(F.col("copy")).alias("copy_phrases"))
    return both.select(
        F.col("key.id").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("copy", 256).alias("edited_sha256"), root(tree(F.col("text"))).alias("fingerprint"),
        root(tree(F.col("copy"))).alias("edited_fingerprint"), likeness(F.col("phrases"), F.col("copy_phrases")).alias("near_edited"),
        likeness(F.col("phrases"), F.col("next_phrases")).alias("near_next"))
