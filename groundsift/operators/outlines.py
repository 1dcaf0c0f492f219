"""Outlines of gaps: directed sides of free pieces, cancelled where pieces meet, linked to rings.

Everything is keyed by gap and line, vertex or side, so a gap that winds
through a whole window is never gathered.  Rings are numbered and ordered by
pointer doubling: each round doubles the stretch a side knows.
Vertices are snapped to a micrometre, interiors lie to the left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsift.session import cut, unsent

UNIT = 1e-6


def _snap(c):
    return F.round(c / F.lit(UNIT)).cast("bigint")


def boundary_sides(pieces: DataFrame) -> DataFrame:
    """Directed boundary sides (survey_id, gap, ax, ay, bx, by) of all gaps, in units of a micrometre."""
    p = cut(pieces.select("survey_id", "gap", *[_snap(F.col(c)).alias(c) for c in ("y0", "y1", "xl0", "xl1", "xr0", "xr1", "bx0", "bx1")]))  # read six times below
    c = F.col

    def face(axis, line, lo, hi, sign, on=None):
        q = p if on is None else p.where(on)
        return q.select("survey_id", "gap", F.lit(axis).alias("axis"), line.alias("line"), lo.alias("lo"), hi.alias("hi"), F.lit(sign).alias("s"))

    on_left, on_right = (c("xl0") == c("bx0")) & (c("xl1") == c("bx0")), (c("xr0") == c("bx1")) & (c("xr1") == c("bx1"))
    faces = (face("y", c("y0"), c("xl0"), c("xr0"), 1).unionByName(face("y", c("y1"), c("xl1"), c("xr1"), -1))
             .unionByName(face("x", c("bx1"), c("y0"), c("y1"), 1, on_right)).unionByName(face("x", c("bx0"), c("y0"), c("y1"), -1, on_left)))
    # opposite faces cancel: net cover between neighbouring end points of a line
    ends = faces.select("survey_id", "gap", "axis", "line", F.explode(F.array(F.struct(c("lo").alias("at"), c("s").alias("d")), F.struct(c("hi").alias("at"), (-c("s")).alias("d")))).alias("e"))
    ends = ends.groupBy("survey_id", "gap", "axis", "line", c("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("survey_id", "gap", "axis", "line").orderBy("at")
    runs = ends.withColumn("cover", F.sum("d").over(w)).withColumn("to", F.lead("at").over(w)).where("cover <> 0")
    first, last = F.when(c("cover") > 0, c("at")).otherwise(c("to")), F.when(c("cover") > 0, c("to")).otherwise(c("at"))
    level = runs.select("survey_id", "gap", F.when(c("axis") == "y", first).otherwise(c("line")).alias("ax"), F.when(c("axis") == "y", c("line")).otherwise(first).alias("ay"),
                        F.when(c("axis") == "y", last).otherwise(c("line")).alias("bx"), F.when(c("axis") == "y", c("line")).otherwise(last).alias("by"))
    right = p.where(~on_right).select("survey_id", "gap", c("xr0").alias("ax"), c("y0").alias("ay"), c("xr1").alias("bx"), c("y1").alias("by"))
    left = p.where(~on_left).select("survey_id", "gap", c("xl1").alias("ax"), c("y1").alias("ay"), c("xl0").alias("bx"), c("y0").alias("by"))
    return level.unionByName(right).unionByName(left).where("ax <> bx OR ay <> by")


def _turn(e, f):
    """Clockwise angle from the way back along ``e`` to the way on along ``f``."""
    back = F.atan2((F.col(f"{e}ay") - F.col(f"{e}by")).cast("double"), (F.col(f"{e}ax") - F.col(f"{e}bx")).cast("double"))
    on = F.atan2((F.col(f"{f}by") - F.col(f"{f}ay")).cast("double"), (F.col(f"{f}bx") - F.col(f"{f}ax")).cast("double"))
    two_pi = 6.283185307179586
    return F.when(back - on <= 1e-12, back - on + two_pi).otherwise(back - on)


def link_rings(sides: DataFrame) -> DataFrame:
    """Ring name and place of every side.  Where rings touch in a vertex they stay apart: the widest clockwise turn goes on."""
    s = cut(sides.withColumn("id", F.monotonically_increasing_id()))  # written once, so names stay
    nxt = s.select("survey_id", "gap", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("n_id"), F.col("bx").alias("n_bx"), F.col("by").alias("n_by"))
    j = s.join(unsent(nxt), ["survey_id", "gap", "bx", "by"]).withColumn("n_ax", F.col("bx")).withColumn("n_ay", F.col("by"))
    step = cut(j.groupBy("id").agg(F.max_by("n_id", F.struct(_turn("", "n_"), "n_id")).alias("next")))
    # ring name: least side name around the cycle
    r = step.select("id", F.col("next").alias("to"), "next", F.least("id", "next").alias("ring"))
    while True:
        far = r.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        new = r.join(unsent(far), "to").select("id", F.col("to2").alias("to"), "next", F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("moved"))
        new = cut(new)
        settled = new.where("moved").isEmpty()
        r = new.drop("moved")
        if settled:
            break
    # steps left until the ring's first side; the first side points to itself
    d = r.select("id", "ring", F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("next")).alias("to"), F.when(F.col("id") == F.col("ring"), 0).otherwise(1).cast("bigint").alias("left"))
    while True:
        far = d.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        # sides that have reached the first one leave the join, where they would all share its key
        go_on = d.where("to <> ring").join(unsent(far), "to").select("id", "ring", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"))
        d = cut(go_on.unionByName(d.where("to = ring").select("id", "ring", "to", "left")))
        if d.where("to <> ring").isEmpty():
            break
    size = d.groupBy("ring").agg(F.max("left").alias("_m"))
    place = d.join(unsent(size), "ring").select("id", "ring", F.when(F.col("left") == 0, 1).otherwise(F.col("_m") - F.col("left") + 2).alias("ord"))
    return s.join(unsent(place), "id").drop("id")


def ring_vertices(linked: DataFrame) -> DataFrame:
    """Vertices of every ring in order, metres; points in the middle of a straight run are left out."""
    n = linked.groupBy("ring").agg(F.max("ord").alias("_n"))
    prev = linked.select("ring", (F.col("ord") + 1).alias("ord"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    first = linked.join(unsent(n), "ring").where(F.col("ord") == F.col("_n")).select("ring", F.lit(1).cast("bigint").alias("ord"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    j = linked.join(unsent(prev.unionByName(first)), ["ring", "ord"])
    cross = (F.col("ax") - F.col("px")).cast("double") * (F.col("by") - F.col("ay")) - (F.col("ay") - F.col("py")).cast("double") * (F.col("bx") - F.col("ax"))
    span = F.greatest(F.abs(F.col("ax") - F.col("px")), F.abs(F.col("ay") - F.col("py")), F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).cast("double")
    return j.where(F.abs(cross) > span * 2).select("survey_id", "gap", "ring", "ord", (F.col("ax") * UNIT).alias("x"), (F.col("ay") * UNIT).alias("y"))


def ring_figures(linked: DataFrame) -> DataFrame:
    """Signed area and length of every ring: shells count positive, holes negative; coordinates taken from the ring's start."""
    head = linked.where("ord = 1").select("ring", F.col("ax").alias("ox"), F.col("ay").alias("oy"))
    j = linked.join(unsent(head), "ring")
    m = lambda a, o: (F.col(a) - F.col(o)).cast("double") * UNIT
    cross = m("ax", "ox") * m("by", "oy") - m("bx", "ox") * m("ay", "oy")
    length = F.hypot((F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")) * UNIT
    return j.groupBy("survey_id", "gap", "ring").agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("length"), F.count("*").alias("sides"))
