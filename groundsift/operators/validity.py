"""Validity of polygon geometries of any size, with the first rule each one breaks.

Sides are dealt to the cells of a grid laid over their own geometry, about as
many cells as sides; a crowded cell is cut finer.  Only sides that share a cell
are compared, in a join by (geometry, cell), so a ring of many thousand sides
is spread over tasks like everything else and no pair of distant sides is made.

* Sides that cross, or run along each other, make a *self-intersection*; so do
  rings that pass through each other at a point, which the order of their
  directions around it tells.
* A ring that meets itself is a *ring self-intersection*.
* Rays from ring midpoints count the sides above them, ring by ring: *hole
  outside shell*, *nested holes*, *nested shells*.
* Rings of a part that touch and the points where they do are a graph; a cycle in it
  cuts ground off: *disconnected interior*.

Geometries are arrays of parts of closed rings, as everywhere.  Touching at
single points is valid.  Null and empty geometries are *empty*; rings of under
four points, open ones, and those with a coordinate that is no finite number
have a bad *ring structure*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators.components import connected_components
from groundsift.session import cut

#: sides in a cell beyond which it is cut finer, into as many cells each way as sides over half of that; halvings at most
CROWD, HALVINGS = 32, 10
#: points of a geometry up to which its sides are compared in its own row; a bound on the pairs of a row, not on what is compared
FEW = 64
#: rules in the order in which they are reported
RULES = ("empty", "ring structure", "self-intersection", "ring self-intersection", "hole outside shell", "nested holes", "nested shells", "disconnected interior")
_RING = ("part", "ring")


def _structure(geom: Column) -> Column:
    """The first two rules, row by row."""
    distinct = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    finite = F.forall(G.vertices(geom), lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    short = F.exists(F.flatten(geom), lambda r: F.size(distinct(r)) < 4)
    return F.when(geom.isNull() | (F.size(geom) <= 0), RULES[0]).when(~G.ring_structure_ok(geom) | ~finite | short, RULES[1])


def _sides(shapes: DataFrame) -> DataFrame:
    """``(key, part, ring, seg, n, ax, ay, bx, by)`` and the grid of the geometry: origin and cell size."""
    extent = G.bounds(F.col("geom"))
    size = F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")) / F.sqrt(F.size(G.vertices(F.col("geom"))))
    rings = (shapes.select("key", extent.alias("b"), "geom").select("key", F.col("b.x0").alias("ox"), F.col("b.y0").alias("oy"), F.greatest(size, F.lit(1e-12)).alias("cell"), F.posexplode("geom").alias("part", "rs"))
             .select("key", "ox", "oy", "cell", "part", F.posexplode("rs").alias("ring", "pts")))
    pts = rings.withColumn("pts", F.filter("pts", lambda p, i: (i == 0) | (p != F.get(F.col("pts"), i - 1)))).withColumn("n", F.size("pts") - 1)
    # sides are paired up before they are exploded: no row carries its whole ring
    ends = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("pts", i).alias("a"), F.get("pts", i + 1).alias("b")))
    seg = pts.select("key", "part", "ring", "n", "ox", "oy", "cell", F.posexplode(ends).alias("seg", "s"))
    return seg.select("key", "part", "ring", "seg", "n", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), "ox", "oy", "cell")


def _cells(sides: DataFrame, x: str, y: str, ox: Column, oy: Column, cell: Column, count: Column | None = None) -> DataFrame:
    """One row per grid cell that a side passes, column by column; ``count`` cells each way at most."""
    def at(v: Column, origin: Column) -> Column:
        i = F.floor((v - origin) / cell).cast("int")
        return i if count is None else F.greatest(F.lit(0), F.least(count - 1, i))

    slack = cell * 1e-6  # a side that ends on a border is in both cells
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = sides.withColumn(x, F.explode(F.sequence(at(low - slack, ox), at(high + slack, ox))))
    left, right = F.greatest(low, ox + F.col(x) * cell - slack), F.least(high, ox + (F.col(x) + 1) * cell + slack)
    slope = F.when(high > low, (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    y0, y1 = F.col("ay") + slope * (left - F.col("ax")), F.col("ay") + slope * (right - F.col("ax"))
    inside = lambda v: F.greatest(F.least("ay", "by"), F.least(F.greatest("ay", "by"), v))
    bottom, top = F.when(slope.isNull(), F.least("ay", "by")).otherwise(inside(F.least(y0, y1))), F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(inside(F.greatest(y0, y1)))
    return columns.withColumn(y, F.explode(F.sequence(at(bottom - slack, oy), at(top + slack, oy))))


def _meetings(sides: DataFrame) -> DataFrame:
    """Pairs of sides of one cell that meet: how, where, and in which directions both leave that point."""
    coarse = _cells(sides, "cx", "cy", F.col("ox"), F.col("oy"), F.col("cell"))
    at = ["key", "cx", "cy"]
    crowded = coarse.groupBy(*at).agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select(*at, F.least(F.lit(HALVINGS), F.ceil(F.log2(F.col("c") / (CROWD / 2)))).cast("int").alias("halvings"))
    split = F.pow(F.lit(2.0), F.coalesce("halvings", F.lit(0))).cast("int")
    fine = coarse.join(crowded, at, "left").withColumn("split", split)
    fine = _cells(fine, "fx", "fy", F.col("ox") + F.col("cx") * F.col("cell"), F.col("oy") + F.col("cy") * F.col("cell"), F.col("cell") / F.col("split"), F.col("split"))
    cell = [*at, "fx", "fy"]
    fine = fine.select(*cell, "part", "ring", "seg", "n", "ax", "ay", "bx", "by")
    return _met(fine.join(_renamed(fine, cell), cell))


def _renamed(sides: DataFrame, keys: list[str]) -> DataFrame:
    return sides.select(*keys, F.col("part").alias("part2"), F.col("ring").alias("ring2"), F.col("seg").alias("seg2"), *[F.col(c).alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("cx_", "cy_", "dx_", "dy_"))])


def _met(pairs: DataFrame) -> DataFrame:
    """What meets, of pairs of sides of one geometry."""
    pairs = pairs.where(F.struct("part", "ring", "seg") < F.struct(F.col("part2").alias("part"), F.col("ring2").alias("ring"), F.col("seg2").alias("seg")))
    pairs = pairs.where((F.least("ax", "bx") <= F.greatest("cx_", "dx_")) & (F.least("cx_", "dx_") <= F.greatest("ax", "bx"))
                        & (F.least("ay", "by") <= F.greatest("cy_", "dy_")) & (F.least("cy_", "dy_") <= F.greatest("ay", "by")))
    a, b, c, d = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"), ("cx_", "cy_"), ("dx_", "dy_")))
    pairs = pairs.select("key", "part", "ring", "seg", "n", "part2", "ring2", "seg2", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    a, b, c, d = (F.col(v) for v in "abcd")
    pairs = pairs.withColumns({"o1": G._orient(a, b, c), "o2": G._orient(a, b, d), "o3": G._orient(c, d, a), "o4": G._orient(c, d, b)})
    same = (F.col("part") == F.col("part2")) & (F.col("ring") == F.col("ring2"))
    following = same & ((F.col("seg2") == F.col("seg") + 1) | ((F.col("seg") == 0) & (F.col("seg2") == F.col("n") - 1)))
    line = (F.col("o1") == 0) & (F.col("o2") == 0)
    shared = lambda k: F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])) - F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k]))
    along = line & ((shared("x") > 0) | (shared("y") > 0)) & (shared("x") >= 0) & (shared("y") >= 0)
    through = (F.col("o1") * F.col("o2") < 0) & (F.col("o3") * F.col("o4") < 0)
    # the point of one that lies on the other
    meets = (F.when((F.col("o1") == 0) & G._on(a, b, c), c).when((F.col("o2") == 0) & G._on(a, b, d), d)
             .when((F.col("o3") == 0) & G._on(c, d, a), a).when((F.col("o4") == 0) & G._on(c, d, b), b))
    pairs = pairs.withColumn("how", F.when(through | along, "cross").when(meets.isNotNull() & ~following, F.when(same, "self").otherwise("touch"))).withColumn("at", meets)

    def leaves(p, q):
        return F.transform(F.filter(F.array(p, q), lambda v: v != F.col("at")), lambda v: F.atan2(v["y"] - F.col("at")["y"], v["x"] - F.col("at")["x"]))

    return pairs.where("how is not null").select("key", "part", "ring", "part2", "ring2", "how", "at", leaves(a, b).alias("out"), leaves(c, d).alias("out2"))


def _inside(sides: DataFrame) -> DataFrame:
    """``(key, part, ring, part2, ring2)``: the first ring lies inside the second; two midpoints per ring, one of them off the other's sides."""
    columns = sides.withColumn("cx", F.explode(F.sequence(
        F.floor((F.least("ax", "bx") - F.col("ox")) / F.col("cell") - 1e-6).cast("int"), F.floor((F.greatest("ax", "bx") - F.col("ox")) / F.col("cell") + 1e-6).cast("int"))))
    px, py = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    points = sides.where("seg < 2").select("key", "part", "ring", "seg", px.alias("px"), py.alias("py"), F.floor((px - F.col("ox")) / F.col("cell")).cast("int").alias("cx"))
    others = columns.select("key", "cx", F.col("part").alias("part2"), F.col("ring").alias("ring2"), "ax", "ay", "bx", "by")
    met = points.join(others, ["key", "cx"]).where((F.col("part") != F.col("part2")) | (F.col("ring") != F.col("ring2")))
    y = F.col("ay") + (F.col("by") - F.col("ay")) * (F.col("px") - F.col("ax")) / (F.col("bx") - F.col("ax"))
    spans = (F.col("ax") <= F.col("px")) != (F.col("bx") <= F.col("px"))
    o = (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("px") - F.col("ax"))
    on = (o == 0) & F.col("px").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & F.col("py").between(F.least("ay", "by"), F.greatest("ay", "by"))
    rays = met.groupBy("key", *_RING, "part2", "ring2", "seg").agg(F.count_if(spans & (y > F.col("py"))).alias("above"), F.max(on).alias("on"))
    first = rays.groupBy("key", *_RING, "part2", "ring2").agg(F.min_by("above", F.struct("on", "seg")).alias("above"))
    return first.where(F.col("above") % 2 == 1).drop("above")


def _rows_of_sides(shapes: DataFrame) -> DataFrame:
    """``(key, sides)``: all sides of a small geometry in one row, rings without repeated points."""
    once = F.transform("geom", lambda rings: F.transform(rings, lambda pts: F.filter(pts, lambda p, i: (i == 0) | (p != F.get(pts, i - 1)))))

    def sides(part, ring, pts):
        return F.transform(F.sequence(F.lit(0), F.size(pts) - 2), lambda i: F.struct(
            part.alias("part"), ring.alias("ring"), i.alias("seg"), (F.size(pts) - 1).alias("n"), F.get(pts, i)["x"].alias("ax"), F.get(pts, i)["y"].alias("ay"),
            F.get(pts, i + 1)["x"].alias("bx"), F.get(pts, i + 1)["y"].alias("by")))

    return shapes.select("key", once.alias("geom")).select(
        "key", F.flatten(F.flatten(F.transform("geom", lambda rings, part: F.transform(rings, lambda pts, ring: sides(part, ring, pts))))).alias("sides"))


def _meetings_in_row(small: DataFrame) -> DataFrame:
    """The same as ``_meetings``; a side takes those whose box meets its own from its row."""
    one = small.select("key", "sides", F.posexplode("sides").alias("place", "s"))
    near = lambda o, i: ((i > F.col("place")) & (F.least(o["ax"], o["bx"]) <= F.greatest("s.ax", "s.bx")) & (F.least("s.ax", "s.bx") <= F.greatest(o["ax"], o["bx"]))
                         & (F.least(o["ay"], o["by"]) <= F.greatest("s.ay", "s.by")) & (F.least("s.ay", "s.by") <= F.greatest(o["ay"], o["by"])))
    two = one.select("key", "s", F.explode(F.filter("sides", near)).alias("o"))
    return _met(two.select("key", "s.*", F.col("o.part").alias("part2"), F.col("o.ring").alias("ring2"), F.col("o.seg").alias("seg2"),
                           *[F.col(f"o.{c}").alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("cx_", "cy_", "dx_", "dy_"))]))


def _inside_in_row(small: DataFrame) -> DataFrame:
    """The same as ``_inside``, ring by ring of one row."""
    first = lambda c: F.filter(c, lambda s: s["seg"] == 0)
    rings = (small.where(F.size(first("sides")) > 1).select("key", "sides", F.explode(first("sides")).alias("s")).select("key", "sides", F.col("s.part").alias("part"), F.col("s.ring").alias("ring"))
             .withColumn("o", F.explode(F.filter(first("sides"), lambda s: (s["part"] != F.col("part")) | (s["ring"] != F.col("ring")))))
             .select("key", "part", "ring", F.col("o.part").alias("part2"), F.col("o.ring").alias("ring2"),
                     F.filter("sides", lambda s: (s["part"] == F.col("part")) & (s["ring"] == F.col("ring")) & (s["seg"] < 2)).alias("own"),
                     F.filter("sides", lambda s: (s["part"] == F.col("o.part")) & (s["ring"] == F.col("o.ring"))).alias("sides")))

    def ray(p):
        x, y = (p["ax"] + p["bx"]) / 2, (p["ay"] + p["by"]) / 2
        spans = lambda s: (s["ax"] <= x) != (s["bx"] <= x)
        above = lambda s: s["ay"] + (s["by"] - s["ay"]) * (x - s["ax"]) / (s["bx"] - s["ax"]) > y
        on = lambda s: ((s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]) == 0) & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
        return F.struct(F.exists("sides", on).alias("on"), p["seg"].alias("seg"), F.size(F.filter("sides", lambda s: spans(s) & above(s))).alias("above"))

    # the midpoint that is off the other's sides, the first one if both are
    return rings.where(F.array_min(F.transform("own", ray))["above"] % 2 == 1).select("key", "part", "ring", "part2", "ring2")


def _cut_off(touches: DataFrame) -> DataFrame:
    """Keys of parts whose rings and touching points form a cycle."""
    ends = touches.where("part = part2").select("key", "part", "at", F.explode(F.array("ring", "ring2")).alias("ring")).distinct()
    several = ends.groupBy("key", "part").agg(F.count("*").alias("n")).where("n >= 4").select("key", "part")
    ends = cut(ends.join(several, ["key", "part"]).select(
        "key", F.xxhash64("key", "part", "ring").alias("a"), F.xxhash64("key", "part", F.lit("point"), "at.x", "at.y").alias("b")))
    if ends.isEmpty():
        return ends.select("key")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = connected_components(nodes, ends.select("a", "b"))
    edges = ends.join(named.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("edges"), F.any_value("key").alias("key"))
    return edges.join(named.groupBy("component").agg(F.count("*").alias("nodes")), "component").where("edges >= nodes").select("key")


def reasons(shapes: DataFrame, key: str = "id", geom: str = "geom") -> DataFrame:
    """``shapes`` to ``(key, reason)``, null where the geometry is valid; ``key`` names rows and must be unique."""
    rows = cut(shapes.select(F.col(key).alias("key"), F.col(geom).alias("geom")).withColumn("rule", _structure(F.col("geom"))))
    sound = rows.where("rule is null").select("key", "geom")
    points = F.size(G.vertices(F.col("geom")))
    small, sides = cut(_rows_of_sides(sound.where(points <= FEW))), cut(_sides(sound.where(points > FEW)))
    met = cut(_meetings(sides).unionByName(_meetings_in_row(small)).distinct())
    rule = lambda df, i: df.select("key", F.lit(i).alias("rule"))
    found = rule(met.where("how = 'cross'"), 2).unionByName(rule(met.where("how = 'self'"), 3))
    # two rings at one point: do the directions of one part those of the other?
    spots = cut(met.where("how = 'touch'").groupBy("key", *_RING, "part2", "ring2", "at").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("out")))).alias("out"), F.array_distinct(F.flatten(F.collect_list("out2"))).alias("out2")))
    between = lambda v: (v > F.get("out", F.lit(0))) & (v < F.get("out", F.lit(1)))
    passes = (F.size("out") == 2) & (F.size("out2") == 2) & (between(F.get("out2", F.lit(0))) != between(F.get("out2", F.lit(1))))
    found = found.unionByName(rule(spots.where(passes), 2))
    found = found.unionByName(rule(_cut_off(spots.where(~passes)), 7))
    # what lies in what
    rings = sound.select("key", F.posexplode("geom").alias("part", "rs")).select("key", "part", F.explode(F.sequence(F.lit(0), F.size("rs") - 1)).alias("ring"))
    many = sound.where((points > FEW) & (F.size(F.flatten("geom")) > 1)).select("key")
    within = cut(_inside(sides.join(many, "key", "left_semi")).unionByName(_inside_in_row(small)))
    shell = within.where("ring > 0 AND part2 = part AND ring2 = 0").select("key", *_RING)
    found = found.unionByName(rule(rings.where("ring > 0").join(shell, ["key", *_RING], "left_anti"), 4))
    found = found.unionByName(rule(within.where("ring > 0 AND part2 = part AND ring2 > 0"), 5))
    nested = within.where("ring = 0 AND part2 <> part AND ring2 = 0").select("key", "part", "part2")
    found = found.unionByName(rule(nested.join(within.where("ring = 0 AND ring2 > 0").select("key", "part", "part2").distinct(), ["key", "part", "part2"], "left_anti"), 6))
    first = found.groupBy("key").agg(F.min("rule").alias("first"))
    names = F.array(*[F.lit(r) for r in RULES])
    return rows.join(first, "key", "left").select(F.col("key").alias(key), F.coalesce("rule", F.get(names, F.col("first"))).alias("reason"))
