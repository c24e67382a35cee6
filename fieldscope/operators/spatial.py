"""Density clusters per neighbourhood, their centres, and visit routes, as joins and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.functions.scalar import bearing, bearing_class
from fieldscope.operators.components import connected_components
from fieldscope.operators.conform import first_n
from fieldscope.operators.joins import keep_top
from fieldscope.operators.ordering import quantile_bounds, range_bucket


#: Cells whose points can be within reach of a cell of side eps / sqrt(2), itself left out.
_AROUND = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0) and abs(dy) + abs(dx) < 4]


def _beside(df: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """Rows once per cell around theirs: that cell as (g, oy, ox)."""
    steps = F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in around])
    df = df.withColumn("_step", F.explode(steps))
    return df.withColumns({"oy": F.col("cy") + F.col("_step.y"), "ox": F.col("cx") + F.col("_step.x")}).drop("_step")


#: Two cells whose positions make so many pairs at most are compared outright.
FEW_PAIRS = 4096


def touching(pairs: DataFrame, positions: DataFrame, eps: float, few: int = FEW_PAIRS) -> DataFrame:
    """The (cell, other) of ``pairs`` that have two positions within eps; positions: (cell, y, x), without repeats.

    Small cells are compared position by position. Larger ones are halved again and again, both at once: parts
    whose boxes lie further apart than eps are dropped with all they hold, and two positions within eps settle
    their cells. What stays lies along the gap between two cells, so the work grows with its length and not
    with the product of the positions.
    """
    reach = F.lit(eps) * F.lit(eps)
    far = lambda lo, hi, other_lo, other_hi: F.greatest(F.col(lo) - F.col(other_hi), F.col(other_lo) - F.col(hi), F.lit(0.0))
    wanted = pairs.select(F.explode(F.array("cell", "other")).alias("cell")).distinct()
    positions = cut(positions.join(wanted, "cell", "left_semi"))
    counts = positions.groupBy("cell").agg(F.count("*").alias("n"))
    sized = pairs.join(counts, "cell").join(counts.select(F.col("cell").alias("other"), F.col("n").alias("m")), "other")
    sized = cut(sized.select("cell", "other", (F.col("n").cast("double") * F.col("m") <= few).alias("few")))

    def outright(some: DataFrame) -> DataFrame:
        theirs = positions.select(F.col("cell").alias("other"), F.col("y").alias("qy"), F.col("x").alias("qx"))
        dy, dx = F.col("y") - F.col("qy"), F.col("x") - F.col("qx")
        close = some.select("cell", "other").join(positions, "cell").join(theirs, "other").where(dy * dy + dx * dx <= reach)
        return close.select("cell", "other").distinct()

    found = outright(sized.where("few"))
    left = sized.where("not few").select("cell", "other", *[F.lit(0).cast("long").alias(c) for c in ("a_y", "a_x", "b_y", "b_x")])
    if left.isEmpty():
        return found
    # Halves are numbered from each cell's own corner, in units of twice its width.
    ends = {"y0": F.min("y"), "x0": F.min("x"), "y1": F.max("y"), "x1": F.max("x")}
    box = positions.groupBy("cell").agg(*[of.alias(c) for c, of in ends.items()])
    side = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.lit(1e-300))
    scaled = cut(positions.join(box, "cell").select("cell", "y", "x", *[((F.col(c) - F.col(f"{c}0")) / side / 2).alias(f"s{c}") for c in ("y", "x")]))
    for level in range(1, 60):
        parts = scaled.select("cell", "y", "x", *[F.floor(F.col(f"s{c}") * float(1 << level)).cast("long").alias(f"k{c}") for c in ("y", "x")])
        parts = parts.groupBy("cell", "ky", "kx").agg(
            F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(F.struct("y", "x")).alias("at")
        )
        half = lambda c: F.floor(F.col(c) / 2).cast("long")
        own = parts.select("cell", half("ky").alias("a_y"), half("kx").alias("a_x"), *[F.col(c).alias(f"a{c}") for c in ("ky", "kx", "y0", "y1", "x0", "x1", "at")])
        other = parts.select(F.col("cell").alias("other"), half("ky").alias("b_y"), half("kx").alias("b_x"), *[F.col(c).alias(f"b{c}") for c in ("ky", "kx", "y0", "y1", "x0", "x1", "at")])
        met = left.join(own, ["cell", "a_y", "a_x"]).join(other, ["other", "b_y", "b_x"])
        gap_y, gap_x = far("ay0", "ay1", "by0", "by1"), far("ax0", "ax1", "bx0", "bx1")
        dy, dx = F.col("aat.y") - F.col("bat.y"), F.col("aat.x") - F.col("bat.x")
        met = met.where(gap_y * gap_y + gap_x * gap_x <= reach).select(
            "cell", "other", F.col("aky").alias("a_y"), F.col("akx").alias("a_x"), F.col("bky").alias("b_y"), F.col("bkx").alias("b_x"),
            (dy * dy + dx * dx <= reach).alias("settled"),
        )
        met = cut(met)
        done = met.where("settled").select("cell", "other").distinct()
        found = cut(found.union(done))
        left = met.where("not settled").drop("settled").join(done, ["cell", "other"], "left_anti")
        if left.isEmpty():
            return found.distinct()
    return found.union(outright(left)).distinct()  # parts too narrow to halve


def dbscan(df: DataFrame, group: str, id_: str, lat: str, lon: str, eps: float = 0.001, min_points: int = 3) -> DataFrame:
    """Add ``cluster``: DBSCAN inside each group, distances in coordinate units; -1 is noise.

    Rows at one position count as one with a weight. Cells have side eps / sqrt(2), so that all rows of a cell
    are neighbours: a cell of min_points rows is all core, and only the few positions of sparser cells look
    for neighbours, which keeps their number in proportion to the rows. Core cells link by their outermost
    positions; only cells around each other that are then still in different components are searched for two
    positions within eps (``touching``). Clusters are components of core cells; a border position takes its core neighbour's cluster
    of smallest id. Clusters are numbered from 0 by their smallest core id. Rows with a null group or
    coordinate are noise. ids must be unique and integral.
    """
    side, reach = eps / math.sqrt(2), F.lit(eps) * F.lit(eps)
    named = df.where(F.col(group).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    at = named.groupBy(F.col(group).alias("g"), F.col(lat).alias("y"), F.col(lon).alias("x")).agg(
        F.count("*").alias("n"), F.min(id_).alias("p")
    )
    at = at.withColumns({"cy": F.floor(F.col("y") / side), "cx": F.floor(F.col("x") / side)})
    cells = at.groupBy("g", "cy", "cx").agg(F.sum("n").alias("cell_n"))
    at = cut(at.join(cells, ["g", "cy", "cx"]))
    dy, dx = F.col("y") - F.col("qy"), F.col("x") - F.col("qx")
    near = dy * dy + dx * dx <= reach
    sparse = _beside(at.where(F.col("cell_n") < min_points), [(0, 0), *_AROUND])
    others = at.select("g", F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("p").alias("q"), F.col("n").alias("qn"))
    pairs = sparse.join(others, ["g", "oy", "ox"]).where(near)
    counted = pairs.groupBy("p").agg(F.sum("qn").alias("k")).where(F.col("k") >= min_points).select("p")
    dense = at.where(F.col("cell_n") >= min_points)
    core = cut(dense.unionByName(at.where(F.col("cell_n") < min_points).join(counted, "p", "left_semi")))
    # A core cell is named by its smallest core id; its four outermost positions stand for it at first.
    spot = F.struct("y", "x")
    ends = [of(spot, F.col(c)).alias(f"{of.__name__}_{c}") for of in (F.min_by, F.max_by) for c in ("y", "x")]
    boxes = core.groupBy("g", "cy", "cx").agg(F.min("p").alias("cell"), *ends)
    boxes = cut(boxes.select("g", "cy", "cx", "cell", F.array(*[f"{of}_{c}" for of in ("min_by", "max_by") for c in ("y", "x")]).alias("spots")))
    half = [s for s in _AROUND if s > (0, 0)]
    beside = _beside(boxes, half).join(
        boxes.select("g", F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("cell").alias("other"), F.col("spots").alias("far")), ["g", "oy", "ox"]
    )
    close = lambda a, b: (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["x"] - b["x"]) * (a["x"] - b["x"]) <= reach
    linked = F.exists("spots", lambda a: F.exists("far", lambda b: close(a, b)))
    beside = cut(beside.select("cell", "other", linked.alias("linked")))
    links = beside.where("linked").select("cell", "other")
    parts = connected_components(links, "cell", "other")
    root = boxes.select("cell").join(parts.withColumnRenamed("node", "cell"), "cell", "left")
    root = cut(root.select("cell", F.coalesce("component", "cell").alias("root")))
    apart = beside.where("not linked").join(root, "cell").join(root.select(F.col("cell").alias("other"), F.col("root").alias("far")), "other")
    apart = cut(apart.where("root <> far").select("cell", "other"))
    placed = core.join(boxes.select("g", "cy", "cx", "cell"), ["g", "cy", "cx"])
    if apart.isEmpty():
        root = root.withColumnRenamed("root", "label")
    else:
        late = touching(apart, placed.select("cell", "y", "x"), eps)
        joined = late.join(root, "cell").join(root.select(F.col("cell").alias("other"), F.col("root").alias("far")), "other")
        parts = connected_components(joined, "root", "far").withColumnRenamed("node", "root")
        root = root.join(parts, "root", "left").select("cell", F.coalesce("component", "root").alias("label"))
    labelled = placed.join(root, "cell").select("g", "y", "x", "p", "label")
    border = sparse.join(counted, "p", "left_anti").select("g", "oy", "ox", "y", "x", "p")
    reached = placed.join(root, "cell").select("g", F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("y").alias("qy"), F.col("x").alias("qx"), "label")
    reached = border.join(reached, ["g", "oy", "ox"]).where(near).groupBy("g", "y", "x", "p").agg(F.min("label").alias("label"))
    found = cut(labelled.unionByName(reached).select("g", "y", "x", "label"))
    order = found.select("g", "label").distinct()
    number = (F.row_number().over(Window.partitionBy("g").orderBy("label")) - 1).cast("long")
    by_position = found.join(order.select("g", "label", number.alias("cluster")), ["g", "label"]).select(
        F.col("g").alias(group), F.col("y").alias(lat), F.col("x").alias(lon), "cluster"
    )
    out = df.join(by_position, [group, lat, lon], "left")
    return out.select(*df.columns, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def densest(df: DataFrame, group: str, id_: str, n: int = 10) -> DataFrame:
    """The rows of each group's largest cluster (ties: lowest number); the first n rows by id where there is none."""
    sizes = df.where("cluster >= 0").groupBy(group, "cluster").agg(F.count("*").alias("size"))
    best = sizes.groupBy(group).agg(F.min_by("cluster", F.struct(-F.col("size"), "cluster")).alias("cluster"))
    inside = df.join(best, [group, "cluster"], "left_semi")
    rest = df.join(best.select(group), group, "left_anti")
    return inside.unionByName(first_n(rest, group, [id_], n).select(*inside.columns))


def nearest_to_centroid(df: DataFrame, group: str, id_: str, lat: str, lon: str, n: int = 10) -> DataFrame:
    """The n rows of each group that are nearest to the group's mean position (to nine digits, ties by id)."""
    centre = df.groupBy(group).agg(F.avg(lat).alias("_lat"), F.avg(lon).alias("_lon"))
    away = F.round(F.hypot(F.col(lat) - F.col("_lat"), F.col(lon) - F.col("_lon")), 9)
    rows = df.join(centre, group).withColumn("distancia", away).drop("_lat", "_lon")
    return first_n(rows, group, ["distancia", id_], n)


def segments(df: DataFrame, group: str, order_by: str, lat: str, lon: str, rows_per_range: int = 500_000) -> DataFrame:
    """Stops in order (1-based) with the next stop's position; the last has none. order_by is integral and unique.

    Groups are split in ranges of order_by of about ``rows_per_range`` rows, so that no group is one task's
    work; a small table of (group, range) gives each range its offset and the next range's first stop.
    """
    rows = df.select(group, order_by, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    bounds = quantile_bounds(rows, order_by, rows.count() // rows_per_range) if rows_per_range else []
    rows = rows.withColumn("_range", range_bucket(F.col(order_by), bounds))
    ranges = rows.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(
        F.count("*").alias("n"), F.min_by(F.struct("lat", "lon"), order_by).alias("first")
    )
    by = Window.partitionBy("_group").orderBy("_at")
    before = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_group", "_at", F.coalesce(before, F.lit(0)).alias("_before"), F.lead("first").over(by).alias("_next"))
    rows = rows.join(ranges, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    w = Window.partitionBy(group, "_range").orderBy(order_by)
    following = F.coalesce(F.lead(F.struct("lat", "lon")).over(w), F.col("_next"))
    rows = rows.withColumn("_sig", following)
    return rows.select(
        group, order_by, (F.col("_before") + F.row_number().over(w)).cast("int").alias("orden"), "lat", "lon",
        F.col("_sig.lat").alias("lat_sig"), F.col("_sig.lon").alias("lon_sig"),
    )


def trace(
    df: DataFrame, group: str, id_: str, lat: str, lon: str, k: int = 3, eps: float = 0.001, min_points: int = 3, n: int = 10
) -> DataFrame:
    """Visit routes of the k busiest groups: densest cluster, n stops nearest its centre, segments and their class."""
    stops = densest(dbscan(keep_top(df, group, k), group, id_, lat, lon, eps, min_points), group, id_, n)
    out = segments(nearest_to_centroid(stops, group, id_, lat, lon, n), group, id_, lat, lon, rows_per_range=0)
    angle = bearing(F.col("lat"), F.col("lon"), F.col("lat_sig"), F.col("lon_sig"), wrap=True)
    return out.withColumn("clase", F.when(F.col("lat_sig").isNotNull(), bearing_class(angle)))


def nearest_site(
    points: DataFrame, sites: DataFrame, id_: str, site: str, lat: str = "latitud", lon: str = "longitud"
) -> DataFrame:
    """(id, site, distancia): of each point the nearest site in coordinate units, ties to the smallest site.

    Sites are put in square cells, about one a cell, and cells in cells of twice the width, up to one that holds
    them all. A point first looks in its own cell and the ring around it: a site as near as a cell is wide is the
    nearest. The few points left, far from all sites, go down from the widest cells: at each level only cells
    stay whose nearest corner is no further than some site already seen. Points and sites with a null or
    non-finite coordinate take no part; without sites there is no row. Ids are unique.
    """
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    at = cut(sites.where(fine(y) & fine(x) & F.col(site).isNotNull()).select(F.col(site).alias("s"), y.alias("sy"), x.alias("sx")))
    ends = at.agg(F.count("*").alias("n"), *[of(c).alias(f"{of.__name__}_{c}") for of in (F.min, F.max) for c in ("sy", "sx")]).first()
    rows = points.where(fine(y) & fine(x)).select(F.col(id_).alias("p"), y.alias("py"), x.alias("px"))
    if not ends["n"]:
        return rows.limit(0).select(F.col("p").alias(id_), F.lit(None).cast(at.schema["s"].dataType).alias(site), F.lit(None).cast("double").alias("distancia"))
    span = max(ends["max_sy"] - ends["min_sy"], ends["max_sx"] - ends["min_sx"])
    levels = max(0, math.ceil(math.log2(math.sqrt(ends["n"])))) if span else 0
    width = (span or 1.0) / (1 << levels)
    cell = lambda c, low, level: F.floor((F.col(c) - low) / (width * (1 << level))).cast("long")
    of = lambda c, level: cell(c, ends[f"min_s{c[-1]}"], level)
    away = F.hypot(F.col("py") - F.col("sy"), F.col("px") - F.col("sx"))
    best = F.min(F.struct(away.alias("distancia"), "s")).alias("best")
    rows = cut(rows.withColumns({"cy": of("py", 0), "cx": of("px", 0)}))
    ring = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    placed = at.withColumns({"oy": of("sy", 0), "ox": of("sx", 0)})
    close = _beside(rows, ring).join(placed, ["oy", "ox"]).groupBy("p").agg(best)
    # A site beyond the ring is further away than a cell is wide; a hair less, since cells are rounded.
    close = cut(close.where(F.col("best.distancia") < width * (1 - 1e-9)).select("p", "best"))
    rest = rows.join(close, "p", "left_anti").select("p", "py", "px")
    if not rest.isEmpty():
        tops = at.select(of("sy", levels).alias("oy"), of("sx", levels).alias("ox")).distinct().collect()  # four cells at most
        tops = F.explode(F.array(*[F.struct(F.lit(t["oy"]).alias("oy"), F.lit(t["ox"]).alias("ox")) for t in tops]))
        seen = rest.withColumn("_top", tops).select("p", "py", "px", "_top.oy", "_top.ox")
        for level in range(levels - 1, -1, -1):
            boxes = at.groupBy(of("sy", level).alias("ky"), of("sx", level).alias("kx")).agg(
                F.min("sy").alias("y0"), F.max("sy").alias("y1"), F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min(F.struct("sy", "sx")).alias("one")
            )
            boxes = boxes.withColumns({"oy": F.floor(F.col("ky") / 2).cast("long"), "ox": F.floor(F.col("kx") / 2).cast("long")})
            met = seen.select("p", "py", "px", "oy", "ox").join(boxes, ["oy", "ox"])
            gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"{c}1"), F.lit(0.0))
            met = met.select("p", "py", "px", F.col("ky").alias("oy"), F.col("kx").alias("ox"), F.hypot(gap("y"), gap("x")).alias("least"),
                             F.hypot(F.col("py") - F.col("one.sy"), F.col("px") - F.col("one.sx")).alias("some"))
            met = cut(met)
            bound = met.groupBy("p").agg(F.min("some").alias("bound"))
            seen = met.join(bound, "p").where(F.col("least") <= F.col("bound")).select("p", "py", "px", "oy", "ox")
        close = close.union(seen.join(placed, ["oy", "ox"]).groupBy("p").agg(best))
    return close.select(F.col("p").alias(id_), F.col("best.s").alias(site), F.col("best.distancia").alias("distancia"))


def misassigned(points: DataFrame, sites: DataFrame, id_: str, route: str, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """(id, route, cercana, distancia, distancia_cercana): points whose nearest route centre is another route's.

    points: id, its route and position; sites: a centre a route. Distances are told to nine digits, and a centre
    that is no nearer in these digits than the own one does not count. Points whose route has no centre, or is
    null, are left out.
    """
    near = nearest_site(points, sites, id_, route, lat, lon).select(id_, F.col(route).alias("cercana"), F.round("distancia", 9).alias("distancia_cercana"))
    centres = sites.select(F.col(route), F.col(lat).alias("_y"), F.col(lon).alias("_x"))
    own = points.join(centres, route).withColumn("distancia", F.round(F.hypot(F.col(lat) - F.col("_y"), F.col(lon) - F.col("_x")), 9))
    both = own.join(near, id_).where(F.col("distancia_cercana") < F.col("distancia"))
    return both.select(id_, route, "cercana", "distancia", "distancia_cercana")
