"""Reducing a gridded field (ts, lat, lon, value) to regional or point series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import broadcast_if_small, stage

# A simplified outline of Germany as (lon, lat), closed.
GERMANY_OUTLINE = [
    (8.40, 55.00), (9.00, 54.85), (9.60, 54.83), (10.00, 54.60), (10.80, 54.40), (11.30, 54.00), (12.10, 54.20), (13.00, 54.40), (13.80, 54.10),
    (14.40, 53.90), (14.40, 53.30), (14.15, 52.90), (14.60, 52.50), (14.75, 52.07), (14.60, 51.80), (15.04, 51.30), (14.80, 50.87), (14.40, 50.90),
    (13.50, 50.70), (12.90, 50.40), (12.10, 50.30), (12.20, 50.00), (12.50, 49.90), (13.00, 49.30), (13.80, 48.90), (13.40, 48.60), (13.00, 48.30),
    (12.80, 48.00), (13.00, 47.70), (12.80, 47.50), (12.20, 47.70), (11.60, 47.60), (11.00, 47.40), (10.50, 47.55), (10.20, 47.40), (10.10, 47.30),
    (9.80, 47.55), (9.50, 47.55), (8.90, 47.65), (8.60, 47.80), (8.40, 47.70), (7.90, 47.60), (7.60, 47.60), (7.55, 47.90), (7.60, 48.30),
    (8.00, 48.90), (8.20, 49.00), (7.10, 49.10), (6.70, 49.20), (6.40, 49.50), (6.10, 49.50), (6.40, 49.80), (6.10, 50.10), (6.20, 50.50),
    (6.00, 50.75), (5.90, 51.05), (6.20, 51.40), (5.95, 51.80), (6.70, 51.90), (7.00, 52.40), (6.70, 52.60), (7.00, 53.30), (7.20, 53.50),
    (8.00, 53.70), (8.50, 53.90), (8.90, 54.00), (8.60, 54.40), (8.90, 54.90), (8.40, 55.00),
]
# Population in millions and centroid (lat, lon) of the federal states, 2020.
STATES = [
    ("Baden-Wuerttemberg", 11.10, 48.60, 9.00), ("Bayern", 13.14, 48.90, 11.40), ("Berlin", 3.66, 52.52, 13.40), ("Brandenburg", 2.53, 52.40, 13.20),
    ("Bremen", 0.68, 53.08, 8.80), ("Hamburg", 1.85, 53.55, 10.00), ("Hessen", 6.29, 50.60, 9.00), ("Mecklenburg-Vorpommern", 1.61, 53.80, 12.50),
    ("Niedersachsen", 8.00, 52.80, 9.30), ("Nordrhein-Westfalen", 17.93, 51.50, 7.50), ("Rheinland-Pfalz", 4.10, 49.90, 7.50), ("Saarland", 0.98, 49.40, 7.00),
    ("Sachsen", 4.06, 51.10, 13.20), ("Sachsen-Anhalt", 2.18, 51.90, 11.70), ("Schleswig-Holstein", 2.91, 54.20, 9.70), ("Thueringen", 2.12, 50.90, 11.00),
]
WEIGHTINGS = ("box", "land", "population")
#: Cells of a weight table that every task may hold: a global grid of a quarter degree has 1.04 million.
MOST_CELLS = 1 << 21


def outline_edges(spark: SparkSession, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """edge_id and end points of a closed ring of (lon, lat)."""
    ring = ring or GERMANY_OUTLINE
    return spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(zip(ring[:-1], ring[1:], strict=True))], "edge_id int, x1 double, y1 double, x2 double, y2 double")


def state_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STATES)], "idx int, region string, pop double, clat double, clon double")


def box_cells(spark: SparkSession, lat: tuple[float, float] = (47.0, 55.0), lon: tuple[float, float] = (5.5, 15.5), step: float = 0.25) -> DataFrame:
    n_lat, n_lon = round((lat[1] - lat[0]) / step) + 1, round((lon[1] - lon[0]) / step) + 1
    i = F.col("id")
    return spark.range(n_lat * n_lon).select((F.floor(i / n_lon) * step + lat[0]).alias("lat"), ((i % n_lon) * step + lon[0]).alias("lon"))


def inside_outline(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cells(lat, lon) with inside: strictly within the ring, points on an edge aren't.

    A ray to the east crosses an odd number of edges from inside. Edges are only joined to cells of
    their latitudes, which is what can cross or touch.
    """
    x, y = F.col("lon"), F.col("lat")
    at = F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < at)
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    touches = (F.abs(cross) < 1e-9) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    near = cells.select("lat", "lon").join(edges, y.between(F.least("y1", "y2"), F.greatest("y1", "y2")))
    hit = near.groupBy("lat", "lon").agg((F.sum(F.coalesce(crosses, F.lit(False)).cast("int")) % 2 == 1).alias("_odd"), F.bool_or(touches).alias("_on"))
    return cells.join(hit, ["lat", "lon"], "left").withColumn("inside", F.coalesce(F.col("_odd") & ~F.col("_on"), F.lit(False))).drop("_odd", "_on")


def polygon_cover(edges: DataFrame, step: float) -> DataFrame:
    """poly_id, _i, _j and whole, of the square cells that closed rings of edges(poly_id, edge_id, x1, y1, x2, y2) cut or wholly hold.

    An edge cuts the cells that it passes in each column of cells. Along the middle of a row of cells a
    ring is crossed an even number of times: cells between an odd crossing and the next that no edge cuts lie inside.
    """
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = edges.withColumns({"_lo": lo, "_hi": hi}).withColumn("_i", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor(F.col("_hi") / step))))

    def y_at(x):
        return F.col("y1") + (x - F.col("x1")) * F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))

    ends = [F.coalesce(y_at(F.greatest("_lo", F.col("_i") * step)), F.col("y1")), F.coalesce(y_at(F.least("_hi", (F.col("_i") + 1) * step)), F.col("y2"))]
    pad = 1e-9  # a cell too many is cut, not one too few
    cut = columns.withColumns({"_a": F.least(*ends), "_b": F.greatest(*ends)})
    cut = cut.select("poly_id", "_i", F.explode(F.sequence(F.floor((F.col("_a") - pad) / step), F.floor((F.col("_b") + pad) / step))).alias("_j")).distinct()
    middle = (F.col("_j") + 0.5) * step
    rows = edges.withColumn("_j", F.explode(F.sequence(F.floor(F.least("y1", "y2") / step), F.floor(F.greatest("y1", "y2") / step)))).filter((F.col("y1") > middle) != (F.col("y2") > middle))
    at = F.col("x1") + (middle - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = rows.groupBy("poly_id", "_j").agg(F.sort_array(F.collect_list(at)).alias("_x"))
    spans = crossed.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_x") - 1, F.lit(2)))).select("poly_id", "_j", (F.floor(F.element_at("_x", F.col("_k")) / step) + 1).alias("_from"), (F.floor(F.element_at("_x", F.col("_k") + 1) / step) - 1).alias("_to"))
    whole = spans.filter("_from <= _to").select("poly_id", F.explode(F.sequence("_from", "_to")).alias("_i"), "_j").join(cut, ["poly_id", "_i", "_j"], "left_anti")
    return whole.withColumn("whole", F.lit(True)).unionByName(cut.withColumn("whole", F.lit(False)))


def points_in_polygons(points: DataFrame, edges: DataFrame, step: float = 0.25, most_cells: int = MOST_CELLS) -> DataFrame:
    """points (lat, lon and more) with poly_id, a row for each polygon that holds one strictly; points on an edge aren't inside.

    Most points fall into cells that a polygon holds wholly and are settled by an equality join; in a cut
    cell, a point meets the polygon's edges of its row of cells. The cover, whose size is that of the polygons, is
    staged and broadcast up to most_cells rows.
    """
    x, y = F.col("lon"), F.col("lat")
    placed = points.withColumns({"_i": F.floor(x / step), "_j": F.floor(y / step)})
    met = placed.join(broadcast_if_small(polygon_cover(edges, step), most_cells, "cover"), ["_i", "_j"])
    rows = edges.select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(F.least("y1", "y2") / step), F.floor(F.greatest("y1", "y2") / step))).alias("_j"))
    by_row = rows.groupBy("poly_id", "_j").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    open_ = met.filter(~F.col("whole")).join(broadcast_if_small(by_row, most_cells, "edges-by-row"), ["poly_id", "_j"])

    def crosses(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"]))

    def touches(e):
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (F.abs(cross) < 1e-9) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    inside = (F.size(F.filter("_edges", lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1) & ~F.exists("_edges", touches)
    kept = [*[F.col(f"`{c}`") for c in points.columns], F.col("poly_id")]
    return met.filter("whole").select(*kept).unionByName(open_.filter(inside).select(*kept))


def area_weight():
    """The relative area of a cell of equal degrees."""
    return F.cos(F.radians("lat"))


def _gap(lo, size, at):
    """How far a coordinate is from the interval that begins at lo."""
    return F.greatest(lo - at, at - (lo + size), F.lit(0.0))


def nearest(points: DataFrame, centroids: DataFrame, levels: int = 10, most_cells: int = MOST_CELLS) -> DataFrame:
    """points (point_id, lat, lon and more) with idx and d2 of the nearest of centroids(idx, clat, clon), any number of them.

    Distances are squared degrees, those of longitude shrunk by the cosine of the point's latitude; of equal
    ones the least idx wins. Centroids lie in a tree of cells that halve their parents, `levels` deep, and each cell
    that holds some names one. A point goes down the tree with the cells that may hold its nearest: those whose
    closest corner or side isn't farther than some cell's named centroid. No point meets all centroids, and
    what is left out can't be nearest. Without centroids there are no rows; centroids without a place aren't any.
    A point's rows are told by point_id, which must be its own.
    """
    known = stage(centroids.filter(F.col("clat").isNotNull() & F.col("clon").isNotNull()).select("idx", F.col("clat").cast("double").alias("clat"), F.col("clon").cast("double").alias("clon")), "centroids")
    box = known.agg(*[f(c).alias(n) for c, n in (("clat", "a"), ("clon", "o")) for f, n in ((F.min, f"{n}0"), (F.max, f"{n}1"))]).first()
    if box["a0"] is None:
        return points.join(known.select("idx", F.lit(0.0).alias("d2")).limit(0), F.lit(False))
    side = max(box["a1"] - box["a0"], box["o1"] - box["o0"], 1e-9) * (1 + 1e-9)
    place = points.select("point_id", F.col("lat").alias("_y"), F.col("lon").alias("_x")).filter("_y is not null and _x is not null")
    shrink = F.cos(F.radians("_y"))

    def d2(y, x):
        return F.pow(y - F.col("_y"), F.lit(2.0)) + F.pow((x - F.col("_x")) * shrink, F.lit(2.0))


    def cells_of(size):
        return F.floor((F.col("clat") - box["a0"]) / size), F.floor((F.col("clon") - box["o0"]) / size)

    i, j = cells_of(side / 2)
    top = [F.struct(F.lit(r["i"]).alias("_i"), F.lit(r["j"]).alias("_j")) for r in known.select(i.alias("i"), j.alias("j")).distinct().collect()]  # four at most
    front = place.withColumn("_c", F.explode(F.array(*top))).select("point_id", "_y", "_x", "_c.*")
    for level in range(2, levels + 1):
        size = side / 2**level
        i, j = cells_of(size)
        cells = known.groupBy(i.alias("_ci"), j.alias("_cj")).agg(F.min(F.struct("idx", "clat", "clon")).alias("_one"))
        cells = cells.withColumns({"_i": F.floor(F.col("_ci") / 2), "_j": F.floor(F.col("_cj") / 2)})
        met = front.join(broadcast_if_small(cells, most_cells, "nearest-cells"), ["_i", "_j"])
        near = F.pow(_gap(F.lit(box["a0"]) + F.col("_ci") * size, F.lit(size), F.col("_y")), F.lit(2.0)) + F.pow(_gap(F.lit(box["o0"]) + F.col("_cj") * size, F.lit(size), F.col("_x")) * shrink, F.lit(2.0))
        met = met.withColumns({"_near": near, "_named": d2(F.col("_one.clat"), F.col("_one.clon"))})
        within = F.min("_named").over(Window.partitionBy("point_id"))
        kept = met.withColumn("_within", within).filter(F.col("_near") <= F.col("_within") * (1 + 1e-9) + 1e-12)
        front = kept.select("point_id", "_y", "_x", F.col("_ci").alias("_i"), F.col("_cj").alias("_j"))
        if level % 4 == 0:
            front = stage(front, "nearest-front")
    size = side / 2**levels
    i, j = cells_of(size)
    leaves = known.withColumns({"_i": i, "_j": j})
    last = front.join(broadcast_if_small(leaves, most_cells, "nearest-leaves"), ["_i", "_j"])
    best = last.groupBy("point_id").agg(F.min(F.struct(d2(F.col("clat"), F.col("clon")).alias("d2"), F.col("idx"))).alias("_best"))
    return points.join(best, "point_id").withColumns({"idx": F.col("_best.idx"), "d2": F.col("_best.d2")}).drop("_best")


def population_weights(cells: DataFrame, states: DataFrame) -> DataFrame:
    """cells with region (nearest centroid, degrees of longitude shrunk; first wins ties) and pop_w.

    A region's people are spread over all cells nearest to it. Both sides are small next to the
    field; the regions are a constant table.
    """
    d2 = F.pow(F.col("lat") - F.col("clat"), F.lit(2.0)) + F.pow((F.col("lon") - F.col("clon")) * F.cos(F.radians("lat")), F.lit(2.0))
    near = cells.select("lat", "lon").crossJoin(states).groupBy("lat", "lon").agg(F.min_by(F.struct("region", "pop"), F.struct(d2, "idx")).alias("r"))
    n = F.count(F.lit(1)).over(Window.partitionBy("r.region"))
    return cells.join(near.select("lat", "lon", F.col("r.region").alias("region"), (F.col("r.pop") / n).alias("pop_w")), ["lat", "lon"])


def grid_weights(cells: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """kind, lat, lon, w for box, land and population; cells without weight are left out."""
    c = population_weights(inside_outline(cells, edges), states).withColumn("area", area_weight())
    kinds = F.array(F.struct(F.lit("box").alias("kind"), F.col("area").alias("w")), F.struct(F.lit("land").alias("kind"), F.when(F.col("inside"), F.col("area")).alias("w")), F.struct(F.lit("population").alias("kind"), F.when(F.col("inside"), F.col("area") * F.col("pop_w")).alias("w")))
    return c.select("lat", "lon", F.explode(kinds).alias("k")).select("k.kind", "lat", "lon", "k.w").filter("w > 0")


def weighted_series(grid: DataFrame, weights: DataFrame, value: str = "t2m", keys: tuple[str, ...] = ("ts",), most_cells: int = MOST_CELLS) -> DataFrame:
    """kind, the keys and value: the weighted mean of the field, for every kind in one pass.

    Weights sum over the cells that have a value. The weights, a row a cell with a column for each kind,
    are staged and counted; up to most_cells they are broadcast, so the field stays where it is read and
    only sums by task and key are shuffled. A larger table is joined by cell. Weights without a row are an error.
    """
    staged = stage(weights.select("kind", "lat", "lon", "w"), "weights")
    kinds = sorted(r["kind"] for r in staged.select("kind").distinct().collect())
    if not kinds:
        raise ValueError("weights sum to zero: there are none")
    cells = staged.groupBy("lat", "lon").agg(*[F.sum(F.when(F.col("kind") == k, F.col("w"))).alias(f"_w{i}") for i, k in enumerate(kinds)])
    rows = grid.select(*keys, "lat", "lon", F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).join(broadcast_if_small(cells, most_cells, "cell-weights"), ["lat", "lon"])
    sums = rows.groupBy(*keys).agg(*[s for i in range(len(kinds)) for s in (F.sum(F.col(f"_w{i}") * F.col("_v")).alias(f"_s{i}"), F.sum(f"_w{i}").alias(f"_t{i}"))])
    means = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_divide(f"_s{i}", f"_t{i}").alias(value)) for i, k in enumerate(kinds)])
    return sums.select(*keys, F.explode(means).alias("_k")).select("_k.kind", *keys, F.col(f"_k.{value}").alias(value)).filter(F.col(value).isNotNull())


def checked_weights(weights: DataFrame, kinds: tuple[str, ...] = WEIGHTINGS) -> DataFrame:
    """weights, failing the job if the sum of some kind isn't positive: of one that has no cell, too."""
    totals = weights.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("w"))), F.lit(0.0)).alias(f"_t{i}") for i, k in enumerate(kinds)])
    least = F.least(*[F.col(f"_t{i}") for i in range(len(kinds))], F.lit(float("inf")))
    ok = F.when(least > 0, F.col("w")).otherwise(F.raise_error(F.lit("weights sum to zero")).cast("double"))
    return weights.crossJoin(F.broadcast(totals)).withColumn("w", ok).select(*weights.columns)  # one row


def seam_safe_series(grid: DataFrame, weights: DataFrame, value: str = "t2m") -> DataFrame:
    """As weighted_series for yearly files that overlap: reduced by file, then the first file kept."""
    from ..sources.tables import drop_seam_duplicates

    by_file = weighted_series(grid, weights, value, ("ts", "source_file"))
    return drop_seam_duplicates(by_file, ["kind", "ts"]).drop("source_file")


def box_mean(grid: DataFrame, value: str = "t2m") -> DataFrame:
    return grid.groupBy("ts").agg(F.avg(value).alias(value))


def point_corners(points: DataFrame, lat: tuple[float, float], lon: tuple[float, float], step: float) -> DataFrame:
    """point_id, lat, lon, w: the four cells around each point and their bilinear weights.

    Points outside the box have no corners (see outside_points).
    """
    inside = points.filter(F.col("plat").between(*lat) & F.col("plon").between(*lon))
    n_lat, n_lon = round((lat[1] - lat[0]) / step), round((lon[1] - lon[0]) / step)
    y, x = (F.col("plat") - lat[0]) / step, (F.col("plon") - lon[0]) / step
    p = inside.withColumns({"_i": F.least(F.floor(y), F.lit(n_lat - 1)), "_j": F.least(F.floor(x), F.lit(n_lon - 1))}).withColumns({"_dy": y - F.col("_i"), "_dx": x - F.col("_j")})
    corner = F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((F.col("_dy") if a else 1 - F.col("_dy")) * (F.col("_dx") if b else 1 - F.col("_dx"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    return p.select("point_id", F.explode(corner).alias("c")).select("point_id", (F.col("c.i") * step + lat[0]).alias("lat"), (F.col("c.j") * step + lon[0]).alias("lon"), F.col("c.w").alias("w"))


def outside_points(points: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """The points that point_corners refuses."""
    return points.filter(~(F.col("plat").between(*lat) & F.col("plon").between(*lon)))


def series_at_points(grid: DataFrame, corners: DataFrame, value: str = "t2m") -> DataFrame:
    """point_id, ts, value by bilinear interpolation."""
    return grid.join(corners, ["lat", "lon"]).groupBy("point_id", "ts").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def kept_area(cells: DataFrame, step: float = 0.25, km_per_degree: float = 111.0) -> DataFrame:
    """n_cells and km2 of the cells inside."""
    return cells.filter("inside").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.cos(F.radians("lat")) * (step * km_per_degree) ** 2).alias("km2"))
