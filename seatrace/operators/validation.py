"""Evidence beside the model: slow clusters of a vessel, a surveyed line and other places against the candidate.

Nulls: a position without speed isn't slow, one without coordinates is in no cell. Fewer than two occupied
cells are an error; a candidate without coordinates gives null distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrace.functions.geodesy import geodesic_distance, utm_forward, utm_inverse
from seatrace.operators.paths import consecutive, length, segment_distance
from seatrace.operators.summaries import density_cells, top_two_cells


def slow(positions: DataFrame, knots: float) -> DataFrame:
    return positions.where(F.col("speed") <= knots)


def projected(vertices: DataFrame, lon: str = "lon", lat: str = "lat", zone: int = 33) -> DataFrame:
    """vertices with x and y in UTM, one by one; lines aren't made denser."""
    p = utm_forward(F.col(lon), F.col(lat), zone)
    return vertices.withColumn("_p", p).withColumn("x", F.col("_p.east")).withColumn("y", F.col("_p.north")).drop("_p")


def bounds_around(vertices: DataFrame, margin: float) -> DataFrame:
    """One row (minx, miny, maxx, maxy) around the vertices' x and y."""
    ends = ((f, c, s) for f, s in ((F.min, -1), (F.max, 1)) for c in "xy")
    return vertices.agg(*((f(c) + s * margin).alias(f"{f.__name__}{c}") for f, c, s in ends))


def tile_plan(bounds: DataFrame, span: float) -> DataFrame:
    """(minx, miny, maxx, maxy) of the tiles of at most span that cover each row of bounds, the last ones cut."""
    starts = lambda c: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(f"max{c}") - F.col(f"min{c}")) / span).cast("int") - 1, F.lit(0)))
    cells = bounds.where("maxx > minx and maxy > miny").withColumn("_i", F.explode(starts("x"))).withColumn("_j", F.explode(starts("y")))
    low = lambda c, k: F.col(f"min{c}") + F.col(k) * span
    high = lambda c, k: F.least(low(c, k) + span, F.col(f"max{c}"))
    return cells.select(low("x", "_i").alias("minx"), low("y", "_j").alias("miny"), high("x", "_i").alias("maxx"), high("y", "_j").alias("maxy"))


def dwell_clusters(positions: DataFrame, knots: float, size: float, zone: int = 33) -> DataFrame:
    """(label, lon, lat, n) of the two cells of ``size`` metres with most slow positions, west first.

    Places are the cells' nodes, not the means of their positions.
    """
    cells = density_cells(projected(slow(positions, knots), zone=zone).where("x is not null and y is not null"), size)
    node = utm_inverse(F.col("gx") * size, F.col("gy") * size, zone)
    return top_two_cells(cells, required=True).select("label", "n", node.alias("p")).select("label", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "n")


def in_one_row(clusters: DataFrame) -> DataFrame:
    """Clusters (label west or east, lon, lat, n) as one row, with the metres between them."""
    at = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c))).alias(f"{label}_{c}")
    row = clusters.agg(*(at(label, c) for label in ("west", "east") for c in ("lon", "lat", "n")))
    return row.withColumn("separation_m", geodesic_distance(*(F.col(f"{label}_{c}") for label in ("west", "east") for c in ("lon", "lat"))))


def line_length(vertices: DataFrame, key: str = "cable_id", seq: str = "seq") -> DataFrame:
    """(key, length_m) of lines given as vertices with x and y."""
    steps = consecutive(vertices, key, [seq], ["x", "y"])
    return steps.groupBy(key).agg(F.sum(length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length_m"))


def spatial_validation(line: DataFrame, clusters: DataFrame, lon: float | None, lat: float | None, core: tuple[float, float]) -> DataFrame:
    """One row: length of the line, the candidate's distance from it, its nearest cluster (west if equal) and from a core.

    line has line_id, seq, lon and lat; clusters are those of dwell_clusters.
    """
    steps = consecutive(projected(line), "line_id", ["seq"], ["x", "y"])
    here = utm_forward(F.lit(lon).cast("double"), F.lit(lat).cast("double"))
    steps = steps.withColumn("_h", here)
    away = segment_distance(F.col("_h.east"), F.col("_h.north"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    whole = length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    measured = steps.agg(F.sum(whole).alias("track_length_m"), F.min(away).alias("candidate_distance_m"))
    far = lambda x, y: geodesic_distance(F.lit(lon).cast("double"), F.lit(lat).cast("double"), x, y)
    row = in_one_row(clusters).withColumns({f"_{k}": far(F.col(f"{k}_lon"), F.col(f"{k}_lat")) for k in ("west", "east")})
    known = F.col("_west").isNotNull()
    nearest = row.select(
        F.when(known, F.when(F.col("_east") < F.col("_west"), "east").otherwise("west")).alias("closest_cluster"),
        F.least("_west", "_east").alias("closest_cluster_m"), far(F.lit(core[0]), F.lit(core[1])).alias("core_m"), "separation_m",
    )
    return measured.crossJoin(nearest)


def delay_hours(us: Column, start: str) -> Column:
    """Hours from a UTC time to microseconds since 1970."""
    return (us - F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01 00:00:00Z', TIMESTAMP '{start}Z')")) / 3.6e9


def crossing_times(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct times of crossings in whole microseconds."""
    return hits.select(*keys, F.floor("t").alias("us")).distinct()
