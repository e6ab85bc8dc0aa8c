"""Towed gear behind a vessel: the parameter grid, lag along the path, component places, rejections.

Nulls: a point without a depth rejects every scenario and has no gear; a point without coordinates or
chainage has no gear either. Empty tables of points give scenarios that are all rejected, and no positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seatrace.functions.geodesy import local_inverse
from seatrace.operators.paths import consecutive, length, tow_points
from seatrace.operators.raster import bilinear_depth
from seatrace.operators.sweep import places_behind, swept_parts, swept_steps

CEILING, REACH, NO_DEPTH = "warp ceiling", "door spread exceeds horizontal warp reach", "missing depth"
OFF_PATH, SHORT_CHORD = "the lag reaches before the path", "the path turns back on itself"


def scenario_grid(spark: SparkSession, ratios: list[float], spreads: list[float]) -> DataFrame:
    """(scenario_id, ratio, spread): all pairs, ids G0000... in the order of ratios, then spreads."""
    table = lambda name, values: spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{name}_no int, {name} double")
    pairs = table("ratio", ratios).crossJoin(F.broadcast(table("spread", spreads)))
    number = F.col("ratio_no") * len(spreads) + F.col("spread_no")
    return pairs.select(F.format_string("G%04d", number).alias("scenario_id"), "ratio", "spread")


def lag_squared(depth: Column, ratio: Column | None = None, spread: Column | None = None) -> Column:
    """Of the horizontal reach of the warp, from the columns ratio and spread if they aren't given."""
    warp, half = (F.col("ratio") if ratio is None else ratio) * depth, (F.col("spread") if spread is None else spread) / 2
    return warp * warp - depth * depth - half * half


def scenario_status(points: DataFrame, grid: DataFrame, max_warp: float, depth: str = "depth", depth_offset: float = 0.0) -> DataFrame:
    """(scenario_id, ratio, spread, accepted, rejection_reason): one bad second rejects a scenario.

    depth_offset is added to every depth. The warp follows the depth, and the squared lag the square of it,
    so the whole product isn't needed: the greatest depth, and the least and the greatest absolute one
    decide, and those are one row. A depth that is null, NaN or not above 0 counts as missing, and that, or
    no point at all, rejects all scenarios.
    """
    known = F.col(depth) > 0
    real = F.when(known & ~F.isnan(depth), F.col(depth) + depth_offset)
    ends = points.agg(F.min(F.abs(real)).alias("_lo"), F.max(F.abs(real)).alias("_hi"), F.max(real).alias("_deep"), (F.count(real) < F.greatest(F.count("*"), F.lit(1))).alias("_missing"))
    both = grid.crossJoin(F.broadcast(ends))
    short = F.least(lag_squared(F.col("_lo")), lag_squared(F.col("_hi"))) <= 0
    reason = F.when(F.col("_missing"), NO_DEPTH).when(F.col("ratio") * F.col("_deep") > max_warp, CEILING).when(short, REACH)
    return both.select("scenario_id", "ratio", "spread", reason.isNull().alias("accepted"), reason.alias("rejection_reason"))


def _squared(depth_offset: float) -> Callable[[Column, Column, Column], Column]:
    return lambda ratio, spread, depth: lag_squared(depth + depth_offset, ratio, spread)


def swept_points(tow: DataFrame, path: DataFrame, grid: DataFrame, width: float, depth_offset: float = 0.0, longest: float = float("inf")) -> DataFrame:
    """Every point of tow for every scenario, with its lag, the place there on the path, and why it has no gear, if so.

    tow has mmsi, event_id, us, s (chainage), x, y and depth, to which depth_offset is added; path has the
    segments of the same tows. A track and its path are sorted once and pass by together, with the path of the
    ``longest`` lag and ``width`` more held, so the product with the grid, a few hundred rows by its parameters,
    isn't shuffled. A longer lag is an error.
    """
    found = places_behind(tow, path, grid, _squared(depth_offset), longest, width)
    found = found.withColumn("_chord", length(F.col("x") - F.col("ix"), F.col("y") - F.col("iy")))
    return found.withColumn("reason", F.when(F.col("ix").isNull(), OFF_PATH).when(F.col("_chord") < 1, SHORT_CHORD))


def towed_track(steps: DataFrame, cells: DataFrame, offset: float, corner: tuple[float, float], pixel: tuple[float, float], centre: tuple[float, float] | None = None) -> DataFrame:
    """(mmsi, event_id, us, x, y, depth): tow points ``offset`` aft of the antenna, with the raster's depth under them.

    steps are the antenna's places (mmsi, event_id, us, x, y) with their velocity (vx, vy). The raster lies in the
    plane of x and y, or is one of degrees around ``centre``, to which points are projected back. Where the vessel
    is stationary there is no tow point and no row.
    """
    tow = tow_points(steps, offset).where("tow_x is not null").select("mmsi", "event_id", "us", "tow_x", "tow_y")
    if centre is not None:
        deep = depths_under(tow, cells, centre, corner, pixel)
    else:
        placed = tow.withColumns({"px": (F.col("tow_x") - corner[0]) / pixel[0], "py": (corner[1] - F.col("tow_y")) / pixel[1]})
        deep = bilinear_depth(placed, cells)
    return deep.select("mmsi", "event_id", "us", F.col("tow_x").alias("x"), F.col("tow_y").alias("y"), "depth")


def depths_under(points: DataFrame, cells: DataFrame, centre: tuple[float, float], corner: tuple[float, float], pixel: tuple[float, float]) -> DataFrame:
    """points (tow_x, tow_y in the local projection around centre) with depth, from a raster of geographic cells.

    corner is the longitude and latitude of the raster's north-west corner, pixel the degrees of a cell. A point
    without a place, off the raster or over land has a null depth, which scenario_status refuses.
    """
    there = points.withColumn("_g", local_inverse(F.col("tow_x"), F.col("tow_y"), *centre))
    placed = there.withColumns({"px": (F.col("_g.lon") - corner[0]) / pixel[0], "py": (corner[1] - F.col("_g.lat")) / pixel[1]})
    return bilinear_depth(placed.drop("_g"), cells).drop("px", "py")


def gear_failures(tow: DataFrame, path: DataFrame, grid: DataFrame, width: float, depth_offset: float = 0.0, longest: float = float("inf")) -> DataFrame:
    """(scenario_id, mmsi, event_id, reason) of the points that gear_positions has no rows for."""
    return swept_points(tow, path, grid, width, depth_offset, longest).where("reason is not null").select("scenario_id", "mmsi", "event_id", "reason")


def gear_centres(tow: DataFrame, path: DataFrame, grid: DataFrame, width: float, depth_offset: float = 0.0, longest: float = float("inf")) -> DataFrame:
    """swept_points that have gear, with its direction (_ux, _uy) and centre (_cx, _cy) a lag behind the tow point."""
    found = swept_points(tow, path, grid, width, depth_offset, longest).where("reason is null")
    found = found.withColumn("_ux", (F.col("x") - F.col("ix")) / F.col("_chord")).withColumn("_uy", (F.col("y") - F.col("iy")) / F.col("_chord"))
    return found.withColumn("_cx", F.col("x") - F.col("_lag") * F.col("_ux")).withColumn("_cy", F.col("y") - F.col("_lag") * F.col("_uy"))


def gear_positions(tow: DataFrame, path: DataFrame, grid: DataFrame, width: float, clump_offset: float = 0.0, depth_offset: float = 0.0, observation: Observation | None = None, longest: float = float("inf")) -> DataFrame:
    """(scenario_id, mmsi, event_id, us, component, x, y) for the scenarios of grid, the accepted ones.

    Points that gear_failures lists have no rows; a result is whole only if there are none. With an observation, the
    pass that writes the positions also counts its points and those that break an invariant: doors that aren't
    the spread apart (open_doors) or whose distance and depth don't make the warp (open_warps).
    """
    if observation is None:
        return swept_parts(tow, path, grid, _squared(depth_offset), _parts(clump_offset), longest, width)
    half = F.col("spread") / 2

    def place(name: str, across: Column | float, along: float) -> Column:
        # The normal of the direction (ux, uy) is (-uy, ux); port lies on its positive side.
        px = F.col("_cx") + across * -F.col("_uy") + along * F.col("_ux")
        py = F.col("_cy") + across * F.col("_ux") + along * F.col("_uy")
        return F.struct(F.lit(name).alias("component"), px.alias("px"), py.alias("py"))

    parts = F.array(place("port_door", half, 0.0), place("starboard_door", -half, 0.0), place("centre_clump", F.lit(0.0), clump_offset))
    found = gear_centres(tow, path, grid, width, depth_offset, longest).withColumn("_parts", parts)
    port, starboard = (F.struct(F.col("_parts")[k]["px"].alias("x"), F.col("_parts")[k]["py"].alias("y")) for k in (0, 1))
    apart, loose = closure_faults(port, starboard, F.struct("x", "y"), F.col("depth") + depth_offset)
    found = found.observe(observation, F.count("*").alias("points"), F.count_if(apart).alias("open_doors"), F.count_if(loose).alias("open_warps"))
    rows = found.select("scenario_id", "mmsi", "event_id", "us", F.explode("_parts").alias("p"))
    return rows.select("scenario_id", "mmsi", "event_id", "us", "p.component", F.col("p.px").alias("x"), F.col("p.py").alias("y"))


def closure_faults(port: Column | dict[str, Column], starboard: Column | dict[str, Column], tow: Column | dict[str, Column], depth: Column) -> tuple[Column, Column]:
    """Whether the doors (x, y) aren't the column spread apart, and whether a door's distance from the tow point
    and the depth don't make a warp of the column ratio times the depth."""
    far = lambda a, b: length(a["x"] - b["x"], a["y"] - b["y"])
    warp = F.col("ratio") * depth
    loose = [differs_much(length(far(door, tow), depth), warp) for door in (port, starboard)]
    return differs_much(far(port, starboard), F.col("spread")), loose[0] | loose[1]


def _parts(clump_offset: float) -> dict[str, tuple[float, float]]:
    return {"port_door": (0.5, 0.0), "starboard_door": (-0.5, 0.0), "centre_clump": (0.0, clump_offset)}


def gear_steps(tow: DataFrame, path: DataFrame, grid: DataFrame, width: float, clump_offset: float = 0.0, depth_offset: float = 0.0, longest: float = float("inf")) -> DataFrame:
    """``component_steps`` of ``gear_positions``, made in the pass that places the gear, without a shuffle of positions."""
    return swept_steps(tow, path, grid, _squared(depth_offset), _parts(clump_offset), longest, width)


def component_steps(positions: DataFrame) -> DataFrame:
    """Steps (t0, t1, x0, y0, x1, y1) of each part of the gear, by scenario and vessel."""
    steps = consecutive(positions, ["scenario_id", "mmsi", "component"], ["us", "event_id"], ["us", "x", "y"])
    return steps.withColumnsRenamed({"us0": "t0", "us1": "t1"})


def gear_closure(positions: DataFrame, tow: DataFrame, grid: DataFrame, depth_offset: float = 0.0) -> DataFrame:
    """(scenario_id, points, open_doors, open_warps) of positions that were written before, from the tow points
    (mmsi, event_id, x, y, depth) and the grid, not from the formula that placed them."""
    names = {"_p": "port_door", "_s": "starboard_door"}
    own = {f"{k}{c}": F.when(F.col("component") == name, F.col(c)) for k, name in names.items() for c in "xy"}
    # Greatest (x, y) as numbers: rows are added up in a hash table, where structs would have to be sorted.
    ends = [e for k in names for e in (F.max(own[f"{k}x"]).alias(f"{k}x"), F.max_by(own[f"{k}y"], own[f"{k}x"]).alias(f"{k}y"))]
    doors = positions.groupBy("scenario_id", "mmsi", "event_id").agg(*ends)
    # A task's share of the tow points is small, so it is hashed rather than both sides sorted.
    both = doors.join(tow.select("mmsi", "event_id", "x", "y", "depth").hint("shuffle_hash"), ["mmsi", "event_id"]).join(F.broadcast(grid), "scenario_id")
    door = lambda k: {"x": F.col(f"{k}x"), "y": F.col(f"{k}y")}
    apart, loose = closure_faults(door("_p"), door("_s"), {"x": F.col("x"), "y": F.col("y")}, F.col("depth") + depth_offset)
    count = lambda wrong: F.count_if(F.coalesce(wrong, F.lit(True)))
    return both.groupBy("scenario_id").agg(F.count("*").alias("points"), count(apart).alias("open_doors"), count(loose).alias("open_warps"))


def differs_much(got: Column, wanted: Column, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    return F.abs(got - wanted) > atol + rtol * F.abs(wanted)


def reference_case(status: DataFrame) -> DataFrame:
    """The accepted scenario nearest the middle of the grid; ties go to the smallest (ratio, spread)."""
    span = lambda c: F.when(F.max(c) > F.min(c), F.max(c) - F.min(c)).otherwise(1.0)
    middle = lambda c: (F.min(c) + F.max(c)) / 2
    ends = status.agg(*(f(c).alias(f"{n}_{c}") for c in ("ratio", "spread") for n, f in (("span", span), ("mid", middle))))
    off = sum(F.abs(F.col(c) - F.col(f"mid_{c}")) / F.col(f"span_{c}") for c in ("ratio", "spread"))
    near = status.where("accepted").crossJoin(ends).withColumn("_off", off)
    best = near.agg(F.min(F.struct("_off", "ratio", "spread", "scenario_id")).alias("b"))
    return best.where("b is not null").select("b.scenario_id", "b.ratio", "b.spread")


def missing_cells(status: DataFrame) -> DataFrame:
    """(ratio, spread) pairs of the grid's margins without a scenario; any makes the grid incomplete."""
    whole = status.select("ratio").distinct().crossJoin(status.select("spread").distinct())
    return whole.join(status, ["ratio", "spread"], "left_anti")


def result_matrix(status: DataFrame, components: DataFrame) -> DataFrame:
    """(ratio, cells): by rising spread, 'spread:accepted:components', components once in first-seen order."""
    seen = components.groupBy("scenario_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("component", "t"))), lambda s: s["component"])).alias("names"))
    full = status.join(seen, "scenario_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    cell = F.concat_ws(":", F.col("spread").cast("int").cast("string"), F.col("accepted").cast("string"), F.array_join("names", "+"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("spread", cell.alias("cell")))), lambda s: s["cell"])
    return full.groupBy("ratio").agg(F.array_join(cells, ";").alias("cells"))
