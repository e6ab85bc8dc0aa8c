"""Timed crossings of moving points over polylines.

Nulls: a step or a segment with a null coordinate or time meets nothing; tracks of one point have no steps; empty
tables have no crossings. Repeated points make steps of no length, which cross nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seatrace.operators.cells import touched_cells
from seatrace.operators.sweep import differs

#: Hits of one track closer than this (microseconds) are one crossing, e.g. at a shared vertex.
SAME_US = 1.0
#: Lines are parallel if their cross product is within this share of its terms, and lie on one another within TOUCH.
ROUNDING, TOUCH = 2.0**-50, 1e-9


def clip_steps(steps: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """Steps (t0, t1, x0, y0, x1, y1) cut to [start, end]; steps outside are left out."""
    if start is None and end is None:
        return steps
    a = F.greatest(F.col("t0"), F.lit(start)) if start is not None else F.col("t0")
    b = F.least(F.col("t1"), F.lit(end)) if end is not None else F.col("t1")
    cut = steps.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double")).where("_a < _b")
    at = lambda p, t: F.col(f"{p}0") + (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0")) * (F.col(f"{p}1") - F.col(f"{p}0"))
    ends = {f"{p}{k}": at(p, t) for p in "xy" for k, t in enumerate(("_a", "_b"))}
    return cut.withColumns({f"_{c}": e for c, e in ends.items()}).drop(*ends, "t0", "t1").withColumnsRenamed({f"_{c}": c for c in ends} | {"_a": "t0", "_b": "t1"})


def _meetings(steps: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """Pairs that meet, with _u and _to, the parts of the step where they begin and end to do so.

    Steps and segments are listed in the cells that they touch and joined on the cell; a pair counts in the
    cell of its first common point only. Parallel lines meet where they lie on one another: within
    TOUCH of the step, from _u to _to. Steps and segments without length meet nothing.
    """
    listed = touched_cells(steps, ("x0", "y0", "x1", "y1"), cell)
    lines = touched_cells(segments, ("cx0", "cy0", "cx1", "cy1"), cell)
    near = listed.join(lines.select("_gx", "_gy").distinct(), ["_gx", "_gy"], "left_semi").join(lines, ["_gx", "_gy"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ex, ey = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    px, py = F.col("cx0") - F.col("x0"), F.col("cy0") - F.col("y0")
    cross = _computed(near, {"_den": dx * ey - dy * ex, "_across": px * dy - py * dx, "_over": px * ey - py * ex, "_squared": dx * dx + dy * dy, "_terms": F.abs(dx * ey) + F.abs(dy * ex)})
    cross = cross.where((F.col("_squared") > 0) & ((ex != 0) | (ey != 0)))
    parallel = F.abs("_den") <= ROUNDING * F.col("_terms")
    # Most pairs of a cell don't meet, which shows without a division: both parts lie between 0 and den, but for rounding.
    within = lambda part: (F.col(part) * F.signum("_den") >= 0) & (F.abs(part) <= F.abs("_den") * (1 + ROUNDING))
    on = F.abs("_across") <= TOUCH * F.sqrt("_squared")
    cross = cross.where(F.when(parallel, on).otherwise(within("_over") & within("_across")))
    along = lambda x, y: ((F.col(x) - F.col("x0")) * dx + (F.col(y) - F.col("y0")) * dy) / F.col("_squared")
    ends = _computed(cross, {"_first": F.when(parallel, along("cx0", "cy0")), "_last": F.when(parallel, along("cx1", "cy1")), "_crossed": F.when(~parallel, F.col("_over") / F.col("_den")), "_v": F.when(~parallel, F.col("_across") / F.col("_den")).otherwise(0.0)})
    u = F.coalesce("_crossed", F.greatest(F.least("_first", "_last"), F.lit(0.0)))
    to = F.coalesce("_crossed", F.least(F.greatest("_first", "_last"), F.lit(1.0)))
    met = _computed(ends, {"_u": u, "_to": to}).where("_u between 0 and 1 and _v between 0 and 1 and _u <= _to")
    place = lambda p: F.floor((F.col(f"{p}0") + F.col("_u") * (F.col(f"{p}1") - F.col(f"{p}0"))) / cell).cast("long")
    kept = met.where((F.col("_gx") == place("x")) & (F.col("_gy") == place("y")))
    return kept.drop("_gx", "_gy", "_den", "_across", "_over", "_squared", "_terms", "_first", "_last", "_crossed", "_v")


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row: conditions on them aren't rewritten as conditions on what they come from."""
    made = df.withColumn("_made", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
    return made.select(*df.columns, *(F.col(f"_made.{name}") for name in columns))


def crossing_hits(steps: DataFrame, segments: DataFrame, cell: float, parts: bool = True) -> DataFrame:
    """All points where steps meet lines: step columns, cable_id, seg, t, cx, cy.

    Where a step runs along a line, no point of that stretch is a hit. With ``parts`` the step's other
    meetings with the line are; without, a step that runs along a line anywhere has no hit with it.
    """
    met = _meetings(steps, segments, cell)
    hits = _visible(met, Window.partitionBy(*steps.columns, "cable_id"), parts)
    return _placed(hits).drop("_u", "_to")


def _visible(met: DataFrame, of: WindowSpec, parts: bool) -> DataFrame:
    """Meetings that aren't hidden by a stretch of the same step along the same line, which are one partition of ``of``."""
    covers = F.when(F.col("_to") > F.col("_u"), F.col("_to"))
    if parts:
        reach = F.max(covers).over(of.orderBy("_u", F.desc("_to")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hidden = F.coalesce(reach >= F.col("_u"), F.lit(False))
    else:
        hidden = F.max(covers).over(of).isNotNull()
    return met.withColumn("_hidden", hidden).where("not _hidden").drop("_hidden")


def _placed(met: DataFrame) -> DataFrame:
    along = lambda p: F.col(f"{p}0") + F.col("_u") * (F.col(f"{p}1") - F.col(f"{p}0"))
    return met.withColumn("t", along("t")).withColumn("cx", along("x")).withColumn("cy", along("y"))


def without_repeats(hits: DataFrame, keys: list[str], same: float = SAME_US) -> DataFrame:
    """Hits that come at least ``same`` after the last one kept of the same track and line.

    Hits are sorted by track in one shuffle and pass by in batches with the time of the last kept one.
    A hit that far from the one before is kept in any case, so only runs of closer ones are walked.
    """
    return _kept(_dealt(hits, keys), keys, same)


def _dealt(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits with _track, a hash of the keys, which deals them to tasks.

    The planner leaves keys that are constant out of what a window asks for, but not out of what rows were dealt by, and then deals
    them anew by the window's other keys; with the hash in both, it needn't.
    """
    return hits.withColumn("_track", F.xxhash64(*keys)).repartition("_track")


def _kept(hits: DataFrame, keys: list[str], same: float) -> DataFrame:
    """``without_repeats`` of hits with _track."""
    slim = hits.drop("_track")
    columns = slim.columns
    at = columns.index("t")
    ids = [columns.index(k) for k in keys]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, last = None, 0.0, 0.0  # of the row before: its track, its time, the last kept time
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            times = batch.column(at).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)  # starts a track
            if n > 1:
                new[1:] = np.any([differs(batch.column(k)) for k in ids], axis=0)
            own = tuple(batch.column(k)[0].as_py() for k in ids)
            new[0] = own != key
            free = new | (np.diff(times, prepend=before) >= same)
            for k in np.flatnonzero(~free).tolist():
                if k and free[k - 1]:  # else the last kept one is known from the rows before
                    last = times[k - 1]
                if times[k] - last >= same:
                    free[k], last = True, times[k]
            if free[-1]:
                last = times[-1]
            key, before = tuple(batch.column(k)[n - 1].as_py() for k in ids), times[-1]
            yield batch.filter(pa.array(free))

    # Whatever the steps before made of the rows' places, all of a track are dealt to one task; the planner takes this shuffle away where they are there already.
    # Texts of keys often begin alike, so rows are sorted by the hash of all keys first.
    ordered = hits.repartition("_track").sortWithinPartitions("_track", *keys, "t", "seg")
    return ordered.drop("_track").mapInArrow(kept, slim.schema)


def crossings(steps: DataFrame, segments: DataFrame, keys: list[str], cell: float, start: float | None = None, end: float | None = None, parts: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Crossings with start <= t < end, once each; see ``crossing_hits`` for ``parts``.

    Of the columns of ``crossing_hits``, only ``columns``, if given, and those that order the hits are kept. Meetings go
    by track and line through one shuffle, with a hash in place of their step.
    """
    cut, tracks = clip_steps(steps, start, end), [*keys, "cable_id"]
    placed = _placed(_meetings(cut, segments, cell))
    wanted = columns or [c for c in placed.columns if c not in ("_u", "_to")]
    slim = placed.select(F.xxhash64(*cut.columns).alias("_step"), "_u", "_to", *dict.fromkeys([*wanted, *tracks, "seg", "t"]))
    hits = _visible(_dealt(slim, tracks), Window.partitionBy("_track", "_step", *tracks), parts).drop("_step", "_u", "_to")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("t") >= start)
    if end is not None:
        inside = inside & (F.col("t") < end)
    return _kept(hits.where(inside), tracks, SAME_US)


def checked_crossings(hits: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """hits as they are; one outside start <= t < end, or two of the same keys at one time, are an error when they are read."""
    twice = F.count("*").over(Window.partitionBy(*keys, "t")) > 1
    inside = F.coalesce((F.col("t") >= start) & (F.col("t") < end), F.lit(False))
    wrong = F.when(~inside, F.raise_error(F.lit("a crossing outside the interval")).cast("double")).when(F.col("_twice"), F.raise_error(F.lit("a crossing comes twice")).cast("double"))
    return hits.withColumn("_twice", twice).withColumn("t", F.coalesce(wrong, F.col("t"))).drop("_twice")


def crossing_metrics(hits: DataFrame, start: str, end: str) -> DataFrame:
    """(component, crossings, inside, scenarios, vessels) of hits; inside are those with start <= t < end."""
    a, b = (F.unix_micros(F.lit(d).cast("timestamp")) for d in (start, end))
    inside = (F.col("t") >= a) & (F.col("t") < b)
    counts = [F.count("*").alias("crossings"), F.count_if(inside).alias("inside"), F.count_distinct("scenario_id").alias("scenarios"), F.count_distinct("mmsi").alias("vessels")]
    return hits.groupBy("component").agg(*counts)
