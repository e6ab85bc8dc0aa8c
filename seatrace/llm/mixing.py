"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a weight; its target is its share of all sizes, but at most ``max_epochs`` times
the source's own size. What the caps cut off is shared among the other sources by weight until no
source is above its cap. That fixed point has a closed form: with sources ordered by cap / weight,
the first ones are capped and the rest get weight x level.

A target of e epochs is drawn as floor(e) whole repetitions of every document and one more of a
seeded fraction. The fraction is taken systematically: documents of a source stand in the order of a
seeded hash of their id, then size, then a row number, and those before the point where the remaining
size is reached are repeated once more, so a source misses its target by at most half a document.
That point is found by narrowing: the sums of 4,096 buckets of the hash say in which one it lies, those
of its buckets in which of these, and so on down to the row, with partial sums at every step, so
neither a large source nor many rows of one id meet in one task.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; an empty
table gives no rows; documents of size 0 take 0; repeated rows, and rows with equal or null ids, are
separate documents of which only as many are taken as fit (among rows equal in id and size the row
number decides, which holds for one run over a stable input). Columns of the input named like the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.common import WORD, fresh, scratch, sized

#: Hex digits of the seeded hash that name a bucket (16 ** 3 buckets).
DIGITS = 3
ADDED = ("size", "source_size", "target", "repeats")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    The windows here run over one row per source, however many documents there are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.sum("cap").over(by_ratio) + F.col("cap")) / (
        F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight")
    )
    fills = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    # A source whose level, were it and all after it free, is above its cap is capped.
    fills = fills.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free["level"])
    return fills.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def same(a: Column | str, b: Column | str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def last_taken(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, end, whether it is taken): the row (hash, size, row) of each source in which its rest ends.

    slim has source, h, size and row; targets source and rest. Each step sums the sizes of the groups that a
    part of the order's key makes, finds the group of every source in which the rest ends, and keeps its rows.
    """
    steps = [F.substring("h", 1, DIGITS), F.substring("h", DIGITS + 1, DIGITS), F.col("h"), F.col("size"), F.shiftright("row", 33), F.col("row")]
    before = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside, ends = slim, targets.select("source", "rest")
    for k, step in enumerate(steps):
        sums = inside.groupBy("source", step.alias("key")).agg(F.sum("size").alias("sum"))
        sums = sums.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        rest = sized(ends.select(F.col("source").alias("of"), "rest"))
        found = sums.join(rest, same("source", "of")).where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("sum")))
        ends = scratch(found.select("source", F.col("key").alias("end"), (F.col("rest") - F.col("offset")).alias("rest")), f"ends{k}")
        here = sized(ends.select(F.col("source").alias("of"), "end"))
        inside = inside.join(here, same("source", "of") & (step == F.col("end"))).select(*slim.columns)
        if k < len(steps) - 1:
            inside = scratch(inside, f"inside{k}")
    last = inside.join(sized(ends.select(F.col("source").alias("of"), "rest")), same("source", "of"))
    return last.select("source", F.struct("h", "size", "row").alias("end"), (F.col("size") / 2 <= F.col("rest")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and repeats: how often the mix takes each row.

    size (by default the words of the text) is counted once, into a written copy of the rows with a number
    each; texts are never shuffled. A row per source is joined back, by broadcast if the sources are few.
    """
    row, h, whole, end, taken, of = fresh("row", "h", "whole", "end", "taken", "of")
    size = word_count(F.col("text")) if size is None else size
    counted = docs.withColumn("size", size).drop(*ADDED[1:]).withColumn(row, F.monotonically_increasing_id())
    rows = scratch(counted.withColumn(h, F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "rows")
    slim = rows.select("source", F.col(h).alias("h"), "size", F.col(row).alias("row"))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("times", F.least(times.cast("long"), F.lit(max_epochs)))
    targets = scratch(targets.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    ends = last_taken(slim, targets.where(F.col("times") < max_epochs)).withColumnRenamed("source", "last_of")
    plan = targets.join(ends, same("source", "last_of"), "left")
    plan = plan.select(F.col("source").alias(of), F.col("times").alias(whole), F.col("end").alias(end), F.col("taken").alias(taken), "source_size", "target")
    mixed = rows.join(sized(scratch(plan, "plan")), same("source", of), "left")
    own = F.struct(F.col(h).alias("h"), "size", F.col(row).alias("row"))
    extra = F.coalesce((own < F.col(end)) | ((own == F.col(end)) & F.col(taken)), F.lit(False))
    repeats = (F.col(whole).cast("int") + extra.cast("int")).alias("repeats")
    return mixed.select(*[c for c in docs.columns if c not in ADDED], "size", "source_size", "target", repeats)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as its repeats say, without the columns that mix_sources added."""
    (n,) = fresh("n")
    return mixed.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col("repeats")))).drop(n, *ADDED)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; of the text only its size is kept."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(slim, size=F.col("size"), **how)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
