"""Near-duplicate groups by bottom-k sketches of word shingles, confirmed on the full sets.

One hash function orders all shingles; a document's sketch is the k = 64 smallest of its set. Two
documents with Jaccard similarity 0.8 share 51 of the 64 smallest values of their union on average;
fewer than ``SHARED`` = 33 has a probability below 1e-7, and for sets of at most 40 shingles the
least overlap follows exactly (``k=None`` retains whole sets, for which it always does). So among
retained values in a common order, rarest first, the first (size - least overlap + 1) of two linked
documents must meet. Inverted lists therefore hold only these prefixes, lengthened by two so that linked pairs
meet at least three times: values that no other document retains come first and need no list, and
very common values fall out at the end.

1. One pass over the texts: set size, digest and sketch. Equal sets are one node from here on.
2. Inverted lists of the prefixes. Lists of up to ``short`` members give all their pairs, longer ones
   pair every member with the list's pivot only, the member whose retained values are the most
   widely shared. Pairs that meet often enough and whose union-sketch estimate reaches ``SHARED`` / k
   are confirmed on the full sets, and confirmed links give first components. A large group of copies
   is nearly one component after that, without a pair for each two of its members.
3. Long lists that still hold several components: their members bring their sketches, and a member
   stays if it has enough retained values in common with one of another component. Lists of more than a slot's
   members are cut into pairs of slots for that, so no list is one task's group; the members of its main
   component meet the others only. Then a node's home is
   the longest list that it stays in, and two homes meet if a list has members of both. The nodes of
   a home are dealt into slots of bounded size, those of the home's main component apart. Two slots of
   homes that meet are one tile, a task's group: there all overlaps of full sets come from one sparse
   product, and what leaves the task is a spanning forest of the links between components, not pairs.
   Slots of one and the same component don't meet. Every pair that meets in a long list and has
   enough in common is in a tile, so no list is cut short.
4. The components of step 2 are joined by the links between them; each document gets the smallest
   doc_id of its component.

Edge cases: a null or empty text has no shingles and is linked with nothing; fewer words than a
shingle are one shingle; rows with equal doc_id are rows of their own, linked by their texts only; a
null doc_id is never a component's name: the row takes the name of its component, or null if that has
no other, and is kept only in that case; an empty table gives no rows. Shingles are compared by 64-bit
hashes, digests have 128 bits. Only doc_id and text are read, so other columns cannot clash
(``drop_near_duplicates`` keeps all columns).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.common import discard, scratch, sized, text_slices
from seatrace.llm.components import connected_components, roots
from seatrace.llm.tokenization import Cache

SKETCH, SHARED, MEETINGS = 64, 33, 3
SHORT = 8
#: Of a slot: nodes, and shingles of all its nodes (on average; a larger set is a slot's own).
SLOT_NODES, SLOT_SHINGLES = 1024, 1 << 17
#: Columns of a product at a time, and cells of a column above which it goes through the product.
WIDTH, CELLS = 2048, 256
WORD_HASHES = 200_000
PRIME, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes() -> Cache:
    """A task's cache; it goes with the task, so that an idle worker holds none."""
    return Cache(xxhash.xxh3_64_intdigest, WORD_HASHES)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, size: int, hashes: Cache) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of ``size`` words, A-Z lower-cased."""
    words = text.lower().split()
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * PRIME + own[k : len(words) - n + 1 + k])
    return np.unique(h)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def texts_of(docs: DataFrame, row: str | None) -> DataFrame:
    number = F.col(row) if row else F.lit(0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("long").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def sketches(texts: DataFrame, size: int, k: int | None) -> DataFrame:
    """doc_id, row, n_shingles, digest of the set, sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in text_slices(batches, 2):
            sets = [shingle_set(t, size, hashes) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), batch.column(1), n, pa.array(map(_digest, sets), pa.binary()), _lists([s[:k] for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "digest", "sketch"])

    return texts.mapInArrow(sketch, "doc_id long, row long, n_shingles long, digest binary, sketch array<long>")


def full_sets(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of nodes (node, first, digest), by the text of the row named in first."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in text_slices(batches, 1):
            found = [shingle_set(t, size, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, found), pa.binary()), _lists(found)], ["key", "digest", "shingles"])

    key = F.xxhash64(F.col("first.doc_id"), F.col("first.row")).alias("key")
    wanted = scratch(nodes.select("node", key, "digest"), "wanted")
    keyed = texts.select(F.xxhash64("doc_id", "row").alias("key"), "text")
    chosen = keyed.join(sized(wanted.select("key").distinct()), "key", "left_semi")
    found = chosen.mapInArrow(sets, "key long, digest binary, shingles array<long>")
    # One row a node where rows repeat an id and a text.
    return found.join(sized(wanted), ["key", "digest"]).select("node", "shingles").dropDuplicates(["node"])


def least_overlap(n: Column, percent: int, k: int | None) -> Column:
    """Retained values that a document with n shingles shares at least with one it is linked to."""
    exact = F.ceil(n * percent / 100)
    return (F.least(exact, F.lit(SHARED)) if k else exact).cast("int")


def inverted_lists(nodes: DataFrame, percent: int, k: int | None) -> DataFrame:
    """(value, node, n, centre): the prefixes of nodes (node, n, sketch) in order of rarity.

    centre is the mean logarithm of how many nodes retain each value of the sketch.
    """
    entries = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").count().where("count > 1")
    counted = entries.join(shared, "value")
    retained = F.least(F.col("n"), F.lit(k)) if k else F.col("n")
    own = F.sort_array(F.collect_list(F.struct("count", "value"))).alias("own")  # of one sketch
    ordered = counted.groupBy("node", "n").agg(own, F.sum(F.log2("count")).alias("spread")).withColumn("centre", F.col("spread") / retained)
    prefix = retained - least_overlap(F.col("n"), percent, k) + MEETINGS
    ranked = ordered.withColumn("room", (prefix - (retained - F.size("own"))).cast("int")).where("room > 0")
    return ranked.select("node", "n", "centre", F.explode(F.slice("own", 1, F.col("room"))["value"]).alias("value"))


def near_in_size(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def short_pairs(lists: DataFrame, sizes: DataFrame, percent: int, short: int) -> DataFrame:
    """(a, na, b, nb): all pairs of lists of at most short members, each member with those after it."""
    after = Window.partitionBy("value").orderBy("node").rowsBetween(1, short - 1)
    members = lists.join(sizes.where(F.col("size") <= short).select("value"), "value")
    others = F.collect_list(F.struct("node", "n")).over(after)
    met = members.select("node", "n", F.filter(others, lambda o: near_in_size(o["n"], F.col("n"), percent)).alias("others"))
    return met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode("others").alias("o")).select("a", "na", F.col("o.node").alias("b"), F.col("o.n").alias("nb"))


def star_pairs(lists: DataFrame, long_lists: DataFrame, percent: int) -> DataFrame:
    """(a, na, b, nb): the pivot of every one of long_lists with each other member."""
    pairs = lists.join(long_lists, "value").where(F.col("pivot.node") != F.col("node")).where(near_in_size(F.col("pivot.n"), F.col("n"), percent))
    return pairs.select(F.col("pivot.node").alias("a"), F.col("pivot.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))


def met_pairs(pairs: DataFrame, percent: int, k: int | None) -> DataFrame:
    """Distinct (a, b) of pairs (a, na, b, nb), each as often as they meet, that meet often enough."""
    counted = pairs.groupBy("a", "b", "na", "nb").count()
    need = F.least(F.lit(MEETINGS), least_overlap(F.col("na"), percent, k), least_overlap(F.col("nb"), percent, k))
    return counted.where(F.col("count") >= need).select("a", "b")


def unsigned(value: Column) -> Column:
    """Order of a hash kept as a signed integer, as if unsigned."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the estimate on their union sketch doesn't rule out."""
    own = scratch(nodes.select("node", "sketch").join(sized(ends_of(pairs)), "node", "left_semi"), "own")
    side = lambda x: own.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), unsigned)), 1, SKETCH)
    common = F.size(F.array_intersect(F.transform(F.array_intersect("sa", "sb"), unsigned), union))
    likely = scratch(both.where(common * SKETCH >= SHARED * F.size(union)).select("a", "b"), "likely")
    discard(own)
    return likely


def linked_pairs(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), by their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = likely.join(side("b"), "b").join(side("a"), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    linked = inter * 100 >= (F.size("sa") + F.size("sb") - inter) * percent
    return scratch(both.where(linked).select("a", "b"), "links")


def likely_members(lists: DataFrame, parts: DataFrame, nodes: DataFrame, percent: int, k: int | None) -> DataFrame:
    """The rows of lists (value, size, node, n), with part, whose node has a likely partner of another part there.

    A node without a part is its own. Linked nodes have at least so many retained values in common as the
    smaller need of the two says.
    """
    named = lists.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    counts = named.groupBy("value", "part").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("value").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("all")).where("all > main.c")
    slots_of = lambda c: F.ceil(c / SLOT_NODES).cast("int")
    mixed = mixed.select("value", F.col("main.part").alias("main"), slots_of(F.col("all") - F.col("main.c")).alias("others"), slots_of(F.col("main.c")).alias("mains"))
    several = scratch(named.join(mixed, "value"), "several")
    own = scratch(nodes.select("node", "sketch").join(sized(several.select("node").distinct()), "node", "left_semi"), "own")
    # A list's main part has slots of its own, which meet those of the other members only.
    is_main, deal = F.col("part") == F.col("main"), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    slot = F.when(is_main, F.col("others") + deal(F.col("mains"))).otherwise(deal(F.col("others")))
    met = F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rows = several.withColumn("i", slot).withColumn("j", F.explode(met))
    rows = rows.select("value", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).alias("second"), "node", "n", "part", least_overlap(F.col("n"), percent, k).alias("need"))

    def stay(tile: pa.Table) -> pa.Table:
        ia, ib = sides(tile)
        need, n, part = (tile[x].to_numpy() for x in ("need", "n", "part"))
        sets = array_rows(tile["sketch"])
        both = overlaps([sets[x] for x in ia], [sets[x] for x in ib])
        fit = (both >= np.minimum(need[ia][:, None], need[ib][None, :])) & (part[ia][:, None] != part[ib][None, :])
        fit &= np.minimum(n[ia][:, None], n[ib][None, :]) * 100 >= np.maximum(n[ia][:, None], n[ib][None, :]) * percent
        kept = np.union1d(ia[fit.any(1)], ib[fit.any(0)])
        return tile.select(["value", "node"]).take(pa.array(kept))

    stays = rows.join(own, "node").groupBy("value", "a", "b").applyInArrow(stay, "value long, node long").distinct()
    members = scratch(several.join(stays, ["value", "node"]).select("value", "size", "node", "n", "part"), "likely_members")
    discard(several, own)
    return members


def homes(several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, n, part, home) of lists (value, size, node, n, part), and the homes (a, b) that meet."""
    members = several.groupBy("node").agg(F.max(F.struct("size", "value"))["value"].alias("home"), F.first("n").alias("n"), F.first("part").alias("part"))
    members = scratch(members, "members")
    there = scratch(several.select("value", "node").join(members.select("node", "home"), "node").select("value", "home").distinct(), "there")
    other = there.select("value", F.col("home").alias("b"))
    met = there.withColumnRenamed("home", "a").join(other, "value").where("a < b").select("a", "b").distinct()
    own = members.select(F.col("home").alias("a"), F.col("home").alias("b")).distinct()
    return members, met.union(own)


def tiles(members: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, part, slot) in slots of bounded size, and the pairs (a, b) of slots to compare."""
    counts = members.groupBy("home", "part").count()
    main = counts.groupBy("home").agg(F.max(F.struct("count", "part"))["part"].alias("main"))
    sorted_out = scratch(members.join(main, "home").withColumn("alone", F.when(F.col("part") == F.col("main"), F.col("main"))), "sorted")
    room = F.greatest(F.count("*") / SLOT_NODES, F.sum("n") / SLOT_SHINGLES)
    slots = sorted_out.groupBy("home", "alone").agg(F.ceil(room).cast("int").alias("k"))
    slots = scratch(slots.select("home", "alone", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).withColumn("slot", F.monotonically_increasing_id()), "slots")
    dealt = sorted_out.join(slots.select("home", "alone", "k").distinct().withColumnRenamed("alone", "apart"), ["home"]).where("alone <=> apart")
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    where = slots.select(F.col("home").alias("at"), F.col("alone").alias("apart"), "i", "slot")
    dealt = dealt.drop("apart").join(where.withColumnRenamed("i", "j"), (F.col("home") == F.col("at")) & F.col("alone").eqNullSafe(F.col("apart")) & (F.col("i") == F.col("j")))
    side = lambda x: slots.select(F.col("home").alias(x), F.col("alone").alias(f"alone_{x}"), F.col("slot").alias(f"slot_{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b").where("a < b or slot_a <= slot_b")
    both = both.where("alone_a is null or alone_b is null or alone_a <> alone_b")
    return scratch(dealt.select("node", "part", "slot"), "dealt"), scratch(both.select(F.col("slot_a").alias("a"), F.col("slot_b").alias("b")), "tiles")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the sets a with each of the sets b.

    Values of few cells are added one by one, the others go through a product of 0/1 matrices.
    """
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    values, at = np.unique(np.concatenate([*a, *b, np.zeros(0, np.uint64)]), return_inverse=True)
    at = [at[: len(rows[0])], at[len(rows[0]) :]]
    cells = np.multiply(*(np.bincount(x, minlength=len(values)) for x in at))
    out = np.zeros(len(a) * len(b), np.int64)
    few = (cells > 0) & (cells <= CELLS)
    left, right = ((r[few[x]], x[few[x]]) for r, x in zip(rows, at, strict=True))
    order = np.argsort(right[1], kind="stable")
    begin, end = (np.searchsorted(right[1], left[1], side, sorter=order) for side in ("left", "right"))
    many = end - begin
    hits = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    out += np.bincount(np.repeat(left[0], many) * len(b) + right[0][order][hits], minlength=len(out))
    place = np.cumsum(cells > CELLS) - 1
    product = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int((cells > CELLS).sum()), WIDTH):
        x, y = (np.zeros((len(s), WIDTH), np.float32) for s in (a, b))
        for m, r, c in ((x, rows[0], at[0]), (y, rows[1], at[1])):
            own = (cells[c] > CELLS) & (place[c] >= start) & (place[c] < start + WIDTH)
            m[r[own], place[c[own]] - start] = 1
        product += x @ y.T
    return out.reshape(len(a), len(b)) + product.astype(np.int64)


def sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tile's two sides; a tile without second ones is compared with itself."""
    second = tile["second"].to_numpy()
    first = np.flatnonzero(~second)
    return first, np.flatnonzero(second) if second.any() else first


def array_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column.combine_chunks()]


def tile_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A tile's links between parts, as a spanning forest (a, b) of parts."""

    def link(tile: pa.Table) -> pa.Table:
        ia, ib = sides(tile)
        parts = tile["part"].to_numpy()
        sets = array_rows(tile["shingles"])
        both = overlaps([sets[k] for k in ia], [sets[k] for k in ib])
        na, nb = (np.array([len(sets[k]) for k in i], np.int64) for i in (ia, ib))
        linked = both * 100 >= (na[:, None] + nb[None, :] - both) * percent
        x, y = np.nonzero(linked & (parts[ia][:, None] != parts[ib][None, :]))
        pairs = np.unique(np.stack([parts[ia[x]], parts[ib[y]]], 1), axis=0)
        stars = [(p, q) for p, q in roots(pairs.tolist()).items() if p != q]
        return pa.table({"a": pa.array([p for p, _ in stars], pa.int64()), "b": pa.array([q for _, q in stars], pa.int64())})

    return link


def long_links(lists: DataFrame, parts: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, k: int | None) -> DataFrame:
    """Links (a, b) between parts whose nodes meet in lists (value, size, node, n)."""
    dealt, pairs = tiles(*homes(likely_members(lists, parts, nodes, percent, k)))
    used = dealt.join(sized(pairs.select(F.col("a").alias("slot")).union(pairs.select("b")).distinct()), "slot", "left_semi")
    sets = scratch(full_sets(texts, nodes.join(sized(used.select("node")), "node", "left_semi"), size), "sets")
    own = scratch(sets.join(used, "node").select("slot", "part", "shingles"), "own")
    discard(sets)
    first = own.join(pairs, F.col("slot") == F.col("a")).withColumn("second", F.lit(False))
    second = own.join(pairs.where("a <> b"), F.col("slot") == F.col("b")).withColumn("second", F.lit(True))
    both = first.union(second).select("a", "b", "second", "part", "shingles")
    links = scratch(both.groupBy("a", "b").applyInArrow(tile_links(percent), "a long, b long"), "links")
    discard(own)
    return links


def groups(docs: DataFrame, size: int, percent: int, k: int | None, short: int, row: str | None) -> DataFrame:
    """doc_id, row, n_shingles, and name, the first (no_id, doc_id, row) of the row's component."""
    texts = texts_of(docs, row)
    sketched = scratch(sketches(texts, size, k), "sketches")
    first = F.min(F.struct(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("first"), F.col("n_shingles").alias("n"), "sketch"))
    classes = sketched.where("n_shingles > 0").groupBy("digest").agg(first.alias("x")).select("digest", "x.*")
    classes = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Sets of fewer than four shingles are linked with equal sets only.
    nodes = classes.where(F.col("n") * (100 - percent) >= percent)
    lists = scratch(inverted_lists(nodes, percent, k), "lists")
    pivot = F.max(F.struct("centre", "node", "n")).alias("pivot")
    sizes = scratch(lists.groupBy("value").agg(F.count("*").alias("size"), pivot), "sizes")
    long_lists = sizes.where(F.col("size") > short)
    met = scratch(met_pairs(short_pairs(lists, sizes, percent, short).union(star_pairs(lists, long_lists, percent)), percent, k), "met")
    likely = likely_pairs(met, nodes)
    sets = scratch(full_sets(texts, nodes.join(sized(ends_of(likely)), "node", "left_semi"), size), "sets")
    links = linked_pairs(likely, sets, percent)
    discard(sets)
    parts = connected_components(links)
    further = connected_components(long_links(lists.join(long_lists.select("value", "size"), "value"), parts, nodes, texts, size, percent, k))
    further = further.select(F.col("node").alias("root"), F.col("component").alias("last"))
    joined = parts.join(further, F.col("component") == F.col("root"), "full")
    joined = joined.select(F.coalesce("node", "root").alias("node"), F.coalesce("last", "component").alias("component"))
    firsts = joined.join(classes.select("node", "first"), "node")
    names = firsts.groupBy("component").agg(F.min("first").alias("name"))
    named = joined.join(names, "component").select("node", "name")
    named = scratch(classes.select("digest", "node", "first").join(named, "node", "left").select("digest", F.coalesce("name", "first").alias("name")), "named")
    return sketched.select("doc_id", "row", "n_shingles", "digest").join(named, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int | None = SKETCH, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    component = F.when(F.col("n_shingles") > 0, F.col("name.doc_id")).otherwise(F.col("doc_id"))
    found = groups(docs, size, percent, k, short, None).select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int | None = SKETCH, short: int = SHORT) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id, all columns kept.

    Rows are numbered in a written table, so repeated and null ids are told apart. Texts aren't shuffled
    where few rows go.
    """
    number = f"row_{uuid.uuid4().hex}"
    rows = scratch(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = groups(rows, size, percent, k, short, number)
    gone = scratch(found.where((F.col("n_shingles") > 0) & (F.col("name.row") != F.col("row"))).select(F.col("row").alias(number)), "gone")
    return rows.join(sized(gone), number, "left_anti").drop(number)
