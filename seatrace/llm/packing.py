"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, by residual levels.

Texts are tokenised where they lie; only documents longer than a sequence are cut. Pieces (without
their ids) are numbered and dealt to shards of bounded size by a hash of the number, so equal rows don't meet. Every shard packs its pieces best-fit, the
longest first, and closes the bins that are nearly full. The other bins are items of the next level:
groups of ``fan_in`` shards pack their items the same way, until one group is left, so bins of
different shards are joined. A group hands on at most ``carry`` items, the emptiest ones, and closes
the rest, so no task grows with the input. Every piece stays in exactly one sequence.

Edge cases: a null or empty text has the end id only; repeated rows are packed separately; null doc
ids are kept; an empty table gives no rows. Only doc_id and text are read, so other columns cannot
clash (``pack`` keeps other columns and replaces sequence_id and offset).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seatrace.llm.common import discard, fresh, scratch, text_slices
from seatrace.llm.tokenization import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special=True)
        end, kind = np.array([end_id], encode.typecode).tobytes(), np.dtype(encode.typecode)
        for batch in text_slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(encode.encode(text) + end, kind).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return texts.mapInArrow(pieces, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its offset there; items in order, each into the fullest bin it fits."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, n_bins = 0, 0  # bit r of rooms: a bin with room r is open
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, own, n_bins = capacity, n_bins, n_bins + 1
        bins[k], offsets[k] = own, capacity - room
        left = room - length
        if left:
            free[left].append(own)
            rooms |= 1 << left
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, slack: int = 8, shard_rows: int = 50_000, fan_in: int = 8, carry: int = 20_000) -> DataFrame:
    """pieces (with a column length of 1 to capacity) with sequence_id and offset."""
    keys = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row, shard, bin_, at, filled, into, shift = fresh("row", "shard", "bin", "at", "fill", "into", "shift")
    shards = max(1, -(-pieces.count() // shard_rows))
    numbered = scratch(pieces.select(*keys).withColumn(row, F.monotonically_increasing_id()), "numbered")
    dealt = numbered.withColumn(shard, F.pmod(F.xxhash64(row), F.lit(shards)).cast("int"))
    level = 0

    def local(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        order = np.lexsort((rows[row].to_numpy(), -lengths))
        bins, offsets = best_fit(lengths[order], capacity)
        fill = np.bincount(bins, lengths[order]).astype(np.int64)
        rows = rows.take(pa.array(order)).drop_columns([shard])
        for name, values in ((bin_, key[0].as_py() << 32 | bins), (at, offsets), (filled, fill[bins])):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    placed = dealt.groupBy(shard).applyInArrow(local, StructType([*numbered.schema, *(StructField(c, LongType()) for c in (bin_, at, filled))]))
    placed = scratch(placed.drop(row), "placed")
    discard(numbered)
    open_ = placed.where(F.col(filled) < capacity - slack).select(F.col(bin_).alias("item"), F.col(filled).alias("fill")).distinct()
    open_ = open_.withColumn("node", F.shiftright("item", 32))
    moves = None
    while True:
        level += 1
        shards = -(-shards // fan_in)
        open_ = open_.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        merged = scratch(open_.groupBy("node").applyInPandas(_merger(level, capacity, slack, carry), "node long, item long, into long, shift long, fill long, keep boolean"), f"merged{level}")
        step = merged.select("item", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("item").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
            moves = moves.join(later, "into", "left").select("item", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
        if shards == 1:
            break
        open_ = merged.where("keep").select("node", F.col("into").alias("item"), "fill").distinct()
    moves = moves.select(F.col("item").alias(bin_), F.col("into").alias(into), F.col("shift").alias(shift))
    out = placed.join(moves, bin_, "left")
    return out.select(*keys, F.coalesce(into, bin_).alias("sequence_id"), (F.col(at) + F.coalesce(shift, F.lit(0))).alias("offset"))


def _merger(level: int, capacity: int, slack: int, carry: int):
    def merge(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "item"], ascending=[False, True])
        bins, offsets = best_fit(items["fill"].to_numpy(), capacity)
        fill = np.bincount(bins, items["fill"]).astype(np.int64)
        order = np.argsort(fill, kind="stable")  # the emptiest go on
        keep = np.zeros(len(fill), bool)
        keep[order[:carry]] = True
        keep &= fill < capacity - slack
        into = level << 56 | int(key[0]) << 32 | bins
        return pd.DataFrame({"node": key[0], "item": items["item"].to_numpy(), "into": into, "shift": offsets, "fill": fill[bins], "keep": keep[bins]})

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(scratch(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, **how)
