"""Token-id files: a wavelet matrix per shard, in compressed file images that Spark writes and reads.

An image holds the ids of a run of documents as blocks of 2 ** 17 ids. A block is a wavelet matrix:
one plane of bits for each binary digit of an id, from the highest on, each plane in the order that
stable partition by the planes above leaves, and the number of ones before every 512th bit of each
plane. That gives ``access``, ``rank`` (how often an id stands before a position), ``count`` and
``select``/``occurrences`` without unpacking the ids, and ``ids`` unpacks all of them.

Layout of an image (integers little-endian): magic ``WVM1``, then zstd frames, each after its
length: a JSON header, doc ids (int64), a byte per document that is 1 for a null doc id, ids per
document (uint32), and for each block its planes and its counts.

Images travel in a table (shard, part, n_docs, n_tokens, image), so they are written and read by
Spark's own writers on any shared store.

Edge cases: a null or empty text has the end id only; null doc ids come first; rows with equal
doc_id are ordered by text; an empty table gives no images and no rows. Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.common import scratch
from seatrace.llm.tokenization import encoder

MAGIC = b"WVM1"
BLOCK = 1 << 17
STEP = 512
IMAGES = "shard int, part int, n_docs long, n_tokens long, image binary"
DOCS = "shard int, part int, doc_id long, before long, n_tokens long, ids_crc32 long"


class WaveletBlock:
    """The planes of one block: bits[k] is packed, ones[k][j] counts its ones before bit STEP * j."""

    def __init__(self, n: int, bits: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.bits, self.ones = n, bits, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletBlock:
        bits, ones = [], []
        for k in range(width - 1, -1, -1):
            set_ = (ids & ids.dtype.type(1 << k)) != 0
            bits.append(np.packbits(set_))
            sums = np.add.reduceat(set_, np.arange(0, len(ids), STEP), dtype=np.uint32)
            ones.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32))
            ids = np.concatenate([ids.take(np.flatnonzero(~set_)), ids.take(np.flatnonzero(set_))])
        return cls(len(ids), bits, ones)

    def ids(self, dtype=np.uint32) -> np.ndarray:
        """All ids, from the lowest plane up."""
        value = np.zeros(self.n, dtype)
        for k, packed in enumerate(reversed(self.bits)):
            set_ = np.unpackbits(packed, count=self.n).view(bool)
            low, high = np.flatnonzero(~set_), np.flatnonzero(set_)
            above = np.empty_like(value)
            above[low] = value[: len(low)]
            above[high] = value[len(low) :] | dtype(1 << k)
            value = above
        return value

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        j = i // STEP
        rest = self.bits[plane][j * STEP // 8 : (i + 7) // 8]
        return int(self.ones[plane][j]) + int(np.unpackbits(rest, count=i - j * STEP).sum()) if i % STEP else int(self.ones[plane][j])

    def access(self, i: int) -> int:
        value = 0
        for plane in range(len(self.bits)):
            bit = self._bit(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + self._ones(plane, i) if bit else i - self._ones(plane, i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of token among the first ``end`` ids stand below the last plane."""
        start, width = 0, len(self.bits)
        for plane in range(width):
            if token >> (width - 1 - plane) & 1:
                start, end = (self.zeros[plane] + self._ones(plane, i) for i in (start, end))
            else:
                start, end = (i - self._ones(plane, i) for i in (start, end))
        return start, end

    def rank(self, token: int, end: int) -> int:
        start, stop = self._range(token, end)
        return stop - start

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        ones = self.ones[plane].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * STEP, self.n) - ones
        j = int(np.searchsorted(before, k, side="right")) - 1
        piece = np.unpackbits(self.bits[plane][j * STEP // 8 : (j + 1) * STEP // 8], count=min(STEP, self.n - j * STEP))
        return j * STEP + int(np.flatnonzero(piece == bit)[k - int(before[j])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token, which must exist."""
        width = len(self.bits)
        i = self._range(token, self.n)[0] + k
        for plane in range(width - 1, -1, -1):
            bit = token >> (width - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self.zeros[plane] if bit else i)
        return i


class TokenFile:
    """One image: documents and their ids."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, blocks: list[WaveletBlock]):
        self.doc_ids, self.nulls, self.lengths, self.blocks = doc_ids, nulls, lengths, blocks

    @classmethod
    def build(cls, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> TokenFile:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        blocks = [WaveletBlock.build(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        return cls(np.array([d or 0 for d in doc_ids], np.int64), nulls, np.array(lengths, np.uint32), blocks)

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        header = {"sizes": [b.n for b in self.blocks], "width": len(self.blocks[0].bits) if self.blocks else 0}
        parts = [json.dumps(header).encode(), self.doc_ids.tobytes(), self.nulls.tobytes(), self.lengths.tobytes()]
        for block in self.blocks:
            parts += [b"".join(b.tobytes() for b in block.bits), b"".join(o.tobytes() for o in block.ones)]
        return MAGIC + b"".join(struct.pack("<Q", len(z)) + z for z in map(pack, parts))

    @classmethod
    def from_bytes(cls, image: bytes) -> TokenFile:
        import zstandard

        if image[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix image")
        unpack, at, parts = zstandard.ZstdDecompressor().decompress, 4, []
        while at < len(image):
            (size,) = struct.unpack_from("<Q", image, at)
            parts.append(unpack(image[at + 8 : at + 8 + size]))
            at += 8 + size
        header = json.loads(parts[0])
        blocks = []
        for k, n in enumerate(header["sizes"]):
            planes = np.frombuffer(parts[4 + 2 * k], np.uint8).reshape(header["width"], -1)
            blocks.append(WaveletBlock(n, list(planes), list(np.frombuffer(parts[5 + 2 * k], np.uint32).reshape(header["width"], -1))))
        return cls(np.frombuffer(parts[1], np.int64), np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], np.uint32), blocks)

    def ids(self) -> np.ndarray:
        dtype = np.uint16 if self.blocks and len(self.blocks[0].bits) <= 16 else np.uint32
        return np.concatenate([b.ids(dtype) for b in self.blocks] or [np.zeros(0, dtype)])

    def access(self, i: int) -> int:
        return self.blocks[i // BLOCK].access(i % BLOCK)

    def count(self, token: int) -> int:
        return sum(b.rank(token, b.n) for b in self.blocks if token >> len(b.bits) == 0)

    def occurrences(self, token: int) -> Iterator[int]:
        for k, block in enumerate(self.blocks):
            if token >> len(block.bits) == 0:
                yield from (k * BLOCK + block.select(token, j) for j in range(block.rank(token, block.n)))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_bytes: int = 16 << 20, image_tokens: int = 1 << 22) -> DataFrame:
    """The table of images, in ascending doc_id: range-partitioned shards, cut after image_tokens ids.

    Rows of one id, or of none, are cut into shards by the first letters of their texts, which is their order.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = texts.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, part = encoder(tokenizer, special=True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode.typecode).tobytes()
        ids, lengths, packed, n = [], [], [], 0

        def image() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(packed), encode.typecode)
            row = (shard, part, len(ids), n, TokenFile.build(ids, lengths, whole).to_bytes())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], IMAGE_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed.append(encode.encode(text) + end)
                ids.append(doc_id)
                lengths.append(len(packed[-1]) // len(end))
                n += lengths[-1]
                if n >= image_tokens:
                    yield image()
                    ids, lengths, packed, n, part = [], [], [], 0, part + 1
        if ids:
            yield image()

    return scratch(ranges.mapInArrow(images, IMAGES), "tokens", compression="uncompressed")


IMAGE_NAMES = [x.split()[0] for x in IMAGES.split(", ")]
DOC_NAMES = [x.split()[0] for x in DOCS.split(", ")]


def read_token_files(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the images alone."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = TokenFile.from_bytes(batch.column(2)[k].as_py())
                ids, ends = file.ids(), np.cumsum(file.lengths, dtype=np.int64)
                starts = ends - file.lengths
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                where = [pa.array(np.full(len(ends), batch.column(j)[k].as_py()), pa.int32()) for j in (0, 1)]
                rest = [pa.array(file.doc_ids, pa.int64(), mask=file.nulls.astype(bool)), pa.array(starts), pa.array(file.lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(where + rest, DOC_NAMES)

    found = images.select("shard", "part", "image").mapInArrow(documents, DOCS)
    # Ids before each image: the window runs over one row per image.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = images.select("shard", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, ["shard", "part"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(images: DataFrame, token: int) -> DataFrame:
    """(shard, part, position) of every occurrence of a token id, by rank and select."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, image in zip(*(c.to_pylist() for c in batch.columns)):
                at = list(TokenFile.from_bytes(image).occurrences(token))
                columns = [pa.array([shard] * len(at), pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "position"])

    return images.select("shard", "part", "image").mapInArrow(found, "shard int, part int, position long")
