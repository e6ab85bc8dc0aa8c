"""Token counts of whole texts: only lengths leave the tasks, ids are never kept.

A task takes its texts in batches balanced by bytes, and a long text in parts that are cut only where
the vocabulary provably has a boundary (before a space or a line end that follows a character that is
no white space), so its memory follows neither the number of rows nor the length of a text. Words seen
before are looked up in a bounded cache of the worker. Texts or vocabularies without such boundaries go
to the library whole; counts equal the library's in every case.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are counted each;
strings of special tokens count as by the library's default (one token in the tokenizers library, plain
text in sentencepiece); an empty table gives no rows. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrace.llm.common import text_slices
from seatrace.llm.tokenization import encoder, safe_parts, sentence_pieces

#: Characters of a part of a long text.
PART = 1 << 20


def counter(tokenizer: str, part: int = PART) -> Callable[[str], int]:
    """The function that counts a text's tokens by the file's library: sentencepiece for .model, else tokenizers."""
    if tokenizer.endswith(".model"):
        model = sentence_pieces(tokenizer)
        # A part after the first begins with the space that the model would put before it, or with a line end.
        return lambda text: sum(map(model.count_chunks, safe_parts(" " + text, part))) if model.may_cut(text) else model.count(text)
    encode = encoder(tokenizer, special=True)
    width = array(encode.typecode).itemsize
    if encode.kind == "whole" or any(re.search(r"\s", t.content) for t in encode.library.get_added_tokens_decoder().values()):
        return lambda text: len(encode.encode(text)) // width
    return lambda text: sum(len(encode.encode(p)) for p in safe_parts(text, part)) // width


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, part: int = PART) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, part)
        for batch in text_slices(batches, 1):
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            lengths = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lengths], ["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
