import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seatrace.llm import packing, queries, wavelet
from seatrace.llm.tokenization import encoder
from tests.llm.samples import ODD, SF, documents, empty_docs, odd_docs, rows

PATHS = {n: public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}


def library(name, special=False):
    t = Tokenizer.from_file(PATHS[name])
    t.encode_special_tokens = not special
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(PATHS))
def test_encoder_equals_the_library(name):
    texts = [t for r in ODD if (t := r[1]) and len(t) < 10_000] + ["a  b", " lead", "trail ", "x\n\ny", "it's we'll", "<|endoftext|> a", "1234 a1b2", "éé", "a b", "don't\n stop"]
    fast, slow = encoder(PATHS[name]), library(name)
    for text in texts:
        assert np.frombuffer(fast.encode(text), fast.typecode).tolist() == slow.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", sorted(PATHS))
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab'sS \n\t12.!,é́ \x1c")), max_size=40))
def test_encoder_on_any_text(name, text):
    fast, slow = encoder(PATHS[name]), library(name)
    assert np.frombuffer(fast.encode(text), fast.typecode).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(PATHS))
def test_special_strings_as_by_the_librarys_default(name):
    fast, slow = encoder(PATHS[name], special=True), Tokenizer.from_file(PATHS[name])
    for text in ["plain words", "<|endoftext|>", "a <|endoftext|> b\n<|startoftext|>x", "a<|endoftext|>", "A <|ENDOFTEXT|> b", ""]:
        assert np.frombuffer(fast.encode(text), fast.typecode).tolist() == slow.encode(text, add_special_tokens=False).ids, text
    assert fast.encode("<|endoftext|>") != encoder(PATHS[name]).encode("<|endoftext|>")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_256), min_size=1, max_size=1500))
def test_wavelet_block(ids):
    x = np.array(ids, np.uint16)
    width = max(1, int(x.max()).bit_length())
    block = wavelet.WaveletBlock.build(x, width)
    assert block.ids(np.uint16).tolist() == ids
    for i in range(0, len(ids), 97):
        assert block.access(i) == ids[i]
        assert block.rank(ids[i], len(ids)) == ids.count(ids[i])
        assert block.rank(ids[i], i) == ids[:i].count(ids[i])
        assert block.select(ids[i], ids[:i].count(ids[i])) == i


def test_token_file_round_trip():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_257, 300_000).astype(np.uint16)
    file = wavelet.TokenFile.from_bytes(wavelet.TokenFile.build([1, None, 5], [100_000, 0, 200_000], ids).to_bytes())
    assert np.array_equal(file.ids(), ids) and file.lengths.tolist() == [100_000, 0, 200_000] and file.nulls.tolist() == [0, 1, 0]
    assert file.count(7) == int((ids == 7).sum()) and list(file.occurrences(7)) == np.flatnonzero(ids == 7).tolist()
    assert file.access(299_999) == ids[-1]
    with pytest.raises(ValueError):
        wavelet.TokenFile.from_bytes(b"nothing")


def check_files(data, got):
    t = library("byte_bpe_50k", special=True)
    want, start = [], 0
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)


def test_token_files(spark):
    check_files([(r["doc_id"], r["text"]) for r in documents(spark).collect()], rows(queries.op4_wavelet_files(spark, SF)))


def test_token_files_of_odd_rows(spark):
    files = wavelet.write_token_files(odd_docs(spark), PATHS["byte_bpe_50k"], shard_bytes=1 << 16, image_tokens=1 << 12)
    check_files([r[:2] for r in ODD], rows(wavelet.read_token_files(files)))
    assert files.count() > 3
    zeros = wavelet.occurrences(files, 0).count()
    assert zeros >= len(ODD)
    assert rows(wavelet.read_token_files(wavelet.write_token_files(empty_docs(spark), PATHS["byte_bpe_50k"]))) == []


def check_packing(data, got, capacity=2048):
    t = library("word_bpe_49k", special=True)
    want = []
    for doc_id, text in data:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        ends = [0, *np.cumsum([n for _, n in parts]).tolist()]
        assert [o for o, _ in parts] == ends[:-1] and ends[-1] <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_packing_of_the_driver_table(spark):
    sequences, tokens = check_packing([(r["doc_id"], r["text"]) for r in documents(spark).collect()], rows(queries.op8_residual_packing(spark, SF)))
    assert sequences <= 1.02 * tokens / 2048 + 1


def test_packing_in_levels(spark):
    docs = documents(spark)
    pieces = packing.token_pieces(docs, PATHS["word_bpe_49k"], 2048)
    got = rows(packing.pack(pieces, shard_rows=20, fan_in=2, carry=8))
    sequences, tokens = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    assert sequences <= 1.15 * tokens / 2048 + 1


def test_a_bounded_carry_makes_no_more_sequences(spark):
    pieces = packing.token_pieces(documents(spark), PATHS["word_bpe_49k"], 2048)
    n = [packing.pack(pieces, shard_rows=20, fan_in=2, carry=c).select("sequence_id").distinct().count() for c in (20, 10**9)]
    assert n[0] == n[1]


def test_packing_of_odd_rows(spark):
    check_packing([r[:2] for r in ODD], rows(packing.pack_documents(odd_docs(spark), PATHS["word_bpe_49k"])))
    assert rows(packing.pack_documents(empty_docs(spark), PATHS["word_bpe_49k"])) == []


def test_packing_of_null_large_and_repeated_ids(spark):
    data = [(None, "one two three"), (9007199254740993, "four five"), (9007199254740995, "six"), (None, ""), *[(5, "the same row again")] * 40]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("_bin", F.lit("x")).withColumn("fill", F.lit(None))
    check_packing(data, rows(packing.pack_documents(df, PATHS["word_bpe_49k"], capacity=16, shard_rows=10, fan_in=2)), 16)
    pieces = packing.token_pieces(df, PATHS["word_bpe_49k"], 16).withColumn("_bin", F.lit("x")).withColumn("offset", F.lit("old"))
    got = packing.pack(pieces, 16)
    assert got.columns == [*pieces.columns[:-1], "sequence_id", "offset"] and {r["_bin"] for r in rows(got)} == {"x"}


def test_token_files_of_many_rows_of_one_id(spark):
    data = [(d, f"{chr(97 + k % 26)} row {k}") for d in (7, None) for k in range(120)] + [(7, "same")] * 5 + [(3, None), (9, "last")]
    files = wavelet.write_token_files(spark.createDataFrame(data, "doc_id long, text string"), PATHS["byte_bpe_50k"], shard_bytes=256)
    check_files(data, rows(wavelet.read_token_files(files)))
    assert files.groupBy("shard").agg(F.max("n_docs").alias("n")).agg(F.max("n")).first()[0] < 100
