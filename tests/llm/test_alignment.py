"""Alignment of two tokenizers and token counts against the libraries, text by text."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from seatrace.llm import alignment, queries, token_counts
from seatrace.llm.tokenization import chunks, safe_parts
from tests.llm.samples import ODD, SF, documents, empty_docs, odd_docs, rows

BYTES, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = ["a  b", " lead", "trail ", "x\n\ny", "\n", " ", "\nOf \n of", "<|endoftext|> a", "</s> <0x41>", "a\tb\r\n c", "x▁y", "▁", "naïve é é ﬁ 漢字 😀", "a\x1c b \x85 c", "1234  a1b2", "it's we'll", "\0 a"]


class Plain:
    """Tokens with their bytes, straight from the libraries."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(k, bytes(self.letters[c] for c in self.a.id_to_token(k))) for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends_a, ends_b = ({}, {})
        for tokens, ends in ((a, ends_a), (b, ends_b)):
            at = 0
            for n, (_, x) in enumerate(tokens):
                at += len(x)
                ends[at] = n
        found, i, j = [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            found.append(([k for k, _ in a[i : ends_a[end] + 1]], [k for k, _ in b[j : ends_b[end] + 1]]))
            i, j = ends_a[end] + 1, ends_b[end] + 1
        return len(a), len(b), found


PLAIN = Plain()


def expected(data):
    aligned = [(doc_id, *PLAIN.groups(text)) for doc_id, text in data]
    links = [[(g[0][-1], g[1][-1]) for g in groups] for *_, groups in aligned]
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (doc_id, n_a, n_b, groups), own in zip(aligned, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr), counts, best


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows(df)), key=repr)


def test_alignment_of_the_driver_table(spark):
    want, _, _ = expected([(r["doc_id"], r["text"]) for r in documents(spark).collect()])
    assert got(queries.op11_striped_alignment(spark, SF)) == want


def test_alignment_of_odd_rows_in_small_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SALT_ROWS", 0.01)
    data = [r[:2] for r in ODD] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(7, "one"), (None, None)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(data[len(ODD) :], "doc_id long, text string"), allowMissingColumns=True).repartition(5)
    want, counts, best = expected(data)
    assert got(alignment.count_alignments(docs, BYTES, PIECES, block=500)) == want
    links = alignment.best_links(docs, BYTES, PIECES, block=2000)
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in rows(links)} == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_alignment_without_rows_or_tokens(spark):
    assert rows(alignment.count_alignments(empty_docs(spark), BYTES, PIECES)) == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert got(alignment.count_alignments(docs, BYTES, PIECES)) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab'sS \n\t12.!,é́ \x1c▁\r")), max_size=30), min_size=1, max_size=4))
def test_aligner_on_any_texts(texts):
    for text, (n_a, n_b, n_groups, digest, links) in zip(texts, alignment.aligner(BYTES, PIECES).align(texts)):
        own = PLAIN.groups(text)
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own[2])
        assert (n_a, n_b, n_groups) == (own[0], own[1], len(own[2])) and digest == (sha256(spelt.encode()).hexdigest() if n_a else "")
        assert links.tolist() == sorted(b[-1] * alignment.aligner(BYTES, PIECES).a_size + a[-1] for a, b in own[2])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghtheing'stdll  \n\t.,!?0123456789éüßçàÉ-_()\"<|>"), max_size=200))
def test_ranks_encode_as_merges_do(text):
    own = alignment.aligner(BYTES, PIECES)
    assert own.ranked and alignment.PLAIN.fullmatch(text)
    assert own.ranked.encode_to_numpy(text).tolist() == PLAIN.a.encode(text, add_special_tokens=False).ids


def test_token_counts_of_the_driver_table(spark):
    library = Tokenizer.from_file(BYTES)
    for r, text in zip(rows(queries.op13_token_counts(spark, SF).orderBy("doc_id")), (r["text"] or "" for r in documents(spark).orderBy("doc_id").collect())):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_odd_rows(spark, name):
    path = public_tokenizers.path(name)
    library = SentencePieceProcessor(model_file=path) if name.endswith(".model") else Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t)) if name.endswith(".model") else len(library.encode(t, add_special_tokens=False).ids)
    data = [r[:2] for r in ODD] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200, "x" * 5000), (201, "<|endoftext|> a" * 50)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(data[len(ODD) :], "doc_id long, text string"), allowMissingColumns=True)
    found = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, limit=3, part=40)
    want = [(d, len((t or "").encode()), n := count(t or ""), n > 3) for d, t in data]
    assert sorted((tuple(r.values()) for r in rows(found)), key=repr) == sorted(want, key=repr)
    assert rows(token_counts.count_tokens(empty_docs(spark), path)) == []


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abé \n\t.1▁"), max_size=60), size=st.integers(1, 20))
def test_parts_and_chunks_make_the_text(text, size):
    assert "".join(safe_parts(text, size)) == text
    assert "".join(chunks(" " + text)) == " " + text and all(c[0] in " \n" for c in chunks(" " + text) if text)
    for name in (BYTES, PIECES):
        assert token_counts.counter(name, size)(text) == token_counts.counter(name, 1000)(text)
