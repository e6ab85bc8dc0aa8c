import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seatrace.llm import pii, queries
from tests.llm.samples import ODD, SF, documents, empty_docs, odd_docs, rows

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), n, m.end()) for n, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if holds(kind, m[0])]
    return [(n, a, b) for a, n, b in sorted(found)]


ALPHABET = st.text(alphabet="0123456789+-. ()@ab.x%_", max_size=60)


@settings(max_examples=1500, deadline=None)
@given(ALPHABET)
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111.1111.1111.1111", "me (at) x dot org", "2001:db8:0:0:0:0:0:1", "(555) 234-5678", "10.1.2.3", "a@b.co", " ", ",", "7", "+44 20 7946 0958"]), max_size=12))
def test_loose_spans_do_not_overlap(parts):
    text = "".join(parts)
    base = pii.base_spans(text)
    loose = pii.loose_spans(text, base)
    taken = sorted((a, b) for _, a, b in loose)
    assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:]))
    assert not any(a < y and x < b for a, b in taken for _, x, y in base)


def check(docs, got):
    texts = {}
    for r in docs:
        texts.setdefault(r[0], r[1])
    assert len(got) == len(docs)
    for r in got:
        spans = plain(texts[r["doc_id"]])
        for n, kind in enumerate(BASE):
            assert r[f"n_{kind}"] == sum(s[0] == n for s in spans)
        names = [f"{list(BASE)[k]}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(names) <= set(every)
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), list(BASE).index(s.split(":")[0])))


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    check(docs, rows(queries.op2_voted_pii(spark, SF)))


def test_odd_rows(spark):
    check([r[:2] for r in ODD], rows(pii.find_pii(odd_docs(spark))))
    assert rows(pii.find_pii(empty_docs(spark))) == []


def test_redaction_keeps_columns_and_takes_spans_out(spark):
    docs = odd_docs(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in rows(out)}
    assert text[-5] == "a negative id with mail [EMAIL] and [PHONE] and [IP]"
    assert text[1] is None and text[2] == "" and text[4] == ODD[3][1]


def test_reliabilities_favour_consistent_labelers():
    patterns = [("email+++++0", 500), ("email-----0", 300), ("email++0++0", 100), ("email--0+-0", 60), ("email+-0--0", 5)]
    posterior = pii.fit_labelers(patterns)
    assert posterior["email+++++0"] > 0.9 > 0.1 > posterior["email-----0"]
    shapes = ["bmsswn", "bmlpwx"]
    x = pii.features([(p, shapes[posterior[p] < 0.5]) for p, _ in patterns])
    assert x.shape == (5, pii.WIDTH) and (x.sum(1) <= 1 + 6 + 6).all()
    y, n = np.array([posterior[p] for p, _ in patterns]), np.array([float(n) for _, n in patterns])
    w = pii.fit_classifier(lambda w: pii.newton_sums(x, y, n, w), n.sum())
    p = pii.chances(x, w)
    assert p[0] > 0.7 > 0.3 > p[1]
    # The shape alone moves what the votes leave open.
    open_ = pii.chances(pii.features([("email0000+0", s) for s in shapes]), w)
    assert open_[0] > open_[1]


def test_weights_fit_by_tasks_equal_those_of_one_array(spark):
    found = pii.find_candidates(documents(spark)).repartition(5).cache()
    own = Counter((s["votes"], s["shape"]) for r in found.collect() for s in r["base"] + r["loose"])
    patterns = Counter()
    for (v, _), c in own.items():
        patterns[v] += c
    posterior = pii.fit_labelers(sorted(patterns.items()))
    x = pii.features(list(own))
    y = np.array([posterior[v] for v, _ in own])
    n = np.array([c * np.log1p(patterns[v]) / patterns[v] for (v, _), c in own.items()])
    want = pii.fit_classifier(lambda w: pii.newton_sums(x, y, n, w), float(sum(np.log1p(c) for c in patterns.values())))
    assert np.allclose(pii.span_classifier(found), want, atol=1e-6)


def test_loose_spans_that_the_votes_and_shapes_speak_for(spark):
    mails = [f"Contact: name{k} (at) place{k} dot com\nor so" for k in range(40)]
    codes = [f"serial version 9{k:03d} 4{k:03d} 1111 2222x and more" for k in range(40)]
    got = rows(pii.find_pii(spark.createDataFrame(list(enumerate(mails + codes)), "doc_id long, text string")))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert all(spans[k].startswith("email:9:") for k in range(40)) and not any(spans[k] for k in range(40, 80))
