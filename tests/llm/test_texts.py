import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seatrace.llm import gam, queries, suffix_tree
from tests.llm.samples import ODD, SF, a_to_z_lower, documents, empty_docs, odd_docs, rows


def words(text):
    out, word = [], ""
    for c in a_to_z_lower(text or ""):
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_scores(docs, got):
    counts = Counter()
    for doc_id, text in docs:
        if not held(doc_id):
            counts.update([*words(text), " "])
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in docs:
        tokens = [*words(text), " "]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5] for f in found], [w[5] for w in want], rtol=1e-9)


def test_scores_of_the_driver_table(spark):
    got = rows(queries.op3_suffix_tree_scores(spark, SF))
    check_scores([(r["doc_id"], r["text"]) for r in documents(spark).collect()], got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in got)


def test_scores_of_odd_rows(spark):
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    check_scores([r[:2] for r in ODD], rows(suffix_tree.score_texts(odd_docs(spark), training)))
    assert rows(suffix_tree.score_texts(empty_docs(spark), training)) == []
    none = rows(suffix_tree.score_texts(odd_docs(spark), F.lit(False)))
    assert {r["train_tokens"] for r in none} == {0} and len(none) == len(ODD)


def test_scores_have_learnt_what_follows(spark):
    """A chain of six words, each of which mostly comes again."""
    rng = np.random.default_rng(5)
    vocabulary = [f"t{k}" for k in range(6)]
    texts, word = [], 0
    for _ in range(200):
        own = []
        for _ in range(30):
            word = int(rng.choice(6, p=np.roll([0.7, 0.1, 0.05, 0.05, 0.05, 0.05], word)))
            own.append(vocabulary[word])
        texts.append(" ".join(own))
    data = [(k, t) for k, t in enumerate(texts)]
    probes = [(1000 + 10 * a + b, f"t{a} t{b}") for a in range(6) for b in range(6)] + [(2000 + a, f"t{a}") for a in range(6)] + [(3000, "")]
    df = spark.createDataFrame(data + probes, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in rows(suffix_tree.score_texts(df, F.col("doc_id") < 1000, context_share=1e-3, next_share=1e-3))}
    # P(end after "") + sum over a of P(a) = 1 less the mass kept for unknown words; P(a) itself comes from P(a, end).
    p_end = 10 ** score[3000]
    assert 0 < p_end < 1
    assert all(score[2000 + a] < score[3000] + 3 for a in range(6))
    same = sum(10 ** score[1000 + 11 * a] for a in range(6))
    other = sum(10 ** score[1000 + 10 * a + b] for a in range(6) for b in range(6) if a != b)
    assert same > other / 5  # the tree has learnt that words repeat


def brute_tree(texts, depth, context_least, next_share, discount, strictness):
    """Counts, kept states and probabilities by dictionaries, for whole small corpora."""
    root, nexts = Counter(), {}
    for text in texts:
        tokens = [*words(text), " "]
        root.update(tokens)
        for i, t in enumerate(tokens):
            for k in range(1, min(depth, i) + 1):
                nexts.setdefault(tuple(tokens[i - k : i]), Counter())[t] += 1
    n, v = sum(root.values()), len(root)
    states = {}

    def p(context, token):
        for k in range(min(depth, len(context)), 0, -1):
            own = states.get(tuple(context[-k:]))
            if own:
                return own[0].get(token, 0.0) + own[1] * p(context[len(context) - k + 1 :], token)
        return (root[token] + 1) / (n + v + 1)

    frequent = {(): 0} | {(t,): c for t, c in root.items() if c >= context_least and t != " "}
    for k in range(1, depth + 1):
        made = {}
        for context in [c for c in frequent if len(c) == k]:
            counts = nexts.get(context, Counter())
            total = sum(counts.values())
            listed = {t: c for t, c in counts.items() if c >= max(2, next_share * total)}
            for t, c in listed.items():
                if c >= context_least and t != " ":
                    frequent[(*context, t)] = c
            if not listed:
                continue
            before = {t: p(context[1:], t) for t in listed}
            gain = sum(c * math.log(c / total / before[t]) for t, c in listed.items())
            rest = total - sum(listed.values())
            if rest:
                gain += rest * math.log(rest / total / max(1 - sum(before.values()), 1e-9))
            if 2 * gain > len(listed) + strictness * math.sqrt(2 * len(listed)):
                shares = {t: (c - discount) / total for t, c in listed.items()}
                made[context] = shares, 1 - sum(shares.values())
        states |= made
    return p, states


def test_scores_equal_a_tree_of_dictionaries(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(150):  # the next word depends on the two before
        own = [0, 1]
        while len(own) < 40:
            own.append((own[-1] + 2 * own[-2] + int(rng.integers(0, 2))) % 7)
        texts.append(" ".join(f"v{x}" for x in own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    how = dict(depth=3, context_share=2e-3, next_share=1e-2, discount=0.75, strictness=4.0)
    got = {r["doc_id"]: r["score"] for r in rows(suffix_tree.score_texts(df, F.col("doc_id") % 5 != 0, **how))}
    training = [t for k, t in enumerate(texts) if k % 5]
    total = sum(len(words(t)) + 1 for t in training)
    p, states = brute_tree(training, 3, max(2.0, 2e-3 * total), 1e-2, 0.75, 4.0)
    assert any(len(s) > 1 for s in states)
    for k, text in enumerate(texts):
        tokens = [*words(text), " "]
        want = sum(math.log10(p(tokens[:i], t)) for i, t in enumerate(tokens))
        assert math.isclose(got[k], want, rel_tol=1e-9), (k, got[k], want)


def test_probabilities_after_any_context_sum_to_one():
    """Over all tokens and the share of unknown ones; the scores equal these dictionaries (other tests)."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"v{x}" for x in np.minimum(rng.geometric(0.3, 30), 9)) for _ in range(120)]
    p, states = brute_tree(texts, 3, 2.0, 0.0, 0.75, 4.0)
    tokens = [*sorted({w for t in texts for w in words(t)}), " ", "never seen"]
    assert len(states) > 5
    for context in [(), *sorted(states), ("v1", "v9", "v2"), ("never seen",), ("v3", "never seen")]:
        assert math.isclose(sum(p(list(context), t) for t in tokens), 1, rel_tol=1e-9), context


def test_rare_contexts_are_states_whatever_the_corpus(spark):
    """Contexts far below a ten-thousandth of the tokens, with all entries held and with all joined."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 40, 60)) for _ in range(700)]
    texts += [f"c1 rare{k} word{k} then{k} c{k % 40}" for k in range(30) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p, states = brute_tree(texts, 3, 2.0, 0.0, 0.75, 4.0)
    assert ("rare7",) in states and 1e-4 * 60 * len(texts) > 3
    for held in (0, 100, 2_000_000):
        got = {r["doc_id"]: r["score"] for r in rows(suffix_tree.score_texts(df, F.lit(True), held=held))}
        for k in [*range(0, 700, 50), *range(700, len(texts))]:
            tokens = [*words(texts[k]), " "]
            assert math.isclose(got[k], sum(math.log10(p(tokens[:i], t)) for i, t in enumerate(tokens)), rel_tol=1e-9), (held, k)


def test_scores_in_parts(spark, monkeypatch):
    """Parts of keys and of blocks give the scores of the dictionaries; texts are shuffled in no step that shuffles questions too."""
    steps, write = [], suffix_tree.scratch

    def written(df, name, **options):
        steps.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, **options)

    monkeypatch.setattr(suffix_tree, "scratch", written)
    monkeypatch.setattr(suffix_tree, "PASS_TOKENS", 1, raising=False)
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 200)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 9, 40)) for _ in range(120)] + ["", "c1 odd c2 odd", "c1 odd c2 odd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in rows(suffix_tree.score_texts(df, F.col("doc_id") % 7 != 2, held=50))}
    p, states = brute_tree([t for k, t in enumerate(texts) if k % 7 != 2], 3, 2.0, 0.0, 0.75, 4.0)
    assert got.keys() == set(range(len(texts))) and any(len(s) > 1 for s in states)
    for k, text in enumerate(texts):
        tokens = [*words(text), " "]
        assert math.isclose(got[k], sum(math.log10(p(tokens[:i], t)) for i, t in enumerate(tokens)), rel_tol=1e-9), k
    names = [name for name, _ in steps]
    assert all("MapInArrow" not in plan for name, plan in steps if name.startswith(("counted", "scored")))
    assert names.count("answers") == names.count("scored") == 4 and names.count("chances2") == 2


def test_only_heavy_contexts_are_joined(spark, monkeypatch):
    """Without heavy contexts no step joins runs of words; with heavy ones of each length, and words that no task holds, the
    scores are those of the dictionaries."""
    steps, write = [], suffix_tree.scratch

    def written(df, name, **options):
        steps.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, **options)

    rng = np.random.default_rng(12)
    texts = [" ".join(f"c{x}" for x in np.minimum(rng.geometric(0.5, 40), 5)) for _ in range(120)]
    texts += [f"c1 odd{k % 9} c1 c1 even{k % 7} odd{k % 9} c2" for k in range(40)] + ["", "c1 never odd1 c1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p, _ = brute_tree([t for k, t in enumerate(texts) if k % 7 != 2], 3, 2.0, 0.0, 0.75, 4.0)
    monkeypatch.setattr(suffix_tree, "scratch", written)
    for block, held in ((1 << 19, 100), (100, 100), (100, 5)):
        steps.clear()
        monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", block)
        got = {r["doc_id"]: r["score"] for r in rows(suffix_tree.score_texts(df, F.col("doc_id") % 7 != 2, head_share=3e-3, held=held))}
        assert got.keys() == set(range(len(texts)))
        for k, text in enumerate(texts):
            tokens = [*words(text), " "]
            assert math.isclose(got[k], sum(math.log10(p(tokens[:i], t)) for i, t in enumerate(tokens)), rel_tol=1e-9), (block, held, k)
        joined = [name for name, plan in steps if "Join" in plan]
        assert bool(joined) == (block == 100), joined


def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(queries.op9_quality_gam(spark, sf))}
    assert len(got) == documents(spark, sf).count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None and got[r["doc_id"]]["held_out"]]
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert len(right) > 50 and sum(right) >= 0.85 * len(right), sum(right) / len(right)


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (10, 0), (None, 1), (7, None), (8, 5), (99, 1)], "doc_id long, quality int").withColumn("words", F.lit("clash"))
    got = rows(gam.quality_scores(docs, labels))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in rows(gam.quality_scores(docs, labels.limit(0)))} == {0.5}
    assert rows(gam.quality_scores(empty_docs(spark), labels)) == []
    assert gam.quality_filter(docs, labels.limit(0)).count() == len(ODD)
    assert gam.quality_filter(docs, labels).columns == docs.columns


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, len(gam.FEATURES)))
    y = (x[:, 2] * x[:, 5] > 0).astype(float)
    model = gam.fit_gam(x[:2000], y[:2000])
    assert {tuple(sorted(p[:2])) for p in model.pairs} >= {(2, 5)}
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def plain_gam(x, y, bins, rounds, rate, n_pairs, pair_bins, pair_rounds, l2):
    """Probabilities of the rows by the same boosting, cell by cell in loops."""
    n, m = len(x), len(x[0])
    quantiles = lambda k, parts: sorted({float(np.quantile([r[k] for r in x], q / parts)) for q in range(1, parts)})
    place = lambda cuts, v: sum(v >= c for c in cuts)
    fine, coarse = ([quantiles(k, parts) for k in range(m)] for parts in (bins, pair_bins))
    b1 = [[place(fine[k], r[k]) for k in range(m)] for r in x]
    b2 = [[place(coarse[k], r[k]) for k in range(m)] for r in x]
    share = (sum(y) + 1) / (n + 2)
    total = [math.log(share / (1 - share))] * n
    gain = lambda g, h: g * g / (h + l2)

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

    def cut(g, h):
        best = (-math.inf, 0)
        for at in range(1, len(g)):
            best = max(best, (gain(sum(g[:at]), sum(h[:at])) + gain(sum(g[at:]), sum(h[at:])) - gain(sum(g), sum(h)), at), key=lambda b: b[0])
        return best if len(g) > 1 else (0.0, 0)

    def quarters(g, h):
        best = (-math.inf, None)
        for i in range(1, len(g)):
            for j in range(1, len(g[0])):
                cells = [[(r, c) for r in range(len(g)) for c in range(len(g[0])) if (r < i, c < j) == side] for side in ((True, True), (True, False), (False, True), (False, False))]
                sums = [(sum(g[r][c] for r, c in own), sum(h[r][c] for r, c in own)) for own in cells]
                value = sum(gain(*s) for s in sums)
                if value > best[0]:
                    best = value, {rc: -s[0] / (s[1] + l2) for own, s in zip(cells, sums) for rc in own}
        return best

    def grids(a, b):
        g, h = slopes()
        out = [[[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)] for _ in range(2)]
        for k in range(n):
            for grid, v in zip(out, (g[k], h[k])):
                grid[b2[k][a]][b2[k][b]] += v
        return out

    for _ in range(rounds):
        for k in range(m):
            size, (g, h) = len(fine[k]) + 1, slopes()
            gs, hs = ([sum(v[i] for i in range(n) if b1[i][k] == c) for c in range(size)] for v in (g, h))
            middle = cut(gs, hs)[1]
            edges = {0, middle, size}
            for a, b in ((0, middle), (middle, size)):
                better, at = cut(gs[a:b], hs[a:b])
                if better > 0:
                    edges.add(a + at)
            edges = sorted(edges)
            leaf = {c: -sum(gs[a:b]) / (sum(hs[a:b]) + l2) for a, b in zip(edges, edges[1:]) for c in range(a, b)}
            for i in range(n):
                total[i] += rate * leaf[b1[i][k]]
    scored = sorted(((quarters(*grids(a, b))[0], a, b) for a in range(m) for b in range(a)), reverse=True)[:n_pairs]
    for _ in range(pair_rounds):
        for _, a, b in scored:
            cells = quarters(*grids(a, b))[1]
            for i in range(n):
                total[i] += rate * cells[b2[i][a], b2[i][b]]
    return [1 / (1 + math.exp(-t)) for t in total]


def test_boosted_tables_by_loops():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(120)) > 0).astype(float)
    how = dict(bins=6, rounds=3, rate=0.3, n_pairs=2, pair_bins=3, pair_rounds=2, l2=2.0)
    assert np.allclose(gam.fit_gam(x, y, **how).score(x), plain_gam(x.tolist(), y.tolist(), **how), atol=1e-9)
