import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seatrace.llm import mixing, near_dup, queries, url_filter
from seatrace.llm.components import connected_components
from tests.compare import SMALL, assert_same
from tests.llm.samples import ODD, SF, documents, empty_docs, odd_docs, rows
from tests.llm.test_texts import words


def shingles(text, size):
    w = words(text)
    n = min(size, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def brute_components(data, size, percent=80):
    sets = [(d, shingles(t, size)) for d, t in data]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    lists = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(k)
    met = Counter((a, b) for own in lists.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), common in met.items():
        if 100 * common >= percent * (len(sets[a][1]) + len(sets[b][1]) - common):
            parent[root(a)] = root(b)
    names = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            names[root(k)] = min(names.get(root(k), d), d)
    return sorted(((d, len(s), names.get(root(k))) for k, (d, s) in enumerate(sets)), key=repr)


def check(docs, df, size):
    got = rows(df)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(docs, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def test_near_duplicates_of_the_driver_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = check(docs, queries.op5_bottom_k_near_dups(spark, SF), 2)
    assert sum(r["kept"] for r in got) < len(got)


def test_near_duplicates_of_odd_rows(spark):
    check([r[:2] for r in ODD], near_dup.near_duplicates(odd_docs(spark), size=2), 2)
    assert rows(near_dup.near_duplicates(empty_docs(spark))) == []


def edited(rng, tokens, changes):
    own = list(tokens)
    for k in rng.choice(len(own), changes, replace=False):
        own[k] = f"e{rng.integers(1 << 30)}"
    return own


def test_planted_near_copies_chains_and_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data, n = [], 0
    for group in range(60):
        size = int(rng.integers(5, 400))
        tokens = [f"g{group}w{int(x)}" for x in rng.integers(0, 300, size)]
        for copy in range(4):
            data.append((n, " ".join(tokens if copy == 0 else edited(rng, tokens, min(size, int(size * 0.03 * copy))))))
            n += 1
    tokens = [f"c{k}" for k in range(120)]
    for _ in range(12):  # a chain, each a little further
        data.append((n, " ".join(tokens)))
        tokens = edited(rng, tokens, 4)
        n += 1
    large = [f"big{k}" for k in range(80)]
    for k in range(150):
        data.append((n, " ".join(large if k % 2 else edited(rng, large, 2))))
        n += 1
    for _ in range(50):  # a passage that many share
        data.append((n, " ".join([f"big{k}" for k in range(30)] + [f"own{rng.integers(1 << 30)}" for _ in range(60)])))
        n += 1
    df = spark.createDataFrame(data, "doc_id long, text string")
    check(data, near_dup.near_duplicates(df, size=2), 2)
    # Whole sets as sketches; all lists long, with tiles of few nodes; all lists short.
    check(data, near_dup.near_duplicates(df, size=5, k=None), 5)
    monkeypatch.setattr(near_dup, "SLOT_NODES", 16)
    check(data, near_dup.near_duplicates(df, size=5, short=2), 5)
    check(data, near_dup.near_duplicates(df, size=5, short=1000), 5)


def test_overlaps_of_sets():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 3000, rng.integers(0, 900)).astype(np.uint64)) for _ in range(n)] for n in (40, 33))
    a += [np.arange(5, dtype=np.uint64)] * 30
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert (near_dup.overlaps(a, b) == want).all()
    assert near_dup.overlaps([], b).shape == (0, 33)


def test_rows_that_repeat_ids_are_told_apart(spark):
    first, second = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    data = [(1, first), (1, second), (None, first + " x"), (None, second), (2, first), (1, first)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    check(data, near_dup.near_duplicates(df, size=2), 2)
    assert sorted(r["text"] for r in rows(near_dup.drop_near_duplicates(df, size=2))) == [first, second]


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark)
    out = near_dup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in rows(out))
    assert 5 not in ids and ids[4] == 1 and 6 not in ids and ids[7] == 1 and 8 not in ids and ids[1] == ids[2] == ids[3] == 1


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 400)] + [(500 + k, 500 + (k + 1) % 9) for k in range(9)] + [(7, 7)]
    got = {(r["node"], r["component"]) for r in rows(connected_components(spark.createDataFrame(links, "a long, b long")))}
    for held in (2, 30):
        again = connected_components(spark.createDataFrame(links, "a long, b long").repartition(8), held)
        assert {(r["node"], r["component"]) for r in rows(again)} == got
    assert got == {(k, 100) for k in range(100, 161)} | {(k, 200) for k in range(200, 400)} | {(k, 500) for k in range(500, 509)}


def test_mixing_equals_sql(spark):
    assert_same(queries.op7_source_mix(spark, SMALL), SMALL, queries.ORACLE_SQL["op7_source_mix"])


def filled(sizes, weights, caps):
    """Targets by clamping and sharing out again until nothing changes."""
    total, capped = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(caps[k] for k in capped)
        shares = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if shares[k] > caps[k] * (1 + 1e-12)}
        if not over:
            return [caps[k] if k in capped else shares[k] for k in range(len(sizes))]
        capped |= over


def test_targets_by_repeated_clamping(spark):
    rng = np.random.default_rng(8)
    for _ in range(4):
        sizes = [int(x) for x in rng.integers(1, 10_000, 7) ** rng.integers(1, 3, 7)]
        df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in rows(mixing.source_targets(df, (1, 2, 3), 3))}
        want = filled(sizes, [k % 3 + 1 for k in range(7)], [3 * n for n in sizes])
        assert np.allclose([got[f"s{k}"] for k in range(7)], want)


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = rows(mixing.mix_sources(docs))
    assert len(got) == len(ODD)
    assert all(0 <= r["repeats"] <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        taken = sum(r["size"] * r["repeats"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
    report = mixing.mix_report(docs)
    assert sorted(map(repr, rows(report))) == sorted(map(repr, rows(mixing.mix_report(docs))))
    assert mixing.repeat_rows(mixing.mix_sources(docs)).count() == sum(r["repeats"] for r in got)
    assert rows(mixing.mix_report(empty_docs(spark))) == []


def test_mix_takes_only_as_many_rows_of_one_id_as_fit(spark):
    data = [(1, "a b c", "x")] * 500 + [(None, "a b c", "y")] * 500
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    got = rows(mixing.mix_report(df))
    for source, want in ((1, 1000), (None, 2000)):
        own = [r for r in got if r["doc_id"] == source]
        assert own[0]["target"] == want and abs(sum(r["taken"] for r in own) - want) <= 3 and {r["taken"] for r in own} <= {0, 3, 6, 9}


def test_mix_keeps_columns_whose_names_clash(spark):
    docs = odd_docs(spark).drop("size", "target")
    for name in ("_s", "_n", "whole", "_last", "_end", "rest", "h", "of", "taken"):
        docs = docs.withColumn(name, F.lit("clash"))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "repeats"]
    assert all(r[name] == "clash" for r in rows(mixed) for name in ("_h", "_s", "whole", "_last", "h", "taken"))
    assert mixing.repeat_rows(mixed).columns == docs.columns


def plain_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]) if m else ("", "")
    best = None
    for verdict, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_rules_of_the_driver_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(queries.op10_url_templates(spark, SF))
    assert len(got) == len(pages)
    for r in got:
        host, path, best = plain_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def judged(spark, urls, **how):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(0))
    return rows(url_filter.judge_urls(df, queries.URL_RULES, **how))


def test_odd_urls(spark):
    urls = [None, "", "nothing", "://", "http://A.Example.COM/en/7x?q#f", "http://x.com", "http://notcom/en/", "http://a.net/de/8", "http://example.net/de/8/1", "x://y://z.org/es/", "http://a.org/es/\nq?x", "http://b.org/es"]
    got = {r["page_id"]: r for r in judged(spark, urls)}
    for k, url in enumerate(urls):
        host, path, best = plain_rule(url)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]), url
        assert best or r["verdict"] == "allow"
    assert got[0]["n"] == 0
    assert judged(spark, urls[:1])[0]["verdict"] == "allow"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert rows(url_filter.judge_urls(empty, queries.URL_RULES)) == []


def plain_tree(paths, levels, distinct=8, novelty=0.3, alike_pages=8, strictness=3.0, prior=4.0, base_rate=0.1):
    """{(host, shaped path): (template, share)} of {(host, shaped path): (n, blocked, allowed)}, by loops."""
    names = {key: [] for key in paths}
    cut = {(h, p): (x[:levels] + ["/".join(x[levels:])] * (len(x) > levels)) for h, p in paths for x in [[s for s in p.split("/") if s]]}
    for level in range(levels + 1):
        kids = {}
        for key, segments in cut.items():
            if level < len(segments):
                below = kids.setdefault((key[0], tuple(names[key])), Counter())
                below[segments[level]] += paths[key][0]
        for key, segments in cut.items():
            if level < len(segments):
                below = kids[key[0], tuple(names[key][:level])]
                wild = len(below) >= distinct and len(below) >= novelty * sum(below.values())
                names[key].append("*" if wild else segments[level])
    done = {key: [] for key in paths}
    for level in range(levels + 1):
        branches = {}
        for key, own in names.items():
            if level < len(own):
                kind = branches.setdefault((key[0], tuple(done[key])), {}).setdefault(own[level], [Counter(), 0, 0])
                kind[0][own[level + 1] if level + 1 < len(own) else ""] += paths[key][0]
                kind[1] += paths[key][1]
                kind[2] += paths[key][2]
        new = {}
        for node, kinds in branches.items():
            leads = {}
            for name, (kids, b, a) in kinds.items():
                lead = max((n, c) for c, n in kids.items())[1]
                if sum(kids.values()) >= alike_pages and lead and name != "*":
                    leads.setdefault(lead, []).append((name, kids, b, a))
            found = []
            for lead, group in leads.items():
                pool = sum((x[1] for x in group), Counter())
                pages, blocked, labelled = sum(pool.values()), sum(x[2] for x in group), sum(x[2] + x[3] for x in group)
                alike = []
                for name, kids, b, a in group:
                    total = sum(kids.values())
                    gain = 2 * sum(n * np.log((n / total) / (pool[c] / pages)) for c, n in kids.items())
                    free, own, others = len(pool) - 1, b + a, labelled - b - a
                    same = True
                    if own and others:
                        share = blocked / labelled
                        same = (b / own - (blocked - b) / others) ** 2 <= strictness**2 * share * (1 - share) * (1 / own + 1 / others)
                    if same and gain <= free + strictness * np.sqrt(2 * free) + 1e-6:
                        alike.append((name, total))
                if len(alike) > 1:
                    found.append((-sum(n for _, n in alike), lead, [x for x, _ in alike]))
            for k, (_, _, alike) in enumerate(sorted(found), 1):
                new |= {(node, name): "~" if k == 1 else f"~{k}" for name in alike}
        for key, own in names.items():
            if level < len(own):
                done[key].append(new.get(((key[0], tuple(done[key])), own[level]), own[level]))
    sums, labels = Counter(), {}
    for key, own in done.items():
        sums[key[0], tuple(own), 0] += paths[key][1]
        sums[key[0], tuple(own), 1] += paths[key][2]
        for depth in range(len(own)):
            x = labels.setdefault((key[0], tuple(own[:depth])), {}).setdefault(own[depth], [0, 0])
            x[0] += paths[key][1]
            x[1] += paths[key][2]
    out = {}
    for key, own in done.items():
        up = base_rate
        for depth in range(len(own)):
            known = [b / (b + a) for b, a in labels[key[0], tuple(own[:depth])].values() if b + a]
            up = (sum(known) + prior * up) / (len(known) + prior)
        b, a = (sums[key[0], tuple(own), k] for k in (0, 1))
        out[key] = ("".join(f"/{x}" for x in own), (b + prior * up) / (b + a + prior))
    return out


def test_tree_and_shares_by_loops(spark):
    rng = np.random.default_rng(6)
    paths = {}
    for host in ("a", "b", "c"):
        for _ in range(400):
            depth = int(rng.integers(0, 6))
            path = "".join(f"/{'xyzuvw'[int(rng.integers(0, 2 + k))]}{int(rng.integers(0, 40)) if rng.random() < 0.1 else ''}" for k in range(depth))
            n = int(rng.integers(1, 30))
            label = rng.random()
            bad = path.startswith(("/x", "/y/y")) ^ (rng.random() < 0.05)
            paths[host, path] = (n, n if label < 0.4 and bad else 0, n if label < 0.4 and not bad else 0)
    df = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, shaped string, n long, blocked long, allowed long")
    for levels in (2, 6):
        templates = url_filter.path_templates(df, levels=levels)
        shares = {(r["host"], r["template"]): r["block_share"] for r in rows(url_filter.block_shares(templates, 4.0, 0.1))}
        want = plain_tree(paths, levels)
        got = {(r["host"], r["shaped"]): (r["template"], shares[r["host"], r["template"]]) for r in rows(templates)}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
        assert any("~" in v[0] for v in got.values())


def test_the_method_blocks_pages_that_no_rule_covers(spark):
    urls = [f"http://x.com/{lang}/{k}" for lang in ("en", "de", "fr") for k in range(30)] + [f"http://x.com/shop/{'ab'[k % 2]}/{k}" for k in range(30)]
    got = judged(spark, urls)
    verdicts = Counter((r["url"].split("/")[3], r["verdict"]) for r in got)
    assert verdicts == {("en", "block"): 30, ("de", "block"): 30, ("fr", "block"): 30, ("shop", "allow"): 30}
    assert len({round(r["block_share"], 6) for r in got if r["rule"] is None}) == 2


def test_clashing_names_and_a_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://x.com/" + "a/" * 50_000 + "?q"), (2, None)], "page_id long, url string")
    for name in ("_h", "_s", "_rule", "_shaped", "shaped", "segments", "names", "template", "done"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r["page_id"]: r for r in rows(url_filter.judge_urls(df, queries.URL_RULES))}
    assert len(got) == 2 and all(got[k][name] == "clash" for k in got for name in ("_h", "_s", "_rule", "_shaped", "segments", "done"))
    assert len(got[1]["path"]) == 100_001


def test_templates_and_merged_branches(spark):
    urls = [f"http://shop.io/{lang}/item/{k}" for lang in ("aa", "bb") for k in range(40)] + [f"http://shop.io/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/posts" for k in range(60)] + [f"http://shop.io/about/{k % 2}" for k in range(9)]
    got = Counter(r["template"] for r in judged(spark, urls))
    assert got["/~/item/{n}"] == 80  # two branches alike
    assert got["/user/*/posts"] == 60
    labelled = spark.createDataFrame([(k, f"http://ads.io/{'promo' if k % 3 else 'blog'}/{k}", 1 if k % 3 else 0) for k in range(60)] + [(100 + k, f"http://ads.io/promo/{900 + k}", None) for k in range(5)] + [(200, "http://ads.io/blog/77", None)], "page_id long, url string, bad int")
    verdict = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge_urls(labelled, [], label="bad", alike_pages=1000))}
    assert {verdict[100 + k] for k in range(5)} == {"block"} and verdict[200] == "allow"
