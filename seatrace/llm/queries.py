"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrace.llm import alignment, ann_forest, conversations, gam, mixing, near_dup, packing, pii, suffix_tree, token_counts, topk, url_filter, wavelet
from seatrace.llm.common import read

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.forest_neighbours(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op2_voted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return suffix_tree.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), training)


def op4_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.read_token_files(wavelet.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op5_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op6_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = gam.quality_scores(docs.select("doc_id", "text"), labels, may_train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "block_share")


def op11_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.count_alignments(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op12_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damage(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversations.repair_report(turns, F.col("dropped"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_forest,
        op2_voted_pii,
        op3_suffix_tree_scores,
        op4_wavelet_files,
        op5_bottom_k_near_dups,
        op6_branch_and_bound,
        op7_source_mix,
        op8_residual_packing,
        op9_quality_gam,
        op10_url_templates,
        op11_striped_alignment,
        op12_viterbi_repair,
        op13_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - sum(cap) OVER o + cap AS DOUBLE)
        / CAST((SELECT sum(weight) FROM w) - sum(weight) OVER o + weight AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(level, cap / weight) AS level FROM f WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN f.level * weight > cap THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM l) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole,
        g.target - g.whole * g.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS reach
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN whole < 3 AND reach <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
""",
    "op6_branch_and_bound": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
}


def _repair_sql() -> str:
    """The forward pass as a recursive CTE: a state is (cost, audit, repaired lines), the least one goes on."""

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def way(state: str, cost: str, letter: str, line: str = "[]", when: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': list_concat({state}.t, {line})}} END"

    put = lambda state, role: way(state, "3", "I", f"['{role}:']")
    to_user = lambda s: least(f"{s}.s2", *(put(f"{s}.s{k}", "user") for k in (0, 1, 3)))
    kept, early = "n.role || ':' || n.text", "n.early::INT * 3"
    drop = lambda k: way(f"c.s{k}", "4", "D")
    keep = lambda k, initial: way(f"c.s{k}", early, "K", f"[{kept}]", f"n.live AND left(n.role, 1) = '{initial}'")
    other = lambda k, role: way(f"c.s{k}", f"3 + {early}", "R", f"['{role}:' || n.text]", "n.live")
    return rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
    FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes),
        lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) % 20 AS fault FROM coded, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM dealt, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copies WHERE fault > 0),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS pos, nth > 1 AS again,
        NOT regexp_matches(text, '[^ 	-
]') AS blank,
        NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS unended FROM counted),
judged AS (SELECT *, NOT blank AND NOT again AS live, NOT blank AND unended AS early,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
steps AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0,
        CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s3 FROM ids
    UNION ALL
    SELECT c.conv_id, n.pos, {drop(0)}, {least(drop(1), keep(0, "s"))},
        {least(drop(2), *(f(k, r) for k in (0, 1, 3) for f, r in ((keep, "u"), (other, "user"))))}, {least(drop(3), keep(2, "a"), other(2, "assistant"))}
    FROM (SELECT conv_id, pos, s0, s1, s2, {least("d.s3", put("d.s2", "assistant"))} AS s3
        FROM (SELECT s.conv_id, s.pos, s.s0, s.s1, {to_user("s")} AS s2, s.s3 FROM steps s) d) c
    JOIN judged n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.pos = c.pos + 1),
closed AS (SELECT conv_id, pos, {least("d.s0", "d.s3", put("d.s2", "assistant"))} AS best
    FROM (SELECT s.conv_id, s.pos, s.s0, {to_user("s")} AS s2, s.s3 FROM steps s) d),
ended AS (SELECT conv_id, max_by(best, pos) AS best FROM closed GROUP BY conv_id),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
        count_if(live AND early) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL["op12_viterbi_repair"] = _repair_sql()
