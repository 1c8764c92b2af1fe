"""Registered queries of the document operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, neardup, ngramjoin, packing, pii, quality, secrets, tokenfile, toxicity
from .common import load


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(load(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), ids=False)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(load(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(load(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(load(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(load(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(load(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "documents"))


def queries():
    own = (op1_secret_scan, op2_packing, op3_embedding_neardup, op4_pii, op5_byte_bpe, op6_ngram_join, op7_token_files, op8_toxicity, op9_quality, op10_language)
    return {f.__name__: f for f in own}


def _secret_sql() -> str:
    """The scan without an index: each rule over every text, matches placed by the text between them."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
        parts.append(
            f"SELECT rid, {i} AS rule, ({start})::BIGINT AS s, ({start} + length(m[i]))::BIGINT AS e FROM (SELECT rid, regexp_extract_all(t, {pattern}) AS m, "
            f"regexp_extract_all(t, {pattern}, {r.group}) AS v, string_split_regex(t, {pattern}) AS g FROM d) x, unnest(range(1, len(m) + 1)) AS u(i) WHERE length(v[i]) >= {r.least}"
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    spell = f"string_agg({kinds}[rule + 1] || ':' || s || ':' || e, ',' ORDER BY s, rule)"
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.RULES[: secrets.BASE]))
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), sp AS (" + " UNION ALL ".join(parts) + "), "
        f"a AS (SELECT rid, {counts}, {spell} AS spans, {spell} FILTER (rule < {secrets.BASE}) AS base FROM sp GROUP BY rid) "
        "SELECT doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES[: secrets.BASE]) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REACH = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""

#: All pairs that share a shingle, counted, and what their links reach.
_JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id = doc_id"""

#: All pairs of vectors.
_VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND x.n > 0 AND y.n > 0 AND list_dot_product(x.e, y.e) >= 0.9 * x.n * y.n),
{_REACH},
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n_l, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM (SELECT vec_id FROM v) LEFT JOIN (SELECT a, n AS n_l FROM d) ON a = vec_id LEFT JOIN k ON id = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are held against brute force in the tests."""
    return {"op1_secret_scan": _secret_sql(), "op3_embedding_neardup": _VECTOR_SQL, "op6_ngram_join": _JOIN_SQL}
