"""The registered queries of this subpackage and their SQL, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import backoff_lm, byte_bpe, chain_dedup, jaccard_join, lattice_neardup, license_scan, mixing, quality_rules, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[bytes, str]:
    """The vocabulary file's bytes and its pattern."""
    import public_tokenizers

    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


#: What the token-count query redacts, in this order.
REDACTIONS = [(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<EMAIL>"), (r"(?i)\b(?:api_?key|token|secret|password)\s*[=:]\s*\S+", "<SECRET>"), (r"[ \t]{2,}", " ")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = token_counts.build_trees(table(spark, sf_dir, "documents"), *tokenizer())
    return token_counts.apply_edits(token_counts.edits_by_rule(trees, REDACTIONS), *tokenizer())


def op2_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_neardup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.fuzzy_passages(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score_documents(table(spark, sf_dir, "documents"), order=2)
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words_each=4, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repetition_limit=2.0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_lattice_neardup, op3_chain_dedup, op4_byte_bpe, op5_backoff_lm, op6_jaccard_join, op7_suffix_dedup, op8_license_scan, op9_source_mixing, op10_quality_rules)
    return {f.__name__: f for f in ops}


#: Bigram counts of the corpus, less the document's own.
OP5_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, len(ws) AS n FROM w), t AS (SELECT sum(n) AS t FROM n),
p AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
ud AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY ALL), u AS (SELECT w, sum(c) AS c FROM ud GROUP BY w),
bd AS (SELECT doc_id, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY ALL), b AS (SELECT v, w, sum(c) AS c FROM bd GROUP BY v, w),
s AS (SELECT p.doc_id, CASE WHEN b.c > bd.c THEN ln(b.c - bd.c) - ln(uv.c - coalesce(udv.c, 0)) ELSE CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(greatest(u.c - ud.c, 1)) - ln(greatest(t - n, 1)) END AS x
    FROM p JOIN n ON n.doc_id = p.doc_id JOIN u ON u.w = p.w JOIN ud ON ud.doc_id = p.doc_id AND ud.w = p.w
    LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.doc_id = p.doc_id AND bd.v = p.v AND bd.w = p.w LEFT JOIN u uv ON uv.w = p.v LEFT JOIN ud udv ON udv.doc_id = p.doc_id AND udv.w = p.v, t)
SELECT n.doc_id, n AS n_words, round(sum(x), 4) AS log_score, round(sum(x) / n, 6) AS mean_log_score FROM n LEFT JOIN s ON s.doc_id = n.doc_id GROUP BY n.doc_id, n"""


#: All pairs of vectors.
OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT node, b FROM r JOIN l ON a = reach),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(reach) AS component_id, min(reach) = vec_id AS kept FROM v JOIN r ON node = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id"""

#: All pairs of documents that share a shingle.
OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT node, b FROM r JOIN e ON a = reach)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id FROM documents d JOIN r ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

#: Every window of 50 bytes, as hexadecimal digits.
OP7_SQL = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM h WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS f FROM win) WHERE f < doc_id),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS b FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut) GROUP BY doc_id, k),
parts AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT h.doc_id, string_agg(substring(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(x), 2 * max(e) + 1) AS y, sum(e - a)::BIGINT AS removed, count(*) AS spans FROM parts JOIN h ON h.doc_id = parts.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others can't be expressed; tests hold them against brute force."""
    return {"op2_lattice_neardup": OP2_SQL, "op5_backoff_lm": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_suffix_dedup": OP7_SQL}
