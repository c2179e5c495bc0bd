"""Queries and SQL of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import ann, bpe, decontam, langid, linededup, minhash, pii, quality, toxicity, urlfilter
from strata.llm.common import bucket_of, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


#: Upper and lower A-Z, and white space as the contracts have it, in DuckDB.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP1_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) END AS s FROM docs
), items AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10).drop("kept")

OP2_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS at FROM parts
), keyed AS (
  SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM lines
), hot AS (
  SELECT key FROM (SELECT DISTINCT rid, key FROM keyed WHERE key <> '') GROUP BY key HAVING count(*) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.at) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY k.rid
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES) + " AS t(rule, verdict)")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules, default="allow")


OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), bare AS (
  SELECT page_id, split_part(split_part(coalesce(rest, ''), '?', 1), '#', 1) AS p FROM cut
), parts AS (
  SELECT page_id, row_number() OVER () AS row_id, translate(split_part(p, '/', 1), '{UPPER}', '{LOWER}') AS host,
         CASE WHEN contains(p, '/') THEN substr(p, strpos(p, '/')) ELSE '' END AS path FROM bare
), rules(rule, host, path, verdict) AS (
  VALUES {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in URL_RULES)}
), hits AS (
  SELECT p.row_id, max(struct_pack(l := length(r.rule), h := length(r.host), rule := r.rule, verdict := r.verdict)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row_id
)
SELECT p.page_id, p.host, p.path, h.best.rule AS rule, coalesce(h.best.verdict, 'allow') AS verdict FROM parts p LEFT JOIN hits h USING (row_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 5) == 0)
    model = quality.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.3, keep=("held_out",))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    return langid.identify(docs, langid.train(docs.where("not held_out")), keep=("held_out",))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    model = toxicity.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3, keep=("held_out",))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.detect(table(spark, sf_dir, "documents"), pii.train(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_minhash": op1_minhash, "op2_line_dedup": op2_line_dedup, "op3_decontamination": op3_decontamination, "op4_url_filter": op4_url_filter, "op5_quality": op5_quality, "op6_ann": op6_ann, "op7_bpe": op7_bpe, "op8_language_id": op8_language_id, "op9_toxicity": op9_toxicity, "op10_pii": op10_pii}

ORACLE_SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_url_filter": OP4_SQL}
