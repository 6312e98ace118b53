"""The training-data operators as queries over the test tables, with
production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, classifier, jaccard, jpeg, licenses, mixing, quality, toxicity, urls, warc
from gleaner.llm.common import fold, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file, the same on every executor: GLEANER_TOKENIZERS
    names its folder, else it comes with the public_tokenizers package."""
    folder = os.environ.get("GLEANER_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "base_failed", "kept")


def op2_mixture_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(F.col("weight") * 1e6, 6).alias("weight_ppm"), F.round("p", 6).alias("p"), F.round("residual", 6).alias("residual"), "sampled")


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.round_trip(read(spark, sf_dir, "documents"))


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches")


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 5)
    scored = classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels", "doc_id", "quality"), part != 0, part == 1)
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = read(spark, sf_dir, "documents"), fold("doc_id", 3)
    network = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), part != 1)
    return toxicity.score(docs, network).select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The rules that are given, and those of the operator's user, which judge what no given rule fits: a parameter, here hosts
#: that the test tables mark as spam.
BASE_URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]
OWN_URL_RULES = [urls.Rule("block", f"casino-win.example.{top}", "", base=False) for top in ("com", "net", "org")]
URL_RULES = BASE_URL_RULES + OWN_URL_RULES


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixture_raking": op2_mixture_raking,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_license_join": op4_license_join,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_url_rules": op7_url_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_warc_normaliser": op10_warc_normaliser,
    "pipeline": pipeline,
}

def warc_oracle() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM l"""


def url_oracle() -> str:
    """op7 in DuckDB: every rule against every page."""
    rules = ", ".join(f"({r.base}, '{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(base, action, h, p) AS (VALUES {rules}),
m AS (SELECT page_id, base, action, r.h || r.p AS name FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY base DESC, length(r.h) + length(r.p) DESC, length(r.h) DESC, action DESC) = 1)
SELECT page_id, host, path, CASE WHEN base THEN name END AS rule, CASE WHEN NOT base THEN name END AS own_rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op2_mixture_raking": mixing.oracle(),
    "op4_license_join": licenses.oracle(),
    "op7_url_rules": url_oracle(),
    "op10_warc_normaliser": warc_oracle(),
}
