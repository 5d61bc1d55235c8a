"""One query per operator, over its whole table with production parameters, and SQL where it can express the query."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.llm import warc
from cloneframe.llm.bpe import round_trip
from cloneframe.llm.common import scratch_path
from cloneframe.llm.hmm import score_documents
from cloneframe.llm.html_text import extract
from cloneframe.llm.minhash_forest import near_duplicates
from cloneframe.llm.packing import pack
from cloneframe.llm.pii import pseudonymise
from cloneframe.llm.quality import measure, train
from cloneframe.llm.sketch import fingerprints
from cloneframe.llm.substring_dedup import remove_repeats

#: For the tests and the check; a deployment passes its own secret.
PII_KEY = "cloneframe-demo-key"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), archives)
    read = warc.read(spark, archives, with_payload=False)
    digest = F.when(F.col("record_type") == "response", F.col("block_digest")).otherwise(F.col("payload_digest"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_read(spark, sf_dir, "documents"), PII_KEY)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), with_ids=False)


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs, train(docs, _read(spark, sf_dir, "labels")), carry=["doc_id"])


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, 35).drop("text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_packing": op5_packing,
    "op6_sketch": op6_sketch,
    "op7_quality": op7_quality,
    "op8_hmm": op8_hmm,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bpe": op10_bpe,
}

OP1 = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (
  SELECT page_id, n, digest,
    CASE WHEN n >= 100 AND min(page_id) OVER (PARTITION BY digest) IS DISTINCT FROM page_id
      THEN min(page_id) OVER (PARTITION BY digest) END AS refers
  FROM (
    SELECT page_id, cast(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages
  )
)
"""

WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)
"""
OP9 = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM h JOIN r USING (h)),
every AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1,
    "op4_minhash_forest": OP4,
    "op9_substring_dedup": OP9,
}
