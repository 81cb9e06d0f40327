"""The part of some operators' results that SQL can tell too, as queries of their own with that SQL.

Each goes through its operator and leaves out the columns that the method adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import scan_licenses
from .media import encode_media, media_features
from .periodic import periodic_runs
from .secrets import secret_digests

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, len(w) AS n_words,
    [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'mit' AND w[i + 1] = 'license'] AS mit,
    [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'apache' AND w[i + 1] = 'license'] AS apache,
    [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'] AS gpl
  FROM w)
SELECT doc_id, n_words::BIGINT AS n_words, len(mit || apache || gpl)::BIGINT AS n_base, list_min(mit || apache || gpl)::BIGINT AS first_word,
  list_max(mit || apache || gpl)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p
"""


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''),
    '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda s: length(s) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda s: length(s) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda s: length(s) >= 24))::BIGINT AS n_hex
FROM documents
"""


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_SQL = r"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, CASE WHEN n = 0 THEN 576 ELSE (n + 575) // 576 * 576 END AS whole FROM b)
SELECT doc_id, n::BIGINT AS n_bytes, whole::BIGINT AS payload_bytes, sha256(unhex(hex(t) || repeat('FF', (whole - n)::INTEGER))) AS payload_sha256 FROM p
"""


def short_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text and its runs of periods of one to three words, of which there are few enough for SQL."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    short = F.filter("runs", lambda r: r["period"] <= 3)
    return found.select(
        "doc_id", "n_words", F.size(short).cast("long").alias("n_short"), F.aggregate(short, F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("words")
    )


PERIOD_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
q AS (SELECT doc_id, i, unnest([1, 2, 3]) AS q,
  unnest([word = lead(word, 1) OVER o, word = lead(word, 2) OVER o, word = lead(word, 3) OVER o]) AS same FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM q WHERE same),
r AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= 24),
k AS (SELECT doc_id, s, n, min(q) AS q FROM r GROUP BY doc_id, s, n)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, count(k.s)::BIGINT AS n_short, coalesce(sum(k.n), 0)::BIGINT AS words
FROM t LEFT JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id, t.w
"""

QUERIES = {f.__name__: f for f in (license_places, secret_counts, media_payloads, short_periods)}
ORACLES = {"license_places": LICENSE_SQL, "secret_counts": SECRET_SQL, "media_payloads": MEDIA_SQL, "short_periods": PERIOD_SQL}
