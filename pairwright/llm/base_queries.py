"""Parts of the operators' results that SQL can express, as queries of their own with that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import audio, licenses, mixing, secrets

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind."""
    return secrets.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_SECRETS = rf"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '{ASSIGN}', 1), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, and the places and labels of phrases."""
    return licenses.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places(phrase: str) -> str:
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


LICENSE_PHRASES = rf"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, labels AS base_labels
FROM (
  SELECT doc_id, w, {" || ".join(_places(x) for x in licenses.PHRASES)} AS p,
    array_to_string(list_filter([{", ".join(f"CASE WHEN len({_places(x)}) > 0 THEN '{label}' END" for x, label in sorted(licenses.PHRASES.items(), key=lambda x: x[1]))}], lambda x: x IS NOT NULL), ',') AS labels
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents)
)
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and targets in thousandths."""
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target"))


#: The level at which the targets, each up to twice its source's size, add up: the smallest at which a source is
#: full that is too high, or none.
MIX_TARGETS = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM docs GROUP BY source
),
levels AS (SELECT 2.0 * source_size / w AS level FROM sources),
sums AS (SELECT level, (SELECT sum(least(2.0 * source_size, w * level)) FROM sources) AS used, (SELECT 1.5 * sum(source_size) FROM sources) AS due FROM levels),
base AS (SELECT coalesce(max(level) FILTER (WHERE used <= due), 0) AS low, any_value(due) AS due FROM sums),
last AS (
  SELECT low + (due - (SELECT sum(least(2.0 * source_size, w * low)) FROM sources)) / nullif((SELECT sum(w) FROM sources WHERE 2.0 * source_size > w * low), 0) AS level FROM base
)
SELECT doc_id, size, source_size, CAST(round(1000 * least(2.0 * source_size, coalesce(w * (SELECT level FROM last), 2.0 * source_size))) AS BIGINT) AS target
FROM docs JOIN sources ON docs.source IS NOT DISTINCT FROM sources.source
"""


def audio_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of the texts, byte by byte."""
    return audio.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def _little(number: str) -> str:
    return f"unhex(printf('%02x%02x%02x%02x', ({number}) & 255, (({number}) >> 8) & 255, (({number}) >> 16) & 255, (({number}) >> 24) & 255))"


#: A RIFF header of one channel, RATE samples a second, 8 bits each.
AUDIO_BYTES = rf"""
SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(p) AS payload_sha256, n_bytes + pad + 44 AS media_bytes,
  sha256('RIFF'::BLOB || {_little("n_bytes + pad + 36")} || 'WAVEfmt '::BLOB || unhex('1000000001000100') || {_little(str(audio.RATE))} || {_little(str(audio.RATE))} || unhex('01000800') || 'data'::BLOB || {_little("n_bytes + pad")} || p) AS media_sha256
FROM (
  SELECT doc_id, n_bytes, pad, encode(t) || unhex(repeat('00', CAST(pad AS INT))) AS p
  FROM (SELECT doc_id, t, n_bytes, CASE WHEN n_bytes = 0 THEN 64 ELSE (64 - n_bytes % 64) % 64 END AS pad
    FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents))
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"base_secrets": base_secrets, "license_phrases": license_phrases, "mix_targets": mix_targets, "audio_bytes": audio_bytes}


def oracle_sql() -> dict[str, str]:
    return {"base_secrets": BASE_SECRETS, "license_phrases": LICENSE_PHRASES, "mix_targets": MIX_TARGETS, "audio_bytes": AUDIO_BYTES}
