"""The registered queries over the generated tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, fingerprints, gif, langid, mixing, neardup, quality, secretscan, sharding, tokencount
from quernel.llm.common import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_gif_media": lambda s, d: gif.text_media(documents(s, d)),
        "op2_byte_bpe": lambda s, d: bpe.encode_digests(documents(s, d), RANKS),
        "op3_language_id": lambda s, d: langid.identify(documents(s, d)),
        "op4_near_duplicates": lambda s, d: neardup.near_duplicates(documents(s, d)),
        "op5_token_counts": lambda s, d: tokencount.token_counts(documents(s, d), VOCABULARY),
        "op6_fingerprints": lambda s, d: fingerprints.fingerprints(documents(s, d)),
        "op7_secret_scans": lambda s, d: secretscan.scan(documents(s, d)),
        "op8_source_mix": lambda s, d: mixing.mixed(documents(s, d)),
        "op9_shards": lambda s, d: sharding.sharded(documents(s, d)),
        "op10_quality": lambda s, d: quality.classify(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
    }


#: All pairs that share a shingle, their similarity, and what is reachable by links.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT y, root FROM reach JOIN links ON x = reach.doc_id
), components AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


#: The level at which capped targets add up to the share: the first whose next source, by size over weight, stays under its cap.
SOURCE_MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS key FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT source, source_size, source_size * CAST({mixing.MOST} AS DOUBLE) AS cap,
    CAST(([{', '.join(map(str, mixing.WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mixing.WEIGHTS)}] AS DOUBLE) AS weight
  FROM per
), filled AS (
  SELECT *, (sum(source_size) OVER () * CAST({mixing.SHARE} AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER rest AS level,
    row_number() OVER (ORDER BY cap / weight, source) AS place
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
  SELECT coalesce(arg_min(level, place) FILTER (WHERE cap >= weight * level), 0) AS level FROM filled
), targets AS (
  SELECT source, source_size, least(cap, weight * chosen.level) AS target FROM weighted, chosen
), rated AS (
  SELECT doc_id, size, source_size, target, s.source, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || key), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS drawn,
    row_number() OVER (PARTITION BY doc_id, s.source, key) AS number
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CAST(floor(rate) + floor(number * (rate - floor(rate)) + drawn) - floor((number - 1) * (rate - floor(rate)) + drawn) AS BIGINT) AS copies FROM rated
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source FROM copied
"""


def oracle_sql() -> dict[str, str]:
    """Hashes of media, tokenizers and models can't be said in SQL; near-duplicates and the mix can."""
    return {"op4_near_duplicates": NEAR_DUPLICATES_SQL, "op8_source_mix": SOURCE_MIX_SQL}
