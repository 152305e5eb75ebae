"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS pos
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
-- the level at which every source gets min(2 * size, level * weight) words: tried after each possible
-- number of capped sources, where the sources cap in the order of 2 * size / weight
tried AS (
  SELECT a.source,
         (3 * (SELECT sum(source_size) FROM s) - 2 * coalesce(sum(2 * b.source_size)
            FILTER (2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0))
         / (2 * sum(b.weight) FILTER (2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight)) AS level
  FROM s a CROSS JOIN s b GROUP BY a.source),
best AS (
  SELECT max(level) AS level FROM tried),
t AS (
  SELECT source, source_size, CAST(least(2 * source_size, level * weight) AS DOUBLE) AS target FROM s, best),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.pos, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - start))
            AS BIGINT) AS taken
FROM p
"""

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_LETTERS.upper()}', '{_LETTERS}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n
  FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (
  SELECT r, n, term, count(*) AS tf FROM (SELECT r, n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (
  SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (
  SELECT q.item_id, p.r, CAST(sum(times
    * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY ALL),
y AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op5_mix_sources": MIX, "op13_lexical_search": SEARCH}
