"""SQL for the operators on repeated texts, benchmark items and pages, for ids that do not repeat."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(name: str, table: str, key: str, text: str) -> str:
    """A table of `id, pos, word`, the words of each text numbered from 1."""
    return f"""{name}_lists AS (
  SELECT {key} AS id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS words FROM {table}
), {name} AS MATERIALIZED (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM {name}_lists
)"""


def _shingles(name: str, table: str, key: str) -> str:
    """A table of the distinct `id, shingle`: runs of five words, or the whole of a shorter text."""
    return f"""{_words(f"{name}_words", table, key, _LOWER)}, {name} AS MATERIALIZED (
  SELECT DISTINCT id, concat_ws(' ', word, b, c, d, e) AS shingle FROM (
    SELECT id, pos, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c, lead(word, 3) OVER w AS d, lead(word, 4) OVER w AS e
    FROM {name}_words WINDOW w AS (PARTITION BY id ORDER BY pos)
  ) WHERE e IS NOT NULL OR pos = 1
)"""


SUBSTRING_DEDUP = f"""WITH {_words("w", "documents", "doc_id", "coalesce(text, '')")}, windows AS (
  SELECT id, pos, sha256(string_agg(word, ' ') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS digest,
    lead(pos, 49) OVER (PARTITION BY id ORDER BY pos) AS last_pos
  FROM w
), starts AS (
  SELECT id, pos FROM (SELECT id, pos, min(id) OVER (PARTITION BY digest) AS first_id FROM windows WHERE last_pos IS NOT NULL)
  WHERE id > first_id
), covered AS (
  SELECT w.id, w.pos, w.word, coalesce(max(s.pos) OVER (PARTITION BY w.id ORDER BY w.pos) > w.pos - 50, false) AS gone
  FROM w LEFT JOIN starts s ON s.id = w.id AND s.pos = w.pos
), cut AS (
  SELECT id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM covered GROUP BY id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN cut ON cut.id = doc_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE {_shingles("s", "documents", "doc_id")}, sizes AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), shared AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b
), smallest AS (
  SELECT a, min(b) AS least_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id,
  doc_id <= coalesce(least_id, doc_id) AS kept
FROM documents LEFT JOIN sizes ON sizes.id = doc_id LEFT JOIN smallest ON smallest.a = doc_id"""

WARC = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), t AS (
  SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
    CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS target
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(target, page_id) AS refers_to
FROM t"""

CONTAMINATION = f"""WITH {_shingles("s", "documents", "doc_id")}, {_shingles("i", "benchmark", "item_id")}, sizes AS (
  SELECT id, count(*) AS n FROM i GROUP BY id
), shared AS (
  SELECT s.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s JOIN i USING (shingle) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_shared / n AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= 0.75 * n"""
