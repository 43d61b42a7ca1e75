"""The queries of this subpackage and the SQL that some of them can be told in."""

from __future__ import annotations

from larkspur.llm.fertility import op2_quality_rules
from larkspur.llm.jaccard import op4_jaccard_join
from larkspur.llm.jpeg import op10_media
from larkspur.llm.language import op1_language_id
from larkspur.llm.mixing import op9_mixing
from larkspur.llm.pieces import op7_sentencepiece
from larkspur.llm.pii import op5_pii
from larkspur.llm.resampling import op6_quality_classifier
from larkspur.llm.token_counts import op3_token_counts
from larkspur.llm.warc import op8_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
}

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
one AS (SELECT r, unnest(s) AS x FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM one a JOIN one b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT r, r FROM sets UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""

_WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM g
"""

_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS name FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) AS words,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source),
src2 AS (
  SELECT *, sum(words) OVER () AS total, 3 * words AS most,
         coalesce(sum(3 * words) OVER (ORDER BY 3 * words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY 3 * words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM src),
src3 AS (SELECT *, (total - before) * weight >= most * rest AS is_full FROM src2),
tgt AS (
  SELECT source, source_size, CASE WHEN is_full THEN most ELSE
    greatest(total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER (), 0) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM src3),
bits AS (
  SELECT source, greatest(length(bin(size)), 1) AS bits, CAST(sum(size) AS DOUBLE) AS words FROM sized GROUP BY ALL),
b2 AS (
  SELECT bits.source, bits, words, target, source_size, words / bits AS amount, 3 * words AS most
  FROM bits JOIN tgt ON bits.source IS NOT DISTINCT FROM tgt.source),
b3 AS (
  SELECT *, coalesce(sum(most) OVER (PARTITION BY source ORDER BY most / nullif(amount, 0) NULLS FIRST, bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(amount) OVER (PARTITION BY source ORDER BY most / nullif(amount, 0) NULLS FIRST, bits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b2),
b4 AS (SELECT *, amount <= 0 OR (target - before) * amount >= most * rest AS is_full FROM b3),
b5 AS (
  SELECT *, CASE WHEN is_full THEN most ELSE
    greatest(target - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER (PARTITION BY source), 0) * amount / sum(CASE WHEN is_full THEN 0 ELSE amount END) OVER (PARTITION BY source) END AS share
  FROM b4),
b6 AS (SELECT *, CASE WHEN words > 0 THEN least(3.0, share / words) ELSE 0.0 END AS copies FROM b5),
b7 AS (
  SELECT source, bits, target, source_size, floor(copies) AS certain, copies - floor(copies) AS chance,
         target - sum(floor(copies) * words) OVER (PARTITION BY source) AS lacks FROM b6),
u AS (
  SELECT s.*, b.target, b.source_size, b.certain, b.chance, b.lacks,
         (CAST('0x' || substr(md5(name || ':mix'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN b7 b ON s.source IS NOT DISTINCT FROM b.source AND greatest(length(bin(s.size)), 1) = b.bits),
o AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS odds FROM u WHERE chance > 0 AND size > 0),
fit AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + size / 2.0 <= lacks AS fits FROM o)
SELECT doc_id, size, source_size, target, CAST((certain + 1) * size AS BIGINT) AS taken, CAST(certain + 1 AS BIGINT) AS copies FROM fit WHERE fits
UNION ALL
SELECT doc_id, size, source_size, target, CAST(certain * size AS BIGINT), CAST(certain AS BIGINT) FROM fit WHERE NOT fits
UNION ALL
SELECT doc_id, size, source_size, target, CAST(certain * size AS BIGINT), CAST(certain AS BIGINT) FROM u WHERE NOT (chance > 0 AND size > 0)
"""

ORACLES = {"op4_jaccard_join": _JACCARD, "op8_warc": _WARC, "op9_mixing": _MIXING}
