"""SQL for DuckDB of those queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from cueloom.llm.common import LOWER, UPPER
from cueloom.llm.licenses import BASE, SIGNATURES

#: Words, unchanged and lower-cased. Rows are told apart by a number of their own, as ids may repeat.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _texts(words: str) -> str:
    return f"d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents)"


PASSAGES = f"""WITH {_texts(_WORDS)},
win AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS k FROM d),
lowest AS (SELECT k, min(id) AS low FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM win JOIN lowest USING (k) WHERE low < id),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

CONTAMINATION = f"""WITH {_texts(_TERMS)},
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i:i + 12], ' '))) AS k FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM patterns),
win AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k FROM d, sizes),
hits AS (SELECT r, i, n, item FROM win JOIN patterns USING (n, k)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

_RULES = ", ".join(f"('{s.label}', '{s.pattern.strip(' ').replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}', '{s.keyword.replace(' ', '  ')}', {s.priority}, CAST({s.confidence} AS DOUBLE))" for s in SIGNATURES)
_PLACES = ", ".join(f"({str(p.split())}, '{label}')" for p, label in BASE.items())
#: Each word between two spaces of its own; a signature's matches by the lengths of what stands between them.
LICENSES = f"""WITH {_texts(_TERMS)}, lined AS (SELECT r, w, ' ' || array_to_string(w, '  ') || ' ' AS line FROM d),
rules(label, pattern, keyword, priority, confidence) AS (VALUES {_RULES}),
phrases(phrase, label) AS (VALUES {_PLACES}),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS pos FROM d, phrases),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
matches AS (SELECT r, label, priority, confidence, regexp_extract_all(line, ' ' || pattern || ' ') AS m, regexp_split_to_array(line, ' ' || pattern || ' ') AS p FROM lined JOIN rules ON contains(line, keyword) AND regexp_matches(line, ' ' || pattern || ' ')),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matches),
spans AS (SELECT r, label, priority, confidence, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM numbered),
ordered AS (SELECT *, max(a + n) OVER (PARTITION BY r ORDER BY a, n DESC, priority DESC, label, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
found AS (SELECT r, label, confidence FROM ordered WHERE before IS NULL OR a + n > before),
told AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM (SELECT * FROM found UNION ALL SELECT r, label, CAST(0.7 AS DOUBLE) FROM places) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN base USING (r) LEFT JOIN told USING (r)"""

ORACLE_SQL = {"op4_passages": PASSAGES, "op5_licenses": LICENSES, "op8_decontaminate": CONTAMINATION}
