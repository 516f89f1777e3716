"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from namewright.llm import chat, line_dedup
from namewright.llm.secrets import RULES

_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(place: int, rule) -> str:
    pattern = _quoted(rule.pattern)
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
      list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0) AS a, length(found[i]) AS n
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {pattern}, 0) AS found, regexp_extract_all(text, {pattern}, {rule.group}) AS own, string_split_regex(text, {pattern}) AS gaps FROM docs) WHERE len(found) > 0)
      WHERE length(own[i]) >= {rule.least}"""


_SHOW = "kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT"
OP3 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({' UNION ALL '.join(_spans(i, r) for i, r in enumerate(RULES))})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (s.kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(string_agg({_SHOW}, ',' ORDER BY a, place) FILTER (base), '')) AS base_sha256, coalesce(string_agg({_SHOW}, ',' ORDER BY a, place), '') AS spans
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""

OP6 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp c"""

_WORDS = "regexp_extract_all(" + _LOW.format(x="coalesce(text, '')") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP7 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  sized AS (SELECT *, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
  sizes AS (SELECT DISTINCT size FROM windows),
  places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
  hits AS (SELECT p.doc_id, p.i, p.size, n.item_id FROM places p JOIN windows n ON p.size = n.size AND p.win = n.win),
  hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op3_secrets": OP3, "op6_embeddings": OP6, "op7_decontaminate": OP7, "op8_chat": chat.ORACLE}
