"""DuckDB SQL of the queries in ``scans``."""

from __future__ import annotations

from namewright.functions.markers import WORDS

_SLOTS = """slots AS (SELECT o_custkey AS image, substr(o_orderpriority, 1, 1)::BIGINT AS col, o_orderkey AS slot, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'auto' ELSE 'review' END AS status, o_totalprice AS score FROM orders),
  cols AS (SELECT image, col, count(*) AS n, (image + col) % 7 <> 0 AS stop_card, (image + col) % 7 <> 3 AS readable, count(*) FILTER (status = 'auto') AS n_auto FROM slots GROUP BY ALL)"""
_TRUTH = """truth AS (SELECT doc_id, source AS image, lang, CASE WHEN n_chars > 3000 THEN 'long' ELSE 'short' END AS level, 'c' || (doc_id % 3) AS category, CASE WHEN doc_id % 5 < 3 THEN 'C4' ELSE 'C6' END AS config,
    'o' || (doc_id % 2) AS oracle_id, doc_id % 11 = 0 AS split FROM documents),
  got AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'auto' WHEN quality = 1 THEN 'review' ELSE 'empty' END AS status, 'o' || (doc_id % 4) AS oracle_id FROM labels)"""
_CENTS = "cents AS (SELECT event_type, user_id, floor(value * 100)::BIGINT AS cents FROM events)"
_PIXELS = """px AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  im AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, greatest(least(floor(v * 128) + 128, 255), 0)::BIGINT AS p FROM px)"""

# Header markers against found columns: each marker should sit where the column's map puts it.
_HEADER = """marks AS (SELECT s_suppkey % 5 AS image, s_suppkey * 7 % 12 AS id, (s_suppkey * 13 % 17 + CASE WHEN s_suppkey * 7 % 2 = 1 THEN 40 ELSE 0 END)::DOUBLE AS cx, (s_suppkey * 11 % 5)::DOUBLE AS cy FROM supplier),
  found AS (SELECT n_nationkey % 5 AS image, n_nationkey // 5 + 1 AS col, 2.0::DOUBLE * (n_nationkey % 5) AS dx FROM nation WHERE n_nationkey % 5 < 4),
  pairs AS (SELECT m.*, f.col, 0.5::DOUBLE * cx + f.dx AS x, 0.5::DOUBLE * cy + 3 AS y, (id // 2 + 1 - f.col) * 70 AS away FROM marks m LEFT JOIN found f ON m.image = f.image),
  header AS (SELECT image, id, cx, cy, coalesce(bool_or(sqrt((x - CASE WHEN id % 2 = 0 THEN 15 ELSE 55 END - away) * (x - CASE WHEN id % 2 = 0 THEN 15 ELSE 55 END - away) + (y - 12.5) * (y - 12.5)) < 10 + 0.03::DOUBLE * abs(away)), false) AS plausible, count(col) AS n_columns FROM pairs GROUP BY image, id, cx, cy)"""


def _tally(groupings: list[str], counters: list[str], rows: str) -> str:
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in counters)
    parts = [f"SELECT 'total' AS grouping, NULL::VARCHAR AS value, {sums} FROM {rows}"]
    parts += [f"SELECT '{g}' AS grouping, {g} AS value, {sums} FROM {rows} GROUP BY {g}" for g in groupings]
    return " UNION ALL ".join(parts)


_FLAGS = """rows AS (SELECT t.*, (lang <> 'other' AND NOT split)::INT AS scored, coalesce(g.status, '') = 'auto' AS is_auto, g.oracle_id AS got_id, g.status FROM truth t LEFT JOIN got g USING (doc_id)),
  flags AS (SELECT *, (is_auto AND got_id = oracle_id)::INT * scored AS auto_ok, (is_auto AND got_id = oracle_id)::INT AS auto_ok_all, (is_auto AND got_id <> oracle_id)::INT AS wrong,
    coalesce(status = 'review', false)::INT AS review, (NOT is_auto AND coalesce(status, '') <> 'review')::INT AS empty FROM rows)"""

ORACLES = {
    "column_status": f"WITH {_SLOTS} SELECT image, col AS \"column\", CASE WHEN readable AND n_auto = n AND (stop_card OR n = 20) THEN 'ok' ELSE 'error' END AS status, stop_card, CASE WHEN readable THEN n ELSE 0 END AS n_cards, CASE WHEN readable THEN n ELSE 0 END AS n_slots FROM cols",
    "result_nested": f"""WITH {_SLOTS}, photos AS (SELECT image, CASE WHEN max(col) > 4 THEN 'C6' ELSE 'C4' END AS config, CASE WHEN bool_or(NOT readable) THEN 'retake' ELSE 'ok' END AS photo_status FROM cols GROUP BY image)
      SELECT s.image, config, photo_status, s.col AS "column", slot, status, score FROM slots s JOIN cols c ON s.image = c.image AND s.col = c.col AND c.readable JOIN photos p ON p.image = s.image""",
    "status_summary": f"WITH {_SLOTS} SELECT image, col AS \"column\", count(*) AS slots, count(*) FILTER (status = 'auto') AS auto, count(*) FILTER (status = 'review') AS review, 0::BIGINT AS empty FROM slots GROUP BY ALL",
    "eval_tally": f"WITH {_TRUTH.replace('source AS image, lang,', chr(39).join(['source AS image, CASE WHEN lang = ', 'es', ' THEN ', 'other', ' ELSE lang END AS lang,']))}, {_FLAGS} {_tally(['image', 'lang', 'level', 'category', 'config'], ['scored', 'auto_ok', 'auto_ok_all', 'wrong', 'review', 'empty'], 'flags')}",
    "eval_phantom": f"WITH {_TRUTH}, wrong AS (SELECT image, level, config, 1 AS wrong FROM got JOIN truth USING (doc_id) WHERE status = 'auto' AND level <> 'long') {_tally(['image', 'level', 'config'], ['wrong'], 'wrong')}",
    "eval_missing": """WITH got AS (SELECT o_custkey AS image, arg_min(o_orderstatus, o_orderkey) AS s, min(o_orderkey) AS k FROM orders GROUP BY 1), g AS (SELECT image, CASE WHEN s = 'P' THEN 'retake' ELSE 'ok' END AS status, CASE WHEN k % 2 = 0 THEN 'C4' ELSE 'C6' END AS config FROM got),
      t AS (SELECT c_custkey AS image, CASE WHEN c_nationkey % 2 = 0 THEN 'C4' ELSE 'C6' END AS config, CASE WHEN c_custkey % 9 = 0 THEN 'retake' ELSE 'ok' END AS expect FROM customer)
      SELECT t.image, (g.image IS NULL)::BIGINT AS missing, (expect = 'retake')::BIGINT AS retake, CASE WHEN g.image IS NULL THEN 0 ELSE (status <> expect)::BIGINT + (expect <> 'retake' AND g.config <> t.config)::BIGINT END::BIGINT AS status_errors FROM t LEFT JOIN g USING (image)""",
    "eval_columns": """WITH l AS (SELECT l_suppkey AS c, count(*) AS n_all, count(*) FILTER (l_returnflag = 'R') AS n_r FROM lineitem GROUP BY 1),
      t AS (SELECT s_suppkey AS c, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_all ELSE n_r END, 0) AS n, s_suppkey % 5 = 0 AS neg FROM supplier LEFT JOIN l ON l.c = s_suppkey),
      g AS (SELECT c, n_all AS n, CASE WHEN c % 10 = 0 THEN 'error' ELSE 'ok' END AS status FROM l WHERE c % 7 <> 0)
      SELECT t.c AS "column", (g.c IS NULL)::BIGINT + (NOT neg AND (g.n IS NULL OR g.n <> t.n))::BIGINT AS count_errors, (neg AND coalesce(status, '') <> 'error')::BIGINT AS status_errors FROM t LEFT JOIN g USING (c)""",
    "eval_verdict": f"WITH {_TRUTH}, {_FLAGS}, s AS (SELECT lang, sum(scored)::BIGINT AS scored, sum(auto_ok)::BIGINT AS auto_ok, sum(wrong)::BIGINT AS wrong FROM flags GROUP BY lang) SELECT *, CASE WHEN scored > 0 THEN 100.0::DOUBLE * auto_ok / scored ELSE 0.0 END AS rate, CASE WHEN wrong > 0 OR CASE WHEN scored > 0 THEN 100.0::DOUBLE * auto_ok / scored ELSE 0.0 END < 20 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s",
    "profile_nearest_rank": "WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[floor((len(v) - 1) * 0.5::DOUBLE + 0.5)::BIGINT + 1] AS p50, v[floor((len(v) - 1) * 0.95::DOUBLE + 0.5)::BIGINT + 1] AS p95 FROM s",
    "profile_mean": f"WITH {_CENTS} SELECT event_type, avg(cents) AS mean, count(cents) AS n FROM cents GROUP BY 1",
    "profile_share": f"WITH {_CENTS}, m AS (SELECT event_type, avg(cents) AS mean FROM cents GROUP BY 1) SELECT event_type, round(100.0::DOUBLE * mean / (SELECT sum(mean) FROM m), 6) AS share FROM m",
    "profile_stages": f"WITH {_CENTS} SELECT avg(cents) AS total, avg(user_id) AS stages_warp, avg(cents % 7) AS stages_trim FROM cents",
    "crops_per_slot": f"WITH {_CENTS}, g AS (SELECT user_id, count(*) AS lines, count(*) FILTER (event_type = 'purchase') AS slots FROM cents GROUP BY 1) SELECT user_id, CASE WHEN slots > 0 THEN lines / slots ELSE 0.0 END::DOUBLE AS crops_per_slot FROM g",
    "gate_summary": f"WITH {_CENTS} SELECT event_type, count(*) AS lines, avg(cents) AS mean FROM cents GROUP BY 1",
    "reader_bakeoff": f"""WITH {_TRUTH}, r AS (SELECT t.image AS reader, level = CASE WHEN doc_id % 4 = 0 THEN 'long' ELSE 'short' END AS exact, status = 'auto' AS is_auto, g.oracle_id = t.oracle_id AS same FROM truth t JOIN got g USING (doc_id) WHERE lang <> 'fr')
      SELECT reader, count(*) AS lines, 100.0::DOUBLE * count(*) FILTER (exact) / count(*) AS exact, 100.0::DOUBLE * count(*) FILTER (is_auto AND same) / count(*) AS auto_ok, count(*) FILTER (is_auto AND NOT same) AS wrong FROM r GROUP BY 1""",
    "set_stats": "SELECT p_type AS level, count(*) AS slots, count(DISTINCT p_brand) AS printings, count(DISTINCT p_name) AS oracles FROM part GROUP BY 1",
    "batch_schedule": "WITH g AS (SELECT source, count(*) AS lines, sum(n_chars)::BIGINT AS px FROM documents GROUP BY 1), b AS (SELECT *, greatest(1, least(4, ceil(lines / 8)))::BIGINT AS batch FROM g) SELECT source, lines, batch, ceil(lines / batch)::BIGINT AS calls, px FROM b",
    "index_build": r"""WITH f AS (SELECT *, p_size % 3 = 0 AND p_size % 10 <> 0 AND p_size % 2 <> 0 AS inset FROM part WHERE p_size % 10 <> 0 AND p_partkey % 13 <> 0),
      n AS (SELECT 'en' AS lang, p_name || ' // ' || p_type AS name, p_brand AS oracle_id FROM f UNION ALL SELECT 'en', p_name, p_brand FROM f WHERE NOT inset UNION ALL SELECT 'pt', 'Ção ' || p_name, p_brand FROM f WHERE p_partkey % 3 = 0),
      d AS (SELECT DISTINCT lang, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS key, oracle_id, name FROM n)
      SELECT key, name, oracle_id, lang, row_number() OVER (ORDER BY lang, key, oracle_id, name) - 1 AS entry_idx FROM d""",
    "index_solvable": """WITH e AS (SELECT c_custkey, c_mktsegment AS oracle_id, CASE WHEN c_custkey % 3 = 0 THEN substr(c_mktsegment, 1, 3) || (c_custkey % 400) ELSE (c_custkey % 400)::VARCHAR END AS key FROM customer),
      k AS (SELECT key FROM e GROUP BY key HAVING count(DISTINCT oracle_id) = 1) SELECT c_custkey, key, oracle_id FROM e WHERE key IN (SELECT key FROM k)""",
    "pool_quota": """WITH d AS (SELECT *, md5('7:' || c_custkey) AS draw FROM customer), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY draw, c_custkey) = 1)
      SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY draw, c_custkey) AS draw_rank FROM o QUALIFY draw_rank <= 10""",
    "pool_category": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'en_split' WHEN p_size % 5 = 1 THEN 'en_multiface' WHEN p_partkey % 6 = 0 OR p_partkey % 8 = 0 THEN 'en_special' WHEN p_partkey % 4 = 0 THEN 'en_old' WHEN p_partkey % 4 IN (1, 2) THEN 'en_modern' END AS category,
      CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN p_name ELSE p_brand END WHEN p_size % 5 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN p_brand END
        ELSE CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand END END AS shown FROM part""",
    "drift_predict": """WITH e AS (SELECT event_id, user_id, ts, floor(value * 10) / 10 % 8 AS v FROM events), w AS (SELECT event_id, coalesce(list(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []::DOUBLE[]) AS o FROM e),
      m AS (SELECT event_id, o, list_sort(o)[len(o) // 2 + 1] AS med FROM w), n AS (SELECT *, list_filter(list_zip(range(len(o))::DOUBLE[], o), lambda p: abs(p[2] - med) <= 2.5) AS near FROM m),
      k AS (SELECT *, list_avg(list_transform(near, lambda p: p[1])) AS mk, list_avg(list_transform(near, lambda p: p[2])) AS mo FROM n),
      s AS (SELECT *, list_sum(list_transform(near, lambda p: (p[1] - mk) * (p[2] - mo))) / list_sum(list_transform(near, lambda p: (p[1] - mk) * (p[1] - mk))) AS slope FROM k)
      SELECT event_id, 0.0::DOUBLE + round(CASE WHEN len(o) = 0 THEN 0.0 WHEN len(near) < 4 THEN med ELSE least(greatest(mo + slope * (len(o) - mk), med - 2.5), med + 2.5) END, 6) AS shift FROM s""",
    "drift_feedback": """WITH RECURSIVE e AS (SELECT event_id, user_id, value % 8 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      step AS (
        SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS i, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS found, []::DOUBLE[] AS o FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT event_id, user_id, i, shift, least(greatest(v, shift - 2.5), shift + 2.5), list_append(o, least(greatest(v, shift - 2.5), shift + 2.5))[-8:] FROM (
          SELECT *, CASE WHEN len(o) = 0 THEN 0.0 WHEN len(near) < 4 THEN med ELSE least(greatest(mo + list_sum(list_transform(near, lambda p: (p[1] - mk) * (p[2] - mo))) / list_sum(list_transform(near, lambda p: (p[1] - mk) * (p[1] - mk))) * (len(o) - mk), med - 2.5), med + 2.5) END::DOUBLE AS shift FROM (
            SELECT *, list_avg(list_transform(near, lambda p: p[1])) AS mk, list_avg(list_transform(near, lambda p: p[2])) AS mo FROM (
              SELECT *, list_filter(list_zip(range(len(o))::DOUBLE[], o), lambda p: abs(p[2] - med) <= 2.5) AS near FROM (
                SELECT e.event_id, e.user_id, e.i, e.v, o, list_sort(o)[len(o) // 2 + 1] AS med FROM step JOIN e ON e.user_id = step.user_id AND e.i = step.i + 1)))))
      SELECT event_id, 0.0::DOUBLE + round(shift, 6) AS shift, 0.0::DOUBLE + round(found, 6) AS "offset" FROM step WHERE i > 0""",
    "marker_pairs": """WITH m AS (SELECT s_suppkey % 5 AS image, s_suppkey * 7 % 12 AS id, (s_suppkey * 13 % 17 + CASE WHEN s_suppkey * 7 % 2 = 1 THEN 40 ELSE 0 END)::DOUBLE AS cx, (s_suppkey * 11 % 5)::DOUBLE AS cy, (15 + s_suppkey % 6)::DOUBLE AS side FROM supplier),
      p AS (SELECT l.image, l.id // 2 + 1 AS col, abs(sqrt((l.cx - r.cx) * (l.cx - r.cx) + (l.cy - r.cy) * (l.cy - r.cy)) / ((l.side + r.side) / 2) / (40.0::DOUBLE / 18.0::DOUBLE) - 1) AS error FROM m l JOIN m r ON l.image = r.image AND l.id % 2 = 0 AND r.id = l.id + 1 AND greatest(l.side, r.side) < 1.3 * least(l.side, r.side))
      SELECT image, col AS "column", round(min(error), 9) AS error FROM p WHERE error < 0.2 GROUP BY ALL""",
    "stop_slot": """WITH e AS (SELECT event_id, floor(value * 10)::BIGINT AS v, 20.0::DOUBLE + user_id % 20 AS side FROM events), p AS (SELECT event_id, (v % 700) / 10.0::DOUBLE AS x, (v * 3 % 2400) / 10.0::DOUBLE AS y, side FROM e)
      SELECT event_id, CASE WHEN x >= 0 AND x < 70 AND y >= 25 AND abs(x - 35) < 10 AND abs(side / 30.0::DOUBLE - 1) < 0.2 THEN round((y - side / 2 - 3 - 25) / 10)::BIGINT + 1 END AS stop_slot FROM p""",
    "column_plan": """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN least(greatest(o_custkey % 30 - 5, 0), 20) END, 20)::BIGINT AS n_cards, 25.0::DOUBLE + 10.0::DOUBLE * (o_custkey % 20) + 0.5::DOUBLE - 1.5::DOUBLE AS y0,
      25.0::DOUBLE + 10.0::DOUBLE * (o_custkey % 20) + 10.0::DOUBLE - 0.5::DOUBLE + 1.5::DOUBLE AS y1, 2 * (o_custkey % 6) + 1 AS marker FROM orders""",
    "header_plausible": f"WITH {_HEADER} SELECT image, id, cx, cy, plausible, n_columns FROM header",
    "photo_columns": f"""WITH {_HEADER}, photos AS (SELECT r.image, CASE WHEN bool_or(h.id BETWEEN 8 AND 11 AND (n_columns = 0 OR plausible)) THEN 'C6' ELSE 'C4' END AS config FROM (SELECT unnest(range(5)) AS image) r LEFT JOIN header h USING (image) GROUP BY 1),
      stops AS (SELECT c_custkey AS place, c_custkey % 5 AS image, (c_custkey * 13 % 200)::DOUBLE AS cx, (c_custkey * 11 % 500)::DOUBLE AS cy FROM customer WHERE c_custkey % 7 = 0),
      met AS (SELECT f.image, f.col, place, round((0.5::DOUBLE * (cy - 30) + 3 - 3 - 25) / 10)::BIGINT + 1 AS slot FROM found f JOIN stops s ON s.image = f.image AND 0.5::DOUBLE * cx + dx >= 0 AND 0.5::DOUBLE * cx + dx < 70 AND 0.5::DOUBLE * cy + 3 >= 25 AND abs(0.5::DOUBLE * cx + dx - 35) < 10),
      firsts AS (SELECT image, col, arg_min(slot, place) AS slot FROM met GROUP BY ALL)
      SELECT p.image, config, a.col AS "column", f.image IS NOT NULL AS readable, slot IS NOT NULL AS stop_card, CASE WHEN slot IS NULL THEN 20 ELSE least(greatest(slot - 1, 0), 20) END::BIGINT AS n_cards
      FROM photos p JOIN (SELECT unnest(range(1, 7)) AS col) a ON a.col <= CASE WHEN config = 'C6' THEN 6 ELSE 4 END LEFT JOIN found f ON f.image = p.image AND f.col = a.col LEFT JOIN firsts s ON s.image = p.image AND s.col = a.col""",
    "dict_lookup": f"""WITH w AS (SELECT unnest(range(50)) AS id, unnest([{', '.join(map(str, WORDS))}])::INT AS word), c AS (SELECT (l_partkey * 40503 % 65536)::INT AS code, count(*) AS n FROM lineitem GROUP BY 1),
      d AS (SELECT code, id, bit_count(xor(code, word))::BIGINT AS errors FROM c, w WHERE bit_count(xor(code, word)) <= 4), b AS (SELECT code, min(errors) AS errors FROM d GROUP BY 1),
      f AS (SELECT d.code, min(d.id) AS id, min(d.errors) AS errors FROM d JOIN b ON d.code = b.code AND d.errors = b.errors GROUP BY d.code HAVING count(*) = 1) SELECT c.code, n, id, errors FROM c LEFT JOIN f ON c.code = f.code""",
    "downscale": f"WITH {_PIXELS}, d AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, sum(p)::BIGINT // 4 AS p FROM im GROUP BY ALL) SELECT vec_id, string_agg(printf('%02x', p), '' ORDER BY y, x) AS pixels FROM d GROUP BY 1",
    "adaptive_threshold": f"""WITH {_PIXELS}, d AS (SELECT a.vec_id, a.y, a.x, a.p, sum(b.p) / count(*) AS mean FROM im a JOIN im b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
      SELECT vec_id, string_agg(CASE WHEN p < mean - 7 THEN 'ff' ELSE '00' END, '' ORDER BY y, x) AS pixels FROM d GROUP BY 1""",
    "invert": f"WITH {_PIXELS} SELECT vec_id, string_agg(printf('%02x', 255 - p), '' ORDER BY y, x) AS pixels FROM im GROUP BY 1",
    "two_means": f"""WITH {_PIXELS}, l AS (SELECT vec_id, list(p::DOUBLE) AS v, min(p)::DOUBLE AS low, max(p)::DOUBLE AS high FROM im GROUP BY 1)
      SELECT vec_id, CASE WHEN high - low >= 30 THEN round(list_reduce(list_transform(range(10), lambda i: i::DOUBLE), lambda t, i:
        CASE WHEN len(list_filter(v, lambda x: x > t)) IN (0, len(v)) THEN t ELSE (list_avg(list_filter(v, lambda x: x > t)) + list_avg(list_filter(v, lambda x: x <= t))) / 2 END,
        (high + low) / 2), 6) END AS threshold FROM l""",
    "row_energy_peak": f"""WITH {_PIXELS}, e AS (SELECT a.vec_id, a.y, sum(abs(b.p - a.p))::BIGINT AS energy FROM im a JOIN im b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL),
      l AS (SELECT vec_id, list(energy ORDER BY y) AS es FROM e GROUP BY 1), c AS (SELECT vec_id, es, unnest(range(35, 96)) AS c FROM l),
      f AS (SELECT vec_id, c, list_sum(list_transform(range(c - 18, c + 18), lambda r: es[r // 20 + 1])) AS f FROM c),
      n AS (SELECT *, lag(f) OVER w AS f0, lead(f) OVER w AS f1 FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY c)),
      best AS (SELECT vec_id, c AS top FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY f DESC, c DESC) = 1),
      second AS (SELECT vec_id, c AS other FROM n JOIN best USING (vec_id) WHERE f >= f0 AND f >= f1 AND abs(c - top) >= 24 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY f DESC, c DESC) = 1)
      SELECT vec_id, greatest(top - 38, 0)::BIGINT AS y0, (top + 38)::BIGINT AS y1, greatest(other - 38, 0 * other)::BIGINT AS "second" FROM best LEFT JOIN second USING (vec_id)""",
    "right_trim": f"""WITH {_PIXELS}, k AS (SELECT a.vec_id, a.x, 2 * sum(abs(b.p - a.p))::BIGINT AS energy FROM im a JOIN im b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL),
      e AS (SELECT v.vec_id, c AS x, coalesce(k.energy, 0) AS energy FROM (SELECT vec_id, unnest(range(64)) AS c FROM embeddings) v LEFT JOIN k ON k.vec_id = v.vec_id AND c = k.x * 8 + 7),
      q AS (SELECT vec_id, list(energy ORDER BY energy) AS s FROM e GROUP BY 1),
      b AS (SELECT vec_id, x, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS island FROM e JOIN q USING (vec_id) WHERE s[60] > s[7] AND energy <= s[7] + 0.2::DOUBLE * (s[60] - s[7])),
      r AS (SELECT vec_id, min(x) AS a, max(x) AS z FROM b GROUP BY vec_id, island HAVING max(x) - min(x) >= 6 AND max(x) >= 20),
      t AS (SELECT vec_id, arg_max(a, z) AS a FROM r GROUP BY 1)
      SELECT vec_id, CASE WHEN coalesce(a, 0) = 0 THEN 64 ELSE greatest(least(a + 2, 64), 1) END::BIGINT AS "end" FROM q LEFT JOIN t USING (vec_id)""",
    "ctc_greedy": """WITH p AS (SELECT vec_id, i // 4 AS t, i % 4 AS c, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY v DESC, c DESC) = 1),
      l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM b), e AS (SELECT *, c > 0 AND (before IS NULL OR before <> c) AS emits FROM l)
      SELECT vec_id, coalesce(string_agg(['a', 'b', 'c'][c], '' ORDER BY t) FILTER (emits), '') AS text, round(coalesce(avg(v) FILTER (emits), 0.0), 6) AS confidence FROM e GROUP BY 1""",
    "homography_fit": """WITH n AS (SELECT vec_id, unnest(range(8)) AS quad, embedding::DOUBLE[] AS e FROM embeddings),
      c AS (SELECT vec_id, quad, list_transform(range(4), lambda k: [30.0::DOUBLE * [0, 1, 1, 0][k + 1] + 5 * e[quad * 8 + 2 * k + 1], 30.0::DOUBLE * [0, 0, 1, 1][k + 1] + 5 * e[quad * 8 + 2 * k + 2]]) AS q FROM n),
      d AS (SELECT *, q[3][1] - q[1][1] AS ax, q[3][2] - q[1][2] AS ay, q[4][1] - q[2][1] AS bx, q[4][2] - q[2][2] AS by_ FROM c),
      t AS (SELECT *, ((q[2][1] - q[1][1]) * by_ - (q[2][2] - q[1][2]) * bx) / (ax * by_ - ay * bx) AS t FROM d)
      SELECT vec_id, quad::BIGINT AS quad, round(q[1][1] + t * ax, 4) AS x, round(q[1][2] + t * ay, 4) AS y FROM t""",
    "marker_detect": """SELECT n_nationkey::BIGINT AS nation, m::BIGINT AS marker, m::BIGINT AS seen, [36, 36, 108, 108][n_nationkey % 4 + 1]::BIGINT AS x, [36, 108, 108, 36][n_nationkey % 4 + 1]::BIGINT AS y
      FROM (SELECT n_nationkey, unnest([2 * n_nationkey, 2 * n_nationkey + 1]) AS m FROM nation)""",
}
