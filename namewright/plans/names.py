"""Queries on text lines and name matching, with their DuckDB SQL.

The driver's tables stand in for lines and names: queries are damaged part names, an index entry is a part (key p_name, entity
p_brand, file order p_partkey).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import similarity as sim
from namewright.functions import text as t
from namewright.operators import cascade, matching
from namewright.operators.results import slot_fields


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- T1-T14 -----------------------------------------------------------------------------------------------------------


def text_normalize(spark, sf_dir):
    key = t.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).select("doc_id", F.length("key").alias("key_chars"), F.md5("key").alias("key_md5"))


def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean(F.col("text")).alias("c")).select("doc_id", F.length("c").alias("chars"), F.md5("c").alias("clean_md5"))


def text_has_letter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.has_letter(F.col("text")).alias("has_letter"))


def _cost_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    end = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' 6UU' WHEN 1 THEN ' U' WHEN 2 THEN ' WR  ' WHEN 3 THEN concat(' ', p_size) ELSE concat(' {', p_size % 10, '}') END")
    return part.select("p_partkey", F.concat("p_name", end).alias("line"))


def text_mana_token(spark, sf_dir):
    return _cost_lines(spark, sf_dir).select("p_partkey", t.strip_mana_token(F.col("line")).alias("head"))


def text_name_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", t.looks_like_name(F.col("text")).alias("name_shape"), t.title_case_start(F.col("text")).alias("title_start"))


def text_decoy(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_brand").alias("a"), F.upper("p_name").alias("b"), "p_type")
    long = rows.select("p_partkey", F.explode(F.array("a", "b", "p_type")).alias("line"))
    key = F.when(F.col("p_partkey") % 2 == 0, "prosperity").otherwise("else")
    return long.select("p_partkey", "line", t.decoy_or_fragment(F.col("line"), key).alias("decoy"), t.too_short_for_auto(t.separated(F.col("line"))).alias("short"))


def indel_ratio_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b")))
    scored = pairs.withColumn("lcs", sim.lcs_column(F.col("a"), F.col("b")).cast("long"))
    ratio = sim.ratio_column(F.col("lcs"), F.col("a"), F.col("b"))
    return scored.select("a", "b", "lcs", sim.indel_column(F.col("lcs"), F.col("a"), F.col("b")).cast("long").alias("indel"), sim.published_score(ratio).alias("score"))


# --- M1-M5 ------------------------------------------------------------------------------------------------------------


def part_index(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("oracle_id"), F.lit("en").alias("lang"), F.col("p_partkey").alias("entry_idx"))


def _capital(text):
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def damaged(spark, sf_dir) -> DataFrame:
    """Each distinct part name without its third character, as a line (raw)."""
    cut = F.concat(F.substring("p_name", 1, 2), F.substring(F.col("p_name"), F.lit(4), F.length("p_name")))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("truth"), _capital(cut).alias("raw")).distinct()


def _matched(spark, sf_dir) -> DataFrame:
    return matching.match_lines(damaged(spark, sf_dir), matching.shards(part_index(spark, sf_dir)))


def match_top3(spark, sf_dir):
    listed = _matched(spark, sf_dir).select("raw", F.posexplode("candidates").alias("rank", "c"))
    return listed.select("raw", (F.col("rank") + 1).cast("long").alias("rank"), "c.oracle_id", "c.key", "c.score")


def match_best_per_entity(spark, sf_dir):
    """All pairs in the JVM form: each query's best entry of every entity."""
    queries = damaged(spark, sf_dir).select(F.lower("raw").alias("query")).distinct()
    first = part_index(spark, sf_dir).groupBy("oracle_id", "key").agg(F.min("entry_idx").alias("entry_idx"))
    scored = matching.score_all(queries, first, sim.lcs_column(F.col("query"), F.col("key")))
    scored = scored.withColumn("score", sim.ratio_column(F.col("lcs"), F.col("query"), F.col("key")))
    return matching.best_per_entity(scored).select("query", "oracle_id", "key", "entry_idx", sim.published_score(F.col("score")).alias("score"))


def match_accept(spark, sf_dir):
    best = lambda i: F.coalesce(F.get("candidates", F.lit(i))["score"], F.lit(0.0))
    return _matched(spark, sf_dir).select("raw", "key", "status", best(0).alias("best"), best(1).alias("runner_up"), F.get("candidates", F.lit(0))["oracle_id"].alias("oracle_id"))


def match_bulk(spark, sf_dir):
    """The headline load: distinct kinds of parts, damaged, against all long part names as keys."""
    key = F.lower(F.concat_ws(" ", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" ")), "p_name"))
    part = table(spark, sf_dir, "part")
    index = part.select(key.alias("key"), key.alias("name"), F.col("p_name").alias("oracle_id"), F.lit("en").alias("lang"), F.col("p_partkey").alias("entry_idx"))
    kind = F.lower(F.concat_ws(" ", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" "))))
    asked = part.select(kind.alias("kind")).distinct().select(F.concat(F.substring("kind", 1, 2), F.substring(F.col("kind"), F.lit(4), F.length("kind"))).alias("query"))
    found = matching.top_candidates(asked.repartition(spark.sparkContext.defaultParallelism, "query"), matching.shards(index), "query")
    listed = found.select("query", F.posexplode("candidates").alias("rank", "c"))
    return listed.select("query", (F.col("rank") + 1).cast("long").alias("rank"), "c.oracle_id", "c.key", sim.published_score(F.col("c.score")).alias("score"))


# --- C1-C6 ------------------------------------------------------------------------------------------------------------


def _lines(spark, sf_dir, form: str) -> DataFrame:
    """Readings of each distinct part name: fast (last character lost), accurate (as printed, now and then lower case) and
    three numbered variants."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("slot")).withColumn("n", F.length("p_name"))
    shape = {
        "fast": F.when(F.col("slot") % 3 == 0, F.upper("p_name")).when(F.col("slot") % 3 == 1, _capital(F.concat(F.substring(F.col("p_name"), F.lit(1), F.col("n") - 2), F.lit(" 3")))).otherwise(_capital(F.col("p_name"))),
        "accurate": F.when(F.col("slot") % 2 == 0, F.col("p_name")).otherwise(_capital(F.substring(F.col("p_name"), F.lit(1), F.col("n") - 1))),
    }
    if form in shape:
        return names.select("slot", shape[form].alias("raw"), (F.col("slot") % 10 / 10.0).alias("confidence"))
    cut = _capital(F.substring(F.col("p_name"), F.lit(1), F.col("n") - (F.col("variant") - 1).cast("int")))
    return names.withColumn("variant", F.explode(F.array(*(F.lit(v) for v in (1, 2, 3))))).select("slot", "variant", cut.alias("raw"), ((F.col("slot") + F.col("variant")) % 10 / 10.0).alias("confidence"))


def single_index(spark, sf_dir) -> DataFrame:
    """An index in which each name is an entity of its own."""
    own = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entry_idx"))
    return own.select(F.col("p_name").alias("key"), F.col("p_name").alias("name"), F.concat(F.lit("id:"), "p_name").alias("oracle_id"), F.lit("en").alias("lang"), "entry_idx")


def _fast(spark, sf_dir):
    index = matching.shards(single_index(spark, sf_dir))
    return index, cascade.match_readings(_lines(spark, sf_dir, "fast"), index)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("slot", "raw", "status", F.get("candidates", F.lit(0))["oracle_id"].alias("oracle_id"), cascade.best_score(F.col("candidates")).alias("score"))


def space_ambiguous(spark, sf_dir):
    index = single_index(spark, sf_dir)
    split = index.select(F.concat(F.substring("key", 1, 3), F.lit(" "), F.substring(F.col("key"), F.lit(4), F.length("key"))).alias("key"), "name", F.concat(F.lit("split:"), "name").alias("oracle_id"), "lang", (F.col("entry_idx") + 10_000_000).alias("entry_idx"))
    both = matching.shards(index.unionByName(split))
    found = cascade.match_readings(_lines(spark, sf_dir, "accurate"), both)
    return found.select("slot", cascade.space_ambiguous(F.col("candidates")).alias("ambiguous"), "status")


def trust_filter(spark, sf_dir):
    _, fast = _fast(spark, sf_dir)
    return fast.select("slot", "raw", "status", cascade.trusted(F.col("status"), F.col("raw"), F.col("key"), F.col("candidates")).alias("trusted"))


def cascade_reread(spark, sf_dir):
    index, fast = _fast(spark, sf_dir)
    return _flat(cascade.reread_untrusted(fast, _lines(spark, sf_dir, "accurate"), index, ["slot"]))


def fallback_best(spark, sf_dir):
    index, fast = _fast(spark, sf_dir)
    reread = cascade.reread_untrusted(fast, _lines(spark, sf_dir, "accurate"), index, ["slot"])
    return _flat(cascade.fallback(reread, _lines(spark, sf_dir, "variants"), index, ["slot"]))


def slot_results(spark, sf_dir):
    _, fast = _fast(spark, sf_dir)
    rows = slot_fields(fast)
    return rows.select("slot", "status", "raw", "name", "oracle_id", "lang", "score", F.size("candidates").cast("long").alias("n_candidates"))


QUERIES = {f.__name__: f for f in (text_normalize, text_clean, text_has_letter, text_mana_token, text_name_shape, text_decoy, indel_ratio_pairs, match_top3, match_best_per_entity, match_accept, match_bulk, space_ambiguous, trust_filter, cascade_reread, fallback_best, slot_results)}


#: DuckDB has no LCS: the same bit recurrence as a list reduction over the characters of b.
LCS_SQL = """(length({a}) - bit_count(list_reduce(
    list_transform(range(1, length({b}) + 1), lambda i: unicode(substr({b}, i::INT, 1))::BIGINT),
    lambda s, c: ((s + (s & list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN unicode(substr({a}, (i + 1)::INT, 1)) = c THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END))::BIGINT))
      | (s - (s & list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN unicode(substr({a}, (i + 1)::INT, 1)) = c THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END))::BIGINT)))
      & ((1::BIGINT << length({a})::INT) - 1),
    (1::BIGINT << length({a})::INT) - 1)))::BIGINT"""


def lcs_sql(a: str, b: str) -> str:
    return LCS_SQL.format(a=a, b=b)


def published_sql(x: str) -> str:
    return f"(floor((({x})::FLOAT)::DOUBLE * 10000.0 + 0.5) / 10000.0)"


_KEY = r"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = r"trim(regexp_replace(trim(regexp_replace(regexp_extract({x}, '(?s)^(.*\p{{L}}\S*)', 1), '\s+', ' ', 'g')), '[{{}}()\[\]0-9@#*%&+=|\\/\s]+$', ''))"

_SCORED = f"""
  damaged AS (SELECT DISTINCT upper(substr(p_name, 1, 1)) || substr(p_name, 2, 1) || substr(p_name, 4) AS raw,
                     lower(substr(p_name, 1, 2) || substr(p_name, 4)) AS query FROM part),
  idx AS (SELECT p_name AS key, p_brand AS oracle_id, min(p_partkey) AS entry_idx FROM part GROUP BY ALL),
  pairs AS (SELECT q.raw, q.query, i.key, i.oracle_id, i.entry_idx, {lcs_sql('q.query', 'i.key')} AS lcs FROM damaged q, idx i),
  scored AS (SELECT *, 2.0::DOUBLE * lcs / (length(query) + length(key)) * 100.0::DOUBLE AS ratio FROM pairs),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, oracle_id ORDER BY ratio DESC, entry_idx) = 1),
  top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, oracle_id) AS rank FROM best QUALIFY rank <= 3)"""


_CAP = "(upper(substr({x}, 1, 1)) || substr({x}, 2))"
_NAMES = "names AS (SELECT p_name, min(p_partkey) AS slot, length(p_name) AS n FROM part GROUP BY p_name)"
_SINGLE = "idx AS (SELECT p_name AS key, 'id:' || p_name AS oracle_id, min(p_partkey) AS entry_idx FROM part GROUP BY p_name)"
_FAST = f"""fast AS (SELECT slot, 0 AS variant, CASE slot % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN {_CAP.format(x="(substr(p_name, 1, n - 2) || ' 3')")}
  ELSE {_CAP.format(x='p_name')} END AS raw, slot % 10 / 10.0::DOUBLE AS confidence FROM names)"""
_ACCURATE = f"""accurate AS (SELECT slot, 0 AS variant, CASE WHEN slot % 2 = 0 THEN p_name ELSE {_CAP.format(x='substr(p_name, 1, n - 1)')} END AS raw, slot % 10 / 10.0::DOUBLE AS confidence FROM names)"""
_VARIANTS = f"""variants AS (SELECT slot, variant, {_CAP.format(x='substr(p_name, 1, n - (variant - 1))')} AS raw, (slot + variant) % 10 / 10.0::DOUBLE AS confidence
  FROM (SELECT *, unnest([1, 2, 3]) AS variant FROM names))"""


def _read_sql(lines: str) -> str:
    """CTEs that match the lines of a CTE and apply accept and guards: <lines>_read."""
    key = _KEY.format(x=_CLEAN.format(x="raw"))
    squash = lambda k: f"replace({k}, ' ', '')"
    score = lambda x: published_sql(x)
    return f"""{lines}_key AS (SELECT *, {key} AS key FROM {lines}),
  {lines}_pair AS (SELECT l.*, i.key AS ikey, i.oracle_id, i.entry_idx, {lcs_sql('l.key', 'i.key')} AS lcs FROM {lines}_key l, idx i),
  {lines}_ratio AS (SELECT *, 2.0::DOUBLE * lcs / (length(key) + length(ikey)) * 100.0::DOUBLE AS ratio FROM {lines}_pair),
  {lines}_best AS (SELECT * FROM {lines}_ratio QUALIFY row_number() OVER (PARTITION BY slot, variant, oracle_id ORDER BY ratio DESC, entry_idx) = 1),
  {lines}_top AS (SELECT *, row_number() OVER (PARTITION BY slot, variant ORDER BY ratio DESC, oracle_id) AS rank FROM {lines}_best QUALIFY rank <= 3),
  {lines}_wide AS (SELECT slot, variant, raw, confidence, key, max(ratio) FILTER (rank = 1) AS b, max(ratio) FILTER (rank = 2) AS r, max(ikey) FILTER (rank = 1) AS bkey,
     max(ikey) FILTER (rank = 2) AS rkey, max(oracle_id) FILTER (rank = 1) AS oracle_id, count(*) AS n_candidates FROM {lines}_top GROUP BY ALL),
  {lines}_read AS (SELECT *, {score('b')} AS score, coalesce({squash('bkey')} = {squash('rkey')}, false) AS ambiguous, CASE WHEN b >= 90 - 1e-6 AND b - r >= 5 - 1e-6 AND (length(key) > 6 OR b >= 95 - 1e-6)
     AND NOT (NOT regexp_matches(raw, '\\p{{Ll}}') AND (length(regexp_replace(raw, '[^\\p{{L}}]+', '', 'g')) < 5 OR bkey = 'prosperity')) AND {squash('bkey')} <> coalesce({squash('rkey')}, '')
     AND length({squash('key')}) >= 3 THEN 'auto' ELSE 'review' END AS status FROM {lines}_wide)"""


_TRUST = r"""(status = 'auto' AND (score >= 95 - 1e-6 OR (regexp_matches(trim(raw), '^\p{Lu}') AND regexp_matches(raw, '\p{Ll}')
  AND (NOT regexp_matches(raw, '\p{Ll}\p{Lu}') OR replace(bkey, ' ', '') = replace(key, ' ', '')))))"""
_REREAD = f"""two AS (SELECT f.slot, {_TRUST} AS trusted, f, a FROM fast_read f JOIN accurate_read a USING (slot)),
  picked AS (SELECT slot, trusted, f.status AS fs, a.status AS s2, CASE WHEN trusted THEN f WHEN a.status = 'auto' OR a.score > f.score OR (a.score = f.score AND a.confidence > f.confidence) THEN a ELSE f END AS p FROM two),
  reread AS (SELECT slot, p.raw AS raw, CASE WHEN trusted THEN fs WHEN s2 = 'auto' THEN 'auto' WHEN fs = 'auto' THEN 'review' ELSE p.status END AS status, p.oracle_id AS oracle_id, p.score AS score, p.confidence AS confidence FROM picked)"""
_TRUST_QUALIFIED = _TRUST.replace("status", "f.status").replace("score", "f.score").replace("raw", "f.raw").replace("bkey", "f.bkey").replace("(key", "(f.key")
_REREAD = _REREAD.replace(_TRUST, _TRUST_QUALIFIED)

ORACLES = {
    "text_normalize": f"SELECT doc_id, length(k)::INT AS key_chars, md5(k) AS key_md5 FROM (SELECT doc_id, {_KEY.format(x='text')} AS k FROM documents)",
    "text_clean": f"SELECT doc_id, length(c)::INT AS chars, md5(c) AS clean_md5 FROM (SELECT doc_id, {_CLEAN.format(x='text')} AS c FROM documents)",
    "text_has_letter": r"SELECT doc_id, regexp_matches(text, '\p{L}') AS has_letter FROM documents",
    "text_mana_token": r"""WITH l AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' 6UU' WHEN 1 THEN ' U' WHEN 2 THEN ' WR  ' WHEN 3 THEN ' ' || p_size ELSE ' {' || (p_size % 10) || '}' END AS line FROM part),
      m AS (SELECT p_partkey, regexp_extract(rtrim(line), '^(.*\S)\s+([0-9XWUBRGC{}]{2,})$', 1) AS head, regexp_extract(rtrim(line), '^(.*\S)\s+([0-9XWUBRGC{}]{2,})$', 2) AS token FROM l)
      SELECT p_partkey, CASE WHEN token <> '' AND (regexp_matches(token, '[0-9]') OR regexp_matches(token, '^[A-Z]+$')) AND trim(head) <> '' THEN head END AS head FROM m""",
    "text_name_shape": r"""SELECT conv_id, turn, regexp_matches(trim(text), '^\p{Lu}') AND regexp_matches(text, '\p{Ll}') AND NOT regexp_matches(text, '\p{Ll}\p{Lu}') AS name_shape,
      regexp_matches(trim(text), '^\p{Lu}') AND regexp_matches(text, '\p{Ll}') AS title_start FROM conversations""",
    "text_decoy": r"""WITH l AS (SELECT p_partkey, unnest([upper(p_brand), upper(p_name), p_type]) AS line FROM part),
      n AS (SELECT *, length(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS letters FROM l)
      SELECT p_partkey, line, letters > 0 AND NOT regexp_matches(line, '\p{Ll}') AND (letters < 5 OR p_partkey % 2 = 0) AS decoy,
        length(replace(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ', '')) < 3 AS short FROM n""",
    "indel_ratio_pairs": f"""WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT x.p_name AS a, y.p_name AS b, {lcs_sql('x.p_name', 'y.p_name')} AS lcs FROM n x, n y)
      SELECT a, b, lcs, (length(a) + length(b) - 2 * lcs)::BIGINT AS indel, {published_sql('2.0::DOUBLE * lcs / (length(a) + length(b)) * 100.0::DOUBLE')} AS score FROM p""",
    "match_top3": f"WITH {_SCORED} SELECT raw, rank, oracle_id, key, {published_sql('ratio')} AS score FROM top",
    "match_best_per_entity": f"WITH {_SCORED} SELECT query, oracle_id, key, entry_idx, {published_sql('ratio')} AS score FROM best",
    "match_bulk": f"""WITH long AS (SELECT lower(p_type || ' ' || replace(p_brand, '#', ' ') || ' ' || p_name) AS key, p_name AS oracle_id, min(p_partkey) AS entry_idx FROM part GROUP BY ALL),
      kinds AS (SELECT DISTINCT lower(p_type || ' ' || replace(p_brand, '#', ' ')) AS kind FROM part), q AS (SELECT substr(kind, 1, 2) || substr(kind, 4) AS query FROM kinds),
      pairs AS (SELECT query, key, oracle_id, entry_idx, {lcs_sql('query', 'key')} AS lcs FROM q, long), scored AS (SELECT *, 2.0::DOUBLE * lcs / (length(query) + length(key)) * 100.0::DOUBLE AS ratio FROM pairs),
      best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, oracle_id ORDER BY ratio DESC, entry_idx) = 1),
      top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, oracle_id) AS rank FROM best QUALIFY rank <= 3)
      SELECT query, rank, oracle_id, key, {published_sql('ratio')} AS score FROM top""",
    "match_accept": f"""WITH {_SCORED}, w AS (SELECT raw, query AS key, max(CASE WHEN rank = 1 THEN {published_sql('ratio')} END) AS best, max(CASE WHEN rank = 2 THEN {published_sql('ratio')} END) AS runner_up,
        max(CASE WHEN rank = 1 THEN ratio END) AS b, max(CASE WHEN rank = 2 THEN ratio END) AS r, max(CASE WHEN rank = 1 THEN oracle_id END) AS oracle_id FROM top GROUP BY raw, query)
      SELECT raw, key, CASE WHEN b >= 90 - 1e-6 AND b - r >= 5 - 1e-6 AND (length(key) > 6 OR b >= 95 - 1e-6) THEN 'auto' ELSE 'review' END AS status, best, runner_up, oracle_id FROM w""",
    "space_ambiguous": f"""WITH {_NAMES}, {_SINGLE.replace('idx AS', 'one AS')},
      idx AS (SELECT * FROM one UNION ALL SELECT substr(key, 1, 3) || ' ' || substr(key, 4), 'split:' || key, entry_idx + 10000000 FROM one), {_ACCURATE}, {_read_sql('accurate')}
      SELECT slot, ambiguous, status FROM accurate_read""",
    "trust_filter": f"WITH {_NAMES}, {_SINGLE}, {_FAST}, {_read_sql('fast')} SELECT slot, raw, status, {_TRUST} AS trusted FROM fast_read",
    "slot_results": f"""WITH {_NAMES}, {_SINGLE}, {_FAST}, {_read_sql('fast')} SELECT slot, status, raw, CASE WHEN status = 'auto' THEN bkey END AS name, CASE WHEN status = 'auto' THEN oracle_id END AS oracle_id,
      CASE WHEN status = 'auto' THEN 'en' END AS lang, score, n_candidates FROM fast_read""",
    "cascade_reread": f"WITH {_NAMES}, {_SINGLE}, {_FAST}, {_ACCURATE}, {_read_sql('fast')}, {_read_sql('accurate')}, {_REREAD} SELECT slot, raw, status, oracle_id, score FROM reread",
    "fallback_best": f"""WITH {_NAMES}, {_SINGLE}, {_FAST}, {_ACCURATE}, {_VARIANTS}, {_read_sql('fast')}, {_read_sql('accurate')}, {_read_sql('variants')}, {_REREAD},
      tried AS (SELECT slot, 0 AS variant, raw, status, oracle_id, score, confidence FROM reread
        UNION ALL SELECT v.slot, v.variant, v.raw, v.status, v.oracle_id, v.score, v.confidence FROM variants_read v JOIN reread r ON v.slot = r.slot AND r.status <> 'auto')
      SELECT slot, raw, status, oracle_id, score FROM tried QUALIFY row_number() OVER (PARTITION BY slot ORDER BY score DESC, confidence DESC, variant) = 1""",
}
