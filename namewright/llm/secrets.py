"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: strings that every match must hold, as OR of
ANDs of lower-case trigrams. The index holds, for each trigram of any rule, the documents with that trigram; intersecting
the postings of a query's branch gives the rule's candidates, which the regular expression then verifies. Rules without
mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read
from namewright.session import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (Java and Python syntax alike) whose group is at least ``least`` long."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: In the order in which spans of one start are listed. The long forms of access and hex match what their `+` forms and the
#: length condition leave: a shorter run holds no long match.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,64}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
]

MOST_STRINGS = 16
#: Java's engine goes a call deeper for each repetition of a group; a repeat of one character is a loop.
MOST_GROUP_REPEATS = 256
#: Matches of a text whose spans one step of the outer scan gathers.
SPAN_BLOCK = 256


def _exact(node) -> set[str] | None:
    """The strings, lower-cased, that a parsed node stands for, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= MOST_STRINGS:
        return {chr(v).lower() for _, v in arg}
    if op == "SUBPATTERN":
        return _exact_sequence(arg[3])
    if op == "BRANCH":
        sets = [_exact_sequence(b) for b in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        own = _exact_sequence(inner)
        if own is None or int(high) > 8 or not isinstance(high, int):
            return None
        out, power = set(), {""}
        for n in range(int(high) + 1):
            if n >= low:
                out |= power
            power = {a + b for a in power for b in own}
            if len(power) > MOST_STRINGS:
                return None
        return out
    return None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _exact(node)
        if own is None:
            return None
        out = {a + b for a in out for b in own}
        if len(out) > MOST_STRINGS:
            return None
    return out


def _and(left: set[frozenset[str]] | None, right: set[frozenset[str]] | None) -> set[frozenset[str]] | None:
    """Both of two queries; a query is a set of branches (sets of trigrams), None where anything may match."""
    if left is None or right is None:
        return left if right is None else right
    both = {a | b for a in left for b in right}
    return both if len(both) <= 4 * MOST_STRINGS else left


def _of_strings(strings: set[str]) -> set[frozenset[str]] | None:
    if any(len(s) < 3 for s in strings):
        return None
    return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}


def _query(nodes) -> set[frozenset[str]] | None:
    found, run = None, {""}
    for node in nodes:
        own = _exact(node)
        if own is not None and len({a + b for a in run for b in own}) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        found, run = _and(found, _of_strings(run)), own or {""}
        op, arg = str(node[0]), node[1]
        if own is None and op == "SUBPATTERN":
            found = _and(found, _query(arg[3]))
        elif own is None and op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found = _and(found, _query(arg[2]))
        elif own is None and op == "BRANCH":
            parts = [_query(b) for b in arg[1]]
            if all(p is not None for p in parts):
                found = _and(found, set().union(*parts))
    return _and(found, _of_strings(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """Branches of trigrams, one of which every text with a match holds in full; empty where there is no such query."""
    found = _query(list(regex_parser.parse(pattern))) or set()
    # A branch that holds another one adds nothing.
    return sorted(sorted(b) for b in found if not any(o < b for o in found))


def check_rule(rule: Rule) -> None:
    """Raise ValueError for a pattern whose depth of recursion would grow with the text."""

    def walk(nodes) -> None:
        for node in nodes:
            op, arg = str(node[0]), node[1]
            if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                one = len(arg[2]) == 1 and str(arg[2][0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY")
                if not one and int(arg[1]) > MOST_GROUP_REPEATS:
                    raise ValueError(f"rule {rule.kind} repeats a group without a bound of at most {MOST_GROUP_REPEATS}; repeat a class of characters")
                walk(arg[2])
            elif op == "SUBPATTERN":
                walk(arg[3])
            elif op == "BRANCH":
                for branch in arg[1]:
                    walk(branch)

    walk(regex_parser.parse(rule.pattern))


# --- DataFrame operators ----------------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(gram, doc_id): the postings of every trigram that a rule asks for. Trigrams are of the lower-cased text."""
    grams = sorted({g for r in rules for b in trigram_query(r.pattern) for g in b})
    if not grams:
        return docs.select(F.lit("").alias("gram"), "doc_id").where("false")
    lowered = docs.select("doc_id", F.lower("text").alias("low")).where("low IS NOT NULL")
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return lowered.select(F.explode(held).alias("gram"), "doc_id").distinct()


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): the kinds of rules for which a document holds all trigrams of a branch."""
    spark = index.sparkSession
    branches = [(g, r.kind, i, len(b)) for r in rules for i, b in enumerate(trigram_query(r.pattern)) for g in b]
    if not branches:
        return index.groupBy("doc_id").agg(F.collect_set("gram").alias("rules"))
    # The query's size depends on the rules alone, so it may be broadcast.
    asked = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("gram", "kind", "branch", "need"), strict=True))) for b in branches))))
    met = index.join(F.broadcast(asked), "gram").groupBy("doc_id", "kind", "branch", "need").agg(F.count("*").alias("n"))
    return met.where("n = need").groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind's place, end) of the rule's matches in code points, leftmost first and non-overlapping.

    Splitting at the same pattern gives the texts between the matches, whose lengths place them. The running sum goes over
    blocks of matches, since adding to an array copies it.
    """
    kind = "array<struct<start:long,place:int,end:long>>"
    empty = F.array().cast(kind)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g)).alias("gap"),
        F.transform(found, lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m)).alias("own"),
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), end.alias("end"))
        spans = F.when(part["own"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"), state["done"].alias("done"))

    def block(state: Column, first: Column) -> Column:
        start = F.struct(state["at"].alias("at"), empty.alias("spans"), state["done"].alias("done"))
        join = lambda s: F.struct(s["at"].alias("at"), F.concat(s["done"], F.array(s["spans"])).alias("done"))
        return F.aggregate(F.slice(parts, first, SPAN_BLOCK), start, step, join)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("done"))
    firsts = F.sequence(F.lit(1), F.size(parts), F.lit(SPAN_BLOCK))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(firsts, start, block, lambda s: s["done"]))).otherwise(empty)


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, spans): every rule's spans in each whole text, by start and then rule.

    Defined cases: null texts count as empty; whole texts are scanned whatever their length, and a rule that would recurse by it
    is refused with ValueError; repeated rows stay repeated; rows that share a doc_id, or have none, share
    their candidates, which only means more verification; an empty table gives no rows; other columns are ignored.
    """
    rules = rules or RULES
    for rule in rules:
        check_rule(rule)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    index = cut(trigram_index(docs, indexed), "postings")
    found = candidates(index, indexed).withColumnRenamed("doc_id", "found_id")
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    lists = []
    for i, r in enumerate(rules):
        spans = spans_of(F.col("text"), r, i)
        if r in indexed:
            spans = F.when(F.array_contains("rules", r.kind), spans).otherwise(F.array().cast("array<struct<start:long,place:int,end:long>>"))
        lists.append(spans)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    named = F.transform(F.array_sort(F.concat(*lists)), lambda s: F.struct(F.get(kinds, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", named.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    names = [r.kind for r in RULES if r.base]
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in names]
    base = F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
