from __future__ import annotations

import hashlib
import random
import re

import pytest

from namewright.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
MORE = [(r.kind, re.compile(r.pattern)) for r in secrets.RULES if not r.base]


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    more = [(m.start(), 3 + i, k, m.end()) for i, (k, p) in enumerate(MORE) for m in p.finditer(text)]
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    kinds = [s[2] for s in base]
    return (*(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more))


def check(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rules string, spans int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.op3_secrets(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == [["aki", "kia"]]
    branches = secrets.trigram_query(secrets.RULES[0].pattern)
    assert ["ken", "oke", "tok"] in branches and ["api", "ike", "key", "pik"] in branches and len(branches) == 6
    assert secrets.trigram_query("ab|abcd") == [] and secrets.trigram_query("x(foo|bars)+y*z") == [["ars", "bar"], ["foo"]]


def test_the_tables(spark, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, tmp_path, rows)


def test_edges_of_the_input(spark, tmp_path):
    rng = random.Random(4)
    bits = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", ".", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "a" * 36, "ſecret"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "token=abcdef"), (None, "nothing"), (1002, "token=token:abcdefg"), (1002, "token=secret=abcdef"), (1003, "pre " * 50_000 + "😀password = 'hunter2hunter2'"), (1003, "f" * 100_000)]
    check(spark, tmp_path, rows)


def test_long_texts_that_tempt_every_rule(spark, tmp_path):
    long = ["-----BEGIN " + "AB " * 20_000 + "PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----" + " " * 1_000_000, "token" + " " * 500_000 + "=" + " " * 500_000 + "abcdefgh", "password=" + "a/" * 500_000, "AKIA" + "A1" * 500_000, "0f" * 500_000, "ghp_" + "a" * 1_000_000, "-----BEGIN " * 90_000, "token=abcdef " * 3_000]
    check(spark, tmp_path, list(enumerate(long)))


def test_rules_that_would_recurse_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for pattern in ("a(?:bc)*d", "(x|y)+", "(?:[a-z]+ )+key"):
        with pytest.raises(ValueError):
            secrets.scan_secrets(docs, [secrets.Rule("own", pattern)])
    assert secrets.scan_secrets(docs, [secrets.Rule("own", "(?:ab){1,9}[a-z]*")]).count() == 1


def test_plans_hold_no_python(spark, sf_dir):
    plan = secrets.op3_secrets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
