import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import secret_scan as S
from loomline.llm.queries import op12_secret_scan
from loomline.tables import new_path

BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]+", 24, 0),
}
KEY = "ghp_" + "aB3" * 12
ODD = [
    (1, None), (2, ""), (3, "password=hunter2"), (4, "PassWd : 'short' Token=\"abc123def\" passſword=longenough"), (4, "password=hunter2"),
    (5, "é AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " \u212a api_key= " + "0af" * 8 + " apikey:x"), (None, "password=hunter2"), (6, "token " * 3000 + "=" + "a" * 50_000),
    (7, "secret" + " " * 50_000 + "token:::secret==secret=a/b"), (8, "-----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-ab https://me:pw@host " + KEY + " AIza" + "x" * 35),
    (9, "http://a.b/c:d@e https://x:y ghp_short xoxz-123456789012345 gha_" + "z1" * 20), (10, "f" * 23 + "g" + "0" * 24 + "\U0001f600" + "9" * 30),
]


def want(rows):
    out = []
    for doc, text in rows:
        spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, least, g)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if len(m[g]) >= least]
        n = [sum(s[1] == i for s in spans) for i in range(3)]
        out.append((doc, *n, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])) for r in df.collect())


def test_query(spark, sf, documents):
    assert got(op12_secret_scan(spark, sf)) == want([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_edges(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("blob", F.lit("clash")).withColumn("found", F.lit("clash"))
    rows = S.report(docs, new_path(spark))
    assert got(rows) == want(ODD)
    spans = {r["doc_id"]: r["spans"] for r in rows.collect()}
    assert [s.split(":")[0] for s in spans[8].split(",")] == ["private_key", "slack", "login", "github", "google"]
    assert spans[9] == "" and spans[1] == ""
    assert got(S.report(odd_docs, new_path(spark))) == want([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert S.report(no_docs, new_path(spark)).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_ledger_scans_unseen_pairs_only(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    ledger = new_path(spark)
    versions = [("a", 1, "password=hunter2"), ("a", 2, "clean"), ("b", 1, "password=hunter2"), ("c", 1, None)]
    pairs = lambda: spark.read.parquet(ledger).count()
    frame = lambda rows: spark.createDataFrame(rows, "path string, at int, body string")
    out = lambda df: {(r["path"], r["at"]): [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in df.collect()}
    first = S.scan(frame(versions), ledger, "body", S.BASE)
    assert first.columns == ["path", "at", "blob", "found"]
    hit = [("assign", 0, 16)]
    assert out(first) == {("a", 1): hit, ("a", 2): [], ("b", 1): hit, ("c", 1): []}
    assert pairs() == 3 * 3  # three blobs
    S.scan(frame(versions), ledger, "body", S.BASE)
    assert pairs() == 9
    back = frame([*versions, ("a", 3, "password=hunter2"), ("d", 1, "new token: abcdef")])
    assert out(S.scan(back, ledger, "body", S.BASE))["d", 1] == [("assign", 4, 17)]
    assert pairs() == 12  # a restored version isn't read again
    longer = (S.Rule("assign", S.BASE[0].pattern, 8, 2, True, S.BASE[0].hints), *S.BASE[1:])
    assert longer[0].version != S.BASE[0].version
    assert out(S.scan(back, ledger, "body", longer)) == {("a", 1): [], ("a", 2): [], ("b", 1): [], ("c", 1): [], ("a", 3): [], ("d", 1): []}
    assert pairs() == 16  # four blobs with the new version of one rule
    assert out(S.scan(back, ledger, "body", S.BASE))["b", 1] == hit
    assert pairs() == 16
    # Rows of a job that was lost after writing, or of another at the same time, count once.
    spark.read.parquet(ledger).coalesce(1).write.mode("append").parquet(ledger)
    assert out(S.scan(back, ledger, "body", S.BASE))["b", 1] == hit


def test_hints_cover_the_patterns():
    for rule in S.RULES:
        samples = {"assign": "APIkey=123456", "access": "AKIA" + "A" * 16, "private_key": "-----BEGIN PRIVATE KEY-----", "github": KEY, "google": "AIza" + "x" * 35, "slack": "xoxp-1234567890", "login": "redis://a:b@"}
        text = samples.get(rule.kind, "x" + "0af" * 8)
        assert rule.find(text) and rule.may_match(text.encode(), text.encode().lower())
        assert not rule.may_match(b"clean prose", b"clean prose")
