import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import chat_repair as C
from loomline.llm.queries import op13_chat_repair
from loomline.operators import segments

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [(conv, *row)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, repaired) by dynamic programming over prefixes; rows are (role, text, fault)."""

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, made) in list(table.items()):
                nxt = "A" if state == "U" else "U"
                better(table, nxt, (cost + 5, audit + "I", [*made, ("user" if nxt == "U" else "assistant", "")]))
        return table

    table = inserted({"0": (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, made) in table.items():
            better(new, state, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            add = 5 if fault == "truncated" else 0
            nxt, name = ("A", "assistant") if state == "U" else ("U", "user")
            better(new, nxt, (cost + 1 + add, audit + "R", [*made, (name, text)]))
            if role[:1] == name[0]:
                better(new, nxt, (cost + add, audit + "K", [*made, (role, text)]))
            if state == "0" and role[:1] == "s":
                better(new, "S", (cost + add, audit + "K", [*made, (role, text)]))
        table = inserted(new)
    return min((v for s, v in table.items() if s in "0A"), key=lambda v: v[:2])


def want(turns):
    convs = {}
    for conv, *row in damaged(turns):
        convs.setdefault(conv, []).append(tuple(row))
    out = []
    for conv in {t[0] for t in turns}:
        rows = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, made = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        at = [r[0] for r in rows if r[0] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def drawn(seed, convs, most):
    draw = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(draw.randrange(1, most)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["yes.", "no!", "why?", "cut off", " \t", "", None, f"number {turn}.", "é… ", "done. \n"])
            out.append((conv if conv else None, draw.choice([turn, turn, turn * 2, None]), role, text))
    return out


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    df = op13_chat_repair(spark, sf)
    assert df.columns == COLUMNS
    assert got(df) == want([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows])


@pytest.mark.parametrize("block,least", [(4096, 1 << 16), (3, 20)])
def test_odd_conversations(spark, monkeypatch, block, least):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(segments, "LEAST", least)
    turns = drawn(block, 60, 30)
    df = spark.createDataFrame(turns, TURNS)
    for c in ("place", "edit", "key", "at", "audit", "tag"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(C.repair_damaged(df)) == want(turns)
    assert C.repair_damaged(df.where("conv_id < 0")).count() == 0


def test_hot_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(segments, "LEAST", 300)
    draw = random.Random(1)
    turns = [(1, i, draw.choice(["user", "assistant"]), draw.choice([f"t{i}.", "again.", "cut"])) for i in range(1500)] + [(2, i, "ua"[i % 2] + "x", "ok.") for i in range(9)]
    assert got(C.repair_damaged(spark.createDataFrame(turns, TURNS))) == want(turns)


def test_repaired_rows_obey_the_grammar(spark):
    _, rows = C.repair(spark.createDataFrame(drawn(5, 40, 20), TURNS))
    convs = {}
    for r in rows.collect():
        convs.setdefault(r["conv_id"], []).append((r["place"], r["role"][:1]))
    for own in convs.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(i for _, i in sorted(own)))


def test_parse_in_parts():
    draw = random.Random(9)
    for _ in range(300):
        rows = [C.Row(draw.choice("suat"), draw.random() < 0.2, 5 * (draw.random() < 0.3)) for _ in range(draw.randrange(0, 14))]
        whole = C.parse(rows)
        faults = ["blank" if r.faulty else "truncated" if r.extra else None for r in rows]
        least = min(whole[e] for e in C.ACCEPTED if e in whole)
        assert least == cheapest([(r.initial, "", f) for r, f in zip(rows, faults)])[:2]
        cut = sorted(draw.randrange(0, len(rows) + 1) for _ in range(2))
        parts = [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]
        moves = [[(e, to, *v) for e in (C.OPEN if i else ["nothing"]) for to, v in C.parse(p, e).items()] for i, p in enumerate(parts)]
        assert C.put_together(moves) == least
