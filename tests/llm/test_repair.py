"""Repair of conversations against a plain search over (cost, audit), whole and split over many parts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, extra int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """The report's columns of one conversation: rows are (turn, role, text), damaged already."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], numpy.int64(numpy.uint64(xxhash.xxh64_intdigest(r[2], 42)))))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(SPACE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, q, found):
        if q not in table or found[:2] < table[q][:2]:
            table[q] = found

    def inserted(table):
        for _ in range(4):
            for q, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in step:
                        better(table, step[q, role[0]], (cost + 5, audit + "I", (*out, f"{role}:")))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q, (cost, audit, out) in best.items():
            better(after, q, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            worse = 5 * (fault == "truncated")
            if (q, role[:1]) in step:
                better(after, step[q, role[:1]], (cost + worse, audit + "K", (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (q, new[0]) in step:
                    better(after, step[q, new[0]], (cost + worse + 1, audit + "R", (*out, f"{new}:{text}")))
        best = inserted(after)
    cost, audit, out = min(best[q] for q in ("", "a") if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def hurt(conv, turn, role, text):
    name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    kind = zlib.crc32(name.encode()) % 20
    role, text = (" " if x is None else x for x in (role, text))
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    row = (turn, "user" if kind == 4 else role, text)
    return [] if kind == 0 else [row] * (2 if kind == 3 else 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Hi.", "yes", "no!", " ", "", None, "a\n", "long " * 30 + "end?", "é.", "Hi.", "ok. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "urban"]
    out = []
    for c in [*range(60), None]:
        for t in range(rng.choice([1, 2, 4, 7])):
            turn = None if rng.random() < 0.1 else rng.choice([t, t, t * 2])
            out.append((c, turn, roles[t % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts), 1))
    for t in range(400):  # a conversation of half of all rows
        out.append((30, t, rng.choice(roles[:5]), rng.choice(texts) if rng.random() < 0.3 else f"{t}.", 2))
    out += [(c, 0, "user", "lost.", 1) for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return out + out[:5]


def groups(rows, damage):
    out = {}
    for c, turn, role, text, _ in rows:
        out.setdefault(c, []).extend(hurt(c, turn, role, text) if damage else [(turn, " " if role is None else role, " " if text is None else text)])
    return out


@pytest.mark.parametrize("part_bytes", [1 << 25, 120])
def test_repair(spark, rows, part_bytes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, part_bytes).collect()}
    want = groups(rows, False)
    assert got.keys() == want.keys()
    for c, held in want.items():
        assert got[c] == plain(held)[0], c


def test_rows_of_the_repair(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sorted(repair.repaired_rows(df, 200).collect(), key=lambda r: (r["part"], r["at"])):
        out.setdefault(r["conv_id"], [[], []])
        out[r["conv_id"]][0].append(r["edit"])
        if r["edit"] != "D":
            out[r["conv_id"]][1].append(f"{r['role']}:{r['text']}")
    for c, held in groups(rows, False).items():
        report, repaired = plain(held)
        assert "".join(out[c][0]) == report[6] and out[c][1] == list(repaired)


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op13_repair(spark, str(tmp_path)).collect()}
    want = groups(rows, True)
    assert got.keys() == want.keys()
    for c, held in want.items():
        assert got[c] == (plain(held)[0] if held else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), c
    assert any(not held for held in want.values())


def test_query_on_the_tables(spark):
    d = "/root/testdata/sf0.001"
    want = groups([(*r, 0) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], True)
    for r in repair.op13_repair(spark, d).collect():
        assert tuple(r)[1:] == (plain(want[r["conv_id"]])[0] if want[r["conv_id"]] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0 and repair.repaired_rows(empty).count() == 0


def test_few_states_are_enough():
    """Vectors are normalised, so conversations of any length meet few of them."""
    automaton, rng = repair.Automaton(), random.Random(1)
    for _ in range(50):
        automaton.scan([rng.randrange(9) for _ in range(500)], automaton.final)
    assert len(automaton.vectors) < 200
    symbols = [rng.randrange(9) for _ in range(90)]
    whole = automaton.scan(symbols, automaton.final)
    now = automaton.final
    for a in (60, 30, 0):
        now = repair.apply_matrix(automaton.matrix(symbols[a : a + 30]), now)
    assert now[0] == whole[1] + automaton.vectors[whole[0][-1]][0]


def test_damage_keeps_rows_in_spark(spark):
    df = spark.createDataFrame([(1, None, None, "a.b!", 0)], SCHEMA)
    want = hurt(1, None, None, "a.b!")
    assert [tuple(r)[1:] for r in repair.damaged(df).collect()] == want
    assert repair.damaged(df.withColumn("kind", F.lit(1))).columns == ["conv_id", "turn", "role", "text"]
