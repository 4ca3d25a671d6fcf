import hashlib
import itertools
import random
import re
import zlib

import pytest

from tracewell.llm import conversation_repair as R

from test_filters import by_duckdb, same_rows

SCHEMA = "conv_id long, turn long, role string, text string, key string, block long, pos array<int>"
VALID = re.compile(r"(s?(ua)+)?")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def in_order(rows):
    key = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, key(r)))


def faults(rows):
    """(fault, initial) of each row, and the report's counts."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((fault, role[:1] or "?"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x + y not in ("su", "ua", "au") for (_, x), (_, y) in itertools.pairwise(out))
    return out, [gaps, *(sum(f == k for f, _ in out) for k in ("blank", "duplicate", "truncated")), illegal]


def every_repair(rows, flags):
    """(cost, audit, lines) of every edit of the rows with two insertions at most before, between and behind them."""
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}

    def spread(i):
        for put in inserts:
            head = [("I", 5, x, f"{names[x]}:") for x in put]
            if i == len(rows):
                yield head
                continue
            fault, initial = flags[i]
            role, text = rows[i][2:]
            choices = [("D", 2, None, None)]
            if fault not in ("blank", "duplicate"):
                wait = 5 * (fault == "truncated")
                choices += [("K", wait, initial, f"{role}:{text}"), ("R", 1 + wait, "u", f"user:{text}"), ("R", 1 + wait, "a", f"assistant:{text}")]
            for rest in spread(i + 1):
                for c in choices:
                    yield [*head, c, *rest]

    for edits in spread(0):
        if VALID.fullmatch("".join(x for *_, x, line in edits if line is not None)):
            yield sum(e[1] for e in edits), "".join(e[0] for e in edits), "\n".join(e[3] for e in edits if e[3] is not None)


def brute(table):
    for conv in {r[0] for r in table}:
        rows = in_order(damage([r[:4] for r in table if r[0] == conv]))
        flags, counts = faults(rows)
        cost, audit, text = min(every_repair(rows, flags))
        yield (conv, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame([(*r, "x", 7, [1]) for r in rows], schema).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in R.repair_report(table).collect()), key=str)


def conversations(seed, n, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "User", "tool"]
    texts = ["Yes.", "No!", "Why? ", "open", "a.\n", "", " \t", None, "say it.", "é…", "x" * 3000 + "."]
    return [(conv, rng.choice([*range(most), None]), rng.choice(roles), rng.choice(texts)) for conv in [*range(n), None] for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("block", [256, 2])
def test_repairs_equal_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = conversations(block, 60, 3)
    got = report(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert {"D", "K", "R"} <= set("".join(r[7] for r in got))


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(conv, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Go on.", "Stop!", "well"]) + f" {rng.randint(0, 30)}.") for conv in range(3) for t in range(150)]
    rows += [(0, t, "user", "again.") for t in range(200, 260)]
    whole = report(spark, rows)
    monkeypatch.setattr(R, "BLOCK", 7)
    assert report(spark, rows) == whole
    table = spark.createDataFrame([(*r, "x", 7, [1]) for r in rows], SCHEMA).toPandas()[["conv_id", "turn", "role", "text"]]
    want = by_duckdb(R.SQL, conversations=table)
    assert sorted(want[COLUMNS].itertuples(index=False, name=None), key=str) == whole


def test_repaired_turns_alternate(spark):
    rows = conversations(5, 40, 6)
    turns = R.turns_of(spark.createDataFrame([(*r, "x", 7, [1]) for r in rows], SCHEMA))
    by_conv = {}
    for r in R.Repair(R.damaged(turns)).turns().collect():
        by_conv.setdefault(r.conv_id, []).append((r.block, r.j, r.role))
    assert by_conv
    for own in by_conv.values():
        assert VALID.fullmatch("".join(role[0] for *_, role in sorted(own)))


def test_equals_sql_and_edges(spark):
    rows = conversations(9, 50, 7)
    table = spark.createDataFrame([(*r, "x", 7, [1]) for r in rows], SCHEMA)
    want = by_duckdb(R.SQL, conversations=table.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    same_rows(R.repair_report(table).toPandas().astype({"conv_id": "Int64"}), want.astype({"conv_id": "Int64"}))
    assert report(spark, rows[:0]) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert report(spark, [(None, None, None, None)]) == sorted(brute([(None, None, None, None)]))
