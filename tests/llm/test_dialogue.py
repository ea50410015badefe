"""Repairs against a search over all edit sequences, the tables against DuckDB, shared conversations against whole ones."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from tessera.llm import dialogue, registry

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(tokens, most_inserts=3):
    """Least (cost, audit) over all sequences of edits, by trying them."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(tokens) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if not re.match(r"(s?(ua)*u?)$", roles):
            return
        if inserts < most_inserts:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserts + 1)
        if i < len(tokens):
            t = tokens[i]
            go(i + 1, roles, cost + 3 * t.copies, audit + "D" * t.copies, inserts)
            if not t.must_go:
                go(i + 1, roles + (t.initial or "-"), cost + t.truncated, audit + "K", inserts)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + t.truncated, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return best


def test_parser_against_all_edits():
    parser = dialogue.Earley()
    for n in range(4):
        for kinds in product(["u", "a", "s", "x", "", "u-", "a~"], repeat=n):
            tokens = [dialogue.Token(k[:1], must_go="-" in k, truncated="~" in k, copies=2 if "-" in k else 1) for k in kinds]
            assert parser.parse(tokens)["repaired"] == brute(tokens), kinds
    rng = random.Random(2)
    for _ in range(60):
        tokens = [dialogue.Token(rng.choice("uuaasx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(4, 6))]
        assert parser.parse(tokens)["repaired"] == brute(tokens), tokens


def test_spans_join_to_the_whole_and_long_conversations_stay_linear():
    rng = random.Random(3)
    for n in (7, 900, 4000):
        tokens = [dialogue.Token(rng.choice("uasx"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(n)]
        whole = dialogue.Earley().parse(tokens)
        best, at = {"nothing": (0, "")}, 0
        while at < n:
            to = at + rng.randint(1, n // 3)
            ways = [(y, (c + cost, a + audit)) for x, (c, a) in best.items() for y, (cost, audit) in dialogue.Earley(start=x).parse(tokens[at:to]).items() if y != "repaired"]
            best = {y: min(w for z, w in ways if z == y) for y, _ in ways}
            at = to
        assert best == {k: v for k, v in whole.items() if k != "repaired"}
        assert whole["repaired"] == min(best["nothing"], best["assistant"])


def slow(rows):
    """The contract, row by row: rows are (conv_id, turn, role, text)."""
    out, by = [], {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        by[c] += [] if kind == 0 else [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, tokens, kept, counts = set(), [], [], [0, 0, 0, 0]
        for i, (_, r, x) in enumerate(turns):
            blank, again = not WORD.search(x), (r, x) in seen
            cut = not blank and not again and "".join(WORD.findall(x))[-1] not in ".!?"
            seen.add((r, x))
            tokens.append(dialogue.Token(r[:1], blank or again, cut))
            kept.append((1, r, x))
            for j, f in enumerate((blank, again and not blank, cut, i > 0 and turns[i - 1][1][:1] + r[:1] not in ("su", "ua", "au"))):
                counts[j] += f
        cost, audit = dialogue.Earley().parse(tokens)["repaired"]
        text = "\n".join(f"{e['role']}:{e['text']}" for e in dialogue.edited(kept, audit, "nothing") if e["edit"] != "D")
        days = {t for t, _, _ in turns if t is not None}
        out.append((c, max(days) - min(days) + 1 - len(days) if days else 0, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, edge string")
    return sorted((tuple(r) for r in dialogue.report(dialogue.digests(dialogue.repair(dialogue.damaged(df), dialogue.F.col("copies")))).collect()), key=repr)


def odd(n, conv, seed):
    rng = random.Random(seed)
    texts = ["A b.", "Why?", " \t ", "", None, "open end", "x.", "same!", "é. \n", "tail\x0b", "y" * 5000]
    return [(conv(rng), rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "other", "unknown", "a:b"]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.", 1, "e") for _ in range(n)]


@pytest.fixture
def many_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_odd_rows_and_a_conversation_that_tasks_share(spark, many_tasks):
    rows = odd(300, lambda r: r.choice([None, -1, *range(60)]), 1)
    rows += rows[:20]
    assert run(spark, rows) == slow([r[:4] for r in rows])
    # One conversation holds most rows: several tasks have a part of it, and equal rows stay together.
    rows = odd(1500, lambda r: 5, 2) + odd(200, lambda r: r.randrange(40), 3) + [(5, 7, "user", "same again", 0, "")] * 400
    got = dialogue.repair(dialogue.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, edge string")), dialogue.F.col("copies"))
    assert got.filter("conv_id = 5").count() > 1
    assert run(spark, rows) == slow([r[:4] for r in rows])
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None, 0, "")]) == slow([(1, None, None, None)])


def test_repairs_are_whole(spark):
    """The turns that stay read as the grammar wants, and the audit tells of each."""
    got = dialogue.repair(dialogue.damaged(spark.read.parquet(f"{SF}/conversations.parquet")), dialogue.F.col("copies")).collect()
    for r in got:
        if r["parts"] == 1:
            assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in r["repaired"] if x["edit"] != "D"))
            assert "".join(x["edit"] * x["copies"] for x in r["repaired"]) == r["audit"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '/root/testdata/sf{sf}/conversations.parquet'")
    want = con.execute(dialogue.oracle()).fetchall()
    got = registry.op12_conversation_repair(spark, f"/root/testdata/sf{sf}")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 0
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").collect()]
    assert sorted(want) == sorted(slow(rows))
