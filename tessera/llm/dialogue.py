"""Conversation structure repair by error-correcting Earley parsing.

A conversation should read (s?(ua)+)?: nothing, or pairs of a user's and an assistant's turn after at most one system
turn; a role counts by its initial.  The grammar of roles has, beside the productions that keep a turn, error productions
that delete it, give it another role, or insert a turn.  Every chart item retains the least (cost, audit): the audit is the
string of edits, so ties go to the ASCII-least one; the completed item of the whole conversation yields the repair.
Productions are left-recursive, so all items of a column begin at the column of the start, a column has a fixed number of
them, and parsing takes linear time.

A turn is blank (no word), else duplicate (its role and text stand earlier in the conversation), else truncated (its last
character but for white space is none of .!?), or sound.  Blank and duplicate turns must go.

Rows are dealt by ranges of (conversation, turn), so one conversation may hold a third of all rows.  A task parses what it
holds of a conversation; where a conversation goes on in another task, it parses from each of the four contexts that can
precede, and these spans are joined in order afterwards, a row a task.

Cases: null roles and texts count as one space, null turns come first; equal turns are ordered by role and text, so equal
rows are adjacent; they travel as one row with a number of copies, of which all but the first are duplicates; an empty role
has no initial and fits nowhere; null conversation ids are one conversation; other columns are ignored; a conversation
without rows (copies 0) has an empty repair; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WHITE, WORD, small_batches
from tessera.session import Scratch, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What was read so far: nothing, a system turn, a user's turn last, an assistant's turn last.
CONTEXTS = ("nothing", "system", "user", "assistant")


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


@dataclass(frozen=True)
class Token:
    """A turn for the parser; must_go: all `copies` of it are deleted."""

    initial: str
    must_go: bool = False
    truncated: bool = False
    copies: int = 1


# -- Grammar --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Production:
    """left -> right; terminals are pairs (edit, initial).  An insertion costs without reading a turn."""

    left: str
    right: tuple
    cost: int = 0
    audit: str = ""


def grammar(costs: Costs, start: str = "nothing") -> list[Production]:
    """Role grammar for a conversation of which `start` has been read."""
    out = [Production("repaired", ("nothing",)), Production("repaired", ("assistant",)), Production(start, ())]
    follows = [("system", "nothing"), *(("user", x) for x in ("nothing", "system", "assistant")), ("assistant", "user")]
    for to, before in follows:
        out.append(Production(to, (before, (KEEP, to[0]))))
        if to != "system":
            out.append(Production(to, (before, (REROLE, to[0]))))
            out.append(Production(to, (before,), costs.insert, INSERT))
    return out + [Production(x, (x, (DELETE, ""))) for x in CONTEXTS]


def edit_cost(terminal: tuple[str, str], token: Token, costs: Costs) -> int | None:
    """What it costs to read the turn by this terminal; None: not possible."""
    edit, initial = terminal
    if edit == DELETE:
        return costs.delete * token.copies
    if token.must_go or (edit == KEEP and token.initial != initial):
        return None
    return costs.truncated * token.truncated + costs.rerole * (edit == REROLE)


# -- Parser ---------------------------------------------------------------------------------------------------------


class Earley:
    """Least (cost, audit) of every nonterminal over a sequence of turns.

    An item is (production, place of the dot, column where it began).  Within a column items leave the agenda by rising
    (cost, audit); since no edit costs less than nothing, the first value of an item is its least.  Two audits of one cost
    over the same turns never are each the other's beginning (an insertion costs), so the order holds whatever follows.
    """

    def __init__(self, costs: Costs = Costs(), start: str = "nothing", symbols: tuple[str, ...] = CONTEXTS):
        self.costs, self.symbols = costs, symbols
        self.rules = grammar(costs, start)
        self.of: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            self.of.setdefault(rule.left, []).append(i)
        self.goals = [i for s in ("repaired", *symbols) for i in self.of.get(s, [])]

    def parse(self, tokens: list[Token]) -> dict[str, tuple[int, str]]:
        """(cost, audit) by nonterminal that the whole sequence is, among `symbols` and "repaired"."""
        waiting: dict[int, dict[str, list]] = {}
        done, items = self.column(0, [(0, "", (i, 0, 0)) for i in self.goals], waiting)
        settled: list[str] = []
        for j, token in enumerate(tokens, 1):
            seeds = []
            for item, (cost, audit) in items.items():
                rule, dot, origin = item
                right = self.rules[rule].right
                if dot < len(right) and not isinstance(right[dot], str):
                    more = edit_cost(right[dot], token, self.costs)
                    if more is not None:
                        seeds.append((cost + more, audit + right[dot][0] * token.copies, (rule, dot + 1, origin)))
            done, items = self.column(j, seeds, waiting)
            for gone in set(waiting) - {origin for _, _, origin in items} - {0}:
                del waiting[gone]
            done, items = self.settle(done, items, settled)
        head = "".join(settled)
        return {s: (cost, head + audit) for (s, origin), (cost, audit) in done.items() if origin == 0 and (s in self.symbols or s == "repaired")}

    def column(self, j: int, seeds: list, waiting: dict) -> tuple[dict, dict]:
        """Completes and predicts: values of completed (nonterminal, origin) and of all items of column j."""
        order, agenda, items, done = count(), [], {}, {}
        here = waiting.setdefault(j, {})

        def add(cost: int, audit: str, item: tuple) -> None:
            if item not in items:
                heapq.heappush(agenda, (cost, audit, next(order), item))

        for seed in seeds:
            add(*seed)
        while agenda:
            cost, audit, _, item = heapq.heappop(agenda)
            if item in items:
                continue
            items[item] = cost, audit
            rule, dot, origin = item
            p = self.rules[rule]
            if dot == len(p.right):
                key = p.left, origin
                if key not in done or (cost + p.cost, audit + p.audit) < done[key]:
                    done[key] = cost + p.cost, audit + p.audit
                    for (r, d, o), (c, a) in waiting.get(origin, {}).get(p.left, ()):
                        add(c + done[key][0], a + done[key][1], (r, d + 1, o))
            elif isinstance(p.right[dot], str):
                ask = p.right[dot]
                here.setdefault(ask, []).append((item, (cost, audit)))
                for r in self.of.get(ask, ()):
                    add(0, "", (r, 0, j))
                if (ask, j) in done:
                    add(cost + done[ask, j][0], audit + done[ask, j][1], (rule, dot + 1, origin))
        return done, items

    @staticmethod
    def settle(done: dict, items: dict, settled: list[str], least: int = 128) -> tuple[dict, dict]:
        """Takes off what all audits of a column begin with, so that they stay short over long conversations."""
        audits = [audit for _, audit in items.values()]
        if min(map(len, audits), default=0) < least or any(origin for _, _, origin in items):
            return done, items
        head = os.path.commonprefix(audits)
        if not head:
            return done, items
        settled.append(head)
        n = len(head)
        return {k: (c, a[n:]) for k, (c, a) in done.items()}, {k: (c, a[n:]) for k, (c, a) in items.items()}


# -- Turns ----------------------------------------------------------------------------------------------------------


def edited(turns: list[tuple], audit: str, start: str) -> list[dict]:
    """The repair that an audit stands for: edit, copies, role, text; turns are (copies, role, text)."""
    out, last, at = [], start, 0
    rest = iter(turns)
    while at < len(audit):
        edit, role, text, copies = audit[at], "", "", 1
        if edit != INSERT:
            copies, role, text = next(rest)
        if edit in (INSERT, REROLE):
            role = "assistant" if last == "user" else "user"
        if edit != DELETE:
            last = {"s": "system", "u": "user", "a": "assistant"}[role[:1]]
        out.append({"edit": edit, "copies": copies, "role": role, "text": text})
        at += copies
    return out


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Segment:
    """What one task holds of a conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.turns: list[tuple] = []
        self.tokens: list[Token] = []
        self.stats = {"n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "min_turn": None, "max_turn": None, "first": None, "last": None}

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, first: bool, truncated: bool) -> None:
        if not copies:
            return
        s, initial = self.stats, role[:1]
        if turn is not None and turn != s["max_turn"]:
            s["turns"] += 1
            s["min_turn"] = turn if s["min_turn"] is None else s["min_turn"]
            s["max_turn"] = turn
        sound = not blank and first
        s["n"] += copies
        s["blank"] += copies * blank
        s["duplicate"] += 0 if blank else copies - sound
        s["truncated"] += sound and truncated
        s["illegal"] += copies - 1 + (s["last"] is not None and not legal(s["last"], initial))
        s["first"] = initial if s["first"] is None else s["first"]
        s["last"] = initial
        if sound:
            self.turns.append((1, role, text))
            self.tokens.append(Token(initial, truncated=truncated))
        if copies > sound:
            self.turns.append((copies - sound, role, text))
            self.tokens.append(Token(initial, must_go=True, copies=copies - sound))


STATS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, min_turn long, max_turn long, first string, last string"
REPAIRED = "array<struct<edit string, copies long, role string, text string>>"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _parsed(conv_type: T.DataType, costs: Costs, cache: int = 20_000) -> tuple:
    """For sorted partitions: a row a segment; `whole` ones are repaired, others carry their spans and turns."""
    schema = T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(f"edge long, whole boolean, stats struct<{STATS}>, cost long, audit string, spans array<struct<before string, after string, cost long, audit string>>, repaired {REPAIRED}").fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        parsers = {x: Earley(costs, x) for x in CONTEXTS}
        known: dict[tuple, tuple[int, str]] = {}
        out: list[dict] = []
        held: Segment | None = None
        seen, size = 0, 0

        def whole(s: Segment) -> dict:
            key = tuple(s.tokens)
            if key not in known:
                if len(known) >= cache:
                    known.clear()
                found = parsers["nothing"].parse(s.tokens)["repaired"]
                if len(key) > 32:
                    return {"cost": found[0], "audit": found[1], "repaired": edited(s.turns, found[1], "nothing")}
                known[key] = found
            cost, audit = known[key]
            return {"cost": cost, "audit": audit, "repaired": edited(s.turns, audit, "nothing")}

        def spans(s: Segment) -> dict:
            ways = [{"before": x, "after": y, "cost": c, "audit": a} for x in CONTEXTS for y, (c, a) in parsers[x].parse(s.tokens).items() if y != "repaired"]
            return {"spans": ways, "repaired": [{"copies": n, "role": role, "text": text} for n, role, text in s.turns]}

        def finish(s: Segment, last: bool) -> None:
            edge = last or seen == 1
            row = {"conv_id": s.conv, "edge": 2 * part + last if edge else None, "whole": not edge, "stats": s.stats}
            out.append(row | (spans(s) if edge else whole(s)))

        for b in batches:
            for conv, turn, role, text, n, blank, first, truncated in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "blank", "first", "truncated")), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        finish(held, False)
                    held, seen = Segment(conv), seen + 1
                held.add(turn, role, text, n, blank, first, truncated)
                size += len(text)
                if len(out) >= 500 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if held is not None:
            finish(held, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run, schema


def _joined(costs: Costs) -> tuple:
    """For segments of conversations in order: each one's audit and the context before it; the first has the sums."""
    schema = T.StructType.fromDDL(f"edge long, part int, parts int, before string, cost long, audit string, stats struct<{STATS}>")
    arrow = _arrow(schema)

    def solve(rows: list[dict]) -> list[dict]:
        best = {"nothing": (0, "", ())}
        for r in rows:
            after: dict = {}
            for w in r["spans"]:
                if w["before"] in best:
                    cost, audit, path = best[w["before"]]
                    new = cost + w["cost"], audit + w["audit"], (*path, (w["before"], w["cost"], w["audit"]))
                    if w["after"] not in after or new[:2] < after[w["after"]][:2]:
                        after[w["after"]] = new
            best = after
        cost, audit, path = min((best[x] for x in ("nothing", "assistant") if x in best), key=lambda x: x[:2])
        total = dict(rows[0]["stats"])
        for r in rows[1:]:
            s = r["stats"]
            if total["n"] and s["n"]:
                total["illegal"] += not legal(total["last"], s["first"])
            total["turns"] += s["turns"] - (s["min_turn"] is not None and s["min_turn"] == total["max_turn"])
            for k in ("n", "blank", "duplicate", "truncated", "illegal"):
                total[k] += s[k]
            for k in ("min_turn", "first"):
                total[k] = s[k] if total[k] is None else total[k]
            for k in ("max_turn", "last"):
                total[k] = total[k] if s[k] is None else s[k]
        return [{"edge": r["edge"], "part": i, "parts": len(rows), "before": before, "audit": a, "cost": cost if not i else None, "stats": total if not i else None} for i, (r, (before, _, a)) in enumerate(zip(rows, path, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield pa.RecordBatch.from_pylist(solve(held), arrow)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist(solve(held), arrow)

    return run, schema


def judged(turns: DataFrame, copies: Column | int = 1) -> DataFrame:
    """conv_id, turn, role, text, n, blank, first, truncated: equal rows as one with their number, and its faults.

    first: no equal role and text has a smaller turn (null being the smallest).
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(copies) if isinstance(copies, int) else copies).cast("long").alias("n"))
    rows = rows.withColumn("text", F.when(F.col("n") > 0, F.col("text")).otherwise(F.lit("")))
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # Length first, so that no two pairs of role and text are written alike.
    each = each.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    again = each.filter("n > 0").groupBy("conv_id", "key").agg(F.min(place).alias("least"), F.count("*").alias("m")).filter("m > 1").select(F.col("conv_id").alias("c_"), "key", "least")
    out = each.join(again.withColumnRenamed("key", "k_"), F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("key") == F.col("k_")), "left")
    last = F.substring(F.rtrim("text", F.lit(WHITE.decode())), -1, 1)
    return out.select("conv_id", "turn", "role", "text", "n", (~F.col("text").rlike(WORD)).alias("blank"), (F.col("least").isNull() | (F.col("least") == place)).alias("first"), (~last.isin(".", "!", "?")).alias("truncated"))


def repair(turns: DataFrame, copies: Column | int = 1, costs: Costs = Costs()) -> DataFrame:
    """conv_id, part, parts, stats, cost, audit, repaired of every conversation of turns (conv_id, turn, role, text).

    repaired: edit (K, R, D, I), copies, role, text in order; deleted turns stand in it with D.  Mostly a conversation is
    one row; one that tasks shared has a row for each (part, from 0, of `parts`), the first of which has stats and cost.
    copies: how often a row stands; 0 lets the conversation appear without it.
    """
    spark = turns.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        rows = scratch.table(judged(turns, copies), "turns")
        # Only rows that agree in all of these must meet; the order below is finer, never across.
        dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
        run, schema = _parsed(rows.schema["conv_id"].dataType, costs)
        parsed = scratch.table(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema), "parsed")
        edges = parsed.filter("NOT whole")
        join, joined = _joined(costs)
        found = edges.select("conv_id", "edge", "stats", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "edge").mapInArrow(join, joined)
        split = edges.select("conv_id", "edge", "repaired").join(found, "edge")
        out = T.StructType([parsed.schema["conv_id"], *(joined[c] for c in ("part", "parts", "stats", "cost", "audit")), parsed.schema["repaired"]])
        arrow = _arrow(out)

        def apply(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                made = []
                for r in b.to_pylist():
                    r["repaired"] = edited([(x["copies"], x["role"], x["text"]) for x in r["repaired"]], r["audit"], r["before"])
                    made.append({f.name: r[f.name] for f in out})
                yield pa.RecordBatch.from_pylist(made, arrow)

        done = parsed.filter("whole").select("conv_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), "stats", "cost", "audit", "repaired")
        return materialize(done.unionByName(split.mapInArrow(apply, out)), "repaired")


def lines(repaired: Column | str = "repaired") -> Column:
    """The repaired turns as `role:text`."""
    col = F.col(repaired) if isinstance(repaired, str) else repaired
    return F.transform(F.filter(col, lambda x: x["edit"] != DELETE), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))


def digests(repairs: DataFrame) -> DataFrame:
    """conv_id, stats, cost, audit, repaired_sha256 of repair()'s rows: a row a conversation.

    A digest reads its text in order: that of a conversation of one part is an expression; parts of a shared one follow
    each other through one task, which holds a part at a time.
    """
    import hashlib

    one = repairs.filter("parts = 1").select("conv_id", "stats", "cost", "audit", F.sha2(F.array_join(lines(), "\n").cast("binary"), 256).alias("repaired_sha256"))
    schema = one.schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        row, audits, digest, begun = {}, [], hashlib.sha256(), False
        for b in batches:
            for r in b.to_pylist():
                if not r["part"]:
                    row, audits, digest, begun = {c: r[c] for c in ("conv_id", "stats", "cost")}, [], hashlib.sha256(), False
                audits.append(r["audit"])
                for line in r["lines"]:
                    digest.update(("\n" * begun + line).encode())
                    begun = True
                if r["part"] == r["parts"] - 1:
                    yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], arrow)

    many = repairs.filter("parts > 1").select("conv_id", "part", "parts", "stats", "cost", "audit", lines().alias("lines"))
    return one.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema))


def report(digest: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of digests()' rows."""
    gaps = F.coalesce(F.col("stats.max_turn") - F.col("stats.min_turn") + 1 - F.col("stats.turns"), F.lit(0).cast("long"))
    return digest.select("conv_id", gaps.alias("gaps"), *(f"stats.{c}" for c in ("blank", "duplicate", "truncated", "illegal")), "cost", "audit", "repaired_sha256")


# -- Damage of the registered query ---------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by the checksum of `conv_id:turn`, and `copies`: 0 where a row is dropped, 2 where it is
    repeated."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def oracle() -> str:
    """The registered query in DuckDB: a recursive table steps through each conversation, with the four contexts' least
    (cost, audit, output) as its state."""
    ways = {"n": [], "s": [("n", "s")], "u": [("n", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}
    name = {"u": "user", "a": "assistant"}

    def least(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def added(state: str, cost: str, edit: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + ({cost}), 'e': {state}.e || '{edit}', 't': list_concat({state}.t, {line})}} END"

    def inserted(state: dict[str, str]) -> list[tuple[str, str]]:
        """Contexts after insertions: user's after any but its own, assistant's after the user's, and user's again."""
        return [
            ("u", least([state["u"], *(added(state[x], "2", "I", "['user:']") for x in ("n", "s", "a"))])),
            ("a", least([state["a"], added("u", "2", "I", "['assistant:']")])),
        ]

    def read(to: str) -> str:
        options = [added(f"p.{to}", "3", "D", "[]::VARCHAR[]")]
        for before, i in ways[to]:
            options.append(f"CASE WHEN NOT r.go AND r.initial = '{i}' THEN {added(f'p.{before}', 'r.cut', 'K', '[r.role || chr(58) || r.text]')} END")
            if to in name:
                options.append(f"CASE WHEN NOT r.go THEN {added(f'p.{before}', '2 + r.cut', 'R', f'[{chr(39)}{name[to]}:{chr(39)} || r.text]')} END")
        return least(options)

    state = "STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])"
    (_, first_u), (_, first_a) = inserted({x: x for x in "nsua"})
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), bytes AS (
  SELECT DISTINCT name, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT) AS b FROM raw
), summed AS (
  SELECT name, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda v, c: list_reduce(list_prepend(xor(v, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind FROM bytes
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw JOIN summed USING (name)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt
), told AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed
), turns AS (
  SELECT *, blank OR again AS go, CASE WHEN open THEN 1 ELSE 0 END AS cut FROM told
), steps AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'e': '', 't': []}}::{state} AS n, NULL::{state} AS s,
    {{'c': 2, 'e': 'I', 't': ['user:']}}::{state} AS u, {{'c': 4, 'e': 'II', 't': ['user:', 'assistant:']}}::{state} AS a
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, k, n, s, u, {first_a} AS a FROM (
    SELECT conv_id, k, n, s, a, {first_u} AS u FROM (
      SELECT r.conv_id, r.k, {read('n')} AS n, {read('s')} AS s, {read('u')} AS u, {read('a')} AS a
      FROM steps p JOIN turns r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1) q) q
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT go) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k
  FROM turns GROUP BY conv_id
), best AS (
  SELECT c.*, {least(['s.n', 's.a'])} AS b FROM counts c JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.k = c.k
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.e, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""
