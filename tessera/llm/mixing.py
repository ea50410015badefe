"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a hashed order and their words counted through, as often as the target asks; the
stream is cut into blocks of equal numbers of words.  Slots of the mix draw their sources by the van der Corput
sequence mapped through the cumulative targets, so that every stretch of the mix has nearly the targets' proportions;
the slots of a source are ranked, and its block r takes the slot of rank r.  A source stops with the word that reaches its
target, rounded; hence its share is exact.

Slots are not listed: a source's interval is a union of dyadic ones, the slots of a dyadic interval are an arithmetic
progression, and the slot of rank r is found by counting those below a number.  So a slot follows from the source's
interval and the block alone, whatever the smallest source, and slots that would belong to used-up sources stay empty.

Cases: null texts have size 0 and are taken 0 times; a null source is a source of its own, last; sources without words
have target 0; an empty table gives an empty mix; repeated rows are separate documents; other columns are kept in a
struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import n_words
from tessera.llm.ordering import parts_of, positions
from tessera.session import materialize

BITS = 48


@dataclass(frozen=True)
class Params:
    """weights repeat over the sources in code point order; budget and cap are multiples of the sizes; block is in words."""

    weights: tuple[int, ...] = (5, 2, 1)
    budget: float = 1.5
    cap: int = 2
    block: int = 2_048
    seed: int = 1


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """source, size -> source, sid (from 1), source_size, rows, target, words (the target rounded), lo, hi (the share of
    the mix from lo to hi, in units of 2 ** -BITS).

    The level that, times weight, fills the budget once capped sources have left is the largest one met when sources
    leave in the order of their cap per weight.  One row a source is ordered here, not the documents.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("rows"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), ((F.col("sid") - 1) % len(p.weights) + 1).cast("int")))
    limit = (p.cap * F.col("source_size")).cast("double")
    by_cap = Window.orderBy(limit / F.col("weight"), "sid")
    total = Window.partitionBy()
    left = p.budget * F.sum("source_size").over(total) - F.coalesce(F.sum(limit).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", left / open_weight)
    per = per.withColumn("target", F.least(limit, F.col("weight") * F.max("level").over(total)))
    per = per.withColumn("words", F.least(F.round("target").cast("long"), p.cap * F.col("source_size"))).drop("level", "weight")
    upto = F.coalesce(F.sum("words").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    edge = lambda words: F.when(F.sum("words").over(total) > 0, F.floor(words / F.sum("words").over(total) * 2.0**BITS)).otherwise(0).cast("long")
    return per.withColumns({"lo": edge(upto - F.col("words")), "hi": edge(upto)})


def progressions(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """First members and periods of the arithmetic progressions that hold the slots whose point lies from lo to hi."""
    first, period = [], []
    while lo < hi:
        size = lo & -lo or 1 << BITS
        while size > hi - lo:
            size //= 2
        bits = BITS + 1 - size.bit_length()
        first.append(int(format(lo // size, f"0{bits}b")[::-1], 2) if bits else 0)
        period.append(1 << bits)
        lo += size
    return np.array(first, np.int64), np.array(period, np.int64)


def slots(lo: int, hi: int, ranks: np.ndarray) -> np.ndarray:
    """The slots of these ranks (from 0) among those whose van der Corput point lies from lo to hi."""
    if hi <= lo:  # a share too small to have points comes after all others
        return ranks + (1 << BITS)
    first, period = progressions(lo, hi)
    share = (hi - lo) / 2**BITS
    # The points in an interval stray from its share by less than one for each progression.
    low = np.maximum(0, np.floor((ranks - len(first)) / share).astype(np.int64) - 1)
    high = np.ceil((ranks + 1 + len(first)) / share).astype(np.int64) + 1
    while (low < high).any():
        mid = (low + high) // 2
        below = np.maximum(0, (mid[:, None] - first[None, :] + period) // period).sum(axis=1)  # of slots up to mid
        low, high = np.where(below > ranks, low, mid + 1), np.where(below > ranks, mid, high)
    return low


def _piece(a: Column, start: Column, b: Column, turn: int, block: int):
    """What a block, by number, takes of the words from a to b of the source's stream; the document starts at `start`."""

    def of(k: Column) -> Column:
        at = F.greatest(a, k * block)
        n = F.least(b, (k + 1) * block) - at
        fields = {"slot": k, "place": at - k * block, "turn": F.lit(turn), "first": at - start, "n": n}
        return F.struct(*[c.cast("int" if name == "turn" else "long").alias(name) for name, c in fields.items()])

    return of


PIECES = "array<struct<slot:bigint,place:bigint,turn:int,first:bigint,n:bigint>>"


def _with_slots(rows: DataFrame) -> DataFrame:
    """Replaces the block's number in each piece by its slot; rows have lo, hi and pieces."""
    names = [f.name for f in rows.schema.fields if f.name not in ("lo", "hi", "pieces")]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            pieces = b["pieces"]
            flat, ends = pieces.flatten(), pieces.offsets.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            lo, hi = (b[c].to_numpy()[row] for c in ("lo", "hi"))
            block = flat.field("slot").to_numpy()
            slot = np.empty_like(block)
            for edge in np.unique(lo[hi > lo]) if len(lo) else []:
                at = np.flatnonzero((lo == edge) & (hi > lo))
                ranks, back = np.unique(block[at], return_inverse=True)
                slot[at] = slots(int(edge), int(hi[at[0]]), ranks)[back]
            slot[hi <= lo] = block[hi <= lo] + (1 << BITS)
            kinds = [flat.type.field(k) for k in range(flat.type.num_fields)]
            filled = pa.StructArray.from_arrays([pa.array(slot) if f.name == "slot" else flat.field(f.name) for f in kinds], fields=kinds)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), filled)], names=[*names, "pieces"])

    schema = T.StructType([f for f in rows.schema.fields if f.name in names] + [f for f in rows.schema.fields if f.name == "pieces"])
    return rows.mapInArrow(run, schema)


def mix(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: row (its other columns as a struct), size, source_size, target, taken, and pieces: for each
    block of the mix that takes words of it, slot (where in the mix), place (word within the block), turn (0 the first
    time through the source), first (word of the document) and n (words)."""
    others = [c for c in docs.columns if c != text] or [doc_id]
    named = docs.select(F.struct(*others).alias("row"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.lit(p.seed), F.col(doc_id)).alias("h"), F.xxhash64(F.lit(p.seed + 1), F.col(text)).alias("tie"))
    named = materialize(named, "sizes")
    per = materialize(targets(named, p), "targets")
    rows = named.join(per, named["source"].eqNullSafe(per["source"])).select("row", "size", "h", "tie", "sid", "rows", "source_size", "target", "words", "lo", "hi")
    rows = positions(rows, ["sid"], parts_of(F.col("rows")), "h", ["tie"], F.col("size"), "start")
    parts = []
    for turn in range(p.cap):
        a = F.col("start") + turn * F.col("source_size")
        b = F.least(a + F.col("size"), F.col("words"))
        blocks = F.sequence(F.floor(a / p.block), F.floor((b - 1) / p.block))
        parts.append(F.when(b > a, F.transform(blocks, _piece(a, a, b, turn, p.block))).otherwise(F.array().cast(PIECES)))
    out = _with_slots(rows.select("row", "size", "source_size", "target", "lo", "hi", F.concat(*parts).cast(PIECES).alias("pieces")))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return out.select("row", "size", "source_size", "target", taken.alias("taken"), "pieces")
