"""Removal of byte strings that repeat anywhere, found with a sparse suffix array sorted deep-shallow.

A string of `length` bytes that occurs twice contains, at the same offset in both places, the smallest hash among its
grams of `gram` bytes.  So only suffixes at such local minima (anchors) are sorted, and nothing is missed: anchors with
an equal gram form a group, and within a group the contexts to the right, and the reversed ones to the left, are sorted:
multikey quicksort on eight-byte symbols down to a shallow depth, then blind tries for the strings that still agree.
Common prefixes of neighbours give how far any two anchors agree on either side, and thereby every repeated string.

Anchors whose whole context occurs twice need no sorting, and equal contexts are sorted once with their count, so
groups of copies cost one context.  A group of more than `most` distinct contexts is divided before it is sorted: strings
that begin lo to hi symbols left of the gram all hold the lo symbols before it and the side - hi symbols after it, so
contexts that differ there never meet at these offsets; and what lies beyond hi symbols to the left and side - lo to the
right plays no part in them.  So for each half of the offsets contexts are cut to what matters, equal ones become one with
a count, and groups go by the bytes that strings share; halves that are still too large are divided again.  At a single
offset a group is one string.  So no task sorts more than `most` contexts at a time, and contexts are only taken as equal by their bytes (grams and whole
contexts by 128 bits of hashes).

Passages may be counted in words as well: a text is then the string of its words' hashes, a symbol of eight bytes each,
and what repeats are strings of `length` whole words, whatever white space stands between them.

Cases: null and empty texts have no bytes and lose none; texts shorter than `length` lose none; copies and repeated
rows lose all that is in both; ids may be null or repeated; extra columns keep their values whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WHITE, mix64, small_batches
from tessera.llm.neardup import node_of
from tessera.session import Scratch, materialize

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
BYTE = mix64(np.arange(1, 257).astype(U))


@dataclass(frozen=True)
class Params:
    """gram must be a power of two below length; shallow is the depth in bytes at which blind tries take over; with words,
    length and gram are words rather than bytes."""

    length: int = 400
    gram: int = 256
    shallow: int = 16
    most: int = 20_000
    words: bool = False

    @property
    def side(self) -> int:
        """Bytes (or words) of context on either side of a gram."""
        return self.length - self.gram

    @property
    def unit(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1


# -- Deep-shallow sorting -------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Compacted trie that branches on single bytes and skips the rest; strings are compared once, at a leaf."""

    def __init__(self, strings: list[bytes]):
        self.s, self.root = strings, None

    def _branch(self, i: int, at: int) -> int:
        return self.s[i][at] if at < len(self.s[i]) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._branch(i, node[0])) or next(iter(node[1].values()))
        other = node[0]
        same = common(self.s[i], self.s[other])
        if same == len(self.s[i]) == len(self.s[other]):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            above, node = node, node[1][self._branch(i, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][self._branch(i, same)] = [i]
            return
        split = (same, {self._branch(other, same): node, self._branch(i, same): [i]})
        if above is None:
            self.root = split
        else:
            above[1][self._branch(i, above[0])] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], shallow: int) -> list[int]:
    """Indexes in ascending order of the strings; equal strings keep their order."""
    out: list[int] = []
    work = [(list(range(len(strings))), 0)]
    while work:
        part, depth = work.pop()
        if len(part) < 2:
            out.extend(part)
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in part:
                trie.insert(i)
            out.extend(trie.ordered())
        else:
            key = {i: strings[i][depth : depth + 8] for i in part}
            pivot = sorted((key[part[0]], key[part[len(part) // 2]], key[part[-1]]))[1]
            less, same, more = [], [], []
            for i in part:
                (less if key[i] < pivot else more if key[i] > pivot else same).append(i)
            work.append((more, depth))
            work.append((same, depth + 8 if len(pivot) == 8 else shallow))
            work.append((less, depth))
    return out


def agreeing(strings: list[bytes], order: list[int]) -> np.ndarray:
    """Common prefix of each string, in that order, with the one before it; 0 for the first."""
    return np.array([0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)])


def repeated_offsets(lefts: list[bytes], rights: list[bytes], counts: list[int], p: Params, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Bool [i, d - lo]: whether the string that starts d symbols left of gram i, d from lo to hi (default: all), also
    starts elsewhere.  lefts are reversed; counts above 1 stand for contexts that occur several times."""
    n, side = len(lefts), p.side
    hi = side if hi is None else hi
    sides = [(order := deep_shallow(strings, p.shallow), agreeing(strings, order) // p.unit) for strings in (lefts, rights)]
    sizes = [np.array([len(x) // p.unit for x in strings]) for strings in (lefts, rights)]
    many = np.array(counts) > 1
    out = np.zeros((n, hi + 1 - lo), bool)
    some = max(24, 100_000 // n)  # fewer offsets at a time for large groups, so that they stay small in memory
    for at in range(lo, hi + 1, some):
        need = np.arange(at, min(at + some, hi + 1))
        ids = np.zeros((n, len(need)), np.int64)
        for (order, lcp), least in zip(sides, (need, side - need), strict=True):
            group = np.empty_like(ids)
            group[order] = np.cumsum(lcp[:, None] < least[None, :], axis=0)
            ids = ids * (n + 1) + group
        by = np.argsort(ids, axis=0, kind="stable")
        ordered = np.take_along_axis(ids, by, axis=0)
        twin = np.zeros_like(ids, bool)
        equal = ordered[1:] == ordered[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        found = np.zeros_like(twin)
        np.put_along_axis(found, by, twin, axis=0)
        fits = (sizes[0][:, None] >= need) & (sizes[1][:, None] >= side - need)
        out[:, need - lo] = (found | many[:, None]) & fits
    return out


# -- Anchors --------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, by doubling."""
    y, size = x, 1
    while 2 * size <= w:
        y, size = op(y[:-size], y[size:]), 2 * size
    return op(y[: len(x) - w + 1], y[w - size :]) if size < w else y


def anchors(texts: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' places in the list, positions of their anchors, hashes of the grams, hashes of the contexts; texts: their
    symbols' hashes.  Hashes are differences of the running sums over all texts, which are taken as one string; windows
    that reach over a text's end choose nothing."""
    which = np.array([i for i, b in enumerate(texts) if len(b) >= p.length], np.int64)
    if not len(which):
        return which, which, np.empty(0, U), np.empty(0, U)
    ends = np.cumsum([len(texts[i]) for i in which])
    starts = np.concatenate([[0], ends[:-1]])
    b = np.concatenate([texts[i] for i in which])
    n, w = len(b), p.side + 1
    steps = _powers(n)
    total = np.concatenate([[U(0)], np.cumsum(b * steps[0][:n])])
    h = mix64((total[p.gram :] - total[: -p.gram]) * steps[1][: n - p.gram + 1])
    low = _slide(h, w, np.minimum)
    for end in ends[:-1]:
        low[end - p.length + 1 : end] = 0
    edge = np.zeros(w - 1, U)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    of = np.searchsorted(ends, at, side="right")
    inside = at + p.gram <= ends[of]
    at, of = at[inside], of[inside]
    lo, hi = np.maximum(at - p.side, starts[of]), np.minimum(at + p.length, ends[of])
    shape = (at - lo).astype(U) * U(0x165667B19E3779F9) + (hi - at).astype(U) * U(0xC2B2AE3D27D4EB4F)
    return which[of], at - starts[of], h[at], mix64((total[hi] - total[lo]) * steps[1][lo] + shape)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 200_000)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size, U(x))])) for x in (BASE, BASE_INVERSE)]
    return _POWERS


def symbols(text: str | None, p: Params) -> np.ndarray:
    """Hashes of a text's bytes, or of its words."""
    t = (text or "").encode()
    b = BYTE[np.frombuffer(t, np.uint8)]
    if not p.words:
        return b
    first, end = word_places(t).T
    steps = _powers(len(b))
    total = np.concatenate([[U(0)], np.cumsum(b * steps[0][: len(b)])])
    return mix64((total[end] - total[first]) * steps[1][first] + (end - first).astype(U) * U(0x165667B19E3779F9))


IS_WHITE = np.isin(np.arange(256), np.frombuffer(WHITE, np.uint8))


def word_places(t: bytes) -> np.ndarray:
    """First byte and end of each word."""
    white = IS_WHITE[np.frombuffer(t, np.uint8)]
    return np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]))).reshape(-1, 2)


#: Symbols whose hashes are computed at a time: as many as stay in a core's cache.
AT_ONCE = 32_768


def _anchor_rows(docs: DataFrame, p: Params) -> DataFrame:
    """node, text, copies -> node, pos, g, c, copies."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            some, size, start, out, found = [], 0, 0, [], 0
            for i in range(b.num_rows):
                some.append(symbols(b["text"][i].as_py(), p))
                size += len(some[-1])
                end = i == b.num_rows - 1
                if size > AT_ONCE or end:
                    which, *rest = anchors(some, p)
                    out.append((which + start, *rest))
                    found += len(which)
                    some, size, start = [], 0, i + 1
                if found > 100_000 or end:
                    which, pos, g, c = map(np.concatenate, zip(*out, strict=True))
                    row = pa.array(which)
                    cols = [b["node"].take(row), pa.array(pos.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), b["copies"].take(row)]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "pos", "g", "c", "copies"])
                    out, found = [], 0

    return docs.select("node", "text", "copies").mapInArrow(run, "node binary, pos int, g long, c long, copies long")


ROW = "g long, s long, c long, left binary, right binary"


def _flat(lists: pa.ListArray, *fields: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each row's structs begin and end, and these fields of all structs; null lists are empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), [pc.struct_field(values, f) for f in fields]


def _contexts(docs: DataFrame, p: Params) -> DataFrame:
    """node, text, spots (pos, g, c) -> g, s (a second hash of the gram), c, left (reversed), right."""
    names = ["g", "s", "c", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            bounds, (spots, grams, contexts) = _flat(b["spots"], "pos", "g", "c")
            places, done, out = spots.to_pylist(), 0, ([], [], [])
            for i in range(b.num_rows):
                raw = b["text"][i].as_py()
                t = symbols(raw, p).tobytes() if p.words else (raw or "").encode()
                # Bytes backwards; words keep theirs in order, their number backwards.
                back = np.frombuffer(t, U)[::-1].tobytes() if p.words else t[::-1]
                for pos in places[bounds[i] : bounds[i + 1]]:
                    at, right, end = p.unit * pos, p.unit * (pos + p.gram), p.unit * (pos + p.length)
                    out[0].append(xxhash.xxh3_64_intdigest(t[at:right]) - 2**63)
                    out[1].append(back[len(t) - at : len(t) - at + p.unit * p.side])
                    out[2].append(t[right:end])
                if len(out[0]) > 20_000 or i == b.num_rows - 1:
                    g, c = (x.slice(done, len(out[0])) for x in (grams, contexts))
                    yield pa.RecordBatch.from_arrays([g, pa.array(out[0], pa.int64()), c, pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=names)
                    done, out = done + len(out[0]), ([], [], [])

    return docs.mapInArrow(run, ROW)


def _runs(flags: np.ndarray, p: Params, lo: int) -> list[list[int]]:
    """Runs of offsets d as ranges of symbols around the gram: [-d of the last, length - d of the first)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [[-int(b - 1 + lo), p.length - int(a + lo)] for a, b in edge.reshape(-1, 2)]


def pair_ranges(lefts: list[bytes], rights: list[bytes], p: Params, lo: int, hi: int) -> list[list[int]]:
    """The same runs for two contexts that occur once each: to order two strings is to compare them once."""
    far, near = (common(*x) // p.unit for x in (lefts, rights))
    first, last = max(lo, p.side - near), min(hi, far)
    return [[-last, p.length - first]] if first <= last else []


GROUP = ["g", "s", "lo", "hi", "shared"]


def _sorted_groups(grouped: DataFrame, p: Params) -> DataFrame:
    """GROUP, c, left, right, n, sorted by GROUP within partitions -> GROUP, c, ranges; one group at a time in memory."""
    kept = [f for f in grouped.schema.fields if f.name in (*GROUP, "c")]
    schema = T.StructType([*kept, T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType())))])
    names = [f.name for f in kept]

    def emit(key: tuple, rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1 and rows[0][3] == 1:
            return []
        lefts, rights, counts = ([r[k] for r in rows] for k in (1, 2, 3))
        if len(rows) == 2 and max(counts) == 1:
            ranges = pair_ranges(lefts, rights, p, key[2], key[3])
            return [(*key, r[0], ranges) for r in rows] if ranges else []
        found = repeated_offsets(lefts, rights, counts, p, key[2], key[3])
        return [(*key, r[0], x) for r, f in zip(rows, found, strict=True) if (x := _runs(f, p, key[2]))]

    def run(batches: Iterator[pa.RecordBatch]):
        key, rows, out, kinds = None, [], [], None

        def table() -> pa.RecordBatch:
            cols = dict(zip((*GROUP, "c", "ranges"), list(zip(*out, strict=True)) or [[]] * 7, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(cols[n], kinds[n]) for n in names), pa.array(cols["ranges"], pa.list_(pa.list_(pa.int32())))], names=[*names, "ranges"])

        for b in batches:
            kinds = {n: b.schema.field(n).type for n in names}
            for x in zip(*(b[k].to_pylist() for k in (*GROUP, "c", "left", "right", "n")), strict=True):
                if x[:5] != key:
                    if rows:
                        out += emit(key, rows)
                    key, rows = x[:5], []
                rows.append(x[5:])
            if len(out) > 20_000:
                yield table()
                out = []
        if kinds:
            out += emit(key, rows) if rows else []
            yield table()

    return grouped.mapInArrow(run, schema)


def _halves(rows: DataFrame, p: Params) -> DataFrame:
    """Contexts of groups, once for each half of the group's offsets: cut to what matters there, with the bytes that
    strings at these offsets share and a hash of the cut context."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))
    each = rows.select("g", "s", "c", "left", "right", "n", F.explode(parts).alias("x")).select("g", "s", "c", "left", "right", "n", "x.*")
    before, after = p.unit * F.col("lo"), p.unit * (p.side - F.col("hi"))
    each = each.filter((F.octet_length("left") >= before) & (F.octet_length("right") >= after))
    first = F.lit(1)
    each = each.withColumn("shared", F.concat(F.substring("left", first, before), F.substring("right", first, after)))
    left, right = F.substring("left", first, p.unit * F.col("hi")), F.substring("right", first, p.unit * (p.side - F.col("lo")))
    each = each.withColumns({"near_left": left, "near_right": right})
    return each.withColumn("k", F.unhex(F.md5(F.concat(F.octet_length("near_left").cast("string").cast("binary"), F.lit(b"|"), "near_left", "near_right"))))


def _in_small_groups(contexts: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """g, s, c, left, right, n, kinds (contexts of the gram) -> g, c, ranges, from groups of p.most contexts at most."""
    rows = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(p.side), "shared": F.lit(b"").cast("binary")})
    cols = [*GROUP, "c", "left", "right", "n"]
    spread = lambda df: df.select(*cols).repartition(*GROUP).sortWithinPartitions(*GROUP, "c")
    out = _sorted_groups(spread(rows.filter(F.col("kinds") <= p.most)), p).select("g", "c", "ranges")
    large = scratch.table(rows.filter(F.col("kinds") > p.most).select(*cols), "large")
    # A round halves the offsets of what is still too large: at most log2(side) + 1 of them.
    while large.limit(1).count():
        parts = scratch.table(_halves(large, p), "halves")
        cut = parts.groupBy(*GROUP, "k").agg(F.first("near_left").alias("left"), F.first("near_right").alias("right"), F.sum("n").alias("n"))
        cut = scratch.table(cut.withColumnRenamed("k", "c"), "cut-contexts")
        many = scratch.table(cut.groupBy(*GROUP).agg(F.count("*").alias("kinds")).filter(F.col("kinds") > p.most).select(*GROUP), "large-groups")
        found = _sorted_groups(spread(cut.join(many, GROUP, "left_anti")), p).withColumnRenamed("c", "k")
        # Ranges of cut contexts, given to the contexts they were cut from.
        key = [*GROUP, "k"]
        out = out.unionByName(parts.select("c", *key).join(scratch.table(found, "cut-ranges"), key).select("g", "c", "ranges"))
        large = scratch.table(parts.join(many, GROUP, "left_semi").select(*cols), "large")
    return out


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """node, text (empty for null), copies: one row a text; map tasks send a text once."""
    named = docs.select(node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return named.groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def repeated(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """(node, spans): ranges of bytes (or words) of each text that repeated strings cover; texts: as distinct_texts."""
    small_batches(texts.sparkSession)
    with Scratch(texts.sparkSession) as scratch:
        rows = scratch.table(_anchor_rows(texts, p), "anchors")
        # As a table of its own: joined straight to the aggregation, a hot gram's anchors could not be split.
        grams = scratch.table(rows.groupBy("g").agg(F.sum("copies").alias("n")).filter("n > 1").select("g"), "grams")
        spots = scratch.table(rows.join(grams, "g"), "spots")
        scratch.drop(rows)
        # Contexts per gram: with a single one, all its places repeat in full and nothing is left to sort.
        per = spots.groupBy("g", "c").agg(F.sum("copies").alias("n"), F.min(F.struct("node", "pos")).alias("at"))
        kinds = scratch.table(per, "contexts")
        many = scratch.table(kinds.groupBy("g").agg(F.count("*").alias("kinds")), "kinds")
        kinds = kinds.join(many, "g")
        whole = kinds.filter("kinds = 1 AND n > 1").select("g", "c", F.array(F.array(F.lit(-p.side), F.lit(p.length))).alias("ranges"))
        wanted = kinds.filter("kinds > 1").groupBy("at.node").agg(F.collect_list(F.struct("at.pos", "g", "c")).alias("spots"))
        found = scratch.table(_contexts(texts.join(wanted, "node").select("text", "spots"), p).join(kinds.select("g", "c", "n", "kinds"), ["g", "c"]), "contexts")
        all_ranges = scratch.table(whole.unionByName(_in_small_groups(found, p, scratch)), "ranges")
        part = spots.select("node", "pos", "g", "c").join(all_ranges, ["g", "c"]).select("node", F.transform("ranges", lambda r: F.struct((F.col("pos") + r[0]).alias("a"), (F.col("pos") + r[1]).alias("b"))).alias("r"))
        return materialize(part.groupBy("node").agg(F.flatten(F.collect_list("r")).alias("spans")), "spans")


def runs_of(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges in any order cover between 0 and n; they may overlap and reach over both."""
    a, b = np.maximum(a, 0), np.minimum(b, n)
    some = b > a
    a, b = a[some], b[some]
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    apart = a[1:] > b[:-1]
    edge = [True] if len(a) else []
    return a[np.concatenate([edge, apart]).astype(bool)], b[np.concatenate([apart, edge]).astype(bool)]


def byte_runs(t: bytes, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ranges of bytes, from a to b, and ranges of words, from first to last, cover."""
    if len(first):
        places = word_places(t)
        first, last = np.maximum(first, 0), np.minimum(last, len(places))
        some = last > first
        a, b = np.concatenate([a, places[first[some], 0]]), np.concatenate([b, places[last[some] - 1, 1]])
    return runs_of(a, b, len(t)) if len(a) else (a, b)


def remove(docs: DataFrame, p: Params = Params(), text: str = "text", digest: bool = False, words: Params | None = None, report: Params | None = None) -> DataFrame:
    """docs with the text's remaining bytes (cut characters are dropped), and n_bytes, n_removed, n_spans, kept_sha256
    in a struct column `cut`; with digest, the text itself is left out.  With words, repeated strings of so many words go
    as well; with report, they stay and are counted: n_passages (runs of words that such strings cover), n_passage_bytes
    (0 without report)."""
    small_batches(docs.sparkSession)
    texts = materialize(distinct_texts(docs, text), "texts")
    spans = repeated(texts, p)
    for name, more in (("words", words), ("report", report)):
        if more:
            spans = spans.join(repeated(texts, more).withColumnRenamed("spans", name), "node", "full")
        else:
            spans = spans.withColumn(name, F.lit(None).cast(spans.schema["spans"].dataType))
    counts = ["n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_bytes"]
    info = T.StructType([*(T.StructField(c, T.LongType()) for c in counts), T.StructField("kept_sha256", T.StringType())])
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("rest", T.StringType()), T.StructField("cut", info)])
    kinds = pa.struct([*((c, pa.int64()) for c in counts), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rests, infos, none = [], [], np.empty(0, np.int64)
            spans = []
            for c in ("spans", "words", "report"):
                bounds, (a, e) = _flat(b[c], "a", "b")
                spans.append((bounds, a.to_numpy(), e.to_numpy()))
            for i in range(b.num_rows):
                t = b["text"][i].as_py().encode()
                found, more, told = ([x[bounds[i] : bounds[i + 1]] for x in ranges] for bounds, *ranges in spans)
                starts, ends = byte_runs(t, *found, *more)
                kept = zip([0, *ends.tolist()], [*starts.tolist(), len(t)], strict=True)
                rest = b"".join([t[x:y] for x, y in kept])
                passages, stops = byte_runs(t, none, none, *told)
                numbers = (len(t), len(t) - len(rest), len(starts), len(passages), int((stops - passages).sum()))
                rests.append(None if digest else rest.decode("utf-8", "ignore"))
                infos.append(dict(zip(counts, numbers, strict=True)) | {"kept_sha256": hashlib.sha256(rest).hexdigest()})
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(rests, pa.string()), pa.array(infos, kinds)], names=["node", "rest", "cut"])

    done = texts.join(spans, "node", "left").select("node", "text", "spans", "words", "report").mapInArrow(run, schema)
    # Each text is cut once and joined to its rows, which need not carry it.
    others = [c for c in docs.columns if c != text]
    rows = docs.select(node_of(F.col(text)).alias("node"), F.col(text).isNull().alias("none"), F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))
    out = rows.join(done, "node")
    back = [F.when(~F.col("none"), F.col("rest")).alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if not (digest and c == text)]
    return out.select(*back, "cut")
