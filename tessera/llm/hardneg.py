"""Hard negatives by dual-tree search over integer inner products.

An anchor's positives are its first rows of the same label; a positive's hard negatives are the first rows of other labels
whose score lies within a window of shares of the positive's score.  First: by score, largest first, then by id.

Trees of balls stand on both sides.  The upper tree of candidates is fitted on a bounded sample and every row is routed to
a leaf of it; its balls are measured over all rows.  Anchors travel in groups of one leaf.  A group, as a node of its own,
descends the upper tree: the interval of inner products that two balls allow tells which leaves can still hold an answer
for any of its anchors.  Where group and leaf meet, both sides have trees again, pairs of nodes whose interval misses are
pruned for all their anchors at once, and pairs of leaves are scored exactly, the most promising first.  What an anchor
must beat comes at first from the sample.  Every step keeps k rows an anchor (or positive) and cell, never pairs.

Leaves of many rows are split into cells by a hash of the id, so one vector may stand in a third of all rows.

Cases: rows with a null id, label or vector, with null or non-finite components or another length than most sampled
vectors take no part; rows that repeat an id count once (least label, then least vector); positives without an answer give
no row, nor does a positive whose score is below 0; equal scores are ordered by id; other columns are ignored; an empty
table gives no rows.  Scores are exact while they are below 2^53.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.session import Scratch, materialize


@dataclass(frozen=True)
class Params:
    """low and high: percent of the positive's score between which a negative's must lie; scale: components become
    floor(scale * x).  sample bounds the rows that the upper tree is fitted on, leaf the sampled rows of its leaves, cell
    the rows that meet a group of anchors at once; tip_anchors and tip are the leaves of the trees within a task."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: float = 256.0
    sample: int = 16_384
    leaf: int = 64
    cell: int = 16_384
    least_cell: int = 1_024
    group: int = 256
    tip: int = 128
    tip_anchors: int = 16


# -- Trees of balls -------------------------------------------------------------------------------------------------


class Tree:
    """Balls over rows, split at a gap near the median of their widest direction.

    Nodes are numbered from the root, 0; a node holds rows order[start:end], its ball (centre, radius), the largest norm,
    children (0: none), and where its rows were split: direction and cut.
    """

    def __init__(self, x: np.ndarray, tip: int):
        self.x, self.tip = x, tip
        self.order = np.arange(len(x))
        self.start, self.end, self.left, self.right = [], [], [], []
        self.centre, self.radius, self.norm = [], [], []
        self.direction, self.cut = [], []
        self._grow(0, len(x))
        for name in ("start", "end", "left", "right", "radius", "norm", "centre", "direction", "cut"):
            setattr(self, name, np.array(getattr(self, name)))
        self.measured()

    def measured(self) -> None:
        self.length = np.linalg.norm(self.centre, axis=1)

    def _grow(self, start: int, end: int) -> int:
        me = len(self.start)
        rows = self.x[self.order[start:end]]
        centre = rows.mean(axis=0)
        away = rows - centre
        dist = np.sqrt((away * away).sum(axis=1))
        for name, value in (("start", start), ("end", end), ("left", 0), ("right", 0), ("centre", centre), ("radius", dist.max()), ("norm", np.sqrt((rows * rows).sum(axis=1).max())), ("direction", np.zeros(len(centre))), ("cut", 0.0)):
            getattr(self, name).append(value)
        if end - start > self.tip and dist.max() > 0:
            d = away[np.argmax(dist)]
            for _ in range(4):  # towards the widest direction
                d = away.T @ (away @ d)
                d = d / (np.linalg.norm(d) or 1.0)
            along = rows @ d
            by = np.argsort(along, kind="stable")
            gap = np.diff(along[by])
            # The widest gap of the middle half keeps clusters whole; where all are equal there, the widest of all.
            n, quarter = len(by), len(by) // 4
            at = quarter + int(np.argmax(gap[quarter : n - quarter]))
            at = at if gap[at] > 0 else int(np.argmax(gap))
            if gap[at] > 0:
                middle = start + at + 1
                self.order[start:end] = self.order[start:end][by]
                self.direction[me] = d
                self.cut[me] = float((along[by[at]] + along[by[at + 1]]) / 2)
                self.left[me] = self._grow(start, middle)
                self.right[me] = self._grow(middle, end)
        return me

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left == 0)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Leaf of each row, and the nodes passed on the way, by level."""
        at, path = np.zeros(len(x), int), []
        while True:
            path.append(at)
            down = self.left[at] > 0
            if not down.any():
                return at, path
            low = np.einsum("ij,ij->i", x, self.direction[at]) < self.cut[at]
            at = np.where(down, np.where(low, self.left[at], self.right[at]), at)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]

    def over(self, values: np.ndarray, least: bool) -> np.ndarray:
        """Per node the least (or largest) of a value by row."""
        of = values[self.order]
        return np.array([(of[s:e].min() if least else of[s:e].max()) for s, e in zip(self.start, self.end, strict=True)])


def intervals(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what the inner products of any row of node i of a and any row of node j of b lie."""
    mid = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    # a.b = ca.cb + ca.(b - cb) + (a - ca).b, and the same from the other side.
    spread = np.minimum(a.length[i] * b.radius[j] + a.radius[i] * b.norm[j], b.length[j] * a.radius[i] + b.radius[j] * a.norm[i])
    most = a.norm[i] * b.norm[j]
    slack = 1e-6 * (1.0 + most)
    return np.maximum(mid - spread, -most) - slack, np.minimum(mid + spread, most) + slack


def descend(a: Tree, b: Tree, need: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that can hold answers, with the upper end of their interval; need and most are by node of a."""
    i, j = np.zeros(1, int), np.zeros(1, int)
    out = []
    while len(i):
        low, up = intervals(a, i, b, j)
        ok = (up >= need[i]) & (low <= most[i])
        i, j, up = i[ok], j[ok], up[ok]
        end_a, end_b = a.left[i] == 0, b.left[j] == 0
        both = end_a & end_b
        out.append((i[both], j[both], up[both]))
        i, j, end_a, end_b = i[~both], j[~both], end_a[~both], end_b[~both]
        ways_a = [np.where(end_a, i, a.left[i]), np.where(end_a, -1, a.right[i])]
        ways_b = [np.where(end_b, j, b.left[j]), np.where(end_b, -1, b.right[j])]
        pairs = [(x, y) for x in ways_a for y in ways_b]
        i, j = (np.concatenate([p[n] for p in pairs]) for n in (0, 1))
        keep = (i >= 0) & (j >= 0)
        i, j = i[keep], j[keep]
    i, j, up = (np.concatenate([o[n] for o in out]) for n in range(3))
    order = np.lexsort((-up, i))
    return i[order], j[order], up[order]


# -- Search ---------------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


@dataclass
class Slots:
    """What is asked for: for anchor `of`, the k first rows of its label (same) or of other labels with scores between low
    and high.  need: the score that an answer has at least."""

    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    k: int
    same: bool


class Best:
    """The k best (score, id) a slot so far."""

    def __init__(self, slots: Slots):
        self.slots = slots
        self.score = np.full((len(slots.of), slots.k), -np.inf)
        self.id = np.zeros((len(slots.of), slots.k), np.int64)
        self.need = np.maximum(slots.low, slots.need)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New candidates, in any order; they are better than what they replace, or equal with a smaller id."""
        touched = np.unique(slot)
        k = self.slots.k
        old = np.repeat(touched, k)
        slot = np.concatenate([slot, old])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < k
        self.score[slot[keep], place[keep]] = score[keep]
        self.id[slot[keep], place[keep]] = ids[keep]
        self.need[touched] = np.maximum(self.need[touched], self.score[touched, k - 1])


def search(anchors: Rows, a: Tree, rows: Rows, b: Tree, slots: Slots, at_once: int = 8) -> Best:
    """Answers among rows, by descending both trees."""
    best = Best(slots)
    if not len(slots.of) or not len(rows.ids):
        return best
    by = np.argsort(slots.of, kind="stable")
    first, last = (np.searchsorted(slots.of[by], np.arange(len(anchors.ids)), side=s) for s in ("left", "right"))

    def by_anchor(values: np.ndarray, least: bool, none: float) -> np.ndarray:
        out = np.full(len(anchors.ids), none)
        (np.minimum if least else np.maximum).at(out, slots.of, values)
        return out

    need, most = a.over(by_anchor(best.need, True, np.inf), True), a.over(by_anchor(slots.high, False, -np.inf), False)
    i, j, up = descend(a, b, need, most)
    for node in np.unique(i):
        mine = np.flatnonzero(i == node)
        group = a.rows(node)
        asked = np.concatenate([by[first[g] : last[g]] for g in group])
        where = np.searchsorted(np.sort(group), slots.of[asked])
        group = np.sort(group)
        for n in range(0, len(mine), at_once):
            some = mine[n : n + at_once]
            some = some[up[some] >= best.need[asked].min()]
            if not len(some):
                break
            cols = np.concatenate([b.rows(c) for c in j[some]])
            s = (anchors.x[group] @ rows.x[cols].T)[where]
            fits = (s >= best.need[asked][:, None]) & (s <= slots.high[asked][:, None])
            alike = rows.labels[cols][None, :] == anchors.labels[group[where]][:, None]
            fits &= alike if slots.same else ~alike
            fits &= rows.ids[cols][None, :] != anchors.ids[group[where]][:, None]
            r, c = np.nonzero(fits)
            if len(r):
                best.add(asked[r], s[r, c], rows.ids[cols[c]])
    return best


# -- On Spark -------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def valid(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, embedding of the rows that take part; a repeated id counts once."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(embedding) > 0) & ok)
    out = out.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"))
    again = out.groupBy("vec_id").agg(F.count("*").alias("n_")).filter("n_ > 1").select("vec_id")
    if again.isEmpty():
        return out
    least = out.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    return out.join(again, "vec_id", "left_anti").unionByName(least)


def fit(rows: DataFrame, p: Params, n: int, parallel: int) -> tuple[Tree, Rows] | None:
    """The upper tree, and the sampled rows: those with the smallest hashes of their ids."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).toArrow()
    if not picked.num_rows:
        return None
    lengths = pc.list_value_length(picked["embedding"]).to_pylist()
    sizes = Counter(lengths)
    size = max(sizes, key=lambda s: (sizes[s], -s))
    picked = picked.filter(pa.array([x == size for x in lengths]))
    x = np.floor(p.scale * _matrix(picked["embedding"].combine_chunks(), picked.num_rows))
    cell = min(p.cell, max(p.least_cell, n // max(1, parallel)))
    tip = max(p.leaf, -(-len(x) * cell // max(1, n)))
    return Tree(x, tip), Rows(picked["vec_id"].to_numpy(), picked["label"].to_numpy(), x)


def _routed(tree: Tree, p: Params):
    """vec_id, label, v, leaf; rows of another length go."""
    dim = tree.centre.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            b = b.filter(pa.array(b["embedding"].value_lengths().to_numpy(zero_copy_only=False) == dim))
            x = np.floor(p.scale * _matrix(b["embedding"], b.num_rows)) if b.num_rows else np.zeros((0, dim))
            leaf, _ = tree.route(x)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * dim + 1, dim), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], v, pa.array(leaf, pa.int32())], names=["vec_id", "label", "v", "leaf"])

    return run


def _balls(tree: Tree):
    """Per task and node: node, n, radius around its centre, largest norm."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, radius, norm = np.zeros(len(tree.start), np.int64), np.zeros(len(tree.start)), np.zeros(len(tree.start))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["v"], b.num_rows)
            length = np.sqrt((x * x).sum(axis=1))
            _, path = tree.route(x)
            for level, at in enumerate(path):
                new = np.ones(len(at), bool) if not level else at != path[level - 1]
                np.add.at(n, at[new], 1)
                np.maximum.at(radius, at[new], np.sqrt(((x[new] - tree.centre[at[new]]) ** 2).sum(axis=1)))
                np.maximum.at(norm, at[new], length[new])
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(radius[seen]), pa.array(norm[seen])], names=["node", "n", "radius", "norm"])

    return run


@dataclass
class Index:
    """All rows by cell, the upper tree with its measured balls, and the sample."""

    rows: DataFrame
    cells: DataFrame
    tree: Tree
    sample: Rows
    parts: dict[int, int]


def index(rows: DataFrame, p: Params, scratch: Scratch) -> Index | None:
    """Fits the tree, routes every row, measures the balls; the driver holds the sample and a row a node."""
    spark = rows.sparkSession
    rows = scratch.table(rows, "rows")
    n, parallel = rows.count(), 2 * spark.sparkContext.defaultParallelism
    fitted = fit(rows, p, n, parallel)
    if fitted is None:
        return None
    tree, sample = fitted
    routed = scratch.table(rows.mapInArrow(_routed(tree, p), "vec_id long, label long, v array<double>, leaf int"), "routed")
    balls = routed.mapInArrow(_balls(tree), "node long, n long, radius double, norm double").groupBy("node").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    tree.radius, tree.norm = np.zeros(len(tree.start)), np.zeros(len(tree.start))
    parts = {}
    cell = min(p.cell, max(p.least_cell, n // max(1, parallel)))
    for r in balls:
        tree.radius[r["node"]], tree.norm[r["node"]] = r["radius"], r["norm"]
        if not tree.left[r["node"]]:
            parts[r["node"]] = -(-r["n"] // (2 * cell))
    # One row a leaf.
    of = F.broadcast(spark.createDataFrame(sorted(parts.items()), "leaf int, parts long"))
    cells = routed.join(of, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.struct("vec_id", "label", "v").alias("r"))
    cells = scratch.table(cells.groupBy("leaf", "part").agg(F.collect_list("r").alias("r")), "cells")
    return Index(routed, cells, tree, sample, parts)


def _unpacked(values: pa.StructScalar) -> Rows:
    r = values.values
    return Rows(r.field("vec_id").to_numpy(), r.field("label").to_numpy(), _matrix(r.field("v"), len(r)))


SLOTS = "array<struct<of:int,positive:long,score:long,low:double,high:double,need:double>>"


def _slots(values: pa.ListScalar, k: int, same: bool) -> tuple[Slots, pa.StructArray]:
    s = values.values
    of, low, high, need = (s.field(c).to_numpy(zero_copy_only=False) for c in ("of", "low", "high", "need"))
    return Slots(of, low, high, need, k, same), s


def _aimed(ix: Index, p: Params, same: bool, k: int):
    """Of groups of anchors: what each slot must beat, from the sample, and the leaves that can hold answers."""
    tree, sample = ix.tree, ix.sample
    near = Tree(sample.x, p.tip)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                anchors = _unpacked(b["r"][i])
                a = Tree(anchors.x, p.tip_anchors)
                slots, raw = _slots(b["slots"][i], k, same)
                need = search(anchors, a, sample, near, slots).need
                # The group descends as one node: its root.
                top = Tree(anchors.x, len(anchors.x))
                _, leaf, _ = descend(top, tree, np.array([need.min(initial=np.inf)]), np.array([slots.high.max(initial=-np.inf)]))
                cols = [raw.field(c) if c != "need" else pa.array(need) for c in ("of", "positive", "score", "low", "high", "need")]
                told = pa.StructArray.from_arrays(cols, names=["of", "positive", "score", "low", "high", "need"])
                leaves = np.unique(leaf).astype(np.int32)
                ends = lambda n: pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays([b["r"].slice(i, 1), pa.ListArray.from_arrays(ends(len(told)), told), pa.ListArray.from_arrays(ends(len(leaves)), pa.array(leaves))], names=["r", "slots", "leaves"])

    return run


def _met(p: Params, same: bool, k: int):
    """A cell's answers to a group's slots: anchor_id, positive_id, positive_score, score, vec_id."""
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]):
        held, rows, b_tree = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                cell = b["leaf"][i].as_py(), b["part"][i].as_py()
                if cell != held:
                    held, rows = cell, _unpacked(b["cell"][i])
                    b_tree = Tree(rows.x, p.tip)
                anchors = _unpacked(b["r"][i])
                slots, raw = _slots(b["slots"][i], k, same)
                best = search(anchors, Tree(anchors.x, p.tip_anchors), rows, b_tree, slots)
                s, place = np.nonzero(np.isfinite(best.score))
                take = pa.array(s)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[slots.of[s]]), raw.field("positive").take(take), raw.field("score").take(take), pa.array(best.id[s, place]), pa.array(best.score[s, place].astype(np.int64))], names=names)

    return run


def _first(ix: Index, asked: DataFrame, p: Params, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """The first k rows of every slot of groups of anchors: asked has r (vec_id, label, v of anchors) and slots."""
    spark = asked.sparkSession
    aimed = asked.mapInArrow(_aimed(ix, p, same, k), f"r {asked.schema['r'].dataType.simpleString()}, slots {SLOTS}, leaves array<int>")
    of = F.broadcast(spark.createDataFrame(sorted(ix.parts.items()), "leaf int, parts long"))
    sent = aimed.select("r", "slots", F.explode("leaves").alias("leaf")).join(of, "leaf")
    sent = sent.select("r", "slots", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = sent.join(ix.cells.withColumnRenamed("r", "cell"), ["leaf", "part"])
    met = both.mapInArrow(_met(p, same, k), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return scratch.table(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "first")


def mine(rows: DataFrame, anchors: Column, p: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each positive's hardest negatives.

    anchors tells which rows are anchors, in terms of vec_id; every row is a candidate.
    """
    spark = rows.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        ix = index(valid(rows, vec_id, embedding, label), p, scratch)
        if ix is None:
            return spark.range(0).select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
        mine_ = ix.rows.filter(anchors)
        sizes = mine_.groupBy("leaf").agg(F.ceil(F.count("*") / p.group).alias("parts"))
        dealt = mine_.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.struct("vec_id", "label", "v").alias("r"))
        groups = scratch.table(dealt.groupBy("leaf", "part").agg(F.array_sort(F.collect_list("r")).alias("r")), "anchors")
        any_score = [F.lit(-np.inf).alias("low"), F.lit(np.inf).alias("high"), F.lit(-np.inf).alias("need")]
        one = F.transform("r", lambda x, i: F.struct(i.alias("of"), F.lit(None).cast("long").alias("positive"), F.lit(None).cast("long").alias("score"), *any_score))
        found = _first(ix, groups.select("r", one.alias("slots")), p, True, p.positives, scratch)
        low, high = F.ceil(F.lit(p.low) * F.col("score") / 100.0), F.floor(F.lit(p.high) * F.col("score") / 100.0)
        bounds = found.select("anchor_id", F.struct(F.col("vec_id").alias("positive"), "score", low.cast("double").alias("low"), high.cast("double").alias("high"), low.cast("double").alias("need")).alias("s")).filter("s.low <= s.high")
        windows = bounds.groupBy("anchor_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
        each = groups.select("leaf", "part", F.posexplode("r").alias("of", "a")).join(windows, F.col("a.vec_id") == F.col("anchor_id"))
        packed = each.groupBy("leaf", "part").agg(F.array_sort(F.collect_list(F.struct("of", "a", "s"))).alias("q"))
        slot = F.flatten(F.transform("q", lambda x, i: F.transform(x["s"], lambda y: F.struct(i.alias("of"), y["positive"].alias("positive"), y["score"].alias("score"), y["low"].alias("low"), y["high"].alias("high"), y["need"].alias("need")))))
        asked = scratch.table(packed.select(F.transform("q", lambda x: x["a"]).alias("r"), slot.alias("slots")), "asked")
        out = _first(ix, asked, p, False, p.negatives, scratch)
        return materialize(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def oracle() -> str:
    """The registered query in DuckDB, by all pairs."""
    return """
WITH ok AS (
  SELECT DISTINCT ON (vec_id) vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY rank <= 3"""
