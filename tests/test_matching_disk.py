"""Shuffles of the matching queries carry vectors and answers, never pairs with vectors."""

import re

import numpy as np
import pytest

import __spark_entry__
from tessera.operators import pivots, vectors

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.standard_normal(dim).round(3).tolist()) for i in range(n)], "id long, cls array<double>")


@pytest.mark.parametrize("name", ["coarse_topk", "coarse_topk_rot"])
def test_queries_are_not_copied_to_cells(spark, name):
    plan = plan_of(__spark_entry__.queries()[name](spark, SF))
    assert "CartesianProduct" in plan and "explode(cells" not in plan


@pytest.mark.parametrize("name", ["fine_maxsim", "candidate_rank", "coarse_to_fine"])
def test_vectors_are_not_joined_to_pairs(spark, name):
    plan = plan_of(__spark_entry__.queries()[name](spark, SF))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("name", ["composite_score", "cost_matrix", "best_rotation", "top3_candidates", "flat_side_score"])
def test_pairs_are_shuffled_once(spark, name):
    """From the product on, a piece's rows stay where the first shuffle has brought them."""
    plan = plan_of(__spark_entry__.queries()[name](spark, SF))
    above = plan[: plan.index("CartesianProduct")]
    assert len(re.findall(r"Exchange hashpartitioning\(piece_id#\d+L, \d+\), REPARTITION_BY_COL", above)) == 1
    assert not re.search(r"Exchange hashpartitioning\(piece_id#\d+L, (rot|row)", plan)


def test_fine_where_vectors_meet(spark):
    """Blocks of few queries, tasks of some blocks: every query has its k, and the scores of max_sim()."""
    q, x = drawn(spark, 230, 24, 1).withColumnRenamed("id", "q"), drawn(spark, 310, 24, 2)
    p = pivots.Params(sample=200, block=32, least_block=16, queries=20, held=1 << 13)
    got = vectors.top_cosine(q, x, 5, ["q"], ["id"], p=p, fine=8).cache()
    assert got.groupBy("q").count().filter("count <> 5").count() == 0 and got.count() == 5 * 230
    pairs = got.select("q", "id", "coarse", "rk", got.fine.alias("met"))
    want = vectors.max_sim(pairs, vectors.tokens(q, ["q"]), vectors.tokens(x, ["id"]), ["q"], ["id"])
    assert want.filter("abs(fine - met) < 1e-12").count() == 5 * 230


def test_copies_at_the_last_place(spark):
    """Of more equal keys than there are places, those of the smallest ids stay, whatever the blocks are."""
    keys = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [2.0, 1.0 + i]) for i in range(600)], "id long, cls array<double>")
    q = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "q long, cls array<double>")
    got = vectors.top_cosine(q, keys, 4, ["q"], ["id"], p=pivots.Params(sample=50, block=16, least_block=16, queries=8))
    equal = [i for i in range(600) if i % 3 or i == 3]
    assert {(r["q"], r["id"]) for r in got.collect()} == {(a, i) for a in range(40) for i in sorted(equal)[:4]}
