"""What multi-index hashing sends to the driver does not grow with probes or tasks."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mih
from tessera.session import materialize


def rows(spark, n=600, dim=16):
    x = np.random.default_rng(2).standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").select(mih._node(), "vec_id", "embedding")


def test_probes_are_not_broadcast(spark):
    df, p = rows(spark), mih.Params(bits=64)
    x = np.array([r[0] for r in df.select("embedding").collect()])
    model = mih.Model(mih.quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), p), 13, 20, mih.reaches(13, 5))
    index = materialize(mih.coded(df, model), "index")
    for some in (mih.retrieved(index, index, model, p), mih._scan(index, index, 5, p)):
        plan = some._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and ("part" in line or "shard" in line)]
        assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_sample_by_a_bound_on_hashes(spark):
    df = rows(spark).drop("vec_id").repartition(7)
    want = [list(r["embedding"]) for r in df.orderBy(F.xxhash64("node"), "node").limit(40).collect()]
    few, every = (mih._sampled(df, 600, n) for n in (40, 5000))
    assert [r[0] for r in few] == want and len(every) == 600
    assert mih._sampled(df.limit(0), 0, 40) == []
