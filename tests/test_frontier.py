"""Orders level by level against the queue of one worker."""

import numpy as np

from tessera.operators import sequence

SCHEMA = "job_id long, piece_id long, row long, col long, piece_type string, confidence double"


def test_levels_against_the_queue(spark):
    rng = np.random.default_rng(1)
    rows, seen = [], set()
    for job in range(9):
        h, w = int(rng.integers(1, 8)), int(rng.integers(1, 8))
        for i in range(h * w + 3):
            r, c = (i // w, i % w) if i < h * w else (int(rng.integers(0, h)), int(rng.integers(0, w)))
            if rng.random() < 0.75:
                kind = rng.choice(["corner", "edge", "interior", "other", None], p=[0.2, 0.3, 0.3, 0.1, 0.1])
                rows.append((job, 100 * job + int(rng.permutation(100)[0]), r, c, kind, None if rng.random() < 0.1 else float(rng.integers(0, 5)) / 4))
    rows = [x for x in rows if not (x[1] in seen or seen.add(x[1]))]
    df = spark.createDataFrame(rows + rows[:4] + [(1, None, 0, 0, "edge", 0.5), (None, 7, 0, 0, "edge", 0.5), (2, 950, None, 1, "edge", 0.5)], SCHEMA)
    fields = ("job_id", "piece_id", "level", "step_num")
    got = sorted(tuple(r[f] for f in fields) for r in sequence.frontier_order(df).collect())
    want = sorted(tuple(r[f] for f in fields) for r in sequence.assembly_order(df).collect())
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert [x[2] for x in got] == [None if x[2] is None or x[2] != x[2] else x[2] for x in want]
    assert len(got) == len(rows) and sequence.frontier_order(df.limit(0)).count() == 0
