"""Every registered assembly query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import adjacency
from tessera.plans import catalogue
from tessera.plans.views import Views

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns, rows = want.columns, want.fetchall()
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(columns, rows)


def test_every_query_has_sql_or_a_test_of_its_own():
    own = {"assignment_optimal", "swap_step", "swap_search", "contour_shapes", "watershed_split"}
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == own


def test_assignments_are_optimal(spark):
    """Costs computed anew, and no exchange of two or three pieces lowers the total; totals as the solver's on the dense matrix."""
    v = Views(spark, DATA)
    got = {}
    for r in catalogue.queries()["assignment_optimal"](spark, DATA).collect():
        got.setdefault(r["job_id"], []).append((r["piece_id"], r["row"], r["col"], r["confidence"]))
    jobs = {}
    for r in v.puzzles().orderBy("piece_id").collect():
        jobs.setdefault(r["job_id"], []).append(r)
    assert set(got) == set(jobs)
    for job, rows in jobs.items():
        x = np.array([r["v"] for r in rows])
        p = np.roll(x, -16, axis=1)
        cos = p @ x.T / (np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
        flats = np.array([{"corner": 2, "edge": 1, "interior": 0}[r["piece_type"]] for r in rows])
        have = np.array([r["flat_side_count"] for r in rows])
        cost = 1 - (0.7 * np.maximum(0, cos) + 0.3 * np.maximum(0, 1 - 0.5 * abs(flats[None, :] - have[:, None])))
        at = {(r["row"], r["col"]): j for j, r in enumerate(rows)}
        who = {r["piece_id"]: i for i, r in enumerate(rows)}
        j = np.full(len(rows), -1)
        for piece, row, col, confidence in got[job]:
            j[who[piece]] = at[row, col]
            assert confidence == pytest.approx(1 - cost[who[piece], at[row, col]], abs=1e-5)
        assert sorted(j) == list(range(len(rows)))
        now = cost[np.arange(len(rows)), j]
        swapped = cost[:, j]
        assert (swapped + swapped.T >= now[:, None] + now[None, :] - 1e-6).all()


def test_suppression_is_independent_and_maximal(spark):
    v = Views(spark, DATA)
    kept = {r[0] for r in catalogue.queries()["dedup_overlap"](spark, DATA).collect()}
    edges = [tuple(r) for r in catalogue.queries()["overlap_coefficient"](spark, DATA).select("a", "b").collect()]
    score = {r["mask_id"]: (-r["solidity"], r["mask_id"]) for r in v.mask_rows().collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for m in sorted(score, key=score.get):
        if not near.get(m, set()) & want:
            want.add(m)
    assert kept == want


def slow_climb(place, sides, limit, enough):
    """The search by its definition, every score computed from the profiles when it is asked for."""

    def score(x, y):
        hist = sum(min(np.floor((x + 1) * 16).tolist().count(b), np.floor((y + 1) * 16).tolist().count(b)) for b in range(33)) / len(x)
        fx, fy = np.abs(x).mean() < 0.1, np.abs(y).mean() < 0.1
        curv = 1.0 if fx and fy else 0.25 if fx or fy else (1 - np.corrcoef(x, y)[0, 1]) / 2
        return round(0.6 * hist + 0.4 * curv, 9)

    def pairs():
        at = {xy: p for p, xy in place.items()}
        for p, (r, c) in sorted(place.items()):
            if (q := at.get((r, c + 1))) is not None:
                yield score(sides[p][1], sides[q][3]), p, q
            if (q := at.get((r + 1, c))) is not None:
                yield score(sides[p][2], sides[q][0]), p, q

    def mean(p):
        got = [s for s, a, b in pairs() if p in (a, b)]
        return sum(got) / len(got) if got else 1.0

    for _ in range(limit):
        s, p, other = min(pairs(), default=(1.0, None, None))
        if s >= enough:
            break
        for q in sorted(place):
            if q in (p, other):
                continue
            before = mean(p) + mean(q)
            place[p], place[q] = place[q], place[p]
            if mean(p) + mean(q) > before + 1e-12:
                break
            place[p], place[q] = place[q], place[p]
        else:
            break
    return place


def test_swaps_against_the_definition(spark):
    rng = np.random.default_rng(3)
    rows, profiles, want = [], [], {}
    for job in range(6):
        n_rows, n_cols = [(2, 2), (2, 3), (3, 3), (1, 4), (3, 3), (1, 1)][job]
        ids = [10 * job + i for i in range(n_rows * n_cols)]
        place = {p: (i // n_cols, i % n_cols) for i, p in enumerate(ids)}
        sides = {p: np.round(rng.uniform(-1, 1, (4, 16)) * rng.choice([0.05, 1.0], (4, 1), p=[0.2, 0.8]), 3) for p in ids}
        rows += [(job, p, *xy) for p, xy in place.items()]
        profiles += [(job, p, sides[p].tolist()) for p in ids]
        want |= slow_climb(place, sides, 20, 0.9)
    start = spark.createDataFrame(rows, "job_id long, piece_id long, row long, col long")
    sides = spark.createDataFrame(profiles, "job_id long, piece_id long, sides array<array<double>>")
    got = {r["piece_id"]: (r["row"], r["col"]) for r in adjacency.swap_search(start, sides, 20, 0.9).collect()}
    assert got == want and got != {r[1]: r[2:] for r in rows}


def test_swaps_keep_places_and_pieces(spark):
    for name in ("swap_step", "swap_search"):
        rows = catalogue.queries()[name](spark, DATA).collect()
        assert len({r["piece_id"] for r in rows}) == len({(r["job_id"], r["row"], r["col"]) for r in rows}) == 500


def test_shapes_and_watershed_agree_with_the_kernels(spark):
    v = Views(spark, DATA)
    got = {r["user_id"]: r for r in catalogue.queries()["contour_shapes"](spark, DATA).collect()}
    points = {}
    for r in v.contours().orderBy("user_id", "idx").collect():
        points.setdefault(r["user_id"], []).append((r["x"], r["y"]))
    assert set(got) == set(points)
    for user, p in points.items():
        p = np.array(p)
        assert got[user]["solidity"] == pytest.approx(kernels.solidity(p), abs=1e-6) and got[user]["merged"] == kernels.has_deep_defect(p)
        assert got[user]["corners"] == kernels.corners(p).tolist()
    parts = catalogue.queries()["watershed_split"](spark, DATA).collect()
    assert len(parts) == v.raster_mask().filter("m > 0").count() and max(r["part"] for r in parts) > 1
