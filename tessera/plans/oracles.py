"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

import math

VIEWS = """
grid AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM embeddings),
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label, vec_id // w AS "row", vec_id % w AS col, w FROM embeddings, grid),
shape AS (SELECT max("row") + 1 AS n_rows, max(col) + 1 AS n_cols FROM vectors),
cells AS (SELECT "row", col, v AS cls FROM vectors),
pieces AS (SELECT vec_id AS piece_id, list_concat(v[len(v) // 4 + 1 :], v[: len(v) // 4]) AS cls, label % 3 AS flat_side_count FROM vectors),
piece_rot AS (SELECT piece_id, r * 90 AS rot, CASE WHEN r = 0 THEN cls ELSE list_concat(cls[r * (len(cls) // 4) + 1 :], cls[: r * (len(cls) // 4)]) END AS cls
              FROM pieces, (SELECT unnest(range(4)) AS r)),
matches AS (SELECT vec_id AS piece_id, "row", col, round((1 + list_inner_product(list_concat(v[len(v) // 4 + 1 :], v[: len(v) // 4]), v)
              / (greatest(sqrt(list_inner_product(v, v)), 1e-8) * greatest(sqrt(list_inner_product(v, v)), 1e-8))) / 2, 9) AS confidence, label % 3 AS flat_side_count FROM vectors),
typed AS (SELECT *, CASE WHEN "row" IN (0, n_rows - 1) AND col IN (0, n_cols - 1) THEN 'corner' WHEN "row" IN (0, n_rows - 1) OR col IN (0, n_cols - 1) THEN 'edge' ELSE 'interior' END AS piece_type FROM matches, shape),
placed AS (SELECT *, piece_id + 1 AS step_num, confidence < 0.55 AS flagged FROM typed WHERE confidence >= 0.45),
puzzles AS (SELECT *, CASE WHEN "row" IN (0, 9) AND col IN (0, 9) THEN 'corner' WHEN "row" IN (0, 9) OR col IN (0, 9) THEN 'edge' ELSE 'interior' END AS piece_type
            FROM (SELECT piece_id // 100 AS job_id, piece_id, piece_id % 100 // 10 AS "row", piece_id % 10 AS col, confidence, flat_side_count FROM matches)),
seated AS (SELECT *, CASE piece_type WHEN 'corner' THEN 0 WHEN 'edge' THEN 1 ELSE 2 END AS kind FROM puzzles WHERE confidence >= 0.45),
sides AS (SELECT vec_id, p // 16 AS side, p % 16 AS idx, v[p + 1] AS k FROM (SELECT vec_id, v, unnest(range(len(v))) AS p FROM vectors)),
pixels AS (SELECT l_returnflag AS img, l_linestatus AS c, CAST(least(255, floor(l_extendedprice / 105000 * 256)) AS BIGINT) AS v, l_orderkey AS block FROM lineitem),
raster AS (SELECT "row", col, round(127.5 * (1 + v[1])) AS v FROM vectors),
raster_mask AS (SELECT "row", col, CAST(label >= 3 AS BIGINT) AS m FROM vectors),
contours AS (SELECT user_id, row_number() OVER w - 1 AS idx, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000, 0.0) AS x, value AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
mask_rows AS (SELECT o_orderkey AS mask_id, CAST(floor(o_totalprice) AS BIGINT) AS area, 1 + o_custkey % 50 AS w, 1 + o_orderkey % 50 AS h, (o_orderkey % 100) / 100 AS solidity FROM orders),
mask_sets AS (SELECT DISTINCT l_orderkey AS mask_id, l_partkey AS px FROM lineitem),
job_events AS (SELECT user_id AS job_id, ts, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'preprocessing' WHEN 'click' THEN 'matching' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS stage,
    CASE WHEN event_id % 4 <> 0 THEN CAST(least(100, floor(value)) AS BIGINT) END AS progress, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
"""

def r(expr: str, name: str) -> str:
    """To the nearest millionth, by the same steps as on the other side."""
    return f"floor(round(CAST({expr} AS DOUBLE), 11) * 1e6 + 0.5) / 1e6 AS {name}"


COS = "round(list_inner_product(p.cls, c.cls) / (greatest(sqrt(list_inner_product(p.cls, p.cls)), 1e-8) * greatest(sqrt(list_inner_product(c.cls, c.cls)), 1e-8)), 12)"
COARSE = f"""coarse_rot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, rot ORDER BY coarse DESC, "row", col) AS rk
    FROM (SELECT piece_id, rot, "row", col, {COS} AS coarse FROM piece_rot p, cells c)) WHERE rk <= 30)"""
UNIT = "list_transform(range(8), lambda t: CASE WHEN list_inner_product({0}[8*t+1 : 8*t+8], {0}[8*t+1 : 8*t+8]) > 0 THEN list_transform({0}[8*t+1 : 8*t+8], lambda e: e / sqrt(list_inner_product({0}[8*t+1 : 8*t+8], {0}[8*t+1 : 8*t+8]))) ELSE {0}[8*t+1 : 8*t+8] END)"
FINE = f"""lt AS MATERIALIZED (SELECT piece_id, rot, {UNIT.format("cls")} AS l FROM piece_rot), rt AS MATERIALIZED (SELECT "row", col, {UNIT.format("cls")} AS r FROM cells),
fine AS MATERIALIZED (SELECT s.*, greatest(0.0, least(1.0, list_avg(list_transform(l, lambda a: list_max(list_transform(r, lambda b: list_inner_product(a, b))))))) AS fine
    FROM coarse_rot s JOIN lt USING (piece_id, rot) JOIN rt USING ("row", col))"""
CANDIDATES = f"""{COARSE}, {FINE},
candidates AS MATERIALIZED (SELECT piece_id, rot, "row", col, fine, expected, flat, round(0.70 * fine + 0.30 * flat, 9) AS composite FROM (
    SELECT f.*, expected, greatest(0.0::DOUBLE, 1 - 0.5::DOUBLE * abs(expected - flat_side_count)) AS flat FROM fine f JOIN pieces USING (piece_id)
    JOIN (SELECT "row", col, CASE piece_type WHEN 'corner' THEN 2 WHEN 'edge' THEN 1 ELSE 0 END AS expected FROM typed) USING ("row", col)))"""
BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, "row", col ORDER BY composite DESC, rot) AS n FROM candidates) WHERE n = 1)"""
PAIRS = """pairs AS (SELECT x.piece_id AS a, y.piece_id AS b, 1 AS side_a, 3 AS side_b FROM matches x JOIN matches y ON x."row" = y."row" AND y.col = x.col + 1
    UNION ALL SELECT x.piece_id, y.piece_id, 2, 0 FROM matches x JOIN matches y ON y."row" = x."row" + 1 AND y.col = x.col)"""
FLAT = "flats AS (SELECT vec_id, side, avg(abs(k)) < 0.1 AS is_flat FROM sides GROUP BY ALL)"
SCORED = f"""{PAIRS}, {FLAT}, shares AS (SELECT vec_id, side, CAST(floor((k + 1) * 16) AS BIGINT) AS bin, count(*) / 16 AS p FROM sides GROUP BY ALL),
hist AS (SELECT a, b, least(sum(least(x.p, y.p)), 1.0) AS hist FROM pairs JOIN shares x ON x.vec_id = a AND x.side = side_a JOIN shares y ON y.vec_id = b AND y.side = side_b AND y.bin = x.bin GROUP BY a, b),
curv AS (SELECT a, b, CASE WHEN fa AND fb THEN 1.0 WHEN fa OR fb THEN 0.25 WHEN sa < 1e-8 OR sb < 1e-8 THEN 0.5 ELSE greatest(0.0, least(1.0, (1 - cv / (sa * sb)) / 2)) END AS curv FROM (
    SELECT a, b, any_value(f.is_flat) AS fa, any_value(g.is_flat) AS fb, covar_pop(x.k, y.k) AS cv, stddev_pop(x.k) AS sa, stddev_pop(y.k) AS sb
    FROM pairs JOIN sides x ON x.vec_id = a AND x.side = side_a JOIN sides y ON y.vec_id = b AND y.side = side_b AND y.idx = x.idx
    JOIN flats f ON f.vec_id = a AND f.side = side_a JOIN flats g ON g.vec_id = b AND g.side = side_b GROUP BY a, b)),
scored AS (SELECT a, b, coalesce(hist, 0.0) AS hist, curv, round(0.6 * coalesce(hist, 0.0) + 0.4 * curv, 9) AS combined FROM curv LEFT JOIN hist USING (a, b))"""
HIST = """levels AS (SELECT g.*, v, coalesce(n, 0) AS n FROM (SELECT DISTINCT {0} FROM pixels) g CROSS JOIN (SELECT unnest(range(256)) AS v) LEFT JOIN (SELECT {0}, v, count(*) AS n FROM pixels GROUP BY ALL) USING ({0}, v)),
cdfs AS (SELECT {0}, v, n, sum(n) OVER (PARTITION BY {0} ORDER BY v) / sum(n) OVER (PARTITION BY {0}) AS cdf FROM levels)"""
LUT = HIST.format("img, c") + """, lut AS (SELECT s.c, s.v AS i, coalesce(min(t.v), 255) AS j FROM cdfs s LEFT JOIN cdfs t ON t.img = 'R' AND t.c = s.c AND round(t.cdf, 12) >= round(s.cdf, 12)
    WHERE s.img = 'A' GROUP BY s.c, s.v)"""
BINS = "bins AS (SELECT img, c, v // 8 AS bin, count(*) / sum(count(*)) OVER (PARTITION BY img, c) AS p FROM pixels GROUP BY img, c, v // 8)"
NEAREST = """box AS (SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM contours GROUP BY user_id),
corners AS (SELECT user_id, 0 AS corner, x0 AS cx, y0 AS cy FROM box UNION ALL SELECT user_id, 1, x1, y0 FROM box UNION ALL SELECT user_id, 2, x1, y1 FROM box UNION ALL SELECT user_id, 3, x0, y1 FROM box),
nearest AS (SELECT user_id, corner, idx FROM (SELECT user_id, corner, idx, row_number() OVER (PARTITION BY user_id, corner ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 9), idx) AS n
    FROM contours JOIN corners USING (user_id)) WHERE n = 1)"""
WRAP = """wrapped AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER a) AS xp, coalesce(lag(y) OVER w, last_value(y) OVER a) AS yp, coalesce(lead(x) OVER w, first_value(x) OVER a) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER a) AS yn
    FROM contours WINDOW w AS (PARTITION BY user_id ORDER BY idx), a AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
OVERLAP = """sized AS (SELECT mask_id, count(*) AS n FROM mask_sets GROUP BY mask_id),
met AS (SELECT x.mask_id AS a, y.mask_id AS b, count(*) AS inter FROM mask_sets x JOIN mask_sets y ON x.px = y.px AND x.mask_id < y.mask_id GROUP BY 1, 2),
over_ AS (SELECT a, b, inter, inter / least(p.n, q.n) AS ov FROM met JOIN sized p ON p.mask_id = a JOIN sized q ON q.mask_id = b)"""
BFS = """bfs(job_id, piece_id, "row", col, level) AS (SELECT job_id, piece_id, "row", col, 0 FROM (SELECT *, row_number() OVER (PARTITION BY job_id
        ORDER BY ("row" = 0 AND col = 0) DESC, (piece_type = 'corner') DESC, confidence DESC, piece_id) AS n FROM seated) WHERE n = 1
    UNION SELECT p.job_id, p.piece_id, p."row", p.col, b.level + 1 FROM bfs b JOIN seated p ON p.job_id = b.job_id AND abs(p."row" - b."row") + abs(p.col - b.col) = 1 WHERE b.level < 100),
    levels AS (SELECT job_id, piece_id, min(level) AS level FROM bfs GROUP BY ALL)"""
STEPS = BFS + """, ranked(job_id, piece_id, "row", col, level, rk) AS (SELECT job_id, piece_id, "row", col, level, 1::BIGINT FROM bfs WHERE level = 0
    UNION ALL SELECT job_id, piece_id, "row", col, level, row_number() OVER (PARTITION BY job_id ORDER BY parent, kind, confidence DESC, way) FROM (
        SELECT s.job_id, s.piece_id, s."row", s.col, r.level + 1 AS level, min(r.rk) AS parent, any_value(s.kind) AS kind, any_value(s.confidence) AS confidence,
            arg_min(CASE WHEN s."row" < r."row" THEN 0 WHEN s."row" > r."row" THEN 1 WHEN s.col < r.col THEN 2 ELSE 3 END, r.rk) AS way
        FROM ranked r JOIN seated s ON s.job_id = r.job_id AND abs(s."row" - r."row") + abs(s.col - r.col) = 1 JOIN levels l ON l.piece_id = s.piece_id AND l.level = r.level + 1 GROUP BY ALL)),
    steps AS (SELECT s.*, row_number() OVER (PARTITION BY s.job_id ORDER BY r.level NULLS LAST, r.rk, s.kind, s.confidence DESC, s.piece_id) AS step_num FROM seated s LEFT JOIN ranked r USING (job_id, piece_id))"""
REGIONS = """links AS (SELECT p.id AS a, q.id AS b FROM px p JOIN px q ON abs(p."row" - q."row") <= 1 AND abs(p.col - q.col) <= 1),
    reach(node, root) AS (SELECT id, id FROM px UNION SELECT b, root FROM reach JOIN links ON a = node),
    stats AS (SELECT component, count(*) AS area, min("row") AS row0, min(col) AS col0, max("row") AS row1, max(col) AS col1, CAST(floor(avg("row")) AS BIGINT) AS c_row, CAST(floor(avg(col)) AS BIGINT) AS c_col
        FROM (SELECT node, min(root) AS component FROM reach GROUP BY node) JOIN px ON id = node GROUP BY component)"""
COMMANDS = """SELECT 'line' AS kind, 0 AS x0, y AS y0, 1920 AS x1, y AS y1, CAST(NULL AS VARCHAR) AS text, 'grid' AS colour FROM (SELECT CAST(floor(k * (1080.0::DOUBLE / n_rows)) AS BIGINT) AS y FROM (SELECT n_rows, unnest(range(n_rows + 1)) AS k FROM shape))
            UNION ALL SELECT 'line', x, 0, x, 1080, NULL, 'grid' FROM (SELECT CAST(floor(k * (1920.0::DOUBLE / n_cols)) AS BIGINT) AS x FROM (SELECT n_cols, unnest(range(n_cols + 1)) AS k FROM shape))
            UNION ALL SELECT 'dot', x, y, x, y, NULL, CASE WHEN confidence >= 0.75 THEN 'green' WHEN confidence >= 0.55 THEN 'yellow' ELSE 'red' END FROM (SELECT *, CAST(floor((col + 1) * (1920.0::DOUBLE / n_cols)) AS BIGINT) - 9 AS x, CAST(floor("row" * (1080.0::DOUBLE / n_rows)) AS BIGINT) + 9 AS y FROM placed)
            UNION ALL SELECT 'text', x, y, x, y, CAST(step_num AS VARCHAR), 'white' FROM (SELECT *, CAST(floor(col * (1920.0::DOUBLE / n_cols) + 1920.0::DOUBLE / n_cols / 2) AS BIGINT) AS x, CAST(floor("row" * (1080.0::DOUBLE / n_rows) + 1080.0::DOUBLE / n_rows / 2) AS BIGINT) AS y FROM placed)"""
#: Ends of a digit's strokes in halves of its size, and which strokes it has.
STROKES = """strokes(s, a0, b0, a1, b1) AS (VALUES ('a', 0, 0, 2, 0), ('b', 2, 0, 2, 1), ('c', 2, 1, 2, 2), ('d', 0, 2, 2, 2), ('e', 0, 1, 0, 2), ('f', 0, 0, 0, 1), ('g', 0, 1, 2, 1)),
    digits(ch, segs) AS (VALUES ('0', 'abcdef'), ('1', 'bc'), ('2', 'abged'), ('3', 'abgcd'), ('4', 'fgbc'), ('5', 'afgcd'), ('6', 'afgedc'), ('7', 'abc'), ('8', 'abcdefg'), ('9', 'abcdfg'))"""
#: Sides of places on a border, each with its successor; see the outlines.  px and DIRS give cracks (e, nxt).
CRACKS = """dirs(side, nr, nc, lr, lc, ar, ac) AS (VALUES (0, -1, 0, -1, 1, 0, 1), (1, 0, 1, 1, 1, 1, 0), (2, 1, 0, 1, -1, 0, -1), (3, 0, -1, -1, -1, -1, 0)),
    cracks AS (SELECT p.id * 4 + side AS e, p."row" AS "row", p.col AS col, side, p.id AS id, CASE WHEN l.id IS NOT NULL THEN l.id * 4 + (side + 3) % 4 WHEN a.id IS NOT NULL THEN a.id * 4 + side ELSE p.id * 4 + (side + 1) % 4 END AS nxt
        FROM px p CROSS JOIN dirs LEFT JOIN px o ON o."row" = p."row" + nr AND o.col = p.col + nc LEFT JOIN px l ON l."row" = p."row" + lr AND l.col = p.col + lc LEFT JOIN px a ON a."row" = p."row" + ar AND a.col = p.col + ac WHERE o.id IS NULL),
    walk(start, e, idx) AS (SELECT e, e, 0 FROM cracks UNION ALL SELECT start, nxt, idx + 1 FROM walk JOIN cracks USING (e) WHERE nxt <> start),
    loops AS (SELECT * FROM (SELECT *, min(e) OVER (PARTITION BY start) AS least FROM walk) JOIN cracks USING (e) WHERE start = least)"""
MARKED = 'px AS (SELECT "row", col, "row" * 100000 + col AS id FROM vectors WHERE label >= 8), ' + REGIONS
PLACES = """places AS (SELECT a AS "row", b AS col FROM (SELECT unnest(range(n_rows)) AS a FROM shape), (SELECT unnest(range(n_cols)) AS b FROM shape))"""


def morphed(name: str, of: str, offsets: str) -> str:
    """Two common tables: `of` dilated, and eroded, by offsets (a, b)."""
    return f"""{name}_out AS (SELECT "row", col FROM places EXCEPT SELECT "row", col FROM {of}),
    {name}_wide AS (SELECT DISTINCT p."row", p.col FROM places p JOIN {of} m ON ({offsets.format("p", "m")})),
    {name}_thin AS (SELECT "row", col FROM {of} EXCEPT SELECT p."row", p.col FROM places p JOIN {name}_out m ON ({offsets.format("p", "m")}))"""


CROSS, BOX = 'abs({0}."row" - {1}."row") + abs({0}.col - {1}.col) <= 1', 'greatest(abs({0}."row" - {1}."row"), abs({0}.col - {1}.col)) <= 1'
OTSU = """SELECT img, v AS t FROM (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY round(w0 / w * ((w - w0) / w) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6) DESC, v) AS k FROM (
            SELECT img, v, sum(n) OVER c AS w0, sum(n * v) OVER c AS s0, sum(n) OVER (PARTITION BY img) AS w, sum(n * v) OVER (PARTITION BY img) AS s FROM levels WINDOW c AS (PARTITION BY img ORDER BY v)) WHERE w0 > 0 AND w0 < w) WHERE k = 1"""
TURN = "atan2((x - lx) * (nx_y - y) - (y - ly) * (nx - x), (x - lx) * (nx - x) + (y - ly) * (nx_y - y))"
COS30, SIN30 = math.cos(math.radians(30)), math.sin(math.radians(30))
STAGES = "CASE stage WHEN 'queued' THEN 0 WHEN 'preprocessing' THEN 5 WHEN 'matching' THEN 55 WHEN 'done' THEN 100 END"


def gauss() -> tuple[float, float]:
    side = math.exp(-1 / (2 * 0.8 * 0.8))
    return side / (1 + 2 * side), 1 / (1 + 2 * side)


def sql() -> dict[str, str]:
    """Name -> SQL; a pair is further common tables and the query, a string is a query over the views alone."""
    side, mid = gauss()
    weight = f"(CASE WHEN dr = 0 THEN {mid!r} ELSE {side!r} END * CASE WHEN dc = 0 THEN {mid!r} ELSE {side!r} END)"
    q: dict[str, str | tuple[str, str]] = {
        "coarse_topk": (COARSE, f'SELECT piece_id, "row", col, {r("coarse", "coarse")}, rk FROM coarse_rot WHERE rot = 0'),
        "coarse_topk_rot": (COARSE, f'SELECT piece_id, rot, "row", col, {r("coarse", "coarse")}, rk FROM coarse_rot'),
        "l2_normalize": f"SELECT vec_id, t AS tok, d AS dim, {r('u[t + 1][d + 1]', 'val')} FROM (SELECT vec_id, {UNIT.format('v')} AS u FROM vectors), (SELECT unnest(range(8)) AS t), (SELECT unnest(range(8)) AS d)",
        "mean_pool_cls": f"""SELECT "row", col, dim, {r("CASE WHEN l > 0 THEN x / l ELSE x END", "val")} FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY "row", col)) AS l FROM (
            SELECT "row", col, d AS dim, avg(cls[8 * t + d + 1]) AS x FROM cells, (SELECT unnest(range(8)) AS t), (SELECT unnest(range(8)) AS d) GROUP BY ALL))""",
        "token_cell_overlap": ("""steps AS (SELECT *, (3 * n_rows + 7) / n_rows AS sr, (3 * n_cols + 5) / n_cols AS sc FROM cells, shape)""", """SELECT "row", col, (r1 - r0) * (c1 - c0) AS n_tokens, r0, r1, c0, c1 FROM (SELECT "row", col,
            CAST(greatest(0, floor("row" * sr) - greatest(1, floor(sr * 0.1::DOUBLE))) AS BIGINT) AS r0, CAST(least(3 * n_rows + 7, floor(("row" + 1) * sr) + greatest(1, floor(sr * 0.1::DOUBLE))) AS BIGINT) AS r1,
            CAST(greatest(0, floor(col * sc) - greatest(1, floor(sc * 0.1::DOUBLE))) AS BIGINT) AS c0, CAST(least(3 * n_cols + 5, floor((col + 1) * sc) + greatest(1, floor(sc * 0.1::DOUBLE))) AS BIGINT) AS c1 FROM steps)"""),
        "fine_maxsim": (f"{COARSE}, {FINE}", f'SELECT piece_id, "row", col, {r("fine", "fine")} FROM fine WHERE rot = 0'),
        "coarse_to_fine": (f"{COARSE}, {FINE}", f'SELECT piece_id, rot, "row", col, {r("coarse", "coarse")}, {r("fine", "fine")} FROM fine'),
        "flat_side_score": (CANDIDATES, 'SELECT DISTINCT piece_id, "row", col, CAST(expected AS BIGINT) AS expected, flat FROM candidates'),
        "composite_score": (CANDIDATES, f'SELECT piece_id, rot, "row", col, {r("composite", "composite")}, {r("1 - composite", "cost")} FROM candidates'),
        "cost_matrix": (CANDIDATES, f"""SELECT piece_id, "row", col, {r("cost", "cost")}, {r("sum(cost) OVER p + (SELECT count(*) FROM cells) - count(*) OVER p", "row_total")} FROM (
            SELECT piece_id, "row", col, least(min(1 - composite), 1.0) AS cost FROM candidates GROUP BY ALL) WINDOW p AS (PARTITION BY piece_id)"""),
        "best_rotation": (f"{CANDIDATES}, {BEST}", f'SELECT piece_id, "row", col, rot, {r("fine", "fine")}, {r("flat", "flat")} FROM best'),
        "top3_candidates": (f"{CANDIDATES}, {BEST}", f'SELECT piece_id, rk, "row", col, rot, {r("composite", "composite")} FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY composite DESC, "row", col) AS rk FROM best) WHERE rk <= 3'),
        "unassigned_pieces": "SELECT piece_id FROM pieces WHERE piece_id NOT IN (SELECT piece_id FROM placed)",
        "flag_low_confidence": f"SELECT piece_id, {r('confidence', 'confidence')}, confidence < 0.55 AS flagged FROM matches",
        "confidence_stats": f"SELECT {r('avg(confidence)', 'mean')}, {r('min(confidence)', '\"min\"')}, {r('max(confidence)', '\"max\"')}, {r('stddev_pop(confidence)', 'std_pop')}, CAST(sum(CAST(confidence < 0.55 AS INT)) AS BIGINT) AS flagged_count, {r('avg(CAST(confidence < 0.55 AS INT))', 'flagged_fraction')} FROM matches",
        "confidence_bands": "SELECT CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM matches GROUP BY 1",
        "classify_position": """SELECT "row", col, piece_type, CAST(CASE piece_type WHEN 'corner' THEN 2 WHEN 'edge' THEN 1 ELSE 0 END AS BIGINT) AS expected FROM typed""",
        "class_counts": "SELECT piece_type, count(*) AS n FROM typed GROUP BY 1",
        "flat_side_mismatch": "SELECT * FROM (SELECT piece_id, CAST(CASE piece_type WHEN 'corner' THEN 2 WHEN 'edge' THEN 1 ELSE 0 END AS BIGINT) AS expected, flat_side_count AS actual FROM typed) WHERE expected <> actual",
        "grid_shape_search": (f"""counts AS (SELECT c_mktsegment AS key, count(*) AS n, sqrt(count(*) * {4 / 3!r}) AS cf, count(*) / sqrt(count(*) * {4 / 3!r}) AS rf FROM customer GROUP BY 1),
            tried AS (SELECT key, n, cf, rf, CAST(floor(rf) AS BIGINT) + i AS r, CAST(floor(cf) AS BIGINT) + j AS c, 1 AS seq FROM counts, (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j)
                WHERE floor(rf) + i BETWEEN 2 AND 100 AND floor(cf) + j BETWEEN 2 AND 100
                UNION ALL SELECT key, n, cf, rf, CAST(round_even(rf, 0) AS BIGINT), CAST(round_even(cf, 0) AS BIGINT), 0 FROM counts)""",
            f"""SELECT key, r AS rows, c AS cols, {r("abs(r * c - n) / n * 100", "diff_pct")} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(r * c - n), abs(CASE WHEN r > 0 THEN c / r ELSE 0 END - cf / rf), seq, r, c) AS k FROM tried) WHERE k = 1"""),
        "grid_override_check": f"""SELECT id, rows, cols, CASE WHEN rows NOT BETWEEN 2 AND 100 OR cols NOT BETWEEN 2 AND 100 THEN 'out_of_range' WHEN d > 15 THEN 'high_deviation' ELSE 'ok' END AS status, {r("d", "diff_pct")} FROM (
            SELECT *, abs(rows * cols - n) / n * 100 AS d FROM (SELECT c_custkey AS id, 1 + c_custkey % 110 AS rows, 1 + c_custkey * 7 % 40 AS cols, 10 + c_custkey * 13 % 1500 AS n FROM customer))""",
        "infer_grid_shape": "SELECT n_rows, n_cols FROM shape",
        "grid_pixel_map": """SELECT "row", col, x, y, CAST(greatest(0, least(floor(y / (1080.0::DOUBLE / n_rows)), n_rows - 1)) AS BIGINT) AS back_row, CAST(greatest(0, least(floor(x / (1920.0::DOUBLE / n_cols)), n_cols - 1)) AS BIGINT) AS back_col
            FROM (SELECT *, CAST(floor(col * (1920.0::DOUBLE / n_cols)) AS BIGINT) AS x, CAST(floor("row" * (1080.0::DOUBLE / n_rows)) AS BIGINT) AS y FROM vectors, shape)""",
        "bbox_clamp": f"""SELECT box_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area, {r("CASE WHEN h > 0 THEN w / h ELSE 0 END", "aspect")} FROM (SELECT o_orderkey AS box_id, greatest(0, o_custkey % 1900 - 8) AS x1, greatest(0, o_orderkey % 1060 - 8) AS y1,
            least(1920, o_custkey % 1900 + 1 + o_custkey % 50 + 8) AS x2, least(1080, o_orderkey % 1060 + 1 + o_orderkey % 50 + 8) AS y2, 1 + o_custkey % 50 AS w, 1 + o_orderkey % 50 AS h FROM orders)""",
        "rotate_coords": """SELECT "row", col, k, CASE k WHEN 0 THEN "row" WHEN 1 THEN n_cols - 1 - col WHEN 2 THEN n_rows - 1 - "row" ELSE col END AS row2, CASE k WHEN 0 THEN col WHEN 1 THEN "row" WHEN 2 THEN n_cols - 1 - col ELSE n_rows - 1 - "row" END AS col2 FROM cells, shape, (SELECT unnest(range(4)) AS k)""",
        "neighbor_pairs": (PAIRS, "SELECT a, b, CAST(side_a AS BIGINT) AS side_a, CAST(side_b AS BIGINT) AS side_b FROM pairs"),
        "neighbor_map": (PAIRS, "SELECT piece_id, count(*) AS n_pairs FROM (SELECT a AS piece_id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1"),
        "pair_scores": (SCORED, f"SELECT a, b, {r('hist', 'hist')}, {r('curv', 'curv')}, {r('combined', 'combined')} FROM scored"),
        "attach_scores": (SCORED, f"""SELECT piece_id, {r("coalesce(avg(hist), 0.5)", "adjacency")}, {r("coalesce(avg(curv), 0.5)", "curv")}, {r("coalesce(avg(combined), 1.0)", "neighborhood")}
            FROM pieces LEFT JOIN (SELECT a AS piece_id, hist, curv, combined FROM scored UNION ALL SELECT b, hist, curv, combined FROM scored) USING (piece_id) GROUP BY piece_id"""),
        "worst_pair": (SCORED, f"SELECT a, b, {r('combined', 'combined')} FROM scored ORDER BY scored.combined, a, b LIMIT 1"),
        "curvature_complement": (SCORED, f"SELECT a, b, {r('curv', 'score')} FROM curv"),
        "hist256": (HIST.format("img, c"), "SELECT img, c, v, n FROM levels"),
        "cdf": (HIST.format("img, c"), f"SELECT img, c, v, {r('cdf', 'cdf')} FROM cdfs"),
        "hist_match_lut": (LUT, "SELECT c, i, j FROM lut"),
        "hist_match_apply": (LUT, "SELECT p.c, j AS v_new, CAST(count(*) AS BIGINT) AS n FROM pixels p JOIN lut ON lut.c = p.c AND lut.i = p.v WHERE img = 'A' GROUP BY 1, 2"),
        "hist32_norm": (BINS, f"SELECT img, c, bin, {r('p', 'p')} FROM bins"),
        "hist_intersection": (BINS, f"SELECT x.img AS img_a, y.img AS img_b, {r('least(sum(least(x.p, y.p)), 1.0)', 'score')}, {r('sum(least(x.p, y.p)) / 2', 'score_mean')} FROM bins x JOIN bins y ON x.c = y.c AND x.bin = y.bin AND x.img < y.img GROUP BY 1, 2"),
        "otsu_threshold": (HIST.format("img"), OTSU),
        "gray_levels": """SELECT img, gray, count(*) AS n FROM (SELECT img, block, CAST(floor(round(0.114::DOUBLE * coalesce(avg(v) FILTER (c = 'F'), 0.0) + 0.587::DOUBLE * coalesce(avg(v) FILTER (c = 'O'), 0.0), 6)) AS BIGINT) AS gray FROM pixels GROUP BY img, block) GROUP BY 1, 2""",
        "area_downscale": f"""SELECT "row" // 2 AS "row", col // 2 AS col, {r("avg(v)", "avg")} FROM raster GROUP BY "row" // 2, col // 2""",
        "gaussian_blur3": (f"""looks AS (SELECT s."row", s.col, {weight} AS wt, CASE WHEN s."row" + dr < 0 THEN 1 WHEN s."row" + dr >= n_rows THEN n_rows - 2 ELSE s."row" + dr END AS r, CASE WHEN s.col + dc < 0 THEN 1 WHEN s.col + dc >= n_cols THEN n_cols - 2 ELSE s.col + dc END AS c
            FROM (SELECT a AS "row", b AS col FROM (SELECT unnest(range(n_rows)) AS a FROM shape), (SELECT unnest(range(n_cols)) AS b FROM shape)) s, shape, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc))""",
            f"""SELECT l."row", l.col, {r("sum(wt * v)", "val")} FROM looks l JOIN raster x ON x."row" = l.r AND x.col = l.c GROUP BY 1, 2"""),
        "alpha_composite": """SELECT "row", col, CAST(floor(v * m + 128 * (1 - m)) AS BIGINT) AS val FROM raster JOIN raster_mask USING ("row", col)""",
        "boundary_strip": (f"""strip AS (SELECT x.*, n_rows, n_cols, greatest(1, least(10, n_rows // 4, n_cols // 4)) AS wd FROM raster x JOIN raster_mask USING ("row", col), shape WHERE m > 0)""",
            f"""SELECT CAST(side AS BIGINT) AS side, count(*) AS n, {r("avg(v)", "mean")} FROM (SELECT 0 AS side, v FROM strip WHERE "row" < wd UNION ALL SELECT 1, v FROM strip WHERE col >= n_cols - wd UNION ALL SELECT 2, v FROM strip WHERE "row" >= n_rows - wd UNION ALL SELECT 3, v FROM strip WHERE col < wd) GROUP BY side"""),
        "signed_curvature": f"""SELECT user_id, idx, {r(TURN, "kappa")} FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lead(x) OVER w AS nx, lead(y) OVER w AS nx_y FROM contours WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE lx IS NOT NULL AND nx IS NOT NULL
            UNION ALL SELECT user_id, 0, 0.0 FROM contours GROUP BY user_id HAVING count(*) < 3""",
        "corner_angles": (WRAP, f"""SELECT user_id, idx, {r("degrees(acos(CASE WHEN s > 0 THEN greatest(-1.0, least(1.0, ((xp - x) * (xn - x) + (yp - y) * (yn - y)) / s)) ELSE 1.0 END))", "angle_deg")} FROM (
            SELECT *, sqrt((xp - x) * (xp - x) + (yp - y) * (yp - y)) * sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y)) AS s FROM wrapped)"""),
        "nearest_point": (NEAREST, "SELECT user_id, CAST(corner AS BIGINT) AS corner, idx FROM nearest"),
        "side_segments": (NEAREST, """SELECT user_id, row_number() OVER w - 1 AS side, CASE WHEN lead(idx) OVER w IS NOT NULL THEN lead(idx) OVER w - idx + 1 ELSE n - idx + min(idx) OVER (PARTITION BY user_id) + 1 END AS n_points
            FROM (SELECT DISTINCT user_id, idx FROM nearest) JOIN (SELECT user_id, count(*) AS n FROM contours GROUP BY 1) USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY idx)"""),
        "mean_center": f"SELECT vec_id, side, idx, {r('k - avg(k) OVER (PARTITION BY vec_id, side)', 'k')} FROM sides",
        "resample_linear": f"""SELECT vec_id, side, s, {r("a.k + (b.k - a.k) * (p - lo)", "k")} FROM (SELECT s, s * 15 / 31.0::DOUBLE AS p, CAST(floor(s * 15 / 31.0::DOUBLE) AS BIGINT) AS lo FROM (SELECT unnest(range(32)) AS s)), sides a JOIN sides b USING (vec_id, side) WHERE a.idx = lo AND b.idx = least(lo + 1, 15)""",
        "classify_side": (FLAT, f"SELECT vec_id, side, is_flat, {r('k', 'peak')} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, side ORDER BY round(abs(k), 9) DESC, idx) AS n FROM sides) JOIN flats USING (vec_id, side) WHERE n = 1"),
        "flat_side_count": (FLAT, "SELECT vec_id, CAST(sum(CAST(is_flat AS INT)) AS BIGINT) AS flat_side_count FROM flats GROUP BY 1"),
        "polygon_area_perimeter": (WRAP, f"""SELECT user_id, {r("area", "area")}, {r("per", "perimeter")}, {r("CASE WHEN per > 0 THEN 4 * pi() * area / (per * per) ELSE 0 END", "compactness")} FROM (
            SELECT user_id, abs(sum(x * yn - xn * y)) / 2 AS area, sum(sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y))) AS per FROM wrapped GROUP BY user_id)"""),
        "pca_orientation": f"SELECT user_id, {r('CASE WHEN a < 0 THEN a + 180 ELSE a END', 'angle_mod180')} FROM (SELECT user_id, degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) AS a FROM contours GROUP BY 1)",
        "mask_area_filter": "SELECT mask_id, CASE WHEN area NOT BETWEEN 1000 AND 200000 THEN 'area' WHEN solidity < 0.60 THEN 'solidity' WHEN (CASE WHEN h > 0 THEN w / h ELSE 0 END) NOT BETWEEN 0.20 AND 5.0 THEN 'aspect' ELSE 'kept' END AS kept_reason FROM mask_rows",
        "overlap_coefficient": (OVERLAP, f"SELECT a, b, inter, {r('ov', 'ov')} FROM over_ WHERE ov > 0.30"),
        "dedup_overlap": (f"""{OVERLAP}, scored AS (SELECT DISTINCT mask_id, -solidity AS s FROM mask_rows), links AS MATERIALIZED (SELECT a, b FROM over_ WHERE ov > 0.30 UNION ALL SELECT b, a FROM over_ WHERE ov > 0.30),
            arcs AS MATERIALIZED (SELECT a AS weak, b AS strong FROM links JOIN scored x ON x.mask_id = a JOIN scored y ON y.mask_id = b WHERE (y.s, b) < (x.s, a)),
            rounds(k, m, st) AS (SELECT 0, mask_id, 0 FROM scored UNION ALL SELECT r.k + 1, r.m, CASE WHEN r.st <> 0 THEN r.st WHEN bool_or(coalesce(s.st = 1, FALSE)) THEN 2 WHEN bool_or(coalesce(s.st = 0, FALSE)) THEN 0 ELSE 1 END
                FROM rounds r LEFT JOIN arcs ON weak = r.m LEFT JOIN rounds s ON s.m = strong WHERE (SELECT count(*) FROM rounds WHERE st = 0) > 0 GROUP BY r.k, r.m, r.st)""", "SELECT m AS mask_id FROM rounds WHERE k = (SELECT max(k) FROM rounds) AND st = 1"),
        "connected_components": (f"""{OVERLAP}, links AS MATERIALIZED (SELECT a, b FROM over_ WHERE ov > 0.5 AND inter >= 2 UNION SELECT b, a FROM over_ WHERE ov > 0.5 AND inter >= 2),
            reach(node, root) AS (SELECT a, a FROM links UNION SELECT b, root FROM reach JOIN links ON a = node)""", "SELECT component, count(*) AS n FROM (SELECT node, min(root) AS component FROM reach GROUP BY node) GROUP BY component"),
        "split_replace_union": ("""children AS (SELECT DISTINCT l_orderkey AS parent_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS child, CAST(floor(l_extendedprice) AS BIGINT) AS area FROM lineitem),
            valid AS (SELECT c.* FROM children c JOIN mask_rows m ON m.mask_id = parent_id WHERE c.area >= 30000 AND c.area >= 0.15 * m.area), many AS (SELECT parent_id FROM valid GROUP BY 1 HAVING count(*) >= 2)""",
            "SELECT concat_ws('/', parent_id, child) AS mask_id, parent_id, true AS refined FROM valid WHERE parent_id IN (FROM many) UNION ALL SELECT CAST(mask_id AS VARCHAR), NULL, false FROM mask_rows WHERE mask_id NOT IN (FROM many)"),
        "bfs_levels": (BFS, "SELECT job_id, piece_id, CAST(level AS BIGINT) AS level FROM levels"),
        "unreached_anti": (BFS, "SELECT piece_id FROM seated WHERE piece_id NOT IN (SELECT piece_id FROM levels)"),
        "inner_distances": ("""px AS (SELECT "row" // 16 * 1000000 + col // 16 AS image, "row", col FROM raster_mask WHERE m > 0),
            free AS (SELECT t.image, a + t.r0 AS "row", b + t.c0 AS col FROM (SELECT DISTINCT image, "row" // 16 * 16 AS r0, col // 16 * 16 AS c0 FROM px) t, (SELECT unnest(range(-1, 17)) AS a), (SELECT unnest(range(-1, 17)) AS b)
                EXCEPT SELECT image, "row", col FROM px)""",
            'SELECT p.image, p."row", p.col, min(abs(p."row" - f."row") + abs(p.col - f.col)) AS distance FROM px p JOIN free f USING (image) GROUP BY ALL'),
        "bfs_frontier": (STEPS, "SELECT job_id, step_num, piece_id, level FROM steps LEFT JOIN (SELECT piece_id, any_value(level) AS level FROM ranked GROUP BY piece_id) USING (piece_id)"),
        "bfs_order": (STEPS, "SELECT job_id, step_num, piece_id FROM steps"),
        "assembly_steps": (STEPS, 'SELECT job_id, step_num, piece_id, "row", col, piece_type, confidence < 0.55 AS flagged FROM steps'),
        "candidate_rank": (f"{COARSE}, {FINE}", 'SELECT piece_id, "row", col, row_number() OVER (PARTITION BY piece_id ORDER BY round(fine, 9) DESC, rk) AS place FROM fine WHERE rot = 0'),
        "pca_reduce": f"SELECT count(*) AS n_dims, max(n) AS n, {r('sum(var)', 'variance')}, 0.0::DOUBLE AS mean, true AS falls FROM (SELECT d, count(*) AS n, var_pop(v[d + 1]) AS var FROM vectors, (SELECT unnest(range(64)) AS d) GROUP BY d)",
        "reference_cells": (f"""tokens AS (SELECT "row" AS y, col AS x, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS u FROM vectors),
            windows AS (SELECT a AS "row", b AS col, greatest(0, floor(a * (h / 5)) - greatest(1, floor(h / 5 * 0.1::DOUBLE))) AS r0, least(h, floor((a + 1) * (h / 5)) + greatest(1, floor(h / 5 * 0.1::DOUBLE))) AS r1,
                greatest(0, floor(b * (w / 6)) - greatest(1, floor(w / 6 * 0.1::DOUBLE))) AS c0, least(w, floor((b + 1) * (w / 6)) + greatest(1, floor(w / 6 * 0.1::DOUBLE))) AS c1
                FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(6)) AS b), (SELECT n_rows AS h, n_cols AS w FROM shape)),
            means AS (SELECT "row", col, d, avg(u[d + 1]) AS e, count(*) AS n FROM windows JOIN tokens ON y >= r0 AND y < r1 AND x >= c0 AND x < c1, (SELECT unnest(range(64)) AS d) GROUP BY "row", col, d)""",
            f"""SELECT "row", col, n AS n_tokens, d AS dim, {r('e / sqrt(sum(e * e) OVER (PARTITION BY "row", col))', "val")} FROM means"""),
        "component_stats": (MARKED, "SELECT row0 * 100000 + col0 AS component, * EXCLUDE (component) FROM stats"),
        "component_area_filter": (MARKED, "SELECT row0, col0, row1, col1, area FROM stats, shape WHERE area BETWEEN floor(n_rows * n_cols * 0.004::DOUBLE) AND floor(n_rows * n_cols * 0.05::DOUBLE)"),
        "extract_pieces": (MARKED, "SELECT row_number() OVER (ORDER BY component) - 1 AS piece_id, area, greatest(0, row0 - 8) AS y0, greatest(0, col0 - 8) AS x0, least(n_rows, row1 + 9) AS y1, least(n_cols, col1 + 9) AS x1 FROM stats, shape"),
        "piece_outlines": (f"""px AS (SELECT "row", col, "row" * 100000 + col AS id FROM raster_mask WHERE m > 0), {CRACKS}""", """SELECT start // 4 // 100000 AS row0, start // 4 % 100000 AS col0, start % 4 AS side0,
            sum(CASE side WHEN 0 THEN -("row") WHEN 2 THEN "row" + 1 ELSE 0 END) OVER (PARTITION BY start) > 0 AS "outer", idx, "row" + CAST(side IN (2, 3) AS BIGINT) AS y, col + CAST(side IN (1, 2) AS BIGINT) AS x FROM loops"""),
        "piece_descriptors": (f"""{MARKED}, {CRACKS},
            steps AS (SELECT l.start, l.id, l."row" AS r, l.col AS c, l.side, l.nxt // 4 // 100000 AS r2, l.nxt // 4 % 100000 AS c2 FROM loops l),
            named AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
            rings AS (SELECT component, start, sum(CASE side WHEN 0 THEN -r WHEN 2 THEN r + 1 ELSE 0 END) AS crack, abs(sum(c * r2 - c2 * r)) / 2 AS area, sum(sqrt((r2 - r) ** 2 + (c2 - c) ** 2)) AS perimeter FROM steps JOIN named ON node = id GROUP BY component, start),
            outers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY area DESC, start) AS n FROM rings WHERE crack > 0) WHERE n = 1),
            pts AS (SELECT DISTINCT component, r, c FROM steps JOIN named ON node = id),
            hull_edges AS (SELECT p.component, p.r AS r1, p.c AS c1, q.r AS r2, q.c AS c2 FROM pts p JOIN pts q ON p.component = q.component AND (p.r, p.c) <> (q.r, q.c)
                WHERE NOT EXISTS (SELECT 1 FROM pts z WHERE z.component = p.component AND ((q.c - p.c) * (z.r - p.r) - (q.r - p.r) * (z.c - p.c) < 0
                    OR ((q.c - p.c) * (z.r - p.r) - (q.r - p.r) * (z.c - p.c) = 0 AND ((z.r - p.r) * (q.r - p.r) + (z.c - p.c) * (q.c - p.c) < 0 OR (z.r - p.r) ** 2 + (z.c - p.c) ** 2 > (q.r - p.r) ** 2 + (q.c - p.c) ** 2))))),
            hull AS (SELECT component, sum(c1 * r2 - c2 * r1) / 2 AS hull_area FROM hull_edges GROUP BY component)""", f"""SELECT row_number() OVER (ORDER BY component) - 1 AS piece_id, greatest(0, row0 - 8) AS y0, greatest(0, col0 - 8) AS x0, least(n_rows, row1 + 9) AS y1, least(n_cols, col1 + 9) AS x1,
            stats.area AS pixels, (SELECT count(*) FROM rings g WHERE g.component = stats.component AND crack < 0) AS holes, {r("o.area", "area")}, {r("perimeter", "perimeter")},
            {r("CASE WHEN perimeter > 0 THEN 4 * pi() * o.area / perimeter / perimeter ELSE 0 END", "compactness")}, {r("CASE WHEN hull_area > 0 THEN o.area / hull_area ELSE 0 END", "solidity")}
            FROM stats JOIN outers o USING (component) LEFT JOIN hull USING (component), shape"""),
        "crop_pixels": (f"""{MARKED}, named AS (SELECT node, min(root) AS component FROM reach GROUP BY node), boxes AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS piece_id, greatest(0, row0 - 8) AS y0, greatest(0, col0 - 8) AS x0, least(n_rows, row1 + 9) AS y1, least(n_cols, col1 + 9) AS x1 FROM stats, shape)""",
            """SELECT piece_id, "row" - y0 AS y, col - x0 AS x, v, CASE WHEN n.component = b.component THEN 255 ELSE 0 END AS alpha FROM boxes b JOIN raster p ON "row" >= y0 AND "row" < y1 AND col >= x0 AND col < x1 LEFT JOIN named n ON n.node = "row" * 100000 + col"""),
        "threshold_components": (f"""marks AS (SELECT 0 AS img, CAST(v AS BIGINT) AS v FROM raster), {HIST.format("img").replace("pixels", "marks")}, cut AS ({OTSU}),
            bright AS (SELECT "row", col FROM raster, cut WHERE raster.v > t + 8), {PLACES}, {morphed("dil", "bright", CROSS)}, {morphed("ero", "dil_wide", CROSS)},
            px AS (SELECT "row", col, "row" * 100000 + col AS id FROM ero_thin), {REGIONS}""", "SELECT * EXCLUDE (component) FROM stats WHERE area >= 2"),
        "mask_subtract": (f"""{PLACES}, marked AS (SELECT "row", col FROM raster_mask WHERE m > 0), {morphed("m", "marked", BOX)}""", 'SELECT "row", col FROM m_wide EXCEPT SELECT "row", col FROM m_thin'),
        "area_resize": (f"""sized AS (SELECT *, CAST(greatest(1, floor(n_rows * least(1.0, 16 / greatest(n_rows, n_cols)) + 0.5)) AS BIGINT) AS h, CAST(greatest(1, floor(n_cols * least(1.0, 16 / greatest(n_rows, n_cols)) + 0.5)) AS BIGINT) AS w FROM shape),
            parts AS (SELECT k, l, v, (least(("row" + 1) * h / n_rows, k + 1) - greatest("row" * h / n_rows, k)) AS a, (least((col + 1) * w / n_cols, l + 1) - greatest(col * w / n_cols, l)) AS b
                FROM raster, sized, (SELECT unnest(range(h)) AS k FROM sized), (SELECT unnest(range(w)) AS l FROM sized))""",
            f"""SELECT k AS "row", l AS col, {r("sum(v * a * b) / sum(a * b)", "v")} FROM parts WHERE a > 1e-9 AND b > 1e-9 GROUP BY k, l"""),
        "rotate_raster": (f"""canvas AS (SELECT n_rows AS h, n_cols AS w, CAST(ceil(n_rows * {COS30!r} + n_cols * {SIN30!r} - 1e-9) AS BIGINT) AS hh, CAST(ceil(n_rows * {SIN30!r} + n_cols * {COS30!r} - 1e-9) AS BIGINT) AS ww FROM shape),
            looks AS (SELECT a AS "row", b AS col, {SIN30!r} * (b - (ww - 1) / 2) + {COS30!r} * (a - (hh - 1) / 2) + (h - 1) / 2 AS y, {COS30!r} * (b - (ww - 1) / 2) - {SIN30!r} * (a - (hh - 1) / 2) + (w - 1) / 2 AS x
                FROM canvas, (SELECT unnest(range(hh)) AS a FROM canvas), (SELECT unnest(range(ww)) AS b FROM canvas))""",
            'SELECT l."row", l.col, coalesce(v, 128.0::DOUBLE) AS v FROM looks l LEFT JOIN raster p ON p."row" = floor(round(y, 9) + 0.5) AND p.col = floor(round(x, 9) + 0.5)'),
        "analyze_sides": (FLAT, f"""SELECT vec_id, side, is_flat, {r("peak", "peak")}, {r("size", "size")}, {r("last", "last")}, CAST(sum(CAST(is_flat AS INT)) OVER (PARTITION BY vec_id) AS BIGINT) AS flat_sides FROM flats
            JOIN (SELECT vec_id, side, k AS peak FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, side ORDER BY round(abs(k), 9) DESC, idx) AS n FROM sides) WHERE n = 1) USING (vec_id, side)
            JOIN (SELECT vec_id, side, sum(abs(a.k + (b.k - a.k) * (p - lo))) AS size, max(b.k) FILTER (s = 31) AS last FROM (SELECT s, s * 15 / 31.0::DOUBLE AS p, CAST(floor(s * 15 / 31.0::DOUBLE) AS BIGINT) AS lo FROM (SELECT unnest(range(32)) AS s)),
                (SELECT * REPLACE (k - avg(k) OVER (PARTITION BY vec_id, side) AS k) FROM sides) a JOIN (SELECT * REPLACE (k - avg(k) OVER (PARTITION BY vec_id, side) AS k) FROM sides) b USING (vec_id, side)
                WHERE a.idx = lo AND b.idx = least(lo + 1, 15) GROUP BY vec_id, side) USING (vec_id, side)"""),
        "contour_dents": (WRAP + """, pts AS (SELECT DISTINCT user_id, x, y FROM contours),
            edges AS (SELECT p.user_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM pts p JOIN pts q ON p.user_id = q.user_id AND (p.x, p.y) <> (q.x, q.y)
                WHERE NOT EXISTS (SELECT 1 FROM pts z WHERE z.user_id = p.user_id AND ((q.x - p.x) * (z.y - p.y) - (q.y - p.y) * (z.x - p.x) < 0
                    OR ((q.x - p.x) * (z.y - p.y) - (q.y - p.y) * (z.x - p.x) = 0 AND ((z.x - p.x) * (q.x - p.x) + (z.y - p.y) * (q.y - p.y) < 0 OR (z.x - p.x) ** 2 + (z.y - p.y) ** 2 > (q.x - p.x) ** 2 + (q.y - p.y) ** 2))))),
            hull AS (SELECT user_id, sum(x1 * y2 - x2 * y1) / 2 AS hull_area, count(*) AS n FROM edges GROUP BY user_id),
            marked AS (SELECT c.user_id, idx, c.x, c.y, CASE WHEN e.user_id IS NOT NULL THEN idx END AS h FROM contours c LEFT JOIN (SELECT DISTINCT user_id, x1, y1 FROM edges) e ON e.user_id = c.user_id AND x1 = c.x AND y1 = c.y),
            between_ AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), max(h) OVER (PARTITION BY user_id)) AS i, coalesce(first_value(h IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(h) OVER (PARTITION BY user_id)) AS j FROM marked WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
            depths AS (SELECT m.user_id, max(CASE WHEN (b.x - a.x) ** 2 + (b.y - a.y) ** 2 > 0 THEN abs((b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) ELSE sqrt((m.x - a.x) ** 2 + (m.y - a.y) ** 2) END) AS d
                FROM between_ m JOIN contours a ON a.user_id = m.user_id AND a.idx = m.i JOIN contours b ON b.user_id = m.user_id AND b.idx = m.j WHERE h IS NULL GROUP BY m.user_id),
            shaped AS (SELECT user_id, abs(sum(x * yn - xn * y)) / 2 AS area, sum(sqrt((xn - x) ** 2 + (yn - y) ** 2)) AS perimeter FROM wrapped GROUP BY user_id),
            full_ AS (SELECT *, CASE WHEN n > 2 AND hull_area > 0 THEN area / hull_area ELSE 0 END AS so, CASE WHEN n > 2 AND hull_area > 0 THEN coalesce(d, 0) ELSE 0 END AS de FROM shaped LEFT JOIN hull USING (user_id) LEFT JOIN depths USING (user_id))""",
            f"""SELECT user_id, {r("so", "solidity")}, {r("de", "dent")}, de > 0.08 * perimeter AS merged FROM full_"""),
        "largest_contour": (WRAP, f"""SELECT image, user_id AS contour, {r("area", "area")} FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(area, 6) DESC, user_id) AS n
            FROM (SELECT user_id, user_id % 10 AS image, abs(sum(x * yn - xn * y)) / 2 AS area FROM wrapped GROUP BY user_id)) WHERE n = 1"""),
        "missing_files": """SELECT page_id AS id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages WHERE regexp_replace(url, '^[a-z]+://[^/]*/?', '') NOT IN (SELECT regexp_replace(url, '^[a-z]+://[^/]*/?', '') FROM pages WHERE page_id % 7 <> 0)""",
        "manifest_stats": """SELECT count(*) AS total, CAST(sum(CAST(flagged AS INT)) AS BIGINT) AS flagged, round(avg(confidence), 4) AS mean, round(min(confidence), 4) AS "min", round(max(confidence), 4) AS "max",
            count(*) FILTER (piece_type = 'corner') AS corners, count(*) FILTER (piece_type = 'edge') AS edges, count(*) FILTER (piece_type = 'interior') AS interior FROM placed""",
        "manifest_json": 'SELECT piece_id, "row", col FROM placed',
        "step_labels": """SELECT step_num, format('Step {} ({},{}) R0 {} conf:{:.2f}', step_num, "row", col, piece_type, round(confidence, 2)) AS label FROM placed""",
        "asset_urls": "SELECT step_num, format('/assets/job/step_cards/step_{:04d}.jpg', step_num) AS card_url, format('/assets/job/pieces/piece_{:04d}.jpg', piece_id) AS crop_url FROM placed",
        "draw_commands": COMMANDS,
        "draw_pixels": (f"""cmds AS ({COMMANDS}), {STROKES}, chars AS (SELECT *, unnest(range(len(text))) AS k FROM cmds WHERE kind = 'text'),
            ends AS (SELECT 1 AS z, x0, y0, x1, y1, '' AS text, y0 AS zy, x0 AS zx, y1 AS zy1, x1 AS zx1, colour FROM cmds WHERE kind = 'line' UNION ALL
                SELECT 3, x0 + k * 6 + a0 * 2, y0 + b0 * 4, x0 + k * 6 + a1 * 2, y0 + b1 * 4, text, y0, x0, y1, x1, colour FROM chars JOIN digits ON ch = text[k + 1] JOIN strokes ON contains(segs, s)),
            stepped AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, unnest(range(greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) AS t FROM ends),
            covered AS (SELECT CASE WHEN n = 0 THEN y0 ELSE y0 + CAST(floor((2 * (y1 - y0) * t + n) / (2 * n)) AS BIGINT) END AS "row", CASE WHEN n = 0 THEN x0 ELSE x0 + CAST(floor((2 * (x1 - x0) * t + n) / (2 * n)) AS BIGINT) END AS col, (z, zy, zx, zy1, zx1, text, colour) AS o, colour FROM stepped UNION ALL
                SELECT y0 + a, x0 + b, (2, y0, x0, y1, x1, '', colour), colour FROM cmds, (SELECT unnest(range(-6, 7)) AS a), (SELECT unnest(range(-6, 7)) AS b) WHERE kind = 'dot' AND a * a + b * b <= 36)""",
            'SELECT "row", col, arg_max(colour, o) AS colour FROM covered WHERE "row" BETWEEN 0 AND 1079 AND col BETWEEN 0 AND 1919 GROUP BY "row", col'),
        "png_pixels": 'SELECT "row", col, v FROM raster',
        "jpeg_tiles": """SELECT ("row" // 16) || '-' || (col // 16) AS path, count(*) * 3 AS n, TRUE AS "close" FROM raster GROUP BY ALL""",
        "inspect_images": ("""tiled AS (SELECT DISTINCT ("row" // 16) || '-' || (col // 16) AS path, "row" // 16 * 3 + col // 16 AS k FROM raster),
            kinds(i, fmt) AS (VALUES (0, 'png'), (1, 'jpeg'), (2, 'ppm'))""",
            """SELECT path || '.' || fmt AS path, CASE WHEN (k + i) % 7 <> 0 AND fmt <> 'ppm' THEN fmt END AS fmt, error_code, CAST(422 AS BIGINT) AS http_code FROM (SELECT *,
            CASE WHEN (k + i) % 7 = 0 THEN 'empty' WHEN fmt = 'ppm' THEN 'format' WHEN (k + i) % 5 = 0 THEN 'decode' ELSE 'too_small' END AS error_code FROM tiled, kinds)"""),
        "asset_guard": ("""paths AS (SELECT regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages UNION
            SELECT unnest(['../etc/passwd', 'a/../../b.png', '/abs.png', 'step_cards/step_0001.jpg', 'x.JPEG', 'noext', 'a.svg', 'dir.png/readme', '.jpg', 'C:x.png'])),
            parts AS (SELECT path, string_split(replace(path, chr(92), '/'), '/') AS s FROM paths)""",
            """SELECT path, reason = 'ok' AS allowed, reason FROM (SELECT path, CASE WHEN list_contains(s, '..') OR starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') THEN 'traversal'
            WHEN instr(s[-1][2:], '.') = 0 OR NOT regexp_matches(lower(s[-1]), '\\.(jpg|jpeg|png|json|webp)$') THEN 'extension' ELSE 'ok' END AS reason FROM parts)"""),
        "detect_format": ("""odd AS (SELECT page_id AS id, hex(encode(html)) AS h FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'FFD8FFE0'), (-2, '89504E470D0A1A0A'), (-3, '524946460000000057454250'), (-4, '524946460000000057415645'), (-5, ''), (-6, '424D'), (-7, 'FFD8')))""",
            "SELECT CAST(id AS BIGINT) AS id, CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '89504E47') THEN 'png' WHEN starts_with(h, '52494646') AND h[17:24] = '57454250' THEN 'webp' END AS fmt FROM odd"),
        "validate_chain": f"""SELECT id, error_code, CAST(CASE WHEN error_code IS NULL THEN 200 ELSE 422 END AS BIGINT) AS http_code FROM (SELECT id, CASE WHEN size = 0 THEN 'empty' WHEN size > {50 * 1024 * 1024} THEN 'too_large' WHEN bad THEN 'format' WHEN h IS NULL THEN 'decode' WHEN ch <> 3 THEN 'channels'
            WHEN least(h, w) < 64 THEN 'too_small' WHEN greatest(h, w) > 16000 THEN 'too_wide' END AS error_code FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 200) AS BIGINT) END AS size, o_orderkey % 5 = 0 AS bad,
            CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 3 END AS ch, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 400 END AS h, o_orderkey % 17000 AS w FROM orders))""",
        "job_latest_state": "SELECT job_id, arg_max(stage, (ts, seq)) FILTER (stage IS NOT NULL) AS stage, arg_max(progress, (ts, seq)) FILTER (progress IS NOT NULL) AS progress, arg_max(error, (ts, seq)) FILTER (error IS NOT NULL) AS error, epoch_us(max(ts)) AS updated_us FROM job_events GROUP BY job_id",
        "job_stage_progress": f"""SELECT job_id, seq AS event_id, CAST(coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS progress,
            CASE stage WHEN 'queued' THEN 'pending' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status FROM (SELECT *, coalesce(progress, {STAGES}) AS told FROM job_events)""",
        "job_ttl_expiry": """SELECT job_id, CAST(sum(CAST(coalesce(gap, 0) > 86400000000 AS INT)) AS BIGINT) AS expiry_gaps, (SELECT epoch_us(max(ts)) FROM events) - max(us) <= 86400000000 AS alive_at_end
            FROM (SELECT job_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, seq) AS gap FROM job_events) GROUP BY job_id""",
        "correction_precondition": """SELECT c_custkey AS job_id, e AS error, CAST(CASE e WHEN 'job_not_found' THEN 404 WHEN 'conflict' THEN 409 ELSE 200 END AS BIGINT) AS http_code FROM (
            SELECT c_custkey, CASE WHEN stage IS NULL THEN 'job_not_found' WHEN stage <> 'done' THEN 'conflict' END AS e FROM customer LEFT JOIN (SELECT job_id, arg_max(stage, (ts, seq)) AS stage FROM job_events GROUP BY 1) ON job_id = c_custkey)""",
        "correction_override": """SELECT piece_id, "row", col, count(*) OVER (PARTITION BY "row", col) > 1 AS conflict FROM (SELECT vec_id AS piece_id, "row", CASE WHEN label = 7 THEN w - 1 - col ELSE col END AS col FROM vectors)""",
    }
    out = {}
    for name, x in q.items():
        more, query = (f", {x[0]}", x[1]) if isinstance(x, tuple) else ("", x)
        out[name] = f"WITH RECURSIVE {VIEWS.strip()}{more}\n{query}"
    return out
