"""Independent SQL (DuckDB) for the registered queries, over the same Parquet tables."""

from __future__ import annotations

from .. import params as P



def _two(v: str) -> str:
    """Two decimals, half away from zero, of all digits of the binary value."""
    digits = f"printf('%.40f', abs({v}))"
    cents = f"(split_part({digits}, '.', 1)::BIGINT * 100 + substr(split_part({digits}, '.', 2), 1, 2)::BIGINT + (substr(split_part({digits}, '.', 2), 3, 1) >= '5')::INT)"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || ({cents} // 100)::VARCHAR || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0'))"


# Parts that queries share: the derived tables, as common table expressions in order of use.
PARTS = {
    "maps": "SELECT r_regionkey AS map_id FROM region",
    "h": """SELECT (l_suppkey % 5)::INT AS map_id, (l_orderkey % 96)::INT AS row, (l_partkey % 96)::INT AS col,
        (sum(l_linenumber) + count(*)) % 10 AS h FROM lineitem GROUP BY 1, 2, 3""",
    "cells0": """SELECT m.map_id, r.i::INT AS row, c.i::INT AS col,
        (((r.i % 12 < 4) OR (c.i % 16 < 4)) AND coalesce(h.h, 9) >= 1) OR (r.i % 12 BETWEEN 6 AND 8 AND c.i % 16 BETWEEN 8 AND 11) AS walkable
        FROM maps m CROSS JOIN range(96) r(i) CROSS JOIN range(96) c(i)
        LEFT JOIN h ON h.map_id = m.map_id AND h.row = r.i AND h.col = c.i""",
    "cells": """SELECT *, CASE WHEN map_id <> 4 THEN (walkable AND (row % 12 IN (1, 2) OR col % 32 IN (1, 2)))::INT END AS manual_main FROM cells0""",
    "places": """SELECT (p_partkey % 5)::INT AS map_id, lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS id,
        CASE WHEN p_partkey % 2 = 0 THEN p_name || ' / ' || p_brand ELSE p_name END AS name,
        CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS second,  p_name AS first,
        (['landscape', 'square', 'bridge', 'sports', 'dining', 'service', 'building', 'gate', 'dormitory'])[((p_size * 7 + p_partkey) % 9) + 1] AS type,
        ((p_partkey * 37) % 1536)::DOUBLE AS cx, ((p_partkey * 101) % 1536)::DOUBLE AS cy,
        CASE WHEN p_partkey % 10 = 0 THEN ((p_partkey * 37) % 1536 + 24)::DOUBLE END AS ax,
        CASE WHEN p_partkey % 10 = 0 THEN ((p_partkey * 101) % 1536)::DOUBLE END AS ay, p_partkey AS part
        FROM part""",
    "gates": """SELECT map_id, id, name, cx, cy, ax, ay, (row_number() OVER (PARTITION BY map_id ORDER BY part))::INT AS gate_order
        FROM places WHERE type = 'gate' AND part % 3 = 0 QUALIFY gate_order <= 7""",
    "lists": """SELECT map_id, id, type, 'dorm' AS list FROM places WHERE type = 'dormitory' AND part % 4 = 0
        UNION ALL SELECT map_id, id, type, 'key' FROM places WHERE type = 'building' AND part % 2 = 0""",
    "weights": """SELECT p.*, CASE
        WHEN p.type = 'dormitory' AND l.list IS NULL THEN 0 WHEN p.type = 'gate' AND g.id IS NULL THEN 0 WHEN p.type = 'building' AND l.list IS NULL THEN 0
        ELSE CASE p.type WHEN 'landscape' THEN 10 WHEN 'square' THEN 8 WHEN 'bridge' THEN 8 WHEN 'sports' THEN 6 WHEN 'dining' THEN 6
            WHEN 'service' THEN 5 WHEN 'building' THEN 4 WHEN 'gate' THEN 3 WHEN 'dormitory' THEN 2 ELSE 0 END
            + CASE l.list WHEN 'key' THEN 4 WHEN 'dorm' THEN 1 ELSE 0 END END AS weight,
        coalesce(p.ax, p.cx) AS px, coalesce(p.ay, p.cy) AS py
        FROM places p LEFT JOIN lists l ON l.map_id = p.map_id AND l.id = p.id LEFT JOIN gates g ON g.map_id = p.map_id AND g.id = p.id""",
    "points": """SELECT n_regionkey AS map_id, n_name AS id, 113.40::DOUBLE + ((n_nationkey * 37) % 100) / 10000 AS lng, 23.04::DOUBLE + ((n_nationkey * 53) % 100) / 10000 AS lat,
        170000 * ((113.40::DOUBLE + ((n_nationkey * 37) % 100) / 10000) - 113.40::DOUBLE) - 60 + ((n_nationkey * 29) % 7 - 3) AS x,
        -170000 * ((23.04::DOUBLE + ((n_nationkey * 53) % 100) / 10000) - 23.04::DOUBLE) + 1640 + ((n_nationkey * 31) % 7 - 3) AS y
        FROM nation WHERE n_regionkey <> 4 OR n_nationkey < 10""",
    "mean": "SELECT map_id, count(*) AS n, avg(lng) AS lng0, avg(lat) AS lat0, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY map_id",
    "sums": """SELECT p.map_id, sum((lng - lng0) * (lng - lng0)) AS uu, sum((lat - lat0) * (lat - lat0)) AS vv, sum((lng - lng0) * (lat - lat0)) AS uv,
        sum((lng - lng0) * (x - cx)) AS ux, sum((lat - lat0) * (x - cx)) AS vx, sum((lng - lng0) * (y - cy)) AS uy, sum((lat - lat0) * (y - cy)) AS vy
        FROM points p JOIN mean m ON m.map_id = p.map_id GROUP BY p.map_id""",
    "model": """SELECT m.map_id, n, n >= 3 AS ready, lng0, lat0,
        CASE WHEN n >= 3 THEN (ux * vv - vx * uv) / (uu * vv - uv * uv) END AS a1, CASE WHEN n >= 3 THEN (vx * uu - ux * uv) / (uu * vv - uv * uv) END AS b1, CASE WHEN n >= 3 THEN cx END AS c1,
        CASE WHEN n >= 3 THEN (uy * vv - vy * uv) / (uu * vv - uv * uv) END AS a2, CASE WHEN n >= 3 THEN (vy * uu - uy * uv) / (uu * vv - uv * uv) END AS b2, CASE WHEN n >= 3 THEN cy END AS c2
        FROM mean m JOIN sums s ON s.map_id = m.map_id""",
    "ev": """SELECT (user_id % 5)::INT AS map_id, user_id, event_id, ts,
        CASE WHEN event_id % 211 = 0 THEN 'reset' WHEN event_id % 223 = 0 THEN 'stop' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'compass' ELSE 'fix' END AS kind,
        113.40::DOUBLE + ((event_id * 7919) % 10000) / 1e6::DOUBLE AS lng, CASE WHEN event_id % 97 <> 0 THEN 23.04::DOUBLE + ((event_id * 104729) % 10000) / 1e6::DOUBLE END AS lat,
        CASE WHEN event_id % 13 = 0 THEN 0 ELSE value END AS h_acc, 50.0::DOUBLE AS acc, ((event_id * 31) % 360)::DOUBLE AS dir FROM events""",
    "fix0": """SELECT e.*, ready, a1 * (lng - lng0) + b1 * (lat - lat0) + c1 AS x, a2 * (lng - lng0) + b2 * (lat - lat0) + c2 AS y
        FROM ev e LEFT JOIN model m ON m.map_id = e.map_id WHERE kind = 'fix' AND lat IS NOT NULL""",
    "fix": """SELECT *, coalesce(x BETWEEN 0 AND 1536 AND y BETWEEN 0 AND 1536, false) AS inside FROM fix0""",
    "cellfix": """SELECT *, least(greatest(floor(y / 16), 0), 95)::BIGINT AS row, least(greatest(floor(x / 16), 0), 95)::BIGINT AS col FROM fix WHERE inside""",
    "tracks": "SELECT user_id AS route_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq, row, col FROM cellfix",
    "steps": """SELECT *, lag(row) OVER w AS r0, lag(col) OVER w AS c0, lead(row) OVER w AS r2, lead(col) OVER w AS c2 FROM tracks WINDOW w AS (PARTITION BY route_id ORDER BY seq)""",
    "edges0": """SELECT route_id, seq, CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END AS edge
        FROM (SELECT *, r0 || ',' || c0 AS a, row || ',' || col AS b FROM steps WHERE r0 IS NOT NULL)""",
    "visits": "SELECT *, row_number() OVER (PARTITION BY route_id, edge ORDER BY seq) - 1 AS visit FROM edges0",
    "req": """SELECT o_orderkey AS request_id, (o_custkey % 5)::INT AS map_id, o_custkey AS user_id,
        CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN 'north' ELSE ((o_orderkey % 40) * 389 % 1536)::VARCHAR END AS start_x, ((o_orderkey % 40) * 613 % 1536)::VARCHAR AS start_y,
        ((o_custkey % 40) * 389 % 1536)::VARCHAR AS goal_x, ((o_custkey % 40) * 613 % 1536)::VARCHAR AS goal_y,
        CASE o_orderkey % 7 WHEN 0 THEN ' ' || (o_custkey % 1000) || ' ' WHEN 1 THEN '' ELSE '_' || (o_custkey % 1000) END AS place_text FROM orders""",
    "num": """SELECT *, CASE WHEN trim(start_x) = '' THEN 0 ELSE try_cast(start_x AS DOUBLE) END AS sx, start_y::DOUBLE AS sy, goal_x::DOUBLE AS gx, goal_y::DOUBLE AS gy FROM req""",
    "kw": """SELECT unnest(string_split(p_name, ' ')) AS keyword FROM part
        UNION SELECT '_' || p_partkey FROM part UNION SELECT ' ' || upper(p_name) || '  ' FROM part
        UNION SELECT p_name[1:2] || ' ' || p_name[3:] FROM part UNION SELECT '' UNION SELECT 'no such place'""",
    "found": """SELECT keyword, map_id, id, first, second, (row_number() OVER (PARTITION BY keyword, map_id ORDER BY id))::INT AS rank
        FROM kw JOIN (SELECT *, replace(lower(id || ' ' || name), ' ', '') AS hay FROM places) ON contains(hay, replace(lower(keyword), ' ', ''))""",
    "taps": """SELECT event_id, (user_id % 5)::INT AS map_id, ((event_id * 13) % 750)::DOUBLE AS screen_x, ((event_id * 17) % 1334)::DOUBLE AS screen_y,
        (event_id % 5 + 1) / 4 AS scale, ((event_id % 7) * 20 - 60)::DOUBLE AS ox, ((event_id % 11) * 20 - 100)::DOUBLE AS oy FROM events""",
    "road": "SELECT map_id, row, col FROM cells WHERE walkable",
    "mains": "SELECT map_id, row, col FROM cells WHERE manual_main = 1",
    "rays": "SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i) WHERE a.i <> 1 OR b.i <> 1",
    "near": """SELECT a.map_id, a.row, a.col, b.row AS row2, b.col AS col2, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS base
        FROM road a CROSS JOIN rays JOIN road b ON b.map_id = a.map_id AND b.row = a.row + dr AND b.col = a.col + dc""",
    "runs": """SELECT map_id, row, min(col) AS f, max(col) AS t, row::BIGINT * 1048576 + min(col) AS id
        FROM (SELECT *, col - row_number() OVER (PARTITION BY map_id, row ORDER BY col) AS g FROM road) GROUP BY map_id, row, g""",
    "touch": """SELECT a.map_id, a.id AS a, b.id AS b FROM runs a JOIN runs b ON b.map_id = a.map_id AND abs(b.row - a.row) = 1 AND b.f <= a.t + 1 AND b.t >= a.f - 1""",
    "comp": """(WITH RECURSIVE cc(map_id, id, label) USING KEY (map_id, id) AS (
        SELECT map_id, id, id FROM runs
        UNION SELECT n.map_id, n.b, min(cc.label) FROM cc JOIN touch n ON n.map_id = cc.map_id AND n.a = cc.id
            JOIN recurring.cc o ON o.map_id = n.map_id AND o.id = n.b WHERE cc.label < o.label GROUP BY ALL)
        SELECT w.map_id, w.row, w.col, cc.label FROM cc JOIN runs u ON u.map_id = cc.map_id AND u.id = cc.id
        JOIN road w ON w.map_id = u.map_id AND w.row = u.row AND w.col BETWEEN u.f AND u.t)""",
    "biggest": """SELECT map_id, label FROM (SELECT map_id, label, count(*) AS n FROM comp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY n DESC, label) = 1""",
    "reach": "SELECT c.map_id, c.row, c.col FROM comp c JOIN biggest b ON b.map_id = c.map_id AND b.label = c.label",
    "upright": """SELECT map_id, row, col, walkable, manual_main, least(row - coalesce(max(CASE WHEN NOT walkable THEN row END) OVER (PARTITION BY map_id, col ORDER BY row), -100000),
        coalesce(min(CASE WHEN NOT walkable THEN row END) OVER (PARTITION BY map_id, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 100000) - row) AS v FROM cells""",
    "clear": """SELECT *, least(col + min(v - col) OVER (PARTITION BY map_id, row ORDER BY col),
        min(v + col) OVER (PARTITION BY map_id, row ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - col, 32767)::INT AS clearance FROM upright""",
    "wide": "SELECT map_id, row, col FROM clear WHERE walkable AND clearance >= 2",
    "wruns": """SELECT map_id, row, min(col) AS f, max(col) AS t, row::BIGINT * 1048576 + min(col) AS id
        FROM (SELECT *, col - row_number() OVER (PARTITION BY map_id, row ORDER BY col) AS g FROM wide) GROUP BY map_id, row, g""",
    "wtouch": """SELECT a.map_id, a.id AS a, b.id AS b FROM wruns a JOIN wruns b ON b.map_id = a.map_id AND abs(b.row - a.row) = 1 AND b.f <= a.t + 1 AND b.t >= a.f - 1""",
    "wcomp": """(WITH RECURSIVE cc(map_id, id, label) USING KEY (map_id, id) AS (
        SELECT map_id, id, id FROM wruns
        UNION SELECT n.map_id, n.b, min(cc.label) FROM cc JOIN wtouch n ON n.map_id = cc.map_id AND n.a = cc.id
            JOIN recurring.cc o ON o.map_id = n.map_id AND o.id = n.b WHERE cc.label < o.label GROUP BY ALL)
        SELECT w.map_id, w.row, w.col, cc.label FROM cc JOIN wruns u ON u.map_id = cc.map_id AND u.id = cc.id
        JOIN wide w ON w.map_id = u.map_id AND w.row = u.row AND w.col BETWEEN u.f AND u.t)""",
    "score": "SELECT map_id, row, col, least(1.0::DOUBLE, ln(1 + count(*) OVER (PARTITION BY map_id, label)) / ln(421.0::DOUBLE))::FLOAT::DOUBLE AS main_score FROM wcomp",
    "feat": "SELECT c.*, coalesce(s.main_score, 0) AS main_score FROM clear c LEFT JOIN score s ON s.map_id = c.map_id AND s.row = c.row AND s.col = c.col",
    "factor": """SELECT map_id, row, col, manual_main AS m, greatest(1, 1 + 1.35::DOUBLE * 1.8 / pow(greatest(1, clearance), 1.7)
        + CASE WHEN manual_main IS NULL THEN 0 ELSE (1 - manual_main) * 1.35::DOUBLE * 0.28 END
        - least(greatest(1, clearance) - 1, 6) * 1.35::DOUBLE * CASE WHEN manual_main IS NULL THEN 0.04 ELSE 0.02 END
        - main_score * 1.35::DOUBLE * CASE WHEN manual_main IS NULL THEN 0.42 ELSE 0.12 END - coalesce(manual_main, 0) * 1.35::DOUBLE * 0.48) AS factor FROM feat WHERE walkable""",
    "moves": """SELECT n.*, n.base * f.factor + CASE WHEN f.m IS NULL OR f.m > 0 THEN 0 ELSE n.base * 1.35::DOUBLE * 1.15 + CASE WHEN g.m > 0 THEN 5.4::DOUBLE ELSE 0 END END AS cost
        FROM near n JOIN factor f ON f.map_id = n.map_id AND f.row = n.row2 AND f.col = n.col2 JOIN factor g ON g.map_id = n.map_id AND g.row = n.row AND g.col = n.col""",
    "snap_in": "SELECT DISTINCT map_id, row AS o_row, col AS o_col FROM cellfix",
    "snap_ring": """SELECT s.*, r.row AS r_row, r.col AS r_col, greatest(abs(s.o_row - r.row), abs(s.o_col - r.col)) AS ring
        FROM snap_in s JOIN reach r ON r.map_id = s.map_id AND abs(s.o_row - r.row) <= 24 AND abs(s.o_col - r.col) <= 24
        QUALIFY ring = min(ring) OVER (PARTITION BY s.map_id, s.o_row, s.o_col)""",
    "snapped": """SELECT f.event_id, f.map_id, f.x, f.y, r_row, r_col, sqrt(((r_col + 0.5) * 16 - x) * ((r_col + 0.5) * 16 - x) + ((r_row + 0.5) * 16 - y) * ((r_row + 0.5) * 16 - y)) AS distance
        FROM cellfix f LEFT JOIN snap_ring s ON s.map_id = f.map_id AND s.o_row = f.row AND s.o_col = f.col
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, r_row, r_col) = 1""",
    "mruns": """SELECT map_id, row, min(col) AS f, max(col) AS t, row::BIGINT * 1048576 + min(col) AS id
        FROM (SELECT *, col - row_number() OVER (PARTITION BY map_id, row ORDER BY col) AS g FROM mains) GROUP BY map_id, row, g""",
    "mtouch": """SELECT a.map_id, a.id AS a, b.id AS b FROM mruns a JOIN mruns b ON b.map_id = a.map_id AND abs(b.row - a.row) = 1 AND b.f <= a.t + 1 AND b.t >= a.f - 1""",
    "mcomp": """(WITH RECURSIVE cc(map_id, id, label) USING KEY (map_id, id) AS (
        SELECT map_id, id, id FROM mruns
        UNION SELECT n.map_id, n.b, min(cc.label) FROM cc JOIN mtouch n ON n.map_id = cc.map_id AND n.a = cc.id
            JOIN recurring.cc o ON o.map_id = n.map_id AND o.id = n.b WHERE cc.label < o.label GROUP BY ALL)
        SELECT w.map_id, w.row, w.col, cc.label FROM cc JOIN mruns u ON u.map_id = cc.map_id AND u.id = cc.id
        JOIN mains w ON w.map_id = u.map_id AND w.row = u.row AND w.col BETWEEN u.f AND u.t)""",
    "pcell": "SELECT map_id, id, type, weight, px, py, least(greatest(floor(py / 16), 0), 95)::BIGINT AS o_row, least(greatest(floor(px / 16), 0), 95)::BIGINT AS o_col FROM weights WHERE weight > 0",
    "psnap": """SELECT c.*, r.row AS r_row, r.col AS r_col FROM pcell c JOIN reach r ON r.map_id = c.map_id AND abs(c.o_row - r.row) <= 24 AND abs(c.o_col - r.col) <= 24
        QUALIFY row_number() OVER (PARTITION BY c.map_id, c.id ORDER BY greatest(abs(c.o_row - r.row), abs(c.o_col - r.col)),
            ((r.col + 0.5) * 16 - px) * ((r.col + 0.5) * 16 - px) + ((r.row + 0.5) * 16 - py) * ((r.row + 0.5) * 16 - py), r.row, r.col) = 1""",
    "gpoint": "SELECT *, coalesce(ax, cx) AS px, coalesce(ay, cy) AS py, least(greatest(floor(coalesce(ay, cy) / 16), 0), 95)::BIGINT AS o_row, least(greatest(floor(coalesce(ax, cx) / 16), 0), 95)::BIGINT AS o_col FROM gates",
    "gring": """SELECT g.*, r.row AS r_row, r.col AS r_col, sqrt(((r.col + 0.5) * 16 - px) * ((r.col + 0.5) * 16 - px) + ((r.row + 0.5) * 16 - py) * ((r.row + 0.5) * 16 - py)) AS distance
        FROM gpoint g JOIN reach r ON r.map_id = g.map_id AND abs(g.o_row - r.row) <= 24 AND abs(g.o_col - r.col) <= 24
        QUALIFY greatest(abs(g.o_row - r.row), abs(g.o_col - r.col)) = min(greatest(abs(g.o_row - r.row), abs(g.o_col - r.col))) OVER (PARTITION BY g.map_id, g.id)""",
    "granks": "SELECT *, (row_number() OVER (PARTITION BY map_id, id ORDER BY distance, r_row, r_col))::INT AS rank FROM gring",
    "gsnap": "SELECT map_id, id, name, gate_order, r_row * 1048576 + r_col AS source FROM granks WHERE rank = 1",
    "arcs": """SELECT map_id, row::BIGINT * 1048576 + col AS src, row2::BIGINT * 1048576 + col2 AS dst, round(cost / 1e-9::DOUBLE)::BIGINT AS c, round(16 * base / 1e-9::DOUBLE)::BIGINT AS l FROM moves""",
    "field": """(WITH RECURSIVE f(map_id, source, cell, v) USING KEY (map_id, source, cell) AS (
        SELECT DISTINCT map_id, source, source, {'c': 0::BIGINT, 'l': 0::BIGINT, 'n': (-1)::BIGINT, 's': 1::BIGINT} FROM gsnap
        UNION SELECT f.map_id, f.source, a.src, min({'c': f.v.c + a.c, 'l': f.v.l + a.l, 'n': f.cell, 's': f.v.s + 1}) FROM f JOIN arcs a ON a.map_id = f.map_id AND a.dst = f.cell
            LEFT JOIN recurring.f o ON o.map_id = f.map_id AND o.source = f.source AND o.cell = a.src
            WHERE o.v IS NULL OR (f.v.c + a.c, f.v.l + a.l, f.cell) < (o.v.c, o.v.l, o.v.n) GROUP BY ALL)
        SELECT map_id, source, cell, v.c * 1e-9::DOUBLE AS cost, v.l * 1e-9::DOUBLE AS length, v.s AS n_cells FROM f)""",
    "ways": """SELECT f.map_id, f.cell, g.id AS gate, g.name, f.source, f.length, f.cost, f.n_cells,
        (row_number() OVER (PARTITION BY f.map_id, f.cell ORDER BY f.length, g.gate_order))::INT AS rank FROM field f JOIN gsnap g ON g.map_id = f.map_id AND g.source = f.source""",
    "rpoint": """SELECT DISTINCT map_id, sx AS px, sy AS py, least(greatest(floor(sy / 16), 0), 95)::BIGINT AS o_row, least(greatest(floor(sx / 16), 0), 95)::BIGINT AS o_col FROM num WHERE sx IS NOT NULL""",
    "rsnap": """SELECT p.map_id, p.px, p.py, r.row * 1048576::BIGINT + r.col AS cell FROM rpoint p JOIN reach r ON r.map_id = p.map_id AND abs(p.o_row - r.row) <= 24 AND abs(p.o_col - r.col) <= 24
        QUALIFY row_number() OVER (PARTITION BY p.map_id, p.px, p.py ORDER BY greatest(abs(p.o_row - r.row), abs(p.o_col - r.col)),
            ((r.col + 0.5) * 16 - px) * ((r.col + 0.5) * 16 - px) + ((r.row + 0.5) * 16 - py) * ((r.row + 0.5) * 16 - py), r.row, r.col) = 1""",
    "exits": "SELECT w.*, w.map_id || '|' || w.cell AS route_id FROM ways w JOIN (SELECT DISTINCT map_id, cell FROM rsnap) r ON r.map_id = w.map_id AND r.cell = w.cell",
    "marks": """SELECT e.map_id, e.user_id, e.event_id, e.ts, e.kind, f.x, f.y, coalesce(f.inside, false) AS inside, f.event_id IS NOT NULL AS good, e.dir
        FROM ev e LEFT JOIN fix f ON f.event_id = e.event_id WHERE e.kind <> 'fix' OR f.event_id IS NOT NULL""",
    "timeline": """SELECT map_id, user_id, event_id, ts, last_value(CASE WHEN kind IN ('fix', 'reset') THEN {'x': CASE WHEN inside THEN x END, 'y': CASE WHEN inside THEN y END, 'f': kind = 'fix'} END IGNORE NULLS) OVER w AS loc,
        last_value(CASE WHEN kind = 'compass' THEN {'d': dir} WHEN kind = 'reset' THEN {'d': NULL} END IGNORE NULLS) OVER w AS head,
        last_value(CASE WHEN kind = 'reset' THEN 'locating' WHEN kind = 'error' THEN 'failed' WHEN kind = 'stop' THEN 'idle' WHEN kind = 'fix' AND inside THEN 'tracking' WHEN kind = 'fix' THEN 'failed' END IGNORE NULLS) OVER w AS state
        FROM marks WINDOW w AS (PARTITION BY map_id, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "state": "SELECT * FROM timeline QUALIFY row_number() OVER (PARTITION BY map_id, user_id ORDER BY ts DESC, event_id DESC) = 1",
}

_STATE = "round(loc.x, 4) AS x, round(loc.y, 4) AS y, coalesce(loc.f, false) AS has_fix, head.d AS heading, coalesce(state, 'idle') AS status"

BODIES = {
    "src1_read_road_grid": "SELECT map_id, row, col, walkable, 'ok' AS status FROM cells",
    "src2_main_road_layer": "SELECT map_id, row, col, walkable, manual_main FROM cells",
    "src3_read_places": "SELECT map_id, id, name, type, cx AS center_x, cy AS center_y, ax AS access_x, ay AS access_y, 0 AS n_polygons FROM places",
    "src4_control_points": "SELECT map_id, id, round(lng, 6) AS lng, round(lat, 6) AS lat, round(x, 6) AS x, round(y, 6) AS y FROM points",
    "src5_location_fixes": "SELECT map_id, user_id, event_id, ts, round(lng, 6) AS longitude, round(lat, 6) AS latitude, h_acc AS horizontal_accuracy FROM ev WHERE kind = 'fix'",
    "src6_compass": "SELECT map_id, user_id, event_id, ts, dir AS direction FROM ev WHERE kind = 'compass'",
    "src7_route_requests": "SELECT request_id, map_id, user_id, sx IS NULL AS bad_start, sx AS start_x, sy AS start_y, gx AS goal_x, gy AS goal_y, place_text FROM num",
    "snk1_write_features": "SELECT map_id, count(*) AS cells, count(*) FILTER (walkable) AS road_cells FROM cells GROUP BY 1",
    "fil1_finite_fixes": "SELECT event_id, user_id FROM fix",
    "fil2_inside_map": "SELECT event_id, map_id, round(x, 4) AS x, round(y, 4) AS y FROM fix WHERE inside",
    "fil3_is_road": "SELECT event_id, t.map_id, floor(screen_y / 16)::INT AS row, floor(screen_x / 16)::INT AS col FROM taps t JOIN road r ON r.map_id = t.map_id AND r.row = floor(screen_y / 16) AND r.col = floor(screen_x / 16)",
    "fil4_search_places": """SELECT keyword, map_id, rank, id, CASE WHEN first <> '' AND first <> id THEN first ELSE id END AS title,
        CASE WHEN second = '' THEN id ELSE id || ' / ' || second END AS subtitle FROM found WHERE rank <= 40""",
    "fil5_open_gates": "SELECT map_id, id, name, gate_order FROM gates",
    "fil7_validate_requests": """SELECT request_id, CASE WHEN request_id % 37 = 0 OR sx IS NULL THEN 'missing_start'
        WHEN trim(place_text) <> '' AND request_id % 11 = 0 THEN 'text_changed' WHEN trim(place_text) = '' AND request_id % 17 = 0 AND NOT (gx = 0 AND gy = 0) THEN 'goal_changed' ELSE 'ok' END AS status FROM num""",
    "sc1_pixel_to_cell": "SELECT event_id, least(greatest(floor((screen_y * 3 - 200) / 16), 0), 95)::BIGINT AS row, least(greatest(floor((screen_x * 3 - 200) / 16), 0), 95)::BIGINT AS col FROM taps",
    "sc2_cell_center": "SELECT map_id, row, col, (col + 0.5)::DOUBLE * 16 AS x, (row + 0.5)::DOUBLE * 16 AS y FROM cells",
    "sc3_cell_id": "SELECT map_id, row::BIGINT * 96 + col AS cell_id, row::BIGINT AS row, col::BIGINT AS col FROM cells",
    "sc4_project": "SELECT event_id, round(x, 4) AS x, round(y, 4) AS y FROM fix",
    "sc5_pixel_correction": "SELECT event_id, round(x + CASE WHEN event_id % 3 = 2 THEN 2.5 ELSE 0 END, 4) AS x FROM fix WHERE x IS NOT NULL",
    "sc6_screen_to_map": "SELECT event_id, round(least(greatest((screen_x - ox) / scale, 0), 1536), 4) AS x, round(least(greatest((screen_y - oy) / scale, 0), 1536), 4) AS y FROM taps",
    "sc7_fix_accuracy": "SELECT event_id, CASE WHEN h_acc IS NULL OR h_acc = 0 THEN acc ELSE h_acc END AS accuracy FROM ev WHERE kind = 'fix'",
    "sc8_heading_vector": "SELECT event_id, round(sin(radians(dir)), 4) + 0.0 AS head_x, round(-cos(radians(dir)), 4) + 0.0 AS head_y FROM ev WHERE kind = 'compass'",
    "sc9_step_base_cost": "SELECT map_id, round(base, 4) AS base_cost, count(*) AS steps FROM near GROUP BY 1, 2",
    "sc10_cost_factor": "SELECT map_id, row, col, round(factor, 4) AS factor FROM factor",
    "sc11_departure_penalty": """SELECT map_id, round(p, 4) AS penalty, count(*) AS steps FROM (SELECT n.map_id, CASE WHEN b.manual_main IS NULL OR b.manual_main > 0 THEN 0
        ELSE n.base * 1.35::DOUBLE * 1.15 + CASE WHEN a.manual_main > 0 THEN 5.4::DOUBLE ELSE 0 END END AS p FROM near n JOIN cells a ON a.map_id = n.map_id AND a.row = n.row AND a.col = n.col
        JOIN cells b ON b.map_id = n.map_id AND b.row = n.row2 AND b.col = n.col2) GROUP BY 1, 2""",
    "sc12_step_direction": "SELECT route_id, seq, sign(row - r0)::INT AS d_row, sign(col - c0)::INT AS d_col FROM steps WHERE r0 IS NOT NULL",
    "sc13_js_number": "SELECT request_id, sx IS NULL AS bad, sx AS value FROM num",
    "sc14_point_key": f"SELECT id, {_two('cx * 0.005::DOUBLE')} || ',' || {_two('-cy * 0.005::DOUBLE')} AS key FROM places",
    "sc15_split_name": "SELECT id, first AS primary_name, second AS secondary_name FROM places",
    "sc16_destination_texts": "SELECT id, id || ' / ' || name AS typed, first AS title, CASE WHEN second = '' THEN id ELSE id || ' / ' || second END AS subtitle, id || '  ' || name AS label FROM places",
    "sc17_edge_key": "SELECT route_id, seq, edge FROM edges0",
    "sc18_tour_zone": "SELECT id, least(3, floor(cy / 384))::INT || '-' || least(3, floor(cx / 384))::INT AS zone FROM places",
    "sc19_candidate_weight": "SELECT map_id, id, weight FROM weights",
    "sc20_tour_score": """SELECT map_id, id, round(weight * CASE WHEN px > 700 THEN 1.45::DOUBLE ELSE 1 END * CASE WHEN type IN ('landscape', 'square') THEN 1.2::DOUBLE ELSE 1 END
        / pow(greatest(80, sqrt((px - 700) * (px - 700) + (py - 700) * (py - 700))) / 700 + 1, 0.85), 4) AS score FROM weights WHERE weight > 0""",
    "sc21_place_anchor": "SELECT id, coalesce(ax, cx) AS x, coalesce(ay, cy) AS y FROM places",
    "sc22_route_start": """SELECT request_id, r.map_id, round(CASE WHEN s.user_id IS NOT NULL THEN loc.x WHEN u.user_id IS NOT NULL THEN u.x WHEN sx IS NOT NULL THEN sx END, 4) AS x,
        round(CASE WHEN s.user_id IS NOT NULL THEN loc.y WHEN u.user_id IS NOT NULL THEN u.y WHEN sx IS NOT NULL THEN sy END, 4) AS y,
        CASE WHEN s.user_id IS NOT NULL THEN 'live' WHEN u.user_id IS NOT NULL THEN 'confirmed' WHEN sx IS NOT NULL THEN 'typed' END AS source
        FROM num r LEFT JOIN (SELECT * FROM state WHERE loc.x IS NOT NULL) s ON s.map_id = r.map_id AND s.user_id = r.user_id
        LEFT JOIN (SELECT map_id, user_id, max(gx) AS x, max(gy) AS y FROM num WHERE user_id % 3 = 0 GROUP BY 1, 2) u ON u.map_id = r.map_id AND u.user_id = r.user_id""",
    "sc23_straight_line": "SELECT route_id, seq, round(sqrt((row - r0) * (row - r0) + (col - c0) * (col - c0)), 4) AS cells FROM steps WHERE r0 IS NOT NULL",
    "sc24_stop_names": """SELECT map_id, type, array_to_string((list(first ORDER BY first))[1:12], ' → ') || CASE WHEN count(*) > 12 THEN ' → 等 ' || count(*) || ' 处' ELSE '' END AS stop_names
        FROM places WHERE type IN ('gate', 'square') GROUP BY 1, 2""",
    "sc25_summaries": f"""SELECT route_id, printf('{P.ROUTE_TEXT}', n_cells, round(length), 0) AS route_summary,
        printf('{P.EXIT_TEXT}', CASE WHEN trim(string_split(name, '/')[1]) <> '' THEN trim(string_split(name, '/')[1]) ELSE gate END, round(length)) AS exit_summary FROM exits WHERE rank = 1""",
    "j1_snap_to_road": "SELECT event_id AS point_id, map_id, r_row AS snap_row, r_col AS snap_col, round(distance, 4) AS distance, CASE WHEN r_row IS NULL THEN 'no_road' ELSE 'ok' END AS status FROM snapped",
    "j2_expand_neighbors": "SELECT map_id, row, col, count(*) AS degree FROM near GROUP BY 1, 2, 3",
    "j3_gap_edges": """SELECT map_id, row, col, row2, col2, g AS gap_cells, round((g + 1) * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END, 4) AS base_cost FROM (
        SELECT a.map_id, a.row, a.col, (a.row + dr * (k.i + 1))::INT AS row2, (a.col + dc * (k.i + 1))::INT AS col2, dr, dc, k.i::INT AS g
        FROM road a CROSS JOIN rays CROSS JOIN range(3) k(i) JOIN road b ON b.map_id = a.map_id AND b.row = a.row + dr * (k.i + 1) AND b.col = a.col + dc * (k.i + 1)
        QUALIFY row_number() OVER (PARTITION BY a.map_id, a.row, a.col, dr, dc ORDER BY k.i) = 1) WHERE g > 0""",
    "j4_edge_costs": "SELECT map_id, row, col, count(*) AS edges, round(sum(cost), 4) AS move_cost FROM moves GROUP BY 1, 2, 3",
    "j5_resolve_places": """SELECT request_id, r.map_id, CASE WHEN e.id IS NOT NULL THEN e.id WHEN n = 1 THEN l[1] END AS place,
        CASE WHEN e.id IS NOT NULL THEN 'ok' WHEN trim(place_text) = '' THEN 'empty' WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
        CASE WHEN e.id IS NULL AND n > 1 THEN array_to_string(l[1:8], ', ') END AS candidates
        FROM req r LEFT JOIN places e ON e.map_id = r.map_id AND e.id = trim(place_text)
        LEFT JOIN (SELECT q.map_id, q.t, count(*) AS n, list(p.id ORDER BY p.id) AS l FROM (SELECT DISTINCT map_id, trim(place_text) AS t FROM req WHERE trim(place_text) <> '') q
            JOIN places p ON p.map_id = q.map_id AND (contains(lower(p.id), lower(q.t)) OR contains(lower(p.name), lower(q.t))) GROUP BY 1, 2) m ON m.map_id = r.map_id AND m.t = trim(place_text)""",
    "j6_starts_to_gates": """SELECT event_id, g.id AS gate, round(sqrt((x - coalesce(ax, cx)) * (x - coalesce(ax, cx)) + (y - coalesce(ay, cy)) * (y - coalesce(ay, cy))), 4) AS distance
        FROM fix f JOIN gates g ON g.map_id = f.map_id WHERE inside""",
    "j7_place_lookup": "SELECT map_id, id, name, 'gate' AS type FROM gates",
    "j8_fixes_projector": "SELECT map_id, CASE WHEN NOT ready THEN 'uncalibrated' WHEN inside THEN 'tracking' ELSE 'off_map' END AS status, count(*) AS fixes FROM fix GROUP BY 1, 2",
    "j9_location_heading": "SELECT user_id, round(loc.x, 4) AS x, round(loc.y, 4) AS y, head.d AS heading FROM state WHERE loc.x IS NOT NULL AND head.d IS NOT NULL",
    "agg1_fit_projector": "SELECT map_id, ready, n AS n_points, round(a1, 2) AS ax, round(b1, 2) AS bx, round(c1, 2) AS cx, round(a2, 2) AS ay, round(b2, 2) AS by, round(c2, 2) AS cy FROM model",
    "agg2_road_components": "SELECT map_id, label AS component_id, count(*) AS cells FROM comp GROUP BY 1, 2",
    "agg3_reachable_mask": "SELECT map_id, row, col FROM reach",
    "agg4_main_road_score": "SELECT map_id, row, col, round(main_score, 4) AS main_score FROM score",
    "agg5_route_length": "SELECT route_id, round(coalesce(sum(16 * sqrt((row - r0) * (row - r0) + (col - c0) * (col - c0))), 0), 4) AS length_px FROM steps GROUP BY 1",
    "agg6_route_stats": "SELECT route_id, n_cells, round(length, 4) AS length_px, round(cost, 4) AS cost, 0::BIGINT AS gap_cells FROM exits WHERE rank = 1",
    "agg7_nearest_open_gate": """SELECT event_id AS request_id, s.map_id, gate, round(length, 4) AS length_px, round(cost, 4) AS cost, CASE WHEN r_row IS NULL THEN 'no_road' WHEN gate IS NULL THEN 'no_gate' ELSE 'ok' END AS status
        FROM snapped s LEFT JOIN (SELECT * FROM ways WHERE rank = 1) w ON w.map_id = s.map_id AND w.cell = s.r_row * 1048576::BIGINT + s.r_col""",
    "iter2_cost_field": "SELECT map_id, source, cell, round(cost, 4) AS cost FROM field",
    "win7_ranks": """SELECT map_id, 'component' AS kind, label::VARCHAR AS "of", n::VARCHAR AS value, (row_number() OVER (PARTITION BY map_id ORDER BY n DESC, f))::INT AS rank FROM (SELECT map_id, label, count(*) AS n, min(row * 1048576::BIGINT + col) AS f FROM comp GROUP BY 1, 2)
        UNION ALL SELECT map_id, 'gate', cell::VARCHAR, gate, rank FROM exits
        UNION ALL SELECT map_id, 'snap', id, r_row || ',' || r_col, rank FROM granks
        UNION ALL SELECT map_id, 'search', keyword, id, rank FROM found WHERE rank <= 40 AND length(keyword) < 4""",
    "agg9_edge_visit_counts": "SELECT route_id, edge, count(*) AS visits FROM edges0 GROUP BY 1, 2",
    "agg10_grid_layer_stats": """SELECT c.map_id, count(*) FILTER (walkable) AS road_cells, coalesce(sum(manual_main), 0)::BIGINT AS main_cells, any_value(l) AS largest FROM cells c
        LEFT JOIN (SELECT map_id, array_to_string((list(n ORDER BY n DESC))[1:10], ',') AS l FROM (SELECT map_id, label, count(*) AS n FROM mcomp GROUP BY 1, 2) GROUP BY 1) s ON s.map_id = c.map_id GROUP BY 1""",
    "fil6_tour_candidates": """SELECT p.map_id, id, type, weight, r_row AS snap_row, r_col AS snap_col, least(3, floor((r_row + 0.5) * 16 / 384))::INT || '-' || least(3, floor((r_col + 0.5) * 16 / 384))::INT AS zone
        FROM psnap p""",
    "win1_clearance": "SELECT map_id, row, col, clearance FROM clear",
    "win2_place_dedup": "SELECT map_id, type AS id, max(part) AS part FROM places GROUP BY 1, 2",
    "win3_simplify_path": """SELECT route_id, seq, row, col FROM steps WHERE r0 IS NULL OR r2 IS NULL OR sign(row - r0) <> sign(r2 - row) OR sign(col - c0) <> sign(c2 - col)""",
    "win4_edge_visit_rank": "SELECT route_id, seq, visit::INT AS visit, (visit % 3)::INT AS colour FROM visits",
    "win5_route_runs": """SELECT route_id, run, min(colour)::INT AS colour, min(seq) - 1 AS first_seq, max(seq) AS last_seq FROM (SELECT *, sum(change) OVER (PARTITION BY route_id ORDER BY seq)::BIGINT AS run FROM (
        SELECT *, visit % 3 AS colour, CASE WHEN lag(visit % 3) OVER (PARTITION BY route_id ORDER BY seq) = visit % 3 THEN 0 ELSE 1 END AS change FROM visits)) GROUP BY 1, 2""",
    "win6_segment_annotations": """SELECT route_id, seq, (x0 + x1) / 2 AS mid_x, (y0 + y1) / 2 AS mid_y, round(atan2(y1 - y0, x1 - x0), 4) AS bearing FROM (
        SELECT route_id, seq, x1, y1, lag(x1) OVER w AS x0, lag(y1) OVER w AS y0 FROM (SELECT route_id, seq, (col + 0.5)::DOUBLE * 16 AS x1, (row + 0.5)::DOUBLE * 16 AS y1 FROM steps
        WHERE r0 IS NULL OR r2 IS NULL OR sign(row - r0) <> sign(r2 - row) OR sign(col - c0) <> sign(c2 - col)) WINDOW w AS (PARTITION BY route_id ORDER BY seq))
        WHERE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) >= 96""",
    "win7_busiest_cells": "SELECT map_id, row, col, n_fixes, rank FROM (SELECT *, (row_number() OVER (PARTITION BY map_id ORDER BY n_fixes DESC, row, col))::INT AS rank FROM (SELECT map_id, row, col, count(*) AS n_fixes FROM cellfix GROUP BY 1, 2, 3)) WHERE rank <= 20",
    "srt1_places_by_id": "SELECT map_id, id, (row_number() OVER (PARTITION BY map_id ORDER BY id))::INT AS pos FROM places",
    "srt2_first_options": "SELECT keyword, map_id, rank, id FROM found WHERE rank <= 8",
    "srt3_best_first_stop": """SELECT map_id, id, round(s, 4) AS score FROM (SELECT map_id, id, round(weight * 1.45::DOUBLE * CASE WHEN type IN ('landscape', 'square') THEN 1.2::DOUBLE ELSE 1 END
        / pow(greatest(80, sqrt((px - 700) * (px - 700) + (py - 700) * (py - 700))) / 700 + 1, 0.85), 9) AS s FROM weights WHERE weight > 0) QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY s DESC, id) = 1""",
    "set1_join_legs": "SELECT route_id AS request_id, (row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1)::INT AS seq, row, col FROM tracks WHERE seq < 5 OR seq % 5 > 0",
    "set2_id_sets": "SELECT map_id, id, type FROM lists",
    "st1_project_fixes": "SELECT event_id, user_id, round(x, 4) AS x, round(y, 4) AS y, inside AS inside_map, CASE WHEN NOT ready THEN 'uncalibrated' WHEN inside THEN 'tracking' ELSE 'off_map' END AS status FROM fix",
    "st2_user_location_state": f"SELECT map_id, user_id, {_STATE} FROM state",
    "st3_poll_fixes": "SELECT map_id, user_id, time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_id FROM fix WHERE inside QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 5 SECOND, ts) ORDER BY ts DESC, event_id DESC) = 1",
    "st3_poll_stream": "SELECT map_id, user_id, time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_id FROM fix WHERE inside QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 5 SECOND, ts) ORDER BY ts DESC, event_id DESC) = 1",
    "snk1_upsert_stream": f"SELECT map_id, user_id, {_STATE} FROM state",
    "st4_status_timeline": f"SELECT user_id, event_id, {_STATE} FROM timeline",
}


def sql(body: str) -> str:
    """``body`` with the parts it needs, in order."""
    import re

    names, need, todo = list(PARTS), set(), [body]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in need and re.search(rf"\b(FROM|JOIN)\s+{n}\b", text):
                need.add(n)
                todo.append(PARTS[n])
    parts = [f"{n} AS {PARTS[n] if PARTS[n].startswith('(') else '(' + PARTS[n] + ')'}" for n in names if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


ORACLES = {name: sql(body) for name, body in BODIES.items()}
