"""DuckDB SQL with the same rows as the registered queries, written independently of the operators."""

from __future__ import annotations

SQL: dict[str, str] = {}

# Geometry by closed forms -----------------------------------------------------


def ring(c: str, n: int) -> str:
    """1-based ring of a RING pixel."""
    cap, npix = 2 * n * (n - 1), 12 * n * n
    return (
        f"(CASE WHEN {c} < {cap} THEN CAST(floor((1 + floor(sqrt(1 + 2 * {c}))) / 2) AS BIGINT) WHEN {c} < {npix - cap} THEN ({c} - {cap}) // {4 * n} + {n}"
        f" ELSE {4 * n} - CAST(floor((1 + floor(sqrt(1 + 2 * ({npix - 1} - {c})))) / 2) AS BIGINT) END)"
    )


def size(r: str, n: int) -> str:
    return f"(4 * least({r}, {4 * n} - {r}, {n}))"


def start(r: str, n: int) -> str:
    return f"(CASE WHEN {r} <= {n} THEN 2 * {r} * ({r} - 1) WHEN {r} <= {3 * n} THEN {2 * n * (n - 1)} + ({r} - {n}) * {4 * n} ELSE {12 * n * n} - 2 * ({4 * n} - {r}) * ({4 * n} - {r} + 1) END)"


def ring_z(r: str, n: int) -> str:
    return f"(CASE WHEN {r} < {n} THEN 1 - {r} * {r} / {3.0 * n * n} WHEN {r} > {3 * n} THEN ({4 * n} - {r}) * ({4 * n} - {r}) / {3.0 * n * n} - 1 ELSE ({2 * n} - {r}) * 2 / {3.0 * n} END)"


def turn(c: str, r: str, n: int) -> str:
    """Quarter turns of longitude of a pixel whose ring is r."""
    return f"(({c} - {start(r, n)} + CASE WHEN {r} BETWEEN {n} AND {3 * n} AND ({r} + {n}) % 2 = 1 THEN 0.0 ELSE 0.5 END) / ({size(r, n)} / 4))"


def lat(r: str, n: int) -> str:
    return f"degrees(asin({ring_z(r, n)}))"


def located(source: str, n: int, columns: str = "*") -> str:
    """A relation with z and t, and the pixel and ring of each row."""
    return f"""
  (SELECT {columns}, CASE WHEN abs(z) <= 2.0 / 3.0 THEN {2 * n * (n - 1)} + {4 * n} * ({n} + up - down)
        + (((up + down - {n} + (CASE WHEN ({n} + 1 + up - down) % 2 = 0 THEN 1 ELSE 0 END) + 1 - ((up + down - {n} + (CASE WHEN ({n} + 1 + up - down) % 2 = 0 THEN 1 ELSE 0 END) + 1) % 2 + 2) % 2) // 2) % {4 * n} + {4 * n}) % {4 * n}
      WHEN z > 0 THEN 2 * i * (i - 1) + CAST(floor(t * i) AS BIGINT) % (4 * i) ELSE {12 * n * n} - 2 * i * (i + 1) + CAST(floor(t * i) AS BIGINT) % (4 * i) END AS cell,
    CASE WHEN abs(z) <= 2.0 / 3.0 THEN {2 * n} + up - down WHEN z > 0 THEN i ELSE {4 * n} - i END AS ring
  FROM (SELECT *, CAST(floor({n} * (0.5 + t) - 0.75 * {n} * z) AS BIGINT) AS up, CAST(floor({n} * (0.5 + t) + 0.75 * {n} * z) AS BIGINT) AS down,
      CAST(floor((t - floor(t)) * {n} * sqrt(3 * (1 - abs(z)))) AS BIGINT) + CAST(floor((1 - (t - floor(t))) * {n} * sqrt(3 * (1 - abs(z)))) AS BIGINT) + 1 AS i FROM {source}))"""


OBS = "(SELECT event_id, ts AS time, value, (2 * (event_id % 997) + 1) / 997.0::DOUBLE - 1 AS z, 4 * (user_id % 151) / 151.0::DOUBLE AS t, event_id % 8 AS alt FROM events)"
FIELD = "(SELECT l_linenumber::DOUBLE AS level, l_orderkey % 192 AS cell, avg(l_quantity) AS u, avg(l_tax) AS v, avg(l_extendedprice) AS temp, avg(l_discount) AS omega FROM lineitem GROUP BY ALL)"
MONTHLY = "(SELECT month(l_shipdate) AS time, l_linenumber::DOUBLE AS level, l_orderkey % 192 AS cell, avg(l_quantity) AS u, avg(l_tax) AS v, avg(l_extendedprice) AS temp, avg(l_discount) AS omega FROM lineitem GROUP BY ALL)"
GAPPY = f"(SELECT * REPLACE (CASE WHEN (cell * 7 + level::BIGINT * 3) % 5 <> 0 THEN u END AS u) FROM {FIELD})"
REGULAR = "(SELECT l_linenumber::DOUBLE AS level, (l_orderkey % 15) * 12.0::DOUBLE - 84 AS lat, (l_partkey % 24) * 15.0::DOUBLE AS lon, avg(l_quantity) AS u FROM lineitem GROUP BY ALL)"


def pixels(n: int) -> str:
    """cell, ring, z, lat, lon of all pixels."""
    return f"(SELECT cell, ring, {ring_z('ring', n)} AS z, {lat('ring', n)} AS lat, {turn('cell', 'ring', n)} * 90 AS lon FROM (SELECT cell, {ring('cell', n)} AS ring FROM (SELECT unnest(range({12 * n * n})) AS cell)))"


def vector(lon: str, lat_: str) -> str:
    return f"cos(radians({lat_})) * cos(radians({lon})) AS x, cos(radians({lat_})) * sin(radians({lon})) AS y, sin(radians({lat_})) AS zz"


def r(c: str, digits: int = 6) -> str:
    return f"round({c} + {1.7e-3 * 10.0**-digits!r}, {digits}) + 0.0"


SQL["ang2pix_ring"] = f"SELECT event_id, cell, ring FROM {located(OBS, 64)}"
SQL["pix2ang_ring"] = f"""
SELECT cell, ring, {r(ring_z('ring', 8))} AS z, {r(turn('cell', 'ring', 8))} AS t, cell - {start('ring', 8)} + {start('(32 - ring)', 8)} AS mirror, {start('ring', 8)} AS first
FROM (SELECT cell, {ring('cell', 8)} AS ring FROM (SELECT unnest(range(768)) AS cell))"""

#: Pixels by face and place in the face, with both indices (nside n).
FACES = """
  (SELECT *, 4 * q AS ring_size, CASE WHEN jr < {n} OR jr > {m} THEN 0 ELSE (jr - {n}) % 2 END AS s FROM
    (SELECT face, x, y, [2,2,2,2,3,3,3,3,4,4,4,4][face + 1] * {n} - x - y - 1 AS jr, least([2,2,2,2,3,3,3,3,4,4,4,4][face + 1] * {n} - x - y - 1, {k} - ([2,2,2,2,3,3,3,3,4,4,4,4][face + 1] * {n} - x - y - 1), {n}) AS q,
      [1,3,5,7,0,2,4,6,1,3,5,7][face + 1] AS jp FROM (SELECT unnest(range(12)) AS face), (SELECT unnest(range({n})) AS x), (SELECT unnest(range({n})) AS y)))"""


def faces(n: int) -> str:
    bits = range(max(1, n.bit_length() - 1))
    nest = f"face * {n * n} + " + " + ".join(f"(((x >> {b}) & 1) << {2 * b}) + (((y >> {b}) & 1) << {2 * b + 1})" for b in bits)
    place = "((jp * q + x - y + 1 + s - ((jp * q + x - y + 1 + s) % 2 + 2) % 2) // 2 - 1)"
    inner = FACES.format(n=n, m=3 * n, k=4 * n)
    return f"(SELECT {start('jr', n)} + ({place} % ring_size + ring_size) % ring_size AS cell_ring, {nest} AS cell_nest, jr AS ring, ring_size FROM {inner})"


SQL["grid_table"] = f"""
SELECT cell_ring, cell_nest, ring, ring_size, {r(ring_z('ring', 8))} AS z, {r(lat('ring', 8))} AS lat, {r(turn('cell_ring', 'ring', 8) + ' * 90')} AS lon, cell_ring - {start('ring', 8)} + {start('(32 - ring)', 8)} AS mirror
FROM {faces(8)}"""
SQL["ring_nest_reorder"] = f"SELECT level, cell_nest AS cell, {r('u')} AS u FROM {FIELD} JOIN {faces(4)} ON cell_ring = cell"
SQL["wavelength_table"] = f"""
SELECT l, CASE WHEN l > 0 THEN {r('2 * pi() * 6371.229 / sqrt(l * (l + 1.0))', 4)} END AS wavelength_km, CASE WHEN l > 0 THEN {r('l::DOUBLE', 4)} END AS degree FROM (SELECT unnest(range(192)) AS l)"""

# Reductions -------------------------------------------------------------------

SQL["zonal_mean"] = f"SELECT ring, {r('avg(value)')} AS value, count(*) AS n, round({lat('ring', 4)}, 6) AS lat FROM {located(OBS, 4)} GROUP BY ring"
ZONAL_GAPPY = f"(SELECT level, {ring('cell', 4)} AS ring, avg(u) AS u, avg(temp) AS temp FROM {GAPPY} GROUP BY ALL)"
SQL["zonal_mean_missing"] = f"SELECT level, ring, {r(lat('ring', 4))} AS lat, {r('u')} AS u, {r('temp')} AS temp FROM {ZONAL_GAPPY}"
SQL["band_zonal_mean"] = f"""
SELECT band, {r('-90 + (band + 0.5) * 1.0')} AS lat, {r('avg(value)')} AS value
FROM (SELECT value, least(greatest(CAST(floor((z * 90 + 90) / 1.0) AS BIGINT), 0), 179) AS band FROM {OBS}) GROUP BY band"""
SQL["global_mean_coslat"] = f"""
SELECT level, {r('sum(u * w) / sum(CASE WHEN u IS NOT NULL THEN w END)')} AS u, {r('sum(temp * w) / sum(CASE WHEN temp IS NOT NULL THEN w END)')} AS temp
FROM (SELECT *, cos(radians({lat('ring', 4)})) AS w FROM {ZONAL_GAPPY}) GROUP BY level"""
SQL["longitude_mean"] = f"SELECT level, lat, {r('avg(u)')} AS u FROM {REGULAR} GROUP BY ALL"
SQL["time_mean"] = f"SELECT level, cell, {r('avg(u)')} AS u, {r('avg(temp)')} AS temp FROM {MONTHLY} GROUP BY ALL"
SQL["swath_bin_mean"] = f"SELECT alt AS level, cell, {r('avg(value)')} AS value, count(*) AS samples FROM {located(OBS, 4)} WHERE event_id % 11 <> 0 GROUP BY ALL"
SQL["swath_bin_ut"] = f"SELECT alt AS level, cell, CAST(floor(hour(time) + minute(time) / 60 + 0.0) AS BIGINT) AS ut, {r('avg(value)')} AS value, count(*) AS samples FROM {located(OBS, 4)} WHERE event_id % 11 <> 0 GROUP BY ALL"
SQL["circular_mean_phase"] = f"SELECT level, {r('atan2(avg(u * sin(v * 10)), avg(u * cos(v * 10)))')} AS phase, {r('avg(u)')} AS u FROM {FIELD} GROUP BY level"
SQL["value_spread"] = f"SELECT level, {r('min(temp)')} AS least, {r('max(temp)')} AS greatest, {r('quantile_cont(temp, 0.5)')} AS median, {r('quantile_cont(temp, 0.97)')} AS p97 FROM {FIELD} GROUP BY level"

# Extraction -------------------------------------------------------------------

SQL["extract_point"] = f"""
SELECT level, {r('u')} AS u, {r('v')} AS v, {r('temp')} AS temp, {r('omega')} AS omega, 30.0::DOUBLE AS lat, 45.0::DOUBLE AS lon FROM {FIELD}
WHERE cell = (SELECT cell FROM {located("(SELECT sin(radians(30.0)) AS z, 0.5::DOUBLE AS t)", 4)})"""
SQL["nearest_cell"] = f"""
SELECT level, cell, {r('u')} AS u FROM {FIELD} WHERE cell = (
  SELECT cell FROM (SELECT cell, {vector('lon', 'lat')} FROM {pixels(4)}), (SELECT cos(radians(12)) * cos(radians(200)) AS a, cos(radians(12)) * sin(radians(200)) AS b, sin(radians(12)) AS c)
  ORDER BY (x - a) * (x - a) + (y - b) * (y - b) + (zz - c) * (zz - c), cell LIMIT 1)"""
SQL["meridian_nearest"] = f"""
WITH p AS (SELECT cell, {vector('lon', 'lat')} FROM {pixels(4)} WHERE abs((lon - 33 + 180 + 720) % 360 - 180) <= 720 / sqrt(192)),
t AS (SELECT target, tlat, {vector('33', 'tlat')} FROM (SELECT target, -90 + target * 5.0 AS tlat FROM (SELECT unnest(range(37)) AS target)))
SELECT target, {r('tlat')} AS lat, cell FROM (
  SELECT target, tlat, cell, row_number() OVER (PARTITION BY target ORDER BY round((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.zz - t.zz) ** 2, 12), cell) AS k FROM p, t) WHERE k = 1"""


def bilinear(targets: str, n: int) -> str:
    """(target, cell, w) of targets (target, lon, lat) with z = sin(lat)."""
    return f"""
  (SELECT target, cell, sum(w) AS w FROM (
    SELECT target, unnest(CASE WHEN ring IN (0, {4 * n}) THEN [{start('rr', n)}, {start('rr', n)} + 1, {start('rr', n)} + 2, {start('rr', n)} + 3]
        ELSE [{start('rr', n)} + (first % sz + sz) % sz, {start('rr', n)} + ((first + 1) % sz + sz) % sz] END) AS cell,
      unnest(CASE WHEN ring IN (0, {4 * n}) THEN [share / 4, share / 4, share / 4, share / 4] ELSE [share * (1 - fr), share * fr] END) AS w
    FROM (SELECT *, CAST(floor(place) AS BIGINT) AS first, place - floor(place) AS fr FROM (
      SELECT *, {size('rr', n)} AS sz, turn * {size('rr', n)} / 4 - CASE WHEN rr BETWEEN {n} AND {3 * n} AND (rr + {n}) % 2 = 1 THEN 0.0 ELSE 0.5 END AS place FROM (
        SELECT target, turn, ring, share, CASE WHEN ring = 0 THEN 1 WHEN ring = {4 * n} THEN {4 * n - 1} ELSE ring END AS rr FROM (
          SELECT target, turn, unnest([above, above + 1]) AS ring, unnest([1 - low, low]) AS share FROM (
            SELECT *, least(greatest((theta - t0) / (t1 - t0), 0.0), 1.0) AS low FROM (
              SELECT *, CASE WHEN above = 0 THEN 0.0 ELSE acos({ring_z('above', n)}) END AS t0, CASE WHEN above + 1 = {4 * n} THEN pi() ELSE acos({ring_z('(above + 1)', n)}) END AS t1 FROM (
                SELECT *, CASE WHEN z > 2/3 THEN CAST(floor({n} * sqrt(3 * (1 - z))) AS BIGINT) WHEN z < -2/3 THEN {4 * n - 1} - CAST(floor({n} * sqrt(3 * (1 + z))) AS BIGINT) ELSE CAST(floor({n} * (2 - 1.5 * z)) AS BIGINT) END AS above FROM (
                  SELECT target, sin(radians(lat)) AS z, radians(90.0 - lat) AS theta, (lon % 360) / 90.0 AS turn FROM {targets})))))))))
  GROUP BY target, cell)"""


def along(targets: str, values: list[str]) -> str:
    sums = ", ".join(f"{r(f"CASE WHEN count({v}) = max(need) THEN sum({v} * w) END")} AS {v}" for v in values)
    return f"""
WITH t AS {targets}, w AS (SELECT *, count(*) OVER (PARTITION BY target) AS need FROM {bilinear('t', 4)})
SELECT level, target, {sums}, {r('max(lon)')} AS lon, {r('max(lat)')} AS lat FROM {FIELD} JOIN w USING (cell) JOIN t USING (target) GROUP BY level, target"""


SQL["parallel_bilinear"] = along("(SELECT target, target * 22.5::DOUBLE AS lon, 21.0::DOUBLE AS lat FROM (SELECT unnest(range(16)) AS target))", ["u", "temp"])
SQL["meridian_bilinear"] = along("(SELECT target, 77.0::DOUBLE AS lon, -90.0 + target * (180.0::DOUBLE / 15) AS lat FROM (SELECT unnest(range(16)) AS target))", ["u"])
SQL["nearest_levels"] = f"SELECT level, cell, {r('u')} AS u FROM {FIELD} WHERE level IN (SELECT first(level ORDER BY abs(level - w), level) FROM (SELECT DISTINCT level FROM {FIELD}), (SELECT unnest([1.4, 1.6, 6.5, 90.0]) AS w) GROUP BY w)"
SQL["level_range"] = f"SELECT level, cell, {r('u')} AS u FROM {FIELD} WHERE level BETWEEN 2 AND 5"
SQL["drop_empty_levels"] = f"SELECT level, cell, {r('u')} AS u FROM {FIELD} WHERE level <> 3"

# Regridding -------------------------------------------------------------------

SQL["regrade_down"] = f"""
SELECT c.cell_ring AS cell, level, {r('u')} AS u, {r('temp')} AS temp
FROM (SELECT level, cell_nest >> 2 AS p, avg(u) AS u, avg(temp) AS temp FROM {GAPPY} JOIN {faces(4)} ON cell_ring = cell GROUP BY ALL) JOIN {faces(2)} c ON p = c.cell_nest"""
SQL["regrade_up"] = f"""
SELECT c.cell_ring AS cell, level, {r('u')} AS u FROM {FIELD} JOIN {faces(4)} a ON a.cell_ring = cell JOIN {faces(8)} c ON c.cell_nest >> 2 = a.cell_nest"""
SQL["knn_idw"] = f"""
WITH s AS (SELECT cell, {vector('lon', 'lat')} FROM {pixels(4)}), t AS (SELECT cell AS target, {vector('lon', 'lat')} FROM {pixels(8)}),
near AS (SELECT * FROM (SELECT target, cell, d2, row_number() OVER (PARTITION BY target ORDER BY d2, cell) AS k, min(d2) OVER (PARTITION BY target) AS first FROM (
  SELECT target, cell, round((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.zz - t.zz) * (s.zz - t.zz), 12) AS d2 FROM s, t)) WHERE k <= 3 AND sqrt(first) < 0.12),
w AS (SELECT target, cell, raw / sum(raw) OVER (PARTITION BY target) AS w FROM (SELECT *, 1 / greatest(sqrt(d2), 1e-12) ** 2 AS raw FROM near))
SELECT level, target, {r('CASE WHEN count(u) = 3 THEN sum(u * w) END')} AS u, {r('CASE WHEN count(temp) = 3 THEN sum(temp * w) END')} AS temp
FROM {GAPPY} JOIN w USING (cell) GROUP BY level, target"""
SQL["interpolate_unstructured"] = SQL["knn_idw"].replace("level, target,", "level, target AS cell,", 1)
SQL["gap_fill_space"] = f"""
WITH f AS (SELECT level, cell, u, {vector('lon', 'lat')} FROM {GAPPY} JOIN {pixels(4)} USING (cell)),
best AS (SELECT a.level, a.cell, first(b.u ORDER BY round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.zz - b.zz) ** 2, 12), b.cell) AS filled FROM f a JOIN f b ON a.level = b.level AND a.u IS NULL AND b.u IS NOT NULL GROUP BY ALL)
SELECT level, cell, {r('coalesce(u, filled)')} AS u FROM f LEFT JOIN best USING (level, cell)"""
SQL["gap_fill_time"] = f"""
WITH f AS (SELECT time, level, cell, CASE WHEN (cell + time) % 4 >= 2 THEN u END AS u, row_number() OVER (PARTITION BY level, cell ORDER BY time) AS i FROM {MONTHLY}),
g AS (SELECT *, last_value(CASE WHEN u IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, last_value(u IGNORE NULLS) OVER a AS ua, first_value(CASE WHEN u IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib, first_value(u IGNORE NULLS) OVER b AS ub FROM f
  WINDOW a AS (PARTITION BY level, cell ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY level, cell ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT time, level, cell, {r('coalesce(u, ua + (ub - ua) * (i - ia) / (ib - ia), ua, ub)')} AS u FROM g"""
SQL["bilinear_regular"] = f"""
WITH f AS {REGULAR}, t AS (SELECT cell AS target, lon, lat FROM {pixels(4)}),
w AS (SELECT target, unnest([la, la, la + 12, la + 12]) AS lat, unnest([lo, (lo + 15) % 360, lo, (lo + 15) % 360]) AS lon, unnest([(1 - y) * (1 - x), (1 - y) * x, y * (1 - x), y * x]) AS w FROM (
  SELECT target, la, lo, (lat - la) / 12 AS y, (lon - lo) / 15 AS x FROM (SELECT *, floor((lat + 84) / 12) * 12 - 84 AS la, floor(lon / 15) * 15 AS lo FROM t WHERE lat >= -84 AND lat < 84)))
SELECT level, target, {r('CASE WHEN count(u) = count(*) THEN sum(u * w) END')} AS u FROM f JOIN w USING (lat, lon) WHERE w > 0 GROUP BY level, target"""


def profile(source: str, x: str, values: list[str], targets: str, name: str) -> str:
    linear = ", ".join(f"{r(f'lo.{v} + (target - lo.x) / (hi.x - lo.x) * (hi.{v} - lo.{v})')} AS {v}" for v in values)
    packed = ", ".join(f"{v} := {v}" for v in values)
    return f"""
SELECT cell, {r('target')} AS {name}, {linear} FROM (
  SELECT cell, target, p[k] AS lo, p[k + 1] AS hi FROM (
    SELECT *, least(greatest(len(list_filter(p, lambda e: e.x <= target)), 1), len(p) - 1) AS k FROM (
      SELECT cell, list(struct_pack(x := {x}, {packed}) ORDER BY {x}) AS p FROM {source} GROUP BY cell HAVING count(*) > 1), (SELECT unnest({targets}) AS target)))"""


SQL["log_pressure_interp"] = profile(FIELD, "ln(100000.0 / level)", ["u", "temp"], "[ln(100000.0), ln(50000.0), ln(40000.0), ln(20000.0), ln(15000.0), ln(10000.0)]", "logp")
SQL["destagger"] = profile(FIELD, "level", ["omega"], "[0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]::DOUBLE[]", "level")
SQL["half_to_full"] = f"SELECT cell, (level + l) / 2 AS level, {r('(omega + o) / 2')} AS omega FROM (SELECT cell, level, omega, lead(level) OVER w AS l, lead(omega) OVER w AS o FROM {FIELD} WINDOW w AS (PARTITION BY cell ORDER BY level)) WHERE l IS NOT NULL"

# Comparison -------------------------------------------------------------------

PAIR = f"(SELECT level, cell, u, v, temp / 1500.0 AS u2, omega * 0.8 AS v2 FROM {FIELD})"


def scalar(a: str, b: str) -> str:
    d, ok = f"({b} - {a})", "count(*) > 1"
    sums = {
        "bias": f"avg({d})", "rmse": f"sqrt(avg({d} * {d}))", "crmse": f"sqrt(greatest(0, avg({d} * {d}) - avg({d}) ** 2))", "mae": f"avg(abs({d}))", "r": f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)",
        "sigma_ref": f"stddev_samp({a})", "sigma_cmp": f"stddev_samp({b})", "skill": f"1 - avg({d} * {d}) / nullif(var_samp({a}), 0)",
    }
    return "count(*) AS n, " + ", ".join(f"{r(f"CASE WHEN {ok} THEN {v} END")} AS {k}" for k, v in sums.items())


def vectorial(u: str, v: str, u2: str, v2: str) -> str:
    du, dv = f"({u2} - {u})", f"({v2} - {v})"
    d2, bias2 = f"({du} * {du} + {dv} * {dv})", f"(avg({du}) ** 2 + avg({dv}) ** 2)"
    sums = {
        "bias": f"sqrt({bias2})", "rmse": f"sqrt(avg({d2}))", "crmse": f"sqrt(greatest(0, avg({d2}) - {bias2}))", "mae": f"avg(sqrt({d2}))", "r": f"sum({u2} * {u} + {v2} * {v}) / sqrt(sum({u2} * {u2} + {v2} * {v2}) * sum({u} * {u} + {v} * {v}))",
        "sigma_ref": f"sqrt(var_samp({u}) + var_samp({v}))", "sigma_cmp": f"sqrt(var_samp({u2}) + var_samp({v2}))", "skill": f"1 - avg({d2}) / (var_samp({u}) + var_samp({v}))",
    }
    return "count(*) AS n, " + ", ".join(f"{r(e)} AS {k}" for k, e in sums.items())


SQL["compare_stats"] = f"SELECT 'u' AS variable, {scalar('u', 'u2')} FROM {PAIR}"
ZONAL_PAIR = f"(SELECT * FROM (SELECT level, {ring('cell', 4)} AS ring, avg(u) AS u, avg(u2) AS u2, avg(v) AS v, avg(v2) AS v2 FROM {PAIR} GROUP BY ALL) WHERE {lat('ring', 4)} BETWEEN -60 AND 60)"
SQL["compare_by_level"] = f"""
SELECT 'u' AS variable, level, {scalar('u', 'u2')} FROM {ZONAL_PAIR} GROUP BY GROUPING SETS ((level), ())
UNION ALL SELECT 'v', level, {scalar('v', 'v2')} FROM {ZONAL_PAIR} GROUP BY GROUPING SETS ((level), ())"""
SQL["compare_vector"] = f"SELECT 'Winds' AS variable, level, {vectorial('u', 'v', 'u2', 'v2')} FROM {PAIR} GROUP BY GROUPING SETS ((level), ())"
SQL["align_levels"] = f"""
WITH q AS (SELECT cell, level * 2 - 0.5 AS level, u2 AS u FROM {PAIR}), axis AS (SELECT DISTINCT level AS x FROM {FIELD} WHERE level BETWEEN 1.5 AND 7),
b AS (SELECT cell, level AS x0, lead(level) OVER w AS x1, u AS u0, lead(u) OVER w AS u1 FROM q WINDOW w AS (PARTITION BY cell ORDER BY level))
SELECT b.cell, x AS level, {r('f.u')} AS u, {r('u0 + (x - x0) / (x1 - x0) * (u1 - u0)')} AS u_cmp FROM b JOIN axis ON x >= x0 AND x < x1 JOIN {FIELD} f ON f.cell = b.cell AND f.level = x"""
SQL["align_times"] = f"SELECT time, level, cell, {r('u')} AS u, {r('u')} AS u_cmp FROM {MONTHLY} WHERE time BETWEEN 5 AND 8"

# Dynamics ---------------------------------------------------------------------


def eddies(source: str, keys: str, pairs: list[tuple[str, str]], means: list[str]) -> str:
    names = sorted({v for p in pairs for v in p} | {*means})
    own = ", ".join(f"avg({v}) OVER (PARTITION BY {keys}, ring) AS m_{v}" for v in names)
    products = ", ".join(f"avg(({a} - m_{a}) * ({b} - m_{b})) AS {a}_{b}" for a, b in pairs)
    return f"(SELECT {keys}, ring, {', '.join(f'avg({v}) AS {v}' for v in means)}, {products} FROM (SELECT *, {own} FROM (SELECT *, {ring('cell', 4)} AS ring FROM {source})) GROUP BY {keys}, ring)"


SQL["eddy_covariance"] = f"SELECT level, ring, {r(lat('ring', 4))} AS lat, {r('u')} AS u, {r('temp')} AS temp, {r('u_v')} AS u_v, {r('v_temp')} AS v_temp, {r('u_omega')} AS u_omega FROM {eddies(GAPPY, 'level', [('u', 'v'), ('v', 'temp'), ('u', 'omega')], ['u', 'temp'])}"


def gradient(f: str, x: str, w: str) -> str:
    """Second-order derivative over a named window."""
    g = lambda e, k: f"lead({e}, {k}) OVER {w}" if k > 0 else f"lag({e}, {-k}) OVER {w}" if k else e
    a, b = f"({x} - {g(x, -1)})", f"({g(x, 1)} - {x})"
    c, d = f"({g(x, 2)} - {g(x, 1)})", f"({g(x, -1)} - {g(x, -2)})"
    first = f"(-(2 * {b} + {c}) / ({b} * ({b} + {c})) * {f} + ({b} + {c}) / ({b} * {c}) * {g(f, 1)} - {b} / ({c} * ({b} + {c})) * {g(f, 2)})"
    last = f"({a} / ({d} * ({a} + {d})) * {g(f, -2)} - ({a} + {d}) / ({a} * {d}) * {g(f, -1)} + (2 * {a} + {d}) / ({a} * ({a} + {d})) * {f})"
    inner = f"(({a} * {a} * {g(f, 1)} + ({b} * {b} - {a} * {a}) * {f} - {b} * {b} * {g(f, -1)}) / ({a} * {b} * ({a} + {b})))"
    return f"(CASE WHEN {g(x, -1)} IS NULL THEN {first} WHEN {g(x, 1)} IS NULL THEN {last} ELSE {inner} END)"


ZONAL = f"(SELECT level, ring, {lat('ring', 4)} AS lat, u, temp FROM (SELECT level, {ring('cell', 4)} AS ring, avg(u) AS u, avg(temp) AS temp FROM {FIELD} GROUP BY ALL))"
SQL["gradient_latitude"] = f"SELECT level, ring, {r(gradient('u', 'lat', 'w'))} AS u_y FROM {ZONAL} WINDOW w AS (PARTITION BY level ORDER BY lat)"
SQL["gradient_level"] = f"SELECT level, ring, {r(gradient('temp', 'level', 'w'))} AS t_z FROM {ZONAL} WINDOW w AS (PARTITION BY ring ORDER BY level)"
SQL["gravity_profile"] = """
SELECT h AS height, round(9.80665 * (6371000.0::DOUBLE / (6371000.0::DOUBLE + h)) ** 2, 9) AS gravity, round(6371000.0::DOUBLE * h / (6371000.0::DOUBLE - h), 5) AS geometric, round(2 * 7.292e-5::DOUBLE * sin(radians(h / 2000)), 12) AS f
FROM (SELECT unnest(range(121)) * 1000.0::DOUBLE AS h)"""
SQL["hydrostatic_pressure"] = """
SELECT height, round(rho, 9) AS rho, round(1.0 + sum(layer) OVER (ORDER BY height DESC), 5) AS pressure FROM (
  SELECT height, rho, coalesce((rho + lag(rho) OVER w) / 2 * 9.80665 * (lag(height) OVER w - height), 0.0) AS layer
  FROM (SELECT h AS height, 1.225::DOUBLE * exp(-h / 7000) AS rho FROM (SELECT unnest(range(61)) * 1000.0::DOUBLE AS h)) WINDOW w AS (ORDER BY height DESC))"""
SQL["scale_height"] = f"SELECT {r('greatest(-1 / regr_slope(ln(100000.0 * exp(-level / 7)), level * 1000 + u), 1000.0)', 4)} AS scale_height FROM {FIELD}"

ATMOSPHERE = f"(SELECT 100000.0::DOUBLE / level AS level, cell, u, v * 100 AS v, temp / 1000 + 300 * sqrt(level) AS theta, omega - 0.05::DOUBLE AS omega FROM {FIELD})"
EDDIES = f"(SELECT level, ring, {lat('ring', 4)} AS lat, u, theta, u_v AS upvp, v_theta AS vpthetap, u_omega AS upomegap FROM {eddies(ATMOSPHERE, 'level', [('u', 'v'), ('v', 'theta'), ('u', 'omega')], ['u', 'theta'])})"
COS, A, DEG = "cos(radians(lat))", "6371000.0::DOUBLE", "(180 / pi())"
UP, ACROSS = "up AS (PARTITION BY ring ORDER BY level)", "ax AS (PARTITION BY level ORDER BY lat)"


def floored(c: str) -> str:
    return f"(CASE WHEN abs({c}) >= 1e-10 THEN {c} WHEN {c} < 0 THEN -1e-10 ELSE 1e-10 END)"


def flux_pressure(mode: str, source: str = EDDIES) -> str:
    f_hat = "f" if mode == "qg" else "(f - shear)"
    f_phi = "-upvp" if mode == "qg" else "u_p * flux - upvp"
    lift = "upomegap" if mode == "full" else "0.0"
    return f"""
  (SELECT *, {A} * {COS} * ({f_phi}) AS f_phi, {A} * {COS} * ({f_hat} * flux - {lift}) AS f_z, -{gradient('flux', 'level', 'up')} AS v_star, {gradient(f'(flux * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) AS w_star FROM (
    SELECT *, 2 * 7.292e-5::DOUBLE * sin(radians(lat)) AS f, vpthetap / {floored('theta_g')} AS flux FROM (
      SELECT *, {gradient('u', 'level', 'up')} AS u_p, {gradient('theta', 'level', 'up')} AS theta_g, {gradient(f'(u * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) AS shear FROM {source} WINDOW {UP}, {ACROSS})) WINDOW {UP}, {ACROSS})"""


for _mode in ("full", "tem", "qg"):
    SQL[f"ep_flux_{_mode}"] = f"SELECT round(level, 4) AS level, ring, round(f_phi / 1e6::DOUBLE, 4) AS f_phi, round(f_z / 1e6::DOUBLE, 4) AS f_z, round(v_star, 6) AS v_star, round(w_star, 6) AS w_star FROM {flux_pressure(_mode)}"
SQL["ep_divergence"] = f"""
SELECT round(level, 4) AS level, ring, round(d, 3) AS divergence, round(d / ({A} * {COS}) * 86400, 3) AS a_ep FROM (
  SELECT *, {gradient(f'(f_phi * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) + {gradient('f_z', 'level', 'up')} AS d FROM {flux_pressure('full')} WINDOW {UP}, {ACROSS})"""
HIGH = f"(SELECT 7000.0 * ln(1e5 / level) + 1000.0 AS level, ring, lat, u, theta, upvp, vpthetap, -upomegap / 10 AS upwp, vpthetap / 1000 AS wpthetap FROM {EDDIES})"
SQL["ep_flux_height"] = f"""
SELECT round(level, 3) AS level, ring, round(psi / 1e3, 4) AS psi, round((-rho * {A} * {COS} * upvp + psi * u_z) / 1e6, 4) AS f_phi, round((-rho * {A} * {COS} * upwp + psi * (f - shear)) / 1e6, 4) AS f_z FROM (
  SELECT *, {A} * {COS} * rho * (vpthetap * theta_z - wpthetap * theta_y) / greatest(theta_y * theta_y + theta_z * theta_z, 1e-30) AS psi FROM (
    SELECT * REPLACE ({floored('theta_z')} AS theta_z), 1.225 * exp(-level / 7000) AS rho, 2 * 7.292e-5::DOUBLE * sin(radians(lat)) AS f FROM (
      SELECT *, {gradient('u', 'level', 'up')} AS u_z, {gradient('theta', 'level', 'up')} AS theta_z, {gradient('theta', 'lat', 'ax')} * {DEG} / {A} AS theta_y, {gradient(f'(u * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) AS shear
      FROM {HIGH} WINDOW {UP}, {ACROSS})))"""

# Tides and spectra ------------------------------------------------------------

HOURLY = f"(SELECT cell, hour(time)::DOUBLE AS hour, avg(value) AS value FROM {located(OBS, 2)} GROUP BY ALL)"


def fit(periods: str) -> str:
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    one, two, three, right = ("cc", "cs", "sc"), ("cs", "ss", "sn"), ("sc", "sn", "n"), ("yc", "ys", "sy")
    whole = det(one, two, three)
    solve = lambda a, b, c: f"CASE WHEN n >= 3 AND abs({whole}) > 1e-9 * n ** 3 THEN {det(a, b, c)} / {whole} END"
    return f"""
  (SELECT cell, period_h, {solve(right, two, three)} AS c, {solve(one, right, three)} AS s, {solve(one, two, right)} AS mean FROM (
    SELECT cell, period_h, count(*)::DOUBLE AS n, sum(c * c) AS cc, sum(s * s) AS ss, sum(c * s) AS cs, sum(c) AS sc, sum(s) AS sn, sum(value * c) AS yc, sum(value * s) AS ys, sum(value) AS sy FROM (
      SELECT cell, value, period_h, cos(hour * 2 * pi() / period_h) AS c, sin(hour * 2 * pi() / period_h) AS s FROM {HOURLY}, (SELECT unnest({periods}) AS period_h)) GROUP BY ALL))"""


SQL["tide_ls"] = f"SELECT cell, period_h, {r('c', 5)} AS c, {r('s', 5)} AS s, {r('mean', 5)} AS mean, {r('sqrt(c * c + s * s)', 5)} AS amplitude FROM {fit('[24.0, 12.0, 8.0]::DOUBLE[]')}"
SQL["tide_sym_asy"] = f"""
WITH f AS (SELECT *, {ring('cell', 2)} AS ring FROM {fit('[24.0]::DOUBLE[]')}), m AS (SELECT *, cell - {start('ring', 2)} + {start('(8 - ring)', 2)} AS other FROM f)
SELECT a.period_h, a.cell, {r('(a.c + b.c) / 2', 5)} AS c_sym, {r('(a.c - b.c) / 2', 5)} AS c_asy, {r('(a.s + b.s) / 2', 5)} AS s_sym, {r('(a.s - b.s) / 2', 5)} AS s_asy FROM f a JOIN m b ON a.cell = b.other"""


#: Every cell of every level, gaps at the level's mean.
DENSE = f"""(SELECT level, cell, u IS NULL AS gap, coalesce(u, avg(u) OVER s) AS u, coalesce(v, avg(v) OVER s) AS v
  FROM (SELECT DISTINCT level FROM {FIELD}) CROSS JOIN (SELECT unnest(range(192)) AS cell) LEFT JOIN {FIELD} USING (level, cell) WINDOW s AS (PARTITION BY level))"""


def fourier(value: str, orders: str, source: str = FIELD) -> str:
    return f"""
  (SELECT level, ring, m, sum({value} * cos(m * radians(t * 90))) * (CASE WHEN m = 0 THEN 1.0 ELSE 2.0 END) / sz AS a, CASE WHEN m = 0 THEN 0.0 ELSE sum({value} * sin(m * radians(t * 90))) * 2.0 / sz END AS b
   FROM (SELECT *, {size('ring', 4)} AS sz, {turn('cell', 'ring', 4)} AS t FROM (SELECT *, {ring('cell', 4)} AS ring FROM {source})), (SELECT unnest({orders}) AS m) GROUP BY level, ring, m, sz)"""


SQL["ring_fourier"] = f"SELECT level, ring, m, {r('a')} AS a, {r('b')} AS b FROM {fourier('u', '[0, 1, 2, 3]')}"


def alm(value: str) -> str:
    """Coefficients up to degree 2 by the polynomials of the associated Legendre functions."""
    lam = """CASE WHEN l = 0 THEN sqrt(1 / (4 * pi())) WHEN l = 1 AND m = 0 THEN sqrt(3 / (4 * pi())) * z WHEN l = 1 THEN -sqrt(3 / (8 * pi())) * sqrt(1 - z * z)
      WHEN m = 0 THEN sqrt(5 / (16 * pi())) * (3 * z * z - 1) WHEN m = 1 THEN -sqrt(15 / (8 * pi())) * z * sqrt(1 - z * z) ELSE sqrt(15 / (32 * pi())) * (1 - z * z) END"""
    return f"""
  (SELECT level, l, m, sum(a * sz * ({lam})) AS re, sum(-b * sz * ({lam})) AS im FROM (
    SELECT *, {size('ring', 4)} / (CASE WHEN m = 0 THEN 1.0 ELSE 2.0 END) * 4 * pi() / 192 AS sz, {ring_z('ring', 4)} AS z FROM {fourier(value, '[0, 1, 2]', DENSE)}), (SELECT unnest([0, 1, 2]) AS l) WHERE l >= m GROUP BY ALL)"""


SQL["power_spectrum_low_l"] = f"SELECT level, l, {r('sum((re * re + im * im) * (CASE WHEN m = 0 THEN 1 ELSE 2 END)) / (2 * l + 1)', 4)} AS power FROM {alm('u')} GROUP BY level, l"
SQL["cross_spectrum_low_l"] = f"SELECT a.level, a.l, {r('sum((a.re * b.re + a.im * b.im) * (CASE WHEN a.m = 0 THEN 1 ELSE 2 END)) / (2 * a.l + 1)', 5)} AS power FROM {alm('u')} a JOIN {alm('v')} b ON a.level = b.level AND a.l = b.l AND a.m = b.m GROUP BY a.level, a.l"
SQL["filter_lmax"] = f"""
WITH c AS (SELECT level, max(CASE WHEN l = 0 THEN re END) AS c00, max(CASE WHEN l = 1 AND m = 0 THEN re END) AS c10, max(CASE WHEN l = 1 AND m = 1 THEN re END) AS c11, max(CASE WHEN l = 1 AND m = 1 THEN im END) AS d11 FROM {alm('u')} GROUP BY level)
SELECT level, cell, CASE WHEN NOT gap THEN {r('c00 * sqrt(1 / (4 * pi())) + c10 * sqrt(3 / (4 * pi())) * z - 2 * sqrt(3 / (8 * pi())) * sqrt(1 - z * z) * (c11 * cos(radians(lon)) - d11 * sin(radians(lon)))', 5)} END AS u FROM c JOIN (SELECT level, cell, gap FROM {DENSE}) USING (level) JOIN {pixels(4)} USING (cell)"""

# Winds of degree 1 from the derivatives of three functions.
CALM = f"(SELECT level, cell, coalesce(u, 0.0) AS u, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT level FROM {FIELD}) CROSS JOIN (SELECT unnest(range(192)) AS cell) LEFT JOIN {FIELD} USING (level, cell))"


def wind_sums(source: str) -> str:
    return f"""
  (SELECT level, sum(w * (-v) * d10) / sqrt(2) AS e10, sum(w * u * d10) / sqrt(2) AS b10,
     sum(w * ((-v) * d11 * cos(p) - u * t11 * sin(p))) / sqrt(2) AS er, sum(w * (-(-v) * d11 * sin(p) - u * t11 * cos(p))) / sqrt(2) AS ei,
     sum(w * (u * d11 * cos(p) + (-v) * t11 * sin(p))) / sqrt(2) AS br, sum(w * (-u * d11 * sin(p) + (-v) * t11 * cos(p))) / sqrt(2) AS bi
   FROM (SELECT level, u, v, 4 * pi() / 192 AS w, radians(lon) AS p, -sqrt(3 / (4 * pi())) * sqrt(1 - z * z) AS d10, -sqrt(3 / (8 * pi())) * z AS d11, -sqrt(3 / (8 * pi())) AS t11
     FROM {source} JOIN {pixels(4)} USING (cell)) GROUP BY level)"""


_scale = "(-sqrt(2) / 6371229.0)"
_synth = "({a}10 * sqrt(3 / (4 * pi())) * z - 2 * sqrt(3 / (8 * pi())) * sqrt(1 - z * z) * ({a}r * cos(radians(lon)) - {a}i * sin(radians(lon))))"
SQL["vorticity_divergence_low_l"] = f"""
SELECT level, cell, CASE WHEN NOT gap THEN {r(_scale + ' * 1e6 * ' + _synth.format(a='b'))} END AS vorticity, CASE WHEN NOT gap THEN {r(_scale + ' * 1e6 * ' + _synth.format(a='e'))} END AS divergence
FROM {wind_sums(CALM)} JOIN (SELECT level, cell, gap FROM {DENSE}) USING (level) JOIN {pixels(4)} USING (cell)"""
SQL["kinetic_spectrum_low_l"] = f"""
SELECT level, unnest([0, 1]) AS l, unnest([0.0::DOUBLE, {r('(e10 * e10 + 2 * (er * er + ei * ei) + b10 * b10 + 2 * (br * br + bi * bi)) / 6', 5)}]) AS power FROM {wind_sums(DENSE)}"""

# A Morlet transform by the definition of the discrete Fourier transform.
SERIES = f"""(SELECT cell, hour, coalesce(value, mean) AS value FROM (SELECT hour, avg(value) AS mean FROM {HOURLY} GROUP BY hour) CROSS JOIN (SELECT unnest(range(48)) AS cell) LEFT JOIN {HOURLY} USING (cell, hour))"""
SQL["wavelet_spectrum"] = f"""
WITH rings AS (
  SELECT hour, ring, 2.0 / sz * sum(value * cos(radians(t * 90))) AS a, 2.0 / sz * sum(value * sin(radians(t * 90))) AS b, sz
  FROM (SELECT *, {size('ring', 2)} AS sz, {turn('cell', 'ring', 2)} AS t FROM (SELECT *, {ring('cell', 2)} AS ring FROM {SERIES})) GROUP BY hour, ring, sz),
x AS (SELECT ring, sz, n, hour, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY hour) - 1 AS n FROM rings) WINDOW w AS (PARTITION BY ring)),
k AS (SELECT unnest(range(1, 32)) AS k),
xh AS (SELECT ring, k, sum(a * cos(2 * pi() * k * n / 64)) AS ar, -sum(a * sin(2 * pi() * k * n / 64)) AS ai, sum(b * cos(2 * pi() * k * n / 64)) AS br, -sum(b * sin(2 * pi() * k * n / 64)) AS bi FROM x, k GROUP BY ring, k),
s AS (SELECT 2.0 * 2 ** (j * 0.25) AS s FROM (SELECT unnest(range(CAST(floor(log2(24 / 2.0) / 0.25) AS BIGINT) + 1)) AS j)),
d AS (SELECT s, k, sqrt(2 * pi() * s) * pi() ** -0.25 * exp(-((s * 2 * pi() * k / 64 - 6) ** 2) / 2) / 64 * sqrt(1 / s) AS d FROM s, k),
wv AS (
  SELECT x.ring, sz, s, x.hour, x.n, sum(d * (ar * cos(2 * pi() * k * n / 64) - ai * sin(2 * pi() * k * n / 64))) AS ar, sum(d * (ar * sin(2 * pi() * k * n / 64) + ai * cos(2 * pi() * k * n / 64))) AS ai,
    sum(d * (br * cos(2 * pi() * k * n / 64) - bi * sin(2 * pi() * k * n / 64))) AS br, sum(d * (br * sin(2 * pi() * k * n / 64) + bi * cos(2 * pi() * k * n / 64))) AS bi
  FROM x JOIN xh ON x.ring = xh.ring JOIN d USING (k) GROUP BY x.ring, sz, s, x.hour, x.n)
SELECT {r('s * 4 * pi() / (6 + sqrt(38))', 5)} AS period_h, hour, {r('sum(sqrt((ar + bi) ** 2 + (br - ai) ** 2) / 2 * sz) / 48', 5)} AS west, {r('sum(sqrt((ar - bi) ** 2 + (-ai - br) ** 2) / 2 * sz) / 48', 5)} AS east, {r('4 * pi() / (6 + sqrt(38)) / sqrt(2) * greatest(least(n, 23 - n), 1e-5)', 5)} AS coi_h FROM wv GROUP BY s, hour, n"""

SQL["unit_conversion"] = f"SELECT level, cell, {r('u + 273.15')} AS u, {r('temp * 100')} AS temp, {r('v / 3.6')} AS v FROM {FIELD}"
