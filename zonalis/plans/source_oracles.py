"""DuckDB SQL of the queries on reading, naming, writing, streams and figures."""

from __future__ import annotations

from zonalis.plans import harmonic_oracles
from zonalis.plans.oracles import A, ACROSS, COS, DEG, FIELD, GAPPY, MONTHLY, OBS, REGULAR, UP, ZONAL, ZONAL_GAPPY, along, faces, flux_pressure, gradient, lat, located, pixels, r, ring
from zonalis.plans.oracles import SQL as GRID

SQL: dict[str, str] = {}

# Reading, naming and writing --------------------------------------------------

SQL["cleaned_missing"] = f"SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN {r('value')} END AS value, {r('event_id % 240 / 10')} AS hours FROM {OBS}"
SQL["merged_fields"] = f"SELECT level, cell, {r('u')} AS u, CASE WHEN level <= 4 THEN {r('v')} END AS v, CASE WHEN level > 4 THEN {r('temp')} END AS temp FROM {FIELD}"
SQL["placed_by_grid_table"] = f"SELECT level, cell, {r('u')} AS u, {r('lon')} AS lon, {r('lat')} AS lat FROM {FIELD} JOIN {pixels(4)} USING (cell)"
SQL["mapped_variables"] = f"SELECT level, cell, {r('u')} AS wind, {r('temp')} AS heat FROM {FIELD}"
SQL["variables_of_a_swath"] = f"SELECT level, cell, {r('u')} AS u, {r('temp')} AS temp FROM {FIELD}"
SQL["stored_formats"] = f"SELECT store, level, cell, {r('u')} AS u FROM {FIELD}, (SELECT unnest(['.parquet', '.orc', '.csv', '.json']) AS store)"


def whole_circle(source: str) -> str:
    return f"""(SELECT max(gap) <= 1.5 * quantile_cont(gap, 0.5) FROM (
      SELECT coalesce(lead(lon) OVER (ORDER BY lon), min(lon) OVER () + 360) - lon AS gap FROM (SELECT DISTINCT lon FROM {source})))"""


SQL["axis_facts"] = f"""
WITH p AS (SELECT lon, lat FROM {pixels(4)}), f AS (SELECT DISTINCT level FROM {FIELD}),
steps AS (SELECT lead(t) OVER (ORDER BY t) - t AS step FROM (SELECT DISTINCT epoch(date_trunc('hour', time)) / 3600 AS t FROM {OBS}))
SELECT (SELECT max(abs(lat)) <= 90.5 AND max(abs(lon)) <= 400 FROM p) AS geographic, (SELECT 2 * max(abs(lat)) <= 90.5 FROM p) AS beyond_poles, {whole_circle('p')} AS whole_circle, {whole_circle('(SELECT lon FROM p WHERE lon < 180)')} AS half_circle,
  (SELECT max(abs(lon)) > 2 * pi() FROM p) AS degrees, (SELECT radians(max(abs(lon))) > 2 * pi() FROM p) AS radians, (SELECT max(level) <= 500 AND bool_and(level = round(level)) FROM f) AS level_index, (SELECT bool_and(level / 2 = round(level / 2)) FROM f) AS half_levels,
  (SELECT quantile_cont(step, 0.5)::DOUBLE FROM steps) AS step_hours"""
SQL["elapsed_hours"] = f"SELECT event_id, {r('(epoch_us(time) - min(epoch_us(time)) OVER ()) / 3.6e9', 5)} AS hours FROM {OBS}"
SQL["grid_constants"] = f"""
SELECT zoom, 1 << zoom AS nside, 12 * (1 << zoom) * (1 << zoom) AS npix, {r('4 * pi() / (12 * power(4, zoom))')} AS area, {r('6371 * sqrt(4 * pi() / (12 * power(4, zoom)))')} AS km,
  CAST(power(2, round(log2(greatest(1, sqrt(power(5, zoom + 1) / 12))))) AS BIGINT) AS nside_for, zoom + 1 IN (1, 2, 4, 8) AS valid FROM (SELECT unnest(range(11)) AS zoom)"""
SQL["tide_names"] = "SELECT * FROM (VALUES ('DW1', 24.0::DOUBLE, 1::BIGINT), ('SW2', 12, 2), ('SE2', 12, -2), ('DE3', 24, -3), ('TW3', 8, 3), ('QE4', 6, -4), ('DS0', 24, 0), ('3', NULL, 3), ('-2', NULL, -2)) AS t(name, period_h, m)"
SQL["curvilinear_cells"] = f"SELECT level, CAST((lat + 84) / 12 * 24 + lon / 15 AS BIGINT) AS cell, {r('lat')} AS lat, {r('lon')} AS lon, {r('u')} AS u FROM {REGULAR}"
SQL["healpix_to_coarser_nested"] = f"SELECT level, cell_nest >> 2 AS cell, {r('avg(u)')} AS u FROM {FIELD} JOIN {faces(4)} ON cell_ring = cell GROUP BY ALL"
SQL["interpolate_radians"] = GRID["interpolate_unstructured"]
SQL["stream_daily_bins"] = f"""
WITH o AS (SELECT *, date_trunc('day', time) AS start, max(time) OVER () AS last FROM {located(OBS, 4)})
SELECT day(start) AS day, ring, {r('avg(value)')} AS value, count(*) AS samples FROM o WHERE value IS NOT NULL AND start + INTERVAL 1 DAY <= last - INTERVAL 6 HOUR GROUP BY start, ring"""

# What figures show ------------------------------------------------------------

SQL["figure_section"] = f"SELECT level, {r(lat('ring', 4))} AS lat, {r('u')} AS u FROM {ZONAL_GAPPY}"
_mean = f"(SELECT level, cell, avg(u) AS u FROM {MONTHLY} GROUP BY ALL)"
SQL["figure_section_meridian"] = f"SELECT level, lat, u FROM ({along('(SELECT target, 77.0::DOUBLE AS lon, -90.0 + target * (180.0::DOUBLE / 15) AS lat FROM (SELECT unnest(range(16)) AS target))', ['u']).replace(FIELD, _mean)})"
SQL["figure_keogram"] = f"""
SELECT time, level, {r('sum(u * w) / sum(w)')} AS u FROM (SELECT time, level, avg(u) AS u, cos(radians({lat('ring', 4)})) AS w FROM (SELECT time, level, u, {ring('cell', 4)} AS ring FROM {MONTHLY}) GROUP BY time, level, ring) GROUP BY time, level"""
SQL["figure_map"] = f"SELECT cell, {r('u')} AS u FROM {FIELD} WHERE level = 3"
SQL["figure_spectrum"] = f"""
WITH s AS (SELECT cell % 24 AS l, avg(u / (cell + 1)) AS power FROM {FIELD} WHERE cell % 24 > 0 GROUP BY ALL), m AS (SELECT quantile_cont(l, 0.5) AS l0, quantile_cont(power, 0.5) AS p0 FROM s)
SELECT l, {r('power')} AS power, {r('p0 * power(l / l0, -3)')} AS slope_3, {r('p0 * power(l / l0, -5.0 / 3)')} AS slope_5_3 FROM s, m"""
SQL["figure_tides"] = f"""
SELECT level, ring, {r('atan2(avg(u * sin(v * 10)), avg(u * cos(v * 10)))')} AS phase, {r('avg(u)')} AS amplitude FROM (SELECT level, u, v, {ring('cell', 4)} AS ring FROM {FIELD} WHERE cell % 2 = 1) GROUP BY ALL"""
SQL["figure_arrows"] = f"SELECT level, ring, {r(f'u * {COS} * sqrt(1e5 / level)', 4)} AS arrow_x, {r(f'temp * {COS} * sqrt(1e5 / level)', 4)} AS arrow_y FROM {ZONAL} WHERE abs(lat) <= 85 AND ring % 2 = 0"
SQL["figure_arrows_edmon"] = f"SELECT level, ring, {r(f'2 * pi() / 9.80665 * {COS} * {A} * u / 1e6', 4)} AS arrow_x, {r(f'2 * pi() / 9.80665 * {COS} * {A} * {A} * temp / 100 / 1e12', 4)} AS arrow_y FROM {ZONAL} WHERE abs(lat) <= 85 AND ring % 2 = 0"
SQL["tide_wavelet_cells"] = f"SELECT w.*, p.cell, {r('p.lon')} AS lon FROM ({harmonic_oracles.SQL['tide_wavelet']}) w JOIN {pixels(2)} p USING (ring)"
_beside = " OR ".join(f"({f}(1) OVER {w} IS NOT NULL AND {f}(d) OVER {w} IS NULL)" for f in ("lag", "lead") for w in ("up", "ax"))
_holed = f"(SELECT * REPLACE (CASE WHEN NOT (ring = 5 AND level BETWEEN 30000 AND 40000) THEN f_phi END AS f_phi) FROM {flux_pressure('full')})"
SQL["ep_divergence_edge"] = f"""
SELECT round(level, 4) AS level, ring, CASE WHEN NOT beside AND level >= 20000 THEN round(d, 3) END AS divergence, CASE WHEN NOT beside AND level >= 20000 THEN round(d / ({A} * {COS}) * 86400, 3) END AS a_ep FROM (
  SELECT *, {_beside} AS beside FROM (
    SELECT *, {gradient(f'(f_phi * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) + {gradient('f_z', 'level', 'up')} AS d FROM {_holed} WINDOW {UP}, {ACROSS}) WINDOW {UP}, {ACROSS})"""
