"""DuckDB SQL of dense transforms: spherical harmonics by recurrence, wavelets by the definition of their sums."""

from __future__ import annotations

from zonalis.plans.oracles import ACROSS, CALM, COS, DEG, FIELD, GAPPY, HOURLY, SERIES, UP, A, eddies, fit, flux_pressure, gradient, lat, pixels, r, ring, size, turn

SQL: dict[str, str] = {}

METRES = "6371229.0::DOUBLE"

# Spherical harmonics ----------------------------------------------------------


def basis(n: int, lmax: int) -> str:
    """cell, l, m, p (normalised Legendre function), d (its slope in colatitude), t (m p / sine), c, s (cosine and sine of m times longitude), k (2 for m > 0)."""
    top = "(CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END) * sqrt((2 * m + 1) / (4 * pi()) * factorial((2 * m)::INTEGER)::DOUBLE / (power(4.0::DOUBLE, m) * factorial(m::INTEGER)::DOUBLE * factorial(m::INTEGER)::DOUBLE)) * power(sqrt(1 - z * z), m)"
    ratio = lambda l: f"sqrt(({l} * {l} - m * m) / (4.0::DOUBLE * {l} * {l} - 1))"
    return f"""
  (WITH RECURSIVE px AS (SELECT cell, z::DOUBLE AS z, radians(lon) AS phi FROM {pixels(n)}), orders AS (SELECT unnest(range({lmax + 1})) AS m),
   rec AS (SELECT cell, z, phi, m, m AS l, ({top})::DOUBLE AS p, 0.0::DOUBLE AS q FROM px, orders
     UNION ALL SELECT cell, z, phi, m, l + 1, (z * p - (CASE WHEN l > m THEN {ratio('l')} ELSE 0.0 END) * q) / {ratio('(l + 1)')}, p FROM rec WHERE l < {lmax})
   SELECT cell, l, m, p, (l * z * p - sqrt((2 * l + 1) * (l * l - m * m) / greatest(2 * l - 1, 1)::DOUBLE) * q) / sqrt(1 - z * z) AS d, m * p / sqrt(1 - z * z) AS t,
     cos(m * phi) AS c, sin(m * phi) AS s, CASE WHEN m = 0 THEN 1 ELSE 2 END AS k FROM rec)"""


def analysis(name: str, source: str, key: str, n: int, iterations: int = 3) -> str:
    """CTEs that end in ``name`` (key, l, m, re, im): coefficients of source (key, cell, x), refined; ``y`` is the basis."""
    weight = f"4 * pi() / {12 * n * n}"
    parts = [f"{name}_x0 AS (SELECT {key}, cell, x FROM {source})"]
    for i in range(iterations + 1):
        out = f"{name}_{i}" if i < iterations else name
        sums = f"SELECT {key}, l, m, {weight} * sum(x * p * c) AS re, -{weight} * sum(x * p * s) AS im FROM {name}_x{i} JOIN y USING (cell) GROUP BY ALL"
        parts.append(f"{out} AS ({sums})" if i == 0 else f"{out} AS (SELECT {key}, l, m, a.re + b.re AS re, a.im + b.im AS im FROM {name}_{i - 1} a JOIN ({sums}) b USING ({key}, l, m))")
        if i < iterations:
            parts.append(f"{name}_x{i + 1} AS (SELECT {key}, cell, f.x - g.x AS x FROM {name}_x0 f JOIN ({synthesis(out, key)}) g USING ({key}, cell))")
    return ", ".join(parts)


def synthesis(coefficients: str, key: str, re: str = "re", im: str = "im", into: str = "x") -> str:
    return f"SELECT {key}, cell, sum(k * p * (({re}) * c - ({im}) * s)) AS {into} FROM {coefficients} JOIN y USING (l, m) GROUP BY ALL"


def power(re: str = "re", im: str = "im") -> str:
    return f"sum(({re} * {re} + {im} * {im}) * (CASE WHEN m = 0 THEN 1 ELSE 2 END)) / (2 * l + 1)"


def filled(source: str) -> str:
    """Every cell of every level of source, gaps at the level's mean."""
    return f"""(SELECT level, cell, u IS NULL OR v IS NULL AS gap, u IS NULL AS u_gap, coalesce(u, avg(u) OVER s) AS u, coalesce(v, avg(v) OVER s) AS v
    FROM (SELECT DISTINCT level FROM {FIELD}) CROSS JOIN (SELECT unnest(range(192)) AS cell) LEFT JOIN {source} USING (level, cell) WINDOW s AS (PARTITION BY level))"""


WAVELENGTH = "2 * pi() * 6371.229 / sqrt(greatest(l, 1) * (greatest(l, 1) + 1.0))"
SQL["power_spectrum"] = f"""
WITH y AS {basis(4, 11)}, {analysis('a', f'(SELECT level, cell, u AS x FROM {filled(GAPPY)})', 'level', 4)}
SELECT level, l::INTEGER AS l, {r(WAVELENGTH, 5)} AS wavelength_km, {r(power(), 5)} AS power FROM a GROUP BY level, l"""
_sigma = "radians(20.0) / sqrt(8 * ln(2.0))"
_bell = f"exp(-l * (l + 1) * ({_sigma}) * ({_sigma}) / 2)"
SQL["filter_gauss"] = f"""
WITH y AS {basis(4, 11)}, {analysis('a', f'(SELECT level, cell, u AS x FROM {filled(GAPPY)})', 'level', 4)}
SELECT level, cell, CASE WHEN NOT u_gap THEN {r('x', 5)} END AS u FROM ({synthesis('a', 'level', f're * {_bell}', f'im * {_bell}')}) JOIN (SELECT level, cell, u_gap FROM {filled(GAPPY)}) USING (level, cell)"""


def wind_parts(source: str) -> str:
    """CTE w: gradient part (er, ei) and curl part (br, bi) of the winds of source (level, cell, u, v)."""
    scale = "/ sqrt(l * (l + 1.0)) * 4 * pi() / 192"
    return f"""w AS (SELECT level, l, m, sum(-v * d * c - u * t * s) {scale} AS er, sum(v * d * s - u * t * c) {scale} AS ei, sum(u * d * c - v * t * s) {scale} AS br, sum(-u * d * s - v * t * c) {scale} AS bi
    FROM {source} JOIN y USING (cell) WHERE l > 0 GROUP BY level, l, m)"""


def winds_of(coefficients: str, er: str = "er", ei: str = "ei", br: str = "br", bi: str = "bi") -> str:
    """(level, cell, u, v) of gradient and curl parts."""
    f = "sqrt(l * (l + 1.0))"
    return f"""SELECT level, cell, sum(k / {f} * ((({br}) * d - ({ei}) * t) * c - (({bi}) * d + ({er}) * t) * s)) AS u, -sum(k / {f} * ((({er}) * d + ({bi}) * t) * c - (({ei}) * d - ({br}) * t) * s)) AS v
    FROM {coefficients} JOIN y USING (l, m) WHERE l > 0 GROUP BY ALL"""


SQL["kinetic_spectrum"] = f"""
WITH y AS {basis(4, 11)}, {wind_parts(filled(FIELD))}
SELECT level, l::INTEGER AS l, {r(WAVELENGTH, 5)} AS wavelength_km, {r(f"({power('er', 'ei')} + {power('br', 'bi')}) / 2", 5)} AS power FROM w GROUP BY level, l
UNION ALL SELECT DISTINCT level, 0, {r('2 * pi() * 6371.229 / sqrt(2.0)', 5)}, 0.0 FROM w"""
_up = f"-sqrt(l * (l + 1.0)) / {METRES}"
GAPS = f"(SELECT level, cell, gap FROM {filled(FIELD)})"
CURL = f"""curl AS (SELECT level, cell, z.x AS vorticity, q.x AS divergence FROM ({synthesis('w', 'level', f'{_up} * br', f'{_up} * bi')}) z JOIN ({synthesis('w', 'level', f'{_up} * er', f'{_up} * ei')}) q USING (level, cell))"""
SQL["vorticity_divergence"] = f"""
WITH y AS {basis(4, 11)}, {wind_parts(CALM)}, {CURL}
SELECT level, cell, CASE WHEN NOT gap THEN {r('vorticity', 10)} END AS vorticity, CASE WHEN NOT gap THEN {r('divergence', 10)} END AS divergence FROM curl JOIN {GAPS} USING (level, cell)"""
_down = f"-{METRES} / sqrt(l * (l + 1.0))"
SQL["winds_from_vorticity_divergence"] = f"""
WITH y AS {basis(4, 11)}, {wind_parts(CALM)}, {CURL}, seen AS (SELECT level, cell, CASE WHEN gap THEN 0.0 ELSE vorticity END AS vorticity, CASE WHEN gap THEN 0.0 ELSE divergence END AS divergence FROM curl JOIN {GAPS} USING (level, cell)),
{analysis('zz', '(SELECT level, cell, vorticity AS x FROM seen)', 'level', 4)}, {analysis('dd', '(SELECT level, cell, divergence AS x FROM seen)', 'level', 4)},
both_parts AS (SELECT level, l, m, {_down} * dd.re AS er, {_down} * dd.im AS ei, {_down} * zz.re AS br, {_down} * zz.im AS bi FROM zz JOIN dd USING (level, l, m) WHERE l > 0)
SELECT level, cell, CASE WHEN NOT gap THEN {r('u', 5)} END AS u, CASE WHEN NOT gap THEN {r('v', 5)} END AS v FROM ({winds_of('both_parts')}) JOIN {GAPS} USING (level, cell)"""
_inverse = f"{METRES} / sqrt(l * (l + 1.0))"
_shown = ", ".join(f"CASE WHEN NOT gap THEN {r(e, 5)} END AS {c}" for e, c in (("rot.u", "u_rot"), ("rot.v", "v_rot"), ("dvg.u", "u_div"), ("dvg.v", "v_div"), ("ps.x / 1e6", "psi"), ("ch.x / 1e6", "chi")))
SQL["helmholtz_potentials"] = f"""
WITH y AS {basis(4, 11)}, {wind_parts(CALM)}
SELECT level, cell, {_shown} FROM ({winds_of('w', '0', '0')}) rot JOIN ({winds_of('w', br='0', bi='0')}) dvg USING (level, cell)
JOIN ({synthesis('w', 'level', f'{_inverse} * br', f'{_inverse} * bi')}) ps USING (level, cell) JOIN ({synthesis('w', 'level', f'{_inverse} * er', f'{_inverse} * ei')}) ch USING (level, cell) JOIN {GAPS} USING (level, cell)"""

# Tides ------------------------------------------------------------------------


def directed(period: float, m: int) -> str:
    """Amplitude and phase of the part of one period that travels with wavenumber m."""
    sign = -1 if m > 0 else 1
    re, im = f"(a.re - {sign} * b.im) / 2", f"(a.im + {sign} * b.re) / 2"
    lon = f"({m} * radians(lon))"
    return f"""(WITH f AS {fit(f'[{period}]::DOUBLE[]').replace(HOURLY, SERIES)}, {analysis('a', "(SELECT 0 AS one, cell, coalesce(c, 0.0) AS x FROM f)", 'one', 2)}, {analysis('b', "(SELECT 0 AS one, cell, coalesce(s, 0.0) AS x FROM f)", 'one', 2)},
    kept AS (SELECT one, l, m, {re} AS re, {im} AS im FROM a JOIN b USING (one, l, m) WHERE m = {abs(m)}),
    maps AS (SELECT cell, cc.x AS c, ss.x AS s, lon FROM ({synthesis('kept', 'one')}) cc JOIN ({synthesis('kept', 'one', f'{sign} * im', f'{-sign} * re')}) ss USING (cell) JOIN {pixels(2)} USING (cell))
    SELECT cell, {period}::DOUBLE AS period_h, {m}::INTEGER AS m, {r('sqrt(c * c + s * s)', 5)} AS amplitude, {r(f'atan2(s * cos({lon}) + c * sin({lon}), c * cos({lon}) - s * sin({lon}))', 5)} AS phase FROM maps)"""


SQL["tide_directional"] = f"WITH y AS {basis(2, 4)} SELECT * FROM {directed(24.0, 1)} UNION ALL SELECT * FROM {directed(12.0, -2)}"

RINGS = f"""(SELECT hour, ring, 2.0 / sz * sum(value * cos(radians(t * 90))) AS a, 2.0 / sz * sum(value * sin(radians(t * 90))) AS b
  FROM (SELECT *, {size('ring', 2)} AS sz, {turn('cell', 'ring', 2)} AS t FROM (SELECT *, {ring('cell', 2)} AS ring FROM {SERIES})) GROUP BY hour, ring, sz)"""


def morlet(source: str, key: str, dj: float) -> str:
    """CTEs that end in wv: key, s (scale), hour, n and the scaled coefficients of the series a, b of 24 hours, padded to 64."""
    wave = lambda re, im: f"sum(d * ({re} * cos(2 * pi() * k * n / 64) - {im} * sin(2 * pi() * k * n / 64)))"
    other = lambda re, im: f"sum(d * ({re} * sin(2 * pi() * k * n / 64) + {im} * cos(2 * pi() * k * n / 64)))"
    return f"""
wx AS (SELECT {key}, n, hour, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY hour) - 1 AS n FROM {source}) WINDOW w AS (PARTITION BY {key})),
wk AS (SELECT unnest(range(1, 32)) AS k),
wh AS (SELECT {key}, k, sum(a * cos(2 * pi() * k * n / 64)) AS ar, -sum(a * sin(2 * pi() * k * n / 64)) AS ai, sum(b * cos(2 * pi() * k * n / 64)) AS br, -sum(b * sin(2 * pi() * k * n / 64)) AS bi FROM wx, wk GROUP BY {key}, k),
ws AS (SELECT 2.0::DOUBLE * power(2.0::DOUBLE, j * {dj}::DOUBLE) AS s FROM (SELECT unnest(range(CAST(floor(log2(24 / 2.0) / {dj}) AS BIGINT) + 1)) AS j)),
wd AS (SELECT s, k, sqrt(2 * pi() * s) * pi() ** -0.25 * exp(-((s * 2 * pi() * k / 64 - 6) ** 2) / 2) / 64 * sqrt(1 / s) AS d FROM ws, wk),
wv AS (SELECT wx.{key}, s, wx.hour, wx.n, {wave('ar', 'ai')} AS ar, {other('ar', 'ai')} AS ai, {wave('br', 'bi')} AS br, {other('br', 'bi')} AS bi FROM wx JOIN wh ON wx.{key} = wh.{key} JOIN wd USING (k) GROUP BY wx.{key}, s, wx.hour, wx.n)"""


#: Period of a scale of 1.
FACTOR = "(4 * pi() / (6 + sqrt(38)))"


def demodulated(source: str) -> str:
    """Time-mean amplitudes and phases at the scales nearest to 24 and 12 hours, of series by ring."""
    angle = f"(2 * pi() / (s * {FACTOR}) * n)"
    turned = lambda x, y: (f"avg(({x}) * cos({angle}) - ({y}) * sin({angle}))", f"avg(({x}) * sin({angle}) + ({y}) * cos({angle}))")
    (wx, wy), (ex, ey) = turned("(ar + bi) / 2", "(br - ai) / 2"), turned("(ar - bi) / 2", "(-ai - br) / 2")
    return f"""{morlet(source, 'ring', 0.1)}, chosen AS (SELECT p AS period_h, arg_min(s, abs(s * {FACTOR} - p)) AS s FROM ws, (SELECT unnest([24.0, 12.0]::DOUBLE[]) AS p) GROUP BY p),
means AS (SELECT ring, period_h, s, {wx} AS wx, {wy} AS wy, {ex} AS ex, {ey} AS ey FROM wv JOIN chosen USING (s) GROUP BY ring, period_h, s)
SELECT ring, period_h, {r(f's * {FACTOR}', 5)} AS scale_period_h, {r('sqrt(wx * wx + wy * wy)', 5)} AS west_amplitude, {r('atan2(wy, wx)', 5)} AS west_phase, {r('sqrt(ex * ex + ey * ey)', 5)} AS east_amplitude, {r('atan2(ey, ex)', 5)} AS east_phase FROM means"""


ORDERS = analysis("a", f"(SELECT hour, cell, value AS x FROM {SERIES})", "hour", 2)
SQL["tide_wavelet"] = f"WITH {demodulated(RINGS)}"
SQL["tide_wavelet_harmonic"] = f"""
WITH y AS {basis(2, 4)}, {ORDERS}, tables AS (SELECT DISTINCT ring, l, p FROM y JOIN (SELECT cell, ring FROM {pixels(2)}) USING (cell) WHERE m = 1 AND cell IN (SELECT min(cell) FROM {pixels(2)} GROUP BY ring)),
own AS (SELECT hour, ring, sum(2 * re * p) AS a, sum(-2 * im * p) AS b FROM a JOIN tables USING (l) WHERE m = 1 GROUP BY hour, ring), {demodulated('own')}"""
SQL["harmonic_wavelet_spectrum"] = f"""
WITH y AS {basis(2, 4)}, {ORDERS}, own AS (SELECT hour, l, 2 * re AS a, -2 * im AS b FROM a WHERE m = 1), {morlet('own', 'l', 0.25)}
SELECT {r(f's * {FACTOR}', 5)} AS period_h, hour, {r('sqrt(sum(((ar + bi) ** 2 + (br - ai) ** 2) / 4)) / sqrt(2 * pi())', 5)} AS west, {r('sqrt(sum(((ar - bi) ** 2 + (-ai - br) ** 2) / 4)) / sqrt(2 * pi())', 5)} AS east,
  {r(f'{FACTOR} / sqrt(2) * greatest(least(n, 23 - n), 1e-5)', 5)} AS coi_h FROM wv GROUP BY s, hour, n"""

# Eliassen-Palm chain ----------------------------------------------------------

AIR = f"(SELECT 100000.0::DOUBLE / level AS level, cell, u, v * 100 AS v, (200 + temp / 1000) * power(level::DOUBLE, 287.05::DOUBLE / 1004.64::DOUBLE) AS theta, omega - 0.05::DOUBLE AS omega FROM {FIELD})"
MEANS = f"(SELECT level, ring, {lat('ring', 4)} AS lat, u, theta, u_v AS upvp, v_theta AS vpthetap, u_omega AS upomegap FROM {eddies(AIR, 'level', [('u', 'v'), ('v', 'theta'), ('u', 'omega')], ['u', 'theta'])})"
_beside = " OR ".join(f"({f}(1) OVER {w} IS NOT NULL AND {f}(d) OVER {w} IS NULL)" for f in ("lag", "lead") for w in ("up", "ax"))
SQL["eliassen_palm_chain"] = f"""
SELECT round(level, 4) AS level, ring, round(f_phi / 1e6::DOUBLE, 3) AS f_phi, CASE WHEN NOT beside THEN round(d, 2) END AS divergence FROM (
  SELECT *, {_beside} AS beside FROM (
    SELECT *, {gradient(f'(f_phi * {COS})', 'lat', 'ax')} * {DEG} / ({A} * {COS}) + {gradient('f_z', 'level', 'up')} AS d FROM {flux_pressure('full', MEANS)} WINDOW {UP}, {ACROSS}) WINDOW {UP}, {ACROSS})"""
