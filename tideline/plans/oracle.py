"""DuckDB SQL for the queries, written for itself: set-based statements over the same tables."""

from __future__ import annotations

from ..operators.geo import GERMANY_OUTLINE, STATES

PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
AHEAD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
W = "PARTITION BY series_id ORDER BY ts"
PI = "3.141592653589793"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def stamp(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def fill(x: str = "x") -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER ({W} {PAST}), first_value({x} IGNORE NULLS) OVER ({W} {AHEAD}))"


def local(c: str = "ts") -> str:
    return f"timezone('Europe/Berlin', {c} AT TIME ZONE 'UTC')"


def frame(agg: str, n: int, back: int, x: str = "x") -> str:
    f = f"({W} ROWS BETWEEN {back + n - 1} PRECEDING AND {back} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {agg}({x}) OVER {f} END"


def lag(k: int, x: str = "x") -> str:
    return f"lag({x}, {k}) OVER ({W})"


HOURLY = "hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS x FROM events GROUP BY 1, 2)"
GAPPY = "gappy AS (SELECT series_id, ts, CASE WHEN (hour(ts) * 7 + day(ts)) % 11 <> 0 THEN x END AS x FROM hourly)"


def dense(name: str, source: str, step: str = "1 HOUR") -> str:
    return f"{name} AS (SELECT g.series_id, g.ts, s.x FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {source} GROUP BY series_id) g LEFT JOIN {source} s ON s.series_id = g.series_id AND s.ts = g.ts)"


SINGLE = "single AS (SELECT event_type AS series_id, ts, min(value) AS v FROM events GROUP BY 1, 2)"
CLEAN = f"{HOURLY}, {dense('dense', 'hourly')}, clean AS (SELECT series_id, ts, {fill()} AS x FROM dense)"
TRIMMED = "trimmed AS (SELECT g.* FROM gappy g JOIN (SELECT series_id, min(ts) lo, max(ts) hi FROM gappy WHERE x IS NOT NULL GROUP BY 1) e ON g.series_id = e.series_id AND g.ts BETWEEN e.lo AND e.hi)"
DAILY = f"raw_days AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2), {dense('dense_days', 'raw_days', '1 DAY')}, days AS (SELECT series_id, ts, {fill()} AS x FROM dense_days)"
TEMP = f"warm AS (SELECT *, round(sin(hour(ts) * 2 * {PI} / 24) * 10 + 12 + (floor(x) - 17 * floor(floor(x) / 17)), 4) AS temp FROM clean)"
SCORED = "TIMESTAMP '2024-01-10'"
BASED = f"based AS (SELECT *, {lag(168)} AS seasonal_naive, {lag(24)} AS yesterday, ({lag(168)} + {lag(336)} + {lag(504)} + {lag(672)}) / 4 AS mean_last_4_weeks FROM clean)"
PRED = f"{CLEAN}, {BASED}, pred AS (SELECT series_id, ts, x AS y, 'seasonal_naive' AS model, seasonal_naive AS pred FROM based WHERE ts >= {SCORED} UNION ALL SELECT series_id, ts, x, 'yesterday', yesterday FROM based WHERE ts >= {SCORED})"
FOLDS = """folds AS (SELECT k + 1 AS fold, TIMESTAMP '1998-01-01' + INTERVAL (6 * k - 12) MONTH AS val_start, TIMESTAMP '1998-01-01' + INTERVAL (6 * k) MONTH AS test_start,
 least(TIMESTAMP '1998-01-01' + INTERVAL (6 * k + 6) MONTH, last + INTERVAL 1 HOUR) AS test_end FROM (SELECT unnest(range(0, 40)) AS k), (SELECT max(ts) AS last FROM days)
 WHERE (SELECT count(DISTINCT ts) FROM days WHERE ts >= TIMESTAMP '1998-01-01' + INTERVAL (6 * k) MONTH) >= 60)"""
ROLES = "roles AS (SELECT d.*, f.*, CASE WHEN ts < val_start THEN 'train' WHEN ts < test_start THEN 'validation' ELSE 'test' END AS role FROM days d JOIN folds f ON d.ts < f.test_end)"
DAY_PRED = f"{DAILY}, {FOLDS}, day_based AS (SELECT *, {lag(7)} AS seasonal_naive, {lag(1)} AS yesterday FROM days), day_pred AS (SELECT b.series_id, b.ts, f.fold, f.test_start, b.x AS y, m.model, CASE m.model WHEN 'yesterday' THEN yesterday ELSE seasonal_naive END AS pred FROM day_based b JOIN folds f ON b.ts >= f.test_start AND b.ts < f.test_end CROSS JOIN (VALUES ('seasonal_naive'), ('yesterday')) m(model))"
MODED = f"{DAY_PRED}, moded AS (SELECT *, 'none' AS mode FROM day_pred WHERE model = 'yesterday' UNION ALL SELECT series_id, ts, fold, test_start, y, model, pred + (y - pred) * 0.1 * (fold % 3), 'noisy' FROM day_pred WHERE model = 'yesterday'), tidy AS (SELECT fold, test_start, model, mode, avg(abs(pred - y)) AS mae FROM moded GROUP BY ALL)"
FOLD_DELTA = "deltas AS (SELECT a.fold, a.test_start, a.model, a.mae AS first, b.mae AS second, b.mae - a.mae AS delta FROM tidy a JOIN tidy b USING (fold, test_start, model) WHERE a.mode = 'none' AND b.mode = 'noisy')"


def normal(seed: str, tag: str = "noise") -> str:
    digest = f"md5('{tag}|' || {seed} || '|' || series_id || '|' || CAST(epoch(ts) AS BIGINT))"

    def u(at: int) -> str:
        return f"((('0x' || substr({digest}, {at}, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"

    return f"(sqrt(ln({u(1)}) * -2.0) * cos(({u(13)}) * 6.283185307179586))"


# ---- geography -----------------------------------------------------------------------------

EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(GERMANY_OUTLINE[:-1], GERMANY_OUTLINE[1:], strict=True)) + ") e(x1, y1, x2, y2))"
STATE_ROWS = "states AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s[0]}', {s[1]}::DOUBLE, {s[2]}::DOUBLE, {s[3]}::DOUBLE)" for i, s in enumerate(STATES)) + ") s(idx, region, pop, clat, clon))"
CUSTOMERS = "cells AS (SELECT DISTINCT 47.0::DOUBLE + (c_custkey * 37 % 641) * 0.0125::DOUBLE AS lat, 5.5::DOUBLE + (c_custkey * 101 % 641) * 0.015625::DOUBLE AS lon FROM customer)"
BOX = "cells AS (SELECT 47.0::DOUBLE + i * 0.25::DOUBLE AS lat, 5.5::DOUBLE + j * 0.25::DOUBLE AS lon FROM range(0, 33) a(i), range(0, 41) b(j))"
ON_EDGE = "(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-9 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))"
INSIDE = f"{EDGES}, inside AS (SELECT lat, lon, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1 AND NOT bool_or({ON_EDGE}) AS inside FROM cells, edges GROUP BY ALL)"
NEAREST = f"{STATE_ROWS}, nearest AS (SELECT lat, lon, region, pop FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY pow(lat - clat, 2) + pow((lon - clon) * cos(radians(lat)), 2), idx) AS n FROM cells, states) WHERE n = 1), people AS (SELECT *, pop / count(*) OVER (PARTITION BY region) AS pop_w FROM nearest)"
WEIGHTS = "w AS (SELECT 'box' AS kind, lat, lon, cos(radians(lat)) AS w FROM cells UNION ALL SELECT 'land', lat, lon, cos(radians(lat)) FROM inside WHERE inside UNION ALL SELECT 'population', i.lat, i.lon, cos(radians(i.lat)) * pop_w FROM inside i JOIN people p ON i.lat = p.lat AND i.lon = p.lon WHERE inside)"
GRID_ONLY = f"hours AS (SELECT ts, round(sum(x), 3) AS v FROM hourly GROUP BY ts), {BOX}, grid AS (SELECT ts, lat, lon, (v - 40 * floor(v / 40)) - 10 + lat * 0.5 - lon * 0.25 AS t2m FROM hours, cells)"
GRID = f"{HOURLY}, {GRID_ONLY}"


# ---- sun -----------------------------------------------------------------------------------

SITES = "sites AS (SELECT n_name AS site_id, 35.0::DOUBLE + n_nationkey * 0.8::DOUBLE AS lat, -10.0::DOUBLE + n_nationkey * 1.5::DOUBLE AS lon, (n_nationkey + 1)::DOUBLE AS share FROM nation)"
TIMES = "times AS (SELECT DISTINCT ts, 8.0::DOUBLE + hour(ts) * 0.5::DOUBLE AS air FROM hourly)"
SKY = f"""{SITES}, {TIMES},
s1 AS (SELECT *, (epoch(ts) / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t FROM sites, times),
s2 AS (SELECT *, 280.46646::DOUBLE + t * (36000.76983::DOUBLE + t * 0.0003032::DOUBLE) AS lraw, radians(357.52911::DOUBLE + t * (35999.05029::DOUBLE - t * 0.0001537::DOUBLE)) AS m, 0.016708634::DOUBLE - t * (0.000042037::DOUBLE + t * 0.0000001267::DOUBLE) AS e, radians(125.04::DOUBLE - 1934.136::DOUBLE * t) AS node,
 23.0::DOUBLE + (26.0::DOUBLE + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60.0::DOUBLE) / 60.0::DOUBLE AS tilt FROM s1),
s3 AS (SELECT *, radians(lraw - 360 * floor(lraw / 360)) AS l0, sin(m) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t)) + sin(2 * m) * (0.019993::DOUBLE - 0.000101::DOUBLE * t) + sin(3 * m) * 0.000289::DOUBLE AS c FROM s2),
s4 AS (SELECT *, radians(degrees(l0) + c - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(node)) AS lam, radians(tilt + 0.00256::DOUBLE * cos(node)) AS eps FROM s3),
s5 AS (SELECT *, asin(sin(eps) * sin(lam)) AS decl, pow(tan(eps / 2), 2) AS y FROM s4),
s6 AS (SELECT *, 4 * degrees(y * sin(2 * l0) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l0) - 0.5::DOUBLE * y * y * sin(4 * l0) - 1.25::DOUBLE * e * e * sin(2 * m)) AS eot_minutes FROM s5),
s7 AS (SELECT *, (hour(ts) * 60 + minute(ts) + eot_minutes + 4 * lon) / 4 AS solar_deg FROM s6),
s8 AS (SELECT *, radians(solar_deg - 360 * floor(solar_deg / 360) - 180) AS ha, radians(lat) AS phi FROM s7),
s9 AS (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha))))) AS zenith, degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180 AS az FROM s8),
s10 AS (SELECT *, az - 360 * floor(az / 360) AS azimuth, 90 - zenith AS elevation, degrees(decl) AS declination, zenith < 90 AS daylight, cos(radians(greatest(0.0::DOUBLE, least(90.0::DOUBLE, zenith)))) AS cz FROM s9),
s11 AS (SELECT *, CASE WHEN zenith >= 90 THEN 0 ELSE greatest(0.0::DOUBLE, 1098.0::DOUBLE * cz * exp(-0.059::DOUBLE / greatest(cz, 1e-6::DOUBLE))) END AS cs_ghi, CASE WHEN zenith < 90 THEN 1 / (cz + 0.50572::DOUBLE * pow(96.07995::DOUBLE - greatest(0.0::DOUBLE, zenith), -1.6364::DOUBLE)) END AS am FROM s10),
s12 AS (SELECT *, CASE WHEN zenith >= 90 THEN 0 ELSE greatest(0.0::DOUBLE, least(1361.0::DOUBLE * (1 + 0.033::DOUBLE * cos(2 * {PI}::DOUBLE * dayofyear(ts) / 365.25::DOUBLE)) * pow(0.7::DOUBLE, pow(am, 0.678::DOUBLE)), CASE WHEN cz > 1e-6::DOUBLE THEN cs_ghi / cz ELSE 0 END)) END AS cs_dni, sqrt(3.0::DOUBLE) / 2 AS cb FROM s11),
s13 AS (SELECT *, CASE WHEN zenith >= 90 THEN 0 ELSE cs_dni * greatest(0.0::DOUBLE, cz * cb + sin(radians(zenith)) * 0.5::DOUBLE * cos(radians(azimuth - 180))) + greatest(0.0::DOUBLE, cs_ghi - cs_dni * cz) * (1 + cb) / 2 + cs_ghi * 0.2::DOUBLE * (1 - cb) / 2 END AS cs_poa FROM s12),
sky AS (SELECT *, air + 25.0::DOUBLE / 800 * cs_poa AS cell_c, 1 - 0.004::DOUBLE * (air + 25.0::DOUBLE / 800 * cs_poa - 25) AS derate FROM s13)"""
SKY_COLUMNS = ["zenith", "elevation", "declination", "eot_minutes", "cs_ghi", "cs_dni", "cs_poa", "cell_c", "derate"]
FLEET = SKY + ", tot AS (SELECT sum(share) AS total FROM sites), fleet0 AS (SELECT ts, " + ", ".join(f"sum(share / total * {c}) AS {c}" for c in SKY_COLUMNS) + ", sum(share / total * cs_poa / 1000 * derate) AS cs_output, degrees(atan2(sum(share / total * sin(radians(azimuth))), sum(share / total * cos(radians(azimuth))))) AS az, bool_or(daylight) AS daylight FROM sky, tot GROUP BY ts), fleet AS (SELECT *, az - 360 * floor(az / 360) AS azimuth FROM fleet0)"
SOLAR = f"{CLEAN}, {FLEET}, solar AS (SELECT c.series_id, c.ts, c.x, f.* EXCLUDE (ts), 8.0::DOUBLE + hour(c.ts) * 0.5::DOUBLE AS temp, round(coalesce(f.cs_poa, 0) / 1000.0::DOUBLE * (c.x - 7 * floor(c.x / 7) + 1) / 8.0::DOUBLE, 3) AS cf FROM clean c LEFT JOIN fleet f ON f.ts = c.ts)"
RATIO = "ratio AS (SELECT *, CASE WHEN cs_poa > 1 AND cf IS NOT NULL THEN least(cf / cs_poa, 2.0::DOUBLE) END AS kt FROM solar)"
SOLAR_BASED = f"{RATIO}, sbased AS (SELECT *, {lag(24, 'cf')} AS yesterday, {lag(168, 'cf')} AS last_week, coalesce(CASE WHEN {lag(24, 'kt')} * cs_poa IS NOT NULL THEN greatest(0.0::DOUBLE, {lag(24, 'kt')} * cs_poa) END, {lag(24, 'cf')}) AS clearsky_persistence FROM ratio)"


def cyc(v: str, period: int, name: str) -> str:
    return f"{r(f'sin(2 * {PI} * {v} / {period})')} AS {name}_sin, {r(f'cos(2 * {PI} * {v} / {period})')} AS {name}_cos"


HOUR, DOW, MONTH, DOY = f"hour({local()})", f"(isodow({local()}) - 1)", f"month({local()})", f"dayofyear({local()})"
CALENDAR = f"{HOUR} AS hour, {DOW} AS dayofweek, {MONTH} AS month, ({DOW} >= 5)::BIGINT AS is_weekend"
CYCLES = f"{cyc(HOUR, 24, 'hour')}, {cyc(DOW, 7, 'dow')}, {cyc(DOY, 365, 'doy')}"
HISTORY = {f"lag_{k}h": lag(k) for k in (24, 48, 72, 168, 336)} | {"roll_mean_24h": frame("avg", 24, 24), "roll_mean_168h": frame("avg", 168, 24), "roll_std_24h": frame("stddev_samp", 24, 24), "same_hour_3wk_mean": f"({lag(168)} + {lag(336)} + {lag(504)}) / 3"}
WARM = {"temp_c": "temp", "hdh": "greatest(0.0, 15 - temp)", "cdh": "greatest(0.0, temp - 22)", "temp_roll_mean_24h": frame("avg", 24, 0, "temp"), "temp_change_24h": f"temp - {lag(24, 'temp')}"}


def named(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


def figures(x: str, digits: int = 6) -> str:
    """A number to so many significant figures, as text: scaled and whole, then its power of ten."""
    return f"CASE WHEN {x} = 0 THEN '0' ELSE round({x} * pow(10.0, {digits - 1} - floor(log10(abs({x})))))::BIGINT || '|' || floor(log10(abs({x})))::BIGINT END"


# Easter by a day-count method (full moon table in closed form), not the one the library uses.
EASTER = """easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM (SELECT *, b // 4 AS d, b % 4 AS e, (b - (b + 8) // 25 + 1) // 3 AS g FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1992, 2003) t(y)))))))"""
HOLIDAYS = f"{EASTER}, holidays AS (SELECT DISTINCT unnest([make_date(y, 1, 1), make_date(y, 5, 1), make_date(y, 10, 3), make_date(y, 12, 25), make_date(y, 12, 26), (sunday - INTERVAL 2 DAY)::DATE, (sunday + INTERVAL 1 DAY)::DATE, (sunday + INTERVAL 39 DAY)::DATE, (sunday + INTERVAL 50 DAY)::DATE]) AS day FROM easter)"
FEATURE_SQL = f"WITH {CLEAN}, f AS (SELECT *, {named(HISTORY)} FROM clean) SELECT series_id, {stamp()} AS ts, {r('x')} AS x, {CALENDAR}, (strftime({local()}, '%m-%d') = '01-01')::BIGINT AS is_holiday, {CYCLES}, {rounded(HISTORY)} FROM f WHERE same_hour_3wk_mean IS NOT NULL AND roll_std_24h IS NOT NULL AND roll_mean_168h IS NOT NULL"
SOLAR_HISTORY = {f"lag_{k}h": lag(k, "cf") for k in (24, 48, 72, 168)} | {"roll_mean_24h": frame("avg", 24, 24, "cf"), "roll_mean_168h": frame("avg", 168, 24, "cf")}
SOLAR_CAL = f"{HOUR} AS hour, {MONTH} AS month, {cyc(HOUR, 24, 'hour')}, {cyc(DOY, 365, 'doy')}"
SOLAR_GEO = f"{rounded(['cs_poa', 'cs_ghi', 'elevation', 'azimuth'])}, daylight::BIGINT AS is_daylight"
DAY_LAGS = {f"lag_{k}": lag(k) for k in (1, 2, 3, 7, 14)} | {"mean_7": frame("avg", 7, 1)}
READY = f"lagged AS (SELECT *, {named(DAY_LAGS)} FROM days), ready AS (SELECT * FROM lagged WHERE lag_14 IS NOT NULL AND mean_7 IS NOT NULL)"
POKED = f"poked AS (SELECT series_id, ts, x + CASE WHEN ts = TIMESTAMP '2024-01-05 06:00:00' THEN 50000.0 ELSE 0 END AS x FROM clean), fa AS (SELECT *, {named(HISTORY)} FROM clean), fb AS (SELECT *, {named(HISTORY)} FROM poked)"
DIFFERS = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in HISTORY}

SCORES = f"{r('avg(abs(pred - y))')} AS mae, {r('sqrt(avg((pred - y) * (pred - y)))')} AS rmse, {r('avg(abs((pred - y) / nullif(y, 0))) * 100')} AS mape, count(*) FILTER (y = 0 AND y IS NOT NULL) AS n_zero, {r('avg(pred - y)')} AS bias"

ORACLE_SQL: dict[str, str] = {
    "series_trim": f"WITH {HOURLY}, {GAPPY}, {TRIMMED} SELECT series_id, {stamp()} AS ts, {r('x')} AS x FROM trimmed",
    "series_densify": f"WITH {HOURLY}, {dense('dense', 'hourly')} SELECT series_id, {stamp()} AS ts, {r('x')} AS x FROM dense",
    "series_fill": f"WITH {HOURLY}, {GAPPY}, {dense('dense', 'gappy')} SELECT series_id, {stamp()} AS ts, {r(fill())} AS x FROM dense",
    "series_carry_in_fill": f"WITH {HOURLY}, {GAPPY}, {dense('dense', 'gappy')} SELECT series_id, {stamp()} AS ts, {r(fill())} AS x FROM dense",
    "series_interpolate": f"""WITH {HOURLY}, {GAPPY}, {TRIMMED}, {dense('dense', 'trimmed')},
 w AS (SELECT *, last_value(x IGNORE NULLS) OVER ({W} {PAST}) AS x0, last_value(CASE WHEN x IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER ({W} {PAST}) AS t0, first_value(x IGNORE NULLS) OVER ({W} {AHEAD}) AS x1, first_value(CASE WHEN x IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER ({W} {AHEAD}) AS t1 FROM dense)
 SELECT series_id, {stamp()} AS ts, {r('CASE WHEN x IS NOT NULL THEN x ELSE x0 + (x1 - x0) * least((epoch(ts) - t0) / 3600, 2.0) / ((t1 - t0) / 3600) END')} AS x FROM w""",
    "series_gap_report": f"WITH {HOURLY}, {GAPPY}, {dense('dense', 'gappy')}, d AS (SELECT *, CASE WHEN hour(ts) <> 5 THEN x END AS y FROM dense) SELECT series_id, count(*) AS n_rows, count(*) - count(x) AS missing_x, {r('(count(*) - count(x)) / count(*)')} AS share_x, count(*) - count(y) AS missing_y, {r('(count(*) - count(y)) / count(*)')} AS share_y, count(*) FILTER (x IS NULL OR y IS NULL) AS missing_any FROM d GROUP BY series_id",
    "series_spread_daily": f"WITH {CLEAN}, c AS (SELECT series_id, ts, x, CASE WHEN hour(ts) = 12 THEN x * 2 + 100 END AS cap FROM clean), f AS (SELECT series_id, ts, x, {fill('cap')} AS capacity_mw FROM c) SELECT series_id, {stamp()} AS ts, {r('x')} AS x, {r('capacity_mw')} AS capacity_mw, {r('x / nullif(capacity_mw, 0)')} AS cf FROM f",
    "series_asof": f"WITH {CLEAN}, {SINGLE}, b AS (SELECT c.series_id, c.ts, e.ts AS ets, e.v FROM clean c ASOF LEFT JOIN single e ON c.series_id = e.series_id AND c.ts >= e.ts), f AS (SELECT c.series_id, c.ts, e.ts AS ets, e.v FROM clean c ASOF LEFT JOIN single e ON c.series_id = e.series_id AND c.ts <= e.ts) SELECT b.series_id, {stamp('b.ts')} AS ts, {r('CASE WHEN b.ts - b.ets <= INTERVAL 20 MINUTE THEN b.v END')} AS before, CASE WHEN b.ts - b.ets <= INTERVAL 20 MINUTE THEN {stamp('b.ets')} END AS before_ts, {r('CASE WHEN f.ets - f.ts <= INTERVAL 20 MINUTE THEN f.v END')} AS after, CASE WHEN f.ets - f.ts <= INTERVAL 20 MINUTE THEN {stamp('f.ets')} END AS after_ts FROM b JOIN f ON b.series_id = f.series_id AND b.ts = f.ts",
    "series_spread_off_grid": f"WITH {CLEAN}, cap AS (SELECT series_id, ts + INTERVAL 17 MINUTE AS ts, x * 2 + 100 AS v FROM clean WHERE hour(ts) = 12 AND day(ts) % 3 = 0), first AS (SELECT series_id, arg_min(v, ts) AS v FROM cap GROUP BY 1) SELECT c.series_id, {stamp('c.ts')} AS ts, {r('coalesce(e.v, first.v)')} AS capacity_mw FROM clean c ASOF LEFT JOIN cap e ON c.series_id = e.series_id AND c.ts >= e.ts LEFT JOIN first ON first.series_id = c.series_id",
    "series_reconcile_irregular": f"WITH {HOURLY}, a AS (SELECT event_type AS series_id, ts, value FROM events), b AS (SELECT a.series_id, abs(a.value - CASE WHEN a.ts - h.ts <= INTERVAL 1 HOUR THEN h.x END) AS d FROM a ASOF LEFT JOIN hourly h ON a.series_id = h.series_id AND a.ts >= h.ts) SELECT series_id, count(d) AS n_compared, {r('max(d)')} AS max_diff, count(*) FILTER (d > 50.0) AS n_over FROM b GROUP BY 1",
    "series_align_irregular": f"WITH {CLEAN}, {SINGLE}, k AS (SELECT series_id, ts + INTERVAL 1234 SECOND AS ts FROM clean WHERE hour(ts) % 6 = 5) SELECT k.series_id, {stamp('k.ts')} AS ts, {r('e.v')} AS value FROM k ASOF LEFT JOIN single e ON k.series_id = e.series_id AND k.ts >= e.ts",
    "series_pick": f"WITH {CLEAN} SELECT series_id, count(*) AS n, {r('sum(x)')} AS x FROM clean WHERE series_id IN ('click', 'view') GROUP BY 1",
    "interval_totals": f"WITH {DAILY}, p AS (SELECT p_partkey AS period, TIMESTAMP '1995-01-01' + to_days((p_partkey * 37 % 2400)::INT) AS lo, (p_partkey % 90 + 1)::INT AS n FROM part) SELECT period, count(*) AS n, sum(floor(x))::BIGINT AS x FROM days JOIN p ON ts >= lo AND ts < lo + to_days(p.n) GROUP BY period",
    "demand_features_stored": FEATURE_SQL,
    "source_seams_planned": f"WITH {HOURLY} SELECT series_id, {r('sum(CASE WHEN ts > $$2024-01-16 12:00:00$$::TIMESTAMP THEN x + 1 ELSE x END)')} AS x, count(*) AS n FROM hourly GROUP BY series_id",
    "geo_polygons": f"WITH k AS (SELECT n_nationkey AS poly_id, 35.0::DOUBLE + n_nationkey * 0.8::DOUBLE AS clat, -10.0::DOUBLE + n_nationkey * 1.5::DOUBLE AS clon, unnest(range(0, 12)) AS v FROM nation), c AS (SELECT poly_id, v, clon + (3.0::DOUBLE + (poly_id * 7 + v * 5) % 4 * 0.5::DOUBLE) * cos(v * 0.5235987755982988::DOUBLE) AS x, clat + (3.0::DOUBLE + (poly_id * 7 + v * 5) % 4 * 0.5::DOUBLE) * sin(v * 0.5235987755982988::DOUBLE) AS y FROM k), e AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.poly_id = b.poly_id AND b.v = (a.v + 1) % 12), p AS (SELECT c_custkey, 30.0::DOUBLE + (c_custkey * 0.618033988749895::DOUBLE - floor(c_custkey * 0.618033988749895::DOUBLE)) * 30 AS lat, -15.0::DOUBLE + (c_custkey * 0.754877666246693::DOUBLE - floor(c_custkey * 0.754877666246693::DOUBLE)) * 45 AS lon FROM customer) SELECT c_custkey, poly_id FROM p, e GROUP BY c_custkey, lat, lon, poly_id HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1 AND NOT bool_or({ON_EDGE})",
    "error_cube": f"WITH {DAY_PRED}, m AS (SELECT *, month(ts) AS mo, isodow(ts) - 1 AS wd FROM day_pred) SELECT CASE grouping_id(mo, wd, fold) WHEN 3 THEN 'month' WHEN 5 THEN 'weekday' WHEN 6 THEN 'fold' WHEN 2 THEN 'fold_month' ELSE 'all' END AS slice, model, concat_ws('|', fold, mo, wd) AS key, count(pred - y) AS n, {r('avg(abs(pred - y))')} AS mae, {r('sqrt(avg((pred - y) * (pred - y)))')} AS rmse, {r('avg(abs((pred - y) / nullif(y, 0))) * 100')} AS mape, {r('avg(pred - y)')} AS bias FROM m GROUP BY GROUPING SETS ((model, mo), (model, wd), (model, fold), (model, fold, mo), (model))",
    "lookback_profile": f"WITH {DAILY}, pk AS (SELECT series_id, ts, CASE WHEN (epoch(ts)::BIGINT // 86400) % 64 = 0 THEN x + 1e7 ELSE x END AS x FROM days), fa AS (SELECT series_id, ts, {named(DAY_LAGS)}, x AS own, 0 AS none FROM days), fb AS (SELECT series_id, ts, {named(DAY_LAGS)}, x AS own, 0 AS none FROM pk), d AS (SELECT CASE WHEN (epoch(fa.ts)::BIGINT // 86400) % 64 > 32 THEN (epoch(fa.ts)::BIGINT // 86400) % 64 - 64 ELSE (epoch(fa.ts)::BIGINT // 86400) % 64 END AS away, unnest([" + ", ".join(f"{{'c': '{c}', 'm': fa.{c} IS DISTINCT FROM fb.{c}}}" for c in [*DAY_LAGS, "own", "none"]) + "]) AS s FROM fa JOIN fb ON fa.series_id = fb.series_id AND fa.ts = fb.ts) SELECT s.c AS \"column\", min(away) FILTER (s.m) AS first, max(away) FILTER (s.m) AS last, count(DISTINCT away) FILTER (s.m) AS n_steps FROM d GROUP BY 1",
    "geo_nearest": f"WITH p AS (SELECT c_custkey AS point_id, 47.0::DOUBLE + (c_custkey * 0.618033988749895::DOUBLE - floor(c_custkey * 0.618033988749895::DOUBLE)) * 8 AS lat, 5.5::DOUBLE + (c_custkey * 0.754877666246693::DOUBLE - floor(c_custkey * 0.754877666246693::DOUBLE)) * 10 AS lon FROM customer), s AS (SELECT s_suppkey AS idx, 47.0::DOUBLE + (s_suppkey * 0.569840290998053::DOUBLE - floor(s_suppkey * 0.569840290998053::DOUBLE)) * 8 AS clat, 5.5::DOUBLE + (s_suppkey * 0.819172513396165::DOUBLE - floor(s_suppkey * 0.819172513396165::DOUBLE)) * 10 AS clon FROM supplier), d AS (SELECT point_id, idx, pow(lat - clat, 2) + pow((lon - clon) * cos(radians(lat)), 2) AS d2 FROM p, s) SELECT point_id, arg_min(idx, d2) AS idx, {r('min(d2)')} AS d2 FROM d GROUP BY 1",
    "series_reconcile": f"WITH {CLEAN}, c AS (SELECT series_id, abs(x / 5000.0 - round(x / 5000.0, 2)) AS d FROM clean) SELECT series_id, count(d) AS n_compared, {r('max(d)')} AS max_diff, count(*) FILTER (d > 0.004) AS n_over FROM c GROUP BY 1",
    "series_zone_capacity_factor": f"WITH {HOURLY}, {GAPPY}, {dense('dense', 'gappy')}, p AS (SELECT *, CASE WHEN count(x) OVER ({W} ROWS 167 PRECEDING) >= 48 THEN max(x) OVER ({W} ROWS 167 PRECEDING) END AS peak FROM dense), q AS (SELECT *, first_value(peak IGNORE NULLS) OVER ({W} {AHEAD}) AS p FROM p) SELECT series_id, {stamp()} AS ts, {r('x')} AS x, {r('CASE WHEN x / nullif(p, 0) IS NOT NULL THEN greatest(0.0, least(1.0, x / nullif(p, 0))) END')} AS cf FROM q",
    "series_align": f"WITH {CLEAN}, {GAPPY}, k AS (SELECT c.series_id, c.ts, g.x FROM clean c LEFT JOIN gappy g ON g.series_id = c.series_id AND g.ts = c.ts WHERE c.ts IN (SELECT ts FROM hourly WHERE series_id = (SELECT min(series_id) FROM hourly))) SELECT series_id, {stamp()} AS ts, {r(fill())} AS x FROM k",
    "series_shares": f"WITH {CLEAN}, m AS (SELECT series_id, avg(x) AS mean FROM clean GROUP BY 1) SELECT series_id, {r('mean')} AS mean, {r('mean / sum(mean) OVER ()')} AS share FROM m",
    "series_growth": f"WITH {HOURLY}, {GAPPY}, g AS (SELECT series_id, arg_min(x, ts) AS first, arg_max(x, ts) AS last FROM gappy WHERE x IS NOT NULL GROUP BY 1) SELECT series_id, {r('first')} AS first, {r('last')} AS last, {r('last / nullif(first, 0)')} AS ratio FROM g",
    "source_seams": f"WITH {HOURLY}, b AS (SELECT series_id, ts, x, 'a' AS f FROM hourly WHERE ts <= TIMESTAMP '2024-01-16 12:00:00' UNION ALL SELECT series_id, ts, x + 1, 'b' FROM hourly WHERE ts >= TIMESTAMP '2024-01-15'), k AS (SELECT series_id, ts, arg_min(x, f) AS x FROM b GROUP BY 1, 2), s AS (SELECT series_id, sum(x) AS x, count(*) AS n FROM k GROUP BY 1) SELECT series_id, {r('x')} AS x, n, (SELECT count(*) FROM b) AS n_rows, (SELECT count(*) FROM k) AS n_keys, (SELECT count(*) FROM b) - (SELECT count(*) FROM k) AS n_duplicates FROM s",
    "source_unpivot": f"SELECT {stamp('l_shipdate')} AS ts, l_returnflag AS series_id, {r('round(sum(l_extendedprice), 2)')} AS x FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_shipdate, l_returnflag",
    "source_wide_csv": f"WITH {HOURLY} SELECT {stamp()} AS ts, " + ", ".join(f"{r(f'max(x) FILTER (series_id = $${c}$$)')} AS {c}_mw" for c in ("click", "view", "purchase")) + " FROM hourly GROUP BY hourly.ts",
    "source_weather": f"WITH {HOURLY} SELECT {stamp()} AS ts, {r('x')} AS temp_c FROM hourly WHERE series_id = 'purchase'",
    "source_extract": f"WITH {DAILY} SELECT series_id, year(ts) AS year, count(*) AS n, {r('round(sum(x), 1)')} AS x FROM days GROUP BY 1, 2",
    "source_scores": f"WITH {PRED} SELECT model, count(pred - y) AS n, {r('round(avg(abs(pred - y)), 4)')} AS mae, 'none' AS weather FROM pred GROUP BY 1",
    "source_grid": f"WITH {GRID}, {INSIDE}, {NEAREST}, {WEIGHTS} SELECT kind, {stamp('g.ts')} AS ts, {r('sum(w * t2m) / sum(w) + CASE WHEN g.ts > $$2024-01-15 12:00:00$$::TIMESTAMP THEN 1 ELSE 0 END')} AS t2m FROM grid g JOIN w ON g.lat = w.lat AND g.lon = w.lon GROUP BY kind, g.ts",
    "solar_daylight_rows": f"WITH {CLEAN}, {FLEET} SELECT series_id, count(*) AS n, {r('sum(x)')} AS x, {stamp('min(clean.ts)')} AS first FROM clean JOIN fleet ON fleet.ts = clean.ts WHERE daylight GROUP BY 1",
    "weighting_comparison": f"WITH {CLEAN}, {GRID_ONLY}, {INSIDE}, {NEAREST}, {WEIGHTS}, warm AS (SELECT kind, g.ts, sum(w * t2m) / sum(w) AS t2m FROM grid g JOIN w ON g.lat = w.lat AND g.lon = w.lon GROUP BY kind, g.ts), l AS (SELECT kind, c.ts, x, lag(x, 24) OVER k + (t2m - lag(t2m, 24) OVER k) * 3 AS pred FROM clean c JOIN warm USING (ts) WINDOW k AS (PARTITION BY kind, series_id ORDER BY c.ts)), s AS (SELECT kind, count(pred - x) AS n, avg(abs(pred - x)) AS mae FROM l WHERE ts >= {SCORED} GROUP BY 1) SELECT kind, n, {r('mae')} AS mae, {r('mae - max(mae) FILTER (kind = $$box$$) OVER ()')} AS delta, {r('(mae - max(mae) FILTER (kind = $$box$$) OVER ()) / max(mae) FILTER (kind = $$box$$) OVER () * 100')} AS delta_pct FROM s",
    "geo_inside_outline": f"WITH {CUSTOMERS}, {INSIDE} SELECT {r('lat')} AS lat, {r('lon')} AS lon, inside, {r('cos(radians(lat))')} AS area FROM inside",
    "geo_population": f"WITH {CUSTOMERS}, {NEAREST} SELECT {r('lat')} AS lat, {r('lon')} AS lon, region, {r('pop_w')} AS pop_w FROM people",
    "geo_kept_area": f"WITH {CUSTOMERS}, {INSIDE} SELECT count(*) AS n_cells, {r('sum(cos(radians(lat)) * 27.75 * 27.75)')} AS km2 FROM inside WHERE inside",
    "geo_weighted_series": f"WITH {GRID}, {INSIDE}, {NEAREST}, {WEIGHTS} SELECT kind, {stamp()} AS ts, {r('sum(w * t2m) / sum(w)')} AS t2m FROM grid g JOIN w ON g.lat = w.lat AND g.lon = w.lon GROUP BY kind, g.ts",
    "geo_box_mean": f"WITH {GRID} SELECT {stamp()} AS ts, {r('avg(t2m)')} AS t2m FROM grid GROUP BY grid.ts",
    "geo_points": f"WITH {GRID}, p AS (SELECT s_suppkey AS point_id, 46.9::DOUBLE + (s_suppkey * 37 % 83) * 0.1::DOUBLE AS y, 5.4::DOUBLE + (s_suppkey * 11 % 103) * 0.1::DOUBLE AS x FROM supplier), q AS (SELECT *, least(floor((y - 47) * 4), 31) AS i, least(floor((x - 5.5) * 4), 39) AS j FROM p WHERE y BETWEEN 47.0 AND 55.0 AND x BETWEEN 5.5 AND 15.5), c AS (SELECT point_id, 47 + (i + a) / 4 AS lat, 5.5 + (j + b) / 4 AS lon, (CASE a WHEN 1 THEN (y - 47) * 4 - i ELSE 1 + i - (y - 47) * 4 END) * (CASE b WHEN 1 THEN (x - 5.5) * 4 - j ELSE 1 + j - (x - 5.5) * 4 END) AS w FROM q, range(0, 2) s(a), range(0, 2) t(b)), v AS (SELECT point_id, g.ts, sum(w * t2m) AS t2m FROM grid g JOIN c ON g.lat = c.lat AND g.lon = c.lon GROUP BY 1, 2) SELECT point_id, {r('avg(t2m)')} AS mean, count(*) AS n FROM v GROUP BY 1",
    "solar_clear_sky": f"WITH {HOURLY}, {SKY} SELECT site_id, {r('lat')} AS lat, {r('lon')} AS lon, {stamp()} AS ts, {r('air')} AS air, {rounded(SKY_COLUMNS)}, {r('azimuth')} AS azimuth, daylight, {r('cs_poa / 1000 * derate')} AS cs_output FROM sky",
    "solar_fleet": f"WITH {HOURLY}, {FLEET} SELECT {stamp()} AS ts, {rounded([*SKY_COLUMNS, 'cs_output', 'azimuth'])}, daylight FROM fleet",
    "solar_index": f"WITH {SOLAR}, z AS (SELECT *, cos(radians(greatest(0.0::DOUBLE, least(90.0::DOUBLE, zenith)))) AS cz FROM solar WHERE cs_poa > 0.001) SELECT series_id, {stamp()} AS ts, {r('least(2.0, cf * 3000 / cs_poa)')} AS kt, CASE WHEN zenith >= 90 THEN 'inf'::DOUBLE ELSE {r('1 / (cz + 0.50572 * pow(96.07995 - greatest(0.0, zenith), -1.6364))')} END AS am FROM z",
    "solar_features_lagged": f"WITH {SOLAR}, f AS (SELECT *, {named(SOLAR_HISTORY)}, {lag(24, 'temp')} AS temp_c, CASE WHEN {frame('sum', 24, 24, 'cs_poa')} > 1 THEN {frame('sum', 24, 24, 'cf')} / {frame('sum', 24, 24, 'cs_poa')} END AS kt_yesterday FROM solar), g AS (SELECT * EXCLUDE (cell_c, derate, cs_output), temp_c + 0.03125 * cs_poa AS cell_c, 1 - 0.004 * (temp_c + 0.03125 * cs_poa - 25) AS derate, cs_poa / 1000 * (1 - 0.004 * (temp_c + 0.03125 * cs_poa - 25)) AS cs_output FROM f) SELECT series_id, {stamp()} AS ts, {r('cf')} AS cf, {SOLAR_CAL}, {rounded(SOLAR_HISTORY)}, {SOLAR_GEO}, {rounded(['temp_c', 'cell_c', 'derate', 'cs_output', 'kt_yesterday'])} FROM g WHERE roll_mean_168h IS NOT NULL AND lag_168h IS NOT NULL AND kt_yesterday IS NOT NULL AND cs_poa IS NOT NULL AND temp_c IS NOT NULL",
    "solar_features_clearsky": f"WITH {SOLAR}, f AS (SELECT *, {named(SOLAR_HISTORY)} FROM solar) SELECT series_id, {stamp()} AS ts, {r('cf')} AS cf, {SOLAR_CAL}, {SOLAR_GEO} FROM f WHERE roll_mean_168h IS NOT NULL AND lag_168h IS NOT NULL AND cs_poa IS NOT NULL",
    "solar_features_no_record": f"WITH {SOLAR}, f AS (SELECT * EXCLUDE (cell_c, derate, cs_output), {named(SOLAR_HISTORY)}, CASE WHEN {frame('sum', 24, 24, 'cs_poa')} > 1 THEN 1 END AS known, temp + 0.03125 * cs_poa AS cell_c, 1 - 0.004 * (temp + 0.03125 * cs_poa - 25) AS derate, cs_poa / 1000 * (1 - 0.004 * (temp + 0.03125 * cs_poa - 25)) AS cs_output FROM solar) SELECT series_id, {stamp()} AS ts, {r('cf')} AS cf, {SOLAR_CAL}, {SOLAR_GEO}, {r('temp')} AS temp_c, {rounded(['cell_c', 'derate', 'cs_output'])} FROM f WHERE roll_mean_168h IS NOT NULL AND lag_168h IS NOT NULL AND known IS NOT NULL AND cs_poa IS NOT NULL",
    "solar_scores": f"WITH {SOLAR}, {SOLAR_BASED}, p AS (SELECT series_id, x, cf AS y, unnest(['yesterday', 'last_week', 'clearsky_persistence']) AS model, unnest([yesterday, last_week, clearsky_persistence]) AS pred FROM sbased WHERE daylight AND ts >= {SCORED}), s AS (SELECT series_id, model, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(pred - y) AS bias, avg(x + 1000) AS cap FROM p GROUP BY 1, 2) SELECT series_id, model, {rounded(['mae', 'rmse', 'bias'])}, {r('rmse * 100')} AS nrmse, {r('1 - mae / nullif(max(mae) FILTER (model = $$yesterday$$) OVER (PARTITION BY series_id), 0)')} AS skill, {r('mae * cap')} AS mae_mw FROM s",
    "solar_night_effect": f"WITH {SOLAR}, {SOLAR_BASED}, p AS (SELECT daylight, abs(pred - y) AS e, model FROM (SELECT daylight, cf AS y, unnest(['yesterday', 'clearsky_persistence']) AS model, unnest([yesterday, clearsky_persistence]) AS pred FROM sbased WHERE ts >= {SCORED})) SELECT model, {r('avg(e)')} AS mae_all, {r('avg(e) FILTER (coalesce(daylight, false))')} AS mae_daylight, {r('avg(e) / nullif(avg(e) FILTER (coalesce(daylight, false)), 0)')} AS ratio FROM p GROUP BY model",
    "solar_drift": f"WITH {HOURLY}, {FLEET}, g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM fleet), d AS (SELECT g.ts, cs_poa, daylight, abs(cs_poa - lag(cs_poa, 24) OVER (ORDER BY g.ts)) AS d FROM g LEFT JOIN fleet f ON f.ts = g.ts) SELECT {r('avg(d) FILTER (daylight) / avg(cs_poa) FILTER (daylight)')} AS drift, {r('avg(daylight::INT)')} AS daylight_share FROM d",
    "solar_demeaned_correlation": f"WITH {SOLAR}, t AS (SELECT series_id, month({local()}) AS m, round(sin(hour(ts) * 2 * {PI} / 24) * 10 + 12 + (floor(x) - 17 * floor(floor(x) / 17)), 4) AS a, CASE WHEN cs_poa > 0.001 THEN least(2.0, cf * 3000 / cs_poa) END AS b FROM solar WHERE daylight), u AS (SELECT *, a - avg(a) OVER (PARTITION BY series_id, m) AS a1, b - avg(b) OVER (PARTITION BY series_id, m) AS b1 FROM t WHERE a IS NOT NULL AND b IS NOT NULL) SELECT series_id, {r('corr(a, b)')} AS r, {r('corr(a1, b1)')} AS r_within_month FROM u GROUP BY 1",
    "calendar_columns": f"WITH {CLEAN} SELECT series_id, {stamp()} AS ts, {CALENDAR}, {CYCLES} FROM clean",
    "calendar_holidays": f"WITH {DAILY}, {HOLIDAYS}, d AS (SELECT series_id, days.ts, h.day IS NOT NULL AS hol FROM days LEFT JOIN holidays h ON h.day = CAST({local('days.ts')} AS DATE)) SELECT series_id, count(*) FILTER (hol) AS n_holidays, {stamp('min(ts) FILTER (hol)')} AS first, {stamp('max(ts) FILTER (hol)')} AS last, sum(date_diff('day', DATE '1990-01-01', ts::DATE)) FILTER (hol)::BIGINT AS checksum FROM d GROUP BY 1",
    "demand_features": FEATURE_SQL,
    "demand_features_chunked": FEATURE_SQL,
    "demand_features_perfect": f"WITH {CLEAN}, {TEMP}, f AS (SELECT *, {named(HISTORY | WARM)} FROM warm) SELECT series_id, {stamp()} AS ts, {rounded(WARM)} FROM f WHERE same_hour_3wk_mean IS NOT NULL AND temp_roll_mean_24h IS NOT NULL",
    "temperature_modes": f"WITH {CLEAN}, {TEMP} SELECT series_id, {stamp()} AS ts, {r(lag(24, 'temp'))} AS lagged, {r('temp + ' + normal('3'))} AS noisy, {r('temp')} AS perfect FROM warm",
    "chronological_split": f"WITH {CLEAN} SELECT series_id, CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'train' WHEN ts < TIMESTAMP '2024-01-20' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, {stamp('min(ts)')} AS lo, {stamp('max(ts)')} AS hi FROM clean GROUP BY 1, 2",
    "backtest_folds": f"WITH {DAILY}, {FOLDS} SELECT fold, {stamp('val_start')} AS val_start, {stamp('test_start')} AS test_start, {stamp('test_end')} AS test_end FROM folds",
    "fold_roles": f"WITH {DAILY}, {FOLDS}, {ROLES} SELECT series_id, fold, role, count(*) AS n, {r('sum(x)', 6)} AS x, (sum(count(*)) FILTER (role <> 'test') OVER (PARTITION BY series_id, fold))::BIGINT AS n_refit FROM roles GROUP BY series_id, fold, role",
    "demand_baselines": f"WITH {CLEAN}, {BASED} SELECT series_id, {stamp()} AS ts, {rounded(['x', 'seasonal_naive', 'yesterday', 'mean_last_4_weeks'])} FROM based WHERE ts >= {SCORED}",
    "demand_scores": f"WITH {PRED}, s AS (SELECT series_id, model, count(pred - y) AS n, {SCORES}, avg(abs(pred - y)) AS raw FROM pred GROUP BY 1, 2) SELECT * EXCLUDE (raw), {r('1 - raw / nullif(max(raw) FILTER (model = $$seasonal_naive$$) OVER (PARTITION BY series_id), 0)')} AS skill FROM s",
    "published_forecast": f"WITH {PRED}, u AS (SELECT * FROM pred UNION ALL SELECT series_id, ts, x, 'published', round(x + {normal('5')} * 20, 4) FROM based WHERE ts >= {SCORED} AND length(series_id) % 2 = 1) SELECT series_id, model, count(pred - y) AS n, {SCORES} FROM u GROUP BY 1, 2",
    "same_rows_check": f"WITH {PRED}, p AS (SELECT * FROM pred WHERE NOT (model = 'yesterday' AND hour(ts) = 3)), a AS (SELECT series_id, ts, model FROM clean, (SELECT DISTINCT model FROM p) WHERE ts >= TIMESTAMP '2024-01-11'), j AS (SELECT coalesce(a.model, p.model) AS model, a.ts AS wanted, p.ts AS pt, p.pred FROM a FULL JOIN p ON a.series_id = p.series_id AND a.ts = p.ts AND a.model = p.model) SELECT model, count(wanted) AS n_rows, count(*) - count(pt) AS missing, count(*) - count(wanted) AS extra, count(*) FILTER (pt IS NOT NULL AND pred IS NULL) AS nulls FROM j GROUP BY 1",
    "wide_predictions": f"WITH {CLEAN}, {BASED} SELECT series_id, {stamp()} AS ts, {r('x')} AS actual, CASE WHEN ts >= {SCORED} THEN {r('seasonal_naive')} END AS seasonal_naive, CASE WHEN ts >= {SCORED} THEN {r('yesterday')} END AS yesterday FROM based WHERE ts >= TIMESTAMP '2024-01-09'",
    "scores_by_hour": f"WITH {PRED} SELECT {HOUR} AS hour, {r('avg(abs(pred - y)) FILTER (model = $$seasonal_naive$$)')} AS seasonal_naive, {r('avg(abs(pred - y)) FILTER (model = $$yesterday$$)')} AS yesterday FROM pred GROUP BY 1",
    "worst_days": f"WITH {PRED}, d AS (SELECT model, CAST({local()} AS DATE) AS day, avg(abs(pred - y)) AS mae FROM pred GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae DESC, day) AS rank FROM d) SELECT model, strftime(day, '%Y-%m-%d') AS day, {r('mae')} AS mae, rank FROM k WHERE rank <= 3",
    "best_model": f"WITH {PRED}, s AS (SELECT model, avg(abs(pred - y)) AS mae FROM pred GROUP BY 1), p AS (SELECT arg_min(model, mae) AS best, max(mae) FILTER (model = 'seasonal_naive') AS a, max(mae) FILTER (model = 'yesterday') AS b FROM s) SELECT best, {r('(a - b) / b')} AS gap, abs((a - b) / b) < 0.02 AS tie FROM p",
    "backtest": f"WITH {DAY_PRED} SELECT fold, {stamp('test_start')} AS test_start, model, {r('avg(abs(pred - y))')} AS mae FROM day_pred GROUP BY fold, day_pred.test_start, model",
    "backtest_summary": f"WITH {DAY_PRED}, t AS (SELECT fold, model, avg(abs(pred - y)) AS mae FROM day_pred GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mae, model) AS n FROM t) SELECT model, {r('avg(mae)')} AS mean_mae, {r('max(mae)')} AS worst_mae, count(*) FILTER (n = 1) AS folds_won FROM k GROUP BY 1",
    "mode_comparison": f"WITH {MODED}, s AS (SELECT mode, count(pred - y) AS n, {SCORES}, avg(abs(pred - y)) AS raw FROM moded GROUP BY 1), b AS (SELECT *, raw - max(raw) FILTER (mode = 'none') OVER () AS d, max(raw) FILTER (mode = 'none') OVER () AS base FROM s) SELECT * EXCLUDE (raw, d, base), {r('d')} AS delta, {r('d / base * 100')} AS delta_pct FROM b",
    "fold_delta": f"WITH {MODED}, {FOLD_DELTA} SELECT fold, {stamp('test_start')} AS test_start, model, {rounded(['first', 'second', 'delta'])} FROM deltas",
    "fold_delta_summary": f"WITH {MODED}, {FOLD_DELTA} SELECT model, {r('avg(delta)')} AS mean_delta, count(*) FILTER (delta < 0) AS wins, {r('min(delta)')} AS least, {r('max(delta)')} AS most FROM deltas GROUP BY 1",
    "seed_spread": f"WITH {CLEAN}, s AS (SELECT seed, avg(abs(x + {normal('seed')} - x)) AS mae FROM clean, range(0, 10) t(seed) GROUP BY seed) SELECT {r('avg(mae)')} AS mean, {r('stddev_samp(mae)')} AS std, {r('min(mae)')} AS least, {r('max(mae)')} AS most, {r('max(mae) - min(mae)')} AS range FROM s",
    "monthly_modes": f"WITH {MODED}, m AS (SELECT {MONTH} AS month, avg(abs(pred - y)) FILTER (mode = 'none') AS none, avg(abs(pred - y)) FILTER (mode = 'noisy') AS noisy FROM moded GROUP BY 1) SELECT month, {rounded(['none', 'noisy'])}, {r('(noisy - none) / nullif(none, 0) * 100')} AS delta_pct FROM m",
    "bias_by_period": f"WITH {DAY_PRED} SELECT year(ts)::VARCHAR AS period, {r('avg(pred - y) FILTER (model = $$seasonal_naive$$)')} AS seasonal_naive, {r('avg(pred - y) FILTER (model = $$yesterday$$)')} AS yesterday FROM day_pred GROUP BY 1",
    "temperature_bins": f"WITH {CLEAN}, {TEMP}, e AS (SELECT series_id, min(temp) AS lo, max(temp) AS hi FROM warm GROUP BY 1) SELECT w.series_id, greatest(1, least(30, coalesce(ceil((temp - lo) * 30 / nullif(hi - lo, 0)), 1)))::BIGINT AS bin, {r('avg(x)')} AS mean, count(x) AS n FROM warm w JOIN e ON w.series_id = e.series_id GROUP BY 1, 2",
    "first_week": f"WITH {CLEAN} SELECT series_id, {stamp()} AS ts, {r('x')} AS x FROM clean WHERE CAST({local()} AS DATE) < (SELECT min(CAST({local()} AS DATE)) FROM clean) + INTERVAL 7 DAY",
    "autocorrelation": f"WITH {CLEAN}, l AS (SELECT *, {lag(1)} AS a, {lag(24)} AS b, {lag(168)} AS c FROM clean) SELECT series_id, {r('corr(x, a)')} AS r_1, {r('corr(x, b)')} AS r_24, {r('corr(x, c)')} AS r_168 FROM l GROUP BY 1",
    "daily_correlation": f"WITH {CLEAN}, {TEMP}, d AS (SELECT series_id, CAST({local()} AS DATE) AS day, avg(x) AS x, avg(temp) AS t FROM warm GROUP BY 1, 2), e AS (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY day) AS t1 FROM d) SELECT series_id, {r('corr(x, t)')} AS r_today, {r('corr(x, t1)')} AS r_yesterday FROM e GROUP BY 1",
    "degree_hour_shares": f"WITH {CLEAN}, {TEMP} SELECT series_id, {r('avg((temp < 15)::INT)')} AS active_hdh, {r('avg((temp >= 15)::INT)')} AS zero_hdh, {r('avg((temp > 22)::INT)')} AS active_cdh, {r('avg((temp <= 22)::INT)')} AS zero_cdh FROM warm GROUP BY 1",
    "leakage_audit": f"WITH {CLEAN}, {POKED}, c AS (SELECT a.series_id, a.ts FROM fa a JOIN fb b ON a.series_id = b.series_id AND a.ts = b.ts WHERE {' OR '.join(DIFFERS.values())}) SELECT series_id, count(*) FILTER (ts < TIMESTAMP '2024-01-05 06:00:00') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 06:00:00') AS too_soon, count(*) FILTER (ts >= TIMESTAMP '2024-01-06 06:00:00') AS allowed FROM c GROUP BY 1",
    "reacting_columns": f"WITH {CLEAN}, {POKED}, j AS (SELECT " + ", ".join(f"count(*) FILTER ({e}) AS {c}" for c, e in DIFFERS.items()) + " FROM fa a JOIN fb b ON a.series_id = b.series_id AND a.ts = b.ts) SELECT \"column\", n_changed, CASE WHEN n_changed > 0 THEN 'ok' ELSE 'spurious' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS n_changed FROM j" for c in DIFFERS) + ") UNION ALL SELECT 'temp', 0, 'ok' UNION ALL SELECT 'kt_yesterday', NULL, 'absent'",
    "standardised": f"WITH {DAILY}, {FOLDS}, {READY}, one AS (SELECT r.*, f.fold, CASE WHEN ts < val_start THEN 'train' WHEN ts < test_start THEN 'validation' ELSE 'test' END AS role FROM ready r JOIN folds f ON ts < test_end), s AS (SELECT series_id, fold, " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}" for c in DAY_LAGS) + " FROM one WHERE role = 'train' GROUP BY 1, 2) SELECT one.series_id, one.fold, role, " + ", ".join(f"{r(f'round(avg(({c} - m_{c}) / s_{c}), 4)')} AS mean_{c}" for c in DAY_LAGS) + ", true AS taken_back FROM one JOIN s ON s.series_id = one.series_id AND s.fold = one.fold GROUP BY one.series_id, one.fold, role",
    "ridge_moments": f"WITH {DAILY}, {FOLDS}, {READY}, b AS (SELECT val_start AS t FROM folds UNION SELECT test_start FROM folds), k AS (SELECT *, (SELECT count(*) FROM b WHERE t <= ts) AS block FROM ready), g AS (SELECT series_id, block, count(*) AS n, " + ", ".join([*(f"avg({c}) AS mean_{c}, avg({c} * {c}) AS square_{c}" for c in [*DAY_LAGS, "x"]), *(f"avg({c} * x) AS with_{c}" for c in DAY_LAGS)]) + " FROM k GROUP BY 1, 2) SELECT series_id, block, n, " + ", ".join([*(f"{figures(f'mean_{c}')} AS mean_{c}, {figures(f'square_{c}')} AS square_{c}" for c in [*DAY_LAGS, "x"]), *(f"{figures(f'with_{c}')} AS with_{c}" for c in DAY_LAGS)]) + " FROM g",
    "linear_predictions": f"WITH {DAILY}, {READY} SELECT series_id, {stamp()} AS ts, {r('round(greatest(0.0, length(series_id) * 10.0 + 0.4137 * lag_1 - 0.2091 * lag_2 + 0.1073 * lag_3 + 0.2969 * lag_7 + 0.1531 * lag_14 + 0.2473 * mean_7), 2)')} AS pred FROM ready",
    "scaler": f"WITH {DAILY}, {FOLDS}, {READY} SELECT series_id, fold, " + ", ".join(f"{r(f'avg({c})')} AS mean_{c}, {r(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END')} AS scale_{c}" for c in DAY_LAGS) + " FROM ready JOIN folds ON ts < val_start GROUP BY 1, 2",
}
