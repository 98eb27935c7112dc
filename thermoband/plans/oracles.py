"""Each comparable query written a second time, as SQL over the base tables."""

from __future__ import annotations

from thermoband.plans.fixed import JOINT_LIMITS, STATED

# Domain tables of the test data.
_CTES = """
tb_raw AS (SELECT event_id, ts, user_id,
    CASE WHEN user_id % 2 = 0 THEN concat('G', user_id) ELSE concat('NG', user_id) END AS original_id,
    CASE WHEN user_id % 2 = 0 THEN 'G' ELSE 'N' END AS type,
    CASE WHEN event_type = 'view' THEN 'lab' ELSE 'field' END AS location,
    date_trunc('hour', ts + INTERVAL 30 MINUTE) AS datetime, value AS temp FROM events),
dimid AS (SELECT original_id, CAST(row_number() OVER (ORDER BY original_id) AS INT) AS id
    FROM (SELECT DISTINCT original_id FROM tb_raw)),
tb AS (SELECT d.id, r.type, r.datetime, CAST(dayofyear(r.datetime) AS INT) AS day,
    CAST(hour(r.datetime) AS INT) AS hour, r.temp, r.ts, r.event_id
    FROM tb_raw r JOIN dimid d ON r.original_id = d.original_id
    WHERE dayofyear(r.datetime) BETWEEN 5 AND 25 AND r.original_id <> 'NG7'),
te AS (SELECT user_id AS id,
    CASE WHEN user_id % 10 = 9 THEN 'Entrance' ELSE concat('S', user_id % 10) END AS site,
    CASE WHEN user_id % 2 = 0 THEN 'Rookery' ELSE 'Prairie' END AS location,
    CASE WHEN user_id % 4 < 2 THEN 'Exposed' ELSE 'Shaded' END AS treatment,
    ts AS datetime, value AS temp, CAST(dayofyear(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, event_id
    FROM events WHERE user_id % 10 <> 9),
te_all AS (SELECT user_id AS id,
    CASE WHEN user_id % 10 = 9 THEN 'Entrance' ELSE concat('S', user_id % 10) END AS site,
    CASE WHEN user_id % 2 = 0 THEN 'Rookery' ELSE 'Prairie' END AS location,
    CASE WHEN user_id % 4 < 2 THEN 'Exposed' ELSE 'Shaded' END AS treatment, value AS temp FROM events),
gradient_raw AS (SELECT
    CASE WHEN user_id % 2 = 0 THEN concat('G', user_id) ELSE concat('NG', user_id) END AS snakeid,
    CASE WHEN user_id % 2 = 0 THEN 'Pregnant' ELSE 'Non-Pregnant' END AS repro,
    CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS run,
    ts AS datetime, value AS tb FROM events WHERE event_type = 'view'),
gradient AS (SELECT snakeid, repro, median(tb) AS tb_med, quantile_cont(tb, 0.25) AS tb_q1,
    quantile_cont(tb, 0.75) AS tb_q3, count(*) AS n_obs FROM gradient_raw GROUP BY snakeid, repro),
tpref AS (SELECT CASE repro WHEN 'Pregnant' THEN 'G' WHEN 'Non-Pregnant' THEN 'N' END AS type,
    CASE repro WHEN 'Pregnant' THEN 'Rookery' WHEN 'Non-Pregnant' THEN 'Prairie' END AS location,
    avg(tb_med) AS tb_med, avg(tb_q1) AS tb_q1, avg(tb_q3) AS tb_q3 FROM gradient GROUP BY repro),
db AS (SELECT b.*, CASE WHEN temp IS NULL OR tb_q1 IS NULL OR tb_q3 IS NULL THEN NULL
    WHEN sign(temp - tb_q1) * sign(temp - tb_q3) = -1 THEN 0.0
    WHEN sign(temp - tb_q1) = -1 THEN temp - tb_q1 ELSE temp - tb_q3 END AS db
    FROM tb b LEFT JOIN tpref p ON b.type = p.type),
de AS (SELECT e.*, CASE WHEN temp IS NULL OR tb_q1 IS NULL OR tb_q3 IS NULL THEN NULL
    WHEN sign(temp - tb_q1) * sign(temp - tb_q3) = -1 THEN 0.0
    WHEN sign(temp - tb_q1) = -1 THEN temp - tb_q1 ELSE temp - tb_q3 END AS de
    FROM te e LEFT JOIN tpref p ON e.location = p.location),
bounds AS (SELECT min(CAST(datetime AS DATE)) AS d1, max(CAST(datetime AS DATE)) AS d2 FROM tb),
te_range AS (SELECT te.* FROM te, bounds WHERE CAST(datetime AS DATE) BETWEEN d1 AND d2),
de_range AS (SELECT de.* FROM de, bounds WHERE CAST(datetime AS DATE) BETWEEN d1 AND d2)
"""

_LABEL = "CASE type WHEN 'G' THEN 'Pregnant' WHEN 'N' THEN 'Non-pregnant' END"
_PART3 = (
    "CASE WHEN hour < 0 OR hour >= 24 OR hour IS NULL THEN NULL WHEN hour < 5 OR hour >= 21 THEN 'Night' "
    "WHEN hour >= 9 AND hour < 17 THEN 'Day' ELSE 'transition' END"
)
_ECO = "CAST(datetime - INTERVAL 9 HOUR AS DATE)"


def _sql(body: str) -> str:
    return f"WITH {_CTES.strip()}\n{body.strip()}"


def _mean(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN avg({x}) END"


def _parts(table: str, keys: str, value: str) -> str:
    """Day-part means per ecological date, without transitions."""
    return f"""SELECT {keys}, date, daytime, {_mean(value)} AS v
    FROM (SELECT *, {_PART3} AS daytime, {_ECO} AS date FROM {table})
    GROUP BY {keys}, date, daytime HAVING daytime <> 'transition'"""


_TYPED = {k: f"(SELECT * REPLACE ({_LABEL} AS type) FROM {k})" for k in ("tb", "db")}
_VIEWS = {
    "tb": (_TYPED["tb"], "type", "temp", 8),
    "te": ("te_range", "location, treatment", "temp", 8),
    "db": (_TYPED["db"], "type", "db", 8),
    "de": ("de_range", "location, treatment", "de", 5),
}


def _part_series(what: str) -> str:
    table, keys, value, _ = _VIEWS[what]
    return _sql(f"SELECT {keys}, date, daytime, round(v, 8) AS {what} FROM ({_parts(table, keys, value)})")


def _part_summary(what: str) -> str:
    table, keys, value, k = _VIEWS[what]
    return _sql(f"""
SELECT {keys}, daytime, round(m, 8) AS avg, round(e, 8) AS se, n,
    round(m - {k} * e, 8) AS lo, round(m + {k} * e, 8) AS hi
FROM (SELECT {keys}, daytime, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS e, count(*) AS n
    FROM ({_parts(table, keys, value)}) GROUP BY {keys}, daytime)""")


def _contrast(what: str, column: str, levels: tuple[str, str], within: str) -> str:
    table, keys, value, _ = _VIEWS[what]
    first, second = levels
    rows = ", ".join(filter(None, [within, "daytime"]))
    return _sql(f"""
SELECT {rows}, round(a, 8) AS "{first}", round(b, 8) AS "{second}", round(a - b, 8) AS diff
FROM (SELECT {rows}, avg(CASE WHEN {column} = '{first}' THEN v END) AS a,
        avg(CASE WHEN {column} = '{second}' THEN v END) AS b
    FROM ({_parts(table, keys, value)}) GROUP BY {rows})""")


def _hourly(table: str, keys: str, value: str) -> str:
    return f"""SELECT {keys}, CAST(datetime AS DATE) AS date, hour, {_mean(value)} AS v
    FROM {table} GROUP BY {keys}, CAST(datetime AS DATE), hour"""


def _loess(what: str, vertices: bool = False) -> str:
    """Local quadratic fit straight from its definition, on single rows: at the points themselves, or at the vertices of
    a tree of cells, with cubics between them."""
    table, keys, value, (lo, hi) = {
        "tb": ("tb", "type", "temp", (10, 35)),
        "te": ("te", "location, treatment", "temp", (-10, 70)),
        "db": ("db", "type", "db", (-20, 2)),
        "de": ("de", "location, treatment", "de", (-32, 40)),
    }[what]
    points = f"SELECT panel.*, CAST(g.i AS INT) AS i, x_lo + g.i * (x_hi - x_lo) / 199 AS x0 FROM panel, range(200) AS g(i)"
    tree = f"""
ends AS (SELECT p.*, list_sort(xs) AS s, list_filter(range(1, n), lambda r: list_sort(xs)[r] <> list_sort(xs)[r + 1]) AS e FROM panel p),
cells AS (
    SELECT {keys}, CAST(1 AS BIGINT) AS f, n AS l, x_lo - margin AS a, x_hi + margin AS b FROM ends
    UNION ALL
    SELECT {keys}, CASE WHEN half = 0 THEN f ELSE cut + 1 END, CASE WHEN half = 0 THEN cut ELSE l END, CASE WHEN half = 0 THEN a ELSE t END,
        CASE WHEN half = 0 THEN t ELSE b END
    FROM (SELECT *, (s[cut] + s[cut + 1]) / 2 AS t
        FROM (SELECT *, CASE WHEN up IS NULL AND down IS NULL THEN m WHEN down IS NULL OR up - m <= m - down THEN up ELSE down END AS cut
            FROM (SELECT *, CASE WHEN above - m - 1 <= m - f THEN above END AS up, CASE WHEN m - below < l - m THEN below END AS down
                FROM (SELECT *, list_min(list_filter(e, lambda r: r >= m AND r < l)) AS above, list_max(list_filter(e, lambda r: r < m AND r >= f)) AS below
                    FROM (SELECT c.*, s, e, most, (f + l) // 2 AS m FROM cells c JOIN ends USING ({keys}) WHERE l - f + 1 > most))))),
        (SELECT unnest([0, 1]) AS half)
    WHERE t <> a AND t <> b),
corners AS (SELECT {keys}, unnest([a, b]) AS x0 FROM cells),
pts AS (SELECT panel.*, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY x0) AS INT) AS i, x0 FROM panel JOIN (SELECT DISTINCT * FROM corners) USING ({keys})),"""
    at = tree if vertices else f"\npts AS ({points}),"
    quadratic = "abs(det3) > 1e-10 * m0*m2*m4"
    fit = f"""CASE
    WHEN {quadratic} THEN (b0*(m2*m4 - m3*m3) - m1*(b1*m4 - b2*m3) + m2*(b1*m3 - b2*m2)) / det3
    WHEN abs(det2) > 1e-10 * m0*m2 THEN (b0*m2 - b1*m1) / det2
    WHEN m0 > 0 THEN b0 / m0 ELSE edge END"""
    slope = f"""CASE
    WHEN {quadratic} THEN (m0*(b1*m4 - b2*m3) - b0*(m1*m4 - m2*m3) + m2*(m1*b2 - m2*b1)) / det3
    WHEN abs(det2) > 1e-10 * m0*m2 THEN (m0*b1 - m1*b0) / det2 ELSE 0 END"""
    result = f"SELECT {keys}, i, round(x0, 6) AS x0, round({fit}, 6) AS fit FROM solved"
    if vertices:
        result = f""", v AS (SELECT {keys}, x0 AS va, {fit} AS fa, {slope} AS sa FROM solved),
pieces AS (SELECT *, lead(va) OVER w AS vb, lead(fa) OVER w AS fb, lead(sa) OVER w AS sb FROM v WINDOW w AS (PARTITION BY {keys} ORDER BY va)),
laid AS (SELECT g.*, fa, fb, sa, sb, vb - va AS h, (x0 - va) / (vb - va) AS t FROM ({points}) g JOIN pieces USING ({keys}) WHERE x0 >= va AND x0 < vb)
SELECT {keys}, i, round(x0, 6) AS x0, round((2*t*t*t - 3*t*t + 1) * fa + (3*t*t - 2*t*t*t) * fb + (t*t*t - 2*t*t + t) * h * sa + (t*t*t - t*t) * h * sb, 6) AS fit
FROM laid"""
    return _sql(f"""
, rows_in AS (SELECT {keys}, CAST(hour AS DOUBLE) AS x, v AS y
    FROM ({_hourly(table, keys, value)}) WHERE v BETWEEN {lo} AND {hi}),
panel AS (SELECT {keys}, min(x) AS x_lo, max(x) AS x_hi, count(*) AS n, list(x) AS xs,
    CAST(floor(count(*) * 0.3 + 1e-5) AS BIGINT) AS q, greatest(CAST(floor(count(*) * CAST(0.06 AS DOUBLE)) AS BIGINT), 1) AS most,
    0.005 * greatest(max(x) - min(x), 1e-3 * greatest(abs(min(x)), abs(max(x))) + 1e-30) AS margin FROM rows_in GROUP BY {keys}),{at}
near AS (SELECT {keys}, i, x0, q, y, x - x0 AS u,
    row_number() OVER (PARTITION BY {keys}, i ORDER BY abs(x - x0)) AS nth
    FROM pts JOIN rows_in USING ({keys})),
reach AS (SELECT {keys}, i, max(CASE WHEN nth = q THEN abs(u) END) AS h FROM near GROUP BY {keys}, i),
wt AS (SELECT {keys}, i, x0, u, y, CASE WHEN abs(u) <= h THEN y END AS y_near,
    CASE WHEN h = 0 THEN CASE WHEN u = 0 THEN 1 ELSE 0 END
        WHEN abs(u) < h THEN pow(1 - pow(abs(u) / h, 3), 3) ELSE 0 END AS w
    FROM near JOIN reach USING ({keys}, i)),
mom AS (SELECT {keys}, i, x0, sum(w) AS m0, sum(w*u) AS m1, sum(w*u*u) AS m2, sum(w*u*u*u) AS m3,
    sum(w*u*u*u*u) AS m4, sum(w*y) AS b0, sum(w*u*y) AS b1, sum(w*u*u*y) AS b2,
    avg(y_near) AS edge
    FROM wt GROUP BY {keys}, i, x0),
solved AS (SELECT *, m0*(m2*m4 - m3*m3) - m1*(m1*m4 - m2*m3) + m2*(m1*m3 - m2*m2) AS det3,
    m0*m2 - m1*m1 AS det2 FROM mom)
{result}""").replace(")\n, rows_in", "),\nrows_in").replace(")\n, v AS", "),\nv AS").replace("WITH ", "WITH RECURSIVE ", 1)


def _basis(column: str, harmonics: int, period: int) -> str:
    cols = ", ".join(
        f"round({f}(2 * pi() * {k} * {column} / {period}) / sqrt({period} / 2.0), 6) AS {f}{k}"
        for k in range(1, harmonics + 1) for f in ("sin", "cos")
    )
    return _sql(f"SELECT DISTINCT {column} AS x, {cols} FROM tb")


def _axis(table: str, column: str, n: int) -> str:
    return f"""(SELECT CASE WHEN i = {n - 1} THEN hi ELSE lo + i * ((hi - lo) / {n - 1}.0) END AS {column}
    FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {table}),
        range({n}) AS g(i))"""


_HOURS_TB, _HOURS_TE = _axis("tb", "hour", 100), _axis("te", "hour", 100)
_DAYS_TB = "(SELECT DISTINCT CAST(day AS DOUBLE) AS day FROM tb)"


def _sincos(k: int, column: str, period: int, f: str) -> str:
    return f"{f}(2 * pi() * {k} * {column} / {period}) / sqrt({period} / 2.0)"


def _design() -> str:
    h = {f"{f}{k}": _sincos(k, "hour", 23, f) for k in (1, 2) for f in ("sin", "cos")}
    d = {f"{f}1": _sincos(1, "day", 365, f) for f in ("sin", "cos")}
    loc = "(CASE location WHEN 'Prairie' THEN 1.0 WHEN 'Rookery' THEN -1.0 END)"
    trt = "(CASE treatment WHEN 'Exposed' THEN 1.0 WHEN 'Shaded' THEN -1.0 END)"
    all_h, all_d = " + ".join(["1", *h.values()]), " + ".join(["1", *d.values()])
    return _sql(f"""
SELECT event_id AS obs_id, id, datetime, round({loc}, 6) AS x_location,
    round({loc} * {trt}, 6) AS x_location_treatment, round({h['sin1']}, 6) AS x_hour,
    round({trt} * ({h['cos2']}), 6) AS x_treatment_hour,
    round(({h['sin2']}) * ({d['cos1']}), 6) AS x_hour_day,
    round({loc} * {trt} * ({h['cos1']}) * ({d['sin1']}), 6) AS x_all,
    round((1 + {loc}) * (1 + {trt}) * ({all_h}) * ({all_d}), 6) AS x_sum
FROM te""")


def _ar1() -> str:
    hour = ["1.0", *[_sincos(k, "hour", 23, f) for k in (1, 2, 3) for f in ("sin", "cos")]]
    day = ["1.0", *[_sincos(1, "day", 365, f) for f in ("sin", "cos")]]
    a = dict(enumerate([*[f"{h} * {d}" for h in hour for d in day], "temp"], start=1))
    cols = ", ".join(f"{x} AS a{i}" for i, x in a.items())
    lags = ", ".join(f"lag(a{i}) OVER w AS p{i}" for i in a)
    pairs = [(i, j) for i in a for j in a if i <= j]
    union = " UNION ALL ".join(
        f"""SELECT id, {i} AS i, {j} AS j, round(sum(a{i} * a{j}), 6) AS s0,
    round(coalesce(sum(a{i} * p{j} + p{i} * a{j}), 0), 6) AS s1,
    round(coalesce(sum(CASE WHEN p1 IS NOT NULL AND nxt IS NOT NULL THEN a{i} * a{j} END), 0), 6) AS s2
    FROM laid GROUP BY id"""
        for i, j in pairs
    )
    return _sql(f"""
, based AS (SELECT id, ts, event_id, {cols} FROM tb),
laid AS (SELECT *, {lags}, lead(a1) OVER w AS nxt FROM based
    WINDOW w AS (PARTITION BY id ORDER BY ts, event_id))
SELECT id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, s0, s1, s2 FROM ({union})""").replace(
        ")\n, based", "),\nbased"
    )


_SHORT = "regexp_replace(printf('%.2f', CASE WHEN round_even({x}, 2) = 0 THEN 0.0 ELSE round_even({x}, 2) END), '\\.?0+$', '')"

_WRITTEN = """CASE event_id % 7 WHEN 0 THEN strftime(ts, '%-m/%-d/%Y') WHEN 1 THEN strftime(ts, '%m-%d-%Y')
        WHEN 2 THEN strftime(ts, '%-m.%d.%y') WHEN 3 THEN strftime(ts, '%m %-d %Y') WHEN 4 THEN strftime(ts, '%B %-d, %Y')
        WHEN 5 THEN upper(strftime(ts, '%b')) || strftime(ts, '-%-d-%Y') ELSE concat('13/', strftime(ts, '%-d/%Y')) END"""

ORACLES: dict[str, str] = {
    "q_scan_lower_rename": "SELECT event_id, ts, user_id AS series, event_type, value AS temp FROM events",
    "q_unite_parse": f"""SELECT event_id, {_WRITTEN} || ' ' || CASE WHEN event_id % 7 IN (1, 4) THEN strftime(ts, '%-I:%M:%S %p') ELSE strftime(ts, '%-H:%M:%S') END AS text,
    CASE WHEN event_id % 7 < 6 THEN date_trunc('second', ts) END AS datetime FROM events""",
    "q_parse_mdy_hm": """SELECT event_id, CASE WHEN event_id % 7 < 6 THEN date_trunc('minute', ts) END AS datetime,
    event_id % 7 = 6 AS unreadable FROM events""",
    "q_csv_dirs": """SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN ts END AS ts, CASE WHEN event_id % 3 <> 2 THEN value END AS value,
    CASE WHEN event_id % 3 <> 2 THEN event_type END AS event_type,
    CASE WHEN event_id % 3 = 2 THEN CAST(user_id AS VARCHAR) END AS extra,
    CASE WHEN event_id % 3 = 0 THEN 'said "' || event_type || '",' || chr(10) || chr(10) || 'then,' || chr(10) || '"' || event_id || '"' || chr(10) END AS note
FROM events""",
    "q_infer_types": """WITH ev AS (SELECT *, event_id % 3 AS k FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
has AS (SELECT count(*) FILTER (WHERE k = 0) > 0 AS a, count(*) FILTER (WHERE k = 1) > 0 AS b, count(*) FILTER (WHERE k = 2) > 0 AS c FROM ev)
SELECT name, kind, apart FROM (
    SELECT 'event_id' AS name, 'integer' AS kind, FALSE AS apart FROM has
    UNION ALL SELECT 'amount', CASE WHEN a THEN 'double' WHEN b THEN 'integer' ELSE 'logical' END, a AND b FROM has
    UNION ALL SELECT 'day', CASE WHEN a AND b THEN 'text' WHEN a THEN 'date' WHEN b THEN 'time' ELSE 'logical' END, a AND b FROM has
    UNION ALL SELECT 'flag', 'logical', FALSE FROM has
    UNION ALL SELECT 'ts', CASE WHEN a OR c THEN 'time' ELSE 'logical' END, FALSE FROM has
    UNION ALL SELECT 'none', 'logical', FALSE FROM has
    UNION ALL SELECT 'note', CASE WHEN b THEN 'text' WHEN c THEN 'integer' ELSE 'logical' END, b AND c FROM has)""",
    "q_bundle": """SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'rest' END AS name, event_id, event_type, value
FROM events WHERE event_type IS NOT NULL""",
    "q_csv_roundtrip": """SELECT event_id, ts, value, f AS format FROM events,
    (SELECT 'csv' AS f UNION ALL SELECT 'parquet')""",
    "q_union_by_name": """SELECT event_id, event_type, value,
    CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup') THEN props END AS props FROM events""",
    "q_round_hour": "SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS datetime FROM events",
    "q_calendar_parts": """SELECT event_id, CAST(dayofyear(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour,
    CAST(ts AS DATE) AS date FROM events""",
    "q_eco_date": "SELECT event_id, CAST(ts - INTERVAL 9 HOUR AS DATE) AS date_adj FROM events",
    "q_day_to_date": _sql(f"""
SELECT CAST(day AS INT) AS day, CAST(floor(hour) AS INT) AS hour, CAST(floor((hour % 1) * 60) AS INT) AS minute,
    CAST(DATE '2019-12-31' + CAST(day AS INT) AS TIMESTAMP) + to_hours(CAST(floor(hour) AS INT))
        + to_minutes(CAST(floor((hour % 1) * 60) AS INT)) AS datetime
FROM {_DAYS_TB}, {_HOURS_TB}"""),
    "q_dictionary_id": _sql("SELECT original_id, id FROM dimid"),
    "q_tb_clean": _sql("SELECT id, type, datetime, day, hour, temp FROM tb"),
    "q_season_bounds": _sql("""SELECT original_id, max(datetime) AS last_datetime,
    CAST(dayofyear(max(datetime)) AS INT) AS last_day FROM tb_raw WHERE location = 'field' GROUP BY original_id"""),
    "q_te_clean": _sql("SELECT id, site, location, treatment, datetime, temp, day, hour FROM te"),
    "q_env_dimension": _sql("SELECT DISTINCT id, site, location, treatment FROM te_all"),
    "q_completeness": _sql(
        "SELECT id, count(*) AS n, count(*) - count(temp) AS n_missing FROM te_all GROUP BY id"
    ),
    "q_date_range_filter": _sql(
        "SELECT id, site, location, treatment, datetime, temp, day, hour FROM te_range"
    ),
    "q_run_metadata": _sql("""
SELECT snakeid, repro, run, n_obs, start, "end", round(gap_max_s, 6) AS gap_max_s,
    round(gap_min_s, 6) AS gap_min_s, round(us / 1e6, 6) AS duration_s,
    CAST(us // 86400000000 AS INT) AS d, CAST(us // 3600000000 % 24 AS INT) AS h,
    CAST(us // 60000000 % 60 AS INT) AS m, round((us % 60000000) / 1e6, 6) AS s
FROM (SELECT snakeid, repro, run, count(*) AS n_obs, min(datetime) AS start, max(datetime) AS "end",
        max(gap) AS gap_max_s, min(gap) AS gap_min_s,
        date_diff('microsecond', min(datetime), max(datetime)) AS us
    FROM (SELECT *, date_diff('microsecond', lag(datetime) OVER (PARTITION BY snakeid, repro, run
            ORDER BY datetime), datetime) / 1e6 AS gap FROM gradient_raw)
    GROUP BY snakeid, repro, run)"""),
    "q_panel_index": _sql("""
SELECT id, type, CAST(row_number() OVER (PARTITION BY type ORDER BY id) AS INT) AS newid, n_rows
FROM (SELECT id, type, count(*) AS n_rows FROM tb GROUP BY id, type)"""),
    "q_display_order": _sql(f"""SELECT DISTINCT type, {_LABEL} AS label,
    CASE type WHEN 'N' THEN 1 WHEN 'G' THEN 2 END AS ord FROM tb"""),
    "q_gradient": _sql("""SELECT snakeid, repro, round(tb_med, 8) AS tb_med, round(tb_q1, 8) AS tb_q1,
    round(tb_q3, 8) AS tb_q3, n_obs FROM gradient"""),
    "q_reference_band": _sql("""SELECT type, location, round(tb_med, 8) AS tb_med, round(tb_q1, 8) AS tb_q1,
    round(tb_q3, 8) AS tb_q3 FROM tpref"""),
    "q_dev_body": _sql("SELECT id, type, datetime, day, hour, round(db, 8) AS db FROM db"),
    "q_dev_env": _sql(
        "SELECT id, site, location, treatment, datetime, day, hour, round(de, 8) AS de FROM de"
    ),
    "q_daypart3": _sql(f"SELECT DISTINCT hour, {_PART3} AS daytime FROM te"),
    "q_daypart2": _sql("""SELECT DISTINCT hour, CASE WHEN hour < 0 OR hour >= 24 THEN NULL
    WHEN hour >= 9 AND hour < 17 THEN 'day' ELSE 'night' END AS daytime FROM te"""),
    "q_hourly_tb": _sql(f"""
SELECT {_LABEL} AS type, day, date, hour, round(v, 8) AS temp, round(tb_q1, 8) AS tb_q1, round(tb_q3, 8) AS tb_q3
FROM ({_hourly('tb', 'type, day', 'temp')}) LEFT JOIN (SELECT type, tb_q1, tb_q3 FROM tpref) USING (type)"""),
    "q_hourly_te": _sql(f"""
SELECT location, treatment, date, hour, round(v, 8) AS temp, round(tb_q1, 8) AS tb_q1, round(tb_q3, 8) AS tb_q3
FROM ({_hourly('te', 'location, treatment', 'temp')})
LEFT JOIN (SELECT location, tb_q1, tb_q3 FROM tpref) USING (location)"""),
    "q_hourly_db": _sql(
        f"SELECT {_LABEL} AS type, day, date, hour, round(v, 8) AS db FROM ({_hourly('db', 'type, day', 'db')})"
    ),
    "q_hourly_de": _sql(f"""SELECT location, treatment, date, hour, round(v, 8) AS de
FROM ({_hourly('de', 'location, treatment', 'de')})"""),
    **{f"q_part_series_{w}": _part_series(w) for w in _VIEWS},
    **{f"q_part_summary_{w}": _part_summary(w) for w in _VIEWS},
    "q_cell_mean_de": _sql(f"""SELECT location, treatment, round({_mean('de')}, 8) AS de
FROM de_range GROUP BY location, treatment"""),
    "q_contrast_de_daytime": _contrast("de", "location", ("Prairie", "Rookery"), "treatment"),
    "q_contrast_de_location": _contrast("de", "location", ("Prairie", "Rookery"), ""),
    "q_contrast_de_exposure": _contrast("de", "treatment", ("Exposed", "Shaded"), ""),
    "q_contrast_db_group": _contrast("db", "type", ("Pregnant", "Non-pregnant"), ""),
    "q_interval_text": _sql(f"""
SELECT "group", '( ' || {_SHORT.format(x='lo')} || ' ,  ' || {_SHORT.format(x='hi')} || ' )' AS ci
FROM (SELECT "group", avg(temp) - 2 * stddev_samp(temp) / sqrt(count(*)) AS lo,
        avg(temp) + 2 * stddev_samp(temp) / sqrt(count(*)) AS hi
    FROM (SELECT concat_ws('.', type, {_PART3}) AS "group", temp FROM tb) GROUP BY "group")"""),
    "q_grid_level0_tb": _sql(f"""SELECT type, day, hour
FROM (SELECT DISTINCT type FROM tb), {_DAYS_TB}, {_HOURS_TB}"""),
    "q_grid_level0_te": _sql(f"""SELECT location, treatment, day, hour
FROM (SELECT DISTINCT location FROM te), (SELECT DISTINCT treatment FROM te), {_axis('te', 'day', 30)}, {_HOURS_TE}"""),
    "q_grid_level1_tb": _sql(f"""SELECT id, type, day, hour
FROM (SELECT DISTINCT id, type FROM tb), {_DAYS_TB}, {_HOURS_TB}"""),
    "q_grid_level1_te": _sql(f"""SELECT id, location, site, treatment, day, hour
FROM (SELECT DISTINCT id, location, site, treatment FROM te), {_axis('te', 'day', 40)}, {_HOURS_TE}"""),
    "q_fourier_hour": _basis("hour", 3, 23),
    "q_fourier_day": _basis("day", 1, 365),
    "q_design_row": _design(),
    "q_band_censor": _sql(f"""
SELECT type AS panel, count(*) AS n_kept FROM ({_hourly('tb', 'type', 'temp')})
WHERE v BETWEEN 10 AND 35 GROUP BY type
UNION ALL
SELECT location || '.' || treatment AS panel, count(*) AS n_kept
FROM ({_hourly('te', 'location, treatment', 'temp')}) WHERE v BETWEEN -10 AND 70 GROUP BY location, treatment"""),
    **{f"q_loess_{w}": _loess(w) for w in _VIEWS},
    **{f"q_loess_vertices_{w}": _loess(w, vertices=True) for w in _VIEWS},
    "q_ar1_stats": _ar1(),
}

# Generalised least squares at a correlation of 0.8 between neighbours, from single rows. Classes don't share
# coefficients, so each class is a system of three equations.
_GLS = {
    "tb": {
        "series": "id", "order": "ts, event_id", "factors": (("type", ("G", "N")),),
        "grid": f"SELECT type, day, hour FROM (SELECT DISTINCT type FROM tb), {_DAYS_TB}, {_HOURS_TB}",
    },
    "te": {
        "series": "id", "order": "datetime, event_id",
        "factors": (("location", ("Prairie", "Rookery")), ("treatment", ("Exposed", "Shaded"))),
        "grid": f"""SELECT location, treatment, day, hour FROM (SELECT DISTINCT location FROM te),
            (SELECT DISTINCT treatment FROM te), {_axis('te', 'day', 30)}, {_HOURS_TE}""",
    },
}
_X = {1: "1.0", 2: _sincos(1, "hour", 23, "sin"), 3: _sincos(1, "hour", 23, "cos")}


def _gls(what: str, body: str, phi: float = 0.8, sd: tuple[float, ...] = (0.0,) * 4) -> str:
    """`beta`: per class the coefficients b1..b3 and their covariances v11..v33; `scale`: sigma2, rows and series;
    `marg`: per series the products g11..g44 (4 is the response) without its slopes on the two waves, whose deviations
    are `sd`, for the environment by treatment."""
    spec = _GLS[what]
    keys = ", ".join(name for name, _ in spec["factors"])
    by = {i: f"CASE WHEN treatment = 'Exposed' THEN {sd[i]} ELSE {sd[i + 2]} END" if what == "te" else str(sd[i]) for i in (0, 1)}
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    every = [(i, j) for i in (1, 2, 3, 4) for j in (1, 2, 3, 4) if i <= j]
    name = lambda i: "y" if i == 4 else f"x{i}"
    products = ", ".join(f"sum({name(i)} * {name(j)}) AS {m(i, j)}" for i, j in every)
    taken = lambda i, j: " + ".join(f"{m(i, a)} * c{a}{b} * {m(b, j)}" for a in (2, 3) for b in (2, 3))
    without = ", ".join(f"{m(i, j)} - ({taken(i, j)}) AS g{i}{j}" for i, j in every)
    columns = {**{f"x{i}": x for i, x in _X.items()}, "y": "temp"}
    now = ", ".join(f"{x} AS {c}" for c, x in columns.items())
    lag = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in columns)
    white = ", ".join(f"CASE WHEN p_x1 IS NULL THEN {c} ELSE ({c} - {phi} * p_{c}) / sqrt(1 - {phi} * {phi}) END AS {c}" for c in columns)
    sums = ", ".join(f"sum(g{i}{j}) AS a{i}{j}" for i in _X for j in _X if i <= j)
    rhs = ", ".join(f"sum(g{i}4) AS r{i}" for i in _X)
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"

    def minor(i: int, j: int) -> str:
        (p, q), (u, v) = [k for k in _X if k != i], [k for k in _X if k != j]
        return f"{'-' if (i + j) % 2 else ''}({a(p, u)} * {a(q, v)} - {a(p, v)} * {a(q, u)})"

    det = " + ".join(f"{a(1, j)} * ({minor(1, j)})" for j in _X)
    inverse = ", ".join(f"({minor(i, j)}) / ({det}) AS c{i}{j}" for i in _X for j in _X)
    solved = ", ".join(f"c{i}1 * r1 + c{i}2 * r2 + c{i}3 * r3 AS b{i}" for i in _X)
    cov = ", ".join(f"c{i}{j} * sigma2 AS v{i}{j}" for i in _X for j in _X)
    return _sql(f"""
, laid AS (SELECT {keys}, {spec['series']} AS s, {spec['order'].split(',')[0]} AS o1, event_id AS o2, {now} FROM {what}),
lagged AS (SELECT *, {lag} FROM laid WINDOW w AS (PARTITION BY s ORDER BY o1, o2)),
white AS (SELECT {keys}, s, {white} FROM lagged),
series AS (SELECT {keys}, s, {products}, count(*) AS n, {by[0]} AS d2, {by[1]} AS d3 FROM white GROUP BY {keys}, s),
inner_det AS (SELECT *, (1 + d2 * d2 * m22) * (1 + d3 * d3 * m33) - d2 * d2 * d3 * d3 * m23 * m23 AS det FROM series),
slopes AS (SELECT *, d2 * d2 * (1 + d3 * d3 * m33) / det AS c22, d3 * d3 * (1 + d2 * d2 * m22) / det AS c33,
    -d2 * d2 * d3 * d3 * m23 / det AS c23, -d2 * d2 * d3 * d3 * m23 / det AS c32 FROM inner_det),
marg AS (SELECT {keys}, s, n, d2, d3, {without}, ln(det) + (n - 1) * ln(1 - {phi} * {phi}) AS log_det FROM slopes),
sums AS (SELECT {keys}, {sums}, {rhs}, sum(g44) AS yy, sum(n) AS n, count(*) AS m, sum(log_det) AS log_det FROM marg GROUP BY {keys}),
inv AS (SELECT *, {inverse}, {det} AS det_x FROM sums),
est AS (SELECT *, {solved} FROM inv),
scale AS (SELECT sum(yy - b1 * r1 - b2 * r2 - b3 * r3) / (sum(n) - 3 * count(*)) AS sigma2, CAST(sum(n) AS BIGINT) AS n_rows,
    CAST(sum(m) AS BIGINT) AS n_series FROM est),
beta AS (SELECT est.*, {cov} FROM est, scale)
{body}""").replace("\n,", ",", 1)


def _gls_coef(what: str) -> str:
    factors = _GLS[what]["factors"]
    parts, k = [], 2 ** len(factors)
    for mask in range(k):
        used = [f for i, f in enumerate(factors) if mask >> i & 1]
        sign = " * ".join([f"CASE WHEN {name} = '{first}' THEN 1 ELSE -1 END" for name, (first, _) in used]) or "1"
        for j, wave in ((1, ""), (2, "hour_sin1"), (3, "hour_cos1")):
            term = ":".join([f"{name}1" for name, _ in used] + ([wave] if wave else [])) or "(Intercept)"
            parts.append(
                f"SELECT '{term}' AS term, round(sum({sign} * b{j}) / {k}, 6) AS estimate, round(sqrt(sum(v{j}{j})) / {k}, 6) AS se FROM beta"
            )
    return _gls(what, " UNION ALL ".join(parts))


def _beta_fraction(x: str, a: str, b: str) -> str:
    """The incomplete beta function where x < (a + 1) / (a + b + 2), its continued fraction from the last term inwards."""
    m = "floor(k / 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    terms = f"CAST(list_reverse(range(1, 101 + CAST(floor(10 * sqrt(greatest({a}, {b}))) AS BIGINT))) AS DOUBLE[])"
    rest = f"list_reduce({terms}, lambda rest, k: CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END / (1 + rest), CAST(0 AS DOUBLE))"
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / (1 + {rest})"


def _beta_cdf(x: str, a: str, b: str) -> str:
    x, a, b = f"({x})", f"({a})", f"({b})"
    return f"""CASE WHEN {x} >= 1 THEN 1 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {_beta_fraction(x, a, b)}
    ELSE 1 - ({_beta_fraction(f"(1 - {x})", b, a)}) END"""


def _steps(n: int) -> str:
    return f"CAST(range({n}) AS DOUBLE[])"


def _upper_t(q: float, df: str) -> str:
    """The t that a t variable exceeds with probability q: Newton steps from below on its convex tail."""
    tail = f"0.5 * ({_beta_cdf(f'{df} / ({df} + t * t)', f'{df} / 2', 'CAST(0.5 AS DOUBLE)')})"
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - ({df} + 1) / 2 * ln(1 + t * t / {df})) / sqrt({df} * pi())"
    return f"list_reduce({_steps(60)}, lambda t, u: t + (({tail}) - {q}) / ({density}), CAST(1 AS DOUBLE))"


def _upper_normal(q: float) -> str:
    rest = "list_reduce(CAST(list_reverse(range(1, 301)) AS DOUBLE[]), lambda r, k: z + k / r, z)"
    density = "(exp(-z * z / 2) / sqrt(2 * pi()))"
    return f"list_reduce({_steps(60)}, lambda z, u: z + ({density} / ({rest}) - {q!r}) / {density}, CAST(1 AS DOUBLE))"


def _degrees(what: str) -> tuple[str, str]:
    """Degrees of freedom between and within series."""
    classes = 2 ** len(_GLS[what]["factors"])
    return f"(n_series - {classes})", f"(n_rows - n_series - {2 * classes})"


def _gls_means(what: str) -> str:
    factors = _GLS[what]["factors"]
    at = ", ".join(f"avg({x}) AS m{i}" for i, x in _X.items())
    value = " + ".join(f"b{i} * m{i}" for i in _X)
    var = " + ".join(f"m{i} * m{j} * v{i}{j}" for i in _X for j in _X)
    cells = f"(SELECT *, {value} AS e, {var} AS v FROM beta, (SELECT {at} FROM {what}))"
    label = " || ', ' || ".join(name for name, _ in factors)
    parts = [f"SELECT {label} AS \"group\", e, sqrt(v) AS se FROM {cells}"]
    half = 2 ** (len(factors) - 1)
    for name, (first, second) in factors:
        sign = f"CASE WHEN {name} = '{first}' THEN 1 ELSE -1 END"
        parts.append(f"SELECT '{first} - {second}', sum({sign} * e) / {half}, sqrt(sum(v)) / {half} FROM {cells}")
    df = f"CAST(least({', '.join(_degrees(what))}) AS DOUBLE)"
    return _gls(what, f"""SELECT "group", round(e, 6) AS estimate, round(se, 6) AS se, round(lo, 6) AS lower, round(hi, 6) AS upper,
    '( ' || {_SHORT.format(x='lo')} || ' ,  ' || {_SHORT.format(x='hi')} || ' )' AS ci
FROM (SELECT "group", e, se, e - crit * se AS lo, e + crit * se AS hi
    FROM ({' UNION ALL '.join(parts)}), (SELECT {_upper_t(0.025, 'df')} AS crit FROM (SELECT {df} AS df FROM scale)))""")


def _gls_population(what: str, deviation: str = "") -> str:
    keys = [name for name, _ in _GLS[what]["factors"]]
    point = f"(SELECT *, {', '.join(f'{x} AS x{i}' for i, x in _X.items())} FROM ({_GLS[what]['grid']}))"
    value = " + ".join(f"b{i} * x{i}" for i in _X)
    var = " + ".join(f"x{i} * x{j} * v{i}{j}" for i in _X for j in _X)
    same = " AND ".join(f"g.{k} = beta.{k}" for k in keys)
    shown = ", ".join(f"g.{k}" for k in keys)
    if not deviation:
        crit = _upper_normal(0.05 / JOINT_LIMITS[what] / 2)
        return _gls(what, f"""SELECT * EXCLUDE (p, e, crit), round(p, 6) AS pred, round(e, 6) AS se, round(p - crit * e, 6) AS lo, round(p + crit * e, 6) AS hi
FROM (SELECT {shown}, day, hour, {value} AS p, sqrt({var}) AS e FROM {point} g JOIN beta ON {same}), (SELECT {crit} AS crit)""")
    return _gls(what, f"""SELECT {', '.join(f'x.{k}' for k in keys)}, day, hour, round(CASE WHEN tb_q1 IS NULL OR tb_q3 IS NULL THEN NULL
    WHEN sign(pred - tb_q1) * sign(pred - tb_q3) = -1 THEN 0.0
    WHEN sign(pred - tb_q1) = -1 THEN pred - tb_q1 ELSE pred - tb_q3 END, 6) AS {deviation}
FROM (SELECT {shown}, day, hour, {value} AS pred FROM {point} g JOIN beta ON {same}) x LEFT JOIN tpref ON x.{keys[0]} = tpref.{keys[0]}""")


def _reml(what: str) -> str:
    """Restricted log likelihood at each stated parameter set."""
    p = 3 * 2 ** len(_GLS[what]["factors"])
    parts = []
    for i, (phi, sd) in enumerate(STATED[what], 1):
        body = f"""SELECT CAST({i} AS INT) AS at, any_value(n_rows) AS n_rows, any_value(n_series) AS n_series, round(sqrt(any_value(sigma2)), 6) AS sigma,
    round(-0.5 * ((any_value(n_rows) - {p}) * ln(any_value(sigma2) * (any_value(n_rows) - {p})) + sum(log_det) + sum(ln(det_x)) + {p} * ln({p // 3})), 6) AS reml
FROM est, scale"""
        parts.append(f"SELECT * FROM ({_gls(what, body, phi, sd)})")
    return " UNION ALL ".join(parts)


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}{max(i, j)}"


def _with_slopes(what: str, body: str) -> str:
    """`own`: per series its keys, s, the class's b1..b3 and its own slopes u2, u3, at the first stated parameters."""
    keys = [name for name, _ in _GLS[what]["factors"]]
    slopes = ", ".join(
        f"d{z} * d{z} * ({_g(z, 4)} - {' - '.join(f'{_g(z, j)} * b{j}' for j in _X)}) AS u{z}" for z in (2, 3)
    )
    shown = ", ".join(f"marg.{k}" for k in keys)
    same = " AND ".join(f"marg.{k} = beta.{k}" for k in keys)
    phi, sd = STATED[what][0]
    return _gls(what, f", own AS (SELECT {shown}, s, b1, b2, b3, {slopes} FROM marg JOIN beta ON {same})\n{body}", phi, sd).replace(
        ")\n, own AS", "),\nown AS"
    )


def _blup(what: str) -> str:
    by = " || ':treatment' || treatment" if what == "te" else ""
    return _with_slopes(what, f"""SELECT s AS id, 'hour_sin1'{by} AS term, round(u2, 6) AS value FROM own
UNION ALL SELECT s, 'hour_cos1'{by}, round(u3, 6) FROM own""")


def _series_prediction(what: str) -> str:
    shown = {"tb": "id, type", "te": "id, location, site, treatment"}[what]
    days = _DAYS_TB if what == "tb" else _axis("te", "day", 40)
    value = f"b1 * ({_X[1]}) + (b2 + u2) * ({_X[2]}) + (b3 + u3) * ({_X[3]})"
    return _with_slopes(what, f"""SELECT g.*, round({value}, 4) AS pred
FROM (SELECT * FROM (SELECT DISTINCT {shown} FROM {what}), {days}, {_HOURS_TB if what == 'tb' else _HOURS_TE}) g
JOIN (SELECT s, b1, b2, b3, u2, u3 FROM own) ON g.id = s""")


def _anova(what: str) -> str:
    """Sequential tests: the whole design, in the order of its terms, swept column by column on single numbers."""
    factors = _GLS[what]["factors"]
    wave = 1 << len(factors)
    masks = sorted(range(2 * wave), key=lambda m: (m.bit_count(), m))
    columns = [(m & (wave - 1), w) for m in masks for w in ((2, 3) if m & wave else (1,))]
    p = len(columns)

    def sign(mask: int) -> str:
        used = [f for i, f in enumerate(factors) if mask >> i & 1]
        return " * ".join(f"(CASE WHEN {name} = '{first}' THEN 1 ELSE -1 END)" for name, (first, _) in used) or "1"

    def product(r: tuple[int, int], c: tuple[int, int]) -> str:
        (mr, i), (mc, j) = r, c
        part = "yy" if i == j == 4 else f"r{min(i, j)}" if 4 in (i, j) else f"a{min(i, j)}{max(i, j)}"
        return f"sum({sign(mr)} * {sign(mc)} * {part})"

    full = [*columns, (0, 4)]
    matrix = "[" + ", ".join("[" + ", ".join(product(r, c) for c in full) + "]" for r in full) + "]"
    steps = [f"s0 AS (SELECT {matrix} AS a FROM sums)"]
    for k in range(1, p + 1):
        cell = f"CASE WHEN i <= {k} OR j <= {k} THEN 0 ELSE a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}] END"
        steps.append(f"s{k} AS (SELECT list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j: {cell})) AS a FROM s{k - 1})")
    words = {"type": "Group", "location": "Location", "treatment": "Exposure"}
    between, within = _degrees(what)
    rows, at = [], 1
    for number, m in enumerate(masks[1:], 1):
        size = 2 if m & wave else 1
        label = ":".join([words[name] for i, (name, _) in enumerate(factors) if m >> i & 1] + (["Hour"] if m & wave else []))
        rss = f"(SELECT a[{p + 1}][{p + 1}] FROM s{at}) - (SELECT a[{p + 1}][{p + 1}] FROM s{at + size})"
        rows.append(f"SELECT {number} AS ord, '{label}' AS term, {size} AS num_df, {within if m & wave else between} AS den_df, ({rss}) / {size} / sigma2 AS f FROM scale")
        at += size
    phi, sd = STATED[what][0]
    tested = f", tested AS ({' UNION ALL '.join(rows)})"
    tail = _beta_cdf("den / (den + num * f)", "den / 2", "num / 2")
    return _gls(what, f""", {', '.join(steps)}{tested}
SELECT CAST(ord AS INT) AS ord, term, CAST(num_df AS INT) AS num_df, CAST(den_df AS INT) AS den_df, round(f, 6) AS f, round({tail}, 6) AS p
FROM (SELECT *, CAST(num_df AS DOUBLE) AS num, CAST(den_df AS DOUBLE) AS den FROM tested)""", phi, sd).replace(")\n, s0 AS", "),\ns0 AS")


for _w in _GLS:
    ORACLES[f"q_gls_coef_{_w}"] = _gls_coef(_w)
    ORACLES[f"q_gls_scale_{_w}"] = _gls(_w, "SELECT n_rows, n_series, round(sqrt(sigma2), 6) AS sigma FROM scale")
    ORACLES[f"q_emm_at_{_w}"] = _gls_means(_w)
    ORACLES[f"q_predict_at_level0_{_w}"] = _gls_population(_w)
    ORACLES[f"q_pred_deviation_at_{_w}"] = _gls_population(_w, {"tb": "pred_db", "te": "pred_de"}[_w])
    ORACLES[f"q_reml_{_w}"] = _reml(_w)
    ORACLES[f"q_blup_at_{_w}"] = _blup(_w)
    ORACLES[f"q_predict_at_level1_{_w}"] = _series_prediction(_w)
    ORACLES[f"q_anova_at_{_w}"] = _anova(_w)
