"""SQL for queries over sources, sinks, reports and signal kernels, told independently of them."""

from __future__ import annotations

import math

from strideway.plans.oracles import DAYS, ENMO_MIN, HOURS, LABELS, SAMPLES, VEC
from strideway.plans.oracles import ORACLES as PLANS

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
NUMBERED = "nm AS (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS t, round(value::FLOAT::DOUBLE, 4) AS a, (user_id % 10)::DOUBLE AS b FROM events)"


def recorded(axes: str, where: str = "") -> str:
    return f"WITH {NUMBERED} SELECT {TS.format('t')} AS time, {axes} FROM nm {where}"


N, RATE, BAND, LAGS = 64, 10, 16, 24
#: (vec_id, i, x): values by place, from 0.
FLAT = f"{VEC}, fx AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e)"


def prominent(source: str, name: str) -> str:
    """Local maxima of (vec_id, i, x) and how far they stand out, as name (vec_id, i, x, stand)."""
    return f"""
        {name}_n AS MATERIALIZED (SELECT vec_id, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM {source} WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
        {name}_m AS MATERIALIZED (SELECT vec_id, i, x FROM {name}_n WHERE x > a AND x > b),
        {name}_h AS (SELECT m.vec_id, m.i, m.x, max(s.i) FILTER (s.i < m.i AND s.x > m.x) AS l, min(s.i) FILTER (s.i > m.i AND s.x > m.x) AS r FROM {name}_m m JOIN {source} s ON s.vec_id = m.vec_id GROUP BY ALL),
        {name} AS MATERIALIZED (
            SELECT h.vec_id, h.i, h.x, h.x - greatest(min(s.x) FILTER (s.i <= h.i AND s.i > coalesce(l, -1)), min(s.x) FILTER (s.i >= h.i AND s.i < coalesce(r, 1000))) AS stand
            FROM {name}_h h JOIN {source} s ON s.vec_id = h.vec_id GROUP BY h.vec_id, h.i, h.x
        )"""


def lowpassed(source: str, name: str, cutoff: float, rate: float, n: int = N) -> str:
    """(vec_id, i, x) after a Butterworth filter of order four, forward and backward over an odd extension by 15 places."""
    k = math.tan(math.pi * cutoff / rate)
    co = []
    for angle in (math.pi / 8, 3 * math.pi / 8):
        q = 2 * math.sin(angle)
        d = 1 + k * q + k * k
        co.append({"b": k * k / d, "a1": 2 * (k * k - 1) / d, "a2": (1 - k * q + k * k) / d})
    (c1, c2), pad = co, 15
    f = lambda v: f"({v!r}::DOUBLE)"
    step = lambda c, x, y, u, v: (f"{f(2 * c['b'])} * {x} - {f(c['a1'])} * {y} + {v}", f"{f(c['b'])} * {x} - {f(c['a2'])} * {y}")
    first = [(f"{f(1 - c['b'])} * x", f"{f(c['b'] - c['a2'])} * x") for c in co]

    def run(src: str, out: str) -> str:
        u1, v1 = step(c1, "x", "y1", "u1", "v1")
        u2, v2 = step(c2, "y1", "y2", "u2", "v2")
        return f"""
            {out}_r AS (
                SELECT vec_id, -1 AS i, NULL::DOUBLE AS y, {first[0][0]} AS u1, {first[0][1]} AS v1, {first[1][0]} AS u2, {first[1][1]} AS v2 FROM {src} WHERE i = 0
                UNION ALL
                SELECT vec_id, i, y2, {u1}, {v1}, {u2}, {v2} FROM (
                    SELECT *, {f(c2['b'])} * y1 + u2 AS y2 FROM (
                        SELECT s.vec_id, s.i, s.x, {f(c1['b'])} * s.x + p.u1 AS y1, p.u1, p.v1, p.u2, p.v2 FROM {out}_r p JOIN {src} s ON s.vec_id = p.vec_id AND s.i = p.i + 1
                    )
                )
            ), {out} AS MATERIALIZED (SELECT vec_id, i, y AS x FROM {out}_r WHERE i >= 0)"""

    whole = n + 2 * pad
    return f"""
        {name}_e AS MATERIALIZED (SELECT vec_id, min_by(x, i) AS a, max_by(x, i) AS z FROM {source} GROUP BY vec_id),
        {name}_x AS MATERIALIZED (
            SELECT vec_id, i + {pad} AS i, x FROM {source}
            UNION ALL SELECT vec_id, {pad} - i, 2 * a - x FROM {source} JOIN {name}_e USING (vec_id) WHERE i BETWEEN 1 AND {pad}
            UNION ALL SELECT vec_id, {pad} + 2 * {n - 1} - i, 2 * z - x FROM {source} JOIN {name}_e USING (vec_id) WHERE i BETWEEN {n - 1 - pad} AND {n - 2}
        ), {run(name + "_x", name + "_f")},
        {name}_b AS MATERIALIZED (SELECT vec_id, {whole - 1} - i AS i, x FROM {name}_f), {run(name + "_b", name + "_g")},
        {name} AS MATERIALIZED (SELECT vec_id, {whole - 1 - pad} - i AS i, x FROM {name}_g WHERE i BETWEEN {pad} AND {pad + n - 1})"""


ACF = f"""{VEC}, d AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS d FROM e), ac AS MATERIALIZED (
            SELECT vec_id, k AS i, list_inner_product(d[k + 1:], d[1:{N} - k]) / list_inner_product(d, d) AS x FROM d, range(LAST) t(k)
        )"""

PICK = ", ".join(f"coalesce(round(max({c}) FILTER (rk = {k}), 6), 0) AS {n}{k}" for n, c in (("f", "f"), ("p", "p")) for k in (1, 2, 3))

ORACLES = {
    "csv_recordings": recorded("a AS x, b AS y, 1.0::DOUBLE AS z"),
    "csv_by_position": recorded("b AS x, a AS y, 1.0::DOUBLE AS z"),
    "csv_row_range": recorded("a AS x, b AS y, 1.0::DOUBLE AS z", "QUALIFY row_number() OVER (ORDER BY event_id) - 1 BETWEEN 10 AND 500"),
    "csv_time_format": recorded("a AS x, b AS y, 1.0::DOUBLE AS z"),
    "csv_duplicate_times": f"""WITH {NUMBERED}, m AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(event_id // 3 * 60) AS u FROM nm)
        SELECT {TS.format('u')} AS time, a AS x, b AS y, 1.0::DOUBLE AS z FROM m WHERE u >= TIMESTAMP '2024-01-01 01:00:00' AND u < TIMESTAMP '2024-01-01 21:00:00' QUALIFY row_number() OVER (PARTITION BY u ORDER BY event_id) = 1""",
    "parquet_recordings": f"SELECT {TS.format('''TIMESTAMP '2024-01-01' + to_seconds(event_id)''')} AS time, round(value, 4) AS x, nullif((user_id % 10)::DOUBLE, 0) AS y, 1.0::DOUBLE AS z FROM events",
    "device_recordings": f"""WITH k AS (SELECT event_type, count(*) AS n, min(user_id) AS low FROM events GROUP BY ALL)
        SELECT event_type AS recording, {TS.format('''TIMESTAMP '2024-01-01' + to_seconds(i)''')} AS time, n::DOUBLE AS x, low::DOUBLE AS y, i::DOUBLE AS z, i AS row FROM k, range(3) t(i)""",
    "training_csv": f"SELECT 'P0' || (event_id % 3) AS pid, {TS.format('ts')} AS time, round(value::FLOAT::DOUBLE, 4) AS x, 0.5::DOUBLE AS y, 1.0::DOUBLE AS z, (user_id % 3)::INTEGER AS annotation FROM events",
    "training_written": """WITH o AS (SELECT event_type AS pid, date_trunc('day', min(ts)) AS o FROM events GROUP BY ALL),
        b AS (SELECT pid, time_bucket(INTERVAL 2 HOUR, ts, o) AS w, sum((user_id % 7 = 0)::INT)::BIGINT AS s FROM events JOIN o ON pid = event_type GROUP BY ALL HAVING count(*) >= 4)
        SELECT pid, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, 4 AS length, 4.0::DOUBLE AS z, CASE WHEN s >= 2 THEN s ELSE 0 END AS steps, (s >= 2)::INTEGER AS walk FROM b""",
    "training_kept": f"""WITH o AS (SELECT event_type AS recording, min(ts) AS o FROM events GROUP BY ALL),
        b AS (SELECT recording, o + to_microseconds((epoch_us(ts) - epoch_us(o)) // 10800000000 * 10800000000) AS w, count(*) AS n, min(ts) AS a, max(ts) AS z, min((user_id % 17 <> 0)::INT) AS ok FROM events JOIN o ON o.recording = event_type GROUP BY ALL)
        SELECT recording, {TS.format('w')} AS window_start, least(n, 8)::INTEGER AS n, {TS.format('z')} AS last FROM b WHERE n >= 8 AND ok = 1 AND abs((epoch_us(z) - epoch_us(a)) / 1e6 - 10400) < 104""",
    "infos_read": "SELECT event_type AS filename, count(*) AS total_steps, round(sum(value), 2) AS sum, CASE WHEN count(*) % 2 = 1 THEN max(user_id) END AS high FROM events GROUP BY event_type",
    "results_collated": f"""WITH {DAYS}, n AS (SELECT recording, row_number() OVER (ORDER BY recording) - 1 AS i FROM (SELECT DISTINCT recording FROM dy))
        SELECT recording AS filename, {TS.format('time')} AS date, round(v, 4) AS steps, CASE WHEN i % 2 = 0 THEN i::INTEGER END AS extra, 'Daily,Info' AS kinds FROM dy JOIN n USING (recording)""",
    "results_united": "SELECT n_name AS name, n_nationkey::INTEGER AS key, NULL::VARCHAR AS kind FROM nation UNION ALL SELECT r_name, r_regionkey::INTEGER, 'region' FROM region",
    "files_found": """WITH n AS (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))
        SELECT t || (['.cwa', '.CWA.gz', '.cwa.zip'])[i % 4 + 1] AS name FROM n WHERE i % 4 < 3""",
    "file_digests": "SELECT r_regionkey::VARCHAR AS name, md5(r_name) AS md5 FROM region",
    "path_split": """SELECT doc_id, '/data/' || coalesce(source, 'none') AS folder, CASE WHEN doc_id % 4 <> 2 THEN 'd' || doc_id END AS name, (['.csv', '.cwa', NULL, '.b'])[doc_id % 4 + 1] AS extension FROM documents""",
    "commands_listed": "SELECT DISTINCT 'strideway process /in/a.b/' || event_type || '.cwa.gz --outdir /out/a.b/' || event_type || ' -q' AS command FROM events",
    "metrics_shown": "SELECT unnest(['TotalSteps', 'StepsDayAvg', 'StepsDayMed', 'StepsDayMin', 'StepsDayMax']) AS metric",
    "steps_written": PLANS["epochs_hourly_spine"],
    "step_times": f"WITH {HOURS} SELECT recording, strftime(time + to_milliseconds(ms), '%Y-%m-%d %H:%M:%S.%g') AS time FROM ep, (VALUES (250), (1500), (59000)) t(ms) WHERE s >= 100",
    "windows_judged": f"""WITH {SAMPLES}, o AS (SELECT recording, min(time) AS o, max(time) AS l FROM sa GROUP BY ALL), v AS (SELECT recording, (epoch_us(time) - epoch_us(o)) // 21600000000 AS k, ok, sqrt(x * x + y * y + 1) AS v FROM sa JOIN o USING (recording)),
        b AS (SELECT recording, k, count(*) AS n, CASE WHEN min(ok::INT) = 1 THEN (sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) >= 0.35)::INTEGER END AS walk FROM v GROUP BY ALL),
        g AS (SELECT recording, o, unnest(range(0, (epoch_us(l) - epoch_us(o)) // 21600000000 + 1)) AS k FROM o)
        SELECT g.recording, {TS.format('o + to_microseconds(g.k * 21600000000)')} AS window_start, coalesce(n, 0) AS n, walk FROM g LEFT JOIN b ON b.recording = g.recording AND b.k = g.k""",
    "network_windows": f"""WITH {VEC}, l AS (SELECT vec_id, list_avg(v) AS l0, list_max(v) / 2 + v[1] - 0.25 AS l1 FROM e) SELECT vec_id, round(l0, 6) AS l0, round(l1, 6) AS l1, (l1 > l0)::INTEGER AS walk FROM l""",
    "group_split": """WITH g AS (SELECT conv_id % 13 AS g, count(*) AS n FROM conversations GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY md5('123:' || g)) AS i, ceil(count(*) OVER () * 0.2) AS m FROM g WHERE g IS NOT NULL)
        SELECT g, n, CASE WHEN i <= m THEN 'test' ELSE 'train' END AS part FROM k""",
    "cross_predicted": f"""WITH {LABELS}, g AS (SELECT doc_id % 10 AS g, min(doc_id) AS f FROM sc GROUP BY ALL), fo AS (SELECT g, (ntile(4) OVER (ORDER BY f) - 1)::INTEGER AS fold FROM g),
        x AS (SELECT doc_id, fo.fold, score FROM sc JOIN fo ON fo.g = doc_id % 10), m AS (SELECT fold, sum(score) AS s, count(*) AS n FROM x GROUP BY ALL)
        SELECT doc_id, fold, round(((SELECT sum(s) FROM m) - s) / ((SELECT sum(n) FROM m) - n), 6) AS predicted FROM x JOIN m USING (fold)""",
    "report_hourly": f"WITH {HOURS}, {ENMO_MIN} SELECT coalesce(ep.recording, hf.recording) AS filename, {TS.format('coalesce(ep.time, hf.time)')} AS time, round_even(s, 0)::BIGINT AS steps, round(hf.e, 4) AS enmo FROM ep FULL JOIN hf ON hf.recording = ep.recording AND hf.time = ep.time",
    "report_minutely": f"""WITH {HOURS}, {ENMO_MIN}, g AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 MINUTE)) AS time FROM ep GROUP BY recording),
        q AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 MINUTE)) AS time FROM mm GROUP BY recording),
        a AS (SELECT g.recording, g.time, s FROM g LEFT JOIN ep USING (recording, time)), b AS (SELECT q.recording, q.time, e FROM q LEFT JOIN mm USING (recording, time))
        SELECT coalesce(a.recording, b.recording) AS filename, {TS.format('coalesce(a.time, b.time)')} AS time, round_even(s, 0)::BIGINT AS steps, round(e, 4) AS enmo FROM a FULL JOIN b ON a.recording = b.recording AND a.time = b.time""",
    "report_daily": f"""WITH {DAYS}, {ENMO_MIN}, wk AS (SELECT recording, date_trunc('day', time) AS time, sum((s >= 100)::INT)::DOUBLE * 60 AS walk FROM ep GROUP BY recording, date_trunc('day', time))
        SELECT recording AS filename, {TS.format('time')} AS time, round_even(v, 0)::BIGINT AS steps, round(df.e, 4) AS enmo, walk FROM dy FULL JOIN df USING (recording, time) FULL JOIN wk USING (recording, time)""",
    "report_info": PLANS["info_pivot"],
    "report_bouts": f"SELECT b.recording AS filename, b.start_time, b.end_time, b.duration, b.steps, e.enmo FROM ({PLANS['bouts_summary']}) b JOIN ({PLANS['bouts_enmo']}) e ON e.recording = b.recording AND e.bout = b.bout",
    "report_unworn": f"WITH {DAYS} SELECT recording, recording <> 'click' AS worn, CASE WHEN recording <> 'click' THEN round(sum(v), 2) END AS total FROM dy GROUP BY recording",
    "feature_acf": f"WITH {ACF.replace('LAST', str(LAGS + 1))} SELECT vec_id, " + ", ".join(f"round(max(x) FILTER (i = {k}), 6) AS acf{k}" for k in range(LAGS + 1)) + " FROM ac GROUP BY vec_id",
    "feature_acf_peaks": f"""WITH {ACF.replace('LAST', str(2 * RATE + 1))}, ng AS MATERIALIZED (SELECT vec_id, i, -x AS x FROM ac), {prominent('ac', 'up')}, {prominent('ng', 'lo')},
        z AS (SELECT vec_id, sum((s <> p)::INT) AS z FROM (SELECT vec_id, x < 0 AS s, lag(x < 0) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM ac) GROUP BY vec_id),
        u AS (SELECT vec_id, min(i) AS i, min_by(x, i) AS x FROM up WHERE stand >= 0.1 GROUP BY vec_id), l AS (SELECT vec_id, min(i) AS i, -min_by(x, i) AS x FROM lo WHERE stand >= 0.1 GROUP BY vec_id)
        SELECT vec_id, round(coalesce(u.x, 0), 6) AS acf_1st_max, round(coalesce(u.i / {RATE}, 0), 6) AS acf_1st_max_loc, round(coalesce(l.x, 0), 6) AS acf_1st_min, round(coalesce(l.i / {RATE}, 0), 6) AS acf_1st_min_loc, z::DOUBLE AS acf_zeros
        FROM z LEFT JOIN u USING (vec_id) LEFT JOIN l USING (vec_id)""",
    "feature_spectrum": f"""WITH {FLAT}, m AS (SELECT vec_id, avg(x) AS m FROM fx GROUP BY ALL),
        s AS (SELECT vec_id, k, sum((x - m) * cos(2 * pi() * k * i / {N})) AS c, sum((x - m) * sin(2 * pi() * k * i / {N})) AS s FROM fx JOIN m USING (vec_id), range({N // 2 + 1}) t(k) GROUP BY ALL),
        p AS MATERIALIZED (SELECT vec_id, k, (c * c + s * s) / ({RATE} * {N}) * CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END / ({N} / {RATE}) AS p, k * {RATE} / {N} AS f FROM s),
        t AS (SELECT vec_id, sum(p) AS power, -sum(CASE WHEN p > 0 THEN p * ln(p) END) / sum(p) + ln(sum(p)) AS pentropy FROM p GROUP BY vec_id),
        pk AS (SELECT vec_id, f, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS rk FROM (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k)) WHERE p > a AND p > b),
        x AS (SELECT vec_id, {PICK} FROM t LEFT JOIN pk USING (vec_id) GROUP BY vec_id)
        SELECT x.*, round(pentropy, 6) AS pentropy, round(power, 6) AS power FROM x JOIN t USING (vec_id)""",
    "feature_bands": f"""WITH {FLAT}, g AS (SELECT vec_id, j, i - j * {BAND // 2} AS i, x FROM fx, range({2 * N // BAND - 1}) t(j) WHERE i BETWEEN j * {BAND // 2} AND j * {BAND // 2} + {BAND - 1}),
        h AS (SELECT vec_id, j, i, (x - avg(x) OVER (PARTITION BY vec_id, j)) * (0.5 - 0.5 * cos(2 * pi() * i / {BAND})) AS x FROM g),
        s AS (SELECT vec_id, j, k, sum(x * cos(2 * pi() * k * i / {BAND})) AS c, sum(x * sin(2 * pi() * k * i / {BAND})) AS s FROM h, range(6) t(k) GROUP BY ALL),
        w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / {BAND}), 2)) AS w FROM range({BAND}) t(i)),
        m AS (SELECT vec_id, k, median((c * c + s * s) / ({BAND} * w) * CASE WHEN k IN (0, {BAND // 2}) THEN 1 ELSE 2 END) / {1 - 1 / 2 + 1 / 3 - 1 / 4 + 1 / 5 - 1 / 6 + 1 / 7 !r}::DOUBLE AS p FROM s, w GROUP BY ALL)
        SELECT vec_id, """ + ", ".join(f"round(max(p) FILTER (k = {k}), 6) AS fft{k}" for k in range(6)) + " FROM m GROUP BY vec_id",
    "peaks_found": f"""WITH {FLAT}, {prominent('fx', 'pk')}, p AS (SELECT * FROM pk WHERE stand >= 0.3)
        SELECT e.vec_id, count(p.i)::DOUBLE AS n, min(p.i)::DOUBLE AS first, max(p.i)::DOUBLE AS last, round(sum(stand), 6) AS total FROM e LEFT JOIN p ON p.vec_id = e.vec_id GROUP BY e.vec_id""",
    "peaks_apart": f"""WITH RECURSIVE {FLAT}, nn AS (SELECT vec_id, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM fx WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
        pk AS (SELECT vec_id, list(i ORDER BY x DESC, i DESC) AS left_ FROM nn WHERE x > a AND x > b GROUP BY vec_id),
        st AS (
            SELECT vec_id, left_, []::BIGINT[] AS got FROM pk
            UNION ALL
            SELECT vec_id, list_filter(left_, lambda j: abs(j - left_[1]) >= 5), list_append(got, left_[1]) FROM st WHERE len(left_) > 0
        ), en AS (SELECT vec_id, got FROM st WHERE len(left_) = 0)
        SELECT e.vec_id, coalesce(len(got), 0)::DOUBLE AS n, coalesce(list_sum(got), 0)::DOUBLE AS places FROM e LEFT JOIN en USING (vec_id)""",
    "signal_filtered": f"WITH RECURSIVE {FLAT}, {lowpassed('fx', 'lp', 3, RATE)} SELECT vec_id, " + ", ".join(f"round(max(x) FILTER (i = {i}), 6) AS v{i}" for i in range(0, N, 7)) + " FROM lp GROUP BY vec_id",
    "magnitude_steps": f"""WITH RECURSIVE {FLAT}, mg AS MATERIALIZED (SELECT vec_id, i, least(sqrt(16 * x * x + x * x / 4 + 1) - 1, 2) AS x FROM fx), {lowpassed('mg', 'lp', 3, RATE)}, {prominent('lp', 'pk')}, p AS (SELECT * FROM pk WHERE stand >= 0.2)
        SELECT e.vec_id, count(p.i)::INTEGER AS steps, round(coalesce(sum(p.i / {RATE}), 0), 4) AS total, round(min(p.i / {RATE}), 4) AS first FROM e LEFT JOIN p ON p.vec_id = e.vec_id GROUP BY e.vec_id""",
    "features_gate": f"""WITH {FLAT}, n AS (SELECT vec_id, (1 + vec_id % 40)::INTEGER AS n FROM e), mg AS (SELECT vec_id, n, i, sqrt(16 * x * x + x * x / 4 + 1) AS x FROM fx JOIN n USING (vec_id) WHERE i < n),
        md AS (SELECT a.vec_id, a.n, a.i, median(b.x) AS x FROM mg a, range(-2, 3) t(o), mg b WHERE b.vec_id = a.vec_id AND b.i = greatest(0, least(a.n - 1, a.i + o)) GROUP BY ALL),
        v AS (SELECT vec_id, n, greatest(-2, least(2, x - 1)) AS x FROM md)
        SELECT vec_id, n, has, CASE WHEN has THEN round(a, 6) END AS avg, CASE WHEN has THEN round(m, 6) END AS max FROM (SELECT vec_id, n, n > {2 * RATE} AND (vec_id % 7 <> 0 OR n < 4) AS has, avg(x) AS a, max(x) AS m FROM v GROUP BY vec_id, n)""",
}
