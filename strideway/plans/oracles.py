"""SQL with the same results as the queries, told independently of their plans."""

from __future__ import annotations

T = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"

HOURS = """
    h AS (SELECT event_type AS recording, date_trunc('hour', ts) AS time, round(sum(value), 2) AS s FROM events GROUP BY ALL),
    sp AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM h GROUP BY recording),
    ep AS (SELECT sp.recording, sp.time, h.s FROM sp LEFT JOIN h USING (recording, time))
"""
MINUTES = """
    h AS (SELECT event_type AS recording, date_trunc('minute', ts) AS time, round(sum(value), 2) AS s FROM events GROUP BY ALL),
    sp AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 MINUTE)) AS time FROM h GROUP BY recording),
    ep AS (SELECT sp.recording, sp.time, h.s FROM sp LEFT JOIN h USING (recording, time))
"""
DAYS = HOURS + ", dy AS (SELECT recording, date_trunc('day', time) AS time, sum(s) AS v, count(s) AS n FROM ep GROUP BY ALL)"
GATED = DAYS + ", g AS (SELECT recording, time, CASE WHEN n * 60 > 22 * 60 THEN v END AS v FROM dy)"
SAMPLES = """
    sa AS (
        SELECT event_type AS recording, ts AS time, user_id % 17 <> 0 AS ok, CASE WHEN user_id % 17 <> 0 THEN value / 40 END AS x, (user_id % 10) / 20 AS y FROM events
    )
"""


def by_daytype(value: str, source: str, aggs: str, extra: str = "") -> str:
    """Aggregates over all days, weekends and weekdays of (recording, time, value)."""
    kinds = {"overall": "true", "weekend": "isodow(time) >= 6", "weekday": "isodow(time) < 6"}
    return " UNION ALL ".join(f"SELECT recording, '{k}' AS daytype{extra}, {aggs.format(v=value)} FROM {source} WHERE {w} GROUP BY ALL" for k, w in kinds.items())


def five(suffix: str) -> str:
    return ", ".join(f"round({f}({{v}}), 6) AS {n}_{suffix}" for f, n in (("sum", "total"), ("avg", "avg"), ("median", "med"), ("min", "min"), ("max", "max")))


def cascade(source: str, fn: str, groups: list[str], name: str) -> str:
    """Steps of filling v of (recording, time, v); the last is called name."""
    out, prev = [], source
    for i, g in enumerate(groups):
        this = name if i == len(groups) - 1 else f"{name}_fill{i}"
        out.append(f"{this} AS (SELECT recording, time, coalesce(v, {fn}(v) OVER (PARTITION BY recording{', ' + g if g else ''})) AS v FROM {prev})")
        prev = this
    return ", ".join(out)


SLOT = "hour(time), minute(time) // 5"
FILL = ["isodow(time), " + SLOT, "isodow(time) >= 6, " + SLOT, SLOT]
DAYFILL = ["isodow(time)", "isodow(time) >= 6", ""]
WHOLE = (
    HOURS
    + """, gr AS (
        SELECT recording, unnest(generate_series(date_trunc('day', min(time)), date_trunc('day', max(time)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS time FROM ep GROUP BY recording
    ), f0 AS (SELECT gr.recording, gr.time, ep.s AS v FROM gr LEFT JOIN ep USING (recording, time)
    ), em AS (SELECT recording, time::DATE AS d FROM ep GROUP BY ALL HAVING count(s) = 0), """
    + cascade("f0", "avg", FILL, "f")
    + ", im AS (SELECT f.recording, f.time, CASE WHEN em.d IS NULL THEN v END AS v FROM f LEFT JOIN em ON f.recording = em.recording AND f.time::DATE = em.d)"
)
SHARES = """
    sh AS (
        SELECT recording, time, s, date_trunc('day', time) AS d,
               round(CASE WHEN s IS NOT NULL THEN sum(s) OVER (PARTITION BY recording, date_trunc('day', time) ORDER BY time) / nullif(sum(s) OVER (PARTITION BY recording, date_trunc('day', time)), 0) END, 9) AS share
        FROM ep
    ), pt AS (
        SELECT recording, d AS time, count(s) AS n, """ + ", ".join(f"epoch(min(time) FILTER (share >= {p / 100}) - d)::BIGINT AS p{p:02}_at" for p in (5, 25, 50, 75, 95)) + """
        FROM sh GROUP BY recording, d
    )
"""
CADENCE = (
    MINUTES
    + """, b AS (SELECT recording, date_trunc('day', time) AS d, coalesce(s, 0) AS s FROM ep WHERE coalesce(s, 0) >= 3
    ), rk AS (SELECT *, rank() OVER (PARTITION BY recording, d ORDER BY s DESC) AS r FROM b
    ), cd0 AS (
        SELECT recording, d AS time, CASE WHEN count(*) >= 5 THEN avg(s) FILTER (r <= 1) END AS peak1, CASE WHEN count(*) >= 5 THEN avg(s) FILTER (r <= 30) END AS peak30,
               CASE WHEN count(*) >= 5 THEN quantile_cont(s, 0.95) END AS p95
        FROM rk GROUP BY recording, d
    ), ad AS (SELECT DISTINCT recording, date_trunc('day', time) AS time FROM ep
    ), cd AS (SELECT ad.recording, ad.time, peak1, peak30, p95 FROM ad LEFT JOIN cd0 USING (recording, time))"""
)
BOUTS = (
    HOURS
    + """, w AS (SELECT recording, time, s, row_number() OVER (PARTITION BY recording ORDER BY time) AS i, coalesce(s >= 100, false) AS one FROM ep
    ), st AS (
        SELECT recording, i, CASE WHEN one THEN 1::BIGINT END AS start, one::INT AS ones, 1::BIGINT AS last, NULL::BIGINT AS done_start, NULL::BIGINT AS done_last FROM w WHERE i = 1
        UNION ALL
        SELECT w.recording, w.i,
               CASE WHEN one THEN coalesce(start, w.i) WHEN start IS NULL OR closed THEN NULL ELSE start END,
               CASE WHEN one THEN CASE WHEN start IS NULL THEN 1 ELSE ones + 1 END ELSE ones END,
               CASE WHEN one THEN w.i ELSE last END,
               CASE WHEN closed THEN start END, CASE WHEN closed THEN last END
        FROM (
            SELECT st.recording AS r0, start, ones, last, w.i AS wi, w.recording AS wr, NOT w.one AND start IS NOT NULL AND (w.i - last > 3 OR ones::DOUBLE / (w.i - start + 1) < 0.8) AS closed
            FROM st JOIN w ON st.recording = w.recording AND w.i = st.i + 1
        ) q JOIN w ON w.recording = q.wr AND w.i = q.wi
    ), bt AS (
        SELECT recording, done_start AS a, done_last AS b FROM st WHERE done_start IS NOT NULL
        UNION ALL
        SELECT recording, start, last FROM st WHERE start IS NOT NULL AND i = (SELECT max(i) FROM w WHERE w.recording = st.recording)
    ), bn AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY a) AS bout FROM bt)"""
).replace("w AS (SELECT recording, time, s, row_number", "w AS MATERIALIZED (SELECT recording, time, s, row_number")
LABELS = """
    sc AS (
        SELECT doc_id, quality::INT AS t, (CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END)::INT AS p, (doc_id % 5)::INT AS fold, (doc_id * 37 % 101) / 100.0::DOUBLE + quality * 0.2::DOUBLE AS score FROM labels
    )
"""
METRICS = """
    (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(list_avg(list_filter([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)], lambda v: v IS NOT NULL)), 0) AS balanced_accuracy
"""
CELLS = ", ".join(f"coalesce(sum({{w}}) FILTER (t = {t} AND p = {p}), 0)::DOUBLE AS {n}" for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
ENMO_MIN = SAMPLES + """,
    mm AS (SELECT recording, date_trunc('minute', time) AS time, avg(CASE WHEN ok THEN greatest(sqrt(x * x + y * y + 1) - 1, 0) * 1000 END) AS e FROM sa GROUP BY ALL),
    eh AS (SELECT recording, date_trunc('hour', time) AS time, avg(e) AS e FROM mm GROUP BY ALL),
    ed AS (SELECT recording, date_trunc('day', time) AS time, avg(e) AS e FROM mm GROUP BY ALL),
    hs AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM eh GROUP BY recording),
    ds AS (SELECT recording, unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time FROM ed GROUP BY recording),
    hf AS (SELECT hs.recording, hs.time, e FROM hs LEFT JOIN eh USING (recording, time)),
    df AS (SELECT ds.recording, ds.time, e FROM ds LEFT JOIN ed USING (recording, time))
"""
VEC = "e AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE) AS v FROM embeddings)"


def profile(source: str, value: str) -> str:
    return f"""
        pr AS ({by_daytype(value, source, "avg({v}) AS m", ", hour(time) AS hour")}),
        ev AS (SELECT DISTINCT recording, daytype, hour FROM (SELECT DISTINCT recording FROM {source}), (VALUES ('overall'), ('weekend'), ('weekday')) k(daytype), range(24) t(hour))
    """


ORACLES = {
    "epochs_hourly_spine": f"WITH {HOURS} SELECT recording, {T}, s AS steps FROM ep",
    "steps_daily": f"WITH {DAYS} SELECT recording, {T}, round_even(round(v, 4), 0)::BIGINT AS steps FROM dy",
    "steps_hourly": f"WITH {HOURS} SELECT recording, {T}, s AS steps FROM ep",
    "steps_minutely": f"WITH {MINUTES} SELECT recording, {T}, s AS steps FROM ep",
    "steps_daily_adjusted_gate": f"WITH {DAYS} SELECT recording, {T}, CASE WHEN n * 60 > 1260 THEN round(v, 4) END AS steps FROM dy",
    "steps_summary": f"WITH {DAYS} {by_daytype('v', 'dy', five('steps'))}",
    "steps_summary_adjusted": f"""WITH {WHOLE}, dy AS (SELECT recording, date_trunc('day', time) AS time, CASE WHEN count(v) * 60 > 1260 THEN sum(v) END AS v FROM im GROUP BY ALL),
        {cascade('dy', 'avg', DAYFILL, 'dd')},
        wk AS (SELECT recording, isodow(time) AS wd, avg(v) AS v FROM dd GROUP BY ALL),
        wd AS (SELECT recording, DATE '2024-01-01' + (wd - 1)::INT AS time, v FROM wk),
        a AS ({by_daytype('v', 'dy', 'round(sum({v}), 6) AS total_steps')}),
        b AS ({by_daytype('v', 'wd', 'round(avg({v}), 6) AS avg_steps, round(median({v}), 6) AS med_steps, round(min({v}), 6) AS min_steps, round(max({v}), 6) AS max_steps')})
        SELECT * FROM a JOIN b USING (recording, daytype)""",
    "walking_daily": f"WITH {HOURS} SELECT recording, strftime(date_trunc('day', time), '%Y-%m-%d %H:%M:%S') AS time, sum((s >= 100)::INT)::DOUBLE * 60 AS walk FROM ep GROUP BY recording, date_trunc('day', time)",
    "walking_summary": f"WITH {HOURS}, wd AS (SELECT recording, date_trunc('day', time) AS time, sum((s >= 100)::INT)::DOUBLE * 60 AS v FROM ep GROUP BY recording, date_trunc('day', time)) {by_daytype('v', 'wd', five('walk'))}",
    "short_epochs_zeroed": f"WITH {HOURS} SELECT recording, {T}, CASE WHEN s < 100 THEN 0 ELSE s END AS steps FROM ep",
    "hour_profile": f"WITH {HOURS}, {profile('ep', 's')} SELECT recording, daytype, hour::INTEGER AS hour, round(m, 6) AS steps FROM ev LEFT JOIN pr USING (recording, daytype, hour)",
    "percentile_times_daily": f"WITH {HOURS}, {SHARES} SELECT recording, {T}, p05_at, p25_at, p50_at, p75_at, p95_at FROM pt",
    "percentile_times_mean": f"""WITH {HOURS}, {SHARES} SELECT recording, """
    + ", ".join(f"strftime(TIMESTAMP '1970-01-01' + to_seconds(floor(avg(p{p:02}_at) FILTER (n * 60 > 1260))::BIGINT), '%H:%M:%S') AS steps{p}that" for p in (5, 25, 50, 75, 95))
    + " FROM pt GROUP BY recording",
    "cadence_daily": f"WITH {CADENCE} SELECT recording, {T}, round(peak1, 4) AS peak1, round(peak30, 4) AS peak30, round(p95, 4) AS p95 FROM cd",
    "cadence_summary": f"WITH {CADENCE} " + by_daytype("", "cd", ", ".join(f"round_even(median({m}), 0)::BIGINT AS {m}" for m in ("peak1", "peak30", "p95"))),
    "cadence_summary_adjusted": f"WITH {CADENCE}, "
    + ", ".join(f"{m}_ AS (SELECT recording, time, {m} AS v FROM cd), {cascade(m + '_', 'median', DAYFILL, m + 'f')}, {m}w AS (SELECT recording, DATE '2024-01-01' + (isodow(time) - 1)::INT AS time, median(v) AS {m} FROM {m}f GROUP BY ALL)" for m in ("peak1", "peak30", "p95"))
    + ", wk AS (SELECT * FROM peak1w JOIN peak30w USING (recording, time) JOIN p95w USING (recording, time)) "
    + by_daytype("", "wk", ", ".join(f"round_even(median({m}), 0)::BIGINT AS {m}" for m in ("peak1", "peak30", "p95"))),
    "bouts_summary": f"""WITH RECURSIVE {BOUTS}, x AS (
            SELECT bn.recording, bout::INTEGER AS bout, min(time) AS t0, max(time) AS t1, count(*) * 60.0::DOUBLE AS duration, sum(s) AS steps, stddev_samp(s / 60) AS cadence_sd,
                   quantile_cont(s / 60, 0.25) AS q1, quantile_cont(s / 60, 0.5) AS q2, quantile_cont(s / 60, 0.75) AS q3
            FROM bn JOIN w ON w.recording = bn.recording AND w.i BETWEEN a AND b GROUP BY ALL
        ) SELECT recording, bout, strftime(t0, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(t1, '%Y-%m-%d %H:%M:%S') AS end_time, duration,
                 epoch(t0 - lag(t1) OVER (PARTITION BY recording ORDER BY bout)) / 60 AS since_last, round(steps, 8) AS steps, round(steps / duration, 8) AS cadence, round(cadence_sd, 8) AS cadence_sd,
                 round(q1, 8) AS cadence_25, round(q2, 8) AS cadence_50, round(q3, 8) AS cadence_75 FROM x""",
    "bouts_enmo": f"""WITH RECURSIVE {BOUTS}, {SAMPLES},
        eh AS (SELECT recording, date_trunc('hour', time) AS time, avg(CASE WHEN ok THEN greatest(sqrt(x * x + y * y + 1) - 1, 0) * 1000 END) AS e FROM sa GROUP BY ALL),
        nr AS (
            SELECT w.recording, w.i, w.time, CASE WHEN c.time IS NOT NULL THEN c.e WHEN n.time IS NOT NULL THEN n.e ELSE p.e END AS e
            FROM w LEFT JOIN eh c ON c.recording = w.recording AND c.time = w.time
            LEFT JOIN eh n ON n.recording = w.recording AND n.time = w.time + INTERVAL 1 HOUR LEFT JOIN eh p ON p.recording = w.recording AND p.time = w.time - INTERVAL 1 HOUR
        ) SELECT bn.recording, bout::INTEGER AS bout, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS "StartTime", strftime(max(time), '%Y-%m-%d %H:%M:%S') AS "EndTime", round(avg(e), 4) AS enmo, round(median(e), 4) AS enmo_med
        FROM bn JOIN nr ON nr.recording = bn.recording AND nr.i BETWEEN a AND b GROUP BY bn.recording, bout""",
    "impute_missing_cascade": f"WITH {WHOLE} SELECT recording, {T}, round(v, 4) AS steps FROM im",
    "impute_missing_inside": f"WITH {HOURS}, f0 AS (SELECT recording, time, s AS v FROM ep), {cascade('f0', 'avg', FILL, 'f')} SELECT recording, {T}, round(v, 4) AS steps FROM f",
    "impute_days_mean": f"WITH {GATED}, {cascade('g', 'avg', DAYFILL, 'f')} SELECT recording, {T}, round(v, 4) AS steps FROM f",
    "impute_days_median": f"WITH {GATED}, {cascade('g', 'median', DAYFILL, 'f')} SELECT recording, {T}, round(v, 4) AS steps FROM f",
    "representative_week": f"WITH {GATED}, {cascade('g', 'avg', DAYFILL, 'f')} SELECT recording, (isodow(time) - 1)::INTEGER AS weekday, round(avg(v), 4) AS steps FROM f GROUP BY ALL",
    "infer_freq": """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events),
        q AS (SELECT user_id, quantile_cont(gap, 0.25) AS a, quantile_cont(gap, 0.75) AS b FROM g WHERE gap IS NOT NULL GROUP BY ALL)
        SELECT user_id, round(avg(gap), 3) AS dt FROM g JOIN q USING (user_id) WHERE gap BETWEEN a AND b GROUP BY ALL""",
    "sample_rate": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS us FROM events), g AS (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 1e6 AS gap FROM e),
        q AS (SELECT user_id, quantile_cont(gap, 0.25) AS a, quantile_cont(gap, 0.75) AS b FROM g WHERE gap IS NOT NULL GROUP BY ALL)
        SELECT user_id, round_even(1 / avg(gap), 0)::INTEGER AS rate FROM g JOIN q USING (user_id) WHERE gap BETWEEN a AND b GROUP BY ALL""",
    "wear_stats": f"""WITH {SAMPLES}, hh AS (SELECT recording, hour(time) AS h, avg(ok::INT) AS share FROM sa GROUP BY ALL), cv AS (SELECT recording, (count(*) = 24 AND min(share) >= 0.01)::INTEGER AS covers24h FROM hh GROUP BY ALL)
        SELECT recording, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS end_time, strftime(min(time) FILTER (x IS NOT NULL OR y IS NOT NULL AND ok), '%Y-%m-%d %H:%M:%S') AS wear_start,
               strftime(max(time) FILTER (ok), '%Y-%m-%d %H:%M:%S') AS wear_end, covers24h, round(count(*) FILTER (ok) * 60.0::DOUBLE / 86400, 6) AS wear_days, round(count(*) FILTER (NOT ok) * 60.0::DOUBLE / 86400, 6) AS nonwear_days
        FROM sa JOIN cv USING (recording) GROUP BY recording, covers24h""",
    "wear_daily": f"WITH {SAMPLES} SELECT recording, time::DATE::VARCHAR AS date, round_even(count(*) FILTER (ok) * 60.0::DOUBLE / 3600, 2) AS wear_hours FROM sa GROUP BY recording, time::DATE",
    "nothing_worn": "SELECT DISTINCT user_id AS recording FROM events WHERE user_id % 17 = 0",
    "flag_wear_below_days": f"WITH {HOURS} SELECT recording, {T}, CASE WHEN count(s) OVER (PARTITION BY recording, time::DATE) >= 22 THEN s END AS steps FROM ep",
    "drop_first_last_days": f"WITH {HOURS}, m AS (SELECT recording, min(time)::DATE AS a, max(time)::DATE AS b FROM ep GROUP BY ALL) SELECT recording, {T}, s AS steps FROM ep JOIN m USING (recording) WHERE time::DATE NOT IN (a, b)",
    "time_trim": f"WITH {HOURS} SELECT recording, {T}, s AS steps FROM ep WHERE time >= TIMESTAMP '2024-01-03 05:00:00' AND time < TIMESTAMP '2024-01-11 00:00:00'",
    "dedup_keep_first": f"WITH e AS (SELECT event_type AS recording, date_trunc('minute', ts) AS time, event_id, value, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY event_id) AS n FROM events) SELECT recording, {T}, event_id, value FROM e WHERE n = 1",
    "windows_origin_start": """WITH o AS (SELECT event_type AS recording, min(ts) AS o, max(ts) AS l FROM events GROUP BY ALL),
        b AS (SELECT event_type AS recording, time_bucket(INTERVAL 2 HOUR, ts, o) AS w, count(*) AS n, sum(value) AS v FROM events JOIN o ON o.recording = event_type GROUP BY ALL),
        s AS (SELECT recording, unnest(generate_series(o, l, INTERVAL 2 HOUR)) AS w FROM o)
        SELECT s.recording, strftime(s.w, '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(n, 0) AS n, round(v, 2) AS total FROM s LEFT JOIN b ON b.recording = s.recording AND b.w = s.w""",
    "window_length_policy": f"""WITH {VEC}, c AS (SELECT vec_id, v[1:1 + vec_id % 64] AS v FROM e), w AS (
            SELECT vec_id, len(v)::INTEGER AS n, CASE WHEN len(v) >= 40 THEN v[1:40] WHEN len(v) > 20 THEN list_concat(v, v)[1:40] END AS w FROM c
        ) SELECT vec_id, n, len(w)::INTEGER AS length, round(w[40], 6) AS last, round(list_sum(w), 4) AS total FROM w""",
    "windows_by_count": """WITH e AS (SELECT event_type AS recording, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM events),
        k AS (SELECT recording, unnest(range(0, (max(i) + 1 - 50) // 30 + 1)) AS k FROM e GROUP BY recording HAVING max(i) >= 49)
        SELECT k.recording, k AS "window", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, round(sum(value), 2) AS total
        FROM k JOIN e ON e.recording = k.recording AND i BETWEEN k * 30 AND k * 30 + 49 GROUP BY k.recording, k""",
    "windows_training": """WITH o AS (SELECT event_type AS pid, date_trunc('day', min(ts)) AS o FROM events GROUP BY ALL),
        b AS (SELECT pid, time_bucket(INTERVAL 2 HOUR, ts, o) AS w, count(*) AS n, sum((user_id % 7 = 0)::INT)::BIGINT AS s FROM events JOIN o ON pid = event_type GROUP BY ALL HAVING count(*) >= 4)
        SELECT pid, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n, CASE WHEN s >= 2 THEN s ELSE 0 END AS steps, (s >= 2)::INTEGER AS walk FROM b""",
    "asof_nearest_tolerance": """WITH e AS (SELECT event_type AS recording, ts, event_id FROM events), m AS (SELECT recording, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM e GROUP BY ALL),
        g AS (SELECT recording, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM m),
        p AS (SELECT g.recording, g.time, e.ts AS pt, e.event_id AS pe FROM g ASOF LEFT JOIN e ON g.recording = e.recording AND g.time >= e.ts),
        n AS (SELECT g.recording, g.time, e.ts AS nt, e.event_id AS ne FROM g ASOF LEFT JOIN e ON g.recording = e.recording AND g.time <= e.ts),
        x AS (SELECT p.recording, p.time, pe, ne, epoch_us(p.time) - epoch_us(pt) AS back, epoch_us(nt) - epoch_us(p.time) AS ahead FROM p JOIN n ON p.recording = n.recording AND p.time = n.time)
        SELECT recording, """ + T + """, CASE WHEN least(coalesce(back, 9e18), coalesce(ahead, 9e18)) <= 6e8 THEN CASE WHEN coalesce(ahead, 9e18) <= coalesce(back, 9e18) THEN ne ELSE pe END END AS event_id FROM x""",
    "grain_outer_join": f"""WITH {DAYS}, {SAMPLES}, wr AS (SELECT recording, date_trunc('day', time) AS time, round_even(count(*) FILTER (ok) * 60.0::DOUBLE / 3600, 2) AS h FROM sa GROUP BY recording, date_trunc('day', time)),
        a AS (SELECT * FROM dy WHERE day(time) > 3), b AS (SELECT * FROM wr WHERE day(time) < 20)
        SELECT coalesce(a.recording, b.recording) AS recording, strftime(coalesce(a.time, b.time), '%Y-%m-%d %H:%M:%S') AS time, round(v, 4) AS steps, h AS wear_hours FROM a FULL JOIN b ON a.recording = b.recording AND a.time = b.time""",
    "enmo_vector": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN round(greatest(sqrt(l_quantity / 25 * (l_quantity / 25) + l_discount * l_discount + l_tax * l_tax) - 1, 0) * 1000, 3) END AS enmo FROM lineitem",
    "enmo_daily": f"WITH {ENMO_MIN} SELECT recording, {T}, round(e, 4) AS enmo FROM df",
    "enmo_hour_profile": f"WITH {ENMO_MIN}, {profile('hf', 'e')} SELECT recording, daytype, hour::INTEGER AS hour, round(m, 4) AS enmo FROM ev LEFT JOIN pr USING (recording, daytype, hour)",
    "enmo_averages": f"WITH {ENMO_MIN} {by_daytype('e', 'df', 'round(avg({v}), 4) AS avg_enmo')}",
    "enmo_adjusted_daily": f"""WITH {SAMPLES}, mm AS (SELECT recording, date_trunc('minute', time) AS time, avg(CASE WHEN ok THEN greatest(sqrt(x * x + y * y + 1) - 1, 0) * 1000 END) AS v FROM sa GROUP BY ALL),
        gr AS (SELECT recording, unnest(generate_series(date_trunc('day', min(time)), date_trunc('day', max(time)) + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) AS time, min(time) AS a, max(time) AS b FROM mm GROUP BY recording),
        f0 AS (
            SELECT g.recording, g.time, coalesce(m.v, CASE WHEN g.time = a - INTERVAL 1 MINUTE THEN (SELECT v FROM mm WHERE mm.recording = g.recording AND mm.time = a) WHEN g.time = b + INTERVAL 1 MINUTE THEN (SELECT v FROM mm WHERE mm.recording = g.recording AND mm.time = b) END) AS v
            FROM gr g LEFT JOIN mm m ON m.recording = g.recording AND m.time = g.time
        ), em AS (SELECT recording, time::DATE AS d FROM mm GROUP BY ALL HAVING count(v) = 0),
        {cascade('f0', 'avg', FILL, 'f')}, im AS (SELECT f.recording, f.time, CASE WHEN em.d IS NULL THEN v END AS v FROM f LEFT JOIN em ON f.recording = em.recording AND f.time::DATE = em.d)
        SELECT recording, strftime(date_trunc('day', time), '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN count(v) > 600 THEN round(avg(v), 3) END AS enmo FROM im GROUP BY recording, date_trunc('day', time)""",
    "feature_moments": f"""WITH {VEC}, x AS (SELECT vec_id, unnest(v) AS x FROM e), m AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY ALL)
        SELECT vec_id, round(m, 4) AS avg, round(s, 4) AS std, round(CASE WHEN s <= 0.01 THEN 0 ELSE avg(pow((x - m) / s, 3)) END, 4) AS skew, round(CASE WHEN s <= 0.01 THEN 0 ELSE avg(pow((x - m) / s, 4)) - 3 END, 4) AS kurt FROM x JOIN m USING (vec_id) GROUP BY vec_id, m, s""",
    "feature_quantiles": f"WITH {VEC}, x AS (SELECT vec_id, unnest(v) AS x FROM e) SELECT vec_id, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS med, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM x GROUP BY vec_id",
    "windows_resized": f"""WITH {VEC} SELECT vec_id, 20 AS n, round(v[1], 4) AS first, round(v[24] + (7 * 63 / 19.0::DOUBLE - 23) * (v[25] - v[24]), 4) AS eighth, round(v[64], 4) AS last FROM e""",
    "hmm_transition": """WITH n AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), c AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY ALL),
        l AS (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL), s AS (SELECT a, sum(n) AS t FROM c GROUP BY ALL)
        SELECT x.role AS from_label, y.role AS to_label, round(coalesce(c.n, 0)::DOUBLE / t::DOUBLE, 6) AS p FROM l x CROSS JOIN l y LEFT JOIN s ON s.a = x.role LEFT JOIN c ON c.a = x.role AND c.b = y.role""",
    "hmm_emission": "WITH l AS (SELECT DISTINCT quality AS q FROM labels) SELECT x.q AS label, y.q AS predicted, round(avg((toxic = y.q)::INT), 6) AS p FROM l x CROSS JOIN l y JOIN labels ON quality = x.q GROUP BY ALL",
    "hmm_prior": "SELECT quality AS label, round(count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE, 6) AS p FROM labels GROUP BY quality",
    "group_lengths": "SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY source",
    "viterbi_smooth": """WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id, (doc_id % 7)::INTEGER AS g, toxic::INTEGER AS o, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY doc_id % 7) AS n FROM labels),
        em AS MATERIALIZED (SELECT * FROM (VALUES (0, ln(0.8::DOUBLE + 1e-16), ln(0.3::DOUBLE + 1e-16)), (1, ln(0.2::DOUBLE + 1e-16), ln(0.7::DOUBLE + 1e-16))) t(o, e0, e1)),
        f AS (
            SELECT g, i, ln(0.5::DOUBLE + 1e-16) + e0 AS s0, ln(0.5::DOUBLE + 1e-16) + e1 AS s1, 0 AS b0, 0 AS b1 FROM k JOIN em USING (o) WHERE i = 1
            UNION ALL
            SELECT k.g, k.i, greatest(s0 + ln(0.9::DOUBLE), s1 + ln(0.2::DOUBLE)) + e0, greatest(s0 + ln(0.1::DOUBLE), s1 + ln(0.8::DOUBLE)) + e1,
                   (s1 + ln(0.2::DOUBLE) > s0 + ln(0.9::DOUBLE))::INT, (s1 + ln(0.8::DOUBLE) > s0 + ln(0.1::DOUBLE))::INT
            FROM f JOIN k ON k.g = f.g AND k.i = f.i + 1 JOIN em USING (o)
        ), ff AS MATERIALIZED (SELECT * FROM f), b AS (
            SELECT ff.g, ff.i, (s1 > s0)::INT AS st FROM ff JOIN k ON k.g = ff.g AND k.i = ff.i WHERE k.i = k.n
            UNION ALL
            SELECT b.g, b.i - 1, CASE WHEN st = 0 THEN b0 ELSE b1 END FROM b JOIN ff ON ff.g = b.g AND ff.i = b.i WHERE b.i > 1
        ) SELECT doc_id, k.g, o AS toxic, st AS smoothed FROM k JOIN b ON b.g = k.g AND b.i = k.i""",
    "sample_weight": f"WITH {LABELS}, n AS (SELECT count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 0) AS b FROM sc) SELECT doc_id, t, round(CASE WHEN t = 0 THEN a::DOUBLE / nullif(2 * b, 0) ELSE 1 END, 6) AS weight FROM sc, n",
    "weighted_metrics": f"WITH {LABELS}, n AS (SELECT count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 0) AS b FROM sc), x AS (SELECT fold, {CELLS.format(w='CASE WHEN t = 0 THEN a::DOUBLE / nullif(b, 0) ELSE 1 END')} FROM sc, n GROUP BY fold), m AS (SELECT fold, {METRICS} FROM x) SELECT fold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(balanced_accuracy, 6) AS balanced_accuracy FROM m",
    "regression_metrics": f"""WITH {LABELS}, c AS (SELECT fold, (doc_id % 4 * t)::DOUBLE AS t, (doc_id % 3)::DOUBLE AS p, (1 + doc_id % 2)::DOUBLE AS w FROM sc)
        SELECT fold, round(sum(w * abs(t - p)) / sum(w), 6) AS mae, round(sqrt(sum(w * pow(t - p, 2)) / sum(w)), 6) AS rmse, round(sum(w * CASE WHEN t = 0 THEN abs(t - p) ELSE abs(t - p) / abs(t) END) / sum(w), 6) AS mape FROM c GROUP BY fold""",
    "fold_summary": f"""WITH {LABELS}, x AS (SELECT fold, {CELLS.format(w='1')} FROM sc GROUP BY fold), m AS (SELECT fold, {METRICS} FROM x),
        u AS (UNPIVOT m ON accuracy, f1, precision, recall, balanced_accuracy INTO NAME metric VALUE v)
        SELECT metric, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS med, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM u GROUP BY metric""",
    "class_report": f"""WITH {LABELS}, c AS (SELECT DISTINCT t AS class FROM sc UNION SELECT DISTINCT p FROM sc), x AS (SELECT class, count(*) FILTER (t = class AND p = class)::DOUBLE AS hit, count(*) FILTER (t = class)::DOUBLE AS support, count(*) FILTER (p = class)::DOUBLE AS said FROM c, sc GROUP BY class)
        SELECT class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1, support FROM x""",
    "calibrate_threshold": f"""WITH {LABELS}, b AS (SELECT score AS th, count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 0) AS b FROM sc GROUP BY score),
        r AS (SELECT th, sum(a) OVER (ORDER BY th DESC)::DOUBLE AS tp, sum(b) OVER (ORDER BY th DESC)::DOUBLE AS fp, sum(a) OVER ()::DOUBLE AS pos, sum(b) OVER ()::DOUBLE AS neg FROM b),
        c AS (SELECT th AS thresh, tp / (tp + fp) AS precision, tp / pos AS recall, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1, tp / pos AS tpr, fp / neg AS fpr, (tp / pos + 1 - fp / neg) / 2 AS balanced_accuracy FROM r),
        o AS (
            (SELECT 'balanced_accuracy' AS goal, * FROM c ORDER BY round(balanced_accuracy, 12) DESC, thresh DESC LIMIT 1) UNION ALL (SELECT 'f1', * FROM c ORDER BY round(f1, 12) DESC, thresh LIMIT 1)
            UNION ALL (SELECT 'precision', * FROM c ORDER BY precision > 0.62 DESC, thresh LIMIT 1) UNION ALL (SELECT 'recall', * FROM c ORDER BY recall > 0.8 DESC, thresh LIMIT 1)
        ) SELECT goal, round(thresh, 6) AS thresh, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(balanced_accuracy, 6) AS balanced_accuracy FROM o""",
    "groupkfold": """WITH g AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source) SELECT source, (ntile(6) OVER (ORDER BY f) - 1)::INTEGER AS fold FROM g""",
    "class_weights": f"WITH {LABELS} SELECT round(count(*) FILTER (t = 1) * 9.0::DOUBLE / count(*) FILTER (t = 0), 6) AS notwalk, 1.0::DOUBLE AS walk FROM sc",
    "plot_data": f"WITH {MINUTES} SELECT recording, time::DATE::VARCHAR AS day, {T}, s AS steps, s IS NULL AS missing FROM ep",
    "info_pivot": f"""WITH {DAYS}, a AS ({by_daytype('v', 'dy', 'sum({v}) AS t, avg({v}) AS a, median({v}) AS m, min({v}) AS n, max({v}) AS x')})
        SELECT recording, """
    + ", ".join(
        f"max(round_even({c}, 0)::BIGINT::VARCHAR) FILTER (daytype = '{k}') AS {n}{s}"
        for c, n in (("t", "totalsteps"), ("a", "stepsdayavg"), ("m", "stepsdaymed"), ("n", "stepsdaymin"), ("x", "stepsdaymax"))
        for k, s in (("overall", ""), ("weekend", "_weekend"), ("weekday", "_weekday"))
    )
    + " FROM a GROUP BY recording",
    "labels_encoded": "WITH l AS (SELECT list_sort(list(DISTINCT role)) AS l FROM conversations) SELECT conv_id, turn, role, (list_position(l, role) - 1)::INTEGER AS code, role AS again FROM conversations, l",
    "ordered_distinct": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source",
    "example_windows": """WITH o AS (SELECT event_type AS pid, date_trunc('day', min(ts)) AS o FROM events GROUP BY ALL),
        b AS (SELECT pid, time_bucket(INTERVAL 2 HOUR, ts, o) AS w, count(*) AS n, (sum((user_id % 7 = 0)::INT) >= 2)::INTEGER AS walk FROM events JOIN o ON pid = event_type GROUP BY ALL HAVING count(*) >= 4)
        SELECT pid, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n, walk FROM b QUALIFY row_number() OVER (PARTITION BY walk ORDER BY pid, w) <= CASE WHEN walk = 1 THEN 10 ELSE 5 END""",
    "windows_mapped": """WITH o AS (SELECT event_type AS recording, min(ts) AS o FROM events GROUP BY ALL)
        SELECT recording, strftime(time_bucket(INTERVAL 1 DAY, ts, o), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(max(value) - min(value), 2) AS spread FROM events JOIN o ON recording = event_type GROUP BY recording, time_bucket(INTERVAL 1 DAY, ts, o)""",
}
