"""The queries over the driver's tables once more, as SQL: written on its own, to be run by another engine."""

from __future__ import annotations

METRICS = "('click'), ('error'), ('purchase'), ('signup'), ('view')"


def _health(width: int = 3600, gap_s: int = 1500) -> str:
    """Events, counts and health rows."""
    return f"""
ev AS (
  SELECT 'w' || CAST((epoch_us(ts) // 1000000 - 345600) // 604800 * 604800 + 345600 AS VARCHAR) AS run_id, epoch_us(ts) AS us, event_type AS metric, user_id AS actor,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, event_id FROM events
), bkt AS (
  SELECT run_id, us // 1000000 // {width} * {width} AS bucket_start, metric, count(*) AS count FROM ev GROUP BY ALL
), seen AS (
  SELECT run_id, us // 1000000 // {width} * {width} AS bucket_start, count(*) AS events_seen, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY ALL
), gaps AS (
  SELECT * FROM (SELECT run_id, lag(us) OVER (PARTITION BY run_id ORDER BY us) AS a, us AS b FROM ev) WHERE b - a > {gap_s} * 1000000::BIGINT
), touched AS (
  SELECT run_id, a, b, unnest(generate_series(a // 1000000 // {width} * {width}, (b - 1) // 1000000 // {width} * {width}, {width})) AS bucket_start FROM gaps
), part AS (
  SELECT run_id, bucket_start, sum(least(b, (bucket_start + {width}) * 1000000) - greatest(a, bucket_start * 1000000)) AS gap_us FROM touched GROUP BY ALL
), h0 AS (
  SELECT seen.*, CAST(coalesce(gap_us, 0) AS BIGINT) AS gap_us, row_number() OVER (PARTITION BY run_id ORDER BY bucket_start) AS i, count(*) OVER (PARTITION BY run_id) AS k
  FROM seen LEFT JOIN part USING (run_id, bucket_start)
), h1 AS (
  SELECT *, greatest(0, CASE WHEN i = k THEN last_us ELSE (bucket_start + {width}) * 1000000 END - CASE WHEN i = 1 THEN first_us ELSE bucket_start * 1000000 END - gap_us) AS observed_duration_us FROM h0
), h2 AS (
  SELECT *, observed_duration_us < {width} * 1000000::BIGINT AS partial, CASE WHEN i <= 3 THEN 'warming_up' WHEN gap_us > 0 THEN 'degraded' ELSE 'ok' END AS coverage_state,
         CASE WHEN gap_us > 0 THEN 'gap_observed' ELSE '' END AS reasons FROM h1
), health AS (
  SELECT *, array_to_string(list_sort(list_filter([CASE WHEN partial THEN 'partial' END, CASE WHEN gap_us > 0 THEN 'seam' END, CASE WHEN gap_us > 0 THEN 'gap' END,
      CASE WHEN coverage_state = 'degraded' THEN 'degraded' END, CASE WHEN coverage_state = 'warming_up' THEN 'warming_up' END], lambda x: x IS NOT NULL)), ',') AS flags,
    CASE WHEN gap_us > 0 THEN 'gap' WHEN partial THEN 'partial' WHEN coverage_state = 'warming_up' THEN 'warming_up' ELSE 'clean' END AS quality,
    NOT (partial OR gap_us > 0 OR coverage_state <> 'ok') AS eligible FROM h2
)"""


def _points(width: int = 3600, gap_s: int = 1500, metrics: str = METRICS) -> str:
    return f"""{_health(width, gap_s)}, grid AS (
  SELECT bucket_start, metric FROM (SELECT unnest(generate_series(lo, hi, {width})) AS bucket_start FROM (SELECT min(bucket_start) AS lo, max(bucket_start) AS hi FROM health)), (VALUES {metrics}) m(metric)
), pts AS (
  SELECT g.metric, g.bucket_start, CASE WHEN h.run_id IS NOT NULL THEN coalesce(b.count, 0) END AS count, h.events_seen, coalesce(h.observed_duration_us, 0) AS observed_duration_us,
         coalesce(h.flags, 'unobserved') AS flags, coalesce(h.quality, 'unobserved') AS quality, coalesce(h.eligible, false) AS eligible,
         CASE WHEN h.observed_duration_us > 0 THEN coalesce(b.count, 0) / (h.observed_duration_us / 1e6) END AS rate
  FROM grid g LEFT JOIN health h USING (bucket_start) LEFT JOIN bkt b ON b.run_id = h.run_id AND b.bucket_start = g.bucket_start AND b.metric = g.metric
)"""


def _deps(robust: bool = False) -> str:
    mean = "list_aggregate(hist, 'median')" if robust else "list_aggregate(hist, 'avg')"
    mad = "list_aggregate(list_transform(hist, lambda x: abs(x - list_aggregate(hist, 'median'))), 'median')"
    std = f"CASE WHEN {mad} > 0 THEN {mad} * 1.4826 ELSE list_aggregate(hist, 'stddev_samp') END" if robust else "list_aggregate(hist, 'stddev_samp')"
    return f"""{_points()}, taught AS (
  SELECT metric, bucket_start, list(rate) OVER (PARTITION BY metric ORDER BY bucket_start ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS own FROM pts WHERE eligible AND rate IS NOT NULL
), held AS (
  SELECT p.*, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY metric ORDER BY bucket_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS hist FROM pts p LEFT JOIN taught USING (metric, bucket_start)
), based AS (
  SELECT *, len(hist) AS baseline_n, CASE WHEN len(hist) >= 5 THEN {mean} END AS baseline_mean, CASE WHEN len(hist) >= 5 THEN {std} END AS baseline_std FROM held
), deps0 AS (
  SELECT *, rate AS value, CASE WHEN baseline_std <> 0 THEN (rate - baseline_mean) / baseline_std END AS z, CASE WHEN baseline_mean <> 0 THEN (rate - baseline_mean) / baseline_mean END AS pct_change FROM based
), deps AS (
  SELECT *, CASE WHEN z IS NULL THEN 'unknown' WHEN abs(pct_change) < 0.15 THEN 'normal' WHEN z >= 3 THEN 'surging' WHEN z >= 1.5 THEN 'elevated' WHEN z <= -3 THEN 'degrading' WHEN z <= -1.5 THEN 'quiet' ELSE 'normal' END AS condition FROM deps0
)"""


def _episodes() -> str:
    return f"""{_deps(True)}, num AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket_start) AS i FROM deps
), sgn AS (
  SELECT num.*, s.sign, s.sign * z AS sz FROM num, (VALUES (1), (-1)) s(sign)
), hold AS (
  SELECT metric, sign, i, sz, sum(br) OVER (PARTITION BY metric, sign ORDER BY i) AS island
  FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY metric, sign ORDER BY i) <= 3 THEN 0 ELSE 1 END AS br FROM sgn WHERE eligible AND sz >= 1)
), isl AS (
  SELECT metric, sign, island, min(i) FILTER (WHERE sz >= 2) AS a, max(i) AS b FROM hold GROUP BY ALL HAVING min(i) FILTER (WHERE sz >= 2) IS NOT NULL
), seg AS (
  SELECT isl.metric, isl.sign, island, a, coalesce(max(s.i), b) AS b FROM isl LEFT JOIN sgn s ON s.metric = isl.metric AND s.sign = isl.sign AND s.i BETWEEN isl.b + 1 AND isl.b + 2 AND s.sz >= 1 GROUP BY isl.metric, isl.sign, island, a, isl.b
), inside AS (
  SELECT s.*, island, count(s.sz) OVER (PARTITION BY s.metric, s.sign, island ORDER BY s.i) AS place FROM seg JOIN sgn s ON s.metric = seg.metric AND s.sign = seg.sign AND s.i BETWEEN seg.a AND seg.b
), agg AS (
  SELECT metric, sign, island, min(bucket_start) AS start_s, max(bucket_start) + 3600 AS end_s, count(*) AS n_windows, CAST(sum(count) AS BIGINT) AS events, max(sz) AS peak_z, avg(sz) AS mean_z,
         CASE WHEN any_value(sign) > 0 THEN max(value) ELSE min(value) END AS extreme_rate, avg(baseline_mean) AS baseline_rate, arg_min(place, struct_pack(v := -sz, p := place)) FILTER (WHERE sz IS NOT NULL) AS best, count(sz) AS n_z
  FROM inside GROUP BY metric, sign, island HAVING count(*) >= 2 AND max(sz) >= 2
), eps0 AS (
  SELECT *, CASE WHEN extreme_rate IS NULL OR coalesce(baseline_rate, 0) = 0 THEN 1.0 WHEN sign > 0 THEN extreme_rate / baseline_rate WHEN extreme_rate > 0 THEN baseline_rate / extreme_rate ELSE greatest(baseline_rate * 60, 2.0) END AS ratio FROM agg
), eps AS (
  SELECT *, CASE WHEN sign > 0 THEN 'rate_burst' ELSE 'rate_lull' END AS type, CASE WHEN sign > 0 THEN 'excess' ELSE 'deficit' END AS direction, CASE WHEN ratio <= 0 THEN 0.0 ELSE round(log2(greatest(ratio, 1.0)), 6) END AS score FROM eps0
)"""


_SUM = lambda *cols: "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ")"


def _field() -> str:
    inter, made = _SUM("r_click", "r_purchase", "r_signup"), _SUM("r_view", "r_click", "r_purchase")
    return f"""{_points()}, wide AS (
  SELECT bucket_start, bool_and(count IS NOT NULL) AS observed, bool_and(eligible) AS eligible, max(rate) FILTER (WHERE metric = 'click') AS r_click, max(rate) FILTER (WHERE metric = 'error') AS r_error,
         max(rate) FILTER (WHERE metric = 'purchase') AS r_purchase, max(rate) FILTER (WHERE metric = 'signup') AS r_signup, max(rate) FILTER (WHERE metric = 'view') AS r_view FROM pts GROUP BY bucket_start
), plain AS (
  SELECT *, r_view AS emission_velocity, CASE WHEN coalesce(r_click, r_purchase, r_signup) IS NOT NULL THEN {inter} END AS interaction_velocity, CASE WHEN r_view > 0 THEN {inter} / r_view END AS interaction_pressure,
         CASE WHEN {inter} > 0 THEN r_click / {inter} END AS reply_share, CASE WHEN coalesce(r_signup, r_error) IS NOT NULL THEN {_SUM("r_signup", "r_error")} END AS graph_velocity,
         CASE WHEN {_SUM("r_signup", "r_error")} > 0 THEN r_error / {_SUM("r_signup", "r_error")} END AS boundary_share, CASE WHEN r_error + {made} > 0 THEN r_error / (r_error + {made}) END AS withdrawal_share FROM wide
), own AS (
  SELECT bucket_start, list(interaction_velocity) OVER (ORDER BY bucket_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS own FROM plain WHERE eligible AND interaction_velocity IS NOT NULL
), hist AS (
  SELECT p.*, last_value(own IGNORE NULLS) OVER (ORDER BY bucket_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM plain p LEFT JOIN own USING (bucket_start)
), field AS (
  SELECT *, CASE WHEN observed AND list_aggregate(hist, 'avg') > 0 THEN list_aggregate(hist, 'stddev_samp') / list_aggregate(hist, 'avg') END AS turbulence,
         CASE WHEN observed THEN interaction_velocity - hist[-1] END AS acceleration FROM hist
), lng AS (
  SELECT bucket_start, quantity, value, CAST(bucket_start // 3600 % 24 AS INTEGER) AS hour, bucket_start // 86400 AS day FROM (
    UNPIVOT (SELECT bucket_start, emission_velocity, interaction_velocity, interaction_pressure, reply_share, graph_velocity, boundary_share, withdrawal_share, turbulence, acceleration FROM field WHERE eligible)
    ON emission_velocity, interaction_velocity, interaction_pressure, reply_share, graph_velocity, boundary_share, withdrawal_share, turbulence, acceleration INTO NAME quantity VALUE value)
), eligible_days AS (
  SELECT bucket_start // 3600 % 24 AS hour, count(DISTINCT bucket_start // 86400) AS n_days FROM field WHERE eligible GROUP BY ALL
), names AS (
  SELECT unnest(['emission_velocity', 'interaction_velocity', 'interaction_pressure', 'reply_share', 'graph_velocity', 'boundary_share', 'withdrawal_share', 'turbulence', 'acceleration']) AS quantity
), cells AS (
  SELECT n.quantity, CAST(e.hour AS INTEGER) AS hour, count(l.value) AS n, e.n_days, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
  FROM names n CROSS JOIN eligible_days e LEFT JOIN lng l ON l.quantity = n.quantity AND l.hour = e.hour GROUP BY n.quantity, e.hour, e.n_days
), resid AS (
  SELECT l.*, value - p50 AS residual FROM lng l JOIN cells c USING (quantity, hour)
), pairs AS (
  SELECT *, value - avg(value) OVER (PARTITION BY quantity) AS d, residual - avg(residual) OVER (PARTITION BY quantity) AS e FROM resid
), nexts AS (
  SELECT *, lead(d) OVER (PARTITION BY quantity ORDER BY bucket_start) AS d1, lead(e) OVER (PARTITION BY quantity ORDER BY bucket_start) AS e1 FROM pairs
), dist0 AS (
  SELECT quantity, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, min(value) AS minimum, max(value) AS maximum,
         CASE WHEN count(*) >= 3 AND sum(d * d) > 0 THEN sum(d * d1) / sum(d * d) END AS lag1_r, CASE WHEN count(*) >= 3 AND sum(e * e) > 0 THEN sum(e * e1) / sum(e * e) END AS residual_r FROM nexts GROUP BY quantity
), dist1 AS (
  SELECT *, greatest(1.0, least(CAST(n AS DOUBLE), n * (1 - least(greatest(lag1_r, -0.999), 0.999)) / (1 + least(greatest(lag1_r, -0.999), 0.999)))) AS n_eff, (SELECT count(DISTINCT bucket_start // 86400) FROM field WHERE eligible) AS n_days FROM dist0
), dist AS (
  SELECT *, CASE WHEN n_days >= 20 AND n_eff >= 100 THEN 'supported' WHEN n_days >= 7 AND n_eff >= 30 THEN 'thin' ELSE 'unsupported' END AS support FROM dist1
), cand AS (
  SELECT * FROM (SELECT l.bucket_start, l.quantity, l.value, CASE WHEN value > c.p95 + 0.05 * (c.p95 - c.p05) THEN 'above' WHEN value < c.p05 - 0.05 * (c.p95 - c.p05) THEN 'below' END AS direction
    FROM lng l JOIN cells c USING (quantity, hour) JOIN dist d USING (quantity) WHERE d.support <> 'unsupported' AND c.p95 - c.p05 > 0.01 * greatest(abs(c.p50), 1e-9)) WHERE direction IS NOT NULL
), put AS (
  SELECT f.*, i.p50, i.p75, i.p95, t.p95 AS tp95, coalesce(interaction_velocity > i.p75, false) AS elevated, row_number() OVER (ORDER BY bucket_start) AS i
  FROM field f LEFT JOIN cells i ON i.quantity = 'interaction_velocity' AND i.hour = bucket_start // 3600 % 24 LEFT JOIN cells t ON t.quantity = 'turbulence' AND t.hour = bucket_start // 3600 % 24
), placed AS (
  SELECT *, i - coalesce(max(CASE WHEN NOT elevated THEN i END) OVER (ORDER BY bucket_start), 0) AS runs FROM put
)"""


def _conditions(offsets: str) -> str:
    return f"""WITH {_field()}, asked AS (
  SELECT (SELECT max(bucket_start) + 3600 FROM field) - o * 3600 AS at_s FROM (SELECT unnest([{offsets}]) AS o)
), last AS (
  SELECT at_s, max(bucket_start) FILTER (WHERE eligible) AS known, arg_max(runs, bucket_start) AS runs FROM asked LEFT JOIN placed ON bucket_start + 3600 <= at_s GROUP BY at_s
), w AS (
  SELECT l.at_s, l.runs, p.*  EXCLUDE (runs), coalesce((SELECT support FROM dist WHERE quantity = 'interaction_velocity'), 'unsupported') AS support,
    coalesce(p.turbulence > p.tp95, false) AND coalesce((SELECT support FROM dist WHERE quantity = 'turbulence'), 'unsupported') <> 'unsupported' AS high
  FROM last l LEFT JOIN placed p ON p.bucket_start = l.known
)
SELECT at_s, bucket_start, round(interaction_velocity / p50, 6) AS ratio, CAST(runs AS INTEGER) AS runs, support,
  CASE WHEN bucket_start IS NULL OR (at_s - bucket_start - 3600) / 3600.0 > 15 THEN 'station_offline' WHEN interaction_velocity IS NULL OR p95 IS NULL OR support = 'unsupported' THEN 'unavailable'
    WHEN interaction_velocity > p95 AND interaction_velocity / p50 >= 3 AND runs >= 3 THEN 'severe' WHEN interaction_velocity > p95 AND runs >= 2 THEN 'storm' WHEN (interaction_velocity > p75 OR high) AND runs >= 2 THEN 'turbulent'
    WHEN high OR interaction_velocity > p95 THEN 'unsettled' WHEN interaction_velocity > p75 THEN 'active' ELSE 'calm' END AS state FROM w"""


_RATIOS = """rat AS (
  SELECT r.ratio, a.bucket_start, a.count AS numerator, b.count AS denominator, CASE WHEN b.count <> 0 THEN a.count / CAST(b.count AS DOUBLE) END AS value, a.count IS NOT NULL AND b.count IS NOT NULL AS observed,
         CASE WHEN a.count IS NULL OR b.count IS NULL THEN 'unobserved' WHEN a.quality <> 'clean' THEN a.quality ELSE b.quality END AS quality
  FROM (VALUES ('click/view', 'click', 'view'), ('purchase/click', 'purchase', 'click'), ('signup/view', 'signup', 'view'), ('error/view', 'error', 'view')) r(ratio, n, d)
  JOIN pts a ON a.metric = r.n JOIN pts b ON b.metric = r.d AND b.bucket_start = a.bucket_start
)"""

_SETS = """sets0 AS (SELECT DISTINCT actor, CAST(target AS VARCHAR) AS target FROM ev WHERE metric = 'view' AND target IS NOT NULL),
sets AS (SELECT *, count(*) OVER (PARTITION BY actor) AS size FROM sets0 QUALIFY count(*) OVER (PARTITION BY actor) >= 3),
sim AS (SELECT a.actor AS a, b.actor AS b, count(*) / CAST(a.size + b.size - count(*) AS DOUBLE) AS jaccard FROM sets a JOIN sets b ON a.target = b.target AND a.actor < b.actor GROUP BY a.actor, b.actor, a.size, b.size
  HAVING count(*) / CAST(a.size + b.size - count(*) AS DOUBLE) >= 0.2)"""

_FACTS = """l AS (SELECT (epoch_us(o_orderdate) // 1000000 - 345600) // 604800 * 604800 + 345600 AS start_s, count(*) AS value FROM orders GROUP BY ALL),
left_facts AS (SELECT start_s, start_s + 604800 AS end_s, start_s // 604800 % 5 = 0 AS weak, CAST(value AS DOUBLE) AS value FROM l),
r AS (SELECT (epoch_us(l_shipdate) // 1000000 - 345600) // 604800 * 604800 + 345600 AS start_s, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"""

_REDUCE = """
WITH o AS (
  SELECT o_orderkey AS seq, o_custkey AS e, (epoch_us(o_orderdate) // 1000000 - 345600) // 604800 * 604800 + 345600 AS start_s, o_orderpriority AS state, lag(o_orderpriority) OVER w AS prior, row_number() OVER w AS place,
         CASE WHEN row_number() OVER w = 1 THEN 'create' WHEN o_orderstatus = 'P' THEN 'tombstone' ELSE 'update' END AS kind FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), c AS (
  SELECT start_s, count(*) AS operations, count(*) FILTER (WHERE kind = 'create') AS creations, count(*) FILTER (WHERE kind = 'tombstone') AS tombstones, count(*) FILTER (WHERE kind = 'update' AND place > 1 AND state <> prior) AS endpoint_mutations,
         count(*) FILTER (WHERE kind = 'update' AND place > 1 AND state <> prior AND state NOT LIKE '5%' AND prior NOT LIKE '5%') AS migration_like_transitions, count(*) FILTER (WHERE kind = 'update') AS u, count(*) FILTER (WHERE kind = 'update' AND place > 1) AS cmp
  FROM o GROUP BY start_s ORDER BY start_s DESC LIMIT 104
), f AS (
  SELECT * FROM (UNPIVOT (SELECT start_s, u, cmp, operations, creations, tombstones, endpoint_mutations, migration_like_transitions FROM c) ON operations, creations, tombstones, endpoint_mutations, migration_like_transitions INTO NAME measurement VALUE n)
), g AS (
  SELECT *, CASE WHEN measurement IN ('endpoint_mutations', 'migration_like_transitions') AND u > 0 THEN cmp / CAST(u AS DOUBLE) ELSE 1.0 END AS cov FROM f
)
SELECT measurement, start_s, start_s + 604800 AS end_s, CASE WHEN n < 10 THEN 'UNKNOWN' WHEN cov < 1 THEN 'DEGRADED' ELSE 'PRESENT' END AS state, CASE WHEN n >= 10 THEN CAST(n AS DOUBLE) END AS value, CASE WHEN n >= 10 THEN round(cov, 6) END AS coverage_fraction FROM g"""

_H, _P = f"WITH {_health()}", f"WITH {_points()}"
_MAIL = r"(did:(plc|web):)|(at://)|([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,})"

SQL: dict[str, str] = {
    "bucket_counts": f"{_H} SELECT run_id, bucket_start, metric, count FROM bkt",
    "bucket_counts_minute": f"WITH {_health(60)} SELECT run_id, bucket_start, metric, count FROM bkt",
    "metric_totals": f"{_H} SELECT metric, CAST(sum(count) AS BIGINT) AS total FROM bkt GROUP BY metric",
    "run_totals": f"{_H} SELECT run_id, metric, CAST(sum(count) AS BIGINT) AS total FROM bkt GROUP BY ALL",
    "available_metrics": f"{_H} SELECT DISTINCT metric FROM bkt",
    "window_health": f"{_H} SELECT run_id, bucket_start, events_seen, gap_us, observed_duration_us, coverage_state, partial, reasons FROM health",
    "window_flags": f"{_H} SELECT run_id, bucket_start, flags, quality FROM health",
    "series_dense": f"{_P} SELECT metric, bucket_start, count, observed_duration_us, flags, quality, eligible, round(rate, 6) AS rate FROM pts",
    "series_dense_minute": f"WITH {_points(60, 7200, '''('click'), ('error')''')} SELECT metric, bucket_start, count, quality, eligible, round(rate, 6) AS rate FROM pts",
    "metric_series": f"""{_H} SELECT bucket_start, 3600 AS bucket_width, CAST(sum(b.count) AS BIGINT) AS count, min(observed_duration_us) AS observed_duration_us, max(CAST(partial AS INTEGER)) AS partial,
      max(CAST(coverage_state = 'degraded' AS INTEGER)) AS degraded, max(CAST(gap_us > 0 AS INTEGER)) AS resume_seam FROM bkt b JOIN health h USING (run_id, bucket_start) WHERE b.metric = 'error' GROUP BY bucket_start""",
    "total_events_series": f"""{_H}, g AS (SELECT unnest(generate_series(lo, hi, 3600)) AS bucket_start FROM (SELECT min(bucket_start) AS lo, max(bucket_start) AS hi FROM health))
      SELECT bucket_start, events_seen AS count, coalesce(quality, 'unobserved') AS quality, CASE WHEN observed_duration_us > 0 THEN round(events_seen / (observed_duration_us / 1e6), 6) END AS rate FROM g LEFT JOIN health USING (bucket_start)""",
    "interval_coverage": f"""{_H}, u AS (SELECT bucket_start, observed_duration_us AS d FROM health UNION ALL SELECT bucket_start, least(observed_duration_us, 2400000000) FROM health WHERE bucket_start // 3600 % 3 = 0),
      p AS (SELECT bucket_start, max(d) AS largest, sum(d) AS total, count(*) AS pieces FROM u GROUP BY ALL),
      a AS (SELECT min(bucket_start) AS first_start, max(bucket_start + 3600) AS last_end, sum(largest) / 1e6 AS lower_s, sum(least(total, 3600000000)) / 1e6 AS upper_s, sum(total) / 1e6 AS recorded_s,
        count(*) FILTER (WHERE pieces > 1) AS split_windows, count(*) FILTER (WHERE largest <> least(total, 3600000000)) AS uncertain_windows FROM p)
      SELECT first_start, last_end, round(lower_s, 6) AS lower_s, round(upper_s, 6) AS upper_s, round(recorded_s, 6) AS recorded_s, split_windows, uncertain_windows, round(lower_s / (last_end - first_start), 6) AS lower_ratio,
        round(upper_s / (last_end - first_start), 6) AS upper_ratio, CASE WHEN lower_s = upper_s THEN round(lower_s, 6) END AS observed_s, CASE WHEN lower_s = upper_s THEN 'exact' ELSE 'bounded' END AS status FROM a""",
    "merge_window_parts": f"{_H} SELECT bucket_start, events_seen AS count, observed_duration_us, flags, coverage_state, gap_us, CAST(1 AS BIGINT) AS pieces FROM health",
    "run_summary": f"""{_H}, a AS (SELECT run_id, count(*) AS windows, count(*) FILTER (WHERE partial) AS partial_windows, CAST(0 AS BIGINT) AS empty_windows, count(*) FILTER (WHERE coverage_state = 'degraded') AS degraded_windows, CAST(0 AS BIGINT) AS lagged_windows,
        count(*) FILTER (WHERE gap_us > 0) AS seam_windows, count(*) FILTER (WHERE gap_us > 0) AS gap_windows, CAST(sum(events_seen) AS BIGINT) AS events, CAST(sum(observed_duration_us) AS BIGINT) AS observed_duration_us, count(*) * 3600000000 AS nominal_duration_us,
        CAST(sum(gap_us) AS BIGINT) AS gap_us, min(first_us) AS lo, max(last_us) AS hi FROM health GROUP BY run_id)
      SELECT * EXCLUDE (lo, hi), CASE WHEN gap_windows > 0 OR degraded_windows > 0 THEN 'partial' ELSE 'complete' END AS status, round((hi - lo) / 1e6, 6) AS data_span_s, round(observed_duration_us / CAST(nominal_duration_us AS DOUBLE), 6) AS coverage_ratio, false AS replayed FROM a""",
    "run_coverage": f"""{_H} SELECT run_id, count(*) AS windows, CAST(sum(events_seen) AS BIGINT) AS events, CAST(sum(observed_duration_us) AS BIGINT) AS observed_us, CAST(sum(gap_us) AS BIGINT) AS gap_us, count(*) FILTER (WHERE partial) AS partial_windows,
      min(bucket_start) AS first_start, max(bucket_start) AS last_start FROM health GROUP BY run_id""",
    "run_conflicts": f"""{_H}, s AS (SELECT run_id, min(us) - 86400000000 AS a, max(us) + 86400000000 AS b FROM ev GROUP BY run_id)
      SELECT 'events' AS endpoint, run_id, other FROM (SELECT run_id, a, lag(run_id) OVER (ORDER BY a) AS other, lag(b) OVER (ORDER BY a) AS until FROM s) WHERE a < until""",
    "compatible_runs": f"{_H} SELECT run_id, min(us) AS start_us, max(us) AS end_us FROM ev GROUP BY run_id",
    "latest_run": f"{_H} SELECT 'events' AS endpoint, arg_max(run_id, us) AS run_id FROM ev",
    "sum_series": f"""{_P} SELECT a.bucket_start, a.count + b.count AS count, a.quality, CASE WHEN a.observed_duration_us > 0 THEN round((a.count + b.count) / (a.observed_duration_us / 1e6), 6) END AS rate
      FROM pts a JOIN pts b USING (bucket_start) WHERE a.metric = 'click' AND b.metric = 'purchase'""",
    "ratio_series": f"{_P}, {_RATIOS} SELECT ratio, bucket_start, numerator, denominator, round(value, 6) AS value, observed, quality FROM rat",
    "ratio_extremes": f"""{_P}, {_RATIOS} SELECT ratio, round(min(value) FILTER (WHERE denominator >= 3), 6) AS low, arg_min(bucket_start, struct_pack(v := value, t := bucket_start)) FILTER (WHERE denominator >= 3 AND value IS NOT NULL) AS low_at,
      round(max(value) FILTER (WHERE denominator >= 3), 6) AS high, arg_max(bucket_start, struct_pack(v := value, t := -bucket_start)) FILTER (WHERE denominator >= 3 AND value IS NOT NULL) AS high_at,
      count(*) FILTER (WHERE denominator >= 3 AND value IS NOT NULL) AS windows, count(*) FILTER (WHERE denominator < 3 AND value IS NOT NULL) AS thin_windows FROM rat GROUP BY ratio""",
    "aggregate_rates": f"""{_P} SELECT metric, CAST(sum(count) AS BIGINT) AS total, round(sum(observed_duration_us) / 1e6, 6) AS observed_s, count(*) AS windows, count(count) AS observed, count(*) FILTER (WHERE eligible) AS eligible,
      round(sum(count) / (sum(observed_duration_us) / 1e6), 6) AS mean_rate FROM pts GROUP BY metric""",
    "combined_rate": f"{_P} SELECT round(sum(count) / max(s), 6) AS rate, CAST(sum(count) AS BIGINT) AS total FROM (SELECT metric, sum(count) AS count, sum(observed_duration_us) / 1e6 AS s FROM pts GROUP BY metric)",
    "rolling_departures": f"""WITH {_deps()} SELECT metric, bucket_start, round(value, 6) AS value, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std, CAST(baseline_n AS INTEGER) AS baseline_n, round(z, 6) AS z, round(pct_change, 6) AS pct_change,
      eligible, quality FROM deps""",
    "robust_departures": f"WITH {_deps(True)} SELECT metric, bucket_start, round(value, 6) AS value, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std, CAST(baseline_n AS INTEGER) AS baseline_n, round(z, 6) AS z FROM deps",
    "condition_labels": f"WITH {_deps()} SELECT metric, condition, count(*) AS windows FROM deps GROUP BY ALL",
    "latest_departure": f"WITH {_deps()} SELECT metric, bucket_start, round(value, 6) AS value, round(baseline_mean, 6) AS baseline_mean, round(z, 6) AS z, condition FROM deps WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric ORDER BY bucket_start DESC) = 1",
    "lagged_correlation": f"""{_P}, k AS (SELECT unnest(generate_series(-5, 5)) AS lag), a AS (SELECT bucket_start, rate AS x FROM pts WHERE metric = 'view' AND eligible), b AS (SELECT bucket_start, rate AS y FROM pts WHERE metric = 'click' AND eligible)
      SELECT CAST(lag AS INTEGER) AS lag, count(y) AS pairs, CASE WHEN count(y) >= 10 THEN round(corr(x, y), 6) END AS r FROM k LEFT JOIN (SELECT lag AS l, x, y FROM k, a JOIN b ON b.bucket_start = a.bucket_start + lag * 3600) ON l = lag GROUP BY lag""",
    "autocorrelation": f"""{_P}, d AS (SELECT metric, bucket_start, rate - avg(rate) OVER (PARTITION BY metric) AS d FROM pts WHERE eligible), e AS (SELECT *, lead(d) OVER (PARTITION BY metric ORDER BY bucket_start) AS d1 FROM d),
      r AS (SELECT metric, count(*) AS n, sum(d * d1) / sum(d * d) AS r FROM e GROUP BY metric) SELECT metric, n, round(r, 6) AS lag1_r, round(greatest(1.0, least(CAST(n AS DOUBLE), n * (1 - r) / (1 + r))), 6) AS n_eff FROM r""",
    "rate_episodes": f"""WITH {_episodes()} SELECT metric, type, direction, start_s, end_s, score, n_windows, events, round(peak_z, 6) AS peak_z, round(mean_z, 6) AS mean_z, round(extreme_rate, 6) AS extreme_rate, round(baseline_rate, 6) AS baseline_rate,
      best - 1 AS rise_windows, n_z - best AS fall_windows FROM eps""",
    "episode_summary": f"WITH {_episodes()} SELECT count(*) AS episodes, min(score) AS low, round(median(score), 6) AS mid, max(score) AS high, min(start_s) AS first_s, max(end_s) AS last_s FROM eps HAVING count(*) > 0",
    "co_occurrence": f"""WITH {_episodes()}, t AS (SELECT metric, metric || ':' || type AS type, start_s, end_s FROM eps) SELECT a.metric AS metric_a, a.type AS type_a, b.metric AS metric_b, b.type AS type_b, greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s,
      least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) AS overlap_s FROM t a JOIN t b ON a.type <> b.type AND (a.start_s, a.type) < (b.start_s, b.type) AND greatest(a.start_s, b.start_s) < least(a.end_s, b.end_s)""",
    "disclosure_gate": f"""WITH {_episodes()}, n AS (SELECT e.metric, e.type, e.start_s, v.actor, count(*) AS n FROM eps e JOIN ev v ON v.metric = e.metric AND v.us >= e.start_s * 1000000 AND v.us < e.end_s * 1000000 GROUP BY ALL),
      m AS (SELECT metric, type, start_s, count(*) AS actors, max(n) AS most, CAST(sum(n) AS BIGINT) AS acts FROM n GROUP BY ALL)
      SELECT metric, type, start_s, coalesce(actors, 0) AS actors, coalesce(most, 0) AS most_by_one, coalesce(acts, 0) AS acts, coalesce(actors, 0) >= 5 AND coalesce(coalesce(most, 0) < coalesce(acts, 0) - baseline_rate * (end_s - start_s), false) AS public
      FROM eps LEFT JOIN m USING (metric, type, start_s)""",
    "sealed_episodes": f"""WITH {_episodes()} SELECT metric, type, start_s, end_s, substr(sha256('{{"end":' || end_s || ',"metric":"' || metric || '","start":' || start_s || ',"windows":' || n_windows || '}}'), 1, 16) AS evidence_id FROM eps""",
    "concentration": f"""{_H}, a AS (SELECT metric, sum(n) AS t, count(*) AS k, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS h FROM (SELECT metric, actor, count(*) AS n FROM ev GROUP BY ALL) GROUP BY metric),
      b AS (SELECT metric, count(*) AS k, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS h FROM (SELECT metric, target, count(*) AS n FROM ev WHERE target IS NOT NULL GROUP BY ALL) GROUP BY metric)
      SELECT a.metric AS collection, CAST(a.t AS BIGINT) AS n_events, a.k AS n_actors, round(a.h, 6) AS actor_herfindahl, b.k AS n_targets, round(b.h, 6) AS target_herfindahl, round(1 / a.h, 6) AS effective_actors, round(log2(greatest(a.h * a.t, 1.0)), 6) AS score FROM a JOIN b USING (metric)""",
    "cohort_pairs": f"{_H}, {_SETS} SELECT a, b, round(jaccard, 6) AS jaccard FROM sim",
    "cohort_components": f"""WITH RECURSIVE {_health()}, {_SETS}, e AS (SELECT a AS x, b AS y FROM sim UNION SELECT b, a FROM sim), reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
      SELECT x AS actor, min(y) AS component FROM reach GROUP BY x""",
    "cohorts": f"""WITH RECURSIVE {_health()}, {_SETS}, e AS (SELECT a AS x, b AS y FROM sim UNION SELECT b, a FROM sim), reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
      mem AS (SELECT x AS actor, min(y) AS component FROM reach GROUP BY x), n AS (SELECT component, count(*) AS n_actors FROM mem GROUP BY ALL HAVING count(*) >= 3),
      j AS (SELECT component, avg(jaccard) AS m FROM sim JOIN mem ON mem.actor = sim.a GROUP BY ALL), pop AS (SELECT target, count(*) AS tally FROM sets GROUP BY ALL),
      sh AS (SELECT component, target, count(*) AS k FROM sets JOIN mem USING (actor) GROUP BY ALL), s AS (SELECT component, count(*) AS c, max(tally) AS top FROM sh JOIN n USING (component) JOIN pop USING (target) WHERE k = n_actors GROUP BY component)
      SELECT 'view' AS collection, component, n_actors, round(m, 6) AS mean_jaccard, coalesce(c, 0) AS n_shared_targets, round(coalesce(top, 0) / CAST((SELECT count(DISTINCT actor) FROM sets) AS DOUBLE), 6) AS target_prevalence, round(log2(greatest(m * n_actors, 1.0)), 6) AS score
      FROM n JOIN j USING (component) LEFT JOIN s USING (component)""",
    "synchronisation": f"""{_H}, f AS (SELECT metric, CAST(CAST(epoch_ms(us // 1000) AS DATE) AS VARCHAR) AS day, actor, min(us) AS t FROM ev GROUP BY ALL), g AS (SELECT metric AS collection, day, count(*) AS n_actors, min(t) AS from_us, max(t) AS to_us, (max(t) - min(t)) / 1e6 AS s FROM f GROUP BY ALL)
      SELECT collection, day, n_actors, from_us, to_us, round(s, 6) AS first_act_span_s, round(least(1e6, 86400.0 / s), 6) AS compression, round(log2(greatest(least(1e6, 86400.0 / s), 1.0)), 6) AS score FROM g WHERE n_actors >= 5 AND s <= 80000 AND least(1e6, 86400.0 / s) >= 1""",
    "lifecycle_inbound": f"""{_H}, t AS (SELECT actor % 100 AS who, us AS t FROM ev WHERE metric = 'error'), a AS (SELECT target AS who, us, actor FROM ev WHERE metric IN ('click', 'purchase')),
      n AS (SELECT t.who, t.t, count(*) FILTER (WHERE us >= t - 86400000000) AS n_inbound, count(DISTINCT CASE WHEN us >= t - 86400000000 THEN actor END) AS n_distinct_actors, count(*) FILTER (WHERE us < t - 86400000000) AS baseline_raw
        FROM t JOIN a ON a.who = t.who AND a.us < t.t AND a.us >= t.t - 5 * 86400000000 GROUP BY ALL),
      x AS (SELECT who, t, coalesce(n_inbound, 0) AS n_inbound, coalesce(n_distinct_actors, 0) AS n_distinct_actors, coalesce(baseline_raw, 0) AS baseline_raw FROM t LEFT JOIN n USING (who, t)),
      y AS (SELECT *, CASE WHEN baseline_raw > 0 THEN n_inbound / (baseline_raw / 4.0) ELSE CAST(n_inbound AS DOUBLE) END AS excess_ratio FROM x), z AS (SELECT *, n_inbound >= 2 AND n_distinct_actors >= 2 AND excess_ratio >= 1.5 AS fits FROM y)
      SELECT who, t, n_inbound, n_distinct_actors, baseline_raw, round(excess_ratio, 6) AS excess_ratio, CASE WHEN fits THEN 'deactivation_after_inbound' ELSE 'deactivation_quiet' END AS type, CASE WHEN fits THEN round(log2(greatest(excess_ratio, 1.0)), 6) ELSE 0.0 END AS score FROM z""",
    "field_vector": f"""WITH {_field()} SELECT bucket_start, observed, eligible, round(emission_velocity, 6) AS emission_velocity, round(interaction_velocity, 6) AS interaction_velocity, round(interaction_pressure, 6) AS interaction_pressure, round(reply_share, 6) AS reply_share,
      round(graph_velocity, 6) AS graph_velocity, round(boundary_share, 6) AS boundary_share, round(withdrawal_share, 6) AS withdrawal_share, round(turbulence, 6) AS turbulence, round(acceleration, 6) AS acceleration FROM field""",
    "climatology_diurnal": f"WITH {_field()} SELECT quantity, hour, n, n_days, round(p05, 6) AS p05, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p95, 6) AS p95 FROM cells",
    "climatology_overall": f"""WITH {_field()} SELECT quantity, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(lag1_r, 6) AS lag1_r, round(n_eff, 6) AS n_eff,
      round(residual_r, 6) AS residual_r, n_days, support FROM dist""",
    "field_candidates": f"WITH {_field()} SELECT bucket_start, quantity, round(value, 6) AS value, direction FROM cand",
    "candidate_rate": f"""WITH {_field()}, pr AS (SELECT count(*) AS scored_pairs FROM lng JOIN dist USING (quantity) WHERE support <> 'unsupported'), c AS (SELECT count(*) AS candidates FROM cand)
      SELECT scored_pairs, candidates, round(candidates / CAST(scored_pairs AS DOUBLE), 6) AS observed_rate, round(candidates / CAST(scored_pairs AS DOUBLE) - 0.1, 6) AS excess_over_nominal FROM pr, c""",
    "conditions_state": _conditions("0"),
    "recent_states": _conditions("0, 1, 3, 6, 12, 24"),
    "persistence": f"WITH {_field()} SELECT bucket_start, elevated, runs FROM placed",
    "diurnal_swing": f"WITH {_field()} SELECT quantity, round(max(p50), 6) AS high, round(min(p50), 6) AS low, CASE WHEN min(p50) > 0 THEN round(max(p50) / min(p50), 6) END AS swing FROM cells GROUP BY quantity",
    "intensity_heatmap": f"WITH {_field()} SELECT CAST(CAST(epoch_ms(bucket_start * 1000) AS DATE) AS VARCHAR) AS day, CAST(bucket_start // 3600 % 24 AS INTEGER) AS hour, round(avg(interaction_velocity), 6) AS mean, count(*) AS windows FROM field WHERE interaction_velocity IS NOT NULL GROUP BY ALL",
    "density_portrait": f"""WITH {_field()}, k AS (SELECT emission_velocity AS x, interaction_velocity AS y FROM field WHERE eligible AND emission_velocity IS NOT NULL AND interaction_velocity IS NOT NULL), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k)
      SELECT CAST(least(59, floor(coalesce((x - x0) * 60 / nullif(x1 - x0, 0), 0))) AS INTEGER) AS bx, CAST(least(33, floor(coalesce((y - y0) * 34 / nullif(y1 - y0, 0), 0))) AS INTEGER) AS by, count(*) AS windows FROM k, b GROUP BY ALL""",
    "radar": f"""WITH {_field()}, r AS (SELECT CAST(bucket_start // 3600 % 24 AS INTEGER) AS hour, interaction_velocity / p50 AS v FROM placed WHERE bucket_start > (SELECT max(bucket_start) FROM field) - 86400 AND p50 > 0 AND interaction_velocity IS NOT NULL)
      SELECT hour, round(list_sort(list(v))[len(list(v)) // 2 + 1], 6) AS ratio, count(*) AS windows FROM r GROUP BY hour""",
    "downsample_columns": f"""{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket_start) AS i, count(*) OVER (PARTITION BY metric) AS k FROM pts), c AS (SELECT *, CAST((i - 1) // greatest(1, CAST(ceil(k / 100.0) AS BIGINT)) AS INTEGER) AS "column" FROM n)
      SELECT metric, "column", min(bucket_start) AS bucket_start, round(min(rate), 6) AS low, round(max(rate), 6) AS high,
        arg_min(quality, list_position(['unobserved', 'gap', 'loss', 'degraded', 'partial', 'warming_up', 'lagged', 'recovering', 'seam', 'clean'], quality)) AS worst, bool_or(count IS NULL) AS any_unobserved, count(*) AS windows FROM c GROUP BY ALL""",
    "quality_histogram": f"{_P} SELECT metric, quality, count(*) AS windows, round(sum(observed_duration_us) / 1e6, 6) AS observed_s FROM pts GROUP BY ALL",
    "entity_reduction": _REDUCE,
    "compose_overlap": f"""WITH {_FACTS}, right_facts AS (SELECT start_s - 259200 AS start_s, start_s + 345600 AS end_s, start_s // 604800 % 5 = 0 AS weak, CAST(rows AS DOUBLE) AS value FROM r)
      SELECT greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s, CASE WHEN a.weak OR b.weak THEN 'DEGRADED' ELSE 'PRESENT' END AS state, CASE WHEN a.weak OR b.weak THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS coverage_fraction, a.value AS left_value, b.value AS right_value
      FROM left_facts a JOIN right_facts b ON greatest(a.start_s, b.start_s) < least(a.end_s, b.end_s)""",
    "compose_pearson": f"WITH {_FACTS} SELECT count(*) AS aligned_windows, round(corr(l.value, r.quantity), 6) AS coefficient, 'DEGRADED' AS state, 0.75::DOUBLE AS coverage_fraction, 'COMPOSED' AS disposition FROM l JOIN r USING (start_s)",
    "archive_partition": f"""{_H}, s AS (SELECT bucket_start, bucket_start > (SELECT max(bucket_start) FROM health) - 86400 AS young FROM health)
      SELECT CASE WHEN young THEN 'recent' ELSE 'archive' END AS side, CAST(CAST(epoch_ms(bucket_start * 1000) AS DATE) AS VARCHAR) AS day, count(*) AS windows, min(bucket_start) AS first_start, max(bucket_start) AS last_start FROM s GROUP BY ALL""",
    "archive_index": f"""{_H} SELECT CAST(CAST(epoch_ms(bucket_start * 1000) AS DATE) AS VARCHAR) AS day, count(*) AS window_count, min(bucket_start) AS first_start, max(bucket_start) AS last_start FROM health
      WHERE bucket_start <= (SELECT max(bucket_start) FROM health) - 86400 GROUP BY ALL""",
    "publish_continuity": f"""{_H}, a AS (SELECT sum(observed_duration_us) / 1e6 AS p, sum(observed_duration_us) FILTER (WHERE bucket_start // 3600 % 50 <> 0) / 1e6 AS c, min(bucket_start) FILTER (WHERE bucket_start // 3600 % 50 <> 0) > min(bucket_start) AS later FROM health),
      d AS (SELECT count(*) AS missing_days FROM (SELECT bucket_start // 86400 AS d FROM health EXCEPT SELECT bucket_start // 86400 FROM health WHERE bucket_start // 3600 % 50 <> 0))
      SELECT CASE WHEN later OR p - c > greatest(120, p * 0.01) OR missing_days > 0 THEN 'SHRUNK' ELSE 'CONTINUOUS' END AS verdict, missing_days, later AS starts_later, p - c > greatest(120, p * 0.01) AS recent_lost, round(p, 6) AS published_s, round(c, 6) AS candidate_s FROM a, d""",
    "status_concerns": f"""{_H}, f AS (SELECT count(*) AS n, sum(gap_us) AS gap, sum(events_seen) AS e, arg_max(coverage_state, bucket_start) AS last FROM health)
      SELECT 'persistence' AS concern, 'PRESENT' AS state, CAST(n AS VARCHAR) AS detail FROM f UNION ALL SELECT 'currency', 'PRESENT', '60' FROM f UNION ALL SELECT 'coverage', CASE WHEN gap > 0 THEN 'DEGRADED' ELSE 'PRESENT' END, CAST(CAST(gap AS BIGINT) AS VARCHAR) FROM f
      UNION ALL SELECT 'loss', 'PRESENT', '0' FROM f UNION ALL SELECT 'schema_drift', 'PRESENT', '0' FROM f UNION ALL SELECT 'delay', 'UNKNOWN', NULL FROM f UNION ALL SELECT 'health', CASE last WHEN 'ok' THEN 'PRESENT' WHEN 'degraded' THEN 'DEGRADED' ELSE 'UNKNOWN' END, last FROM f""",
    "identity_tripwire": f"SELECT doc_id, CAST(length(regexp_replace(text, '{_MAIL}', '', 'g')) AS BIGINT) AS rest_chars FROM documents WHERE regexp_matches(text, '{_MAIL}')",
    "event_profile": "SELECT name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS name FROM events) GROUP BY name",
    "power_check": f"""{_P}, d AS (SELECT metric, bucket_start, rate - avg(rate) OVER (PARTITION BY metric) AS d FROM pts WHERE eligible), e AS (SELECT *, lead(d) OVER (PARTITION BY metric ORDER BY bucket_start) AS d1 FROM d),
      r AS (SELECT metric, count(*) AS n, sum(d * d1) / sum(d * d) AS r, count(DISTINCT bucket_start // 86400) AS days FROM e GROUP BY metric), k AS (SELECT *, greatest(1.0, least(CAST(n AS DOUBLE), n * (1 - r) / (1 + r))) AS n_eff FROM r)
      SELECT metric, n, round(n_eff, 6) AS n_eff, days, round(days * 100.0::DOUBLE / n_eff, 6) AS days_to_target FROM k""",
    "concentrated": f"""{_H}, x AS (SELECT *, us // 21600000000 AS hour FROM ev), a AS (SELECT hour, CAST(sum(n) AS BIGINT) AS t, count(*) AS n, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS h FROM (SELECT hour, actor, count(*) AS n FROM x GROUP BY ALL) GROUP BY hour),
      b AS (SELECT hour, count(*) AS n, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS h FROM (SELECT hour, target, count(*) AS n FROM x WHERE target IS NOT NULL GROUP BY ALL) GROUP BY hour),
      c AS (SELECT hour, 'actor_concentration' AS type, h, n, t AS n_events FROM a UNION ALL SELECT hour, 'target_concentration', b.h, b.n, a.t FROM b JOIN a USING (hour))
      SELECT hour, type, round(h, 6) AS h, n, n_events, round(log2(greatest(h * n_events, 1.0)), 6) AS score FROM c WHERE n_events >= 20 AND h >= 0.01""",
    "public_episodes": f"""WITH {_episodes()}, n AS (SELECT e.metric, e.type, e.start_s, v.actor, count(*) AS n FROM eps e JOIN ev v ON v.metric = e.metric AND v.us >= e.start_s * 1000000 AND v.us < e.end_s * 1000000 GROUP BY ALL),
      m AS (SELECT metric, type, start_s, count(*) AS actors, max(n) AS most, sum(n) AS acts FROM n GROUP BY ALL)
      SELECT type, direction, start_s // 3600 * 3600 AS from_s, (end_s + 3599) // 3600 * 3600 AS to_s, CASE WHEN score >= 3.5 THEN 'extreme' WHEN score >= 2 THEN 'large' WHEN score >= 1 THEN 'moderate' ELSE 'small' END AS band,
        CASE WHEN score >= 3.5 THEN 'critical' WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'med' WHEN score >= 0.585 THEN 'low' ELSE 'info' END AS severity
      FROM eps JOIN m USING (metric, type, start_s) WHERE actors >= 5 AND coalesce(most < acts - baseline_rate * (end_s - start_s), false)""",
    "seismogram": f"WITH {_episodes()} SELECT type, start_s, end_s, score, round(score / nullif(max(score) OVER (), 0), 6) AS height FROM eps",
    "observation_documents": f"""WITH {_field()}, v AS (SELECT f.bucket_start, coalesce(h.quality, 'unobserved') AS quality, f.eligible, len(list_filter([emission_velocity, interaction_velocity, interaction_pressure, reply_share, graph_velocity, boundary_share, withdrawal_share, turbulence, acceleration],
        lambda x: x IS NOT NULL)) AS k FROM field f LEFT JOIN health h USING (bucket_start)) SELECT bucket_start, '3600s' AS window, quality, eligible, CAST(k AS INTEGER) AS measured, CAST(9 - k AS INTEGER) AS missing FROM v""",
}
