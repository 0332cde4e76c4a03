"""Sequential parts: the health fold, the live lane (batch and stream), the cooldown."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import edges, episodes, health, recurrences
from tidemark.streaming import windows as live


def test_health_needs_streaks_and_recovers():
    s, states = health.State(), []
    zero = dict.fromkeys(health.LOSSES, 0)
    for rate in [100] * 6 + [10] * 4 + [100] * 6:
        states.append(health.step(s, rate * 60, 60.0, zero, None)[0])
    assert states[:4] == ["warming_up"] * 4 and states[5] == "ok"
    assert states[7] == "ok" and states[8] == "degraded"  # the third bad window
    assert states[13] == "degraded" and states[14] == "ok"  # the fifth good one
    with pytest.raises(ValueError):
        health.step(health.State(), 1, 1.0, {"gap_us": 0}, None)


def test_a_gap_degrades_at_once():
    s = health.State("ok", 9, 100.0)
    assert health.step(s, 6000, 60.0, dict.fromkeys(health.LOSSES, 0) | {"gap_us": 1}, None)[:2] == ("degraded", ["gap_observed"])


def test_fold_is_by_run(spark):
    rows = [(r, i * 60, 600, 60_000_000, None, 0, 0, 0, 0, 0) for r in ("a", "b") for i in range(7)]
    df = spark.createDataFrame(rows, "run_id string, bucket_start long, events_seen long, observed_duration_us long, lag_max_s double, parse_errors long, rejected_no_time_us long, late_events long, gap_us long, unclassified long")
    got = health.fold(df).groupBy("run_id").agg(F.max_by("state", "bucket_start").alias("s")).collect()
    assert {r.s for r in got} == {"ok"}


def by_hand(events, width):
    """(bucket, count, late) of closed windows, the plain way."""
    out, bucket, high, n, late = [], None, None, 0, 0
    for us in events:
        b = us // 1_000_000 // width * width
        if (high is not None and b <= high) or (bucket is not None and b < bucket):
            late += 1
            continue
        if bucket is not None and b != bucket:
            out.append((bucket, n, late))
            high, n, late = bucket, 0, 0
        bucket, n = b, n + 1
    return out + [(bucket, n, late)]


def test_lane_counts_late_events_but_does_not_apply_them(spark):
    rng = random.Random(5)
    events = [max(0, t * 7_000_000 - rng.choice([0, 0, 0, 90_000_000])) for t in range(400)]
    df = spark.createDataFrame([("s", i, us, ["m"]) for i, us in enumerate(events)], "source string, arrival long, us long, metrics array<string>")
    got = sorted((r.bucket_start, r["count"], r.late_events) for r in live.window_batch(df, 60).collect())
    assert got == by_hand(events, 60)


def folded(rows, width, ended):
    """The closed windows of (source, arrival, us, metrics, outcome), by the lane's fold."""
    out = []
    for source in sorted({r[0] for r in rows}):
        lane = live.Lane(width)
        for _, _, us, metrics, outcome in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            out += lane.take(source, us, metrics, outcome)
        out += lane.close(source, ended=True) if ended else []
    return sorted(out, key=str)


@pytest.mark.parametrize("ended", [True, False])
def test_batch_is_the_fold_of_every_source(spark, ended):
    rng, rows = random.Random(9), []
    for source in ("a", "b", "only lost"):
        for i in range(300):
            us = (i + 3) * 7_000_000 - rng.choice([0, 0, 0, 45_000_000, 130_000_000]) + rng.randrange(1000)
            lost = source == "only lost" or i < 2 or rng.random() < 0.05
            rows.append((source, i, None if lost else us, [] if lost else rng.sample(["m", "n", "o"], rng.randint(0, 2)), rng.choice(["parse_error", "rejected_no_time_us"]) if lost else None))
    mixed = rng.sample(rows, len(rows))
    df = spark.createDataFrame(mixed, "source string, arrival long, us long, metrics array<string>, outcome string")
    got = live.window_batch(df, 60, ended=ended)
    assert got.columns == [c.split()[0] for c in live.CLOSED.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == folded(rows, 60, ended)


def test_batch_deals_one_source_into_ranges(spark, monkeypatch):
    written, held = [], live.held
    monkeypatch.setattr(live, "held", lambda df: written.append(held(df)) or written[-1])
    # The number is the session's; on small tables adaptive execution would put the ranges together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4_000).selectExpr("'s' AS source", "id AS arrival", "id * 1000000 AS us", "array('m') AS metrics")
        got = live.window_batch(df, 60).agg(F.sum("count"), F.sum("late_events")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in written[0].groupBy("range").count().collect()]
    assert tuple(got) == (4_000, 0) and len(sizes) == 4 and max(sizes) < 2_000


def test_stream_equals_batch(spark, tmp_path):
    schema = "source string, arrival long, us long, metrics array<string>"
    rows = [("s", i, i * 9_000_000, ["m"]) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.window_stream(stream, 60).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    whole = {(r.bucket_start, r["count"]) for r in live.window_batch(spark.createDataFrame(rows, schema), 60, ended=False).collect()}
    got = {(r.bucket_start, r["count"]) for r in spark.table("closed").collect()}
    assert got == whole and len(got) == 8


def seamed_rows(seed, sources=("a", "b", "lost", "calm")):
    """Lines with lags, drops of the connection, replays from before them, gaps here, there and nowhere."""
    rng, rows = random.Random(seed), []
    for source in sources:
        arrival, us = 0, 50_000_000
        for _ in range(260):
            arrival += rng.randint(1, 3)
            kind = rng.random()
            if source == "lost" or kind < 0.05:
                rows.append((source, arrival, None, None, rng.choice(["parse_error", "rejected_no_time_us"]), None, None, None, None, None, None))
            elif kind < 0.13 and source != "calm":
                rows.append((source, arrival, None, None, None, None, "dropped", None, None, None, None))
                us -= rng.choice([0, 20_000_000, 100_000_000])
                if rng.random() < 0.8:
                    arrival += 1
                    gap = rng.choice([0, 0, 5_000_000, 40_000_000, 90_000_000])
                    rows.append((source, arrival, None, None, None, None, "resumed", gap, rng.choice([None, us + rng.randint(-30, 60) * 1_000_000]) if gap else None, True, rng.random() < 0.7))
            else:
                us += rng.randint(0, 15_000_000)
                at = us - rng.choice([0, 0, 0, 45_000_000, 130_000_000])
                wall = None if source == "calm" else at + rng.choice([-2_000, 0, 300_000, 5_000_000, 2_000_000_000])
                rows.append((source, arrival, at, rng.sample(["m", "n", "malformed.commit"], rng.randint(0, 2)), None, wall, None, None, None, None, None))
    return rows


SEAMED = "source string, arrival long, us long, metrics array<string>, outcome string, wall_us long, signal string, gap_us long, gap_end_us long, seam boolean, reconnect boolean"


def lane_of(rows, width, ended):
    out = []
    for source in sorted({r[0] for r in rows}):
        lane = live.Lane(width)
        for _, _, us, metrics, outcome, wall, signal, gap, gap_end, seam, reconnect in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            if signal:
                lane.signal(signal, gap or 0, gap_end, bool(seam), bool(reconnect))
            else:
                out += lane.take(source, us, metrics or [], outcome, wall)
        out += lane.close(source, ended=True) if ended else []
    return out


def alike(got, want):
    got, want = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str) for rows in (got, want))
    assert got == want


@pytest.mark.parametrize("ended, seed", [(True, 1), (False, 2), (True, 3), (False, 4)])
def test_batch_is_the_fold_with_gaps_and_drops(spark, ended, seed):
    rows = seamed_rows(seed)
    want = lane_of(rows, 60, ended)
    assert any(r[13] for r in want) and any(r[14] for r in want) and any(r[12] > 1 for r in want)
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SEAMED)
    alike(map(tuple, live.window_batch(df, 60, ended=ended).collect()), want)


def test_stream_is_the_fold_with_gaps_and_drops(spark, tmp_path):
    """Keyed state over many micro-batches; the query is stopped and started again in between."""
    rows = seamed_rows(7)
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SEAMED).option("maxFilesPerTrigger", 1).parquet(folder)
    out, step = [], max(r[1] for r in rows) // 5 + 1
    for part in range(5):
        spark.createDataFrame([r for r in rows if r[1] // step == part], SEAMED).coalesce(1).sortWithinPartitions("source", "arrival").write.mode("append").parquet(folder)
        closed = live.window_stream(stream, 60).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect())))
        closed.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = lane_of(rows, 60, False)
    alike(out, want)
    alike(map(tuple, live.window_batch(spark.createDataFrame(rows, SEAMED), 60, ended=False).collect()), want)


BASE = 1_700_000_040


@pytest.mark.parametrize("gaps, observed, ledger", [([(-10, 5)], 50, 15), ([(-10, 20)], 40, 30), ([(20, 30)], 40, 10), ([(50, 80)], 40, 30), ([(20, 35), (30, 40)], 30, 25), ([(20, 25), (40, 45)], 40, 10), ([(20, 30), (None, 5)], 35, 15)])
def test_only_the_union_of_gaps_in_the_span_counts(spark, gaps, observed, ledger):
    def line(second):
        return [(BASE + second) * 1_000_000, ["m"], None, None, None, None, None, None, None]

    def resumed(a, b):
        return [None, None, None, None, "resumed", (b if a is None else b - a) * 1_000_000, None if a is None else (BASE + b) * 1_000_000, True, True]

    rows = [line(10), *[resumed(*g) for g in gaps], line(max(61, *(b for _, b in gaps)))]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], SEAMED)
    got = live.window_batch(df, 60, ended=False).first()
    assert (got.observed_duration_us, got.gap_us, got.reconnects, got.resume_seam, got.partial) == (observed * 1_000_000, ledger * 1_000_000, len(gaps), True, True)


@pytest.mark.parametrize("partitions", [1, 7])
def test_mean_over_an_order_is_a_loop(spark, partitions):
    rng = random.Random(partitions)
    rows = [(s, i, rng.choice([None, 0.0, rng.random() * 9]) if i > 30 else rng.choice([None, 0.0])) for s in ("a", "b", None) for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "s string, i long, v double").repartition(partitions)
        got = {(r.s, r.i): r.mean for r in recurrences.exponential_mean(df, "s", [F.col("i")], F.col("v"), 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in ("a", "b", None):
        x = 0.0
        for t, i, v in rows:
            if t == s:
                x = x if v is None else v if x == 0 else 0.2 * v + 0.8 * x
                assert abs(got[s, i] - x) < 1e-12


def test_cooldown():
    rows = pd.DataFrame({"det_id": "x", "cycle": range(8), "severity_rank": [1, 1, 1, 2, 2, 2, 2, 2], "score": [1, 1.1, 1.2, 1.2, 1.2, 1.8, 1.8, 1.8]})
    assert health.cooldown(rows) == [True, False, False, True, False, True, False, False]


def test_segments_match_a_loop(spark):
    """The set-based hysteresis against the sequential one, on random series."""
    rng = random.Random(11)
    series = {f"s{k}": [(rng.choice([None, -4.0, -2.0, -1.0, 0.0, 1.0, 1.6, 2.5, 3.5]), rng.random() < 0.9) for _ in range(60)] for k in range(40)}
    rows = [(m, i * 60, 60, z, e) for m, s in series.items() for i, (z, e) in enumerate(s)]
    df = spark.createDataFrame(rows, "metric string, bucket_start long, bucket_width int, z double, eligible boolean")
    got = {}
    for r in episodes.segments(df).select("metric", "sign", "segment", "bucket_start").collect():
        got.setdefault((r.metric, r.sign, r.segment), []).append(r.bucket_start // 60)
    found = sorted((m, s, min(v), max(v)) for (m, s, _), v in got.items())
    want = []
    for m, values in series.items():
        for sign in (1, -1):
            runs, cur, slack = [], [], 0
            for i, (z, e) in enumerate(values):
                enter, hold = z is not None and sign * z >= 3 and e, z is not None and sign * z >= 1.5 and e
                if enter or (cur and hold):
                    cur, slack = [*cur, i], 0
                elif cur:
                    slack += 1
                    cur, slack, runs = ([], 0, [*runs, cur]) if slack > 2 else ([*cur, i], slack, runs)
            for seg in [*runs, cur]:
                while seg and (values[seg[-1]][0] is None or sign * values[seg[-1]][0] < 1.5):
                    seg = seg[:-1]
                if seg:
                    want.append((m, sign, seg[0], seg[-1]))
    assert found == sorted(want)


def test_a_micro_batch_is_taken_in_order_whatever_order_its_chunks_come_in():
    class Loose(live.LaneProcessor):
        def _opened(self):
            self.last = live.Lane(self.width)
            return self.last

        def _kept(self, lane):
            pass

    def run(chunks):
        columns = ["source", "arrival", "us", "metrics", *live.OPTIONAL]
        frames = [pd.DataFrame([("s", a, us, ["post.create"] if us else None, None if us else "parse_error", None, None, None, None, None, None) for a, us in rows], columns=columns) for rows in chunks]
        processor = Loose(60)
        return pd.concat(list(processor.handleInputRows(("s",), iter(frames), None))), processor.last

    rows = [(i, None if i % 7 == 3 else 1_000_000 * 10 * i + 1) for i in range(60)]
    (want, a), (got, b) = run([rows]), run([rows[40:], rows[:20], rows[20:40]])
    assert want.equals(got) and len(want) == 9 and a.held() == b.held()
    assert int(got.late_events.sum()) == 0 and int(got.parse_errors.sum()) == 8


def test_stretches_of_rows_are_what_the_lane_makes_of_each_row():
    """Late rows, rows without a time, windows that are closed already: cut anywhere, a few stretches stand for all rows."""
    import pyarrow as pa

    class Loose(live.StretchProcessor):
        def _opened(self):
            return self.kept

        def _kept(self, lane):
            self.kept = lane

    draw = random.Random(6)
    kinds = pa.schema([("source", pa.string()), ("arrival", pa.int64()), ("us", pa.int64()), ("metrics", pa.list_(pa.string())), ("outcome", pa.string())])
    for _ in range(60):
        at, rows = 5_000_000_000, []
        for k in range(draw.choice([1, 20, 200])):
            at += draw.choice([0, 1, 2_000_000, 40_000_000])
            us = draw.choice([at, at, at, at - draw.randrange(200_000_000), None])
            odd = draw.choice(["parse_error", "rejected_no_time_us"])
            rows.append(("s", k // 2, us, None if us is None else draw.choice([[], ["post.create"], ["like.create", "like.create", "unknown.kind"]]), odd if us is None else "classified"))
        lane, each = live.Lane(60), []
        for _, _, us, metrics, outcome in rows:
            each += lane.take("s", us, metrics or [], outcome)
        # Two micro-batches of two tasks; a cut is where the arrival changes.
        cuts = sorted(draw.randrange(0, len(rows) + 1) // 2 * 2 for _ in range(3))
        processor, got, n = Loose(60), [], 0
        processor.kept = live.Lane(60)
        for tasks in ([rows[: cuts[0]], rows[cuts[0] : cuts[1]]], [rows[cuts[1] : cuts[2]], rows[cuts[2] :]]):
            parts = []
            for task in tasks:
                found = []
                for i in range(0, len(task), 64):
                    batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*task[i : i + 64], strict=True), kinds, strict=True)], schema=kinds)
                    found += live.folded(batch, 60, len(found))
                parts, n = [pd.DataFrame(found), *parts] if found else parts, n + len(found)
            if parts:
                got += list(processor.handleInputRows(("s",), iter(parts), None))
        assert live.frame(each).equals(pd.concat(got, ignore_index=True) if got else live.frame([]))
        assert processor.kept.held() == lane.held() and processor.kept.counts == lane.counts and n <= len(rows)
    with pytest.raises(ValueError, match="order of arrival"):
        live.folded(pa.RecordBatch.from_pylist([{"source": "s", "arrival": a} for a in (2, 1)], kinds), 60, 0)


def test_running_counts_of_inbound_edges_equal_comparing_all(spark):
    draw, back = random.Random(4), 86_400_000_000
    acts = [(draw.randrange(0, 12 * back, back // 8), draw.choice([None, 1, 2, 3, 4]), "x", draw.choice([None, 7, 8])) for _ in range(600)]
    moves = [(draw.choice([7, 8, 9]), draw.randrange(0, 12 * back, back // 8), "error") for _ in range(60)]
    found = edges.inbound(spark.createDataFrame(moves, "actor long, us long, status string"), spark.createDataFrame(acts, "us long, actor long, collection string, target long"))
    times = {m[:2]: moves.count(m) for m in moves}

    def want(who, t):
        recent = [a for u, a, _, w in acts if w == who and t - back <= u < t]
        base = sum(w == who and t - 5 * back <= u < t - back for u, _, _, w in acts)
        return who, t, times[who, t] * len(recent), len({a for a in recent if a is not None}), times[who, t] * base

    got = found.select("who", "t", "n_inbound", "n_distinct_actors", "baseline_raw")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want(who, t) for who, t, _ in moves)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "by_actor" not in plan and "target" not in plan  # edges are counted and written; none of them is joined with transitions


def test_no_frame_of_the_lane_runs_from_each_row_to_the_end(spark, monkeypatch):
    plans, hold = [], live.held
    monkeypatch.setattr(live, "held", lambda df, *more: plans.append(df._jdf.queryExecution().analyzed().toString()) or hold(df, *more))
    rows = [("s", i, None if i % 5 == 4 else 60_000_000 * i, None if i % 5 == 4 else ["a"], "dropped" if i % 5 == 4 else None) for i in range(20)]
    found = live.window_batch(spark.createDataFrame(rows, "source string, arrival long, us long, metrics array<string>, signal string"), 60)
    assert found.count() == 13 and any("epoch" in p for p in plans)
    # Such a frame is walked anew for every row; the number of epochs grows with the rows.
    assert not [p for p in plans if "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" in p]
