"""One commit for a batch, runs, and the stream of recorded frames by its own cursor."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, publish
from tidemark.sources import commits, feed, store
from tidemark.streaming import collector
from tidemark.streaming import windows as live

BASE = 1_700_000_040_000_000
EVENTS = "source string, arrival long, us long, metrics array<string>"


def closed(spark, *seconds, ended=True):
    rows = [("s", i, BASE + s * 1_000_000, ["m", "n"]) for i, s in enumerate(seconds)]
    return live.window_batch(spark.createDataFrame(rows, EVENTS), 60, ended=ended)


def test_a_commit_is_there_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    commits.start_run(spark, root, "r", "e", 60, 1)
    assert commits.commit(closed(spark, 1, 2, 3, 61, ended=False), root, 0, "r", "e")
    assert commits.cursor(spark, root, "e") == BASE + 3_000_000 and commits.cursor(spark, root, "other") is None

    class Died(Exception):
        pass

    # The writer dies after both tables and before the marker.
    second = closed(spark, 61, 70, 130, 190, ended=False)
    create = type(spark).createDataFrame

    def dies_at_the_marker(self, *a, **k):
        if len(a) > 1 and a[1] == commits.MARKER and a[0]:
            raise Died
        return create(self, *a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", dies_at_the_marker)
    with pytest.raises(Died):
        commits.commit(second, root, 1, "r", "e")
    monkeypatch.undo()
    assert store.read(spark, root, "window_health").count() == 3  # it lies there
    assert commits.committed(spark, root, "window_health").count() == 1 and commits.committed(spark, root, "bucket").count() == 2
    assert commits.cursor(spark, root, "e") == BASE + 3_000_000

    # The same batch again, differently cut, replaces what was left; then it stays.
    assert commits.commit(closed(spark, 61, 70, 130, ended=False), root, 1, "r", "e")
    assert not commits.commit(closed(spark, 61, 70, 130, ended=False), root, 1, "r", "e")
    assert commits.committed(spark, root, "window_health").count() == 2 and commits.cursor(spark, root, "e") == BASE + 70_000_000
    assert commits.markers(spark, root).count() == 2


def test_what_a_commit_refuses(spark, tmp_path):
    root = str(tmp_path)
    windows = closed(spark, 1, 2, 61, ended=False)
    with pytest.raises(store.IntegrityError, match="beyond"):
        commits.commit(windows, root, 0, "r", "e", cursor_us=BASE + 61_000_000)
    with pytest.raises(store.IntegrityError, match="beyond"):
        commits.commit(windows.where("false"), root, 0, "r", "e", cursor_us=BASE)
    assert commits.markers(spark, root).count() == 0 and commits.cursor(spark, root, "e") is None
    with pytest.raises(store.IntegrityError, match="twice"):
        commits.commit(windows.union(windows), root, 0, "r", "e")
    assert commits.commit(windows, root, 0, "r", "e", cursor_us=BASE + 1_000_000) and commits.cursor(spark, root, "e") == BASE + 1_000_000
    with pytest.raises(store.IntegrityError, match="committed already"):
        commits.commit(windows, root, 1, "r", "e")
    assert commits.commit(windows, root, 2, "another", "e")  # the rest of a window is another run's row
    with pytest.raises(store.IntegrityError, match="another run's"):
        commits.commit(windows, root, 2, "r", "e")
    assert commits.commit(windows.where("false"), root, 3, "r", "e")  # nothing closed: no cursor
    assert commits.cursor(spark, root, "e") == BASE + 2_000_000


def test_runs_are_open_interrupted_or_ended(spark, tmp_path):
    root = str(tmp_path)
    assert commits.runs(spark, root).count() == 0
    assert commits.start_run(spark, root, "a", "e", 60, 10, version="1") is None
    commits.commit(closed(spark, 1, 2, 61, ended=False), root, 0, "a", "e")
    assert commits.start_run(spark, root, "b", "e", 60, 20) == BASE + 2_000_000
    commits.start_run(spark, root, "c", "elsewhere", 60, 5, planned_end_us=99)
    commits.end_run(spark, root, "b", 30, "completed")
    commits.end_run(spark, root, "b", 40, "again")
    commits.start_run(spark, root, "d", "e", 60, 50)
    with pytest.raises(store.IntegrityError):
        commits.start_run(spark, root, "d", "e", 60, 60)
    got = {r.run_id: r for r in commits.runs(spark, root).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "interrupted", "b": "ended", "c": "open", "d": "open"}
    assert (got["a"].windows, got["a"].first_event_us, got["b"].windows, got["b"].reason, got["b"].ended_us, got["c"].planned_end_us) == (1, BASE + 1_000_000, 0, "completed", 30, 99)
    assert got["b"].resume_cursor_us == got["d"].resume_cursor_us == BASE + 2_000_000


def test_a_collection_has_its_run_and_its_cursor(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(json.dumps({"time_us": BASE + s * 1_000_000, "kind": "identity"}) for s in range(0, 200, 10)))
    root = str(tmp_path / "out")
    run = collector.collect(spark, feed.Feed("e", str(tmp_path / "in")), root, edges=False)
    again = collector.collect(spark, feed.Feed("e", str(tmp_path / "in")), root, edges=False)
    runs = {r.run_id: r for r in commits.runs(spark, root).collect()}
    assert (runs[run].state, runs[run].windows, runs[run].last_event_us) == ("ended", 3, BASE + 170_000_000)
    assert (runs[again].windows, runs[again].resume_cursor_us, runs[again].reason) == (0, BASE + 170_000_000, "completed")
    assert commits.committed(spark, root, "window_health").select("run_id").distinct().count() == 1


def recorded(folder, seed=3):
    """Files of frames: equal times, times that go back, lines without one; (position, line) of all."""
    rng, position, every, us = random.Random(seed), -1, [], BASE
    folder.mkdir()
    for _ in range(6):
        lines = [(us, None)]
        for _ in range(40):
            us += rng.choice([0, 0, 1, 250_000])
            odd = rng.random()
            lines.append((None, "{no json") if odd < 0.05 else (None, "[]") if odd < 0.08 else (us - rng.choice([0, 0, 0, 900_000]), None))
        lines = [(t, text or json.dumps({"time_us": t, "n": len(every) + k, "kind": "identity"})) for k, (t, text) in enumerate(lines)]
        first = max(position, lines[0][0] or position)
        placed = feed.written(lines, first)
        (folder / f"{max(first, 0):020d}.jsonl").write_text("\n".join(x for _, x in placed) + "\n")
        every += placed
        position, us = placed[-1][0], max(us, placed[-1][0]) + 1
    return every


def test_frames_stop_and_go_on_at_any_event(spark, tmp_path):
    every = recorded(tmp_path / "in")
    out = []

    def run(until=None, endpoint="e"):
        stream = feed.frames(spark, str(tmp_path / "in"), endpoint, until_us=until)
        query = stream.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    positions = sorted({p for p, _ in every})
    for until in [*sorted(random.Random(1).sample(positions[:-1], 4)), None]:
        run(until)
        assert until is None or max(p for _, p, _ in out) == until
    assert sorted((p, v) for v, p, _ in out) == sorted(every)  # nothing lost, nothing twice
    assert [v for v, *_ in sorted(out, key=lambda r: r[2])] == [v for _, v in every]  # in order
    with pytest.raises(Exception, match="cannot go on"):
        (tmp_path / "in" / f"{positions[-1] + 5:020d}.jsonl").write_text(json.dumps({"time_us": positions[-1] + 5}))
        run(endpoint="other")


def test_frames_from_a_cursor_feed_a_collection(spark, tmp_path):
    every = recorded(tmp_path / "in", seed=9)
    middle = every[60][0]
    root, config = str(tmp_path / "out"), feed.Feed("e", str(tmp_path / "in"), width=2)
    collector.collect(spark, config, root, lines=feed.frames(spark, config.folder, "e", cursor_us=middle, until_us=every[-30][0]))
    collector.collect(spark, config, root, lines=feed.frames(spark, config.folder, "e"))
    kept = [(p, json.loads(v)) for p, v in every if p > middle and v.startswith('{"time_us"')]
    health = commits.committed(spark, root, "window_health")
    assert health.count() > 1 and health.agg(F.sum(F.col("events_seen") + F.col("late_events"))).first()[0] <= len(kept)
    assert commits.cursor(spark, root, "e") == health.agg(F.max("last_event_us")).first()[0] <= kept[-1][0]
    assert health.groupBy("run_source", "bucket_start").count().where("count > 1").count() == 0


def test_a_baseline_is_kept_for_its_store_and_endpoint(spark, tmp_path):
    root, binding = str(tmp_path), {"endpoint": "e", "store_id": "s"}
    assert health.kept(spark, root, 10.0, binding) == health.State()
    state = health.State("degraded", 9, 123.5, low=3, good=2)
    health.keep(spark, root, state, 100.0, binding)
    health.keep(spark, root, health.State("ok", 12, 140.25), 200.0, binding)  # takes the place of the first
    assert health.kept(spark, root, 300.0, binding) == health.State("ok", 12, 140.25)
    for other in ({"endpoint": "f", "store_id": "s"}, {"endpoint": "e", "store_id": "t"}, {"endpoint": "e", "store_id": None}):
        assert health.kept(spark, root, 300.0, other) == health.State()
    assert health.kept(spark, root, 200.0 + 3601, binding) == health.State()
    (tmp_path / "health.json").write_text("{half")
    (tmp_path / ".health.json.crc").unlink(missing_ok=True)
    assert store.stored_document(spark, f"{root}/health.json") == (None, "not JSON") and health.kept(spark, root, 300.0, binding) == health.State()


def test_an_archive_is_read_back_before_it_is_promised(spark, tmp_path):
    schema = "bucket_start long, quality string, flags array<string>, events_seen long, observed_duration_us long"
    rows = spark.createDataFrame([(i * 3600, "clean", ["seam"] if i % 5 == 0 else [], i, 3_600_000_000) for i in range(120)], schema)
    split = publish.split(rows, cap=10).where("side = 'archive'")
    path = str(tmp_path / "days")
    assert {r.problem for r in publish.read_back(split, path).collect()} == {publish.MISSING}
    publish.write_archive(split, path)
    assert [r.problem for r in publish.read_back(split, path).collect()] == [None] * 5
    days = sorted(d for d in (tmp_path / "days").iterdir() if d.name.startswith("day="))
    for f in days[1].glob("*.json"):
        f.write_text(f.read_text().replace('"events_seen":30', '"events_seen":31'))
    for f in days[2].glob("*.json"):
        f.write_text(f.read_text()[:-9])
    for f in (*days[1].glob(".*.crc"), *days[2].glob(".*.crc")):
        f.unlink()
    days[3].rename(tmp_path / "days" / "day=1999-01-01")
    got = {str(r.day): r.problem for r in publish.read_back(split, path).collect()}
    assert got == {"1970-01-01": None, "1970-01-02": publish.OTHER, "1970-01-03": publish.OTHER, "1970-01-04": publish.MISSING, "1970-01-05": None, "1999-01-01": publish.STRANGER}
