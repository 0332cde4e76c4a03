"""The live lane: event-time windows over an ordered stream, with late events counted but not applied.

``count_stream`` is the plain form (watermark and window).  ``window_stream`` keeps the state of each source itself: events
close a window by moving on, never the clock; an event of a closed window is counted as late on the open one.

Rows are events (``us``), lines without a time (``outcome``) or signals.  The signal ``dropped`` says that the connection is
gone: the open window's counts, which nothing has stored, are dropped, since what follows brings them again; what is known of
the observation itself (reconnects, gaps, that there is a seam) stays and goes to the next window that opens.  The signal
``resumed`` brings such facts: a gap of ``gap_us`` that ends at ``gap_end_us`` (or anywhere, if that is null), ``seam``,
``reconnect``.  A window's observed time is the span from where it was entered to where it ended, less the union of the gaps
inside that span, less all gaps that are nowhere in particular.

Where rows have ``wall_us``, when they were received, a lag (0 to 600 s) is known: its exponential mean over all events and its
maximum since the window before, both up to the event that closes the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars, vocab
from ..operators import ingest, recurrences
from ..sources.store import held

CLOSED = (
    "source string, bucket_start long, bucket_width int, metric string, count long, events_seen long, late_events long, parse_errors long, rejected_no_time_us long, unclassified long, "
    "first_event_us long, last_event_us long, reconnects long, gap_us long, resume_seam boolean, lag_ewma_s double, lag_max_s double, observed_duration_us long, partial boolean"
)
#: Columns that a row may lack, and what stands for them.
OPTIONAL = {"outcome": "string", "wall_us": "long", "signal": "string", "gap_us": "long", "gap_end_us": "long", "seam": "boolean", "reconnect": "boolean"}

# The weight of a new lag, and the greatest lag in seconds.
LAG_ALPHA, LAG_MOST = 0.2, 600.0
#: Rows that are taken from Arrow's columns at a time.
STRETCH = 10_000
DROPPED, RESUMED = "dropped", "resumed"


def json_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Lines of JSON files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path)


def count_stream(events: DataFrame, width: int, delay: str = "0 seconds") -> DataFrame:
    """Counts by window and metric of a stream (ts, metric), closed by the watermark."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", f"{width} seconds"), "metric").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.unix_seconds("window.start").alias("bucket_start"), "metric", "count")


def completed(events: DataFrame) -> DataFrame:
    """(source, arrival, us, metrics) and all optional columns."""
    return events.select("source", "arrival", F.col("us").cast("long").alias("us"), "metrics", *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CLOSED.split(", ")]
    kinds = {"long": "Int64", "int": "int32", "double": "float64", "boolean": "boolean", "string": "object"}
    return pd.DataFrame(rows, columns=names).astype({n: kinds[c.split()[1]] for n, c in zip(names, CLOSED.split(", "), strict=True)})


class Facts:
    """What is known of an observation besides its counts."""

    def __init__(self, reconnects: int = 0, gap_us: int = 0, seam: bool = False, gaps: list[tuple[int, int]] | None = None):
        self.reconnects, self.gap_us, self.seam, self.gaps = reconnects, gap_us, seam, gaps or []

    def note(self, gap_us: int, gap_end_us: int | None, seam: bool, reconnect: bool) -> None:
        self.reconnects, self.gap_us, self.seam = self.reconnects + reconnect, self.gap_us + gap_us, self.seam or seam
        if gap_us and gap_end_us is not None:
            self.gaps.append((gap_end_us - gap_us, gap_end_us))

    def join(self, other: Facts) -> None:
        self.reconnects, self.gap_us, self.seam = self.reconnects + other.reconnects, self.gap_us + other.gap_us, self.seam or other.seam
        self.gaps += other.gaps

    def missing(self, begin: int, end: int) -> int:
        """Microseconds to take from a span: the union of the gaps in it, and gaps that are nowhere."""
        gone, at = self.gap_us - sum(b - a for a, b in self.gaps), begin
        for a, b in sorted(self.gaps):
            a, b = max(a, at), min(b, end)
            if b > a:
                gone, at = gone + b - a, b
        return gone


class Lane:
    """The open window of one source, and what waits for the next one."""

    #: What a lane holds besides counts and facts, in order.
    HELD = "bucket long, high long, events long, late long, waiting long, parse_errors long, rejected long, first_us long, last_us long, begun boolean, lag double, lag_max double"
    FACTS = "waits boolean, reconnects long, gap_us long, seam boolean"

    def __init__(self, width: int):
        self.width = width
        self.bucket = self.high = self.first = self.last = self.lag = self.lag_max = None
        self.events = self.late = self.pending = self.parse_errors = self.rejected = 0
        self.begun, self.counts, self.facts, self.waiting = False, {}, Facts(), Facts()

    def held(self) -> tuple:
        return (self.bucket, self.high, self.events, self.late, self.pending, self.parse_errors, self.rejected, self.first, self.last, self.begun, self.lag, self.lag_max)

    def restore(self, held: tuple) -> None:
        self.bucket, self.high, self.events, self.late, self.pending, self.parse_errors, self.rejected, self.first, self.last, self.begun, self.lag, self.lag_max = held

    def _cleared(self) -> None:
        self.bucket, self.events, self.late, self.counts, self.first, self.last, self.parse_errors, self.rejected, self.facts = None, 0, 0, {}, None, None, 0, 0, Facts()

    def close(self, source: str, ended: bool = False) -> list[tuple]:
        """The open window's rows, one for each metric; ``ended``: the stream stops at its last event."""
        if self.bucket is None:
            return []
        start, end = self.bucket * scalars.MICROS, (self.bucket + self.width) * scalars.MICROS
        begin, to = start if self.begun else self.first, min(self.last, end) if ended else end
        duration = max(0, max(0, to - begin) - self.facts.missing(begin, to))
        odd = sum(n for m, n in self.counts.items() if m in vocab.CANARIES)
        rest = (self.events, self.late, self.parse_errors, self.rejected, odd, self.first, self.last, self.facts.reconnects, self.facts.gap_us, self.facts.seam, self.lag, self.lag_max, duration, duration < end - start)
        rows = [(source, self.bucket, self.width, m, n, *rest) for m, n in sorted(self.counts.items())] or [(source, self.bucket, self.width, None, None, *rest)]
        self.high, self.begun, self.lag_max = self.bucket if self.high is None else max(self.bucket, self.high), True, None if self.lag is None else 0.0
        self._cleared()
        return rows

    def lose(self, outcome: str) -> None:
        """A line without a time counts on the open window, or on the next one."""
        if outcome == "parse_error":
            self.parse_errors += 1
        else:
            self.rejected += 1

    def signal(self, name: str, gap_us: int = 0, gap_end_us: int | None = None, seam: bool = False, reconnect: bool = False) -> None:
        if name == DROPPED:
            if self.bucket is not None:
                self.waiting.join(self.facts)
                self.waiting.seam = True
                self._cleared()
        else:
            (self.waiting if self.bucket is None else self.facts).note(max(0, gap_us), gap_end_us, seam, reconnect)

    def take(self, source: str, us: float | None, metrics: list[str], outcome: str | None = None, wall_us: int | None = None) -> list[tuple]:
        if us is None or us != us:
            self.lose(outcome or "rejected_no_time_us")
            return []
        if wall_us is not None:
            lag = min(max(0.0, (wall_us - us) / scalars.MICROS), LAG_MOST)
            self.lag = lag if not self.lag else LAG_ALPHA * lag + (1 - LAG_ALPHA) * self.lag
            self.lag_max = max(self.lag_max or 0.0, lag)
        return self.observe(source, int(us), metrics)

    def observe(self, source: str, us: int, metrics: list[str]) -> list[tuple]:
        counts: dict[str, int] = {}
        for m in metrics:
            counts[m] = counts.get(m, 0) + 1
        return self.several(source, us // scalars.MICROS // self.width * self.width, 1, 0, us, us, counts)

    def several(self, source: str, bucket: int, events: int, late: int, first: int, last: int, counts: dict[str, int]) -> list[tuple]:
        """``events`` of one window, the first of all at ``first``, and after it ``late`` ones of windows before that."""
        out: list[tuple] = []
        if (self.high is not None and bucket <= self.high) or (self.bucket is not None and bucket < self.bucket):
            if self.bucket is not None:
                self.late += events + late
            else:
                self.pending += events + late
            return out
        if self.bucket is not None and bucket != self.bucket:
            out = self.close(source)
        if self.bucket is None:
            self.bucket, self.late, self.pending, self.first = bucket, self.pending, 0, first
            self.facts, self.waiting = self.waiting, Facts()
        self.events, self.last, self.late = self.events + events, last, self.late + late
        for m, n in counts.items():
            self.counts[m] = self.counts.get(m, 0) + n
        return out


class LaneProcessor(StatefulProcessor):
    """A lane as keyed state: a value for the open window, a map of its counts by metric, and lists of the gaps that belong to
    it or wait for the next one.  A task holds one micro-batch's rows of a source, as Arrow columns, and one window."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lane = handle.getValueState("lane", Lane.HELD)
        self.counts = handle.getMapState("counts", "metric string", "count long")
        self.facts = handle.getListState("facts", Lane.FACTS)
        self.gaps = handle.getListState("gaps", "waits boolean, start_us long, end_us long")

    def _opened(self) -> Lane:
        lane = Lane(self.width)
        if self.lane.exists():
            lane.restore(tuple(None if pd.isna(x) else x for x in self.lane.get()))
            lane.counts = {k[0]: v[0] for k, v in self.counts.iterator()}
            for waits, reconnects, gap_us, seam in self.facts.get():
                setattr(lane, "waiting" if waits else "facts", Facts(reconnects, gap_us, seam))
            for waits, a, b in self.gaps.get():
                (lane.waiting if waits else lane.facts).gaps.append((a, b))
        return lane

    def _kept(self, lane: Lane) -> None:
        self.lane.update(lane.held())
        self.counts.clear()
        for metric, n in lane.counts.items():
            self.counts.updateValue((metric,), (n,))
        both = ((False, lane.facts), (True, lane.waiting))
        self.facts.put([(waits, f.reconnects, f.gap_us, f.seam) for waits, f in both])
        self.gaps.clear()
        if gaps := [(waits, a, b) for waits, f in both for a, b in f.gaps]:
            self.gaps.put(gaps)

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A micro-batch's rows by arrival, a stretch after the other: they were shuffled, so those of several files come mixed."""
        kinds = [("arrival", pa.int64()), ("us", pa.int64()), ("metrics", pa.list_(pa.string()))] + [(c, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in OPTIONAL.items()]
        parts = [pa.Table.from_pandas(part, pa.schema(kinds), preserve_index=False) for part in rows]
        if parts:
            whole = pa.concat_tables(parts)
            order = pc.sort_indices(whole, [("arrival", "ascending")])
            for at in range(0, len(order), STRETCH):
                yield whole.take(order[at : at + STRETCH]).to_pandas()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lane = self._opened()
        for part in self._ordered(rows):
            out = []
            part = part.astype(object)
            for us, metrics, outcome, wall, signal, gap, gap_end, seam, reconnect in part.where(part.notna(), None)[["us", "metrics", *OPTIONAL]].itertuples(index=False):
                if signal is not None:
                    lane.signal(signal, int(gap or 0), None if gap_end is None else int(gap_end), bool(seam), bool(reconnect))
                else:
                    out += lane.take(key[0], us, [] if metrics is None else list(metrics), outcome, None if wall is None else int(wall))
            if out:
                yield frame(out)
        self._kept(lane)

    def close(self) -> None:
        pass


#: What rows are folded into: those from one that no earlier row of its batch has reached in time up to the next such one.
STRETCHES = "source string, arrival long, until long, at long, bucket long, events long, late long, parse_errors long, rejected long, first_us long, last_us long, metrics array<string>, counts array<long>"


def folded(batch: pa.RecordBatch, width: int, at: int) -> list[dict]:
    """Stretches of a batch (source, arrival, us, metrics, outcome), which is in the order of arrival; they are numbered from ``at`` on.

    An event of a window before the highest one of the batch so far is late, whatever came before the batch; those of that
    window are late or on time all together.
    """
    out: list[dict] = []
    table = pa.Table.from_batches([batch])
    for source in table["source"].unique().to_pylist():
        rows = table if source is not None and len(table["source"].unique()) == 1 else table.filter(pc.is_null(table["source"]) if source is None else pc.equal(table["source"], source))
        arrival = rows["arrival"].to_numpy()
        if (np.diff(arrival) < 0).any():
            raise ValueError("rows of a task are not in the order of arrival")
        timed, us = rows["us"].is_valid().to_numpy(), pc.fill_null(rows["us"], 0).to_numpy()
        bucket = np.where(timed, us // scalars.MICROS // width * width, np.iinfo(np.int64).min)
        highest = np.maximum.accumulate(bucket)
        opens = np.r_[timed[0], highest[1:] > highest[:-1]]
        starts = np.flatnonzero(opens | (np.arange(len(us)) == 0))
        stretch = np.cumsum(np.isin(np.arange(len(us)), starts)) - 1
        on, unread = timed & (bucket == highest), pc.fill_null(pc.equal(rows["outcome"], "parse_error"), False).to_numpy()
        number = lambda which: np.bincount(stretch[which], minlength=len(starts)).tolist()  # noqa: B023, E731
        # Metrics of the events on time, counted by stretch.
        lists = rows["metrics"].combine_chunks()
        parent, names = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
        kept = on[parent]
        words, codes = names.dictionary.to_pylist(), names.indices.to_numpy()[kept]
        pairs, n = np.unique(stretch[parent[kept]] * max(1, len(words)) + codes, return_counts=True)
        counts: list[dict] = [{} for _ in starts]
        for pair, k in zip(pairs.tolist(), n.tolist(), strict=True):
            counts[pair // len(words)][words[pair % len(words)]] = k
        last = dict(zip(stretch[on].tolist(), us[on].tolist(), strict=True))
        ends = np.r_[starts[1:], len(us)] - 1
        for k, (start, end, events, late, wrong, lost) in enumerate(zip(starts.tolist(), ends.tolist(), number(on), number(timed & ~on), number(~timed & unread), number(~timed & ~unread), strict=True)):
            where = (int(bucket[start]), int(us[start]), last[k]) if events else (None, None, None)
            out.append({"source": source, "arrival": int(arrival[start]), "until": int(arrival[end]), "at": at + len(out), "bucket": where[0], "events": events, "late": late, "parse_errors": wrong, "rejected": lost, "first_us": where[1], "last_us": where[2], "metrics": list(counts[k]), "counts": list(counts[k].values())})
    return out


def stretches(events: DataFrame, width: int) -> DataFrame:
    """The rows of each task, which come in the order of arrival, as ``STRETCHES``."""
    names = [c.split()[0] for c in STRETCHES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, STRETCHES.split(", "), strict=True)])

    def fold(batches):
        at = 0
        for batch in batches:
            if batch.num_rows:
                found = folded(batch, width, at)
                at += len(found)
                yield pa.RecordBatch.from_pylist(found, schema)

    return events.select("source", "arrival", "us", "metrics", "outcome").mapInArrow(fold, STRETCHES)


class StretchProcessor(LaneProcessor):
    """The same lane over ``STRETCHES``: a task holds a row for each window and batch, not for each event."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lane, out, before = self._opened(), [], None
        whole = pd.concat([part.astype(object) for part in rows]).sort_values(["arrival", "at"])
        for r in whole.where(whole.notna(), None).itertuples(index=False):
            if before is not None and r.arrival < before:
                raise ValueError("rows of several tasks arrive among one another")
            before = r.until
            if r.events:
                counts = {m: int(n) for m, n in zip(r.metrics, r.counts, strict=True)}
                out += lane.several(key[0], int(r.bucket), int(r.events), int(r.late), int(r.first_us), int(r.last_us), counts)
            lane.parse_errors, lane.rejected = lane.parse_errors + int(r.parse_errors), lane.rejected + int(r.rejected)
        if out:
            yield frame(out)
        self._kept(lane)


#: The state store that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def window_stream(events: DataFrame, width: int, ordered: bool = False) -> DataFrame:
    """Closed windows of a stream (source, arrival, us, metrics and optional columns), by keyed state.

    Rows of a source are taken a micro-batch after the other, each in the order of arrival; a feed's micro-batch is one file,
    that of recorded frames is all files up to where the run ends.
    ordered: each task's rows come in the order of arrival, and none of another task's between them, as recorded frames do; without
    signals and lags they are then folded by window where they are read, and only that goes to the state.  Else it is refused.
    Sets the session's state store, which must be RocksDB.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        spark.conf.set(*STORE)
    if ordered and not {"signal", "wall_us"} & set(events.columns):
        return stretches(completed(events), width).groupBy("source").transformWithStateInPandas(StretchProcessor(width), CLOSED, "append", "none")
    return completed(events).groupBy("source").transformWithStateInPandas(LaneProcessor(width), CLOSED, "append", "none")


def window_batch(events: DataFrame, width: int, ended: bool = True) -> DataFrame:
    """The same windows of a whole table, for replays, without a fold.

    The rows are dealt by arrival into ranges that are written; each range takes over from those before it and is walked on its
    own.  Rows of one source that arrive at once are taken in order of their time, signals last.

    Between two drops of the connection (an epoch) the open window is the highest bucket that has arrived, if that is above
    all that were closed before; the last window that an epoch opens is dropped unless the epoch is the last.  What an epoch
    closes at most is therefore what was highest before its highest bucket came, and what is closed before an epoch is a
    running maximum of that: no state goes from row to row.
    """
    by_source = Window.partitionBy("source")
    span = width * scalars.MICROS
    signals, lags = "signal" in events.columns, "wall_us" in events.columns
    lines = completed(events).withColumn("bucket", F.expr(f"CASE WHEN signal IS NULL THEN (us - pmod(us, {span}L)) div {scalars.MICROS}L END"))
    lag = F.least(F.greatest((F.col("wall_us") - F.col("us")) / F.lit(float(scalars.MICROS)), F.lit(0.0)), F.lit(LAG_MOST))
    lines = lines.withColumn("lag", F.when(F.col("bucket").isNotNull() & F.col("wall_us").isNotNull(), lag)).drop("wall_us")
    order = [F.col("source").asc_nulls_first(), F.col("arrival").asc_nulls_last(), F.col("us").asc_nulls_last(), F.col("signal").asc_nulls_first()]
    dealt = recurrences.ranged(lines, order)
    dealt = held(recurrences.folded(dealt, "source", "lag", LAG_ALPHA) if lags else dealt)
    dealt = recurrences.finished(dealt, "source") if lags else dealt.withColumn("mean", F.lit(None).cast("double"))
    same = lambda *on: F.col("source").eqNullSafe(F.col("of")) & F.expr(" AND ".join(on))

    # A row for each range of a source (and epoch): drops before it, and what was highest when it began.
    epochs = F.lit(0).cast("long")
    if signals:
        drop = F.count_if(F.col("signal") == DROPPED)
        drops = dealt.groupBy("source", "range").agg(drop.alias("n"))
        drops = drops.select(F.col("source").alias("of"), F.col("range").alias("piece"), (F.sum("n").over(by_source.orderBy("range")) - F.col("n")).alias("ahead"))
        inside = drop.over(Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.col("signal") == DROPPED, F.lit(False)).cast("int")
        dealt = dealt.withColumn("inside", inside).join(drops, same("range = piece")).drop("of", "piece")
        epochs = F.col("ahead") + F.col("inside")
    dealt = dealt.withColumn("epoch", epochs.cast("long"))
    tops = dealt.groupBy("source", "epoch", "range").agg(F.max("bucket").alias("top"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = tops.select(F.col("source").alias("of"), F.col("epoch").alias("during"), F.col("range").alias("piece"), F.max("top").over(earlier).alias("before"))
    within = Window.partitionBy("source", "epoch", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("highest", F.max("bucket").over(within)).join(begun, same("range = piece", "epoch = during"))
    rows = held(rows.withColumn("highest", F.greatest("highest", "before")).drop("of", "during", "piece", "before", "ahead", "inside"))

    # A row for each epoch: what is closed before it, the first and the last window that it opens, and the next ones after it.
    record = F.col("bucket").isNotNull() & (F.col("highest").isNull() | (F.col("bucket") > F.col("highest")))
    walk = by_source.orderBy("epoch")
    tops = held(rows.groupBy("source", "epoch").agg(F.max_by("highest", F.when(record, F.col("bucket"))).alias("closes")))
    tops = tops.withColumns({"high": F.max("closes").over(walk.rowsBetween(Window.unboundedPreceding, -1)), "ends": F.col("epoch") == F.max("epoch").over(by_source)}).drop("closes")
    opened = rows.where(record).select(F.col("source").alias("of"), F.col("epoch").alias("during"), "bucket").join(tops, same("epoch = during")).where("high IS NULL OR bucket > high")
    opened = opened.groupBy("of", "during").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    known = tops.join(opened, same("epoch = during"), "left").drop("of", "during")
    # The nearest row after each, walked backwards: a frame from a row to the end would be walked anew for every row.
    after = by_source.orderBy(F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -1)
    stays = F.col("ends") | (F.col("first") < F.col("last"))
    known = known.withColumns({
        "next": F.last(F.when(F.col("first").isNotNull(), F.struct("epoch", F.col("first").alias("bucket"))), ignorenulls=True).over(after),
        "next_kept": F.last(F.when(F.col("first").isNotNull() & stays, F.struct("epoch", F.col("first").alias("bucket"))), ignorenulls=True).over(after),
    })
    known = held(known.withColumnRenamed("source", "of").withColumnRenamed("epoch", "during"))

    # Where each row counts: its own window or the open one or the next one; facts go on to one that is kept.
    rows = rows.join(known, same("epoch = during")).drop("of", "during")
    window = lambda b: F.struct("epoch", F.col(b).alias("bucket"))
    rows = rows.withColumn("open", F.when(F.col("high").isNull() | (F.col("highest") > F.col("high")), F.col("highest")))
    rows = rows.withColumn("on_time", F.col("bucket").isNotNull() & (F.col("high").isNull() | (F.col("bucket") > F.col("high"))) & (F.col("highest").isNull() | (F.col("bucket") >= F.col("highest"))))
    kept = lambda b: F.when(F.col("ends") | (F.col(b) < F.col("last")), window(b)).otherwise(F.col("next_kept"))
    facts = F.when(F.col("open").isNotNull(), kept("open")).when(F.col("first").isNotNull(), kept("first")).otherwise(F.col("next_kept"))
    closing = F.col("on_time") & (F.col("bucket") > F.col("open"))
    rows = rows.withColumns({
        "counts_on": F.when(F.col("on_time"), window("bucket")).when(F.col("open").isNotNull(), window("open")).when(F.col("first").isNotNull(), window("first")).otherwise(F.col("next")),
        "facts_on": facts, "lag_on": F.when(closing, window("open")).when(F.col("on_time"), kept("bucket")).otherwise(facts),
        "seamed": (F.col("signal") == DROPPED) & F.col("open").isNotNull(),
    })
    rows = held(rows.select("source", "at", "us", "metrics", "outcome", "signal", "gap_us", "gap_end_us", "seam", "reconnect", "lag", "mean", "on_time", "counts_on", "facts_on", "lag_on", "seamed"))

    line, on_time, lost = F.col("signal").isNull(), F.col("on_time"), F.col("us").isNull()
    unread = F.coalesce(F.col("outcome") == "parse_error", F.lit(False))
    timed = lambda c: F.when(on_time, F.col(c))
    cell = ["epoch", "bucket"]
    sums, ends = ["events_seen", "late_events", "parse_errors", "rejected_no_time_us", "unclassified"], ["first_event_us", "last_event_us"]
    odd = F.size(F.filter("metrics", lambda m: m.isin(*vocab.CANARIES))).cast("long")
    cells = rows.where(line & F.col("counts_on").isNotNull()).groupBy("source", "counts_on").agg(
        F.count_if(on_time).alias("events_seen"), F.count_if(~on_time & ~lost).alias("late_events"), F.count_if(lost & unread).alias("parse_errors"), F.count_if(lost & ~unread).alias("rejected_no_time_us"),
        F.coalesce(F.sum(F.when(on_time & F.col("metrics").isNotNull(), odd)), F.lit(0)).alias("unclassified"), F.min_by(timed("us"), timed("at")).alias("first_event_us"), F.max_by(timed("us"), timed("at")).alias("last_event_us"),
        F.max_by(timed("mean"), timed("at")).alias("last_mean"),
    ).select("source", "counts_on.*", *sums, *ends, "last_mean")
    cells = cells.join(known.select("of", "during", "last", "ends"), same("epoch = during")).where("ends OR bucket < last").withColumn("is_open", F.expr("ends AND bucket = last")).drop("of", "during", "last", "ends")
    if signals:
        is_fact = F.col("signal") == RESUMED
        gap = F.greatest(F.coalesce("gap_us", F.lit(0)), F.lit(0).cast("long"))
        noted = rows.where((is_fact | F.col("seamed")) & F.col("facts_on").isNotNull()).select("source", "facts_on.*", F.when(is_fact, gap).otherwise(0).alias("gap_us"), F.when(is_fact, F.col("gap_end_us")).alias("gap_end_us"), F.coalesce(F.when(is_fact, F.col("seam")), "seamed", F.lit(False)).alias("seam"), (is_fact & F.coalesce("reconnect", F.lit(False))).alias("reconnect"))
        located = F.col("gap_end_us").isNotNull()
        ledger = noted.groupBy(F.col("source").alias("of"), *[F.col(c).alias(f"in_{c}") for c in cell]).agg(
            F.count_if("reconnect").alias("reconnects"), F.sum("gap_us").alias("gap_us"), F.max("seam").alias("resume_seam"), F.sum(F.when(~located, F.col("gap_us")).otherwise(0)).alias("nowhere_us")
        )
        cells = cells.join(ledger, same("epoch = in_epoch", "bucket = in_bucket"), "left").drop("of", "in_epoch", "in_bucket").fillna(0, ["reconnects", "gap_us", "nowhere_us"]).fillna(False, ["resume_seam"])
    else:
        zero = F.lit(0).cast("long")
        cells = cells.withColumns({"reconnects": zero, "gap_us": zero, "nowhere_us": zero, "resume_seam": F.lit(False)})
    # Kept windows come in order, whatever their epochs.  The first is entered at its first event.
    start = F.col("bucket") * scalars.MICROS
    cells = cells.withColumn("begin", F.when(F.col("bucket") > F.min("bucket").over(by_source), start).otherwise(F.col("first_event_us")))
    cells = cells.withColumn("end", F.when(F.col("is_open"), F.least("last_event_us", start + span)).otherwise(start + span))
    cells = cells if ended else cells.where("NOT is_open")
    missing = F.col("nowhere_us")
    if signals:
        gaps = noted.where("gap_us > 0 AND gap_end_us IS NOT NULL").select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), (F.col("gap_end_us") - F.col("gap_us")).alias("a"), F.col("gap_end_us").alias("b"))
        gaps = cells.select("source", "bucket", "begin", "end").join(gaps, same("bucket = in_bucket")).select("source", "bucket", F.greatest("a", "begin").alias("a"), F.least("b", "end").alias("b")).where("a < b")
        seen = Window.partitionBy("source", "bucket").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        gaps = gaps.withColumn("length", F.greatest(F.col("b") - F.greatest("a", F.max("b").over(seen)), F.lit(0).cast("long")))
        gone = gaps.groupBy(F.col("source").alias("of"), F.col("bucket").alias("in_bucket")).agg(F.sum("length").alias("gone"))
        cells = cells.join(gone, same("bucket = in_bucket"), "left").drop("of", "in_bucket")
        missing = missing + F.coalesce("gone", F.lit(0))
    duration = F.greatest(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("end") - F.col("begin")) - missing)
    cells = cells.withColumn("observed_duration_us", duration).withColumn("partial", F.col("observed_duration_us") < span)

    if lags:
        lag_rows = rows.where(F.col("lag").isNotNull() & F.col("lag_on").isNotNull()).groupBy(F.col("source").alias("of"), *[F.col(f"lag_on.{c}").alias(f"in_{c}") for c in cell])
        lag_rows = lag_rows.agg(F.max_by("mean", "at").alias("lag_ewma_s"), F.max("lag").alias("lag_max_s"))
        cells = cells.join(lag_rows, same("epoch = in_epoch", "bucket = in_bucket"), "left").drop("of", "in_epoch", "in_bucket")
        timely = F.max("lag_max_s").over(by_source).isNotNull()  # the last window may have its opening event alone, which counts for the one before
        cells = cells.withColumns({"lag_ewma_s": F.coalesce("lag_ewma_s", F.when(timely, F.col("last_mean"))), "lag_max_s": F.coalesce("lag_max_s", F.when(timely, 0.0))})
    else:
        cells = cells.withColumns({"lag_ewma_s": F.lit(None).cast("double"), "lag_max_s": F.lit(None).cast("double")})
    counts = rows.where(on_time & line).select(F.col("source").alias("of"), F.col("counts_on.epoch").alias("in_epoch"), F.col("counts_on.bucket").alias("in_bucket"), F.explode("metrics").alias("metric"))
    counts = counts.groupBy("of", "in_epoch", "in_bucket", "metric").agg(F.count(F.lit(1)).alias("count"))
    out = cells.join(counts, same("bucket = in_bucket", "epoch = in_epoch"), "left")
    seams = ["reconnects", "gap_us", "resume_seam", "lag_ewma_s", "lag_max_s"]
    return out.select("source", F.col("bucket").alias("bucket_start"), F.lit(width).cast("int").alias("bucket_width"), "metric", "count", *sums, *ends, *seams, "observed_duration_us", "partial")


def classified_stream(lines: DataFrame) -> DataFrame:
    """(outcome, time_us, metrics) of a stream of JSON lines."""
    return ingest.classified(lines).select("outcome", "time_us", "metrics")
