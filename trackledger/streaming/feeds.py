"""The same questions over streams: what catalogs gain and lose, hourly counts, guards, containers, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from trackledger.operators.audit import monotonic_frames
from trackledger.sources.shared import exists, names_in, put_new, text_of, written
from trackledger.sources.snapshots import append_ledger, read_ledger
from trackledger.sources.versions import Versioned


def stream_changes(spark: SparkSession, catalog: str, out: str, checkpoint: str, table: str = "files", identity: tuple[str, ...] = ("path",), once: bool = False) -> StreamingQuery:
    """Follow a catalog (``refresh_catalog``): what each of its commits added, removed or changed goes to ``out``; see ``read_changes``.

    The catalog's markers are the stream, so the driver looks at no folder of files; what differs is read by Spark, from the days that a
    commit replaced only. Each batch first notes from which version to which it goes, so a batch that is run again, or a restart,
    tells the same changes once more in the same place. Versions must be kept (``Versioned.vacuum``) until they have been followed.
    """
    source = Versioned(spark, catalog)

    def take(batch: DataFrame, batch_id: int) -> None:
        note = f"{out}/told/{batch_id:010d}"
        if not exists(spark, note):
            before = [n for n in names_in(spark, f"{out}/told") if n < f"{batch_id:010d}"]
            since = int(text_of(spark, f"{out}/told/{before[-1]}").split()[1]) if before else 0
            put_new(spark, note, f"{since} {source.current()}")
        since, until = map(int, text_of(spark, note).split())
        if until > since:
            source.changes(table, list(identity), since, until).withColumn("version", F.lit(until).cast("long")).write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")

    markers = spark.readStream.schema("version long").json(f"{catalog}/commits")
    writer = markers.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """What ``stream_changes`` has told so far: change, the table's columns, version."""
    return spark.read.parquet(f"{out}/events").drop("batch")


def stream_hourly_units(events: DataFrame, delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """(cam_id, from_dt, n): rows per camera and hour, given out when the watermark has passed the hour."""
    counted = events.withWatermark(ts, delay).groupBy("cam_id", F.window(ts, "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("cam_id", F.col("window.start").alias("from_dt"), "n")


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch's own folder of a table; a batch that is run again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_monotonic(batch: DataFrame, batch_id: int, out: str, by: list[str], seq: str = "seq", ts: str = "frame_ts", forget: str = "30 days") -> None:
    """For foreachBatch: the batch's frames later than all before them, per group, across batches, into ``out`` (by batch).

    The batch is ordered by Spark in slices (``monotonic_frames``), so a group of any size is many tasks and none holds it. What is kept
    between batches is one time for each group, in ``<out>-last``, by batch: a batch reads that of the one before and writes its own, so
    it can be run again. A group whose last frame is more than ``forget`` older than the newest of all is forgotten. Batches must follow
    each other in order of ``seq``; within a batch any order will do.
    """
    spark = batch.sparkSession
    last = f"{out.rstrip('/')}-last"
    rows = written(batch)
    before = spark.read.parquet(f"{last}/batch={batch_id - 1}") if batch_id and exists(spark, f"{last}/batch={batch_id - 1}") else rows.select(*by, F.col(ts).alias("_last")).limit(0)
    kept = monotonic_frames(rows, by, seq, ts).join(before, by, "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
    newest = before.unionByName(rows.groupBy(*by).agg(F.max(ts).alias("_last"))).groupBy(*by).agg(F.max("_last").alias("_last"))
    limit = newest.agg(F.max("_last").alias("_most"))
    _put(newest.join(F.broadcast(limit), F.col("_last") >= F.col("_most") - F.expr(f"interval {forget}"), "left_semi"), last, batch_id)  # one row
    _put(kept, out, batch_id)


CONTAINER = "cam_id long, container long, first_ts timestamp, last_ts timestamp, n_frames long"
_FRAMES = pa.schema([("seq", pa.int64()), ("frame_ts", pa.timestamp("us")), ("frame_id", pa.int64()), ("taken", pa.timestamp("us"))])
#: Frames in one value of the state.
CHUNK_FRAMES = 50_000


def _packed(frames: pd.DataFrame) -> list[tuple[bytes]]:
    """Frames as values of the state: Arrow batches of so many rows."""
    parts = (frames.iloc[i : i + CHUNK_FRAMES] for i in range(0, len(frames), CHUNK_FRAMES))
    return [(pa.record_batch([pa.array(part[f.name], f.type, from_pandas=True) for f in _FRAMES], schema=_FRAMES).serialize().to_pybytes(),) for part in parts]


def _unpacked(values: Iterator[tuple[bytes]]) -> list[pd.DataFrame]:
    return [pa.ipc.read_record_batch(pa.py_buffer(bytes(v[0])), _FRAMES).to_pandas() for v in values]


class _Containers(StatefulProcessor):
    """State per camera: frames that the watermark has not passed, by thousands in one value, and the container that is open.

    The state is told to Spark value by value, which costs far more than the frames do, so a frame is no value of its own.
    """

    def __init__(self, silence_s: float):
        self.silence = pd.Timedelta(seconds=silence_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frames binary")
        self.next = handle.getValueState("next", "taken timestamp")  # the first of those that wait
        self.open = handle.getValueState("open", "container long, first_ts timestamp, last_ts timestamp, n_frames long, frame_id long, taken timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [part[_FRAMES.names] for part in rows])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [])

    def _settle(self, key: tuple, watermark_ms: int, came: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames that the watermark has passed go on in order; an open container that has been silent for long enough is closed."""
        now = pd.Timestamp(watermark_ms, unit="ms")
        first = pd.Timestamp(self.next.get()[0]) if self.next.exists() else None
        came = pd.concat(came, ignore_index=True) if came else pd.DataFrame(columns=_FRAMES.names)
        if first is not None and first <= now:
            frames = pd.concat([*_unpacked(self.waiting.get()), *([came] if len(came) else [])], ignore_index=True)
            self.waiting.clear()
            self.next.clear()
            first = None
        else:  # of those that wait none is ready, so they stay where they are
            frames = came
        if len(frames):
            ready = frames["taken"] <= now
            rest = frames[~ready]
            yield from self._go_on(key, frames[ready].sort_values("seq"))
            if len(rest):
                self.waiting.appendList(_packed(rest))
                least = rest["taken"].min() if first is None else min(first, rest["taken"].min())
                self.next.update((least.to_pydatetime(),))
                self.handle.registerTimer(_ms(least))
        if self.open.exists():
            number, first, last, n, _, taken = self.open.get()
            until = pd.Timestamp(taken) + self.silence
            if until < now:
                self.open.update((number, first, last, 0, None, taken))  # its number is kept for the next one
                if n:
                    yield pd.DataFrame([(key[0], number, first, last, n)], columns=["cam_id", "container", "first_ts", "last_ts", "n_frames"])
            elif n:
                self.handle.registerTimer(_ms(until))

    def _go_on(self, key: tuple, frames: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frames):
            return
        number, first, last, n, frame_id, taken = self.open.get() if self.open.exists() else (-1, None, None, 0, None, None)
        before_id, before_taken = frames["frame_id"].shift(), frames["taken"].shift()
        new = (frames["frame_id"] < before_id) | (frames["taken"] - before_taken > self.silence)
        new.iloc[0] = not n or frames["frame_id"].iloc[0] < frame_id or frames["taken"].iloc[0] - pd.Timestamp(taken) > self.silence
        group = new.cumsum()
        made = frames.assign(container=number + group).groupby("container", sort=True).agg(first_ts=("frame_ts", "first"), last_ts=("frame_ts", "last"), n_frames=("seq", "size")).reset_index()
        if n and number == made["container"].iloc[0]:  # the open one goes on
            made.loc[0, "first_ts"], made.loc[0, "n_frames"] = first, n + int(made.loc[0, "n_frames"])
        elif n:
            made = pd.concat([pd.DataFrame([(number, first, last, n)], columns=made.columns), made], ignore_index=True)
        tail = made.iloc[-1]
        self.open.update((int(tail["container"]), tail["first_ts"].to_pydatetime(), tail["last_ts"].to_pydatetime(), int(tail["n_frames"]), int(frames["frame_id"].iloc[-1]), frames["taken"].iloc[-1].to_pydatetime()))
        yield made.iloc[:-1].assign(cam_id=key[0])[["cam_id", "container", "first_ts", "last_ts", "n_frames"]]

    def close(self) -> None:
        pass


def _ms(t: pd.Timestamp) -> int:
    """The first whole millisecond after ``t``."""
    return int(pd.Timestamp(t).value // 1_000_000) + 1


def stream_containers(frames: DataFrame, silence_s: float, delay: str) -> DataFrame:
    """Closed containers (cam_id, container, first_ts, last_ts, n_frames) of frames (cam_id, seq, frame_ts, frame_id, taken).

    ``taken`` is when a frame was taken by the recorder's clock, which rises with ``seq``; frames may come in up to ``delay`` late. They wait
    until the watermark has passed them and go on in order of ``seq``. A container ends where the frame's number falls or the
    recorder is silent for more than ``silence_s``; a timer gives it out even if nothing follows. Needs the RocksDB state store. The state of a camera is its
    frames of the last ``delay`` and one open container, whatever it sent before.
    """
    return frames.withWatermark("taken", delay).groupBy("cam_id").transformWithStateInPandas(_Containers(silence_s), CONTAINER, "Append", "EventTime")


def stream_dedup(containers: DataFrame, delay: str = "2 days") -> DataFrame:
    """Containers without repeats of (cam_id, first_ts, last_ts) within the watermark."""
    return containers.withWatermark("first_ts", delay).dropDuplicatesWithinWatermark(["cam_id", "first_ts", "last_ts"])


def stream_late(spark: SparkSession, batch: DataFrame, batch_id: int, on_time: str, late: str, days: int = 2, ts: str = "ts") -> None:
    """For foreachBatch: rows more than ``days`` before the newest row so far go to the late table, others to the first one.

    Both tables are parted by batch, and a batch that is run again replaces what it wrote. Each batch leaves its newest time in
    ``<on_time>-newest``; the next ones read these rows instead of the table.
    """
    newest = f"{on_time.rstrip('/')}-newest"
    put = lambda df, path: df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    put(batch.agg(F.max(ts).alias("m")), newest)
    so_far = spark.read.parquet(newest).where(F.col("batch") <= batch_id).agg(F.max("m").alias("m"))
    marked = batch.join(F.broadcast(so_far)).withColumn("_late", F.col(ts) < F.col("m") - F.make_dt_interval(days=F.lit(days))).drop("m")  # one row
    put(marked.where("not coalesce(_late, false)").drop("_late"), on_time)
    put(marked.where("_late").drop("_late"), late)


def submit_days(batch: DataFrame, batch_id: int, ledger: str) -> None:
    """For foreachBatch: the batch's days (text, ``day``) that no batch before has handed out go to the ledger, under the batch's number.

    The ledger (``read_ledger``: day, run) is the memory of what was submitted: it survives restarts and new checkpoints that go on counting,
    and a batch that is run again finds the same days, as its own entries don't count.
    """
    spark = batch.sparkSession
    days = batch.select("day").where("day is not null").distinct()
    if Versioned(spark, ledger).current():
        days = days.join(read_ledger(spark, ledger).where(F.col("run") != str(batch_id)).select("day").distinct(), "day", "left_anti")
    append_ledger(written(days), ledger, str(batch_id))


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of a Parquet table as a stream, so many in a batch at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, into Parquet."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(df: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there now, batch by batch."""
    df.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
