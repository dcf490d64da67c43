"""Streaming forms of the incremental operators.

Each gives on the same input what its batch operator gives; rows that wait for the watermark come out once it has passed
them. Every run names its output and its checkpoint folder: a run that is started again with the same names goes on where
the last one ended. What has been written is found on storage, never in the driver's memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators import evaluation as ev
from corpusloom.plans.session import hadoop_path

#: State with lists and timers needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder_stream(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    """Parquet folders below ``folder`` as a stream, each file once; wall-clock times become timestamps."""
    s = spark.readStream.schema(schema).parquet(f"{folder}/*")
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


def _run(writer, checkpoint: str) -> None:
    """Take in all that is there and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append what a stream gives for the input that is new since the last run; the whole table is returned.

    The file sink's log in ``out`` lists the files of finished batches: a batch that is repeated after a failure adds
    nothing twice, and files of a broken one are not read.
    """
    spark = stream.sparkSession
    with _state_store(spark):
        _run(stream.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


class _state_store:
    """The state store that transitions need, for the time a query is started; a stream's checkpoint keeps its choice."""

    name = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.name)
        self.spark.conf.set(self.name, ROCKSDB)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.name, self.before)


def _children(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Folders ``prefix<number>`` by number."""
    path, fs = hadoop_path(spark, folder)
    if not fs.exists(path):
        return {}
    found = (s.getPath() for s in fs.listStatus(path))
    return {int(p.getName()[len(prefix) :]): p.toString() for p in found if p.getName().startswith(prefix)}


def _finished(spark: SparkSession, out: str) -> list[int]:
    """Batch ids whose version is complete (Spark marks a finished write), ascending."""
    def done(folder: str) -> bool:
        path, fs = hadoop_path(spark, f"{folder}/_SUCCESS")
        return fs.exists(path)

    return sorted(v for v, folder in _children(spark, out, "v=").items() if done(folder))


def _delete(spark: SparkSession, folder: str) -> None:
    path, fs = hadoop_path(spark, folder)
    fs.delete(path, True)


def run_latest(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode aggregation; its newest state is returned.

    Each batch writes the version named by its id, so a repeated batch overwrites itself; the version before stays for
    those who still read it, older ones are deleted.
    """
    spark = stream.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        for old in _finished(spark, out)[:-2]:
            _delete(spark, f"{out}/v={old}")

    _run(stream.writeStream.foreachBatch(fold).outputMode("complete"), checkpoint)
    versions = _finished(spark, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/v={versions[-1]}") if versions else spark.createDataFrame([], stream.schema)


def _parts(spark: SparkSession, out: str, before: int | None = None) -> dict[int, list[int]]:
    """By hash partition, the finished versions that hold it, ascending; only those before a batch."""
    held: dict[int, list[int]] = {}
    for v in _finished(spark, out):
        if before is None or v < before:
            for p in _children(spark, f"{out}/v={v}", "part="):
                held.setdefault(p, []).append(v)
    return held


def keyed_state(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The newest version of every hash partition of a table kept by ``run_keyed``."""
    paths = [f"{out}/v={vs[-1]}/part={p}" for p, vs in sorted(_parts(spark, out).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def run_keyed(stream: DataFrame, out: str, checkpoint: str, key: str, merge: Callable[[DataFrame], DataFrame], parts: int = 64) -> DataFrame:
    """Run a stream whose batches are merged into a table by ``key``; the table is returned.

    ``merge`` makes one frame of the rows of old state and batch, row by key. State lies in ``parts`` partitions by the
    key's hash (choose it by the size of the state; it stays fixed). A batch reads and writes only partitions of which it
    has keys, as version ``v=<batch id>``. A repeated batch starts from the versions before it and overwrites its own, so
    nothing counts twice; a version that was not finished is never read. Of a partition, the version in use and the one
    before it are kept.
    """
    spark, schema = stream.sparkSession, stream.schema
    place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("part", place).persist()
        touched = [r["part"] for r in batch.select("part").distinct().collect()]  # at most ``parts`` numbers
        if touched:
            held = _parts(spark, out, batch_id)
            rows = batch.drop("part")
            old = [f"{out}/v={held[p][-1]}/part={p}" for p in touched if p in held]
            if old:
                rows = spark.read.schema(schema).parquet(*old).unionByName(rows)
            merge(rows).withColumn("part", place).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/v={batch_id}")
            for p in touched:
                for v in held.get(p, [])[:-1]:
                    _delete(spark, f"{out}/v={v}/part={p}")
        batch.unpersist()

    _run(stream.writeStream.foreachBatch(fold), checkpoint)
    return keyed_state(spark, out, schema)


def stream_ingest(docs: DataFrame, max_tokens: int = 1200, overlap: int = 100, delay: str | None = None, processed: DataFrame | None = None, chunker: ck.Chunker | None = None) -> DataFrame:
    """New documents of ``docs(text[, ts])`` to chunks: one document per content id, known ones left out.

    With ``delay`` the duplicates are remembered only that long (rows later than the watermark are
    dropped); without it they are remembered for good.
    """
    content = tx.clean_str(F.col("text"))
    d = docs.select(tx.md5_id(content, "doc-").alias("doc_id"), content.alias("text"), *([F.col("ts")] if delay else []))
    d = d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"]) if delay else d.dropDuplicates(["doc_id"])
    if processed is not None:
        d = d.join(processed.select("doc_id"), "doc_id", "left_anti")
    return ck.chunked(d, "doc_id", "text", max_tokens, overlap, chunker)


def last_events(rows: DataFrame) -> DataFrame:
    """The last event per id (tombstones included; ``replay_aliases`` reads it)."""
    cols = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("e")).select(*[F.col("id") if c == "id" else F.col(f"e.{c}").alias(c) for c in rows.columns])


def run_alias_state(events: DataFrame, out: str, checkpoint: str, parts: int = 64) -> DataFrame:
    """Alias log stream folded to the last event per id, whatever the order in which events arrive."""
    return run_keyed(events, out, checkpoint, "id", last_events, parts)


def stream_result_summary(results: DataFrame, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Running totals per mode; with ``window`` per event-time window and mode (for append output)."""
    r = results.where(F.col("score").isNotNull())
    if window:
        return r.withWatermark("ts", delay).groupBy(F.window("ts", window), "mode").agg(*ev.mode_aggregates())
    return r.groupBy("mode").agg(*ev.mode_aggregates())


class _Moves(StatefulProcessor):
    """Rows of a run wait in a list until the watermark has passed them, then they leave in order.

    A batch's rows are one entry of the list: every call of the state store costs a round trip, every entry its conversion.
    """

    def __init__(self, moves: set[tuple[str, str]], start: str, timeout_us: int):
        self.moves, self.start, self.timeout = moves, start, timeout_us
        self.move = Row("run_id", "seq", "before", "state", "is_valid")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, us long")
        self.held = handle.getListState("held", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = [(r.us, r.seq, r.state) for r in rows]
        self.held.appendValue((json.dumps(got),))
        self._wake(min(r[0] for r in got))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        entries = list(self.held.get())
        held = sorted((tuple(r) for e in entries for r in json.loads(e[0])), key=lambda r: (r[0], _order(r[1])))
        ready = [r for r in held if r[0] <= now]
        later = held[len(ready) :]
        if ready:
            self.held.put([(json.dumps(later),)]) if later else self.held.clear()
        known = self.last.get()
        before, since = known if known is not None else (self.start, None)
        out = []
        for us, seq, state in ready:
            if self._silent(since, us):
                out.append((None, before, "failed"))
                before = self.start
            out.append((seq, before, state))
            before, since = state, us
        if self._silent(since, min(now, later[0][0]) if later else now):
            out.append((None, before, "failed"))
            before, since = self.start, None
        if since is not None:
            self.last.update((before, since))
        elif known is not None:
            self.last.clear()
        if self.timeout and since is not None:
            self._wake(since + self.timeout)
        if later:
            self._wake(later[0][0])
        for seq, before, state in out:
            yield self.move(key[0], seq, before, state, (before, state) in self.moves)

    def _silent(self, since: int | None, until: int) -> bool:
        return bool(self.timeout) and since is not None and since + self.timeout <= until

    def _wake(self, us: int) -> None:
        """At the first whole millisecond from ``us`` on."""
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def _order(seq: str | None) -> tuple:
    """Numbers by value, ahead of other names; null first."""
    try:
        return (0,) if seq is None else (1, int(seq), "")
    except ValueError:
        return (2, 0, seq)


def stream_transitions(log: DataFrame, allowed: Mapping[str, Sequence[str]] = ev.TRANSITIONS, start: str = "idle", timeout: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Moves per run with their verdict: ``log(run_id, seq, state, ts)`` to ``(run_id, seq, before, state, is_valid)``.

    Rows may arrive in any order and in any batch: a row waits until the watermark (``delay`` behind the latest time seen)
    has passed it, and the rows of a run leave by (ts, seq), so each meets its true predecessor. Rows that come later than
    that are dropped. With ``timeout`` a run that stays silent so long in event time is reported as a move to ``failed``
    (seq null) and starts anew, also between two rows that arrive together. Run it with ``run_to_table``, which chooses a
    state store that has lists and timers; a run's list holds what came within the delay.
    """
    moves = {(a, b) for a, bs in allowed.items() for b in bs}
    rid, sid = (dict(log.dtypes)[c] for c in ("run_id", "seq"))
    src = log.withWatermark("ts", delay).select("run_id", F.col("seq").cast("string").alias("seq"), "state", "ts", F.unix_micros("ts").alias("us"))
    made = src.groupBy("run_id").transformWithState(
        _Moves(moves, start, int(pd.Timedelta(timeout) / pd.Timedelta(microseconds=1)) if timeout else 0),
        f"run_id {rid}, seq string, before string, state string, is_valid boolean", "Append", "EventTime",
    )
    return made.withColumn("seq", F.col("seq").cast(sid))


def stream_latency(chunks: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Latency per request and session of ``chunks(request_id, ts, text)``; a session ends after ``gap``."""
    s = chunks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "request_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")
    )
    return s.select(
        "request_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_chunks", "n_chars",
        (F.col("n_chunks") > 1).alias("is_streaming"),
    )
