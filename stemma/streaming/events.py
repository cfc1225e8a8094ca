"""Incremental indexing with Structured Streaming: file events, debounce, upserts by file.

Events are (path, op, ts). A micro-batch debounces per path, keeps the last operation and replaces or deletes the
file's rows; the commit of a batch is one overwrite of the branch's partition, so a replayed batch gives the same state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "path string, op string, ts timestamp"


def normalize_op(op: Column) -> Column:
    """The strongest of combined operations: Create, Write, Remove, Rename; permission changes fall away (null)."""
    low = F.lower(op)
    return F.when(low.contains("create"), "Create").when(low.contains("write"), "Write").when(low.contains("remove"), "Remove").when(low.contains("rename"), "Rename")


def debounce(events: DataFrame, gap: str = "100 milliseconds", key: str = "path", ts: str = "ts", op: str = "op") -> DataFrame:
    """(key, start, end, op, events): runs of a path's events closer than gap as one event, the last one's operation.

    A run ends before the first event that comes gap or later; of events at one time the greatest operation counts.
    A hot path is one sorted window, which spills; nothing is gathered."""
    w = Window.partitionBy(key).orderBy(ts, op)
    t = F.col(ts).cast("timestamp")
    new = F.coalesce((t >= F.lag(t).over(w) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    runs = events.where(F.col(ts).isNotNull()).withColumn("_run", F.sum(new).over(w))
    return runs.groupBy(key, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.max(F.struct(ts, op)).alias("_l"), F.count("*").alias("events")).select(key, "start", "end", F.col(f"_l.{op}").alias("op"), "events")


def session_counts(events: DataFrame, gap: str, key: str, ts: str, late: str | None = None) -> DataFrame:
    """The same runs as event-time sessions, also on streams: (key, start, end, events); late is the watermark."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def last_operations(batch: DataFrame) -> DataFrame:
    """(path, op) of a micro-batch: the last operation per path, of equal times the greatest."""
    ops = batch.withColumn("op", normalize_op(F.col("op"))).where("op is not null and path is not null")
    return ops.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("l")).select("path", "l.op")


def apply_batch(nodes: DataFrame, edges: DataFrame, batch: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], branch: str) -> tuple[DataFrame, DataFrame]:
    """The state after a micro-batch: files removed or renamed lose their nodes and edges, created or written ones get
    what parse(paths) returns. Other branches stay as they are."""
    from ..operators.store import delete_by_file

    last = last_operations(batch)
    n, e = delete_by_file(nodes, edges, branch, last.select(F.col("path").alias("file_path")))
    new_n, new_e = parse(last.where("op in ('Create', 'Write')"))
    return n.unionByName(new_n, allowMissingColumns=True), e.unionByName(new_e, allowMissingColumns=True).dropDuplicates(["branch", "id"])


def watch(spark: SparkSession, events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Runs handle(batch, id) for every micro-batch of a stream of EVENTS; offsets live in the checkpoint."""
    q = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def event_files(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of event files (JSON lines) as they appear in a directory, subdirectories included."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of files with content as they appear below a directory."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def sync_plan(head: str, state: DataFrame, branch: str, diff: Callable[[str], DataFrame] | None) -> tuple[str, DataFrame | None]:
    """('none' | 'incremental' | 'full', changes): none if the branch's recorded commit is head, a full run if there is no
    record or its diff fails."""
    row = state.where(F.col("branch") == branch).select("commit").limit(1).collect()
    if row and row[0].commit == head:
        return "none", None
    if row and row[0].commit and diff is not None:
        try:
            return "incremental", diff(row[0].commit)
        except Exception:  # noqa: BLE001 - a lost commit or a shallow clone: index everything
            return "full", None
    return "full", None


def auto_import_due(export_time: float, imported_time: float | None) -> bool:
    """Whether an export file is newer than what was imported last."""
    return imported_time is None or export_time > imported_time


def changes_to_events(changes: DataFrame, at: Column | None = None) -> DataFrame:
    """changes(path, change) of two scans as EVENTS: added, modified and deleted files are created, written and removed.
    A scan walks every directory, so new directories are watched from the next one on and what is gone is seen."""
    op = F.when(F.col("change") == "added", "Create").when(F.col("change") == "deleted", "Remove").otherwise("Write")
    return changes.select("path", op.alias("op"), (F.current_timestamp() if at is None else at).alias("ts"))


def index_run(store, scan: DataFrame, state: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], hooks: list[Callable] = ()):  # noqa: B006
    """(store, state) after one index run over scan(path, modification_time, ...): files that are gone or changed since
    state(path, modification_time) lose their rows, added and changed ones get what parse(files) returns, and then every
    hook (linking, saving the vectors) turns the store into the next once, however many files changed. Where nothing
    changed the store comes back as it was and no hook runs. Later micro-batches go through apply_batch without hooks."""
    from ..session import cut
    from ..sources.files import changed_files

    changes = cut(changed_files(scan, state))
    if changes.isEmpty():
        return store, state
    store = store.delete_files(changes.select(F.col("path").alias("file_path")))
    store = store.upsert(*parse(scan.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")))
    for hook in hooks:
        store = hook(store)
    return store, scan.select("path", "modification_time")
