"""Live monitoring of trial events.

Sums and counts are added up from what each micro-batch writes.  Alerts depend on the order of a
model's trials; instead of walking each model in one stateful task, every
micro-batch runs the batch operator, which cuts a busy model into slices, on
top of the totals left by the batches before it.  Those totals are one row
per model, kept as one small table per batch id, so a repeated batch starts
from the same totals and rewrites the same results.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trialspark.constants import BURN_WINDOW_SECONDS, STALE_SECONDS
from trialspark.operators import monitor
from trialspark.session import scratch_path

log = logging.getLogger(__name__)

#: slot of events without a time
NO_TIME = -(2**53)


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available, one micro-batch after another, through ``sink``."""
    q = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_path(df.sparkSession, "stream"))
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def to_table(df: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run into parquet and read back; batches land in their own folder, so a repeat overwrites itself.

    In update mode the newest row per ``keys`` counts, so windows that are still open are in the table too.
    A stream without a batch gives an empty table.
    """
    schema = df.schema
    df.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{'latest' if mode == 'complete' else 'batch=-1'}")
    if mode == "complete":
        run(df, lambda b, _i: b.write.mode("overwrite").parquet(f"{path}/latest"), mode)
        return df.sparkSession.read.schema(schema).parquet(f"{path}/latest")
    run(df, lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}"), mode)
    if mode == "update":
        rows = df.sparkSession.read.parquet(path)
        values = [c for c in df.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
        return newest.select(*keys, "_newest.*").select(*df.columns)
    return df.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def first_arrivals(events: DataFrame, path: str, keys: Sequence[str] = ("trial_id",), ts: str = "ts", slot_s: int = 86_400) -> DataFrame:
    """Each event once, however often and however late it is replayed; no row is dropped for its time.

    A replay carries the key and the time of its event, so the keys seen are a stored table in partitions of ``slot_s``
    seconds of event time, and a micro-batch reads only those slots that its rows fall into. The stream has no state: memory
    grows with a micro-batch and its slots, not with the stream. Of copies within one batch any one stays. A null key equals a null
    key; rows without a time have a slot of their own. Keys of a batch are stored under its number and only those of
    earlier batches count, so a repeated batch gives the same keys again. Keys are written in ranges of (slot, key): a slot is
    few files, and a busy one is shared by several tasks.
    """
    spark, keys = events.sparkSession, list(keys)
    slot = F.coalesce(F.floor(F.unix_micros(ts) / F.lit(slot_s * 1_000_000)), F.lit(NO_TIME)).cast("long")
    marked = events.withColumn("_slot", slot)
    key_schema = marked.select(*keys, "_slot").schema.add("_batch", "long")
    spark.createDataFrame([], marked.schema).write.parquet(f"{path}/rows/_batch=-1")
    spark.createDataFrame([], marked.select(*keys).schema).write.parquet(f"{path}/keys/_batch=-1/_slot={NO_TIME}")

    def sink(batch: DataFrame, i: int) -> None:
        once = batch.dropDuplicates([*keys, "_slot"]).persist()
        slots = [r["_slot"] for r in once.select("_slot").distinct().collect()]  # one per slot of event time in the batch
        seen = spark.read.schema(key_schema).parquet(f"{path}/keys").where((F.col("_batch") < i) & F.col("_slot").isin(slots))
        seen = seen.select(F.col("_slot").alias("_s"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
        same = [F.col("_slot") == F.col("_s"), *[F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]]
        once.join(seen, same, "left_anti").write.mode("overwrite").parquet(f"{path}/rows/_batch={i}")
        once.unpersist()
        new = spark.read.schema(marked.schema).parquet(f"{path}/rows/_batch={i}").select(*keys, "_slot").repartitionByRange("_slot", *keys)
        new.write.mode("overwrite").partitionBy("_slot").parquet(f"{path}/keys/_batch={i}")

    run(marked, sink)
    return spark.read.schema(marked.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows").select(*events.columns)


def added_up(rows: DataFrame, path: str, keys: dict[str, Column], sums: dict[str, Column], fold: int = 64) -> DataFrame:
    """Sums per key over a stream that may come in any order, without state.

    A micro-batch writes its own sums under its number, so a repeat overwrites itself; every ``fold`` batches all sums so far are
    folded into one table. The result adds the newest fold and the batches after it. Nothing is kept in
    memory from batch to batch and no row is too late. ``sums`` are sums and counts of the rows of a batch.
    """
    spark = rows.sparkSession
    part = lambda df: df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(n) for n, c in sums.items()])
    schema = part(rows).schema
    kinds = {f.name: f.dataType for f in schema}
    numbered = StructType([*schema.fields, StructField("_batch", LongType())])
    for folder in ("parts", "folds"):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{folder}/_batch=-1")

    def total(upto: int) -> DataFrame:
        """Sums of the batches up to ``upto``; a fold of that very batch does not count, it may be a broken one."""
        folds = spark.read.schema(numbered).parquet(f"{path}/folds").where(F.col("_batch") < upto)
        newest = folds.agg(F.max("_batch").alias("b")).first()["b"]
        newest = -1 if newest is None else newest
        parts = spark.read.schema(numbered).parquet(f"{path}/parts").where((F.col("_batch") > newest) & (F.col("_batch") <= upto))
        both = folds.where(F.col("_batch") == newest).unionByName(parts)
        return both.groupBy(*keys).agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in sums])

    last = [-1]

    def sink(batch: DataFrame, i: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/parts/_batch={i}")
        if (i + 1) % fold == 0:
            total(i).write.mode("overwrite").parquet(f"{path}/folds/_batch={i}")
        last[0] = i

    run(rows, sink)
    return total(last[0])


# ---- sums ----------------------------------------------------------------
def model_stats(trials: DataFrame, path: str) -> DataFrame:
    """Trials, cost and mean cost per model, added up from micro-batches under ``path``; an unknown cost adds nothing."""
    sums = {"trials": F.count(F.lit(1)), "spent": F.sum(monitor.exact_cost()).cast(monitor.MONEY)}
    found = added_up(trials, path, {"model": F.col("model")}, sums)
    return found.select("model", "trials", F.col("spent").cast("double").alias("total_cost"), (F.col("spent") / F.col("trials")).cast("double").alias("mean_cost"))


def window_start(ts: str, width_s: int) -> Column:
    """First microsecond of the window of ``width_s`` seconds that holds ``ts``."""
    width = width_s * 1_000_000
    return (F.floor(F.unix_micros(ts) / F.lit(width)) * width).cast("long")


def trial_rate(trials: DataFrame, path: str, width_s: int = 60) -> DataFrame:
    """Trials per window of ``width_s`` seconds of event time, added up from micro-batches under ``path``; rows without a time count nowhere."""
    timed = trials.where(F.col("ts").isNotNull())
    return added_up(timed, path, {"start_us": window_start("ts", width_s)}, {"trials": F.count(F.lit(1))})


def run_feed(trials: DataFrame, run_id: str) -> DataFrame:
    return trials.where(F.col("run_id") == run_id)


def stale_runs(heartbeats: DataFrame, limit_s: int = STALE_SECONDS, lateness: str | None = None) -> DataFrame:
    """A run goes stale when its beats stop for ``limit_s`` seconds: the end of a session window.

    With ``lateness``, for append mode: a stale run is given once, when the newest beat of all is ``lateness`` past its end, and its state goes
    then, so the state holds the runs of the last hours only. A beat that comes at most ``lateness`` late joins its
    session; one that comes later belongs to a session that has been reported and changes nothing.

    Without, for complete mode: every session is in the result, the last of a run and however late a beat comes. State: one
    row per session, for streams that end.
    """
    beats = heartbeats.withWatermark("ts", lateness) if lateness else heartbeats
    gap = F.session_window("ts", f"{limit_s} seconds")
    return beats.groupBy("run_id", gap).agg(
        F.max("ts").alias("last"), F.count(F.lit(1)).alias("beats")
    ).select("run_id", F.unix_micros("last").alias("heartbeat_us"), "beats", F.unix_micros("session_window.end").alias("stale_us"))


# ---- alerts --------------------------------------------------------------
class Carried:
    """Small table of totals after each micro-batch, keyed by batch id."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = path or scratch_path(spark, "totals")

    def before(self, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch - 1}")

    def after(self, batch: int, totals: DataFrame) -> None:
        totals.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


TOTALS = "model string, n long, spent decimal(24,9)"


def _alerts(trials: DataFrame, path: str, find: Callable[[DataFrame, DataFrame], DataFrame], known_only: bool) -> DataFrame:
    """Alerts of ``find(batch, totals before it)`` for every micro-batch, read back as a table."""
    spark = trials.sparkSession
    carried = Carried(spark, TOTALS)
    shape: list = []

    def sink(batch: DataFrame, i: int) -> None:
        rows = batch.where(F.col("cost").isNotNull()) if known_only else batch
        rows = rows.persist()
        before = carried.before(i)
        found = find(rows, before)
        shape[:] = [found.schema]
        found.write.mode("overwrite").parquet(f"{path}/batch={i}")
        now = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(monitor.exact_cost()).cast(monitor.MONEY).alias("spent"))
        both = before.unionByName(now).groupBy("model").agg(F.sum("n").alias("n"), F.sum("spent").cast(monitor.MONEY).alias("spent"))
        carried.after(i, both)
        rows.unpersist()

    run(trials, sink)
    if not shape:  # no batch came
        return find(spark.createDataFrame([], trials.schema), carried.before(0))
    return spark.read.schema(shape[0]).option("recursiveFileLookup", True).parquet(path)


def anomalies(trials: DataFrame, path: str, multiplier: float) -> DataFrame:
    return _alerts(trials, path, lambda rows, before: monitor.cost_anomalies(rows, multiplier, before), True)


def budget_alerts(trials: DataFrame, path: str, budgets: dict[str, float]) -> DataFrame:
    return _alerts(trials, path, lambda rows, before: monitor.budget_exceeded(rows, budgets, ["model"], before), False)


def burn_alerts(trials: DataFrame, path: str, threshold: float, window_s: int = BURN_WINDOW_SECONDS) -> DataFrame:
    """Sliding spend per model; the rows of the last window are carried from batch to batch."""
    spark = trials.sparkSession
    schema = "trial_id long, model string, ts_us long, cost double"
    carried = Carried(spark, schema)
    shape: list = []

    def sink(batch: DataFrame, i: int) -> None:
        cols = ["trial_id", "model", "ts_us", "cost"]
        both = carried.before(i).withColumn("_new", F.lit(False)).unionByName(batch.select(*cols).withColumn("_new", F.lit(True))).persist()
        fresh = both.where("_new").select("trial_id")
        found = monitor.burn_rate(both, threshold, window_s).join(fresh, "trial_id", "left_semi")
        shape[:] = [found.schema]
        found.write.mode("overwrite").parquet(f"{path}/batch={i}")
        newest = both.agg(F.max("ts_us").alias("newest")).first()["newest"]  # None: nothing carried, nothing new
        since = F.lit(None if newest is None else newest - window_s * 1_000_000).cast("long")
        carried.after(i, both.where(F.col("ts_us") >= since).select(*cols))
        both.unpersist()

    run(trials, sink)
    if not shape:  # no batch came
        return monitor.burn_rate(spark.createDataFrame([], schema), threshold, window_s)
    return spark.read.schema(shape[0]).option("recursiveFileLookup", True).parquet(path)


# ---- listeners -----------------------------------------------------------
class Listeners:
    """Callbacks that get every batch of alerts as a DataFrame; a failing one does not stop the stream."""

    def __init__(self) -> None:
        self.callbacks: list[Callable[[DataFrame, int], None]] = []

    def add(self, fn: Callable[[DataFrame, int], None]) -> None:
        self.callbacks.append(fn)

    def __call__(self, batch: DataFrame, i: int) -> None:
        for fn in self.callbacks:
            try:
                fn(batch, i)
            except Exception as e:  # noqa: BLE001
                log.warning("alert listener failed: %s", e)
