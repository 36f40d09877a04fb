"""Structured Streaming: telemetry into keyed tables, sessions, and change batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.redact import PATTERNS, with_redaction
from ..operators.metrics import percentile_by_index
from ..operators.resolve import resolve_points
from ..operators.snapshots import keyed_upsert, newest


def batch_calls(points: DataFrame, source: str, now: str) -> DataFrame:
    """symbol_id, source, count, p50_ms, p95_ms, first_seen, last_seen of one batch of resolved points (symbol_id,
    calls, duration_ms). Percentiles are by nearest rank, of this batch alone; points without a symbol do not count."""
    known = points.where("symbol_id is not null")
    n = F.col("n")
    p = percentile_by_index(known, ["symbol_id"], "duration_ms", {"p50_ms": F.expr("(n - 1) div 2"), "p95_ms": F.bround(0.95 * (n - 1), 0)}).drop("n")
    g = known.groupBy("symbol_id").agg(F.sum("calls").alias("count"))
    return g.join(p, "symbol_id", "left").select("symbol_id", F.lit(source).alias("source"), "count", "p50_ms", "p95_ms", F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"))


def merge_calls(state: DataFrame, batch: DataFrame, most: int | None = None) -> DataFrame:
    """The state with a batch: counts add, percentiles and last_seen come from the batch, first_seen stays; the newest ``most`` rows."""
    out = keyed_upsert(state, batch, ["symbol_id", "source"], ["count"], ["p50_ms", "p95_ms", "last_seen"], ["first_seen"])
    return newest(out, most, [F.desc("last_seen"), F.asc("symbol_id"), F.asc("source")]) if most else out


def unmapped(points: DataFrame, source: str, now: str) -> DataFrame:
    """file, line, name, source, count, last_seen of points that no symbol was found for; null lines are one key."""
    return points.where("symbol_id is null").groupBy("file", "line", "name").agg(F.sum("calls").alias("count")).withColumn("source", F.lit(source)).withColumn("last_seen", F.lit(now))


class CallIngest:
    """A sink for ``foreachBatch``: redacts, resolves, aggregates and merges spans (pid, file, line, name, calls, duration_ms).

    The state is written whole under the number of the batch, and a batch that is there already is not merged
    again, so a replay after a failure leaves the counts right.
    """

    def __init__(self, symbols: DataFrame, path: str, source: str, now: Callable[[], str], most: int | None = None):
        self.symbols, self.path, self.source, self.now, self.most = symbols, path, source, now, most

    def _last(self, spark: SparkSession) -> int:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()[6:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        return max(done, default=-1)

    def state(self, spark: SparkSession) -> DataFrame | None:
        last = self._last(spark)
        return spark.read.parquet(f"{self.path}/batch={last}") if last >= 0 else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = self._last(spark)
        if number <= last:
            return
        clean = with_redaction(batch, "name", PATTERNS[-2:]).drop("fired")
        points = resolve_points(clean.select("pid", "file", "line", "name"), self.symbols).select("pid", "symbol_id").join(clean.select("pid", "calls", "duration_ms"), "pid")
        fresh = batch_calls(points, self.source, self.now())
        out = merge_calls(spark.read.parquet(f"{self.path}/batch={last}"), fresh, self.most) if last >= 0 else fresh
        out.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 1) -> DataFrame:
    """A stream of the files that arrive in a folder, so many a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def session_totals(stream: DataFrame, key: str, ts: str, gap: str, late: str, amount: str) -> DataFrame:
    """key, start, end, total of sessions that a gap ends, given out once ``late`` has passed; works on tables too."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.sum(amount).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total")


def windowed_counts(stream: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str | None, late: str) -> DataFrame:
    """keys, start, n of windows over time; rows later than ``late`` drop out of a stream."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def debounced(stream: DataFrame, apply: Callable[[DataFrame], None], key: str, ts: str, checkpoint: str) -> StreamingQuery:
    """Give ``apply`` the last change of each key of every batch: changes that came together count once."""

    def one(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), ts).alias("r")).select("r.*")
        apply(last)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
