"""A table's points as an append-only Parquet change log, resolved when read."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.keys import MAX_METRIC_LENGTH, Key, key_columns, point_schema, tag_column
from .files import Files

PUT, DELETE = "P", "D"
#: Seconds of a bucket of the log unless a table sets another width.
BUCKET = 86_400
#: The widths in seconds that a history is usually compacted to, from the newest part to the oldest.
WINDOWS = (86_400, 604_800, 2_592_000, 7_776_000, 15_552_000, 31_536_000, 94_608_000)
#: Rows written one by one that are held, each in a small file of its own, before they become a batch.
PENDING = 10_000
#: Keys whose newest order is broadcast at most, some 40 MB.
BOUNDED = 200_000


def bucket_of(timestamp: Column | str, width: int) -> Column:
    """Start of the window that holds a timestamp."""
    return F.floor(F.col(timestamp) / width if isinstance(timestamp, str) else timestamp / width).cast("bigint") * width


def undominated(log: DataFrame, keys: Sequence[str], leading: Column) -> DataFrame:
    """Leave out rows below the largest ``leading`` of their key; of a key's rows that have it all stay.

    Hash aggregation finds these without a sort. They are broadcast for at most
    BOUNDED keys; the rows of other keys all stay.
    """
    most = log.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max(leading).alias("__most")).limit(BOUNDED)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    held = log.join(F.broadcast(most), same, "left").where(F.col("__most").isNull() | (leading >= F.col("__most")))
    return held.select(*log.columns)


def latest(log: DataFrame, tags: Iterable[str], order: Sequence[Column], extra: Sequence[str] = (), leading: Column | None = None) -> DataFrame:
    """The newest row of every key, deletions included.

    Predicates on key columns move below the window, and its group limit drops
    older rows before the shuffle. ``extra`` are columns that follow from the
    key, such as the bucket, and let their predicates move down too. A log whose
    rows write all metrics at once has no column for the metric.

    The group limit sorts all rows of a task. Where keys are far fewer than rows,
    ``leading`` spares that: what the order compares first, larger ones and those
    that aren't null being newer.
    """
    keys = [*extra, *(c for c in key_columns(tags) if c in log.columns)]
    newest = Window.partitionBy(*keys).orderBy(*order)
    rows = log if leading is None else undominated(log, keys, leading)
    return rows.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def current(log: DataFrame, tags: Iterable[str], order: Sequence[Column], extra: Sequence[str] = (), leading: Column | None = None) -> DataFrame:
    """The live points: newest row of every key, unless that is a deletion."""
    return latest(log, tags, order, extra, leading).where(F.col("op") == PUT)


class ChangeLog:
    """The stored log of one table and its description; one writer at a time.

    A batch first reserves a number in the description and counts once the
    description names that number as written, so a batch that a crash cut off
    never counts, also not when others follow. Single writes are kept in files of
    their own until they become a batch; what a crash has left of them is read
    when the log is opened. The description names the folder in force, so
    compaction writes a new folder and then points to it; folders that a lazy
    DataFrame may still read stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, width: int = BUCKET):
        self.spark, self.path, self.files = spark, path, Files(spark)
        self._view: DataFrame | None = None
        if self.files.exists(f"{path}/table.json") or self.files.exists(f"{path}/table.json.new"):
            self.state = {"reserved": 0, "lost": [], "bands": [], "streams": {}} | self.files.read_json(f"{path}/table.json")
        else:
            self.files.make(path)
            self.state = {"tags": [], "width": width, "bands": [], "generation": 0, "seq": 0, "reserved": 0, "lost": [], "compacted": 0, "streams": {}}
            self._save()
        self._pending: list[tuple] = [tuple(self.files.read_json(f"{self._held}/{name}")) for name in self.files.names(self._held) if name.endswith(".json")]

    @property
    def _held(self) -> str:
        return f"{self.path}/pending"

    def _save(self, **changes) -> None:
        """Change the description; nothing changes here if it can't be written."""
        state = self.state | changes
        self.files.write_json(f"{self.path}/table.json", state)
        self.state = state

    @property
    def tags(self) -> list[str]:
        return sorted(self.state["tags"])

    @property
    def width(self) -> int:
        return self.state["width"]

    @property
    def folder(self) -> str:
        return f"{self.path}/log-{self.state['generation']}"

    @property
    def populated(self) -> bool:
        """True once anything was written, a deletion too, until clear()."""
        return bool(self._pending) or self.state["seq"] > 0

    def bucket(self, timestamp: int) -> int:
        """The bucket of a timestamp: its window's start. It grows with the timestamp, whatever the bands."""
        width = next((w for before, w in self.state["bands"] if timestamp < before), self.width)
        return timestamp // width * width

    def _bucket(self) -> Column:
        out = bucket_of("timestamp", self.width)
        for before, width in reversed(self.state["bands"]):
            out = F.when(F.col("timestamp") < before, bucket_of("timestamp", width)).otherwise(out)
        return out

    def set_tags(self, tags: Iterable[str]) -> None:
        tags = sorted(tags)
        if len({t.lower() for t in tags}) < len(tags):
            raise EngineError("Tag columns must differ by more than case.")
        self._save(tags=tags)

    def _schema(self) -> T.StructType:
        more = [("op", T.StringType()), ("seq", T.LongType()), ("nth", T.LongType()), ("bucket", T.LongType())]
        return T.StructType([*point_schema(self.tags), *(T.StructField(n, t) for n, t in more)])

    def put(self, key: Key, value: float | None) -> None:
        """Keep one write (None: a deletion) in a file of its own until flush()."""
        row = (key.timestamp, key.metric, *(key.tags.get(t) for t in self.tags), value)
        self.files.write_json(f"{self._held}/{len(self._pending):012d}.json", row)
        self._pending.append(row)
        self._changed()
        if len(self._pending) >= PENDING:
            self.flush()

    def flush(self) -> None:
        """Append the kept writes as one batch. If that is broken off they stay, and a second time changes nothing."""
        if self._pending:
            rows = self.spark.createDataFrame([(*r, n) for n, r in enumerate(self._pending)], T.StructType([*point_schema(self.tags), T.StructField("nth", T.LongType())]))
            self._append(rows.withColumn("op", F.when(F.col("value").isNull(), DELETE).otherwise(PUT)).coalesce(1))
            self._pending = []
            self.files.remove(self._held)

    def append(self, points: DataFrame, order: Column | None = None, op: str = PUT, stream: tuple[str, int] | None = None) -> None:
        """Append a batch: timestamp, metric, value and any of tag_<key>. Of equal keys in it the largest ``order`` wins.

        A timestamp that is null or negative, a metric that is null, empty or too
        long and, for writes, a null value fail the batch. ``stream`` names a
        stream and the number of its batch: one that was written before is left
        out.
        """
        if stream and self.state["streams"].get(stream[0], -1) >= stream[1]:
            return
        self.flush()
        right = F.coalesce((F.col("timestamp") >= 0) & F.length("metric").between(1, MAX_METRIC_LENGTH), F.lit(False))
        if op == PUT:
            right &= F.col("value").isNotNull()
        stamp = F.when(right, F.col("timestamp")).otherwise(F.raise_error(F.lit("Invalid timestamp, metric or value.")))
        columns = [stamp.cast("bigint").alias("timestamp"), F.col("metric").cast("string")]
        columns += [(F.col(tag_column(t)) if tag_column(t) in points.columns else F.lit(None)).cast("string").alias(tag_column(t)) for t in self.tags]
        columns += [(F.col("value") if op == PUT else F.lit(None)).cast("double").alias("value")]
        columns += [(F.monotonically_increasing_id() if order is None else order).cast("bigint").alias("nth"), F.lit(op).alias("op")]
        wrong = [c for c in points.columns if c.startswith("tag_") and c[4:] not in self.tags]
        if wrong:
            raise EngineError(f"Tag '{wrong[0][4:]}' is not in the table's tag columns.")
        self._append(points.select(*columns), {"streams": self.state["streams"] | {stream[0]: stream[1]}} if stream else {})

    def _append(self, rows: DataFrame, more: dict | None = None) -> None:
        before = max(self.state["seq"], self.state["reserved"])
        lost = [*self.state["lost"], *range(self.state["seq"] + 1, before + 1)]
        self._save(reserved=before + 1, lost=sorted(set(lost)))
        rows = rows.withColumns({"seq": F.lit(before + 1).cast("bigint"), "bucket": self._bucket()})
        self._write(rows.select(*[f.name for f in self._schema()]), self.folder)
        self._save(seq=before + 1, **(more or {}))
        self._changed()

    def _write(self, rows: DataFrame, folder: str) -> None:
        # rows of a bucket come together before they are written, a few files per bucket; adaptive execution splits a bucket that is too large for one task
        dealt = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "metric", "timestamp")
        out = dealt.write.mode("append").partitionBy("bucket")
        for c in ("metric", *map(tag_column, self.tags)):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(folder)

    def log(self) -> DataFrame:
        """All stored rows, newer and older, of the batches that count."""
        self.flush()
        if self.state["seq"] == 0 or not self.files.exists(self.folder):
            return self.spark.createDataFrame([], self._schema())
        rows = self.spark.read.schema(self._schema()).parquet(self.folder).where(F.col("seq") <= self.state["seq"])
        return rows.where(~F.col("seq").isin(self.state["lost"])) if self.state["lost"] else rows

    def points(self) -> DataFrame:
        """The live points. Straight after a compaction the stored rows are just these."""
        if self._view is not None:
            return self._view
        log = self.log()
        if self.state["compacted"] == self.state["seq"]:
            return log.drop("op", "seq", "nth")
        return current(log, self.tags, [F.desc("seq"), F.desc("nth")], ["bucket"]).drop("op", "seq", "nth")

    def cache(self) -> None:
        """Keep the live points in memory and on local disks until the next write."""
        if self._view is None:
            self._view = self.points().persist()

    def _changed(self) -> None:
        if self._view is not None:
            self._view.unpersist()
            self._view = None

    def compact(self, width: int | None = None, bands: Sequence[Sequence[int]] | None = None) -> None:
        """Rewrite the live points alone as a new generation, in buckets of ``width`` seconds.

        ``bands`` are (end, width) in order of time: points before the first end
        get its width, and so on. Each end is a multiple of its width.
        """
        points, generation = self.points(), self.state["generation"] + 1
        former = self.state
        self.state = former | {"width": width or self.width, "bands": [list(b) for b in (bands if bands is not None else [] if width else former["bands"])]}
        try:
            rows = points.drop("bucket").withColumns({"op": F.lit(PUT), "seq": F.lit(self.state["seq"]).cast("bigint"), "nth": F.lit(0).cast("bigint"), "bucket": self._bucket()})
            self.files.remove(f"{self.path}/log-{generation}")  # what a broken-off compaction has left
            self._write(rows.select(*[f.name for f in self._schema()]), f"{self.path}/log-{generation}")
            self._save(generation=generation, compacted=self.state["seq"], lost=[])
        except BaseException:
            self.state = former
            raise
        self._changed()

    def compact_by_age(self, now: int) -> None:
        """Compact with buckets that widen with age: points older than a window of WINDOWS lie in buckets of its width."""
        ends = [((now - w) // w * w, w) for w in reversed(WINDOWS) if w > self.width]
        self.compact(bands=[(end, w) for end, w in ends if end > 0])

    def vacuum(self) -> None:
        """Remove the folders of former generations."""
        for name in self.files.folders(self.path):
            if name.startswith("log-") and name != f"log-{self.state['generation']}":
                self.files.remove(f"{self.path}/{name}")

    def clear(self) -> None:
        """Forget all points; the tag columns stay and may be changed again."""
        self._pending = []
        self.files.remove(self._held)
        former = self.folder
        self._save(generation=self.state["generation"] + 1, seq=0, reserved=0, lost=[], compacted=0)
        self.files.remove(former)
        self._changed()

    def statistics(self) -> dict[str, int]:
        """Number of batches, files and buckets in force."""
        self.flush()
        files = self.log().inputFiles() if self.state["seq"] else []
        return {"batches": self.state["seq"] - len(self.state["lost"]), "files": len(files), "buckets": len({f.rsplit("/", 2)[1] for f in files})}

    def windows(self) -> DataFrame:
        """(bucket, points): number of live points in each bucket."""
        return self.points().groupBy("bucket").agg(F.count("*").alias("points"))
