"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows and bytes may be broadcast; both are counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: So many texts of a batch are worked on at once.
SLICE = 512


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return os.path.join(tempfile.gettempdir(), "chronolake-checkpoints")


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are built and run inside go when these end, not only when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fence(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The folder is spark.checkpoint.dir; only where that is unset and Spark runs
    in one process (tests) a temporary one is used. Nothing reads the shuffles
    behind a cut again, so they are removed.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    with _swept(spark):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same cut by a Parquet table in that folder, which takes less room than a checkpoint; it goes when Python ends."""
    spark = df.sparkSession
    path = f"{_shared(spark).rstrip('/')}/chronolake-{uuid.uuid4().hex}"
    with _swept(spark):
        df.select("*").write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id's text has the given remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def _width(field: T.DataType, value: Column) -> Column:
    """Bytes of a value: of texts and lists as they are, 8 for anything of fixed size."""
    if isinstance(field, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 8
    return F.lit(8 * max(1, len(field.fields) if isinstance(field, T.StructType) else 1))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if counting shows that it is small in rows and bytes, else unchanged."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    found = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("w").alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has that name."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def per_text(docs: DataFrame, columns: Sequence[str], fields: str, make: Callable[[], Callable[[list], Sequence]]) -> DataFrame:
    """``columns`` of ``docs`` and the ``fields`` (DDL) that ``make()(texts)`` gives as one list for each.

    Columns pass through as Arrow data, so that no value changes: a null beside
    64-bit numbers would make floats of them in pandas. make() runs once a task.
    """
    columns = list(dict.fromkeys(columns))
    (inner,) = spare(columns, "text_in")
    picked = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(inner))
    more = T.StructType.fromDDL(fields)
    schema = T.StructType([*picked.schema.fields[:-1], *more.fields])
    names, width = schema.names, len(columns)
    kinds = [_arrow(f.dataType) for f in more.fields]

    def of(batches):
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                made = work(batch.column(width).to_pylist())
                new = [pa.array(values, kind, from_pandas=False) for values, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=names)

    return picked.mapInArrow(of, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    fixed = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    return fixed[type(kind)]
