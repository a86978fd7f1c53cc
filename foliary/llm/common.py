"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of the word rule: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliary-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


@contextmanager
def _run_once(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile deletes its shuffle files when it has run, not whenever the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; a lost executor then costs a reread, not a recomputation."""
    shared_dir(df.sparkSession)
    with _run_once(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df may run again and then shuffles anew


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """As cut(), as a compressed table: for rows too wide to be kept as plain checkpoint files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    with _run_once(spark):
        df.select("*").write.option("compression", compression).option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of staged(), once everything made of it is itself written. Other DataFrames are left alone."""
    path = df.__dict__.get("staged_path")
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows and bytes per Arrow batch: whole texts are large, so a batch holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def copies(df: DataFrame, n: str, into: str, key: str, most: int, chunk: int = 1 << 16) -> DataFrame:
    """A row for each of the n copies that a row stands for, numbered from 0 in `into`. most is the largest n: rows of many
    copies are cut into chunks that are dealt out before they are written out."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(chunk).cast("long")))
    out = df.withColumn("__begin", begin)
    if most > chunk:
        out = out.repartition(F.col(key), F.col("__begin"))
    return out.withColumn(into, F.explode(F.sequence(F.col("__begin"), F.least(F.col(n), F.col("__begin") + chunk) - 1))).drop("__begin")


def md5_int(text: Column, digits: int = 15) -> Column:
    """A non-negative integer from the first hex digits of MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def crc32_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def in_values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation of a few plain numbers, without Python objects in the plan."""
    names = [c.split()[0] for c in schema.split(",")]
    types = [c.split()[1] for c in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)])
    body = ",".join("(" + ",".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({', '.join(names)})")


def with_made(docs: DataFrame, read: list[str], made: str, maker: Callable[[], Callable[..., list]]) -> DataFrame:
    """docs with columns made by Python, all other columns passed on as Arrow data, unseen.

    made is their DDL; a column of docs with such a name is replaced. maker() is called once per task and gives a
    function of the lists of the columns of `read` that returns one list per made column.
    """
    fields = T.StructType.fromDDL(made).fields
    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields]
    kept = [c for c in docs.columns if c not in names]
    extra = [F.col(c).alias(f"__read{i}") for i, c in enumerate(read)]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for b in batches:
            lists = make(*[b.column(n + i).to_pylist() for i in range(len(read))])
            new = [pa.array(x, t) for x, t in zip(lists, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], names=[*b.schema.names[:n], *names])

    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])
    return docs.select(*[F.col(f"`{c}`") for c in kept], *extra).mapInArrow(run, schema)
