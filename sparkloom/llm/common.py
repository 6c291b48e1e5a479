"""What the operators of this package share: staging, batch sizes and salted ranks."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import sparkloom
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sparkloom)

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where the session has no such setting
    (tests, a single machine) a fresh temporary folder is made once and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts the lineage and survives the loss of executors. ``release`` removes it; in a mounted folder it goes at exit too.
    What compiling and running the plan has left unused in the driver's memory goes back to the system.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    df.write.parquet(path)
    trim(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


#: The JVM's command that gives freed native memory back to the system.
TRIM = "systemTrimNativeHeap"


def trim(spark: SparkSession) -> int | None:
    """Give back to the system the memory outside the heap that the driver's JVM has freed, and return the MB it holds now.

    The C library keeps what is freed in pieces: about 290 MB after three passes of the pipeline over sf0.01. Where the JVM
    lacks the command (Java 17.0.19 on Linux has it), it is left as it is: None.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class
    own = [kind.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    types, values = array(kind, 4), array(jvm.java.lang.Object, 4)
    for k, x in enumerate(own):
        types[k] = x
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), TRIM
    try:
        # by the public interface: the server's own class is closed to other modules
        said = kind.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None
    now = re.search(r"->(\d+)M", said)
    return int(now[1]) if now else None


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "2m") -> None:
    """Hold Arrow batches to about 2 MB, so that very long texts don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks (the code of a task is new each time)."""
    held = sys.modules.setdefault("_sparkloom_kept", types.ModuleType("_sparkloom_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def join_few(df: DataFrame, few: DataFrame, on: list[str], how: str, most: int = 10_000) -> DataFrame:
    """Join a staged table that is broadcast if it has at most ``most`` rows, else shuffled."""
    return df.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, on, how)


#: A key is hot if it holds more than this part of all rows, so at most as many keys are; a hot key is dealt in pieces of about this part.
PIECES = 10_000


def join_hot(rows: DataFrame, by_key: DataFrame, on: list[str], size: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``by_key`` (a staged table of one row for each key), though one key may hold any share of the rows.

    ``size``: a column of ``by_key`` with the number of ``rows`` of its key. The rows of a hot key are dealt by a hash of the
    columns ``spread``, and its row of ``by_key`` is copied to each of its pieces: at most 2 * PIECES rows in all. What is
    broadcast is a number of pieces for each of the at most PIECES hot keys, by hash.
    """
    whole = by_key.agg(F.sum(size)).first()[0] or 0
    pieces = F.ceil(F.col("_held") * (PIECES / max(whole, 1))).cast("int")
    hot = by_key.select(F.xxhash64(*on).alias("_hash"), F.col(size).alias("_held")).groupBy("_hash").agg(F.sum("_held").alias("_held")).filter(F.col("_held") * PIECES > whole).select("_hash", pieces.alias("_pieces"))
    few = by_key.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(hot), "_hash", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
    many = rows.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(hot), "_hash", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int"), F.lit(0)))
    return many.drop("_hash", "_pieces").join(few.drop("_hash", "_pieces"), [*on, "_piece"], how).drop("_piece")


def dense_rank_in(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``keys``, without one task per key.

    Rows are salted by a hash of ``order`` (whose values together should be unique; of equal ones any comes first).
    Each (keys, salt) is numbered by itself; the offsets of the salts come from their counts, of which there are
    at most ``salts`` for each key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*keys, "_salt"]).withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_salt", "_rank", "_before")
