"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words for the operators that split on white space.
SPACES = "[ \\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder so that a lost executor does not lose them.

    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    A temporary one is made only if it names none and the master is local, as in tests; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what nothing names any more, and gives the driver's free memory back.

    Spark finds them when the driver collects its garbage, which a driver of small plans seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Gives what malloc holds free in the driver's two processes back to the system, where it knows how to."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    try:
        jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        named = jvm.java.lang.Class.forName
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By reflection, since the server's own class is not open to calls from here.
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def known(key: Column) -> Column:
    """The key as text that tells a null from an empty one."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def one_of_each(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose (id, text hash) is in stay (k, h): one of each, with all columns of docs."""
    k, h, n = fresh(docs, "_k", "_h", "_n")
    keyed = docs.withColumn(k, known(F.col(id_col))).withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(stay.select(F.col("k").alias(k), F.col("h").alias(h)).distinct(), [k, h], "left_semi")
    return joined.withColumn(n, F.row_number().over(Window.partitionBy(k, h).orderBy(k))).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def fold_case(text: Column) -> Column:
    """A-Z to lower case; every other character stays, as lower() would not have it."""
    return F.translate(text, UPPER, LOWER)


def fold_case_once(text: Column) -> Column:
    """The same, by lower() where the text is all ASCII: faster where the result is used once.

    What is used several times is better without the condition, under which Spark computes it anew
    for each use.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold_case(text))


def space_words(text: Column) -> Column:
    """Array of the words between white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
