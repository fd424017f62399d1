"""What the text operators share: reading tables, tables in the shared folder, joins that check a side's size."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows and bytes in its strings.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="larder-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here, and lost executors cost no recomputation.

    The files are deleted when the application ends, for the frame that is returned reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larder/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def tidy() -> None:
    """Gives freed memory of a Python worker back: workers stay for later tasks, and what they held would count beside the JVM's."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c")) if sys.platform == "linux" else None
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def counted(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """stored(), and the number of its rows (or of those for which `what` holds), counted by the job that writes them."""
    seen = Observation()
    one = F.lit(1) if what is None else F.when(what, 1)
    return stored(df.observe(seen, F.count(one).alias("n")), label), seen.get["n"]


def dropped(df: DataFrame) -> None:
    """Deletes the files of a frame that stored() made and that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of ended jobs whose frames nothing holds any more: it does so only after the driver's JVM has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(side: DataFrame) -> DataFrame:
    """side, which should be stored, with a broadcast hint if it is small; else as it is, for a shuffled join whose skew AQE splits."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in side.dtypes if t in ("string", "binary")]
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0))).first()
    return F.broadcast(side) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else side


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that names made beside it never clash with the caller's."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns])


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """The keys are equal, null with null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
