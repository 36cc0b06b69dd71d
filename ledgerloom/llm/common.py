"""What the training-data operators share: input tables, the shared folder, staged tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder; any
    other master is an error, since a machine-local folder would lose files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, held: list[str] | None = None) -> DataFrame:
    """`df` written to the shared folder and reread: it cuts the lineage, and
    a lost executor costs only a read. The schema is kept as it was. The folder
    is added to `held`, for the caller to release."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes staged folders whose rows are no longer needed."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names` lengthened until they are no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


ROWS = 512  # texts that a worker holds as strings at once, or pairs of them
_held: dict[tuple, object] = {}


def trim() -> None:
    """Gives memory that this process has set free back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def let_go(*but: tuple) -> None:
    """Drops what this worker keeps between tasks, but for the keys named: workers outlive the operators they work for."""
    gone = [k for k in _held if k not in but]
    for k in gone:
        del _held[k]
    if gone:
        gc.collect()
        trim()


def hold(key: tuple, make):
    """What this worker keeps between tasks under `key`, made if it is not there; the rest is let go."""
    let_go(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def slices(batches):
    """Arrow batches or arrays in parts of at most ROWS rows. What the worker kept for other operators is let go."""
    let_go()
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)
    trim()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_remainder(name: str, modulus: int):
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
