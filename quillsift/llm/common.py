"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch sent to a Python worker. Texts may be long, so
#: batches are kept far below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_made: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; any path Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows and bytes, as one row may be megabytes.

    Results are computed lazily under the session's settings, so these bounds
    can't be set for one operator alone. They are lowered only: smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine (master local, as
    in tests) is a folder of our own made and set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillsift-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` once, dealt out by ``key`` into as many buckets as there are shuffle partitions, and read it again.

    Joins by ``key`` then read it where it lies. The table is named in the
    session's catalog and lies in the shared folder.
    """
    spark = df.sparkSession
    name = f"quillsift_{uuid.uuid4().hex}"
    path, n = f"{scratch_root(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    _made.append((spark, path))
    return spark.table(name)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    This cuts the lineage like ``checkpoint()``, survives the loss of any
    executor, is computed once only and is columnar and compressed. The tables
    are removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if (name := path.rpartition("/")[2]).startswith("quillsift_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove the table of ``materialize`` that ``df`` is, once all that is made of it is written itself."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for spark, path in [m for m in _made if folder.endswith(m[1].rpartition("/")[2])]:
            _remove(spark, path)
            _made.remove((spark, path))


@atexit.register
def _remove_made() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already; then the folder's owner clears it
            return


def bucket(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 marks held-out rows. Null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(bucket(doc_id) == 0, F.lit(False))


def learnable(doc_id: Column | str) -> Column:
    """Rows whose labels may be learned from; rows without an id may not."""
    return F.coalesce(bucket(doc_id) != 0, F.lit(False))
