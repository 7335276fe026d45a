"""Written intermediate tables and batch helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine sets none (tests), a temporary folder is made once for the
    application; on a cluster that raises ValueError.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = _OWN.setdefault(context.applicationId, "")
        if not path:
            path = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts lineage the way ``checkpoint()`` does, but keeps column pruning for the readers
    and survives the loss of any executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that goes to a Python worker, at most.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends texts to Python workers in small batches.

    Spark counts rows, of which the default is ten thousand; whole texts are larger than what
    that suits, and the batches of all of an executor's workers are in memory together.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``most`` bytes of text; one text stays whole."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
        total = pc.cumulative_sum(size.cast(pa.int64())).to_numpy()
        first = 0
        while first < len(total):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(total.searchsorted(before + most, "right")))
            yield batch.slice(first, last - first)
            first = last
