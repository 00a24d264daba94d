"""What the operators of this subpackage share: tables, scratch tables, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many bytes in all are broadcast, after their count is known.
BROADCAST_BYTES = 8 << 20
_local: dict[str, str] = {}


#: Words whose hashes a worker remembers.
MEMO = 400_000
_memos: list[dict] = []


class WordHashes(dict):
    """64-bit hashes of words, remembered as far as MEMO goes."""

    def __missing__(self, word: bytes | str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def remembered(memo: dict) -> dict:
    """Registers what an operator's kernels remember in a worker, so that it can make room for another's."""
    _memos.append(memo)
    return memo


def alone(memo: dict) -> dict:
    """`memo`, after all others in this worker are emptied: workers outlive a stage, and would hold every stage's memory."""
    for m in _memos:
        if m is not memo and m:
            m.clear()
    return memo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, whose executors
    are this process, may do without: it gets a folder of its own. Anywhere else a local folder would lose rows, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cinelake-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/cinelake/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once into a Parquet table in the shared folder: a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its counted rows fit `limit` bytes; else it stays and joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def set_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of whole texts stay small: a worker holds one batch at a time. The setting is read when a plan runs, after the operator has
    returned it, so it stays as it is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield kernel(batch)

    return df.mapInArrow(run, schema)


def shielded(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "n_chars")) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` with every column but `own` under a neutral name, so that none clashes with an operator's, and a
    function that gives a result its columns of `docs` back, in order, and what else is asked for."""
    names = docs.columns
    neutral = [c if c in own else f"_col{i}" for i, c in enumerate(names)]

    def restored(made: DataFrame, *more: str) -> DataFrame:
        return made.select(*(F.col(n).alias(c) for n, c in zip(neutral, names, strict=True)), *more)

    return docs.toDF(*neutral), restored


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """`docs` less the columns that a result's columns will take the names of."""
    return docs.drop(*names)
