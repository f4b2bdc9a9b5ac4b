"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; longer texts come alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in the session's ``spark.checkpoint.dir``, which driver and executors share.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="umbraline-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    return base if base.lower() not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


#: Rows of one key from which it may be hot; hot keys hold a thousandth of all rows or more.
HOT_ROWS = 50_000


def joined_to_unique(rows: DataFrame, unique: DataFrame, key: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` inner-joined to ``unique``, which has one row for each ``key`` and says in ``n`` how many rows bear it.

    Keys with more than ``hot_rows`` rows and a thousandth of all ``total`` rows are no more
    than a thousand, so their rows of ``unique`` are sent to the rows; other keys meet by
    shuffling.  ``unique`` must be materialised (it is read up to three times); ``n`` is dropped.
    """
    least = max(hot_rows, total // 1000)
    plain = unique.drop("n")
    if total <= least or not unique.where(F.col("n") > least).limit(1).count():
        return rows.join(plain, key)
    hot = F.broadcast(unique.where(F.col("n") > least).drop("n"))
    others = rows.join(F.broadcast(unique.where(F.col("n") > least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(plain, key))


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing ones never matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a higher-order function would repeat it)."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of one column stay under ``most`` bytes, or come alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of up to ``most`` characters in all, or of one longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield texts[start:]
