"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters A-Z become lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is neither a letter nor a digit becomes a space.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def space_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased; bytes.split() cuts at exactly these six bytes."""
    return text.translate(LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or what setCheckpointDir was given."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):  # one machine, as in tests: any folder is shared
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that what builds on it has no lineage to repeat."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows go to Python at once, unless the session has a setting of its own: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own
        spark.conf.set(key, str(rows))


def slim(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, can't clash with what an operator adds."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def quoted(df: DataFrame, name: str) -> Column:
    """A column of df by its exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def fold(bucket: str) -> Column:
    """crc32 of a key written as text; a null key counts as empty."""
    return F.crc32(F.coalesce(F.col(bucket).cast("string"), F.lit("")))


def carried(df: DataFrame, *without: str) -> Column:
    """All columns of df but some as one struct, whatever their names; never empty."""
    name = "none of them"
    while name in df.columns:
        name += "_"
    return F.struct(F.lit(0).alias(name), *[quoted(df, c).alias(c) for c in df.columns if c not in without])


def rows(batches: Iterable[pa.RecordBatch], size: int = 2000, column: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size`, so that long texts don't pile up in one.

    If a string or binary column is named by its place, a batch also ends where this column has `most` bytes; a
    single longer text is a batch of its own.
    """
    for batch in batches:
        if column is None:
            cuts = [*range(0, batch.num_rows, size), batch.num_rows]
        else:
            until = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts, at = [0], 0
            while at < batch.num_rows:
                within = int(np.searchsorted(until, (until[at - 1] if at else 0) + most, "right"))
                at = min(at + size, max(within, at + 1))
                cuts.append(at)
        for at, end in zip(cuts, cuts[1:]):
            yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()  # a worker outlives its task; what it doesn't use goes back
