"""How a subject's description evolves: entries kept in order, and which of them change it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An entry nearer than this to the last one says nothing new; one that is on average less near than this to
#: the last three is a change; a timeline has so many entries.
REPEATS, CHANGES, RECENT, ENTRIES = 0.80, 0.55, 3, 200


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    length = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return max(0.0, min(1.0, float(a @ b) / length)) if length > 0 else 0.0


def track(entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(key, id, ts, is_change) of each key's last `most` entries that say something new, of key, ts, id, vector.

    Entries are taken in the order of ts and id. One is left out if its cosine with the last kept one is over .80, and is
    a change if its mean cosine with the last three kept ones is under .55 (a key's first never is). A missing key, time
    or vector leaves an entry out; vectors of zeros or of another length than those before are like nothing.

    Partitions are sorted and read as a stream, and all that is held of a key is its last three vectors, so a key of very
    many entries takes its time but no memory.
    """
    given = entries.where("key IS NOT NULL AND ts IS NOT NULL AND vector IS NOT NULL").select("key", "ts", "id", F.col("vector").cast("array<double>").alias("vector"))
    ordered = given.repartition("key").sortWithinPartitions("key", "ts", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for batch in batches:
            take, change = [], []
            vectors = batch.column(3)
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != key:
                    key, kept = own, []
                v = vectors[i].values.to_numpy(zero_copy_only=False)
                near = [_similarity(v, k) if len(v) == len(k) else 0.0 for k in kept]
                if near and near[-1] > REPEATS:
                    continue
                take.append(i)
                change.append(bool(near) and sum(near) / len(near) < CHANGES)
                kept = [*kept, v][-RECENT:]
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(change, pa.bool_())], names=["key", "ts", "id", "is_change"])

    schema = given.select("key", "ts", "id").schema.add("is_change", "boolean")
    found = ordered.mapInArrow(run, schema)
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))
    return found.withColumn("last", last).where(F.col("last") <= most).select("key", "id", "ts", "is_change")
