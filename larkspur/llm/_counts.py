"""Counts of hashed n-grams by class over a whole corpus, summed where the data are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm._text import slices

CHUNK = 1024


def class_counts(rows: DataFrame, buckets: int, index: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """rows: (class string, text). index gives the bucket of each n-gram of some texts and the first n-gram of each
    text (one more entry at the end). Each task adds up its own rows; then tasks add up one chunk of buckets of one
    class each. The driver gets ``buckets`` numbers a class."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                found, first = index(part)
                names = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                owner = np.repeat(np.arange(len(part)), np.diff(first))
                label = {name: i for i, name in enumerate(dict.fromkeys(names))}
                of_text = np.array([label[name] for name in names])
                for name, i in label.items():
                    mine = found if len(label) == 1 else found[of_text[owner] == i]
                    sums.setdefault(name, np.zeros(buckets, np.int64))
                    sums[name] += np.bincount(mine, minlength=buckets)
        for name, s in sums.items():
            parts = s.reshape(-1, CHUNK)
            yield pa.record_batch([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["name", "chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"name": table.column("name").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    ddl = "name string, chunk int, counts binary"
    out: dict[str, np.ndarray] = {}
    for name, chunk, counts in rows.mapInArrow(partial, ddl).groupBy("name", "chunk").applyInArrow(add, ddl).toLocalIterator():
        out.setdefault(name, np.zeros(buckets, np.int64))[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.int64)
    return out
