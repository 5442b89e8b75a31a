"""Walks over sorted rows, for operators whose next step depends on what the last one stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_AT_ONCE = 10_000


def fold_sorted(rows: DataFrame, walk: Callable[[Iterator[tuple]], Iterator[tuple]], out: str) -> DataFrame:
    """``walk`` of the rows of each task, as tuples in the order in which they come; ``out`` names and types the results.

    The caller deals rows out by key and sorts them. Rows come in Arrow batches, so whole numbers stay whole and nulls
    stay null. A task holds a batch and what ``walk`` keeps.
    """
    fields = [tuple(f.split()) for f in out.split(", ")]
    names, types = [n for n, _ in fields], [_TYPES[t] for _, t in fields]

    def batch(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for row in walk(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])):
            made.append(row)
            if len(made) >= _AT_ONCE:
                yield batch(made)
                made = []
        yield batch(made)

    return rows.mapInArrow(each, out)
