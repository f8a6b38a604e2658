"""Whole groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of several groups that are worked on together.
TOGETHER = 50_000


def whole_groups(keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table | None]) -> Callable:
    """A function over batches sorted by ``keys`` that gives ``work`` some whole groups at a time, with the number of each row's group."""
    def groups_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            groups = groups_of(table)
            upto = int(np.searchsorted(groups, groups[-1]))
            if upto:
                done = work(table.slice(0, upto), groups[:upto])
                yield from done.to_batches()
            held, size = table.slice(upto).to_batches(), table.num_rows - upto
        if size:
            table = pa.Table.from_batches(held)
            yield from work(table, groups_of(table)).to_batches()

    return run
