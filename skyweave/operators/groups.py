"""Groups of rows that stand together in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row is one."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where groups begin and the last ends.  Rows of a group follow each other."""
    held: list[pa.RecordBatch] = []
    last = lambda b, i: tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)

    def table() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.flatnonzero(_changes(t, keys))

    for b in batches:
        if not b.num_rows:
            continue
        open_group = not held or last(b, b.num_rows - 1) == last(held[0], 0)
        held.append(b)
        if open_group and last(b, 0) == last(b, b.num_rows - 1):
            continue
        t, begin = table()
        if len(begin) > 1:
            yield t.slice(0, int(begin[-1])), begin
            held = t.slice(int(begin[-1])).combine_chunks().to_batches()
    if held:
        t, begin = table()
        yield t, np.r_[begin, t.num_rows]
