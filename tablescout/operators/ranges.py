"""What tasks do with batches of columns that are ranked range by range.

A column is cut at sorted edges. Slot ``2 k + 1`` holds the values equal to edge ``k``, slot
``2 k`` those between it and the edge before. A value at an edge is ranked by the counts of the
slots; the others are ranked among the rows of their slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Batches = Iterator[pa.RecordBatch]

BLOCK = 32_768  # rows whose ranks are put together at once, or up to twice as many
COUNTS = "i int, slot int, n bigint"
CELLS = "_row bigint, i int, below bigint, at binary, v binary"
RANKED = "_row bigint, i int, at binary, rank binary"
PRODUCTS = "i int, xy double, xx double, yy double, n bigint"


def _numbers(column: pa.Array) -> np.ndarray:
    """Missing values as NaN, which no given value is."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _slots(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    if not edges.size:
        return np.zeros(values.size, np.int64)
    at = np.searchsorted(edges, values)
    return 2 * at + (edges[np.minimum(at, edges.size - 1)] == values)


def slot_counts(edges: list[list[float]]) -> Callable[[Batches], Batches]:
    """The rows of each slot of each column, as ``COUNTS``."""

    def count(batches: Batches) -> Batches:
        cuts = [np.array(e, np.float64) for e in edges]
        totals = [np.zeros(2 * e.size + 1, np.int64) for e in cuts]
        for batch in batches:
            for e, total, column in zip(cuts, totals, batch.columns):
                values = _numbers(column)
                total += np.bincount(_slots(values[~np.isnan(values)], e), minlength=total.size)
        for i, total in enumerate(totals):
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(slots.size, i, np.int32)), pa.array(slots.astype(np.int32)), pa.array(total[slots])],
                ["i", "slot", "n"],
            )

    return count


def _blocks(batches: Batches) -> Iterator[pa.Table]:
    """Consecutive rows, less than ``2 * BLOCK`` at once."""
    held = []
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(start, BLOCK))
            if sum(x.num_rows for x in held) >= BLOCK:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers, each as the bytes of a row of its own."""
    offsets = (np.append(0, ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(rows: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows and where each row's end."""
    parts = rows.to_pylist()
    ends = np.cumsum([len(x) for x in parts]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), ends


def cells(edges: list[list[float]], counts: list[dict[int, int]]) -> Callable[[Batches], Batches]:
    """Rows, numbered in the first column, as ``CELLS``: one row per block, column and slot.

    It holds the places in the block and the values there. ``below``, the number of smaller
    values outside the slot, names the slot. Values at edges come with their ranks instead, all of
    a block and column together, under a negative number.
    """

    def deal(batches: Batches) -> Batches:
        cuts = [np.array(e, np.float64) for e in edges]
        below, ranks = [], []
        for e, found in zip(cuts, counts):
            n = np.array([found.get(s, 0) for s in range(2 * e.size + 1)], np.int64)
            below.append(np.cumsum(n) - n)
            ranks.append(below[-1] + (n + 1) / 2)
        for block in _blocks(batches):
            first = block.column(0)[0].as_py()
            for i, e in enumerate(cuts):
                values = _numbers(block.column(i + 1))
                slots = _slots(values, e).astype(np.int16)
                at_edge = slots % 2 == 1
                known = np.flatnonzero(at_edge)
                if known.size:
                    # Blocks have numbers of their own, so that their ranks spread over the tasks.
                    yield _cells(first, i, [-1 - first], known, ranks[i][slots[known]], [known.size])
                at = np.flatnonzero(~at_edge & ~np.isnan(values))
                if at.size:
                    at = at[np.argsort(slots[at], kind="stable")]
                    ends = np.append(np.flatnonzero(np.diff(slots[at])) + 1, at.size)
                    yield _cells(first, i, below[i][slots[at[ends - 1]]], at, values[at], ends)

    return deal


def _cells(first: int, i: int, below, at: np.ndarray, values: np.ndarray, ends) -> pa.RecordBatch:
    n = len(ends)
    columns = [
        pa.array(np.full(n, first, np.int64)), pa.array(np.full(n, i, np.int32)), pa.array(np.array(below, np.int64)),
        _packed(at.astype(np.uint16), ends), _packed(values, ends),
    ]
    return pa.RecordBatch.from_arrays(columns, ["_row", "i", "below", "at", "v"])


def ranked(slot: pa.Table) -> pa.Table:
    """The cells of one slot with average ranks for values, as ``RANKED``."""
    below, found = slot["below"][0].as_py(), slot["v"]
    if below >= 0:
        values, ends = _unpacked(found, np.float64)
        order = np.argsort(values)
        inner = values[order]
        starts = np.append(0, np.flatnonzero(inner[1:] != inner[:-1]) + 1)
        same = np.diff(np.append(starts, inner.size))
        ranks = np.empty(inner.size)
        ranks[order] = np.repeat(below + starts + (same + 1) / 2, same)
        found = _packed(ranks, ends)
    return pa.Table.from_arrays([slot["_row"], slot["i"], slot["at"], found], ["_row", "i", "at", "rank"])


def _ranks(block: pa.Table, lists: int) -> np.ndarray:
    """The ranks of a block of rows by list and place, NaN where there is none."""
    at, ends = _unpacked(block["at"], np.uint16)
    ranks, _ = _unpacked(block["rank"], np.float64)
    out = np.full((lists, int(at.max()) + 1), np.nan)
    out[np.repeat(block["i"].to_numpy(), np.diff(np.append(0, ends))), at] = ranks
    return out


def rows_of(lists: int) -> Callable[[pa.Table], pa.Table]:
    """The ranked cells of a block as rows ``_row, r0, r1, ...``."""

    def gather(block: pa.Table) -> pa.Table:
        out = _ranks(block, lists)
        kept = np.flatnonzero(~np.isnan(out).all(axis=0))
        columns = [pa.array(block["_row"][0].as_py() + kept)]
        columns += [pa.array(r[kept], mask=np.isnan(r[kept])) for r in out]
        return pa.Table.from_arrays(columns, ["_row", *[f"r{k}" for k in range(lists)]])

    return gather


def products(pairs: list[tuple[int, int]], means: list[float]) -> Callable[[pa.Table], pa.Table]:
    """Per pair of lists with the same rows, a block's sums of products of deviations, as ``PRODUCTS``."""

    def multiply(block: pa.Table) -> pa.Table:
        ranks = _ranks(block, len(means))
        there = ~np.isnan(ranks)
        apart = np.where(there, ranks - np.array(means)[:, None], 0.0)
        total, present = apart @ apart.T, there.sum(axis=1)
        a, b = (np.array(side, np.int64) for side in zip(*pairs))
        squares = np.diag(total)
        found = [np.arange(len(pairs), dtype=np.int32), total[a, b], squares[a], squares[b], present[a]]
        return pa.Table.from_arrays([pa.array(x) for x in found], ["i", "xy", "xx", "yy", "n"])

    return multiply
