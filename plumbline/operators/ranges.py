"""Ranks of the values of many columns, gathered by row, where tables of values would be about as large as the columns.

A sample cuts each column into ranges of about equally many values, and one pass counts each range exactly. The cells of a
block of rows are dealt to their ranges, sorted there, and sent back to their block with their places in the range. What
lies on disk is a few bytes for each cell and column with gaps: places grow along a range, so their differences are small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.functions.kinds import kinds, ref
from plumbline.operators.gram import matrix_sums, sum_matrices

#: Cells that one task sorts at a time.
RANGE_CELLS = 1 << 19
#: Ranks of one block of rows that a task holds at a time.
BLOCK_RANKS = 1 << 25
#: Rows of a block at most.
BLOCK_ROWS = 1 << 18
#: Rows that are drawn to cut the columns into ranges.
SAMPLE_ROWS = 50_000
#: Share of a column with few values above which a value is a range by itself.
FREQUENT = 1e-3
SEED = 42

_CELLS = "at int, part bigint, block bigint, n int, data binary"


class Ranges(NamedTuple):
    """How the columns are cut, and what lies in each range and below it, by all rows and by the rows with each partner."""

    cuts: list[np.ndarray]
    single: list[np.ndarray]
    count: list[np.ndarray]
    below: list[np.ndarray]


def ordered_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as integers or doubles, which :func:`_codes` turns into integers of the same order."""
    of = kinds(df)
    return df.select(*[ref(c).cast("bigint" if of[c] == "integer" else "double").alias(f"v{i}") for i, c in enumerate(columns)])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integers in the order of the values, NaN last and both zeros equal, and which values are present."""
    present = pc.is_valid(column).to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), present
    x = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1)), present


def _least(a: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()))) if a.size else a.astype(np.uint8)


def _packed(*arrays: np.ndarray) -> bytes:
    least = [_least(a) for a in arrays]
    data = bytes(a.itemsize for a in least) + b"".join(a.tobytes() for a in least)
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpacked(data: bytes, n: int, lists: Sequence[int]) -> list[np.ndarray]:
    """The arrays of :func:`_packed`; ``lists`` has the number of lists of ``n`` entries in each."""
    plain = pa.Codec("zstd", 1).decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    out, start = [], len(lists)
    for width, k in zip(plain, lists):
        out.append(np.frombuffer(plain, f"<u{width}", n * k, start).reshape(k, n))
        start += n * k * width
    return out


def _cells(rows: Sequence[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in _CELLS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], names=names)


def cut(rows: DataFrame, total: int, present: Sequence[int], partners: Sequence[int], few: Sequence[bool]) -> Ranges:
    """Ranges of about ``RANGE_CELLS`` values for each column of ``rows``, and their counts from one pass over all rows.

    A value that would fill half a range, or that makes up ``FREQUENT`` of a column with ``few`` values, is a range by itself
    and need not be sorted.
    """
    k = len(present)
    cuts, single = [np.zeros(0, np.int64)] * k, [np.zeros(1, bool)] * k
    if max(present) > RANGE_CELLS:
        table = rows.sample(min(1.0, SAMPLE_ROWS / total), SEED).toArrow()
        for i in range(k):
            ranges = math.ceil(present[i] / RANGE_CELLS)
            codes, there = _codes(table.column(i).combine_chunks())
            drawn = np.sort(codes[there])
            if ranges < 2 or not drawn.size:
                continue
            values, times = np.unique(drawn, return_counts=True)
            alone = values[times >= max(2, drawn.size * min(0.5 / ranges, FREQUENT if few[i] else 1))]
            after = alone[alone < np.iinfo(np.int64).max] + 1
            cuts[i] = np.unique(np.concatenate([drawn[np.arange(1, ranges) * drawn.size // ranges], alone, after]))
            single[i] = np.concatenate([[False], np.isin(cuts[i], alone)])
    first = np.concatenate([[0], np.cumsum([c.size + 1 for c in cuts])])

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((first[-1], 1 + len(partners)))
        columns = [_codes(batch.column(i)) for i in range(k)]
        for i, (codes, there) in enumerate(columns):
            found = np.searchsorted(cuts[i], codes[there], "right")
            for t, j in enumerate([i, *partners]):
                out[first[i] : first[i + 1], t] = np.bincount(found[columns[j][1][there]], minlength=first[i + 1] - first[i])
        return out

    count = matrix_sums(rows, (int(first[-1]), 1 + len(partners)), counted)
    parts = [count[first[i] : first[i + 1]] for i in range(k)]
    return Ranges(cuts, single, parts, [np.cumsum(p, 0) - p for p in parts])


def _dealt(ranges: Ranges, partners: Sequence[int], block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows cut into the cells of each range; those of single values stay with their block."""

    def of_block(table: pa.Table, block: int) -> pa.RecordBatch:
        columns = [_codes(c.combine_chunks()) for c in table.columns]
        gaps = np.zeros(table.num_rows, np.uint64)
        for t, j in enumerate(partners):
            gaps |= (~columns[j][1]).astype(np.uint64) << np.uint64(t)
        out = []
        for i, (codes, there) in enumerate(columns):
            place = np.flatnonzero(there)
            found = np.searchsorted(ranges.cuts[i], codes[place], "right")
            known = ranges.single[i][found]
            if known.any():
                out.append((i, -1 - block, block, int(known.sum()), _packed(place[known], found[known])))
            place, found = place[~known], found[~known]
            order = np.argsort(found.astype(np.min_scalar_type(ranges.cuts[i].size)), kind="stable")
            place, found = place[order], found[order]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            for a, b in zip(starts, [*starts[1:], found.size]):
                some = place[a:b]
                out.append((i, int(found[a]), block, int(b - a), _packed(np.diff(some, prepend=0), gaps[some], codes[some].view(np.uint64))))
        return _cells(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                if size + part.num_rows > block_rows:
                    yield of_block(pa.Table.from_batches(held), block)
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield of_block(pa.Table.from_batches(held), block)

    return run


def _placed(partners: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The cells of a range with their places in it, for each block of rows.

    A cell gets twice the number of smaller values plus the number of equal ones, which is twice its average rank: by all
    rows, and, as what is missing from that, by the rows without each partner.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[1].as_py() < 0:
            return table
        parts = [_unpacked(d, n, (1, 1, 1)) for d, n in zip(table["data"].to_pylist(), table["n"].to_pylist())]
        size = [p[0].size for p in parts]
        place, gaps, codes = (np.concatenate(x) for x in zip(*[(np.cumsum(p[0][0].astype(np.int64)), p[1][0].astype(np.uint64), p[2][0].astype(np.uint64).view(np.int64)) for p in parts]))
        source = np.repeat(np.arange(len(parts)), size)
        order = np.argsort(codes)
        codes, gaps = codes[order], gaps[order]
        start = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        end = np.append(start[1:], codes.size)
        value = np.repeat(np.arange(start.size), end - start)
        # Back to the blocks, and within each in the order of values.
        back = np.argsort(source[order].astype(np.min_scalar_type(len(parts))), kind="stable")
        place, value = place[order][back], value[back]
        edges = np.concatenate([[0], np.cumsum(size)])
        grown = np.empty((1 + partners, codes.size), np.int64)
        for t in range(1 + partners):
            if t:
                missing = np.concatenate([[0], np.cumsum((gaps >> np.uint64(t - 1)) & np.uint64(1), dtype=np.int64)])
            of_value = missing[start] + missing[end] if t else start + end
            at = of_value[value]
            grown[t] = np.diff(at, prepend=0)
            grown[t, edges[:-1]] = at[edges[:-1]]
        data = [_packed(place[a:b], grown[0, a:b], grown[1:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return table.set_column(table.column_names.index("data"), "data", pa.array(data, pa.binary()))

    return run


def _multiplied(ranges: Ranges, partners: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
    """Sums of products of the centred ranks of a block: of each pair of columns, and of each column by the rows with another."""
    k, p = len(ranges.cuts), len(partners)
    tag = [1 + partners.index(i) if i in partners else 0 for i in range(k)]
    total = [c.sum(0) for c in ranges.count]

    def run(table: pa.Table) -> pa.Table:
        cells = [(i, part, n, _unpacked(data, n, (1, 1) if part < 0 else (1, 1, p))) for i, part, n, data in zip(*[table[c].to_pylist() for c in ("at", "part", "n", "data")])]
        rows = 1 + max(int(lists[0].max()) for *_, lists in cells)
        ranks = np.zeros((k, 1 + p, rows))
        there = np.zeros((k, rows))
        for i, part, n, ((place,), (whole,), *missing) in cells:
            if part < 0:
                centred = (2 * ranges.below[i] + ranges.count[i] - total[i])[whole].T
            else:
                centred = np.zeros((1 + p, n))
                centred[1:] -= np.cumsum(missing[0], 1, dtype=np.int64)
                centred += np.cumsum(whole, dtype=np.int64) + (2 * ranges.below[i][part] - total[i])[:, None]
            ranks[i][:, place] = centred
            there[i, place] = 1
        out = np.zeros((2 * k, k))
        for i in range(k):
            for j in range(k):
                own = ranks[i, tag[j]]
                out[i, j] = own @ ranks[j, tag[i]]
                out[k + i, j] = (own * there[j]) @ own
        return pa.table({"row": pa.array(np.arange(2 * k, dtype=np.int32)), "sums": pa.array(list(out), pa.list_(pa.float64()))})

    return run


def rank_products(rows: DataFrame, ranges: Ranges, partners: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the products of the centred ranks, doubled, of each pair of columns among the rows with both.

    The first matrix multiplies the ranks of two columns, the second those of the row's column by themselves. ``rows`` must
    give the same rows in the same order whenever a task reads them again.
    """
    k = len(ranges.cuts)
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_RANKS // (k * (1 + len(partners)))))
    cells = rows.mapInArrow(_dealt(ranges, partners, block_rows), _CELLS)
    placed = cells.groupBy("at", "part").applyInArrow(_placed(len(partners)), _CELLS)
    parts = placed.groupBy("block").applyInArrow(_multiplied(ranges, partners), "row int, sums array<double>")
    out = sum_matrices(parts, (2 * k, k))
    return out[:k], out[k:]
