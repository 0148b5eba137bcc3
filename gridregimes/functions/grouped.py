"""Series as numpy arrays inside tasks: sorted rows stream through, many series at a time, each one whole.

A task holds the series of a batch, or one longer series. Kernels work on all of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: (values by column, bounds of the series in them) to (series of each row of the result, its columns).
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def by_series(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """(keys, ``schema``): what ``kernel`` makes of the other columns of each series, its rows sorted by ``order``.

    Columns of numbers come as doubles, a null as NaN. A NaN in the result is null. Series without rows have none.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    names = [c for c, t in df.dtypes if c not in keys and t not in ("date", "timestamp", "timestamp_ntz", "string")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keys)
    out_names = [x.split()[0] for x in schema.split(", ")]
    ints = [x.split()[1] != "double" for x in schema.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]

    def made(pieces: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(pieces).combine_chunks()
        starts = _starts(table, keys)
        values = {c: pc.cast(table[c], pa.float64()).fill_null(float("nan")).to_numpy() for c in names}
        own, columns = kernel(values, np.r_[starts, len(table)])
        heads = table.select(ordered).take(pa.array(starts[own]))
        arrays = [heads[c].combine_chunks() if isinstance(heads[c], pa.ChunkedArray) else heads[c] for c in ordered]
        arrays += [pa.array(x, t) if i else pa.array(x, t, mask=np.isnan(x)) for x, i, t in zip(columns, ints, types)]
        return pa.RecordBatch.from_arrays(arrays, [*ordered, *out_names])

    ordered = [c for c in df.columns if c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[pa.Table] = []  # the last series, which may go on
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            starts = _starts(table, keys)
            same = not pieces or len(_starts(pa.concat_tables([pieces[-1].slice(len(pieces[-1]) - 1), table.slice(0, 1)]), keys)) == 1
            if not same:
                yield made(pieces)
                pieces = []
            if len(starts) > 1:
                yield made([*pieces, table.slice(0, starts[-1])])
                pieces = []
            pieces.append(table.slice(starts[-1]))
        if pieces:
            yield made(pieces)

    return rows.mapInArrow(run, f"{kinds}, {schema}").select(*keys, *out_names)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a series begins."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in keys:
        coded = table[name].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        at = coded.indices.fill_null(-1).to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return np.flatnonzero(new)


def by_length(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(series, their rows as a matrix of places) for each length."""
    size = np.diff(bounds)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        yield own, bounds[own][:, None] + np.arange(n)


def sign_sums(t: np.ndarray, v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each series, sorted by t and then v: pairs with t and v rising less those with v falling; ties count nothing.

    Pairs that fall are counted bit by bit of the ranks of v: the first bit in which two ranks differ decides, so at each
    bit every 0 counts the earlier 1s that share the bits above. n log n steps for all series together.
    """
    groups, n = len(bounds) - 1, len(v)
    own = np.repeat(np.arange(groups), np.diff(bounds))

    def tied(*columns: np.ndarray) -> np.ndarray:
        """Pairs of neighbours that agree in all columns, by series."""
        new = np.r_[True, np.any([x[1:] != x[:-1] for x in (own, *columns)], axis=0)][:n]
        starts = np.flatnonzero(new)
        m = np.diff(np.r_[starts, n]).astype(np.int64)
        return _sums(own[starts], m * (m - 1) // 2, groups)

    order = np.lexsort((v, own))
    sorted_v = v[order]
    new = np.r_[True, (sorted_v[1:] != sorted_v[:-1]) | (own[order][1:] != own[order][:-1])][:n]
    dense = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = dense - np.repeat(dense[bounds[:-1]], np.diff(bounds))
    in_v = np.diff(np.r_[np.flatnonzero(new), n]).astype(np.int64)
    same_v = _sums(own[order][new], in_v * (in_v - 1) // 2, groups)

    falling, start, end, at = np.zeros(groups, np.int64), bounds[own], bounds[own + 1], np.arange(n)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = rank >> bit & 1
        before = np.r_[0, np.cumsum(one)]
        ones = before[:-1] - before[start]
        zeros = end - start - (before[end] - before[start])
        falling += _sums(own, np.where(one == 0, ones, 0), groups)
        to = np.where(one == 0, at - ones, start + zeros + ones)
        new_start, new_end = np.where(one == 0, start, start + zeros), np.where(one == 0, start + zeros, end)
        moved = np.empty((3, n), np.int64)
        moved[:, to] = rank, new_start, new_end
        rank, start, end = moved
    size = np.diff(bounds).astype(np.int64)
    total = size * (size - 1) // 2 - tied(t) - same_v + tied(t, v) - 2 * falling
    return np.where(_sums(own, np.isnan(v), groups) > 0, np.nan, total)


def _sums(own: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums by series; ``own`` does not fall."""
    total = np.r_[0, np.cumsum(values.astype(np.int64))]
    edges = np.searchsorted(own, np.arange(groups + 1))
    return total[edges[1:]] - total[edges[:-1]]


def grid_sums(values: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """:func:`sign_sums` of pairs in different rows and columns of a table of counts (row, col, count)."""
    out = []
    for i, j in zip(bounds[:-1], bounds[1:]):
        row, col = (np.unique(values[x][i:j], return_inverse=True)[1] for x in ("row", "col"))
        counts = np.zeros((row.max() + 1, col.max() + 1), np.int64)
        counts[row, col] = values["count"][i:j].astype(np.int64)
        before = np.cumsum(counts, 0) - counts
        less = np.cumsum(before, 1) - before
        more = before.sum(1, keepdims=True) - less - before
        out.append(float((counts * (less - more)).sum()))
    return np.arange(len(out)), [np.array(out)]
