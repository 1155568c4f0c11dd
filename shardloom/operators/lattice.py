"""Exact nearest points by rings of lattice cells, for the points that a task holds."""

from __future__ import annotations

import numpy as np

from shardloom.operators.grouped import pairs

#: Pairs of points that are held at once; that are all looked at, as that costs less than a lattice.
PAIRS, FEW = 1 << 20, 1 << 14


def _cells(y: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The lattice's corner and its cells' width: about k + 1 points to a cell, were they spread over the box that holds them."""
    low, span = y.min(axis=0), np.ptp(y, axis=0)
    wide = span[span > 0]
    if not len(wide):
        return low, 1.0
    width = float(np.exp((np.log(wide).sum() + np.log((k + 1) / len(y))) / len(wide)))
    return low, max(width, float(wide.max()) / (1 << 20), np.finfo(float).tiny)


def _ranked(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, skip_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs, each row's k nearest: row, column, squared distance, rank from 0."""
    if skip_own:
        row, col = row[row != col], col[row != col]
    away = sum((x[row, j] - y[col, j]) ** 2 for j in range(x.shape[1]))
    order = np.lexsort((col, np.round(away, 6), row))
    row, col, away = row[order], col[order], away[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return tuple(z[rank < k] for z in (row, col, away, rank))


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip_own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance, rank from 0) of the k nearest rows of y for every row of x; equal distances (to 6
    digits) in the order of y. ``skip_own``: row i of y is no neighbour of row i of x.

    Points are in cells by their first two coordinates. A row looks at the cells around its own, at twice as many to each side
    if it has to, until the k-th distance is less than the way to the cells it has not seen, which is a bound for all
    further coordinates too. So of n points spread over a plane about n log n are looked at. Rows with a coordinate
    that is not finite are nobody's neighbours and have none.
    """
    fine_x, fine_y = np.flatnonzero(np.isfinite(x).all(axis=1)), np.flatnonzero(np.isfinite(y).all(axis=1))
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
    if not len(fine_x) or not len(fine_y) or k < 1:
        return none
    if len(fine_x) * len(fine_y) <= FEW:
        row, col = np.repeat(fine_x, len(fine_y)), np.tile(fine_y, len(fine_x))
        return _ranked(row, col, x, y, k, skip_own)
    dims = min(2, x.shape[1])
    low, width = _cells(y[fine_y, :dims], k)
    cell_x, cell_y = (np.floor((z[:, :dims] - low) / width).astype(np.int64) for z in (x[fine_x], y[fine_y]))
    if dims == 1:
        cell_x, cell_y = (np.concatenate([np.zeros_like(c), c], axis=1) for c in (cell_x, cell_y))
    most = cell_y.max(axis=0)
    stride = int(most[1]) + 1
    code = cell_y[:, 0] * stride + cell_y[:, 1]
    order = np.argsort(code, kind="stable")
    code, at_y = code[order], fine_y[order]
    active, reach, found = np.arange(len(fine_x)), 1, []
    while len(active):
        columns = np.arange(-reach, reach + 1)
        own = cell_x[active]
        first, last = np.clip(own[:, 1] - reach, 0, stride), np.clip(own[:, 1] + reach, -1, stride - 1)
        column = own[:, :1] + columns
        inside = (column >= 0) & (column <= most[0]) & (first <= last)[:, None]
        start = np.where(inside, np.searchsorted(code, column * stride + first[:, None], "left"), 0)
        stop = np.where(inside, np.searchsorted(code, column * stride + last[:, None], "right"), 0)
        sizes = (stop - start).sum(axis=1)
        whole = (own - reach <= 0).all(axis=1) & (own + reach >= most).all(axis=1)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1).tolist(), len(active)]
        again = []
        for a, b in zip(edges, edges[1:], strict=False):
            n, begin = (stop[a:b] - start[a:b]).ravel(), start[a:b].ravel()
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            mine, col = np.repeat(fine_x[active[a:b]], sizes[a:b]), at_y[at]
            mine, col, away, rank = _ranked(mine, col, x, y, k, skip_own)
            far, kth = np.full(len(x), np.inf), rank == k - 1
            far[mine[kth]] = away[kth]
            done = whole[a:b] | (far[fine_x[active[a:b]]] + 1e-5 < (reach * width) ** 2)
            ends = np.zeros(len(x), bool)
            ends[fine_x[active[a:b]]] = done
            found.append(tuple(z[ends[mine]] for z in (mine, col, away, rank)))
            again.append(active[a:b][~done])
        active, reach = np.concatenate(again), reach * 2
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def nearest_in_groups(x: np.ndarray, at: np.ndarray, k: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` among the rows of each group, which begin at ``at`` (and the last ends there); a row is no neighbour of itself. Of small
    groups all pairs are looked at together. ``side`` (0 or 1 of each row): only rows of the other side are neighbours."""
    size, fine = np.diff(at), np.isfinite(x).all(axis=1)
    few = size * size <= FEW
    found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))]
    for row, col in pairs(at[:-1][few], size[few], PAIRS):
        own = fine[row] & fine[col] & (row != col if side is None else side[row] != side[col])
        found.append(_ranked(row[own], col[own], x, x, k, False))
    for a, b in zip(at[:-1][~few], at[1:][~few], strict=True):
        if side is None:
            row, col, away, rank = nearest(x[a:b], x[a:b], k, skip_own=True)
            found.append((row + a, col + a, away, rank))
            continue
        sides = [a + np.flatnonzero(side[a:b] == s) for s in (0, 1)]
        for own, other in (sides, sides[::-1]):
            row, col, away, rank = nearest(x[own], x[other], k)
            found.append((own[row], other[col], away, rank))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))
