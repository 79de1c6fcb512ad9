"""Links of cells of two frames: one-to-one assignments over sparse edges, and distances of pixel sets."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

from lapsegrid.functions.kernels import assign

#: Rows times columns above which a graph that is nearly complete is solved as a matrix.
DENSE = 40_000
#: Distances of outline pixels taken at once.
BLOCK = 1 << 20


def assign_edges(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (left, right: cells; weight not negative) of a one-to-one choice of greatest total weight.

    Shortest augmenting paths over the edges alone: a cell may also stay single at no weight, so no edge is made up. A path
    ends in the part of the graph that it starts in. Graphs that are nearly complete and large are solved as a matrix.
    """
    if not len(weight):
        return np.zeros(0, dtype=np.int64)
    rows, a = np.unique(left, return_inverse=True)
    cols, b = np.unique(right, return_inverse=True)
    best: dict[tuple[int, int], int] = {}
    for k in np.lexsort((np.arange(len(weight)), -weight)).tolist():  # the heaviest of parallel edges
        best.setdefault((int(a[k]), int(b[k])), k)
    if len(rows) * len(cols) > DENSE and 2 * len(best) > len(rows) * len(cols):
        matrix = np.zeros((len(rows), len(cols)))
        for (i, j), k in best.items():
            matrix[i, j] = weight[k]
        pairs = assign(matrix)
    else:
        edges: list[list[tuple[int, float]]] = [[] for _ in rows]
        for (i, j), k in sorted(best.items()):
            edges[i].append((j, float(weight[k])))
        pairs = _augmented(edges, len(cols), float(weight.max()))
    return np.array(sorted(best[p] for p in pairs if p in best), dtype=np.int64)


def _augmented(edges: list[list[tuple[int, float]]], n_cols: int, most: float) -> list[tuple[int, int]]:
    u, v, of_col, of_row = [0.0] * len(edges), [0.0] * n_cols, [-1] * n_cols, [-1] * len(edges)
    for start in range(len(edges)):
        away: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        seen, heap = {start: 0.0}, []
        row, d, single, last = start, 0.0, float("inf"), start
        while True:
            if d + most - u[row] < single:  # this row stays single
                single, last = d + most - u[row], row
            for j, w in edges[row]:
                if j not in done:
                    new = d + most - w - u[row] - v[j]
                    if new < away.get(j, float("inf")):
                        away[j], via[j] = new, row
                        heappush(heap, (new, j))
            while heap and (heap[0][1] in done or heap[0][0] > away[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] > single:
                total, col = single, of_row[last]
                of_row[last] = -1
                break
            d, j = heappop(heap)
            if of_col[j] < 0:
                total, col = d, j
                break
            done[j] = d
            row = of_col[j]
            seen[row] = d
        for r, x in seen.items():
            u[r] += total - x
        for j, x in done.items():
            v[j] -= total - x
        while col >= 0:  # hand each column on the way to the row before it
            row = via[col]
            of_col[col] = row
            of_row[row], col = col, of_row[row]
            if row == start:
                break
    return [(r, j) for r, j in enumerate(of_row) if j >= 0]


def outline(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of a set's pixels that have a 4-neighbour outside the set."""
    span = int(x.max()) - int(x.min()) + 3
    code = (y - y.min()) * span + x - x.min() + 1
    known = np.sort(code)
    inside = np.ones(len(code), dtype=bool)
    for step in (1, -1, span, -span):
        at = np.minimum(np.searchsorted(known, code + step), len(known) - 1)
        inside &= known[at] == code + step
    return np.flatnonzero(~inside)


def set_distances(one: list[tuple[np.ndarray, np.ndarray]], two: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(shared pixels, least distance) of each set of ``one`` with each of ``two``, as matrices. A set is (y, x) whole numbers
    without repeats, and not empty. Shared pixels come from one sort of all pixels; what is apart is nearest at its outline."""
    width = 1 + max(int(x.max()) for _, x in (*one, *two))
    owner = [np.repeat(np.arange(len(s)), [len(y) for y, _ in s]) for s in (one, two)]
    code = [np.concatenate([y.astype(np.int64) * width + x for y, x in s]) for s in (one, two)]
    order = np.argsort(code[1], kind="stable")
    low = np.searchsorted(code[1][order], code[0], side="left")
    n = np.searchsorted(code[1][order], code[0], side="right") - low
    other = owner[1][order][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    shared = np.bincount(np.repeat(owner[0], n) * len(two) + other, minlength=len(one) * len(two)).reshape(len(one), len(two))
    edge = [[(y[k], x[k]) for y, x in s for k in [outline(y, x)]] for s in (one, two)]
    y2, x2 = (np.concatenate([p[c] for p in edge[1]]).astype(float) for c in (0, 1))
    starts = np.cumsum([0, *(len(p[0]) for p in edge[1][:-1])])
    away = np.zeros(shared.shape)
    for i, (y, x) in enumerate(edge[0]):
        if (shared[i] > 0).all():
            continue
        near = np.full(len(two), np.inf)
        step = max(1, BLOCK // len(y2))
        for k in range(0, len(y), step):
            square = ((y[k : k + step, None] - y2) ** 2 + (x[k : k + step, None] - x2) ** 2).min(axis=0)
            near = np.minimum(near, np.minimum.reduceat(square, starts))
        away[i] = np.where(shared[i] > 0, 0.0, np.sqrt(near))
    return shared, away
