"""A robust-pruned flat graph over unit vectors, held in arrays: build, prune, range search."""

from __future__ import annotations

import numpy as np

#: Neighbours a node keeps, expansions of a search, slack of the pruning rule (on squared distance).
DEGREE = 24
EFFORT = 48
SLACK = 1.44
#: In-range nodes that one query expands in one step.
_WAVE = 8


def medoid(x: np.ndarray) -> int:
    """The node nearest to the mean."""
    return int(np.argmax(x @ x.mean(axis=0)))


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours (nodes x degree, -1 for none): the nearest candidate is kept and all candidates much nearer
    to it than to the node are struck out, until none is left. candidates holds -1 for none."""
    chosen = np.full((len(nodes), degree), -1, dtype=np.int64)
    if not candidates.size:
        return chosen
    open_ = (candidates >= 0) & (candidates != nodes[:, None])
    near = x[np.maximum(candidates, 0)]
    distance = np.where(open_, 1 - np.einsum("bd,bcd->bc", x[nodes], near), np.inf)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = distance.argmin(axis=1)
        usable = np.isfinite(distance[rows, best])
        if not usable.any():
            break
        chosen[usable, k] = candidates[rows, best][usable]
        between = 1 - np.einsum("bd,bcd->bc", near[rows, best], near)
        struck = SLACK * between <= distance
        struck |= candidates == candidates[rows, best][:, None]
        distance[struck & usable[:, None]] = np.inf
    return chosen


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, effort: int = EFFORT,
           reach: float = np.inf) -> np.ndarray:
    """Similarities (queries x nodes, -inf where not met) of a best-first search from the entries (queries x e).

    A query expands its best node `effort` times; beyond that it goes on while nodes within reach are left, all of which
    are expanded: the search widens until the range is used up.
    """
    n, m = len(queries), len(x)
    met = np.full((n, m), -np.inf)
    fresh = np.full((n, m), -np.inf)  # similarity of met nodes not yet expanded
    spent = np.zeros(n, dtype=np.int64)

    def meet(q: np.ndarray, node: np.ndarray) -> None:
        new = (node >= 0) & ~np.isfinite(met[q, np.maximum(node, 0)])
        pairs = np.unique(q[new] * m + node[new])
        for begin in range(0, len(pairs), 200_000):
            a, b = np.divmod(pairs[begin:begin + 200_000], m)
            met[a, b] = fresh[a, b] = np.einsum("pd,pd->p", queries[a], x[b])

    meet(np.repeat(np.arange(n), entries.shape[1]), entries.ravel())
    active = np.arange(n)
    while len(active):
        view = fresh[active]
        best = view.argmax(axis=1)
        value = view[np.arange(len(active)), best]
        on = np.isfinite(value) & ((spent[active] < effort) | (value >= reach))
        active, best, view = active[on], best[on], view[on]
        if not len(active):
            break
        q, node = active, best
        if np.isfinite(reach):
            wide = np.argpartition(-view, min(_WAVE, m - 1), axis=1)[:, :_WAVE]
            inside = np.take_along_axis(view, wide, axis=1) >= reach
            a, b = inside.nonzero()
            q, node = np.concatenate([q, active[a]]), np.concatenate([node, wide[a, b]])
        fresh[q, node] = -np.inf
        spent[active] += 1
        near = graph[node]
        meet(np.repeat(q, near.shape[1]), near.ravel())
    return met


def build(x: np.ndarray, degree: int = DEGREE, effort: int = EFFORT) -> np.ndarray:
    """Adjacency (nodes x degree, -1 for none) of rows of x, in the order given: nodes join in growing batches, each
    searches the graph so far from the medoid, prunes what it met, and is offered to its neighbours."""
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n < 2:
        return graph
    start = min(n, 2 * degree)
    first = np.arange(start)
    graph[first] = robust_prune(x, first, np.tile(first, (start, 1)), degree)
    done = start
    while done < n:
        batch = np.arange(done, min(n, done + min(done, 512)))
        entry = np.full((len(batch), 1), medoid(x[:done]))
        met = search(x[:done], graph[:done], x[batch], entry, effort)
        inside = x[batch] @ x[batch].T
        np.fill_diagonal(inside, -np.inf)
        both = np.concatenate([met, inside], axis=1)  # nodes of one batch see each other too
        width = min(3 * degree, both.shape[1])
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        top = np.where(np.isfinite(np.take_along_axis(both, top, axis=1)), top, -1)
        graph[batch] = robust_prune(x, batch, top, degree)
        done = int(batch[-1]) + 1
        _offer(x, graph, batch, degree)
    return graph


def _offer(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int) -> None:
    """Back edges: each new node becomes a candidate of its neighbours, which prune if they hold too many."""
    source = np.repeat(batch, degree)
    target = graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("pd,pd->p", x[source], x[target]), target))
    source, target = source[order], target[order]
    nodes, begins = np.unique(target, return_index=True)
    place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
    near = place < 2 * degree  # the nearest of very many; pruning would leave no more
    offers = np.full((len(nodes), 2 * degree), -1, dtype=np.int64)
    offers[np.searchsorted(nodes, target[near]), place[near]] = source[near]
    graph[nodes] = robust_prune(x, nodes, np.concatenate([graph[nodes], offers], axis=1), degree)
