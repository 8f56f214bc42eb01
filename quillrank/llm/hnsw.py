"""Hierarchical navigable small-world graphs in numpy: many searches go hand in hand.

Layers are nested random subsets of the vectors; each layer links a vector to some near
ones that lie in different directions. A search descends from the top layer and keeps a
beam of the best vectors of the bottom layer, expanding those whose links it has not
followed. All searches of a block take their steps together, so the work is done on arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16  # links that a vector chooses; twice as many may come back to it in the bottom layer
BUILD_BEAM = 48
BLOCK = 512  # searches that go together
EXPAND = 4  # vectors that a search expands in a step
EXACT = 1024  # up to so many vectors of a layer are compared directly while it is built


@dataclass
class Graph:
    """`vectors` (unit rows, float32); for each layer the vectors in it (ascending, all at the bottom) and their links."""

    vectors: np.ndarray
    members: list[np.ndarray]
    links: list[np.ndarray]

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, *(x for pair in zip(self.members, self.links, strict=True) for x in pair)]


def layers_of(n: int, seed: int = 7) -> np.ndarray:
    """The highest layer of each vector: geometric with ratio LINKS, the same in every run."""
    draw = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(np.int64)


def build(vectors: np.ndarray) -> Graph:
    """The graph of unit vectors, layer by layer from the top."""
    level = layers_of(len(vectors))
    graph = Graph(np.ascontiguousarray(vectors, dtype=np.float32), [], [])
    for layer in range(int(level.max(initial=0)), -1, -1):
        members = np.flatnonzero(level >= layer)
        _add_layer(graph, members, 2 * LINKS)
    graph.members.reverse()
    graph.links.reverse()
    return graph


def _add_layer(graph: Graph, members: np.ndarray, most: int) -> None:
    """Links `members` among each other; layers above exist already (in order from the top)."""
    vectors = graph.vectors[members]
    n = len(members)
    links = np.full((n, most), -1, dtype=np.int32)
    order = np.random.default_rng(n).permutation(n)
    above = graph.members[-1] if graph.members else None
    # vectors of the layer above come first: they are where searches enter
    if above is not None:
        first = np.searchsorted(members, above)
        order = np.concatenate((first, order[~np.isin(order, first)]))
    done = 0
    while done < n:
        size = min(n - done, BLOCK if done + BLOCK <= EXACT or done >= EXACT else EXACT - done)
        new = order[done : done + size]
        if done <= EXACT:
            known = order[: done + size]
            sims = vectors[new] @ vectors[known].T
            sims[np.arange(size), done + np.arange(size)] = -np.inf
            near = known[_best(sims, BUILD_BEAM)]
        else:
            entry = _descend(graph, vectors[new], members)
            near, _ = search_layer(vectors, links, vectors[new], entry, BUILD_BEAM)
            own = vectors[new] @ vectors[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.concatenate((near, new[_best(own, LINKS)]), axis=1)
        chosen = _diverse(vectors, new, near, LINKS)
        links[new, : chosen.shape[1]] = chosen
        _link_back(vectors, links, new, chosen)
        done += size
    graph.members.append(members)
    graph.links.append(links)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1), 1)


def _diverse(vectors: np.ndarray, new: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Up to k of each row's candidates: near ones that are nearer to the vector than to any chosen one, then the nearest others."""
    sims = np.einsum("ij,ikj->ik", vectors[new], vectors[np.maximum(near, 0)])
    sims[(near < 0) | (near == new[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(near.shape, dtype=bool)
    again[:, 1:] = (near[:, 1:] == near[:, :-1]) & (near[:, 1:] >= 0)
    sims[again] = -np.inf
    among = np.matmul(vectors[np.maximum(near, 0)], vectors[np.maximum(near, 0)].transpose(0, 2, 1))
    rows, width = near.shape
    taken = np.zeros((rows, width), dtype=bool)
    closest = np.full((rows, width), -np.inf, dtype=np.float32)  # to a chosen one
    count = np.zeros(rows, dtype=np.int64)
    for j in range(width):
        good = (sims[:, j] > closest[:, j]) & (sims[:, j] > -np.inf) & (count < k)
        taken[good, j] = True
        count += good
        closest[good] = np.maximum(closest[good], among[good, j])
    # the rest in order of nearness, until there are k
    rank = np.where(taken, 0, 1) + np.where(sims == -np.inf, 2, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :k]
    out = np.take_along_axis(near, order, 1)
    out[np.take_along_axis(sims, order, 1) == -np.inf] = -1
    return out.astype(np.int32)


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links to `new` from what they have chosen; full lists keep diverse links."""
    most = links.shape[1]
    target, source = chosen.ravel(), np.repeat(new, chosen.shape[1]).astype(np.int32)
    some = target >= 0
    target, source = target[some], source[some]
    # of many links to one vector the nearest `most` count
    near = np.einsum("ij,ij->i", vectors[target], vectors[source])
    order = np.lexsort((-near, target))
    target, source = target[order], source[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    keep = place < most
    target, source, place = target[keep], source[keep], place[keep]
    who, row = np.unique(target, return_inverse=True)
    back = np.full((len(who), most), -1, dtype=np.int32)
    back[row, place] = source
    both = np.concatenate((links[who], back), axis=1)
    both[:, most:][(both[:, most:, None] == both[:, None, :most]).any(2)] = -1  # links that exist
    room = (both >= 0).sum(1) <= most
    packed = np.take_along_axis(both[room], np.argsort(both[room] < 0, axis=1, kind="stable"), 1)
    links[who[room]] = packed[:, :most]
    full = np.flatnonzero(~room)
    for a in range(0, len(full), BLOCK):
        some = full[a : a + BLOCK]
        links[who[some]] = _diverse(vectors, who[some], both[some], most)


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, similarities) of each query's beam, best first, -1 where there are fewer; `entry` has rows of vectors to start from."""
    rows, n = len(queries), len(vectors)
    seen = np.zeros((rows, n), dtype=bool)
    ids = np.full((rows, beam), -1, dtype=np.int32)
    sims = np.full((rows, beam), -np.inf, dtype=np.float32)
    done = np.ones((rows, beam), dtype=bool)
    active, fresh = np.arange(rows), entry
    while len(active):
        row = np.repeat(active, fresh.shape[1])
        found = fresh.ravel()
        new = found >= 0
        new[new] = ~seen[row[new], found[new]]
        row, found = row[new], found[new]
        key = np.unique(row.astype(np.int64) * n + found)
        row, found = key // n, (key % n).astype(np.int32)
        seen[row, found] = True
        value = np.einsum("ij,ij->i", queries[row], vectors[found])
        start = np.searchsorted(row, active)
        count = np.searchsorted(row, active, side="right") - start
        some = count > 0
        touched, start, count = active[some], start[some], count[some]
        if len(touched):
            width = int(count.max())
            at = np.minimum(start[:, None] + np.arange(width), len(found) - 1)
            inside = np.arange(width) < count[:, None]
            all_ids = np.concatenate((ids[touched], np.where(inside, found[at], -1)), axis=1)
            all_sims = np.concatenate((sims[touched], np.where(inside, value[at], -np.inf).astype(np.float32)), axis=1)
            all_done = np.concatenate((done[touched], ~inside), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[touched], sims[touched], done[touched] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_done))
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            break
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :EXPAND]
        chosen = np.take_along_axis(ids[active], pick, 1)
        chosen = np.where(np.take_along_axis(done[active], pick, 1), -1, chosen)
        done[active[:, None], pick] = True
        fresh = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
    return ids, sims


def _descend(graph: Graph, queries: np.ndarray, below: np.ndarray, from_top: bool = True) -> np.ndarray:
    """Where searches enter the layer `below` (its vectors): found in the layers above, which come in order from the top."""
    if not graph.members:
        return np.zeros((len(queries), 1), dtype=np.int32)
    pairs = list(zip(graph.members, graph.links, strict=True))
    if not from_top:
        pairs = pairs[:0:-1]
    entry = None
    for members, links in pairs:
        vectors = graph.vectors[members]
        if entry is None:
            start = np.tile(np.arange(min(len(members), 8), dtype=np.int32), (len(queries), 1))
        else:
            start = np.searchsorted(members, entry).astype(np.int32)
        found, _ = search_layer(vectors, links, queries, start, 8)
        found = np.where(found[:, :4] < 0, found[:, :1], found[:, :4])
        entry = members[found]
    return np.searchsorted(below, entry).astype(np.int32) if entry is not None else np.zeros((len(queries), 1), dtype=np.int32)


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, similarities) of the beams of unit `queries` at the bottom layer."""
    beam = min(beam, len(graph.vectors))
    out_ids, out_sims = np.empty((len(queries), beam), np.int32), np.empty((len(queries), beam), np.float32)
    for a in range(0, len(queries), BLOCK):
        block = queries[a : a + BLOCK]
        entry = _descend(graph, block, graph.members[0], from_top=False)
        out_ids[a : a + BLOCK], out_sims[a : a + BLOCK] = search_layer(graph.vectors, graph.links[0], block, entry, beam)
    return out_ids, out_sims
