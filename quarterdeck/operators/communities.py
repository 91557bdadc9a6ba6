"""Communities of one group's graph in memory: the rounds of ``graph.modularity_communities`` on arrays."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    )
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def turns(ids: np.ndarray, salt: int) -> np.ndarray:
    """Spark's ``xxhash64(id, salt)`` of a bigint and an int."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P5 + np.uint64(8)
        h = h ^ (_turned(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
        h = _mixed(_turned(h, 27) * _P1 + _P4) + _P5 + np.uint64(4)
        h = h ^ (np.uint64(salt) * _P1)
        return _mixed(_turned(h, 23) * _P2 + _P3).view(np.int64)


def modularity(u: np.ndarray, v: np.ndarray, w: np.ndarray, label: np.ndarray, resolution: float) -> float:
    total, a, b = w.sum(), label[u], label[v]
    volume = np.bincount(a, w, len(label)) + np.bincount(b, w, len(label))
    return float(w[a == b].sum() / total - resolution * (volume**2).sum() / (4 * total * total))


def communities(
    first: np.ndarray, second: np.ndarray, weight: np.ndarray, resolution: float, tolerance: float, max_levels: int, max_moves: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with an edge and their communities (connected, named by their smallest member)."""
    ids, ends = np.unique(np.concatenate((first, second)), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(ids))
    score = modularity(a, b, weight, label, resolution)
    u, v, w = a, b, weight
    for level in range(max_levels):
        moved = _moved(u, v, w, ids, resolution, level, max_moves)
        merged = moved[label]
        reached = modularity(a, b, weight, merged, resolution)
        if not reached > score + tolerance:
            return ids, ids[_parts(a, b, label)]
        label, score = merged, reached
        pairs, at = np.unique(np.minimum(moved[u], moved[v]) * len(ids) + np.maximum(moved[u], moved[v]), return_inverse=True)
        u, v, w = pairs // len(ids), pairs % len(ids), np.bincount(at, w)
    raise RuntimeError("Communities did not settle.")


def _moved(u, v, w, ids: np.ndarray, resolution: float, level: int, max_moves: int) -> np.ndarray:
    """Community of every node when no node wants to move."""
    n, total = len(ids), w.sum()
    k = np.bincount(u, w, n) + np.bincount(v, w, n)
    plain = u != v
    source, end, weight = np.concatenate((u[plain], v[plain])), np.concatenate((v[plain], u[plain])), np.tile(w[plain], 2)
    community = np.arange(n)
    target, gain = community.copy(), np.zeros(n)
    dirty = np.ones(n, bool)
    for number in range(max_moves):
        volume = np.bincount(community, k, n)
        # Only nodes with a changed community next to them, or in one, weigh their options anew.
        anew = dirty[community]
        anew[source[dirty[community[end]]]] = True
        some, nodes = anew[source], np.flatnonzero(anew)
        keys = np.concatenate((source[some] * n + community[end[some]], nodes * n + community[nodes]))
        pairs, at = np.unique(keys, return_inverse=True)
        inside = np.bincount(at, np.concatenate((weight[some], np.zeros(len(nodes)))))
        node, option = pairs // n, pairs % n
        own = option == community[node]
        others = volume[option] - np.where(own, k[node], 0.0)
        value = np.round(inside - resolution * k[node] * others / (2 * total), 12)
        starts = np.searchsorted(node, nodes)
        best = np.maximum.reduceat(value, starts) if len(nodes) else value
        # The smallest community of the best ones: options of a node are in their order.
        hits = np.flatnonzero(value == np.repeat(best, np.diff(np.append(starts, len(node)))))
        target[nodes] = option[hits[np.searchsorted(hits, starts)]]
        gain[nodes] = best - value[own]
        wanting = np.flatnonzero(gain > 0)
        if not len(wanting):
            return community
        moving = _that_add_up(wanting, turns(ids, number + 1000 * level), community, target, gain, k, source, end, weight, resolution / (2 * total))
        dirty = np.zeros(n, bool)
        dirty[community[moving]] = dirty[target[moving]] = True
        community[moving] = target[moving]
    raise RuntimeError("Moves did not settle.")


def _that_add_up(wanting, turn, community, target, gain, k, source, end, weight, scale: float) -> np.ndarray:
    """Moves of ``graph._moves_that_add_up``: their gain exceeds all that the moves before them can take."""
    wants = np.zeros(len(community), bool)
    wants[wanting] = True
    place = np.empty(len(community), np.int64)
    place[wanting[np.lexsort((wanting, turn[wanting]))]] = np.arange(len(wanting))
    met = wants[source] & wants[end]
    x, y, w = source[met], end[met], weight[met]
    earlier = place[y] < place[x]
    x, y, w = x[earlier], y[earlier], w[earlier]
    times = (community[y] == target[x]).astype(np.int64) + (target[y] == community[x])
    lost = np.bincount(x, w * times, len(community))[wanting]

    def volume_before(group: np.ndarray) -> np.ndarray:
        order = np.lexsort((place[wanting], group))
        sums = np.cumsum(k[wanting][order]) - k[wanting][order]
        new = np.append(True, group[order][1:] != group[order][:-1])
        out = np.empty(len(wanting))
        out[order] = sums - sums[new][np.cumsum(new) - 1]
        return out

    crowd = volume_before(target[wanting]) + volume_before(community[wanting])
    return wanting[gain[wanting] - scale * k[wanting] * crowd - lost > 0]


def _parts(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest member of each node's connected part of its community."""
    inside = label[u] == label[v]
    u, v = u[inside], v[inside]
    part = np.arange(len(label))
    while True:
        before = part.copy()
        least = np.minimum(part[u], part[v])
        np.minimum.at(part, u, least)
        np.minimum.at(part, v, least)
        # Roots that were met take the smaller one as well, so paths shorten by more than a step.
        np.minimum.at(part, before[u], least)
        np.minimum.at(part, before[v], least)
        while (part != part[part]).any():
            part = part[part]
        if (part == before).all():
            return part
