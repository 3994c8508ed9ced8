"""Orders for bounded lists on the driver: tiles for a cache, lists by share."""

from __future__ import annotations

from collections import OrderedDict


def hilbert(x: int, y: int, side: int) -> int:
    d, s = 0, side // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s //= 2
    return d


def hilbert_order(nx: int, ny: int) -> list[int]:
    side = 1
    while side < max(nx, ny):
        side *= 2
    return sorted(range(nx * ny), key=lambda i: hilbert(i % nx, i // nx, side))


def misses(order: list[int], cameras: dict[int, set[int]], cache: int) -> int:
    """Images that have to be loaded when tiles are done in this order and the least recently used image goes first."""
    held: OrderedDict[int, None] = OrderedDict()
    n = 0
    for t in order:
        for c in sorted(cameras.get(t, ())):
            if c in held:
                held.move_to_end(c)
            else:
                n += 1
                held[c] = None
                if len(held) > cache:
                    held.popitem(last=False)
    return n


def cache_order(nx: int, ny: int, cameras: dict[int, set[int]], cache: int) -> list[int]:
    """Tiles so that each needs few images that aren't held; the Hilbert order where that misses less."""
    fallback = hilbert_order(nx, ny)
    rank = {t: k for k, t in enumerate(fallback)}
    left, held, order = set(range(nx * ny)), OrderedDict(), []
    by_camera: dict[int, set[int]] = {}
    for t, cs in cameras.items():
        for c in cs:
            by_camera.setdefault(c, set()).add(t)
    while left:
        near = {t for c in held for t in by_camera.get(c, ()) if t in left}
        pool = near or {min(left, key=rank.__getitem__)}
        best = min(pool, key=lambda t: (len(cameras.get(t, set()) - held.keys()), -len(cameras.get(t, set()) & held.keys()), rank[t]))
        order.append(best)
        left.discard(best)
        for c in sorted(cameras.get(best, ())):
            held.pop(c, None)
            held[c] = None
        while len(held) > cache:
            held.popitem(last=False)
    return order if misses(order, cameras, cache) <= misses(fallback, cameras, cache) else fallback


def interleave(lists: list[list]) -> list:
    """All items, each list spread evenly over the whole."""
    total, at, out = sum(map(len, lists)), [0] * len(lists), []
    while len(out) < total:
        for k, x in enumerate(lists):
            if at[k] < len(x) and total * at[k] <= len(out) * len(x):
                out.append(x[at[k]])
                at[k] += 1
    return out
