import math

import numpy as np

from lexiscope.llm import packing


def by_trying_all(sizes, capacity, docs_cap, cost_cap):
    """Best fit by its definition: every container with room is compared, by score, then room, then number."""
    w, where, made, least = packing.WEIGHTS, [], [], int(sizes[-1])
    for s in map(int, sizes):
        best = (math.inf, 0, -1)
        for k, (room, docs, cost) in enumerate(made):
            if room >= max(s, least) and docs >= 1 and cost >= max(s, least) ** 2:
                best = min(best, (w[0] * ((room - s) / capacity) ** 2 + w[1] * ((docs - 1) / docs_cap) ** 2 + w[2] * ((cost - float(s) * s) / cost_cap) ** 2, room, k))
        k = best[2]
        if k < 0:
            k = len(made)
            made.append((capacity, docs_cap, cost_cap if s * s <= cost_cap else float(capacity) ** 2))
        room, docs, cost = made[k]
        made[k] = (room - s, docs - 1, cost - float(s) * s)
        where.append(k)
    return where


def test_every_container_is_compared():
    r = np.random.default_rng(1)
    for capacity, sizes in ((512, r.integers(0, 60, 400)), (512, r.integers(150, 500, 300)), (512, np.concatenate([r.integers(300, 420, 90), r.integers(1, 90, 300)])), (96, r.integers(1, 97, 400))):
        sizes = np.sort(sizes)[::-1]
        docs_cap, cost_cap = packing.limits(capacity)
        assert packing.best_fit(sizes, capacity).tolist() == by_trying_all(sizes, capacity, docs_cap, cost_cap)
