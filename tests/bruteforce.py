"""Plain NumPy versions of the graph results, written from the definitions
(explicit pairs, edge by edge), used to check the Spark operators."""

from collections import defaultdict

import numpy as np


def edges(memberships):
    """Directed weighted edges {(u, v): shared links} from (vertex, link) pairs."""
    by_link = defaultdict(set)
    for v, link in memberships:
        by_link[link].add(v)
    w = defaultdict(int)
    for members in by_link.values():
        for u in members:
            for v in members:
                if u != v:
                    w[(u, v)] += 1
    return dict(w)


def lazy_walk(memberships, d=0.15, tol=0.01, max_iter=10):
    e = edges(memberships)
    out = defaultdict(float)
    for (u, _), w in e.items():
        out[u] += w
    rank = {v: 1.0 for v in out}
    if not rank:
        return {}, []
    t, it, trace = 1.0, 0, []
    while t > tol and it < max_iter:
        add = defaultdict(float)
        for (u, v), w in e.items():
            add[v] += (w * (1 - d)) / out[u] * rank[u]
        new = {v: rank[v] * d + add[v] for v in rank}
        t = max(abs(new[v] - rank[v]) for v in rank)
        rank, it = new, it + 1
        trace.append(t)
    return rank, trace


def pagerank(memberships, vertices, damping=0.85, tol=0.01):
    e = edges(memberships)
    out = defaultdict(float)
    for (u, _), w in e.items():
        out[u] += w
    reset = 1.0 - damping
    start = 0.0 + (1.0 - reset) * (reset / (1.0 - reset))
    pr = {v: start for v in vertices}
    delta = dict(pr)
    active = set(vertices)
    while True:
        msg = defaultdict(float)
        for (u, v), w in e.items():
            if u in active and delta[u] > tol:
                msg[v] += delta[u] * (1.0 / out[u]) * w
        if not msg:
            break
        for v, m in msg.items():
            new = pr[v] + (1.0 - reset) * m
            delta[v] = new - pr[v]
            pr[v] = new
        active = set(msg)
    f = len(pr) / float(np.sum(list(pr.values())))
    return {v: p * f for v, p in pr.items()}
