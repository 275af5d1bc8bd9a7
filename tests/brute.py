"""Plain-Python answers for small graphs."""

from collections import defaultdict, deque
from itertools import combinations


def pair_counts(credits, min_common=1):
    members = defaultdict(set)
    for event, entity in credits:
        if event is not None and entity is not None:
            members[event].add(entity)
    counts = defaultdict(int)
    for group in members.values():
        for a, b in combinations(sorted(group), 2):
            counts[a, b] += 1
    return {p: n for p, n in counts.items() if n >= min_common}


def neighbors(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def distances(near, start):
    dist = {start: 0}
    todo = deque([start])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def shortest_paths(near, a, b, max_len=10):
    if a == b:
        return [(a, a)]
    dist = distances(near, b)
    if a not in dist or dist[a] > max_len:
        return []
    out = []

    def walk(path):
        v = path[-1]
        if v == b:
            out.append(tuple(path))
            return
        for w in near[v]:
            if dist.get(w, -1) == dist[v] - 1:
                walk(path + [w])

    walk([a])
    return out


def components(edges, vertices):
    near = neighbors(edges)
    label = {}
    for v in sorted(vertices):
        if v not in label:
            for w in distances(near, v):
                label[w] = v
    return label


def random_edges(rng, n, m):
    """Canonical edges src < dst without duplicates."""
    out = set()
    for _ in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            out.add((min(a, b), max(a, b)))
    return sorted(out)
