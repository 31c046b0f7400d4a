"""Alignment of short texts: local, anchored, and several queries against one text."""

from __future__ import annotations

from dataclasses import dataclass

from .graph import min_cost_flow


@dataclass(frozen=True)
class Match:
    """``text[lo..hi]`` (inclusive) aligned with a query; ``size`` of its characters agree."""

    lo: int
    hi: int
    size: int
    cost: int

    def ratio(self) -> float:
        return self.size / (self.size + self.cost)


def local(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """Best local alignment: score and the half-open ranges in both texts."""
    best, where = 0, (0, 0)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (match if x == y else mismatch), table[i - 1][j] + gap, table[i][j - 1] + gap)
            if table[i][j] > best:
                best, where = table[i][j], (i, j)
    i, j = where
    while i and j and table[i][j]:
        if table[i][j] == table[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return best, (i, where[0]), (j, where[1])


def find(query: str, text: str, ratio: float = 0.7) -> list[Match]:
    """Places of ``text`` that begin with the query's first character and agree with a prefix
    of it in enough of their steps; of nested places the outer, better one stays."""
    found = []
    for start, c in enumerate(text):
        if not query or c != query[0]:
            continue
        row = [(0, 0, 0)]  # (score, agreeing, cost) of query prefixes against the text so far
        for j in range(1, len(query) + 1):
            row.append((row[-1][0] - 1, row[-1][1], row[-1][2] + 1) if j > 1 else (-1, 0, 1))
        best: Match | None = None
        for i in range(start, min(len(text), start + 2 * len(query))):
            new = [(row[0][0] - 1, 0, row[0][2] + 1)]
            for j in range(1, len(query) + 1):
                same = query[j - 1] == text[i]
                d = row[j - 1]
                options = [(d[0] + (1 if same else -1), d[1] + same, d[2] + (not same)), (row[j][0] - 1, row[j][1], row[j][2] + 1), (new[j - 1][0] - 1, new[j - 1][1], new[j - 1][2] + 1)]
                new.append(max(options, key=lambda o: (o[0], o[1])))
            row = new
            top = max(row[1:], key=lambda o: (o[1] - o[2], o[1]))
            if top[1] and top[1] >= ratio * (top[1] + top[2]) and (best is None or (top[1] - top[2], top[1]) > (best.size - best.cost, best.size)):
                best = Match(start, i, top[1], top[2])
        if best:
            found.append(best)
    return [m for m in found if not any(o is not m and o.lo <= m.lo and m.hi <= o.hi and o.size - o.cost >= m.size - m.cost for o in found)]


def align(queries: list[str], text: str, ratio: float = 0.7) -> list[Match | None]:
    """One place per query at most, places apart, most agreement at least cost: a flow from
    queries to the characters that their places start with, renewed while places overlap."""
    options = [find(q, text, ratio) for q in queries]
    while True:
        edges, index = [], {}
        for k, own in enumerate(options):
            if own:
                edges.append(("s", ("q", k), 1.0, 0.0))
            for m in own:
                place = ("p", m.lo, m.hi)
                edges.append((("q", k), place, 1.0, float(m.cost + len(queries[k]) - m.size)))
                index[(k, place)] = m
        for place in {p for _, p in index}:
            edges.append((place, "t", 1.0, 0.0))
        if not edges:
            return [None] * len(queries)
        _, _, flows = min_cost_flow(edges, "s", "t")
        chosen: list[Match | None] = [None] * len(queries)
        for (k, place), m in index.items():
            if flows.get((("q", k), place), 0) > 0.5:
                chosen[k] = m
        clash = [(a, b) for a in range(len(queries)) for b in range(a + 1, len(queries)) if chosen[a] and chosen[b] and chosen[a].lo <= chosen[b].hi and chosen[b].lo <= chosen[a].hi]
        if not clash:
            return chosen
        # the weaker of two overlapping places is given up
        a, b = clash[0]
        loser = min((a, b), key=lambda k: (chosen[k].size - chosen[k].cost, -k))
        options[loser] = [m for m in options[loser] if m is not chosen[loser]]
