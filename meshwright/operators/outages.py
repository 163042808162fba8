"""Availability of demands while links fail and are repaired at random, for networks of any size.

The same process as graph.availability, drawn for many links at once, and the same answer as reaching everything anew after
each change. A breadth-first tree tells for each of its links what is lost while only that link is down, and the links by which
the rest is still reached. Almost always all these are up, so that the time lost is a sum over arrays; the other times are
looked at one by one, each for as long as no link that was asked for changes. While a link above in the tree is down too, the
loss is that link's.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import compress

import numpy as np
import pandas as pd

from meshwright.operators import graph

#: Outages held at a time, mean steps from the source up to which a tree is used, length in mean repair times of the buckets by which outages that may meet are found, and
#: most words of 64 of these.
AT_ONCE, MOST_LEVELS, BUCKET, MOST_WORDS = 600_000, 50, 4.0, 8_000_000


def draw(count: int, mean_up: float, mean_down: float, span: float, down: np.ndarray, rng: np.random.Generator):
    """Outages (link, from, to) of so many links from 0 to span, by link and time, and which links are down at the end.

    down: links that are down at 0. Times up and down are exponential, so what is left of one that began before is too.
    Failures are drawn on one line on which the times of all links lie end to end; those of a link that is down don't count.
    """
    at, far = [np.zeros(1)], count * span
    while at[-1][-1] < far:
        left = (far - at[-1][-1]) / mean_up
        at.append(at[-1][-1] + np.cumsum(rng.standard_exponential(int(left + 4 * np.sqrt(left)) + 2) * mean_up))
    at = np.concatenate(at)
    at = at[1 : np.searchsorted(at, far)]
    link = np.minimum((at / span).astype(np.int64), count - 1)
    start = np.clip(at - link * span, np.finfo(float).tiny, span)
    end = start + rng.standard_exponential(len(at)) * mean_down
    begun = np.flatnonzero(down)
    if len(begun):
        to = np.searchsorted(link, begun)
        link, start = np.insert(link, to, begun), np.insert(start, to, 0.0)
        end = np.insert(end, to, rng.standard_exponential(len(begun)) * mean_down)
    # of each link the first failure before the end of the outage before it, until there is none
    early = (link[1:] == link[:-1]) & (start[1:] < end[:-1])
    if early.any():
        some = np.zeros(count, bool)
        some[link[1:][early]] = True
        left, gone = np.flatnonzero(some[link]), []
        while True:
            k = np.flatnonzero((link[left[1:]] == link[left[:-1]]) & (start[left[1:]] < end[left[:-1]])) + 1
            if not len(k):
                break
            k = k[np.unique(link[left[k]], return_index=True)[1]]
            gone.append(left[k])
            left = np.delete(left, k)
        kept = np.ones(len(link), bool)
        kept[np.concatenate(gone)] = False
        link, start, end = link[kept], start[kept], end[kept]
    still = np.zeros(count, bool)
    still[link[end >= span]] = True
    return link, start, np.minimum(end, span), still


def _expand(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... of each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Outages:
    """Time for which each node of a graph is not reached from start. pair_of: the number of the link of each edge that can fail.

    wanted: nodes for which this is asked, all without it; what is added up for others is not whole then.
    """

    def __init__(self, g: graph.Graph, start: int, pair_of: dict[tuple[int, int], int], pairs: int, wanted: set[int] | None = None) -> None:
        own = [[pair_of.get((i, j), -1) for j in ends] for i, ends in enumerate(g.out)]
        safe = [[j for j, k in zip(ends, ks, strict=True) if k < 0] for ends, ks in zip(g.out, own, strict=True)]
        always, _, _ = graph.breadth_first(safe, [start])
        order, parent, self.level = graph.breadth_first(g.out, always)
        self.deep = sum(self.level[n] for n in order) > MOST_LEVELS * len(order)
        if self.deep:
            return
        # nodes get numbers such that what hangs on a node follows it
        children: list[list[int]] = [[] for _ in g.names]
        for n in order[len(always) :]:
            children[parent[n]].append(n)
        number, stack, names = {}, always[::-1], []
        while stack:
            n = stack.pop()
            number[n] = len(names)
            names.append(n)
            stack += children[n]
        self.number, self.parent = number, [-1 if parent[n] < 0 else number[parent[n]] for n in names]
        self.end = [i + 1 for i in range(len(names))]
        for i in range(len(names) - 1, -1, -1):
            if (p := self.parent[i]) >= 0:
                self.end[p] = max(self.end[p], self.end[i])
        self.out = [[(number[j], k) for j, k in zip(g.out[n], own[n], strict=True)] for n in names]
        self.into: list[list[tuple[int, int]]] = [[] for _ in names]
        for i, row in enumerate(self.out):
            for j, k in row:
                self.into[j].append((i, k))
        self.link = [pair_of.get((parent[n], n), -1) for n in names]
        self.above: list[tuple[int, ...]] = []  # nodes on the path to each that hang on a link which can fail, itself included
        for i, p in enumerate(self.parent):
            self.above.append((self.above[p] if p >= 0 else ()) + ((i,) if self.link[i] >= 0 else ()))
        self.pairs, self.lost = pairs, np.zeros(len(names))
        self.paths = [[self.link[i] for i in a] for a in self.above]
        asked = np.cumsum([0, *(wanted is None or n in wanted for n in names)]).tolist()
        self.nodes = [i for i, k in enumerate(self.link) if k >= 0 and asked[self.end[i]] > asked[i]]
        self.enters: dict[int, list[tuple[int, int, int]]] = {}
        gone, needs, above = [], [], []
        for i in self.nodes:
            a, b, c = self._alone(i)
            gone.append(a)
            needs.append(b + c)
            above.append([False] * len(b) + [True] * len(c))
        flat = lambda rows, kind: np.array([x for r in rows for x in r], kind)
        self.gone, self.gone_n = flat(gone, np.int64), np.array([len(r) for r in gone], np.int64)
        self.needs, self.needs_at = flat(needs, np.int64), np.concatenate(([0], np.cumsum([len(r) for r in needs]))).astype(np.int64)
        self.is_above = flat(above, bool)

    def _enter(self, v: int) -> list[tuple[int, int, int]]:
        """Nodes outside and inside of what hangs on v, and the link between them, but for v's own; those near the source first."""
        if v not in self.enters:
            end, mine = self.end[v], self.link[v]
            enter = [(len(self.above[u]), u, x, k) for x in range(v, end) for u, k in self.into[x] if not v <= u < end and k != mine]
            self.enters[v] = [e[1:] for e in sorted(enter)]
        return self.enters[v]

    def _alone(self, v: int) -> tuple[list[int], list[int], list[int]]:
        """What is not reached while only v's link is down, the other links by which the rest behind it is, and those above v."""
        first, end, mine = v, self.end[v], self.link[v]
        needs: set[int] = set()
        got: set[int] = set()
        for u, x, k in self._enter(v):
            if x not in got:
                needs.add(k)
                needs.update(self.link[i] for i in self.above[u])
                got.add(x)
                stack = [x]
                while stack:
                    for j, q in self.out[stack.pop()]:
                        if first <= j < end and j not in got:
                            needs.add(q)
                            got.add(j)
                            stack.append(j)
        above = {self.link[i] for i in self.above[v]} - {mine}
        return [i for i in range(first, end) if i not in got], sorted(needs - above - {mine, -1}), sorted(above)

    def add(self, link: np.ndarray, start: np.ndarray, end: np.ndarray, span: float, mean_down: float) -> None:
        """Adds what is lost by the outages (by link and time) from 0 to span."""
        if not len(link) or not self.nodes:
            return
        at = np.searchsorted(link, np.arange(self.pairs + 1))
        # a bit for each link and bucket of time that an outage touches
        words = int(min(np.ceil(span / (BUCKET * mean_down) / 64), max(1, MOST_WORDS // self.pairs)))
        scale = words * 64 / span
        low, high = (np.minimum((x * scale).astype(np.int64), words * 64 - 1) for x in (start, end))
        bits, word = np.zeros(self.pairs * words, np.uint64), link * words
        np.bitwise_or.at(bits, word + (low >> 6), np.uint64(1) << (low & 63).astype(np.uint64))
        more = np.flatnonzero(high > low)
        n = high[more] - low[more]
        bucket = np.repeat(low[more] + 1, n) + _expand(n)
        np.bitwise_or.at(bits, np.repeat(word[more], n) + (bucket >> 6), np.uint64(1) << (bucket & 63).astype(np.uint64))
        bits = bits.reshape(self.pairs, words)
        total = np.concatenate(([0.0], np.cumsum(end - start)))
        of = np.array([self.link[i] for i in self.nodes])
        alone = total[at[of + 1]] - total[at[of]]
        key, lists = link * (2 * span) + start, (memoryview(start), memoryview(end), at.tolist(), span, memoryview(bits.ravel()), words, scale)
        needs_n, block = np.diff(self.needs_at), max(1, 1_000_000 // words)
        i = 0
        while i < len(self.nodes):
            j = max(i + 1, int(np.searchsorted(self.needs_at, self.needs_at[i] + block, "right")) - 1)
            rows = np.flatnonzero(needs_n[i:j]) + i
            if len(rows):
                any_down = np.bitwise_or.reduceat(bits[self.needs[self.needs_at[i] : self.needs_at[j]]], self.needs_at[rows] - self.needs_at[i], axis=0).ravel()
                # outages of these nodes' own links, then those in a bucket with another one or in many, then those that meet one
                count = at[of[rows] + 1] - at[of[rows]]
                row, x = np.repeat(np.arange(len(rows)), count), np.repeat(at[of[rows]], count) + _expand(count)
                a, b = low[x], high[x]
                hit = any_down[row * words + (a >> 6)] >> (a & 63).astype(np.uint64) | any_down[row * words + (b >> 6)] >> (b & 63).astype(np.uint64)
                near = np.flatnonzero((hit & np.uint64(1) > 0) | (b - a > 1))
                row, x = rows[row[near]], x[near]
                deps = needs_n[row]
                p, o = np.repeat(self.needs_at[row], deps) + _expand(deps), np.repeat(np.arange(len(x)), deps)
                q, s, e = self.needs[p], start[x][o], end[x][o]
                last = np.searchsorted(key, q * (2 * span) + e) - 1
                meets = np.flatnonzero((last >= 0) & (link[last] == q) & (end[last] > s))
                p, o, q, s, e, last = p[meets], o[meets], q[meets], s[meets], e[meets], last[meets]
                # one that meets a single outage is looked at while both last, else from end to end
                once = (np.bincount(o, minlength=len(x))[o] == 1) & ~((last > 0) & (link[last - 1] == q) & (end[last - 1] > s))
                s, e = np.where(once, np.maximum(s, start[last]), s), np.where(once, np.minimum(e, end[last]), e)
                each = np.flatnonzero(np.diff(o, prepend=-1))
                np.subtract.at(alone, row[o[each]], e[each] - s[each])
                each = each[~(once & self.is_above[p])[each]]
                for m, a, b in zip(row[o[each]].tolist(), s[each].tolist(), e[each].tolist(), strict=True):
                    self._one_by_one(self.nodes[m], a, b, *lists)
            i = j
        np.add.at(self.lost, self.gone, np.repeat(alone, self.gone_n))

    def _one_by_one(self, v: int, t: float, stop: float, starts: memoryview, ends: memoryview, bounds: list[int], span: float, bits: memoryview, words: int, scale: float) -> None:
        """Adds what is lost behind v from t to stop, while its link is down, but for times in which a link above is down too."""
        states: dict[int, bool] = {}
        above, paths, end, until = self.above, self.paths, self.end[v], stop

        def up(k: int) -> bool:
            nonlocal until
            if k not in states:
                i = bisect_right(starts, t, bounds[k], bounds[k + 1]) - 1
                states[k] = i < bounds[k] or ends[i] <= t
                change = (starts[i + 1] if i + 1 < bounds[k + 1] else span) if states[k] else ends[i]
                until = min(until, change)
            return states[k]

        low, high = (min(int(x * scale), words * 64 - 1) for x in (t, stop))
        for word in range(low >> 6, (high >> 6) + 1):
            limit = stop if word == high >> 6 else (word + 1) * 64 / scale
            # only links with a bit in these buckets are asked, all others are up
            mask = (2 << (min(high, word * 64 + 63) & 63)) - (1 << (max(low, word * 64) & 63))
            while t < limit:
                states.clear()
                until = limit
                for k in paths[v]:
                    if bits[k * words + word] & mask and k != self.link[v] and not up(k):
                        break
                else:
                    # v and whatever else is broken and leads there
                    tops, more, seeds, got = [v], set(), [], set()
                    for top in tops:
                        for u, x, k in self._enter(top):
                            if x not in got and u not in more and not (v <= u < end) and (k < 0 or not bits[k * words + word] & mask or up(k)):
                                for i, k in enumerate(paths[u]):
                                    if bits[k * words + word] & mask and not up(k):
                                        tops.append(above[u][i])
                                        more.update(range(tops[-1], self.end[tops[-1]]))
                                        break
                                else:
                                    got.add(x)
                                    seeds.append(x)
                    while seeds:
                        for j, k in self.out[seeds.pop()]:
                            if j not in got and (v <= j < end or j in more) and (k < 0 or not bits[k * words + word] & mask or up(k)):
                                got.add(j)
                                seeds.append(j)
                    for x in range(v, end):
                        if x not in got:
                            self.lost[x] += until - t
                t = until


def availability(edges: pd.DataFrame, link_availability: float, horizon: float, seed: int) -> pd.DataFrame:
    """graph.availability with draws by link instead of in the order of events: demand, availability.

    Networks in which most nodes are very far from the source are simulated event by event.
    """
    src, dst, kind = list(edges["src"]), list(edges["dst"]), list(edges["kind"])
    demands = sorted({n for n in {*src, *dst} if n.startswith("demand:")})
    if graph.SOURCE not in src and graph.SOURCE not in dst:
        return pd.DataFrame({"demand": demands, "availability": [0.0] * len(demands)})
    # a demand with one site is lost when that is
    sites: dict[str, set[str]] = {}
    for a, b in zip(src, dst, strict=True):
        if b.startswith("demand:"):
            sites.setdefault(b, set()).add(a)
    senders = set(src).intersection(demands)
    single = {b: next(iter(s)) for b, s in sites.items() if len(s) == 1 and b not in senders}
    kept = [k != "DEMAND" or b not in single for b, k in zip(dst, kind, strict=True)]
    names = sorted({graph.SOURCE, *compress(src, kept), *compress(dst, kept)})
    number = {n: i for i, n in enumerate(names)}
    a, b = ([number[n] for n in compress(ends, kept)] for ends in (src, dst))
    g = graph.Graph([*a, number[graph.SOURCE]], [*b, number[graph.SOURCE]])
    radio = np.fromiter((k == "WIRELESS" for k in compress(kind, kept)), bool, len(a))
    ends = np.sort(np.column_stack((np.array(a, np.int64)[radio], np.array(b, np.int64)[radio])), axis=1)
    low, high = (x.tolist() for x in np.divmod(np.unique(ends[:, 0] * len(names) + ends[:, 1]), len(names)))
    pair_of, pairs = dict(zip(zip(low, high, strict=True), range(len(low)), strict=True)), len(low)
    pair_of.update(zip(zip(high, low, strict=True), range(pairs), strict=True))
    net = Outages(g, number[graph.SOURCE], pair_of, pairs, {number[s] for n in demands if (s := single.get(n, n)) in number})
    if net.deep:
        return graph.availability(edges, link_availability, horizon, seed)
    del g, pair_of, kept, src, dst, kind, sites, senders, a, b, low, high
    rng, down = np.random.default_rng(seed), np.zeros(pairs, bool)
    parts = max(1, int(np.ceil(pairs * horizon / AT_ONCE)))
    for _ in range(parts):
        link, start, end, down = draw(pairs, link_availability, 1 - link_availability, horizon / parts, down, rng)
        net.add(link, start, end, horizon / parts, 1 - link_availability)
    gone = {n: net.lost[i] / horizon for n, i in net.number.items()}
    up = [1 - gone.get(number.get(single.get(n, n), -1), 1.0) for n in demands]
    return pd.DataFrame({"demand": demands, "availability": up})
