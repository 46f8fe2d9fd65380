"""Probabilistic automata inferred by merging states of a prefix tree.

The values of a sample form a tree of prefixes with counts.  States are taken
up in order of their counts.  Two are compatible if, by Hoeffding's bound, the
frequencies of ending and of each next symbol agree, in them and in all states
below, and if what is left of the values at them is alike in length: the
largest gap between both distributions of lengths stays within the bound.  The
last test pools all values below a state, so it has power where single branches
are too thin, and a format of fixed length keeps a state for each position.  A
state that fewer than ``least`` values reach can't be tested; it is compatible
where its lengths are among the other's.  A state merges into the compatible
kept one of the most similar lengths and next symbols; without one it is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

#: Weight of a symbol that a state hasn't seen, in uses.
SMOOTH = 0.05


class Automaton:
    def __init__(self, values: Iterable[str], symbols: str, alpha: float = 0.05, least: int = 8):
        self.symbols, self.least = symbols, least
        self.seen, self.ended = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        #: Lengths that values still have at a state, with how often.
        self.left: list[Counter] = [Counter()]
        #: Uses of a step, by state and symbol.
        self.uses: list[Counter] = [Counter()]
        for v in values:
            node = 0
            for k, c in enumerate(v):
                self.seen[node] += 1
                self.left[node][len(v) - k] += 1
                self.uses[node][c] += 1
                if c not in self.next[node]:
                    self.next[node][c] = len(self.seen)
                    for column in (self.seen, self.ended):
                        column.append(0)
                    self.next.append({})
                    self.left.append(Counter())
                    self.uses.append(Counter())
                node = self.next[node][c]
            self.seen[node] += 1
            self.left[node][0] += 1
            self.ended[node] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _margin(self, a: int, b: int) -> float:
        return self.bound * (1 / math.sqrt(self.seen[a]) + 1 / math.sqrt(self.seen[b]))

    def _gap(self, a: int, b: int) -> float:
        """The largest gap between the distributions of the lengths left."""
        x, y, gap, p, q = self.left[a], self.left[b], 0.0, 0, 0
        for n in sorted(x.keys() | y.keys()):
            p, q = p + x[n], q + y[n]
            gap = max(gap, abs(p / self.seen[a] - q / self.seen[b]))
        return gap

    def _among(self, a: int, b: int) -> bool:
        """Whether the lengths left at ``a`` occur at ``b``, or lie within the many that do."""
        x, y = self.left[a].keys(), self.left[b].keys()
        return x <= y or (len(y) >= self.least and min(y) <= min(x) and max(x) <= max(y))

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in met:
                continue
            met.add((x, y))
            if not self.seen[x] or not self.seen[y]:
                continue
            margin = self._margin(x, y)
            if abs(self.ended[x] / self.seen[x] - self.ended[y] / self.seen[y]) > margin:
                return False
            for c in self.next[x].keys() | self.next[y].keys():
                if abs(self.uses[x][c] / self.seen[x] - self.uses[y][c] / self.seen[y]) > margin:
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _home(self, node: int) -> int | None:
        """The kept state that ``node`` merges into."""
        best = None
        for k in self.kept:
            gap = self._gap(k, node)
            rare = min(self.seen[k], self.seen[node]) < self.least
            if rare:
                fits = self._among(node, k) or self._among(k, node)
            else:
                fits = gap <= self._margin(k, node)
            if not fits:
                continue
            apart = sum(abs(self.uses[k][c] / self.seen[k] - self.uses[node][c] / self.seen[node]) for c in self.uses[k].keys() | self.uses[node].keys())
            rank = (gap, apart, k)
            if (best is None or rank < best) and self._compatible(k, node):
                best = rank
        return None if best is None else best[2]

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree of the prefix tree to the states it runs through."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.seen[x] += self.seen[y]
            self.ended[x] += self.ended[y]
            self.left[x].update(self.left[y])
            self.uses[x].update(self.uses[y])
            for c, child in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], child))
                else:
                    self.next[x][c] = child

    def _merge_all(self) -> None:
        self.kept, kept = [0], {0}
        while True:
            edges = [(self.seen[child], -child, node, c) for node in self.kept for c, child in self.next[node].items() if child not in kept]
            if not edges:
                break
            _, child, node, c = max(edges)
            child = -child
            home = self._home(child)
            if home is None:
                self.kept.append(child)
                kept.add(child)
            else:
                self.next[node][c] = home
                self._fold(home, child)
        self.steps: list[dict[str, tuple[int, float]]] = []
        self.ends: list[float] = []
        place = {k: i for i, k in enumerate(self.kept)}
        for k in self.kept:
            total = sum(self.uses[k].values()) + self.ended[k] + SMOOTH * (len(self.symbols) + 1)
            likeliest = max(self.next[k], key=lambda c: (self.uses[k][c], c), default=None)
            after = place[self.next[k][likeliest]] if likeliest else 0
            self.steps.append({c: (place[self.next[k][c]] if c in self.next[k] else after, math.log((self.uses[k][c] + SMOOTH) / total)) for c in self.symbols})
            self.ends.append(math.log((self.ended[k] + SMOOTH) / total))
        del self.seen, self.ended, self.left, self.uses, self.next

    def log_likelihood(self, value: str) -> float:
        """A symbol that a state hasn't seen goes where most go."""
        state, total = 0, 0.0
        for c in value:
            state, p = self.steps[state][c]
            total += p
        return total + self.ends[state]
