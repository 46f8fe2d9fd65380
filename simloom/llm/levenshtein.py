"""Levenshtein automata of a lexicon, intersected with its trie.

A state is the set of trie nodes that can be reached with so many edits; the
states and steps that words need are made on first use and kept.  A term may
be a stem, which also accepts any ending.
"""

from __future__ import annotations

STEM, WORD = False, True
#: Edits allowed by the length of a term.
EDITS = ((9, 2), (5, 1), (0, 0))
MOST_STATES = 20_000


def edits_for(term: str) -> int:
    return next(e for n, e in EDITS if len(term) >= n)


class State(dict):
    """A state of the automaton; maps a character to the next state, None where no term is left."""

    __slots__ = ("done", "found", "lexicon", "nodes")

    def __missing__(self, c: str) -> State | None:
        if c and c not in self.lexicon.alphabet:
            return self[""]
        self[c] = after = self.lexicon.step(self, c)
        return after


class Lexicon:
    """Matches words against terms: pairs of a string and whether it is a whole word."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # most edits that any term below a node allows
        for k, (term, _) in enumerate(terms):
            node, allowed = 0, edits_for(term)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].append(k)
        self.alphabet = {c for term, _ in terms for c in term}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state({0: 0}, {})

    def _state(self, nodes: dict[int, int], done: dict[int, int]) -> State | None:
        """``nodes``: least edits by node; ``done``: by stem that has matched already."""
        todo = list(nodes)
        while todo:  # skip characters of terms
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.reach[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        for node, e in nodes.items():
            for k in self.ends[node]:
                term, whole = self.terms[k]
                if whole == STEM and e <= edits_for(term):
                    done[k] = min(e, done.get(k, 99))
        if not nodes and not done:
            return None
        key = (tuple(sorted(nodes.items())), tuple(sorted(done.items())))
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State()
            state.lexicon, (state.nodes, state.done) = self, key
            found = [(e, k) for k, e in state.done]
            found += [(e, k) for node, e in state.nodes for k in self.ends[node] if self.terms[k][1] == WORD and e <= edits_for(self.terms[k][0])]
            state.found = min(found)[::-1] if found else None
        return state

    def step(self, state: State, c: str) -> State | None:
        nodes: dict[int, int] = {}
        for node, e in state.nodes:
            if e + 1 <= self.reach[node]:
                nodes[node] = min(e + 1, nodes.get(node, 99))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child]:
                    nodes[child] = min(cost, nodes.get(child, 99))
        return self._state(nodes, dict(state.done))

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term, earlier terms first, and its distance."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state = self.start
        for c in word:
            state = state[c]
            if state is None:
                return None
        return state.found
