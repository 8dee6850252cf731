"""Generalised suffix automaton over integer tokens, with what its users hang on its states."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All factors of several token strings.

    State 0 is the root. ``size[v]`` is the longest factor of state v, ``link[v]`` the state of its longest proper suffix
    outside v, ``next[v]`` the transitions. Strings are added one by one, each from the root.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, token: int, q: int) -> int:
        new = len(self.size)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the factor is known from an earlier string
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, token, q)
        new = len(self.size)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, token, q)
        return new

    def add(self, tokens: Iterable[int]) -> list[int]:
        """Add a string; returns the state of each prefix as of now (clones may split it later)."""
        last, states = 0, []
        for token in tokens:
            last = self._extend(last, token)
            states.append(last)
        return states

    def statistics(self, tokens: Sequence[int]) -> list[tuple[int, int]]:
        """For each position: state and length of the longest factor that ends there."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for token in tokens:
            while True:
                to = nxt[state].get(token)
                if to is not None:
                    state, length = to, length + 1
                    break
                if state == 0:
                    length = 0
                    break
                state = link[state]
                length = size[state]
            out.append((state, length))
        return out

    def suffix_state(self, state: int, length: int) -> int:
        """The state of the suffix of that length of a factor of ``state`` at least as long."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def by_size(self) -> list[int]:
        """States but the root, longest first: children in the link tree before their parents."""
        return sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)
