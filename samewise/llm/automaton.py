"""A generalised suffix automaton over sequences of hashable words."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """States stand for sets of runs with the same end places; next, link and length are lists by state, 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: Iterable[Hashable]) -> list[int]:
        """Add a sequence; the states of its prefixes, as they are at the end of each step."""
        last, states = 0, []
        for word in words:
            last = self._extend(last, word)
            states.append(last)
        return states

    def longest_first(self) -> list[int]:
        """All states but the root, so that each comes before its link."""
        return sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)

    def _state(self, length: int, after: dict[Hashable, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: Hashable) -> int:
        """The state of the runs through p and word only, apart from the longer ones of q."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: Hashable) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new
