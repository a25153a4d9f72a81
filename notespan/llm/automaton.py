"""A generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class Automaton:
    """The suffix automaton of several strings of numbers: every substring of any of them leads to one state."""

    def __init__(self, strings: Iterable[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole = [-1]  # the number of the string that the state's longest substring is
        for number, s in enumerate(strings):
            state = 0
            for b in s:
                state = self._add(state, b)
            self.whole[state] = number
        #: The nearest state down the links, itself included, that is a whole string.
        self.at = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.at[state] = state if self.whole[state] >= 0 else self.at[self.link[state]]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.whole.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, q: int, b: int) -> int:
        """A state of its own for the part of q that p and b make."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(b) == q:
            self.next[p][b] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, b: int) -> int:
        if (q := self.next[last].get(b)) is not None:
            return self._split(last, q, b)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and b not in self.next[p]:
            self.next[p][b] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][b], b)
        return new

    def step(self, state: int, matched: int, b: int) -> tuple[int, int]:
        """The state and the length of the longest match after one more byte."""
        while (to := self.next[state].get(b)) is None:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return to, matched + 1
