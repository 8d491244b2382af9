"""Generalised suffix automaton over sequences of words.

Each added sequence starts again at the root, so no match runs from one sequence into the
next. ``first`` holds, per state, the tag of the sequence that first contained the state's
strings: with tags added in ascending order that is the smallest tag.
"""

from __future__ import annotations


class SuffixAutomaton:
    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list = [None]

    def _state(self, length: int, tag, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.first.append(tag)
        return len(self.length) - 1

    def _clone(self, p: int, word, q: int) -> int:
        """A state for the strings of q that end p's longest string and the word."""
        nexts, link = self.next, self.link
        c = self._state(self.length[p] + 1, self.first[q], dict(nexts[q]))
        link[c] = link[q]
        link[q] = c
        while p != -1 and nexts[p].get(word) == q:
            nexts[p][word] = c
            p = link[p]
        return c

    def add(self, words, tag=None) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, word, q)
                continue
            new = self._state(length[last] + 1, tag, {})
            p = last
            while p != -1 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p != -1:
                q = nexts[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
            last = new

    def step(self, state: int, matched: int, word) -> tuple[int, int]:
        """The state and the length of the longest match that ends at this word."""
        nexts = self.next
        to = nexts[state].get(word)
        while to is None and state:
            state = self.link[state]
            matched = self.length[state]
            to = nexts[state].get(word)
        return (to, matched + 1) if to is not None else (0, 0)

    def shorten(self, state: int, matched: int, least: int) -> tuple[int, int]:
        """Go to the state that holds the suffix of length ``least``, if more than that is matched."""
        link, length = self.link, self.length
        while length[link[state]] >= least if state else False:
            state = link[state]
            matched = length[state]
        return state, matched
