"""Fuzzy lexicon search: Levenshtein automata run together down a trie of terms."""

from __future__ import annotations

from dataclasses import dataclass

KEPT_WORDS = 400_000
KEPT_STEPS = 200_000


@dataclass(frozen=True)
class Term:
    """``text`` as a whole word, or as the beginning of one (``stem``).

    ``weight``: its odds; ``edits``: how many edits still count as this term.
    """

    text: str
    stem: bool
    weight: float
    edits: int = 0


def usual_edits(text: str, stem: bool) -> int:
    """None for stems and short words, where an edit makes another word."""
    return 0 if stem or len(text) < 5 else 1 if len(text) < 8 else 2


class Lexicon:
    """Finds the term nearest to a word.

    The automaton of all terms is the set of (trie node, edits so far) after each letter: a
    letter steps to an equal child, to any child (replaced), or stays (inserted), and
    children are passed over for one edit each (left out). Nodes below which no term allows
    that many edits are left. Sets are numbered and their steps remembered, so that most
    words cost a few dictionary look-ups until no term is left.
    """

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self._children: list[dict[str, int]] = [{}]
        self._most = [0]  # the most edits any term at or below a node allows
        self._ends: dict[int, list[int]] = {}
        for k, term in enumerate(terms):
            node = 0
            self._most[0] = max(self._most[0], term.edits)
            for letter in term.text:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._most.append(0)
                node = self._children[node][letter]
                self._most[node] = max(self._most[node], term.edits)
            self._ends.setdefault(node, []).append(k)
        self._clear()

    def _clear(self) -> None:
        self._numbers: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: dict[tuple[int, str], int] = {}
        self._stems: list[tuple[int, int] | None] = []
        self._whole: list[tuple[int, int] | None] = []
        self._words: dict[str, tuple[int, int] | None] = {}
        self._start = self._number(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """``states`` with those reached by leaving out letters of terms, best edits only."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, edits = todo.pop()
            if edits > self._most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self._children[node].values()]
        return frozenset(best.items())

    def _number(self, states: frozenset) -> int:
        if states not in self._numbers:
            self._numbers[states] = len(self._sets)
            self._sets.append(states)
            ends = [(edits, k) for node, edits in states for k in self._ends.get(node, ()) if edits <= self.terms[k].edits]
            self._stems.append(min((x for x in ends if self.terms[x[1]].stem), default=None))
            self._whole.append(min((x for x in ends if not self.terms[x[1]].stem), default=None))
        return self._numbers[states]

    def _step(self, number: int, letter: str) -> int:
        states = set()
        for node, edits in self._sets[number]:
            for other, child in self._children[node].items():
                states.add((child, edits + (other != letter)))
            states.add((node, edits + 1))
        return self._number(self._closed(states))

    def _search(self, word: str) -> tuple[int, int] | None:
        now, found = self._start, None
        for letter in word:
            key = (now, letter)
            if key not in self._steps:
                self._steps[key] = self._step(now, letter)
            now = self._steps[key]
            if not self._sets[now]:
                return found
            found = found or self._stems[now]
        return min(filter(None, (found, self._whole[now])), default=None)

    def find(self, words: list[str]) -> list[tuple[int, int] | None]:
        """(edits, term) of the nearest term of each lower-case word, or None."""
        if len(self._words) > KEPT_WORDS or len(self._steps) > KEPT_STEPS:
            self._clear()
        known = self._words
        for word in set(words).difference(known):
            known[word] = self._search(word)
        return list(map(known.__getitem__, words))
