"""A lexicon trie that also accepts misspelled terms: Levenshtein automata of all terms, determinised as they are used."""

from __future__ import annotations


class FuzzyTrie:
    """Finds the lexicon term that a word is, or is a misspelling of.

    A state holds the trie nodes reachable by the letters so far with the fewest edits for each (the product of the trie
    and the Levenshtein automaton); its transitions are worked out when a word first needs them. A whole-word
    term allows one edit from `one` letters on and two from `two`; a stem matches exact beginnings only. With `swaps` two
    neighbouring letters in each other's place are one edit; until the second is read, the state holds (node behind both, second).
    """

    most_states = 100_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], one: int = 5, two: int = 8, swaps: bool = False) -> None:
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [0]  # edits that the terms below a node may need
        self.ends: list[tuple[str, int, float] | None] = [None]
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        for term, weight in words.items():
            edits, node = (len(term) >= one) + (len(term) >= two), 0
            self.allowed[0] = max(self.allowed[0], edits)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.ends.append(None)
                node = self.children[node][ch]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node] = (term, edits, weight)
        self.start = self._closed({0: 0})
        self.next: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, state: dict[int | tuple[int, str], int]) -> frozenset:
        """With the nodes reached by letters that the word leaves out."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            if isinstance(node, tuple):
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.allowed[child] and edits + 1 < state.get(child, 99):
                    state[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(state.items())

    def _step(self, state: frozenset, ch: str) -> frozenset:
        to: dict[int | tuple[int, str], int] = {}
        for node, edits in state:
            if isinstance(node, tuple):
                if node[1] == ch and edits < to.get(node[0], 99):
                    to[node[0]] = edits
                continue
            if edits < self.allowed[node] and edits + 1 < to.get(node, 99):  # a letter too many
                to[node] = edits + 1
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.allowed[child] and cost < to.get(child, 99):
                    to[child] = cost
                behind = self.children[child].get(ch) if self.swaps and letter != ch else None
                if behind is not None and edits + 1 <= self.allowed[behind] and edits + 1 < to.get((behind, letter), 99):
                    to[behind, letter] = edits + 1
        return self._closed(to)

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the nearest term, or None."""
        state = self.start
        for ch in word:
            key = (state, ch)
            to = self.next.get(key)
            if to is None:
                if len(self.next) >= self.most_states:
                    self.next.clear()
                to = self.next[key] = self._step(state, ch)
            state = to
            if not state:
                break
        found = [(edits, -self.ends[node][2]) for node, edits in state if not isinstance(node, tuple) and self.ends[node] and edits <= self.ends[node][1]]
        if found:
            edits, weight = min(found)
            return -weight, edits
        for n in self.lengths:
            if n <= len(word) and word[:n] in self.stems:
                return self.stems[word[:n]], 0
        return None
