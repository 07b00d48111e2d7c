"""Finds very many names at once: one automaton over the words of all their writings.

Each writing is a pattern; the words in it, whatever stands between them, are a path of the automaton. A text's words run
through the automaton once, and where a path ends the pattern is tried at the place of its first word, so what is found is what the
patterns by themselves would find, in a time that does not grow with the number of names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick

from tidemark.operators.text import RUN, Writing, all_writings

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a", "abcdefghijklmnopqrstuvwxyzsk")
#: Digits of a word's number; the first stands apart from the others, so a path begins at a word.
BASE, DIGITS = 128, 3


class Names:
    """(kind, name)s, compiled."""

    def __init__(self, names: list[tuple[str, str]]):
        self.numbers: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.bare: list[tuple[int, Writing]] = []
        paths: dict[str, list[tuple[int, Writing]]] = defaultdict(list)
        for rank, writing in enumerate(all_writings(names)):
            if not writing.paths:
                self.bare.append((rank, writing))
            for words in writing.paths:
                paths["".join(self.code(w.translate(FOLD), True) for w in words)].append((rank, writing))
        for path, found in paths.items():
            self.automaton.add_word(path, (len(path) // DIGITS, found))
        if paths:
            self.automaton.make_automaton()
        self.empty = not paths

    def code(self, word: str, new: bool = False) -> str:
        n = self.numbers.setdefault(word, len(self.numbers) + 1) if new else self.numbers.get(word, 0)
        if n >= BASE**DIGITS:
            raise ValueError("too many words")
        return chr(2 * BASE + n // BASE**2) + chr(n // BASE % BASE) + chr(n % BASE)

    def find(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(start, end, rank, kind) of every writing, each writing without overlaps of its own, leftmost first."""
        for rank, writing in self.bare:
            yield from ((m.start(), m.end(), rank, writing.kind) for m in writing.pattern.finditer(text))
        if self.empty:
            return
        words = list(RUN.finditer(text))
        places: dict[int, tuple[Writing, set[int]]] = {}
        for end, (n, found) in self.automaton.iter("".join(self.code(m[0].translate(FOLD)) for m in words)):
            at = words[end // DIGITS - n + 1].start()
            for rank, writing in found:
                places.setdefault(rank, (writing, set()))[1].add(at - writing.lead)
        for rank, (writing, starts) in places.items():
            reached = 0
            for start in sorted(starts):
                if start >= reached and (m := writing.pattern.match(text, start)):
                    yield start, m.end(), rank, writing.kind
                    reached = m.end()
