"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match over a vocabulary, without building a piece: the vocabulary
is a trie; a node's failure link leads to the node for what is left after the
longest pieces at the front have been popped, and the number of those pieces is
kept beside it. A word is read once, character by character, each failure step
pops at least one piece, so the work is linear in its length. Distinct words are
counted once in a batch and kept for later ones.

A vocabulary with a mark for the end of a word has it as one more character, after
the last one of the word: a final piece fits at the end only. The mark alone is a piece
that counts nothing, so a word may end with a piece that isn't final where the
longest match leaves no other. A word with a character that no piece has is one
unknown piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow
from shelfloom.llm.words import KEPT_LENGTH

_PRE = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")
_KEPT_WORDS = 1_000_000
_DEAD = -1
#: Stands for the end of a word; no byte is written as it.
_END = "\ue000"


class Automaton:
    """Counts greedy pieces; ``initial`` may start a word, ``continuing`` may follow (the same by default); a piece in ``free`` counts nothing."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str] | None = None, free: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.fail: list[int] = [_DEAD]
        self.pops: list[int] = [0]
        self.whole: list[bool] = [False]
        self.start = self.rest = 0
        self.free, self.uncounted = free, set()
        initial = list(initial)
        self._grow(self.rest, initial if continuing is None else continuing)
        if continuing is not None:
            self.start = self._node()
            self._grow(self.start, initial)
        self._link()

    def _node(self) -> int:
        self.next.append({})
        self.fail.append(_DEAD)
        self.pops.append(0)
        self.whole.append(False)
        return len(self.next) - 1

    def _grow(self, root: int, pieces: Iterable[str]) -> None:
        for piece in pieces:
            at = root
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = self._node()
                at = to
            if at != root:
                self.whole[at] = True
                if piece in self.free:
                    self.uncounted.add(at)

    def _link(self) -> None:
        """Breadth first: a node that is a piece pops itself; another pops as its parent does until the character fits."""
        level = list(dict.fromkeys([self.rest, self.start]))
        while level:
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if self.whole[node]:
                        self.fail[node], self.pops[node] = self.rest, int(node not in self.uncounted)
                        continue
                    at, popped = self.fail[parent], self.pops[parent]
                    while at != _DEAD and c not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at != _DEAD:
                        self.fail[node], self.pops[node] = self.next[at][c], popped
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; one (unknown) for a word that the vocabulary can't cover; 0 for an empty one."""
        following, fail, pops, rest = self.next, self.fail, self.pops, self.rest
        at, total = self.start, 0
        for c in word:
            while (to := following[at].get(c)) is None:
                if fail[at] == _DEAD:
                    return 1
                total += pops[at]
                at = fail[at]
            at = to
        while at not in (rest, self.start):
            if fail[at] == _DEAD:
                return 1
            total += pops[at]
            at = fail[at]
        return total


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Counts:
    """Pieces of texts by the vocabulary in a tokenizer file, whose final pieces have ``word_end``; words are lower case, white space is dropped."""

    _built: dict[str, Counts] = {}

    def __init__(self, path: str, word_end: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.automaton = Automaton({piece.removesuffix(word_end) + _END if piece.endswith(word_end) else piece for piece in vocabulary} - {""} | {_END}, free=frozenset({_END}))
        self.bytes_as = byte_characters()
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counts:
        if path not in cls._built:
            cls._built[path] = cls(path)
        return cls._built[path]

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.automaton.count("".join([self.bytes_as[b] for b in word.encode("utf-8", "surrogatepass")]) + _END)
            if len(word) <= KEPT_LENGTH:
                if len(self.known) >= _KEPT_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """(words, pieces)."""
        words = _PRE.findall(text.lower())
        return len(words), sum(map(self.word, words))


def count_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` to (key, n_words, n_pieces), one row for each row.

    Null and empty texts have none. Repeated rows are counted alike; an empty table
    gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.of(path)
        for part in arrow.parts(batches, 1_000):
            found = [counts.text(t) for t in part.column(column).to_pylist()]
            yield arrow.with_columns(part, [column], {"n_words": ([w for w, _ in found], pa.int64()), "n_pieces": ([p for _, p in found], pa.int64())})

    column = arrow.spare([key], "text")
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(column))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_words bigint, n_pieces bigint")
