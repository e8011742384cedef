"""Token counts: how many pieces a unigram tokenizer makes of a text, without making them.

An Aho-Corasick automaton lists every vocabulary piece that ends at each position; dynamic programming
carries the best score and its number of pieces from position to position. As in the tokenizer, a
later candidate replaces the best one only if its score is greater, and candidates come longest piece
first; a character that is no piece costs the lowest score less 10 and counts its UTF-8 bytes, for
which the vocabulary has byte pieces. The tokenizer cuts texts before every space and puts one in
front; so do we, and counts of words are kept in a bounded table.

Defined cases: NULL and empty texts have no tokens. Rows are counted one by one, repeated or not.
Columns not in ``keep`` are ignored. Memory is bounded by one batch, one word's scores and the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.arrow import add_columns, kept_in_worker, texts
from loomtext.llm.pieces import SPACE, Vocabulary, read_vocabulary

UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
CACHED_LENGTH = 200


class PieceCounter(dict):
    """Word -> number of pieces of the word with a space in front.

    Bounded: when the newer half is full it becomes the older one, whose words move up again when
    they are met and are forgotten otherwise.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.older: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.scores) - UNKNOWN_PENALTY
        self.by_line = vocabulary.cuts_at_newline

    def best(self, unit: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of ``unit``."""
        scores, counts = [0.0], [0]
        singles, unknown = self.singles, self.unknown
        if singles.issuperset(unit):  # then some piece ends at every position
            closed = 0
            for end, (length, score) in self.automaton.iter(unit):
                start = end + 1 - length
                other = scores[start] + score
                if end == closed:
                    closed += 1
                    scores.append(other)
                    counts.append(counts[start] + 1)
                elif other > scores[closed]:
                    scores[closed] = other
                    counts[closed] = counts[start] + 1
            return counts[-1], scores[-1]
        here, count, at = None, 0, 1

        def close(here, count):
            character = unit[at - 1]
            if character not in singles:
                other = scores[at - 1] + unknown
                if here is None or other > here:
                    here, count = other, counts[at - 1] + len(character.encode())
            scores.append(here)
            counts.append(count)

        for end, (length, score) in self.automaton.iter(unit):
            while at <= end:
                close(here, count)
                here, at = None, at + 1
            start = at - length
            other = scores[start] + score
            if here is None or other > here:
                here, count = other, counts[start] + 1
        while at <= len(unit):
            close(here, count)
            here, at = None, at + 1
        return counts[-1], scores[-1]

    def __missing__(self, word: str) -> int:
        if self.by_line and "\n" in word:
            # A line feed is its own byte piece and no piece reaches across it.
            first, *rest = word.split("\n")
            return self[first] + sum(1 + (self.best(line)[0] if line else 0) for line in rest)
        count = self.older.get(word) or self.best(SPACE + word)[0]
        if len(word) <= CACHED_LENGTH:
            self[word] = count
        return count

    def of(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0] and len(words) > 1:
            del words[0]  # the text's own space serves as the one in front
        total = sum(map(self.__getitem__, words))
        if len(self) >= CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        return total


def count_tokens(
    docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str]
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_tokens``. ``vocabulary``: path of the model file."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        counter = kept_in_worker(("count", vocabulary), lambda: PieceCounter(shared.value))
        for (column,) in batches:
            yield [pa.array([counter.of(t) for t in texts(column)], pa.int64())]

    return add_columns(docs, keep, [text], "n_tokens bigint", compute)
