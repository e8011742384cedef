"""SentencePiece encoding with seeded merge dropout, and decoding.

Symbols are merged by an agenda, best piece first and leftmost first among equals, as the tokenizer
does. Every candidate taken from the agenda is skipped with the probability ``dropout``. Draws come from
a keyed hash of the seed, the text and the place of the word in it, so every occurrence of a word is
segmented for itself, yet the same on every run and every executor; a lost task repeats it exactly.
Without dropout the ids are the tokenizer's own. Other seeds, one per epoch for instance, give other
segmentations. With a number of ``variants``, occurrences are dealt to that many segmentations of each
word instead.

A draw is the list of candidates to skip, by their number in the order in which they are taken. Words are kept
with what they give if nothing is skipped; occurrences that skip something are merged side by side in NumPy, a
candidate of each at a time. Long or odd words go through the agenda one by one, kept by word and skipped candidates.

Encoding is lossless: characters that are no piece become their UTF-8 bytes, and so does a literal
U+2581, which the tokenizer would turn into a space.

Defined cases: NULL and empty texts have no ids; decoding no or NULL ids gives the empty text. Rows are
encoded one by one, repeated or not; equal texts get equal ids. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomtext.llm.arrow import add_columns, kept_in_worker, texts
from loomtext.llm.pieces import SPACE, Vocabulary, read_vocabulary

CACHED_WORDS = 300_000
CACHED_LENGTH = 200
MASK = (1 << 64) - 1
#: Multipliers of the keyed hash.
LEFT, SIZE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9
MIX_AGAIN = 0x94D049BB133111EB
#: More candidates than any word has.
NEVER = 1 << 60
LONGEST_GAP = 400_000
NO_PAIR = 1 << 70
#: Words up to this length are merged by scanning a short list, which gives the agenda's result faster.
SCANNED_LENGTH = 64
#: Occurrences that are merged side by side, in rows of these widths, and characters of the texts taken together.
ROWS, WIDTHS, TAKEN_TOGETHER = 16_384, (8, 16, 32, SCANNED_LENGTH), 500_000
#: Rank and id of no piece, in arrays.
NOTHING = 1 << 62
#: Stands for a literal U+2581: longer than a character, so it is in no piece.
LITERAL = "\0\0"


class Numbers(dict):
    """Word -> its number in the order in which words were met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Segmenter:
    """Segments words of texts.

    Its tables of words are bounded. That of numbered words is emptied when it is full. Of the other, the newer half
    becomes the older one when it is full, whose words move up again when they are met and are forgotten otherwise.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, variants: int | None):
        pieces = list(zip(vocabulary.pieces, vocabulary.scores, vocabulary.ids, strict=True))
        self.id = {p: i for p, _, i in pieces}
        place = {score: k for k, score in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.rank = {p: place[s] for p, s, _ in pieces if len(p) > 1}
        # The same by pairs of ids, for every way to cut a piece in two: rank and id in one number.
        self.merged = {
            (self.id[p[:k]], self.id[p[k:]]): place[s] << 32 | i
            for p, s, i in pieces
            for k in range(1, len(p))
            if p[:k] in self.id and p[k:] in self.id
        }
        # Such numbers order like ranks if no two pieces share one; pieces of spaces alone may.
        worded = [s for p, s, _ in pieces if p.strip(SPACE)]
        self.scanned_length = SCANNED_LENGTH if len(set(worded)) == len(worded) else 0
        self.of_character = {" " if p == SPACE else p: i for p, i in self.id.items() if len(p) == 1}
        self.bytes = vocabulary.bytes_
        self.dropout = dropout
        # Of 2**53 equally likely draws, those that let so many candidates by at least; rising.
        below, self.below = 1 << 53, []
        while 0 < dropout and (below := int(below * (1 - dropout))) and len(self.below) < LONGEST_GAP:
            self.below.append(below)
        self.below.reverse()
        self.below_array = np.array(self.below, np.uint64)
        self.seed = seed
        self.variants = variants
        # By word, or word and skipped candidates: the number of candidates taken, and the ids.
        self.known: dict[str | tuple, tuple[int, bytes]] = {}
        self.older: dict[str | tuple, tuple[int, bytes]] = {}
        self.no_piece = max(vocabulary.ids) + 1
        pairs = np.array([a * (self.no_piece + 1) + b for a, b in self.merged], np.int64)
        self.pairs, self.pair_values = np.sort(pairs), np.array(list(self.merged.values()), np.int64)[np.argsort(pairs)]
        self.forget()
        # No piece holds a space after another character, so words are segmented alone.
        self.unit = re.compile(" *[^ \n]+|\n+| +" if vocabulary.cuts_at_newline else " *[^ ]+| +")

    def forget(self) -> None:
        """Empties the table of numbered words."""
        self.numbers, self.held = Numbers(), 0
        # By number: candidates taken if none is skipped (-1: long or odd), where its characters and its ids are.
        self.taken, self.lengths, self.sizes = (np.empty(0, np.int64) for _ in range(3))
        self.characters, self.pieces = (np.empty(0, np.int32) for _ in range(2))

    def gaps(self, states: np.ndarray) -> np.ndarray:
        """How many candidates every state lets by before it skips one."""
        if self.dropout <= 0:
            return np.full(len(states), NEVER)
        x = (states ^ (states >> np.uint64(30))) * np.uint64(MIX)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_AGAIN)
        x = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
        return len(self.below) - np.searchsorted(self.below_array, x, side="right")

    def firsts(self, states: np.ndarray) -> list[int]:
        """The first of ``skips`` of every state."""
        return self.gaps(states).tolist()

    def skips(self, state: int) -> Iterator[int]:
        """The numbers of the candidates to skip, rising."""
        at, below = -1, self.below
        if self.dropout <= 0:
            yield NEVER
        while True:
            x = (state ^ (state >> 30)) * MIX & MASK
            x = (x ^ (x >> 27)) * MIX_AGAIN & MASK
            at += len(below) - bisect_right(below, (x ^ (x >> 31)) >> 11) + 1
            yield at
            state = (state * LEFT + SIZE) & MASK

    def ids(self, unit: str, state: int) -> list[int]:
        """Ids of one word with its spaces."""
        return self.segmented(unit, self.skips(state))[2]

    def ids_by_heap(self, unit: str, state: int) -> list[int]:
        return self.segmented_by_heap(unit, self.skips(state))[2]

    def segmented(self, unit: str, skips: Iterator[int]) -> tuple[int, tuple[int, ...], list[int]]:
        """How many candidates were taken, which were skipped, and the ids."""
        symbols = list(map(self.of_character.get, unit))
        if None in symbols or "  " in unit or len(unit) > self.scanned_length:
            return self.segmented_by_heap(unit, skips)
        merged, taken, skipped, skip = self.merged, -1, [], next(skips)
        pairs = [merged.get(p, NO_PAIR) for p in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NO_PAIR:
                break
            at = pairs.index(best)
            taken += 1
            if taken == skip:
                skipped.append(skip)
                skip = next(skips)
                pairs[at] = NO_PAIR
                continue
            symbols[at] = piece = best & 0xFFFFFFFF
            del symbols[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = merged.get((piece, symbols[at + 1]), NO_PAIR)
            if at:
                pairs[at - 1] = merged.get((symbols[at - 1], piece), NO_PAIR)
        return taken + 1, tuple(skipped), symbols

    def segmented_by_heap(
        self, unit: str, skips: Iterator[int]
    ) -> tuple[int, tuple[int, ...], list[int]]:
        """The same for words of any length and with characters that are no piece."""
        symbols = [SPACE if c == " " else LITERAL if c == SPACE else c for c in unit]
        n = len(symbols)
        before, after, sizes = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        rank, agenda = self.rank, []
        taken, skipped, skip = -1, [], next(skips)

        def offer(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            if pair in rank:
                agenda_item = (rank[pair], left, right, sizes[left] + sizes[right])
                heapq.heappush(agenda, agenda_item)

        for left in range(n - 1):
            offer(left, left + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not sizes[left] or not sizes[right] or sizes[left] + sizes[right] != size:
                continue
            taken += 1
            if taken == skip:
                skipped.append(skip)
                skip = next(skips)
                continue
            symbols[left] += symbols[right]
            sizes[left], sizes[right], symbols[right] = size, 0, ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                offer(left, following)
            if before[left] >= 0:
                offer(before[left], left)
        out = []
        for symbol in symbols:
            if symbol in self.id:
                out.append(self.id[symbol])
            else:
                spelled = SPACE if symbol == LITERAL else symbol
                out.extend(self.bytes[b] for b in spelled.encode())
        return taken + 1, tuple(skipped), out

    def states(self, text: str, units: list[str]) -> np.ndarray:
        """One per occurrence of a word, or one per word and variant."""
        base = xxhash.xxh3_64_intdigest(text.encode(), self.seed & MASK)
        states = np.uint64(base) + np.arange(len(units), dtype=np.uint64) * np.uint64(LEFT)
        if self.variants is None:
            return states
        dealt = (((states ^ (states >> np.uint64(29))) * np.uint64(MIX)) >> np.uint64(33)) % np.uint64(self.variants)
        keys = [
            xxhash.xxh3_64_intdigest(unit.encode(), (self.seed * 1_000_003 + variant) & MASK)
            for unit, variant in zip(units, dealt.tolist(), strict=True)
        ]
        return np.array(keys, np.uint64)

    def merge_values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of the pieces that pairs of ids make."""
        wanted = left.astype(np.int64) * (self.no_piece + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_values[at], NOTHING)

    def merged_rows(
        self, symbols: np.ndarray, lengths: np.ndarray, states: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``segmented`` for rows of ids of characters, one word a row, filled up with ``no_piece``: how many
        candidates were taken, and ids and their number. Without states nothing is skipped."""
        columns, rows = np.arange(symbols.shape[1]), np.arange(len(symbols))
        found, sizes, counts = symbols.copy(), lengths.copy(), np.zeros(len(symbols), np.int64)
        pairs = np.full(symbols.shape, NOTHING)
        pairs[:, :-1] = self.merge_values(symbols[:, :-1], symbols[:, 1:])
        skip = np.full(len(symbols), NEVER) if states is None else self.gaps(states)
        number = -1
        while True:
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(len(at)), at]
            live = best < NOTHING
            number += 1
            if not live.all():
                done = rows[~live]
                found[done], counts[done], sizes[done] = symbols[~live], number, lengths[~live]
                rows, symbols, lengths, pairs = rows[live], symbols[live], lengths[live], pairs[live]
                at, best, skip = at[live], best[live], skip[live]
                states = None if states is None else states[live]
            if not len(rows):
                return counts, found, sizes
            hit = skip == number
            skipped, m = np.flatnonzero(hit), np.flatnonzero(~hit)
            if len(skipped):
                pairs[skipped, at[skipped]] = NOTHING
                states[skipped] = states[skipped] * np.uint64(LEFT) + np.uint64(SIZE)
                skip[skipped] += self.gaps(states[skipped]) + 1
            at, piece = at[m], best[m] & 0xFFFFFFFF
            one, several = np.arange(len(m)), symbols[m]
            after = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            several = np.take_along_axis(several, after, axis=1)
            several[:, -1] = self.no_piece
            several[one, at] = piece
            after = np.minimum(columns + (columns >= at[:, None]), len(columns) - 1)
            moved = np.take_along_axis(pairs[m], after, axis=1)
            moved[one, at] = self.merge_values(piece, several[one, np.minimum(at + 1, len(columns) - 1)])
            left = np.flatnonzero(at)
            moved[left, at[left] - 1] = self.merge_values(several[left, at[left] - 1], piece[left])
            symbols[m], pairs[m] = several, moved
            lengths[m] -= 1

    def merged_words(
        self, words: np.ndarray, states: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates taken, number of ids and all ids, one after another, of numbered words."""
        lengths, starts = self.lengths[words], (np.cumsum(self.lengths) - self.lengths)[words]
        counts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, order, narrower = [], [], 0
        for width in WIDTHS:
            fit = np.flatnonzero((lengths > narrower) & (lengths <= width))
            narrower = width
            for k in range(0, len(fit), ROWS):
                some = fit[k : k + ROWS]
                columns = np.arange(width + 1)  # the last stays free
                inside = columns < lengths[some, None]
                symbols = np.full(inside.shape, self.no_piece, np.int32)
                symbols[inside] = self.characters[(starts[some, None] + columns)[inside]]
                drawn = None if states is None else states[some].copy()
                counts[some], found, sizes[some] = self.merged_rows(symbols, lengths[some], drawn)
                parts.append(found[columns < sizes[some, None]])
                order.append(some)
        if not order:
            return counts, sizes, np.empty(0, np.int32)
        order = np.concatenate(order)
        begins = np.empty(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return counts, sizes, gathered(np.concatenate(parts), begins, sizes)

    def number_words(self, units: list[str]) -> np.ndarray:
        """The number of every word; new ones are segmented with nothing skipped."""
        numbers = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        known, lengths, characters = len(self.taken), [], []
        for unit in islice(self.numbers, known, None):
            symbols = list(map(self.of_character.get, unit))
            odd = None in symbols or "  " in unit or len(unit) > self.scanned_length
            lengths.append(0 if odd else len(symbols))
            characters += [] if odd else symbols
            self.held += len(unit)
        if not lengths:
            return numbers
        self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int64)])
        self.characters = np.concatenate([self.characters, np.array(characters, np.int32)])
        fresh = np.arange(known, len(self.lengths))
        counts, sizes, ids = self.merged_words(fresh, None)
        counts[self.lengths[fresh] == 0] = -1
        self.taken = np.concatenate([self.taken, counts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pieces = np.concatenate([self.pieces, ids])
        return numbers

    def encode_all(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text after another, and how many each has."""
        units, drawn, ends = [], [np.empty(0, np.uint64)], []
        for body in bodies:
            own = self.unit.findall(" " + body) if body else []
            if own:
                units += own
                drawn.append(self.states(body, own))
            ends.append(len(units))
        states = np.concatenate(drawn)
        numbers, firsts = self.number_words(units), self.gaps(states)
        taken = self.taken[numbers]
        # Whole words from the table, then those that skip something, then long and odd ones.
        sizes, begins = self.sizes[numbers], (np.cumsum(self.sizes) - self.sizes)[numbers]
        dropped = np.flatnonzero(firsts < taken)
        _, sizes[dropped], ids = self.merged_words(numbers[dropped], states[dropped])
        begins[dropped] = len(self.pieces) + np.cumsum(sizes[dropped]) - sizes[dropped]
        odd, others, at = np.flatnonzero(taken < 0), [], len(self.pieces) + len(ids)
        for k in odd.tolist():
            others.append(np.frombuffer(self.encode_odd(units[k], int(firsts[k]), int(states[k])), np.int32))
            begins[k], sizes[k] = at, len(others[-1])
            at += len(others[-1])
        found = gathered(np.concatenate([self.pieces, ids, *others]), begins, sizes)
        if len(self.known) >= CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        if len(self.numbers) >= CACHED_WORDS or self.held >= CACHED_WORDS * 20:
            self.forget()
        total = np.concatenate([[0], np.cumsum(sizes)])[[0, *ends]]
        return found, np.diff(total)

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def encode_odd(self, unit: str, skip: int, state: int) -> bytes:
        """The ids of an occurrence of a word, by the table of words and skipped candidates."""
        known, key, gaps = self.known, unit, None
        while True:
            entry = known.get(key)
            if entry is None:
                entry = self.older.get(key)
                if entry is None:
                    taken, skipped, ids = self.segmented(unit, self.skips(state))
                    entry = taken, array("i", ids).tobytes()
                    key, skip = (unit, *skipped) if skipped else unit, taken
                if len(unit) <= CACHED_LENGTH:
                    known[key] = entry
            if skip >= entry[0]:
                return entry[1]
            if gaps is None:
                gaps = self.skips(state)
                next(gaps)
                key = (unit, skip)
            else:
                key = (*key, skip)
            skip = next(gaps)


def gathered(source: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parts of an array, one after another."""
    ends = np.cumsum(sizes)
    return source[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def together(bodies: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about TAKEN_TOGETHER characters."""
    group, size = [], 0
    for body in bodies:
        group.append(body)
        size += len(body)
        if size >= TAKEN_TOGETHER:
            yield group
            group, size = [], 0
    yield group


class Joiner:
    """Turns ids back into texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.spelled = dict.fromkeys(range(max(vocabulary.ids + vocabulary.bytes_) + 1), b"")
        for piece, i in zip(vocabulary.pieces, vocabulary.ids, strict=True):
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        for byte, i in enumerate(vocabulary.bytes_):
            self.spelled[i] = bytes([byte])

    def decode(self, ids: Iterable[int]) -> str:
        """The text; the space that encoding put in front is taken off."""
        joined = b"".join(map(self.spelled.__getitem__, ids))
        return joined.decode(errors="replace").removeprefix(" ")


def encode_pieces(
    docs: DataFrame,
    vocabulary: str,
    *,
    text: str = "text",
    keep: list[str],
    dropout: float = 0.1,
    seed: int = 0,
    variants: int | None = None,
) -> DataFrame:
    """The ``keep`` columns of every row with ``ids``, and with ``lossless``: whether decoding them
    gave the text back (NULL as empty). ``vocabulary``: path of the model file."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        segmenter = kept_in_worker(
            ("merge", vocabulary, dropout, seed, variants),
            lambda: Segmenter(shared.value, dropout, seed, variants),
        )
        joiner = Joiner(shared.value)
        for (column,) in batches:
            found, sizes, lossless = [], [], []
            for bodies in together(texts(column)):
                ids, counts = segmenter.encode_all(bodies)
                found.append(ids)
                sizes.append(counts)
                ends = np.cumsum(counts)
                for body, begin, end in zip(bodies, (ends - counts).tolist(), ends.tolist(), strict=True):
                    lossless.append(joiner.decode(ids[begin:end].tolist()) == body)
            ends = np.cumsum(np.concatenate([[0], *sizes]))
            yield [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32())),
                pa.array(lossless, pa.bool_()),
            ]

    return add_columns(docs, keep, [text], "ids array<int>, lossless boolean", compute)


def decode_pieces(
    encoded: DataFrame, vocabulary: str, *, ids: str = "ids", keep: list[str]
) -> DataFrame:
    """The ``keep`` columns of every row with ``decoded``, the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        joiner = Joiner(shared.value)
        for (column,) in batches:
            yield [pa.array([joiner.decode(x or []) for x in column.to_pylist()], pa.string())]

    return add_columns(encoded, keep, [ids], "decoded string", compute)
