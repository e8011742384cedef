"""Benchmark decontamination with an FM-index per shard of training text.

Texts become sequences of word numbers. Each task gathers texts into shards of bounded length, sorts
their suffixes, and keeps the Burrows-Wheeler transform in a wavelet matrix. All windows of the
benchmark are searched backward at once, a word at a time, through ranks in the matrix; occurrences are
located by walking back to the next sampled suffix position, and the spans found are merged per text.

Only words of the benchmark can match, so all other words share one number, and stretches shorter than
the shortest window with no other word left are not indexed; no occurrence is lost by that.

Defined cases: words are ASCII letters (lower-cased), digits and all non-ASCII characters; NULL, empty
and word-less texts and items have no words and hit nothing. An item shorter than a window is one
window itself. Repeated items and rows each count by themselves; items with equal ids count as one. An
empty benchmark hits nothing. Item ids are compared as text. Columns not in
``keep`` are ignored; a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.arrow import add_columns, raw

WINDOW_WORDS = 10
#: Words indexed at once; bounds the memory of a task.
SHARD_WORDS = 1_000_000
#: Every so many suffix positions one is kept.
SAMPLE_STEP = 16
#: Windows searched in one pass over the texts; bounds what is broadcast.
BLOCK_WINDOWS = 200_000

#: Bytes of words, lower-cased; all others become spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def benchmark_words(text: Column) -> Column:
    """The words of a text as an array column."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(
        lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)
    )
    return F.coalesce(found, F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows of all items with the ids they come from: (words, items)."""
    words = items.select(
        F.col(item_id).cast("string").alias("item"), benchmark_words(F.col(text)).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return (
        words.withColumn("at", F.explode(starts))
        .select("item", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
    )


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by doubling; only unsettled groups are sorted again.

    ``s`` ends with 0, which occurs nowhere else.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    keys = s[order]
    starts = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step = 1
    ends = np.concatenate([starts[1:], [True]])
    unsettled = np.flatnonzero(~(starts & ends))
    while len(unsettled):
        at = order[unsettled]
        group = rank[at]
        following = rank[np.minimum(at + step, n - 1)]
        by = np.lexsort((following, group))
        at, group, following = at[by], group[by], following[by]
        order[unsettled] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, unsettled, 0))
        alone = new & np.concatenate([new[1:], [True]])
        unsettled = unsettled[~alone]
        step *= 2
    return order


class Bits:
    """A bit vector with ranks: counts per 64-bit word, the rest by population count."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletMatrix:
    """Ranks and access over a sequence of small numbers, one bit vector per binary digit."""

    def __init__(self, s: np.ndarray):
        self.levels = []
        for shift in range(max(int(s.max()).bit_length(), 1) - 1, -1, -1):
            bit = (s >> shift) & 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit.astype(bool)), zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        begin = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            ones_i, ones_b = bits.ones(i), bits.ones(begin)
            i = np.where(one, zeros + ones_i, i - ones_i)
            begin = np.where(one, zeros + ones_b, begin - ones_b)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
            symbol |= one.astype(np.int64) << shift
        return symbol


class FMIndex:
    """Counts and finds number sequences in ``s``, which ends with its only 0."""

    def __init__(self, s: np.ndarray):
        order = suffix_order(s)
        self.tree = WaveletMatrix(s[order - 1])
        counts = np.bincount(s)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        sampled = order % SAMPLE_STEP == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all windows (numbers, left-aligned) by backward steps."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), self.smaller[-1])
        for back in range(1, windows.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = windows[live, lengths[live] - back]
            inside = symbol < len(self.smaller) - 1
            high[live[~inside]] = low[live[~inside]]
            live, symbol = live[inside], symbol[inside]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        where = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        rows = rows.astype(np.int64)
        while len(open_):
            done = self.sampled.get(rows).astype(bool)
            where[open_[done]] = self.positions[self.sampled.ones(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol = self.tree.access(rows)
            rows = self.smaller[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return where


class Phrases:
    """The windows of one block as numbers over the block's own words."""

    def __init__(self, rows: list[tuple[list[str], list[str]]]):
        self.number = {}
        for words, _ in rows:
            for w in words:
                self.number.setdefault(w.encode(), len(self.number) + 2)
        self.lengths = np.array([len(w) for w, _ in rows], np.int64)
        self.windows = np.zeros((len(rows), int(self.lengths.max(initial=1))), np.int64)
        for k, (words, _) in enumerate(rows):
            self.windows[k, : len(words)] = [self.number[w.encode()] for w in words]
        self.items = [items for _, items in rows]
        self.shortest = int(self.lengths.min(initial=1))

    def stretches(self, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words in long enough stretches, each followed by 1, and their places."""
        get = self.number.get
        numbers = np.fromiter((get(w, 1) for w in text), np.int64, len(text))
        edge = np.flatnonzero(np.concatenate([[True], numbers == 1, [True]]))
        long = np.flatnonzero(np.diff(edge) - 1 >= self.shortest)
        kept = [np.arange(edge[k], edge[k + 1]) for k in long]  # the last place is an edge
        places = np.concatenate(kept) if kept else np.empty(0, np.int64)
        return np.append(numbers, 1)[places], places

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and start of every occurrence in a shard."""
        if not len(numbers) or not len(self.lengths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = FMIndex(np.append(numbers, 0))
        low, high = index.search(self.windows, self.lengths)
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.repeat(low, counts) + np.arange(len(which)) - first
        return which, index.locate(rows)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, ends exclusive."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [tuple(s) for s in spans]


def _searched(phrases: Phrases, texts: list[bytes]) -> Iterator[tuple[int, list, list[str]]]:
    """Words, merged spans of word places, and items found, of each text in turn."""
    found: list[tuple[int, list, list]] = []
    shard: list[np.ndarray] = []
    parts: list[tuple[int, np.ndarray]] = []  # text and places, a row per indexed stretch
    size = 0

    def flush():
        nonlocal shard, parts, size
        if shard:
            owner = np.repeat([t for t, _ in parts], [len(p) for _, p in parts])
            places = np.concatenate([p for _, p in parts])
            which, where = phrases.find(np.concatenate(shard))
            by = np.argsort(owner[where], kind="stable")
            which, where = which[by], where[by]
            edges = np.flatnonzero(np.diff(owner[where])) + 1
            for w, p in zip(np.split(which, edges), np.split(where, edges), strict=True):
                if len(p):
                    _, spans, items = found[int(owner[p[0]])]
                    spans.append((places[p], places[p] + phrases.lengths[w]))
                    items.append(np.unique(w))
        shard, parts, size = [], [], 0

    for text in texts:
        words = words_of(text)
        numbers, places = phrases.stretches(words)
        found.append((len(words), [], []))
        # Texts longer than a shard are cut in pieces that overlap by all but one word of a window.
        overlap = int(phrases.lengths.max(initial=1)) - 1
        for at in range(0, max(len(numbers), 1), SHARD_WORDS):
            piece = slice(at, at + SHARD_WORDS + overlap)
            if len(numbers[piece]):
                shard.append(np.append(numbers[piece], 1))
                parts.append((len(found) - 1, np.append(places[piece], -1)))
                size += len(shard[-1])
            if size >= SHARD_WORDS:
                flush()
    flush()
    for n, spans, items in found:
        union = merged(
            np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])
        ) if spans else []
        names = {phrases.items[w][k] for ws in items for w in ws for k in range(len(phrases.items[w]))}
        yield n, union, sorted(names)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str],
    width: int = WINDOW_WORDS,
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_words``, ``spans`` and ``items``.

    ``spans`` are the merged places of words in occurrences, from ``start`` up to ``end`` exclusive.
    The benchmark is searched in blocks of bounded size, each a broadcast and a pass over the texts.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(items, item_id, item_text, width)
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    block = F.pmod(F.xxhash64("words"), F.lit(blocks))
    result = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
             pa.list_(pa.string())]
    rows, carried = docs, []
    for k in range(blocks):
        found = windows.where(block == k).collect()
        shared = spark.sparkContext.broadcast([(list(r.words), list(r["items"])) for r in found])

        def compute(batches: Iterator[list[pa.Array]], shared=shared) -> Iterator[list[pa.Array]]:
            phrases = Phrases(shared.value)
            for (column,) in batches:
                rows = list(_searched(phrases, raw(column)))
                yield [
                    pa.array([n for n, _, _ in rows], types[0]),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in rows], types[1]),
                    pa.array([i for _, _, i in rows], types[2]),
                ]

        keep = [c for c in keep if c not in ("n_words", "spans", "items")]
        wanted = list(dict.fromkeys([*keep, text])) if k < blocks - 1 else keep
        rows = add_columns(rows, [*wanted, *carried], [text], result, compute)
        names = {n: f"_{n}{k}" for n in ("n_words", "spans", "items")}
        if blocks > 1:
            rows = rows.withColumnsRenamed(names)
            carried += names.values()
    if blocks == 1:
        return rows
    every = F.array_sort(F.concat(*[f"_spans{k}" for k in range(blocks)]))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    union = F.aggregate(
        every,
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    named = F.array_distinct(F.flatten(F.array(*[f"_items{k}" for k in range(blocks)])))
    return rows.select(
        *keep, F.col("_n_words0").alias("n_words"), union.alias("spans"), F.array_sort(named).alias("items")
    )


_WORD = re.compile(rb"[^ ]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def remove_contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", keep: list[str], width: int = WINDOW_WORDS
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_removed`` words and ``remaining``, the text."""
    wanted = list(dict.fromkeys([*keep, text]))
    found = find_contamination(
        docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns}), items,
        text=f"_own_{text}", keep=[f"_own_{c}" for c in wanted], width=width,
    )

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for bodies, spans in batches:
            texts, removed = [], []
            for body, found in zip(bodies.to_pylist(), spans.to_pylist(), strict=True):
                pairs = [(s["start"], s["end"]) for s in found]
                removed.append(sum(b - a for a, b in pairs))
                texts.append(without_spans(body.encode(), pairs).decode() if pairs else body)
            yield [pa.array(removed, pa.int64()), pa.array(texts, pa.string())]

    kept = [f"_own_{c}" for c in keep if c not in ("n_removed", "remaining")]
    made = "n_removed bigint, remaining string"
    out = add_columns(found, kept, [f"_own_{text}", "spans"], made, compute)
    return out.withColumnsRenamed({c: c.removeprefix("_own_") for c in kept})
