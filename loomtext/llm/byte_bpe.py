"""Byte-level BPE encoding and decoding by recursive queries of an in-process DuckDB.

Spark deals the texts; every task holds one small in-memory database with the merge table. A text is cut
into words by the tokenizer's pattern. Different words of a slice of texts become rows (word, position,
token), one per byte. A recursive query joins neighbouring rows with the merge table, contracts each
word's leftmost pair of least rank, and goes on until no row joins. Words up to ``LONG_WORD`` bytes take one
contraction a round. Longer ones contract all occurrences of their least pair in one round, which is
the same unless a new pair has a smaller rank than the one before; words in which that happens are
done again one contraction at a time. A word that is a token itself is that token, as in the tokenizer.
Decoding joins (text, position, token) rows with the vocabulary and aggregates their bytes in order.

Words are kept with their ids, in a table of bounded size. Queries take at most ``QUERY_ROWS`` rows, or one
word or text.

Defined cases: NULL and empty texts have no ids, and no or NULL ids decode to no bytes. Ids that the vocabulary
does not hold decode to nothing. Every row is encoded for itself, so repeated rows and ids stay; an empty
table gives an empty result. Texts of any length are encoded whole. A kept column with the name of a result
gives way to it; columns not in ``keep`` are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.arrow import add_columns, kept_in_worker, texts

#: Bytes up to which a word is contracted pair by pair.
LONG_WORD = 64
#: Rows that a query starts with, unless one word or text alone has more.
QUERY_ROWS = 400_000
#: Words kept with their ids, and the length up to which they are.
CACHED_WORDS = 500_000
CACHED_LENGTH = 100
#: Characters up to which a text is cut into words at once, and words taken from longer ones at a time.
CUT_AT_ONCE = 1_000_000
CUT_WORDS = 200_000
MEMORY = "250MB"

#: A key is rank and position in one number, so its minimum is the leftmost pair of least rank.
LEFTMOST = """
WITH RECURSIVE steps(word, ids) USING KEY (word) AS (
  SELECT word, list(token ORDER BY pos) FROM start GROUP BY word
  UNION ALL (
    WITH pairs AS (
      SELECT word, generate_subscripts(ids, 1) AS pos, unnest(ids) AS token,
             unnest(ids[2:] || [NULL]) AS following
      FROM steps),
    best AS (
      SELECT word, min((merged::BIGINT << 32) | pos) AS key
      FROM pairs JOIN merges ON first = token AND second = following GROUP BY word)
    SELECT word, ids[: (key & 4294967295) - 1] || [(key >> 32)::INTEGER] || ids[(key & 4294967295) + 2 :]
    FROM best JOIN steps USING (word)))
SELECT word, ids, false AS again FROM steps
"""
#: All occurrences of the least pair; of overlapping ones every other, from the left.
EVERY = """
WITH RECURSIVE steps(word, pos, token, rank, again) USING KEY (word, pos) AS (
  SELECT word, pos, token, -1, false FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT word, pos, token, rank, again, lead(token) OVER w AS following,
             row_number() OVER w AS place
      FROM steps WHERE token IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS MATERIALIZED (
      SELECT p.*, merged, alone FROM pairs p
      LEFT JOIN merges ON first = token AND second = following),
    best AS (
      SELECT word, min(merged) AS least, arg_min(alone, merged) AS alone,
             arg_min(place, (merged::BIGINT << 32) | place) AS leftmost
      FROM ranked WHERE merged IS NOT NULL GROUP BY word),
    hits AS (
      SELECT r.word, pos, token, rank, again, place, least,
             coalesce(merged = least AND (NOT b.alone OR place = leftmost), false) AS hit
      FROM ranked r JOIN best b USING (word)),
    lefts AS (
      SELECT *, hit AND (place - coalesce(max(CASE WHEN NOT hit THEN place END) OVER w, 0)) % 2 = 1
                AS taken
      FROM hits WINDOW w AS (PARTITION BY word ORDER BY place)),
    chosen AS (
      SELECT *, lag(taken) OVER (PARTITION BY word ORDER BY place) AS absorbed FROM lefts)
    SELECT word, pos, CASE WHEN taken THEN least WHEN absorbed THEN NULL ELSE token END,
           least, again OR least < rank
    FROM chosen))
SELECT word, list(token ORDER BY pos) AS ids, bool_or(again) AS again
FROM steps WHERE token IS NOT NULL GROUP BY word
"""
DECODE = """
SELECT place, unhex(string_agg(spelled, '' ORDER BY pos)) AS decoded
FROM (SELECT place, unnest(ids) AS token, generate_subscripts(ids, 1) AS pos FROM encoded)
JOIN vocabulary USING (token) GROUP BY place
"""
#: A pair is contracted alone where joining its result with its own first token ranks below it.
MERGES = """
CREATE TABLE merges AS
SELECT a.first, a.second, a.merged, coalesce(b.merged < a.merged, false) AS alone
FROM pairs a LEFT JOIN pairs b ON b.first = a.merged AND b.second = a.first
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks, of a file with a base64 token and a rank on every line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks a token for some byte")
    return ranks


def _database():
    import duckdb

    # Nothing is spilled: what a query holds is bounded, and no folder of the machine is used.
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive items of at most ``QUERY_ROWS`` in all, or one larger item."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + QUERY_ROWS, side="right")))
        yield slice(at, to)
        at = to


class Encoder:
    """Ids of words and texts, with a database of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        joined = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        columns = zip(*joined, strict=True) if joined else ((), (), ())
        self.database = _database()
        arrays = [pa.array(c, pa.int32()) for c in columns]
        self.database.register("pairs", pa.table(arrays, names=["first", "second", "merged"]))
        self.database.execute(MERGES)
        # When the newer half is full it becomes the older one, whose words move up when met again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """All words in order; those of long texts in blocks."""
        if len(text) <= CUT_AT_ONCE:
            yield self.find.findall(text)
            return
        found = (m.group() for m in self.find.finditer(text))
        while block := list(islice(found, CUT_WORDS)):
            yield block

    def contracted(self, words: list[bytes], rounds: str = LEFTMOST) -> list[bytes]:
        """Ids of words, as 32-bit integers, by contracting pairs."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for run in _runs(sizes):
            n = sizes[run]
            word = np.repeat(np.arange(run.start, run.stop, dtype=np.int64), n)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            token = self.of_byte[np.frombuffer(b"".join(words[run]), np.uint8)]
            start = pa.table({"word": word, "pos": pos.astype(np.int32), "token": token})
            self.database.register("start", start)
            done = self.database.sql(rounds).to_arrow_table().combine_chunks()
            ids = done["ids"].combine_chunks()
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            places = done["word"].to_pylist()
            for k, place in enumerate(places):
                out[place] = flat[ends[k] : ends[k + 1]].tobytes()
            again = [p for p, a in zip(places, done["again"].to_pylist(), strict=True) if a]
            for place in again:
                out[place] = self.contracted([words[place]])[0]
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known yet; ordinary ones are kept."""
        short, long_, found = [], [], {}
        for word in words:
            spelled = word.encode()
            rank = self.ranks.get(spelled)
            if rank is not None:
                found[word] = np.int32(rank).tobytes()
            else:
                (short if len(spelled) <= LONG_WORD else long_).append((word, spelled))
        for group, rounds in ((short, LEFTMOST), (long_, EVERY)):
            ids = self.contracted([spelled for _, spelled in group], rounds)
            found.update((word, i) for (word, _), i in zip(group, ids, strict=True))
        self.known.update((w, i) for w, i in found.items() if len(w) <= CACHED_LENGTH)
        return found

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of every text, as 32-bit integers."""
        cut = [self.words(text) for text in batch]
        if sum(map(len, batch)) <= 8 * CUT_AT_ONCE:
            blocks = [list(c) for c in cut]
            return self._looked_up(blocks)
        return [b"".join(self._looked_up([[b]])[0] for b in c) for c in cut]

    def _looked_up(self, cut: list[list[list[str]]]) -> list[bytes]:
        met = set().union(*(block for blocks in cut for block in blocks))
        found = {}
        for word in met:
            ids = self.known.get(word)
            if ids is None and (ids := self.older.get(word)) is not None:
                self.known[word] = ids
            if ids is not None:
                found[word] = ids
        found |= self.learn(met - found.keys())
        out = [b"".join(map(found.__getitem__, chain.from_iterable(blocks))) for blocks in cut]
        if len(self.known) >= CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        return out


class Decoder:
    """Bytes of ids, with a database of its own."""

    def __init__(self, ranks: dict[bytes, int]):
        self.database = _database()
        spelled = pa.array([token.hex() for token in ranks], pa.string())
        tokens = pa.array(list(ranks.values()), pa.int32())
        self.database.register("tokens", pa.table({"token": tokens, "spelled": spelled}))
        self.database.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")

    def decode(self, column: pa.Array) -> list[bytes]:
        """The bytes of every row of a list column."""
        out = [b""] * len(column)
        sizes = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
        for run in _runs(sizes):
            places = pa.array(range(run.start, run.stop), pa.int64())
            rows = column.slice(run.start, run.stop - run.start)
            self.database.register("encoded", pa.table({"place": places, "ids": rows}))
            for place, decoded in self.database.execute(DECODE).fetchall():
                out[place] = decoded
        return out


def encode_byte_bpe(
    docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", keep: list[str]
) -> DataFrame:
    """The ``keep`` columns of every row with ``ids``, the tokens of its text without special ones.

    ``ranks``: path of a file of tokens and ranks on the driver. ``pattern``: what a word is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        encoder = kept_in_worker(
            ("byte-bpe", ranks, pattern), lambda: Encoder(shared.value, pattern)
        )
        for (column,) in batches:
            rows = encoder.encode(texts(column))
            ends = np.cumsum([0] + [len(r) // 4 for r in rows])
            flat = np.frombuffer(b"".join(rows), np.int32)
            yield [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return add_columns(docs, keep, [text], "ids array<int>", compute)


def decode_byte_bpe(
    encoded: DataFrame, ranks: str, *, ids: str = "ids", keep: list[str]
) -> DataFrame:
    """The ``keep`` columns of every row with ``decoded``, the bytes of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        decoder = kept_in_worker(("byte-bpe-back", ranks), lambda: Decoder(shared.value))
        for (column,) in batches:
            yield [pa.array(decoder.decode(column), pa.binary())]

    return add_columns(encoded, keep, [ids], "decoded binary", compute)
