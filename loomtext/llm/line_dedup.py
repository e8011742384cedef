"""Line dedup: later copies of runs of lines that occurred before are deleted.

A run counts if it holds at least ``min_words`` words. From every line on, the fewest lines with that
many words form a window; the least line hash of each window is a fingerprint (winnowing by weight),
so every repeated run that counts is guaranteed to share one. Fingerprints met at two places or more
are joined to their positions, and only there matches are extended both ways: all windows that reach
forward or backward over such a position are compared whole, by a 128-bit hash of their lines. A line
goes if it lies in a window that occurred earlier; windows that reach forward from a run's first line
or any later one, or backward, cover the run entirely, so maximal repeated runs are deleted to their
ends without ever pairing two later copies.

Shorter runs count where their lines are common: a line with a word in it that ``min_documents`` or more
different documents hold goes everywhere but at its earliest place, whatever its length. Documents are
counted exactly per 64-bit line hash. What stays are repeats of fewer words than ``min_words`` whose lines
fewer documents hold, and lines without words.

Earlier means a smaller id (NULL last), then a smaller hash of the text, then a smaller line number.

Defined cases: NULL and empty texts stay as they are. Rows with equal id and text are one document and
are treated alike. Copies within one text count, also overlapping ones. Lines are cut at line feeds and
compared exactly; words are cut at ASCII white space. An empty table gives no rows. Columns not in
``keep`` are ignored; a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.arrow import add_columns, raw
from loomtext.scratch import materialise
from loomtext.session import ship_package

MIN_WORDS = 40
#: Lines of any length that so many documents hold are common.
MIN_DOCUMENTS = 30
MASK = (1 << 64) - 1


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest windows that hold enough words, forward then backward."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + min_words)  # lines before which enough are held
    forward = np.flatnonzero(ends <= n)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    backward = np.flatnonzero(total[1:] >= min_words)
    first = np.concatenate([forward, starts[backward]])
    last = np.concatenate([ends[forward] - 1, backward])
    pairs = np.unique(np.stack([first, last], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def fingerprints(hashes: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Positions of the least hash in each window, the rightmost of equal ones."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)
    found, queue = set(), []  # queue: positions whose hash is below all later ones
    begin = until = 0
    for start in range(len(words)):
        if ends[start] > len(words):
            break
        while until < ends[start]:
            while len(queue) > begin and hashes[queue[-1]] >= hashes[until]:
                queue.pop()
            queue.append(until)
            until += 1
        while queue[begin] < start:
            begin += 1
        found.add(queue[begin])
    return np.array(sorted(found), np.int64)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per different document: line hashes and words per line."""

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (column,) in batches:
            hashes, words = [], []
            for body in raw(column):
                lines = body.split(b"\n")
                hashes.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines])
                words.append([len(x.split()) for x in lines])
            yield [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))]

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    lined = add_columns(rows, ["id", "key"], ["text"], "hashes array<bigint>, words array<int>", compute)
    return lined.dropDuplicates(["id", "key"])


def text_key(text):
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)


def _positions(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per fingerprint and place."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            for k, (h, w) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                h, w = h.values.to_numpy(), w.values.to_numpy()
                at = fingerprints(h, w, min_words)
                rows.append(np.full(len(at), k))
                hashes.append(h[at])
                places.append(at)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places), pa.int64())],
                    names=["id", "key", "fingerprint", "place"],
                )

    kind = lines.schema["id"].dataType.simpleString()
    return lines.select("id", "key", "hashes", "words").mapInArrow(
        compute, f"id {kind}, key string, fingerprint bigint, place bigint"
    )


def _worded(lines: DataFrame) -> DataFrame:
    """One row per document and different line with a word: hash, first place, all places."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, hashes, places = [], [], []
                for k in range(part.num_rows):
                    h = part.column(2)[k].values.to_numpy()
                    worded = np.flatnonzero(part.column(3)[k].values.to_numpy())
                    order = worded[np.argsort(h[worded], kind="stable")]
                    rows.append(np.full(len(order), k))
                    hashes.append(h[order])
                    places.append(order)
                rows, hashes, places = map(np.concatenate, (rows, hashes, places))
                starts = np.flatnonzero(
                    np.concatenate([[True], (np.diff(hashes) != 0) | (np.diff(rows) != 0)])[: len(rows)]
                )
                take = pa.array(rows[starts], pa.int64())
                ends = np.concatenate([starts, [len(rows)]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take),
                     pa.array(hashes[starts], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64()))],
                    names=["id", "key", "line", "places"],
                )

    kind = lines.schema["id"].dataType.simpleString()
    return lines.select("id", "key", "hashes", "words").mapInArrow(
        compute, f"id {kind}, key string, line bigint, places array<bigint>"
    )


def _common_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """Later places of lines that many documents hold: id, key, first and last, which are the same."""
    common = materialise(
        _worded(lines).groupBy("line").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_documents).select("line"),
        "common-lines",
    )
    held = materialise(_worded(lines).join(common, "line", "left_semi"), "common-places")
    place = F.struct(
        F.col("id").isNull().alias("no_id"), "id", "key", F.get("places", F.lit(0)).alias("first")
    )
    firsts = materialise(held.groupBy("line").agg(F.min(place).alias("earliest")), "first-lines")
    placed = held.join(firsts, "line").select(
        "id", "key", "earliest", F.explode("places").alias("first")
    )
    later = placed.where(
        ~(
            F.col("id").eqNullSafe(F.col("earliest.id"))
            & (F.col("key") == F.col("earliest.key"))
            & (F.col("first") == F.col("earliest.first"))
        )
    )
    return later.select("id", "key", "first", F.col("first").alias("last"))


def _extended(seeded: DataFrame, min_words: int) -> DataFrame:
    """One row per window over a seed: its hashes and its lines."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k in range(batch.num_rows):
                h = batch.column(2)[k].values.to_numpy()
                w = batch.column(3)[k].values.to_numpy()
                seeds = np.sort(batch.column(4)[k].values.to_numpy())
                first, last = windows(w, min_words)
                over = np.searchsorted(seeds, first) < np.searchsorted(seeds, last, side="right")
                first, last = first[over], last[over]
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    digest = xxhash.xxh3_128_intdigest(h[a : b + 1].tobytes())
                    found.append(((digest >> 64) - (1 << 63), (digest & MASK) - (1 << 63), a, b))
                    rows.append(k)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 *[pa.array([f[i] for f in found], pa.int64()) for i in range(4)]],
                names=["id", "key", "high", "low", "first", "last"],
            )

    kind = seeded.schema["id"].dataType.simpleString()
    return seeded.select("id", "key", "hashes", "words", "seeds").mapInArrow(
        compute, f"id {kind}, key string, high bigint, low bigint, first bigint, last bigint"
    )


def repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per document with something to delete: id, key of its text, windows of lines."""
    ship_package(docs.sparkSession)
    lines = materialise(_lines(docs, doc_id, text), "lines")
    positions = materialise(_positions(lines, min_words), "fingerprints")
    met_again = materialise(
        positions.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
        .select("fingerprint"),
        "repeated-fingerprints",
    )
    seeds = positions.join(met_again, "fingerprint", "left_semi")
    seeds = seeds.groupBy(F.col("id").alias("id2"), F.col("key").alias("key2")).agg(
        F.collect_list("place").alias("seeds")
    )
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    found = materialise(_extended(lines.join(seeds, same), min_words), "windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "first")
    firsts = materialise(
        found.groupBy("high", "low")
        .agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
        .where("n > 1")
        .select("high", "low", "earliest"),
        "first-windows",
    )
    later = found.join(firsts, ["high", "low"]).where(
        ~(
            F.col("id").eqNullSafe(F.col("earliest.id"))
            & (F.col("key") == F.col("earliest.key"))
            & (F.col("first") == F.col("earliest.first"))
        )
    )
    later = later.select("id", "key", "first", "last").unionByName(_common_lines(lines, min_documents))
    return later.groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def drop_repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str],
    min_words: int = MIN_WORDS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_lines``, ``n_deleted`` and ``remaining``, the text."""
    keep = [c for c in keep if c not in ("n_lines", "n_deleted", "remaining")]
    found = repeated_lines(
        docs, doc_id=doc_id, text=text, min_words=min_words, min_documents=min_documents
    )
    runs = materialise(found, "runs")
    rows = docs.select(
        *[F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)],
        F.col(doc_id).alias("_id"),
        F.col(text).alias("_text"),
        text_key(F.col(text)).alias("_key"),
    )
    joined = rows.join(
        runs, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left"
    )

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for bodies, spans in batches:
            texts, lines, deleted = [], [], []
            for body, found in zip(bodies.to_pylist(), spans.to_pylist(), strict=True):
                n = 0 if body is None else body.count("\n") + 1
                lines.append(n)
                if not found:
                    texts.append(body)
                    deleted.append(0)
                    continue
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, [r["first"] for r in found], 1)
                np.add.at(change, [r["last"] + 1 for r in found], -1)
                stays = np.cumsum(change[:n]) == 0
                texts.append("\n".join(x for x, s in zip(body.split("\n"), stays, strict=True) if s))
                deleted.append(n - int(stays.sum()))
            yield [pa.array(lines, pa.int64()), pa.array(deleted, pa.int64()), pa.array(texts, pa.string())]

    kept = [f"_kept{i}" for i in range(len(keep))]
    made = "n_lines bigint, n_deleted bigint, remaining string"
    return add_columns(joined, kept, ["_text", "runs"], made, compute).toDF(
        *keep, "n_lines", "n_deleted", "remaining"
    )
