"""LM scoring by the likelihood of a text's subword lattice, with word counts of the training texts.

Every way to cut a word into vocabulary pieces is weighted by the pieces' existing scores; a forward
recursion in log space sums all of them to the word's marginal probability. The vocabulary states merge
ranks, so a piece of rank r gets the probability (1 / (r + 1)) / H, Zipf's law; bytes of characters that
are no piece get that of the last rank. A token is a word (with its space in front) or the end of the
text. The training texts add whole words as further arcs of the lattice: with c of N training tokens and
V different ones, a token has probability c / (N + V) + V / (N + V) * lattice (Witten and Bell), so a
word never seen costs what its spelling says. ``score`` is the base-10 logarithm summed over the tokens,
``base_score`` the same for add-one word frequencies.

The lattice of each different word is computed once, after counting. Counts of the commonest
``HEAD_WORDS`` words are broadcast, a fixed number; all others meet their texts by a shuffle on the word,
so common words move nothing and rare ones little. Nothing else is gathered.

Defined cases: a NULL text is empty and has the end token only. A NULL id counts as remainder 0, so it
trains. Rows with equal id and text are scored alike, one result each, and all train. An empty table
gives no rows. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.arrow import add_columns, raw
from loomtext.llm.pieces import SPACE, Vocabulary, read_vocabulary
from loomtext.scratch import materialise
from loomtext.session import ship_package

#: Words with broadcast counts; a fixed number, whatever the input.
HEAD_WORDS = 150_000
#: Different words counted before a task hands them on.
COUNTED_WORDS = 300_000
#: The end of a text as a token: no word is empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


class Lattice:
    """Log probabilities of words over all their segmentations."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        place = {s: k for k, s in enumerate(sorted(set(vocabulary.scores), reverse=True))}
        weights = [1 / (place[s] + 1) for s in vocabulary.scores]
        last = 1 / (len(place) + 1)
        total = sum(weights) + 256 * last + 1  # all pieces, bytes and the end
        self.automaton = ahocorasick.Automaton()
        headed = 1.0  # of pieces that begin a token, the end among them
        for piece, weight in zip(vocabulary.pieces, weights, strict=True):
            self.automaton.add_word(piece, (len(piece), math.log(weight / total)))
            headed += weight if piece.startswith(SPACE) else 0.0
        self.automaton.make_automaton()
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.byte = math.log(last / total)
        # A token ends where another begins, and the end is a token: the shares cancel for words.
        self.end = math.log(1 / headed)

    def log_probability(self, word: bytes) -> float:
        """Natural logarithm for a token, by forward recursion over its characters."""
        if word == END:
            return self.end
        unit = SPACE + word.decode(errors="replace")
        forward, log, exp = [0.0], math.log, math.exp
        for end, (length, weight) in self.automaton.iter(unit):
            while len(forward) <= end:  # the places before end + 1 are complete
                self._through_bytes(unit, forward, len(forward))
            arc = forward[end + 1 - length] + weight
            if len(forward) == end + 1:
                forward.append(arc)
            else:
                other = forward[end + 1]
                top, low = (arc, other) if arc > other else (other, arc)
                forward[end + 1] = top + log(1.0 + exp(low - top))
        while len(forward) <= len(unit):
            self._through_bytes(unit, forward, len(forward))
        return forward[-1]

    def _through_bytes(self, unit: str, forward: list[float], place: int) -> None:
        """The only way to a place where no piece ends."""
        forward.append(forward[place - 1] + self.byte * len(unit[place - 1].encode()))


def held_out_by(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def token_counts(docs: DataFrame, text: str, held_out: Column) -> DataFrame:
    """One row per different token: the token as bytes, and its number in training texts."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), held_out.alias("held_out"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        training, others = Counter(), Counter()

        def partial():
            for word in others:
                training.setdefault(word, 0)
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(training), pa.binary()), pa.array(list(training.values()), pa.int64())],
                names=["token", "c"],
            )
            training.clear()
            others.clear()
            return out

        for batch in batches:
            for text, held in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counter = others if held else training
                counter.update(words_of(text))
                counter[END] += 1
                if len(training) + len(others) > COUNTED_WORDS:
                    yield partial()
        yield partial()

    partial = rows.mapInArrow(compute, "token binary, c bigint")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame) -> int:
    """The least count at which no more than ``HEAD_WORDS`` tokens are as common; at least 1.

    Found from a histogram over powers of 2 ** (1 / 16), a bounded number of bins.
    """
    bins = counts.where("c > 0").groupBy(F.floor(16 * F.log2("c")).cast("int").alias("bin")).count()
    least, total = None, 0
    for r in sorted(bins.collect(), reverse=True):
        total += r["count"]
        if total > HEAD_WORDS:
            break
        least = r["bin"]
    return max(1, math.ceil(2 ** (least / 16))) if least is not None else 1 << 62


def score_texts(
    docs: DataFrame,
    vocabulary: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: Column | None = None,
) -> DataFrame:
    """One row per row: the id, ``held_out``, token counts, ``base_score`` and ``score``.

    Texts where ``held_out`` is true are scored and not learned from.
    """
    spark = docs.sparkSession
    held_out = held_out_by(F.col(doc_id)) if held_out is None else held_out
    pieces = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def spelled(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        lattice = Lattice(pieces.value)
        for (column,) in batches:
            yield [pa.array([lattice.log_probability(w) for w in column.to_pylist()], pa.float64())]

    counts = materialise(
        add_columns(
            token_counts(docs, text, held_out), ["token", "c"], ["token"],
            "spelled double", spelled,
        ),
        "token-counts",
    )
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = n or 0, v or 0
    share = F.col("c") / F.lit(float(max(n + v, 1))) + F.lit(
        v / (n + v) if n + v else 1.0
    ) * F.exp("spelled")
    # Spellings may be too unlikely for a double; their logarithm still holds.
    tiny = F.col("spelled") / math.log(10) + F.lit(math.log10(v / (n + v)) if v else 0.0)
    terms = counts.select(
        "token",
        "c",
        F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"),
        F.when((F.col("c") == 0), tiny).otherwise(F.log10(share)).alias("term"),
    )
    head = terms.where(F.col("c") >= commonest(counts)).drop("c").collect()
    shared = spark.sparkContext.broadcast({bytes(r.token): (r.base, r.term) for r in head})

    def measured(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        known = shared.value
        get = known.get
        for (column,) in batches:
            out = {k: [] for k in ("n", "known", "base", "term", "rare")}
            for text in raw(column):
                words = words_of(text)
                words.append(END)
                found = [x for x in map(get, words) if x is not None]
                out["n"].append(len(words))
                out["known"].append(len(found))  # all of the head occur in training texts
                out["base"].append(math.fsum(x[0] for x in found))
                out["term"].append(math.fsum(x[1] for x in found))
                rare = Counter(w for w in words if w not in known) if len(found) < len(words) else {}
                out["rare"].append([{"token": w, "times": k} for w, k in rare.items()])
            rare_type = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type]
            yield [pa.array(x, t) for x, t in zip(out.values(), types, strict=True)]

    rows = docs.select(
        F.col(doc_id).alias("_id"),
        held_out.alias("_held"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"),  # told apart within an id
        F.col(text).alias("_text"),
    )
    scored = materialise(
        add_columns(
            rows, ["_id", "_held", "_key"], ["_text"],
            "n_tokens bigint, n_head bigint, base_head double, term_head double, "
            "rare array<struct<token:binary,times:bigint>>",
            measured,
        ),
        "scored-heads",
    )
    # Rows with equal id and text share a key; their sums are divided by the number of such rows.
    rare = scored.select("_id", "_key", F.explode("rare").alias("r")).select(
        "_id", "_key", F.col("r.token").alias("token"), F.col("r.times").alias("times")
    )
    tails = (
        rare.join(terms, "token")
        .groupBy("_id", "_key")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_tail"),
            F.sum(F.col("times") * F.col("base")).alias("base_tail"),
            F.sum(F.col("times") * F.col("term")).alias("term_tail"),
        )
    )
    copies = scored.groupBy("_id", "_key").agg(F.count("*").alias("rows")).where("rows > 1")
    left, right = scored.drop("rare"), tails.join(
        copies.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "rows"),
        F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")),
        "left",
    ).select(
        F.col("_id").alias("_id2"), F.col("_key").alias("_key2"),
        *[(F.col(c) / F.coalesce("rows", F.lit(1))).alias(c)
          for c in ("known_tail", "base_tail", "term_tail")],
    )
    same = (F.col("_key") == F.col("_key2")) & F.col("_id").eqNullSafe(F.col("_id2"))
    zero = F.lit(0.0)
    return left.join(right, same, "left").select(
        F.col("_id").alias(doc_id),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.round(F.coalesce("known_tail", zero)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_tail", zero)).alias("base_score"),
        (F.col("term_head") + F.coalesce("term_tail", zero)).alias("score"),
    )
