"""Quality rules: repetition and symbol counts, and distance from how a language usually looks.

Two histograms of every text, of its character classes and of its language's most common words, are
compared with the reference of its language by Jensen-Shannon distance. Only texts that pass the base
rules and are long enough for the distance vote for a reference, each with one histogram of shares
whatever its length. Every source takes the median of its texts bin by bin, and a language the median
of its sources, so neither a large source of junk nor junk spread over less than half of each source
moves it. A language of one or two sources takes the median of its texts. Shares are rounded to
1/10,000 for this, which bounds what a median holds. DataFrame functions only.

Defined cases: a NULL or blank text has no words and fails. Texts shorter than the length guards are
not judged by distance. A NULL or unlisted language has no common words, so only character classes
are judged. NULL is a language, and a source, of its own; without a ``source`` column all texts of a
language are one source. A language with fewer than ``MIN_VOTERS`` votes is compared with the reference
of all languages together, made alike, common words by their place in the list; if no text of the table
votes, with the pooled histogram of its own texts. What moves a reference is junk that passes the base rules in more
than half of a language's sources, or more than half of its texts where it has one or two. Repeated rows
are judged alike, one result each. Columns not named here are ignored unless they are listed in
``keep``; a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.scratch import materialise

SPACES = " \t\n\x0b\f\r"
# Common short words of four languages, in lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "on", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "pour", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
}
#: Result columns, beside those kept.
RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "class_distance", "word_distance", "base_failed", "kept",
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Guards: texts with fewer characters or words are not judged by distance.
MIN_CLASS_CHARS = 300
MIN_HISTOGRAM_WORDS = 100
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.26
#: A language with fewer texts that vote is compared with all languages together.
MIN_VOTERS = 20
#: From so many sources on, sources vote for the reference of a language; below, its texts.
MIN_SOURCES = 3
SHARE_UNITS = 10_000
N_CLASSES = 7
N_COUNTS = max(len(w) for w in COMMON_WORDS.values()) + 1


def _measured(
    rows: DataFrame, text: str, lang: str, source: str | None, keep: list[str]
) -> DataFrame:
    """Counts and histograms, row by row, without a shuffle."""
    common = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        common = F.when(F.col("_lang") == code, F.array(*map(F.lit, words))).otherwise(common)
    bare = F.trim(F.col("_text"), F.lit(SPACES))
    rows = rows.select(
        F.struct(*keep).alias("_kept"),
        F.col(lang).alias("_lang"),
        (F.lit(None).cast("string") if source is None else F.col(source)).alias("_source"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    rows = rows.select(
        "_kept",
        "_lang",
        "_source",
        "_text",
        F.when(bare == "", F.array().cast("array<string>"))
        .otherwise(F.split(bare, "[ \\t\\n\\x0b\\f\\r]+"))
        .alias("_words"),
        F.filter(
            F.split("_text", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != ""
        ).alias("_lines"),
        common.alias("_common"),
    )

    def without(pattern: str) -> Column:
        return F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))

    rows = rows.select(
        "_kept",
        "_lang",
        "_source",
        F.length("_text").cast("long").alias("_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        without("[0-9]+").cast("long").alias("_digits"),
        without("[A-Z]").cast("long").alias("_capitals"),
        without("[.,;:!?'\"()-]").cast("long").alias("_marks"),
        without("[^\\x00-\\x7F]+").cast("long").alias("_foreign"),
        "_common",
        F.filter("_words", lambda w: F.array_contains("_common", w)).alias("_hits"),
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(
                    F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)
                ),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_windows"),
    )
    # Windows found twice or more stand side by side once sorted; most texts have none and skip this.
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(placed))
        .otherwise(nothing),
    ).drop("_windows")
    repeated = F.filter(
        "_sorted",
        lambda s, k: (s["h"] == F.get("_sorted", k - 1)["h"])
        | (s["h"] == F.get("_sorted", k + 1)["h"]),
    )
    rows = rows.withColumn("_places", F.sort_array(F.transform(repeated, lambda s: s["i"])))
    rows = rows.drop("_sorted")
    # Overlapping windows share words: each adds the words after the window before it.
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")
        ),
        lambda a: a["n"],
    )
    known = F.size(F.coalesce("_hits", F.array().cast("array<string>"))).cast("long")
    return rows.select(
        "_kept",
        "_lang",
        "_source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.alias("n_repeat_words"),
        "_chars",
        F.array(
            F.col("_chars") - F.col("word_chars"),
            "_digits",
            "_capitals",
            "_marks",
            "n_symbols",
            "_foreign",
            F.col("word_chars")
            - F.col("_digits") - F.col("_capitals") - F.col("_marks")
            - F.col("n_symbols") - F.col("_foreign"),
        ).alias("_classes"),
        F.when(
            F.col("_common").isNotNull(),
            F.concat(
                F.transform(
                    "_common",
                    lambda c: F.size(F.filter("_hits", lambda h: h == c)).cast("long"),
                ),
                F.array(F.col("n_words") - known),
            ),
        ).alias("_counts"),
    )


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _pooled(measured: DataFrame) -> DataFrame:
    """Bin sums over all texts of a language. One row per language value."""
    return measured.groupBy("_lang").agg(
        F.array(*[F.sum(F.get("_classes", F.lit(i))) for i in range(N_CLASSES)]).alias("classes"),
        F.array(*[F.sum(F.get("_counts", F.lit(i))) for i in range(N_COUNTS)]).alias("counts"),
    )


def _medians(measured: DataFrame) -> DataFrame:
    """Medians of shares: one row per language and source (level 0), language (1), source (2) and in all (3).

    ``n_classes`` and ``n_counts`` are the numbers of texts that voted.
    """

    def shares(counts: str, n: int, votes: Column, prefix: str) -> list[Column]:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
        bins = [F.coalesce(F.get(counts, F.lit(i)), F.lit(0)) for i in range(n)]
        return [
            F.when(votes & (total > 0), F.round(SHARE_UNITS * c / total).cast("int")).alias(f"{prefix}{i}")
            for i, c in enumerate(bins)
        ]

    voters = measured.where(~_failed()).select(
        "_lang",
        "_source",
        *shares("_classes", N_CLASSES, F.col("_chars") >= MIN_CLASS_CHARS, "c"),
        *shares("_counts", N_COUNTS, F.col("n_words") >= MIN_HISTOGRAM_WORDS, "w"),
    )

    def median(prefix: str, n: int) -> Column:
        return F.array(*[F.percentile(f"{prefix}{i}", F.lit(0.5)) for i in range(n)])

    return voters.cube("_lang", "_source").agg(
        F.grouping_id().alias("level"),
        median("c", N_CLASSES).alias("classes"),
        median("w", N_COUNTS).alias("counts"),
        F.count("c0").alias("n_classes"),
        F.count("w0").alias("n_counts"),
    )


def _references(measured: DataFrame) -> DataFrame:
    """One row per language value: ``_ref_classes`` and ``_ref_counts``, the same for every text."""
    medians = materialise(_medians(measured), "quality-medians")
    out = _pooled(measured).withColumnRenamed("_lang", "_ref_lang")
    texts = medians.where("level = 1").select(
        F.col("_lang").alias("_text_lang"),
        *[F.when(F.col(f"n_{k}") >= MIN_VOTERS, F.col(k)).alias(f"texts_{k}") for k in ("classes", "counts")],
    )

    def of_sources(kind: str, n: int) -> Column:
        votes = F.col(f"n_{kind}") > 0
        bins = [F.percentile(F.when(votes, F.get(kind, F.lit(i))), F.lit(0.5)) for i in range(n)]
        return F.when(F.count_if(votes) >= MIN_SOURCES, F.array(*bins)).alias(f"sources_{kind}")

    kinds = {"classes": N_CLASSES, "counts": N_COUNTS}
    sources = (
        medians.where("level = 0")
        .groupBy(F.col("_lang").alias("_source_lang"))
        .agg(*[of_sources(k, n) for k, n in kinds.items()])
    )
    in_all = medians.where("level = 3").groupBy().agg(
        *[F.max(F.when(F.col(f"n_{k}") > 0, F.col(k))).alias(f"all_{k}") for k in kinds]
    )
    all_sources = medians.where("level = 2").groupBy().agg(
        *[of_sources(k, n).alias(f"all_sources_{k}") for k, n in kinds.items()]
    )
    out = out.join(texts, F.col("_ref_lang").eqNullSafe(F.col("_text_lang")), "left")
    out = out.join(sources, F.col("_ref_lang").eqNullSafe(F.col("_source_lang")), "left")
    out = out.crossJoin(F.broadcast(in_all)).crossJoin(F.broadcast(all_sources))

    def chosen(kind: str) -> Column:
        own = F.when(
            F.col(f"texts_{kind}").isNotNull(), F.coalesce(f"sources_{kind}", f"texts_{kind}")
        )
        pooled = F.transform(kind, lambda c: c.cast("double"))
        return F.coalesce(own, f"all_sources_{kind}", f"all_{kind}", pooled).alias(f"_ref_{kind}")

    return out.select("_ref_lang", chosen("classes"), chosen("counts"))


def distance(left: str, right: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count histograms; NULL where one is empty.

    Missing bins count zero.
    """

    def share(counts: str) -> Column:
        filled = F.transform(counts, lambda c: F.coalesce(c, F.lit(0)).cast("double"))
        total = F.aggregate(filled, F.lit(0.0), lambda a, c: a + c)
        return F.when(total > 0, F.transform(filled, lambda c: c / total))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(
        share(left),
        share(right),
        lambda p, q: part(F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0)))
        + part(F.coalesce(q, F.lit(0.0)), F.coalesce(p, F.lit(0.0))),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge_quality(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str | None = None,
    keep: list[str],
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """The ``keep`` columns of every row, with counts, distances and the verdict ``kept``.

    ``source`` names the column of sources, if there is one. The measured rows are written once, so
    references and verdicts come from one pass over the texts.
    """
    keep = [c for c in keep if c not in RESULTS]
    measured = materialise(_measured(docs, text, lang, source, keep), "quality")
    references = materialise(_references(measured), "quality-reference")
    judged = measured.join(
        references, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left"
    ).select(
        "_kept.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(
            F.col("_chars") >= MIN_CLASS_CHARS, distance("_classes", "_ref_classes")
        ).alias("class_distance"),
        F.when(
            F.col("n_words") >= MIN_HISTOGRAM_WORDS, distance("_counts", "_ref_counts")
        ).alias("word_distance"),
        _failed().alias("base_failed"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
