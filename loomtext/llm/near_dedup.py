"""MinHash near-dedup with odd sketches.

A text is the set of its five-word shingles. Texts with equal sets are one class, so exact copies are
settled by one aggregation. Every class gets MinHash samples; the samples are folded into a bitmap of
parities (an odd sketch), and groups of samples into band keys. Classes that share a band key are
candidates. The population count of two sketches' exclusive or tells how many samples differ, a precise
estimate for high similarity, and only pairs that may reach the threshold are confirmed on full sets.

No group is paired out. In each band group all classes are compared with the one that has the least document
id; first every class's best candidate is confirmed, then those that would join different components. In groups in
which more than one component is left, shingles that no other class of such groups holds bound a class's similarity
with any other, so a class with too many of them is linked with none and leaves. What stays is searched whole, in
blocks of bounded size whose sketches are compared in one matrix operation. A block confirms its pairs on full sets,
each pair in the first group that it shares, and hands on only links that join components which it has not joined
yet, fewer than it has classes. So no link between different texts is lost but by the bands themselves: 32 bands of 4
samples miss a pair at the threshold with probability 5e-6, at similarity 0.85 with 1e-10.

Defined cases: NULL, empty and word-less texts have no shingles and are linked with nothing. With fewer
words than a shingle the whole sequence is one. Component ids are least document ids, NULL ids not
counted unless all are NULL. Rows with equal ids get equal results. An empty table gives no rows.
Columns not in ``keep`` are ignored; a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.arrow import add_columns, kept_in_worker, raw
from loomtext.llm.components import components
from loomtext.scratch import materialise
from loomtext.session import ship_package

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Sketch estimates below this are no links: 5 standard deviations under the threshold.
LEAST_ESTIMATE = 0.5
BLOCK_CLASSES = 512
#: Slots of text keys. Those of wanted texts are broadcast, so that few others are moved.
KEY_SLOTS = 1 << 21
CACHED_WORDS = 300_000
RESULTS = ["n_shingles", "component_id", "kept", "leads", "copies"]

_seeded = np.random.default_rng(20240521)
FACTORS = _seeded.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
PLACES = _seeded.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _seeded.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SAMPLE_SALTS = _seeded.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 100:
            self[word] = value
        return value


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The set of 64-bit shingle hashes, sorted. Words have A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(len(h), SHINGLE_WORDS)
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += h[k : k + n] * PLACES[k]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples: the least of 128 multiplicative orders over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * FACTORS).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of how many samples fall on each bit, as signed 64-bit words."""
    bits = _mixed(samples.astype(np.uint64) + SAMPLE_SALTS) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.astype(np.uint64).reshape(BANDS, ROWS)
    return _mixed((rows * BAND_FACTORS).sum(axis=1, dtype=np.uint64) + BAND_FACTORS[:, 0]).view(np.int64)


def estimate(differing_bits: Column) -> Column:
    """Similarity from the number of differing sketch bits."""
    n = SKETCH_BITS
    inside = F.greatest(1 - 2 * differing_bits / n, F.lit(1e-9))
    return 1 + F.log(inside) * (n / (4 * SAMPLES))


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        hashes = kept_in_worker(("word hashes",), WordHashes)
        for (column,) in batches:
            sizes, classes, bands, sketches = [], [], [], []
            for body in raw(column):
                s = shingle_set(body, hashes)
                sizes.append(len(s))
                if not len(s):
                    for out in (classes, bands, sketches):
                        out.append(None)
                    continue
                samples = minima(s)
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(samples))
                sketches.append(odd_sketch(samples))
            longs = pa.list_(pa.int64())
            yield [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                   pa.array(bands, longs), pa.array(sketches, longs)]

    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), text_key(F.col(text)).alias("key")
    )
    made = "n bigint, class binary, bands array<bigint>, sketch array<bigint>"
    return add_columns(rows, ["id", "key"], ["text"], made, compute)


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link, with the estimate."""
    side = classes.select("class", "n", "sketch")
    for c in ("a", "b"):
        pairs = pairs.join(side.withColumnsRenamed({"class": c, "n": f"n_{c}", "sketch": f"s_{c}"}), c)
    sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    bits = F.aggregate(
        F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return pairs.where(sizes).select("a", "b", estimate(bits).alias("estimate")).where(
        F.col("estimate") >= LEAST_ESTIMATE
    )


def _texts_of(named: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """One text for each class in ``named``."""
    wanted = materialise(classes.select("class", "key").join(named.distinct(), "class"), "wanted-texts")
    bodies = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    slot = F.pmod(F.xxhash64("key"), F.lit(KEY_SLOTS))
    slots = wanted.select(slot.alias("slot")).distinct()
    bodies = bodies.join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    return materialise(
        bodies.join(wanted, "key").dropDuplicates(["class"]).select("class", "text"), "texts"
    )


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links, compared on full sets."""
    rows = pairs.select("a", "b")
    rows = rows.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        hashes = kept_in_worker(("word hashes",), WordHashes)
        last, left = None, None
        for one, other in batches:
            linked = []
            for x, y in zip(raw(one), raw(other), strict=True):
                if x != last:  # rows of one centre come together
                    last, left = x, shingle_set(x, hashes)
                right = shingle_set(y, hashes)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield [pa.array(linked, pa.bool_())]

    checked = add_columns(rows, ["a", "b"], ["text_a", "text_b"], "linked boolean", compute)
    return materialise(checked.where("linked").select("a", "b"), "confirmed")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components (node, label) after adding links; components so far are contracted to one node."""
    if links.isEmpty():
        return comps
    if comps is None:
        return components(links)
    ends = _labelled(_labelled(links, comps, "a"), comps, "b")
    higher = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    tops = higher.select(F.col("node").alias("label"), F.col("label").alias("top"))
    raised = comps.join(tops, "label", "left")
    fresh = higher.join(comps, "node", "left_anti")
    return materialise(
        raised.select("node", F.coalesce("top", "label").alias("label")).unionByName(fresh), "components"
    )


def _labelled(rows: DataFrame, comps: DataFrame, column: str) -> DataFrame:
    """Adds ``label_<column>``: the component of a class, itself if it has no links."""
    found = comps.withColumnsRenamed({"node": column, "label": "_label"})
    return rows.join(found, column, "left").withColumn(
        f"label_{column}", F.coalesce("_label", column)
    ).drop("_label")


def _apart(members: DataFrame) -> DataFrame:
    """The members (bucket, class, label) of groups that hold several components, with the group's size."""
    groups = materialise(
        members.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")
        ).where("low <> high").select("bucket", "size"),
        "mixed-groups",
    )
    return members.join(groups, "bucket")


def _sets_of(named: DataFrame, texts: DataFrame) -> DataFrame:
    """The shingles of each class in ``named``."""

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        hashes = kept_in_worker(("word hashes",), WordHashes)
        for (column,) in batches:
            sets = [shingle_set(body, hashes).view(np.int64) for body in raw(column)]
            yield [pa.array(sets, pa.list_(pa.int64()))]

    rows = texts.join(named.distinct(), "class", "left_semi")
    return materialise(add_columns(rows, ["class"], ["text"], "shingles array<bigint>", compute), "sets")


def _able(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that may be linked with another one of ``sets``, with ``alone``: how many shingles only they hold.

    A link shares at least the threshold's part of either set, and none of those shingles.
    """
    held = sets.select(F.xxhash64("class").alias("node"), F.explode("shingles").alias("shingle"))
    once = held.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    alone = once.where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    rows = classes.select("class", "n", "bands", "sketch").join(sets.select("class"), "class")
    rows = rows.join(alone, F.xxhash64("class") == F.col("node"), "left").drop("node")
    rows = rows.withColumn("alone", F.coalesce("alone", F.lit(0)))
    return materialise(rows.where(100 * (F.col("n") - F.col("alone")) >= PERCENT * F.col("n")), "able")


def _across(
    buckets: DataFrame, classes: DataFrame, comps: DataFrame | None, texts: DataFrame
) -> DataFrame:
    """Links (a, b) across components within groups that hold several, enough to join all that are linked there."""
    members = (
        buckets.withColumn("label", F.col("class")) if comps is None else _labelled(buckets, comps, "class")
        .withColumnRenamed("label_class", "label")
    )
    inside = materialise(_apart(members).drop("size"), "mixed-members")
    sets = _sets_of(inside.select("class"), texts)
    able = _able(sets, classes)
    inside = _apart(inside.join(able.select("class"), "class", "left_semi"))
    inside = inside.withColumn("slots", F.ceil(F.col("size") / BLOCK_CLASSES).cast("int"))
    inside = inside.withColumn("slot", F.pmod(F.xxhash64("class"), "slots").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    placed = inside.withColumn("other", other).select(
        "bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"),
        "slot", "class", "label",
    ).join(able, "class").join(sets, "class")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, same = rows["bucket"].iloc[0], rows["i"].iloc[0] == rows["j"].iloc[0]
        left = rows if same else rows[rows["slot"] == rows["i"]]
        right = rows if same else rows[rows["slot"] == rows["j"]]
        links: list[tuple[bytes, bytes]] = []
        if not len(left) or not len(right):
            return pd.DataFrame(links, columns=["a", "b"])
        x, y = np.stack(left["sketch"].to_list()), np.stack(right["sketch"].to_list())
        bits = np.zeros((len(x), len(y)), np.int64)
        for k in range(x.shape[1]):
            bits += np.bitwise_count((x[:, k, None] ^ y[None, :, k]).view(np.uint64))
        similar = 1 + np.log(np.maximum(1 - 2 * bits / SKETCH_BITS, 1e-9)) * SKETCH_BITS / (4 * SAMPLES)
        n, m = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
        own, others = left["alone"].to_numpy()[:, None], right["alone"].to_numpy()[None, :]
        most, least = np.minimum(n - own, m - others), np.maximum(n + others, m + own)  # of both; of either
        likely = (similar >= LEAST_ESTIMATE) & (100 * most >= PERCENT * least)
        names = {label: k for k, label in enumerate({*left["label"], *right["label"]})}
        one, two = left["label"].map(names).to_numpy(), right["label"].map(names).to_numpy()
        likely &= one[:, None] != two[None, :]
        at, to = np.nonzero(np.triu(likely) if same else likely)
        here, before = np.zeros(len(at), bool), np.zeros(len(at), bool)
        x, y = np.stack(left["bands"].to_list()), np.stack(right["bands"].to_list())
        for k in range(BANDS):
            shared = x[at, k] == y[to, k]
            here |= shared & ~before & (x[at, k] == bucket)
            before |= shared
        at, to = at[here], to[here]
        order = np.argsort(-similar[at, to], kind="stable")
        a, b = left["class"].to_list(), right["class"].to_list()
        shingles, further = left["shingles"].to_list(), right["shingles"].to_list()
        top = list(range(len(names)))

        def component(label: int) -> int:
            while top[label] != label:
                label = top[label]
            return label

        for p, q in zip(at[order].tolist(), to[order].tolist(), strict=True):
            ends = component(one[p]), component(two[q])
            if ends[0] != ends[1]:
                common = len(np.intersect1d(shingles[p], further[q], assume_unique=True))
                if 100 * common >= PERCENT * (len(shingles[p]) + len(further[q]) - common):
                    top[max(ends)] = min(ends)
                    links.append((a[p], b[q]))
        return pd.DataFrame(links, columns=["a", "b"])

    # A stated number of tasks: the blocks are few bytes, but each takes its time.
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j")
    return dealt.applyInPandas(block, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str]
) -> DataFrame:
    """One row per row: ``keep``, with n_shingles, component_id and kept (the component's least id).

    Where more than the id is kept, also ``leads``, whether this is the component's first (id, text), ids before
    NULL, and ``copies``, the number of rows with both. Of rows that lead with one copy there is one a component.
    """
    keep = [c for c in keep if c not in RESULTS]
    ship_package(docs.sparkSession)
    signed = materialise(_signatures(docs, doc_id, text), "signatures")
    one = {c: F.first(c).alias(c) for c in ("n", "bands", "sketch")}  # equal in a class
    classes = materialise(
        signed.where("n > 0").groupBy("class")
        .agg(F.min("id").alias("least"), F.min("key").alias("key"), *one.values()),
        "classes",
    )
    buckets = classes.select("class", F.explode("bands").alias("bucket"))
    # The text that came first is the best centre: copies are made from it, not from each other.
    first = F.struct(F.col("least").isNull(), "least", "class")
    centres = materialise(
        classes.select(first.alias("first"), F.explode("bands").alias("bucket"))
        .groupBy("bucket").agg(F.min("first").alias("first"), F.count("*").alias("size"))
        .where("size > 1").select("bucket", "size", F.col("first.class").alias("a")),
        "band-groups",
    )
    # Most band keys occur once; from here on only shared ones are moved.
    shared = materialise(buckets.join(centres, "bucket"), "band-members")
    stars = shared.where("a <> class").select("a", F.col("class").alias("b")).distinct()
    larger = shared.where("size > 2").select("class", "bucket")
    likely = materialise(_likely(stars, classes), "likely")
    comps = None
    if not shared.isEmpty():
        named = likely.select(F.col("a").alias("class")).union(likely.select("b")).union(larger.select("class"))
        texts = _texts_of(named, classes, docs, text)
        best = likely.groupBy("b").agg(
            F.max_by("a", F.struct("estimate", "a")).alias("a"),
        ).select("a", "b")
        best = materialise(best, "best")
        comps = _joined(None, _confirmed(best, texts))
        rest = likely.join(best, ["a", "b"], "left_anti").select("a", "b")
        if comps is not None:
            rest = _labelled(_labelled(rest, comps, "a"), comps, "b").where("label_a <> label_b")
        rest = materialise(rest.select("a", "b"), "rest")
        if not rest.isEmpty():
            comps = _joined(comps, _confirmed(rest, texts))
        comps = _joined(comps, materialise(_across(larger, classes, comps, texts), "across"))
    least = signed.where("n > 0").groupBy("class").agg(F.min("id").alias("least"))
    if comps is not None:
        label = comps.withColumnRenamed("node", "class")
        least = least.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
        least = materialise(least, "least")
        top = materialise(
            least.groupBy("label").agg(F.min("least").alias("component_id")), "component-ids"
        )
        least = least.join(top, "label").select("class", "component_id", "label")
    else:
        least = least.withColumnRenamed("least", "component_id").withColumn("label", F.col("class"))
    named = materialise(
        least.select(F.col("class").alias("_class"), "component_id", F.col("label").alias("_group")), "class-ids"
    )
    rows = signed.join(named, F.col("class") == F.col("_class"), "left").select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "_group",
    )
    rows = rows.withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))
    if keep == [doc_id]:
        return rows.select(F.col("_id").alias(doc_id), "n_shingles", "component_id", "kept")
    # Other columns come back by id and text; rows equal in both have equal results.
    once = rows.groupBy("_id", "_key").agg(
        *(F.first(c).alias(c) for c in ("n_shingles", "component_id", "kept", "_group")),
        F.count(F.lit(1)).alias("copies"),
    )
    once = materialise(once, "texts-by-id")
    place = F.struct(F.col("_id").isNull(), "_id", "_key")
    leaders = once.where("n_shingles > 0").groupBy(F.col("_group").alias("_led")).agg(F.min(place).alias("_lead"))
    rows = once.join(leaders, F.col("_group") == F.col("_led"), "left").withColumn(
        "leads", F.col("_lead").isNull() | (place == F.col("_lead"))
    )
    rows = materialise(rows.drop("_led", "_lead", "_group"), "results")
    full = docs.select(F.struct(*keep).alias("_kept"), F.col(doc_id).alias("_i"), text_key(F.col(text)).alias("_k"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))
    return full.join(rows, same).select("_kept.*", *RESULTS)
