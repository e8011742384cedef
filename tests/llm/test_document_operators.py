"""Operators over documents beside brute force on small tables, with the cases that are easy to miss."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontamination, lattice_lm, near_dedup
from loomtext.llm.document_queries import PIECES
from loomtext.llm.lattice_lm import Lattice, score_texts
from loomtext.llm.licences import CLASSES, scan_licences, train
from loomtext.llm.line_dedup import drop_repeated_lines
from loomtext.llm.merge_pieces import Segmenter, decode_pieces, encode_pieces
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.pieces import read_vocabulary
from loomtext.llm.quality import judge_quality
from loomtext.llm.token_counts import count_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [
    None, "", " ", "\n", "  a  b", "a\nb\n\nc", "日本語 龘𠀀", "▁x y", "tab\tx \n \x00 é̀", " lead",
    "trail ", "🙂🙂 unk", "a" * 3000, "x \n y", "The THE the", "word " * 400,
]


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(PIECES)


def table(spark, texts, extra=True):
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that results use
        for name in ("n_words", "kept", "ids", "items", "_text", "key", "n_tokens", "class"):
            df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# --- token counts and pieces ---------------------------------------------------------------------


def sample_texts(spark, tables):
    return [r.text for r in tables.documents.orderBy("doc_id").limit(40).collect()] + ODD_TEXTS


def test_token_counts_equal_the_tokenizer(spark, tables):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    unigram = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = sample_texts(spark, tables)
    found = count_tokens(table(spark, texts), PIECES, keep=["doc_id"]).collect()
    expected = {i: len(unigram.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in found} == expected


def test_without_dropout_ids_are_the_tokenizers(spark, tables):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in sample_texts(spark, tables) if "▁" not in (t or "")]
    found = encode_pieces(table(spark, texts), PIECES, keep=["doc_id"], dropout=0.0).collect()
    assert {r.doc_id: r.ids for r in found} == {i: model.encode(t or "") for i, t in enumerate(texts)}


def test_dropout_varies_by_seed_and_decodes_losslessly(spark, tables):
    texts = sample_texts(spark, tables)
    one, again, other = (
        {r.doc_id: r.ids for r in
         encode_pieces(table(spark, texts), PIECES, keep=["doc_id"], dropout=0.2, seed=s).collect()}
        for s in (1, 1, 2)
    )
    assert one == again
    assert one != other
    encoded = encode_pieces(table(spark, texts), PIECES, keep=["doc_id", "text"], dropout=0.2, variants=3)
    back = decode_pieces(encoded, PIECES, keep=["doc_id", "text", "lossless"]).collect()
    assert len(back) == len(texts)
    assert all(r.decoded == (r.text or "") and r.lossless for r in back)


def test_scanned_words_equal_the_agenda(vocabulary):
    segmenter = Segmenter(vocabulary, 0.3, 5, 1)
    rng = random.Random(1)
    for _ in range(300):
        unit = " " + "".join(rng.choice("abcdetion. é") for _ in range(rng.randrange(1, 30)))
        assert segmenter.ids(unit, 0) == segmenter.ids_by_heap(unit, 0)


def test_occurrences_of_a_word_are_segmented_for_themselves(spark, vocabulary):
    texts = ["nationality " * 400, "nationality " * 300]
    found = encode_pieces(table(spark, texts), PIECES, keep=["doc_id"], dropout=0.1, seed=1).collect()
    assert all(r.lossless for r in found)
    segmenter = Segmenter(vocabulary, 0.1, 1, None)
    encoded = [segmenter.encode(t) for t in texts]
    assert {r.doc_id: r.ids for r in found} == {i: memoryview(e).cast("i").tolist() for i, e in enumerate(encoded)}
    taken, _, _ = segmenter.segmented(" nationality", iter([1 << 60]))
    states = segmenter.states(texts[0], [" nationality"] * 400).tolist()
    ways = [tuple(segmenter.ids(" nationality", s)) for s in states]
    assert len(set(ways)) > 5
    unskipped = [s for s in states if not segmenter.segmented(" nationality", segmenter.skips(s))[1]]
    assert abs(len(unskipped) / 400 - 0.9**taken) < 0.1
    assert segmenter.firsts(np.array(states, np.uint64)) == [next(segmenter.skips(s)) for s in states]
    ids = memoryview(encoded[0]).cast("i").tolist()
    assert ids[: len(ids) - 1] == [i for w in ways for i in w][: len(ids) - 1]


@pytest.mark.parametrize(("dropout", "variants"), [(0.0, None), (0.1, None), (0.6, 3), (1.0, None)])
def test_words_are_merged_side_by_side(tables, vocabulary, monkeypatch, dropout, variants):
    texts = [t or "" for t in sample_texts(None, tables)]
    segmenter, expected = Segmenter(vocabulary, dropout, 5, variants), []
    for t in texts:
        units = segmenter.unit.findall(" " + t) if t else []
        states = segmenter.states(t, units).tolist() if units else []
        expected.append([i for u, s in zip(units, states, strict=True) for i in segmenter.ids_by_heap(u, s)])
    alone, one_by_one = [], segmenter.segmented
    monkeypatch.setattr(segmenter, "segmented", lambda unit, skips: alone.append(unit) or one_by_one(unit, skips))
    ids, sizes = segmenter.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected
    assert all(len(u) > 64 or "  " in u or any(c not in segmenter.of_character for c in u) for u in alone)


# --- quality rules -------------------------------------------------------------------------------


def test_quality_counts(spark, tables):
    texts = [*sample_texts(spark, tables), "a b c a b c a b c", "x\nx\n \nx", "a b c d " * 30]
    found = {r.doc_id: r for r in judge_quality(table(spark, texts), keep=["doc_id", "kept"]).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        seen, copies = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                copies += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {
            k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)
        }
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (
            found[i].n_words, found[i].word_chars, found[i].n_symbols, found[i].n_dup_lines,
            found[i].n_repeat_words, found[i].base_failed,
        ) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), copies,
            len(covered), failed,
        )
        assert not (failed and found[i].kept)


def test_quality_distances(spark):
    rng = random.Random(2)
    clean = [prose(rng, 200, ["the", "of", "and", "river", "house", "to", "walks"]) for _ in range(30)]
    symbols = " ".join(f"{w}$$$%%%" for w in prose(rng, 200, ["ape", "bee", "cat", "dog", "elk"]).split())
    rows = [(i, t, "en") for i, t in enumerate([*clean, symbols])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in judge_quality(df, keep=["doc_id"], max_class_distance=0.28).collect()}

    def classes(t):
        letters = sum(map(str.isalpha, t)) - sum(map(str.isupper, t))
        marks = len(re.findall(r"[#*$%&|<>]", t))
        return [t.count(" "), 0, sum(map(str.isupper, t)), 0, marks, 0, letters]

    pooled = [sum(x) for x in zip(*[classes(t) for t in [*clean, symbols]], strict=True)]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        parts = [a * math.log2(2 * a / (a + b)) for x in ((p, q), (q, p)) for a, b in zip(*x, strict=True) if a]
        return math.sqrt(sum(parts) / 2)

    for i, t in enumerate([*clean, symbols]):
        assert found[i].class_distance == pytest.approx(distance(classes(t), pooled))
    assert not found[30].kept
    assert found[30].word_distance > max(found[i].word_distance for i in range(30))


@pytest.mark.parametrize(("n_junk", "sources"), [(30, 6), (60, 6), (25, 2)])
def test_quality_references_are_not_moved_by_a_source_of_junk(spark, n_junk, sources):
    rng = random.Random(11)
    letters = ["".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(2000)]
    common = ["the", "of", "and", "to", "in"]

    def clean():
        return " ".join(rng.choice(common if rng.random() < 0.3 else letters) for _ in range(200)) + "."

    rows = [(i, clean(), "en", f"s{1 + i % (sources - 1)}") for i in range(60)]
    rows += [(100 + i, " ".join(f"{w}$$#%%" for w in clean().split()), "en", "s0") for i in range(n_junk)]
    rows += [(500, rows[-1][1], "xx", "s1"), (501, rows[0][1], "xx", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = judge_quality(df, source="source", keep=["doc_id"]).collect()
    assert not any(r.base_failed for r in found)
    assert {r.doc_id for r in found if r.kept} == {*range(60), 501}


# --- line dedup ----------------------------------------------------------------------------------


def lines_by_brute_force(rows, least):
    """Every pair of places, with the longest equal run from them."""
    def key(t):
        return hashlib.sha256((t or "").encode()).hexdigest()[:32]

    docs = sorted({(i is None, i or 0, key(t), t or "") for i, t in rows})
    lines = [t.split("\n") for *_, t in docs]
    stays = [[True] * len(x) for x in lines]
    for d, own in enumerate(lines):
        for at in range(len(own)):
            for e in range(d + 1):
                for start in range(at if e == d else len(lines[e])):
                    size = weight = 0
                    while at + size < len(own) and start + size < len(lines[e]) and own[at + size] == lines[e][start + size]:
                        weight += len(own[at + size].split())
                        size += 1
                    if weight >= least:
                        stays[d][at : at + size] = [False] * size
    return {
        (None if no_id else i, t): "\n".join(x for x, s in zip(own, keeps, strict=True) if s)
        for (no_id, i, _, t), own, keeps in zip(docs, lines, stays, strict=True)
    }


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(25):
        lines = [rng.choice(["a b", "c", "d e f", "", "x y z w", "q q q"]) for _ in range(rng.randrange(14))]
        rows.append((rng.choice([i, i, i, i // 2, None]), "\n".join(lines)))
    rows += [rows[0], rows[3], (77, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = drop_repeated_lines(df, keep=["doc_id", "text"], min_words=9).collect()
    assert len(found) == len(rows)
    expected = lines_by_brute_force(rows, 9)
    for r in found:
        assert (r.remaining or "") == expected[r.doc_id, r.text or ""]


def test_short_lines_of_many_documents_go(spark):
    rows = [(i, f"own {i}\nshort line\n\nshort line\nrare {i // 4}") for i in range(8)] + [(None, "short line")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = drop_repeated_lines(df, keep=["doc_id"], min_documents=5).collect()
    expected = {i: (f"own {i}\n\nrare {i // 4}", 2) for i in range(1, 8)}
    expected |= {0: ("own 0\nshort line\n\nrare 0", 1), None: ("", 1)}
    assert len(found) == len(rows)
    assert {r.doc_id: (r.remaining, r.n_deleted) for r in found} == expected
    whole = drop_repeated_lines(df, keep=["doc_id"], min_documents=10).collect()
    assert all(r.n_deleted == 0 for r in whole if r.doc_id != 3)


# --- near-dedup ----------------------------------------------------------------------------------


def near_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]) and label[j] < label[i]:
                    label[i], moved = label[j], True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(40):  # a chain: each text differs a little from the one before
        base = list(base)
        base[rng.randrange(len(base))] = f"new{i}"
        rows.append((100 + i, " ".join(base)))
    rows += [(i, prose(rng, 60, words)) for i in range(20)]
    rows += [(200 + i, rows[i * 7 % 60][1].upper()) for i in range(15)]
    shared = prose(rng, 40, words)
    rows += [(300 + i, shared + " " + prose(rng, 12 + i % 9, words)) for i in range(60)]
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE\ttwo"), (405, "one")]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_duplicates(df, keep=["doc_id"]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == near_by_brute_force(rows)


def test_band_groups_hand_on_fewer_rows_than_they_have_classes(spark, monkeypatch):
    counts, write = {}, near_dedup.materialise

    def counted(df, label):
        out = write(df, label)
        counts[label] = max(out.count(), counts.get(label, 0))
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    shared = prose(rng, 40, words)
    rows = [(i, shared + " " + prose(rng, 12, words)) for i in range(60)]  # alike, but mostly no links
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_duplicates(df, keep=["doc_id"]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == near_by_brute_force(rows)
    assert counts["across"] < counts["classes"] == 60


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema), keep=["doc_id"]).collect() == []
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, None)]
    found = near_duplicates(spark.createDataFrame(rows, schema), keep=["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == [
        ("7", "7", True), ("7", "7", True), ("8", "8", True), ("8", "8", True), ("None", "7", False),
    ]


# --- decontamination -----------------------------------------------------------------------------


def contamination_by_brute_force(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        words = pattern.findall((t or "").translate(LOWER))
        for k in range(max(len(words) - 9, 1) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(i))
    out = {}
    for i, t in docs:
        words = pattern.findall((t or "").translate(LOWER))
        hit, met = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    met |= windows[tuple(words[k : k + size])]
        out[i] = (len(words), len(hit), sorted(met))
    return out


@pytest.mark.parametrize(("shard", "blocks"), [(1_000_000, 200_000), (50, 20)])
def test_contamination(spark, monkeypatch, shard, blocks):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", blocks)
    rng = random.Random(6)
    words = ["ab", "C", "dé", "f9", "gg"]
    items = [(i, prose(rng, rng.choice([0, 1, 3, 10, 11, 25]), [*words, "h", "i", "j"])) for i in range(15)]
    items += [(98, None), (99, "Zebra!quagga")]
    docs = [(900, None), (901, "zebra. QUAGGA ab")]
    for i in range(40):
        passage = items[i % 15][1]
        docs.append((i, f"{prose(rng, 30, words)}, {passage}" if i % 3 else passage.upper() * 3))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(d, b, keep=["doc_id"]).collect()
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found}
    assert got == contamination_by_brute_force(docs, items)


def test_contamination_is_cut_out(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"Before it. {passage}, and after"), (2, "clean text"), (3, None), (4, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame([(5, passage.upper())], "item_id long, text string")
    found = decontamination.remove_contamination(d, b, keep=["doc_id", "items"]).collect()
    assert {r.doc_id: (r.n_removed, r.remaining) for r in found} == {
        1: (10, "Before it. , and after"), 2: (0, "clean text"), 3: (0, None), 4: (10, "")
    }
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_removed == 0 for r in decontamination.remove_contamination(d, empty, keep=["doc_id"]).collect())


# --- language model ------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations(vocabulary):
    lattice = Lattice(vocabulary)
    weight = {piece: math.exp(w) for piece, (_, w) in lattice.automaton.items()}

    def total(unit):
        if not unit:
            return 1.0
        ways = [weight[unit[:k]] * total(unit[k:]) for k in range(1, len(unit) + 1) if unit[:k] in weight]
        return sum(ways) or math.exp(lattice.byte * len(unit[0].encode())) * total(unit[1:])

    for word in ("the", "nations", "é", "龘a", "x"):
        assert lattice.log_probability(word.encode()) == pytest.approx(math.log(total("▁" + word)))


@pytest.mark.parametrize("head", [150_000, 3])
def test_scores(spark, vocabulary, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lattice_lm, "COUNTED_WORDS", 50)
    rng = random.Random(8)
    words = ["the", "The", "of", "é", "river", "龘", *(f"rare{k}" for k in range(40))]
    rows = [(i, prose(rng, rng.randrange(30), words)) for i in range(40)] + [(50, None), (3, "again"), (None, "no id")]
    rows += [(7, rows[7][1])]
    found = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PIECES).collect()
    lattice = Lattice(vocabulary)
    tokens = [WORD.findall((t or "").translate(LOWER)) + [""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted(
        (str(i), h, len(ws), sum(c[w] > 0 for w in ws), n,
         round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6),
         round(sum(math.log10(c[w] / (n + v) + v / (n + v) * math.exp(lattice.log_probability(w.encode())))
                   for w in ws), 6))
        for (i, _), ws, h in zip(rows, tokens, held, strict=True)
    )
    got = sorted((str(r.doc_id), *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert got == expected
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


# --- licences ------------------------------------------------------------------------------------


def test_licences(spark, tables):
    notices = {
        "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "reserved": "All rights reserved.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    }
    model = train(tables.documents)
    clean = ["The committee reserved all seats.", "She was released under the bridge.", None, "", "\n\n"]
    texts = [f"Some words here.\n\n{t}" for t in notices.values()] + clean
    found = {r.doc_id: r for r in scan_licences(table(spark, texts), model=model, keep=["doc_id"]).collect()}
    assert [[x.family for x in found[i].licences] for i in range(len(texts))] == [
        *[[f] for f in notices], [], [], [], [], []
    ]
    assert all(x.line == 2 for i in range(4) for x in found[i].licences)
    # Held-out accuracy: notices in words of their own, and paragraphs of texts that were not sampled.
    held = ["This software is released under the MIT license", "(c) 2021 Someone. All rights reserved."]
    p = model.probabilities(held + ["the on of and ther inor"])
    assert [CLASSES[k] for k in p.argmax(axis=1)] == ["mit", "reserved", "other"]
