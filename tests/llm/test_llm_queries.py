"""Registered queries of the subpackage beside their SQL, and the pipeline's stages."""

import random

import pytest
from compare import TESTDATA, duck, duck_rows, spark_rows

import corpus_pipeline
from loomtext.llm.queries import ORACLES, QUERIES
from loomtext.scratch import materialise


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(tables, name):
    assert spark_rows(QUERIES[name](tables)) == duck_rows(duck(f"{TESTDATA}/sf0.001"), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_covers_its_table(tables, name):
    found = QUERIES[name](tables)
    key, table = ("vec_id", tables.embeddings) if "vec_id" in found.columns else ("doc_id", tables.documents)
    times = 8 if "component" in found.columns else 1
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(
        r[0] for r in table.select(key).collect() for _ in range(times)
    )


def test_pipeline_stages(spark, tables):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"] is corpus_pipeline.run
    rng = random.Random(4)
    names = ["".join(rng.choice("aeiourstnl") for _ in range(6)) for _ in range(3000)]

    def own(n):
        return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(names) for _ in range(n))

    passage, clean, b, c, d = own(60), own(300), own(200), own(200), own(200)
    texts_a = own(200) + "\n" + passage
    bench = spark.read.parquet(f"{tables.folder}/benchmark.parquet").orderBy("item_id").first().text
    texts = [
        clean, texts_a, b + "\n" + passage, "too short", clean, c + " " + bench, d, d + " more", None,
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, tables.folder), name.replace(" ", "-"))
        seen.append({r.doc_id: r for r in docs.collect()})
        if stage is not corpus_pipeline.encoding:
            assert docs.columns == corpus_pipeline.COLUMNS
    rules, lines, near, bare, pieces = seen
    assert set(rules) == {0, 1, 2, 4, 5, 6, 7}
    assert set(lines) == {0, 1, 2, 5, 6, 7}  # 4 repeats all of 0
    assert lines[1].text == texts[1] and lines[2].text == b
    assert lines[2].n_chars == len(b)
    assert set(near) == {0, 1, 2, 5, 6}
    assert bare[5].text.startswith(c) and bench[:40] not in bare[5].text and bare[0].text == clean
    assert set(pieces) == set(bare) and all(r.lossless for r in pieces.values())


def test_pipeline_keeps_one_row_of_each_group(spark, tables):
    """Repeated rows, NULL ids and ids that repeat with other texts go through all stages."""
    rng = random.Random(6)
    names = ["".join(rng.choice("aeiourstnl") for _ in range(6)) for _ in range(3000)]

    def own(n):
        return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(names) for _ in range(n))

    a, b, c, d, e = (own(300) for _ in range(5))
    rows = [(7, a)] * 3 + [(None, b)] * 3 + [(None, b + " more")] + [(5, c), (5, c + " more"), (4, d), (9, d + " x"), (None, e)]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{k % 4}", len(t)) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    near = corpus_pipeline.near_dedup(spark, docs, tables.folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near) == [(False, 4), (False, 5), (False, 7), (True, 0), (True, 0)]
    assert {r.text[:20] for r in near} == {t[:20] for t in (a, b, c, d, e)}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, tables.folder), name.replace(" ", "-"))
    assert docs.count() == 5 and docs.where("NOT lossless").count() == 0
