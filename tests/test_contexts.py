"""Contexts from JSON of any size, taken item by item."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.scratch import scratch_root
from loomtext.session import few_listing_tasks
from loomtext.sources import contexts
from loomtext.sources.contexts import context_parts, read_context_json
from loomtext.sources.json_items import NotJson, as_text, field, items
from loomtext.suite import QUERIES


def listed(text):
    return [(key, as_text(value, source)) for key, value, source in items(text)]


def test_items_equal_the_json_module():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind == 0:
            return "".join(rng.choice('a"\\é\n,:[]{} \u2028😀') for _ in range(rng.randrange(9)))
        if kind in (1, 2):
            return rng.choice([0, -17, 1.5, 10**30, True, False])
        if kind in (3, 4):
            return None
        if kind < 7:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {str(k): value(depth - 1) for k in range(rng.randrange(4))}

    for _ in range(400):
        whole = value(4)
        for indent in (None, 2):
            for ascii_ in (True, False):
                text = "\n " + json.dumps(whole, indent=indent, ensure_ascii=ascii_) + "\t"
                if not isinstance(whole, (list, dict)):
                    with pytest.raises(NotJson):
                        listed(text)
                    continue
                pairs = list(whole.items()) if isinstance(whole, dict) else [(None, v) for v in whole]
                found = list(items(text))
                assert [(k, v) for k, v, _ in found] == pairs
                for (_, v, source), (_, expected) in zip(found, pairs, strict=True):
                    if not isinstance(expected, str) and expected is not None:
                        compact = as_text(v, source)
                        assert json.loads(compact) == expected
                        assert compact == json.dumps(expected, ensure_ascii=ascii_, separators=(",", ":"))


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "[", "{", "[1", "[1,", "[1,]", "[,1]", "[1 2]", "[1]x", "[1][2]", '{"a"}', '{"a":}', "{a:1}",
        '{"a":1,}', '{"a" 1}', '["\n"]', '["a]', "[01]", "[NaN]", "[-Infinity]", '[{"a":[1}]', "[" * 100_000, "7", '"s"',
    ],
)
def test_what_is_no_json(text):
    with pytest.raises(NotJson):
        listed(text)


def test_field_takes_the_last_of_a_name():
    assert field('{"a": 1, "b": {"a": 9}, "a": [1, 2]}', "a") == "[1,2]"
    assert field('{"a": null}', "a") == field("{}", "a") == ""


def test_forms(spark):
    raw = [
        ("none", None), ("blank", ""), ("scalar", "42"), ("prose", "[see note] and"), ("empty list", " [ ]"),
        ("empty dict", "{}"), ("nulls", '[null, "", " x "]'), ("numbers", "[1.50, 1e400, -0]"),
        ("order", '{"z": 1, "a": [1, {"y": 1, "b": "q r"}], "z": "again"}'),
        ("messages", '[{"content": "a"}, 7, {"role": "r", "content": null}, {"content": [1, {"t": "x y"}], "role": 3}]'),
        ("late content", '["first", {"content": "c"}]'),
    ]
    df = spark.createDataFrame([(*r, "clash", 5) for r in raw], "id string, raw string, kind string, part_idx long")
    by_id = {}
    for r in context_parts(df, "id", "raw").orderBy("ctx_id", "part_idx").collect():
        by_id.setdefault(r["ctx_id"], []).append((r["kind"], r["part_key"], r["role"], r["text"]))
    assert by_id == {
        "none": [("str", None, None, None)],
        "blank": [("str", None, None, "")],
        "scalar": [("str", None, None, "42")],
        "prose": [("str", None, None, "[see note] and")],
        "nulls": [("list", None, None, t) for t in ("", "", " x ")],
        "numbers": [("list", None, None, t) for t in ("1.50", "1e400", "-0")],
        "order": [("dict", "z", None, "1"), ("dict", "a", None, '[1,{"y":1,"b":"q r"}]'), ("dict", "z", None, "again")],
        "messages": [
            ("list", None, None, "a"), ("list", None, None, ""), ("list", None, "r", ""),
            ("list", None, "3", '[1,{"t":"x y"}]'),
        ],
        "late content": [("list", None, None, "first"), ("list", None, None, '{"content":"c"}')],
    }
    assert context_parts(df.where("false"), "id", "raw").collect() == []


def test_files_and_lines_with_errors(spark, tmp_path, monkeypatch):
    (tmp_path / "good.json").write_text('["a", {"k": "v w"}]')
    (tmp_path / "torn.json").write_text('["a", "b')
    read = {r["ctx_id"].rsplit("/")[-1]: r for r in read_context_json(spark, str(tmp_path)).collect()}
    assert read["torn.json"]["kind"] == "error" and "character" in read["torn.json"]["error"]
    assert read["torn.json"]["text"] is None and read["good.json"]["error"] is None
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"x": "1", "id": "late"}\n{"x": "2"}\n[1]\nplain\n{"id": 5, "y": [1, 2]}\n{"id":"t", "x": \n')
    parts = read_context_json(spark, str(lines), lines=True, ctx_id="id").collect()
    good = sorted((r["ctx_id"], r["part_key"], r["text"]) for r in parts if r["kind"] == "dict")
    assert good == [("5", "y", "[1,2]"), ("late", "x", "1")]
    assert sum(r["kind"] == "error" for r in parts) == 4
    monkeypatch.setattr(contexts, "BATCH_ROWS", 1)
    again = read_context_json(spark, str(lines), lines=True, ctx_id="id").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, parts))


def test_long_items_and_long_lists(spark, tmp_path):
    """An item of 25 million characters, alone and beside others, and a list of 200 MB."""
    long = '\\"é' * 8_400_000
    (tmp_path / "item.json").write_text(f'["before", "{long}", {{"k": "{long}"}}, "after"]')
    (tmp_path / "list.json").write_text("[" + ",\n".join(f'"{i:05}{"x" * 199_990}"' for i in range(1000)) + "]")
    parts = read_context_json(spark, str(tmp_path)).select(
        F.regexp_extract("ctx_id", r"(\w+)\.json", 1).alias("name"), "part_idx", "kind",
        F.length("text").alias("n"), F.substring("text", 1, 5).alias("head"),
    )
    item = sorted(tuple(r)[1:] for r in parts.where("name = 'item'").collect())
    assert [(i, n) for i, _, n, _ in item] == [(0, 6), (1, 2 * 8_400_000), (2, 3 * 8_400_000 + 8), (3, 5)]
    assert {kind for _, kind, _, _ in item} == {"list"}
    found = parts.where("name = 'list'").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("head").cast("long") - F.col("part_idx")).alias("off")
    )
    assert tuple(found.first()) == (1000, 1000 * 199_995, 0)


def test_a_file_per_page_needs_no_folder_per_page(spark, tables):
    before = set(Path(scratch_root(spark)).glob("loomtext-texts-*"))
    assert QUERIES["src1_read_context_text"](tables).count() == tables.pages.count()
    (folder,) = set(Path(scratch_root(spark)).glob("loomtext-texts-*")) - before
    assert not [p for p in folder.iterdir() if p.is_dir()]


def test_folders_are_listed_by_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with few_listing_tasks(spark):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
