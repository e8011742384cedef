"""Ordered scans over one partition and many, beside each other and beside plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.operators.chunking import (
    assign_equal,
    chunk_by_header,
    chunk_equal,
    chunk_fixed,
    pack_chars,
    pack_docs,
    pack_spans,
)
from loomtext.operators.ordering import (
    group_size,
    group_total,
    join_ordered,
    last_seen,
    ordered_scan,
    row_number,
    running_sum,
)
from loomtext.operators.profiling import context_profile, first_parts, profile_line
from loomtext.operators.requests import match_responses
from loomtext.sources.contexts import context_parts


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows, and more, in one key; one key is NULL."""
    return spark.range(3000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 97 > 0 THEN concat('k', id % 40) END").alias("k"),
        F.xxhash64("id").alias("o"),
        (F.col("id") % 13).alias("v"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("held"),
    )


@pytest.mark.parametrize("order", ["o", "-o"])
def test_sliced_scan_equals_window(skewed, order):
    outputs = {
        "rn": row_number(),
        "upto": running_sum("v"),
        "last": last_seen("held"),
        "n": group_size(),
        "total": group_total("v"),
    }
    plain = ordered_scan(skewed, ["k"], [order], outputs)
    sliced = ordered_scan(skewed, ["k"], [order], outputs, slice_rows=100)
    assert plain.columns == sliced.columns
    assert rows(plain) == rows(sliced)


def test_sliced_scan_by_timestamp(spark):
    events = spark.range(500).select(
        (F.col("id") % 2).alias("k"),
        F.timestamp_seconds(F.col("id") * 7919 % 1009).cast("timestamp_ntz").alias("ts"),
        "id",
    )
    plain = ordered_scan(events, ["k"], ["ts", "id"], {"rn": row_number()})
    assert rows(plain) == rows(ordered_scan(events, ["k"], ["ts", "id"], {"rn": row_number()}, 20))


def test_null_order_values(spark):
    df = spark.range(200).select(
        F.lit("a").alias("k"), F.when(F.col("id") > 5, F.col("id")).alias("o"), "id"
    )
    for order in (["o", "id"], ["-o", "id"]):
        plain = ordered_scan(df, ["k"], order, {"rn": row_number()})
        assert rows(plain) == rows(ordered_scan(df, ["k"], order, {"rn": row_number()}, 20))


@pytest.fixture(scope="module")
def parts(spark):
    chosen = random.Random(5)
    data = [
        ("hot" if i % 3 == 0 else f"c{i % 20}", i, "x" * chosen.choice([0, 1, 5, 9, 30, 120, 400]), "list")
        for i in range(1200)
    ]
    return spark.createDataFrame(data, "ctx_id string, part_idx long, text string, kind string")


def packed_by_hand(parts, budget):
    found, state = {}, {}
    for row in sorted(parts.collect(), key=lambda r: (r["ctx_id"], r["part_idx"])):
        size, (used, call) = len(row["text"]), state.get(row["ctx_id"], (None, -1))
        if used is None or used + size > budget:
            used, call = 0, call + 1
        state[row["ctx_id"]] = (used + size, call)
        found[row["ctx_id"], row["part_idx"]] = call
    return found


@pytest.mark.parametrize(
    "budget, slice_rows", [(450, 7), (3000, 20), (100, 90), (450, 100_000), (2000, 100_000)]
)
def test_pack_chars_is_next_fit(parts, budget, slice_rows):
    packed = pack_chars(parts, budget, slice_rows)
    assert {
        (r["ctx_id"], r["part_idx"]): r["call_idx"] for r in packed.collect()
    } == packed_by_hand(parts, budget)


def test_hot_contexts_pack_and_join_alike(parts):
    assert rows(pack_docs(parts, 10)) == rows(pack_docs(parts, 10, slice_rows=50))
    assert rows(chunk_equal(parts, 7)) == rows(chunk_equal(parts, 7, slice_rows=50))
    joined = {r["ctx_id"]: r["text"] for r in join_ordered(parts, ["ctx_id"], ["part_idx"], "text").collect()}
    pieces = join_ordered(
        parts, ["ctx_id"], ["part_idx"], "text", piece_chars=300, slice_rows=50
    ).collect()
    assert max(len(r["text"]) for r in pieces) < 300 + 401
    for ctx_id, text in joined.items():
        own = sorted((r["piece_idx"], r["text"]) for r in pieces if r["ctx_id"] == ctx_id)
        assert "\n".join(t for _, t in own) == text


@pytest.mark.parametrize("n, groups", [(3, 5), (10, 3), (7, 7), (20, 6)])
def test_equal_chunks(spark, n, groups):
    df = spark.range(n).select(
        F.lit("c").alias("ctx_id"), F.col("id").alias("part_idx"), F.col("id").cast("string").alias("text")
    )
    width = n // groups
    expected = [groups - 1 if width == 0 else min(i // width, groups - 1) for i in range(n)]
    found = assign_equal(df, groups).orderBy("part_idx").collect()
    assert [r["chunk_idx"] for r in found] == expected


@pytest.mark.parametrize("n_chars", [1, 3, 10])
def test_fixed_chunks_lose_nothing(spark, n_chars):
    texts = ["", "a", "a😀b\nc" * 50, "\r\n" * 200, "x" * n_chars * 40, "é" * (n_chars * 32)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    chunks = chunk_fixed(df, n_chars).orderBy("id", "chunk_idx").collect()
    for number, text in enumerate(texts):
        own = [r["chunk"] for r in chunks if r["id"] == number]
        assert own == [text[i : i + n_chars] for i in range(0, len(text), n_chars)]


def test_headers(spark):
    text = "intro\n### One\nbody 1\n#### Two ###\n### \nlast\r### Three\u2028x"
    df = spark.createDataFrame([(1, text), (2, "no header"), (3, "### A\n### B")], "id long, text string")
    found = [tuple(r) for r in chunk_by_header(df).orderBy("id", "section_idx").collect()]
    assert found == [
        (1, 0, "One", "\nbody 1\n#"),
        (1, 1, "Two ###", "\n### \nlast\r"),
        (1, 2, "Three\u2028x", ""),
        (3, 0, "A", "\n"),
        (3, 1, "B", ""),
    ]


def test_profile(spark, parts):
    hello = spark.createDataFrame([("h", 0, "Hello, world!", "str")], parts.schema)
    assert tuple(context_profile(hello).first()) == ("h", "str", 1, 13)
    line = profile_line(hello).first()["line"]
    assert line == (
        "Your context is a str with 13 total characters, and is broken up into chunks of char lengths: [13]."
    )
    hot = {r["ctx_id"]: r["line"] for r in profile_line(parts).collect()}["hot"]
    assert hot.endswith("]... [300 others].")
    assert first_parts(parts, 5, salts=3).where("ctx_id = 'hot'").count() == 5


def test_context_shapes(spark):
    raw = [
        ("text", "plain [not json"),
        ("brackets", "[not json"),
        ("list", '["a", "b", 3]'),
        ("messages", '[{"role": "user", "content": "Hello"}, {"role": "assistant"}]'),
        ("dict", '{"z": "1", "a": {"k": 2}}'),
    ]
    found = context_parts(spark.createDataFrame(raw, "id string, raw string"), "id", "raw")
    by_id = {}
    for r in found.orderBy("ctx_id", "part_idx").collect():
        by_id.setdefault(r["ctx_id"], []).append((r["kind"], r["part_key"], r["role"], r["text"]))
    assert by_id == {
        "text": [("str", None, None, "plain [not json")],
        "brackets": [("str", None, None, "[not json")],
        "list": [("list", None, None, t) for t in ("a", "b", "3")],
        "messages": [("list", None, "user", "Hello"), ("list", None, "assistant", "")],
        "dict": [("dict", "z", None, "1"), ("dict", "a", None, '{"k":2}')],
    }


def test_match_responses_hot_key(spark):
    chosen = random.Random(9)
    requests = [("u", i, chosen.randrange(5000)) for i in range(300)]
    responses = [("u", i, chosen.randrange(5000)) for i in range(120)]
    schema = "key string, {} long, at long"

    def frame(data, name):
        df = spark.createDataFrame(data, schema.format(name))
        return df.withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")

    expected = {}
    for _, number, at in requests:
        ahead = [(r, i) for _, i, r in responses if at <= r <= at + 30]
        expected[number] = min(ahead)[1] if ahead else None
    for slice_rows in (20, 100_000):
        matched = match_responses(
            frame(requests, "request_id"), frame(responses, "response_id"), "key", 30, slice_rows
        ).collect()
        assert {r["request_id"]: r["response_id"] for r in matched} == expected
        assert all((r["error"] is None) == (r["response_id"] is not None) for r in matched)


def windowed(df, keys, order, tie):
    """The same outputs by one window per key."""
    by = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in [*order, *tie]]
    running = Window.partitionBy(*keys).orderBy(*by)
    return df.select(
        "*",
        F.row_number().over(running).cast("long").alias("rn"),
        F.sum("v").over(running.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n"),
    )


@pytest.mark.parametrize("slice_rows", [None, 15, 100_000])
@pytest.mark.parametrize("order", [["name"], ["-name"], ["tied", "name"], ["-tied", "-name"], ["bin", "day", "-name"]])
def test_scan_by_any_order_with_texts(spark, order, slice_rows):
    """Strings, dates and binary, a first column of which one value holds nearly all rows, long payloads."""
    df = spark.range(700).select(
        F.expr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 5 > 0 THEN concat('k', id % 9) END").alias("k"),
        F.concat(F.lit("n"), F.xxhash64("id").cast("string")).alias("name"),
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("tied"),
        F.lit("x").cast("binary").alias("bin"),
        F.when(F.col("id") % 4 > 0, F.expr("date '2024-01-01' + int(id % 3)")).alias("day"),
        (F.col("id") % 13).alias("v"),
        F.repeat(F.col("id").cast("string"), 50).alias("text"),
    )
    outputs = {"rn": row_number(), "upto": running_sum("v"), "n": group_size()}
    found = ordered_scan(df, ["k"], order, outputs, slice_rows)
    assert rows(found) == rows(windowed(df, ["k"], order, []))
    assert found.columns == [*df.columns, "rn", "upto", "n"]


@pytest.mark.parametrize("slice_rows", [None, 10])
def test_rows_with_one_tuple_all_stay(spark, slice_rows):
    df = spark.range(90).select(
        F.lit("a").alias("k"), (F.col("id") % 4).alias("o"), (F.col("id") % 3).alias("v"),
        F.concat(F.lit("text "), (F.col("id") % 3).cast("string")).alias("text"),
    )
    outputs = {"rn": row_number(), "upto": running_sum("v"), "n": group_size()}
    found = ordered_scan(df, ["k"], ["o"], outputs, slice_rows)
    assert rows(found) == rows(windowed(df, ["k"], ["o"], ["v"]))


def test_no_text_in_a_window(parts, capsys):
    """Windows and range partitions see keys, order and lengths only."""
    pack_spans(parts, 100, slice_rows=20).explain("formatted")
    plan = capsys.readouterr().out
    for node in plan.split("\n\n"):
        if ") Window" in node.split("\n")[0]:
            assert "text" not in node


def test_null_contexts_and_texts_stay(spark):
    data = [(None, i, "x" * (i % 5)) for i in range(30)] + [("a", 1, None), ("a", 2, "yy"), ("a", 2, "y"), ("a", 2, "y")]
    df = spark.createDataFrame(data, "ctx_id string, part_idx long, text string")
    by_hand = packed_by_hand(df.fillna("", "text").where("ctx_id IS NULL").fillna("none", "ctx_id"), 9)
    for slice_rows in (4, 200_000):
        packed = pack_chars(df, 9, slice_rows).collect()
        assert len(packed) == len(data)
        assert {("none", r.part_idx): r.call_idx for r in packed if r.ctx_id is None} == by_hand
        assert [r.call_idx for r in packed if r.ctx_id == "a"] == [0] * 4
    spans = pack_spans(df, 9).collect()
    assert len(spans) == len(data) and all(r.call_idx is not None for r in spans)
    assert len(pack_docs(df, 7).where("ctx_id IS NULL").collect()) == 5
    lines = profile_line(df.withColumn("kind", F.lit("list"))).collect()
    assert {r.ctx_id: r.n_parts for r in lines} == {None: 30, "a": 4}


@pytest.mark.parametrize("n_chars", [1, 3, 7, 1000])
def test_chunks_of_any_number_keep_bytes(spark, n_chars):
    """Bytes that are no characters stay, in few chunks and in many."""
    texts = ["", "a", "é" * 10, "ab\n" * 700, "😀x" * 333]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, text string")
    found = chunk_fixed(df, n_chars).collect()
    for i, t in enumerate(texts):
        own = [r.chunk for r in sorted((r for r in found if r.i == i), key=lambda r: r.chunk_idx)]
        assert own == [t[k : k + n_chars] for k in range(0, len(t), n_chars)]
    assert all(r.i != 9 for r in found)
    raw = spark.sql("SELECT CAST(unhex(repeat('FF61', 400)) AS STRING) AS text")
    chunks = chunk_fixed(raw, n_chars).orderBy("chunk_idx").select(F.hex(F.col("chunk").cast("binary")).alias("h"))
    assert "".join(r.h for r in chunks.collect()) == "FF61" * 400
