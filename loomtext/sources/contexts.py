"""Contexts as rows (ctx_id, part_idx, part_key, role, text), one row per part."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtext.functions.messages import MESSAGES, user_prompt
from loomtext.functions.text import whole_division
from loomtext.operators.chunking import chunk_fixed
from loomtext.operators.ordering import ordered_scan, running_sum
from loomtext.scratch import materialise
from loomtext.session import few_listing_tasks, ship_package
from loomtext.sources.json_items import NotJson, as_text, field, items, opens_json

#: Parts that leave a task at a time.
BATCH_CHARS = 4_000_000
BATCH_ROWS = 10_000

PART_COLUMNS = ["ctx_id", "part_idx", "part_key", "role", "text"]


def read_context_text(
    spark: SparkSession, path: str, part_chars: int | None = None, **options
) -> DataFrame:
    """Text contexts, one part per file; the text is the file's exact content.

    With ``part_chars`` a file of any size becomes parts of fewer than twice as many characters, in order of
    ``part_idx`` from 0, which joined without a separator are the file's text; an empty file gives no part.
    Several tasks then read a large file, each a range of its bytes.
    """
    if part_chars is not None:
        return _text_parts(spark, path, part_chars, options)
    with few_listing_tasks(spark):
        files = spark.read.options(**options).text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("ctx_id"),
        F.lit(0).cast("long").alias("part_idx"),
        F.lit(None).cast("string").alias("part_key"),
        F.lit(None).cast("string").alias("role"),
        F.col("value").alias("text"),
        F.lit("str").alias("kind"),
    )


def _text_parts(spark: SparkSession, path: str, part_chars: int, options: dict) -> DataFrame:
    """Lines are what byte ranges can be cut into without splitting a character. A scan over their lengths
    gives every line its place in the file, and lines are cut or joined by place."""
    lines = spark.read.options(**options).text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("ctx_id"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"),
        # Rises within a block, which one task reads from start to end.
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("_line"),
    ).select(
        "*",
        (F.length("_line").cast("long") + 1).alias("_chars"),
        (F.octet_length("_line").cast("long") + 1).alias("_bytes"),
    )
    # Rows are numbered by the reader, so they are written before they are read a second time.
    lines = materialise(lines, "lines")
    placed = ordered_scan(
        lines, ["ctx_id"], ["_block", "_row"], {"_upto": running_sum("_chars"), "_read": running_sum("_bytes")}
    )
    # The last line of a file has a line feed only if the bytes add up with it.
    ended = F.when(F.col("_read") <= F.col("_size"), F.concat("_line", F.lit("\n"))).otherwise(F.col("_line"))
    whole = placed.select("ctx_id", (F.col("_upto") - F.col("_chars")).alias("_start"), ended.alias("_text"))
    cuts = chunk_fixed(whole, part_chars, "_text").select(
        "ctx_id", (F.col("_start") + F.col("chunk_idx") * part_chars).alias("_at"), "chunk"
    )
    pieces = F.array_sort(F.collect_list(F.struct("_at", "chunk")))
    return (
        cuts.groupBy("ctx_id", whole_division(F.col("_at"), part_chars).alias("part_idx"))
        .agg(pieces.alias("_pieces"))
        .select(
            "ctx_id",
            "part_idx",
            F.lit(None).cast("string").alias("part_key"),
            F.lit(None).cast("string").alias("role"),
            F.array_join(F.col("_pieces.chunk"), "").alias("text"),
            F.lit("str").alias("kind"),
        )
    )


def read_context_json(
    spark: SparkSession, path: str, lines: bool = False, ctx_id: str | None = None, **options
) -> DataFrame:
    """List and dict contexts with their parts numbered in file order.

    One JSON document per file, or with ``lines`` one per line, which splits large files. ``ctx_id``
    then names a top-level field that identifies the context and is not one of its parts. A list or a dict
    that is no JSON gives one row of kind ``error`` with ``error``, and none of its parts; so does a
    line without the ``ctx_id`` field, or one that is neither a list nor a dict.
    """
    if lines and ctx_id is None:
        raise ValueError("One context per line needs ctx_id, the field that identifies it.")
    raw = spark.read.options(**options).text(path, wholetext=not lines)
    found = F.lit(None).cast("string") if lines else F.col("_metadata.file_path")
    return _split(raw.select(found.alias("ctx_id"), F.col("value").alias("raw")), True, ctx_id)


def context_parts(df: DataFrame, ctx_id: str, raw: str) -> DataFrame:
    """Parts of raw contexts: plain text, or JSON text of a list, a message list or a dict.

    A message list (first item has ``content``) gives its contents, an empty text where one is
    missing. Other items are kept as they are, in JSON form when they are not text. Dicts keep the
    order of their keys. A text that starts like JSON but is none is plain text, whatever its size.
    """
    rows = df.select(F.col(ctx_id).alias("ctx_id"), F.col(raw).alias("raw"))
    return _split(rows, False, None).drop("error")


def _split(rows: DataFrame, strict: bool, id_field: str | None) -> DataFrame:
    """Parts of (ctx_id, raw) rows. Texts are taken item by item, so none is too long; they are gone
    through once to see whether they are JSON, and once more for the parts."""
    ship_package(rows.sparkSession)
    schema = StructType(
        [
            rows.schema["ctx_id"],
            *StructType.fromDDL(
                "part_idx long, part_key string, role string, text string, kind string, error string"
            ).fields,
        ]
    )
    names = schema.names

    def parts(ctx_id, raw: str | None) -> Iterator[tuple]:
        whole = raw or ""
        opened = opens_json(whole)
        problem = "neither a list nor a dict" if strict and id_field else None
        if opened:
            first, problem = None, None
            try:
                for number, (key, value, source) in enumerate(items(whole)):
                    if number == 0:
                        first = value
                    if id_field is not None and key == id_field:
                        ctx_id = as_text(value, source)
                if id_field is not None and ctx_id is None:
                    problem = f"no field {id_field}"
            except NotJson as error:
                opened, problem = "", str(error) if strict else None
        if problem is not None:
            yield ctx_id, 0, None, None, None, "error", problem
            return
        if not opened:
            yield ctx_id, 0, None, None, raw, "str", None
            return
        kind = "list" if opened == "[" else "dict"
        messages = kind == "list" and isinstance(first, dict) and "content" in first
        for number, (key, value, source) in enumerate(items(whole)):
            if id_field is not None and key == id_field:
                continue
            role, text = None, None
            if not messages:
                text = as_text(value, source)
            elif isinstance(value, dict):
                role = field(source, "role") if value.get("role") is not None else None
                text = field(source, "content")
            yield ctx_id, number, key, role, text or "", kind, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for rows_ in batches:
            for at in range(rows_.num_rows):
                ctx_id, raw = (c[at].as_py() for c in rows_.columns)
                for part in parts(ctx_id, raw):
                    held.append(part)
                    size += len(part[4] or "")
                    if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return rows.mapInArrow(run, schema)


def context_from_table(
    df: DataFrame, ctx_id: str, part_idx: str, text: str, role: str | None = None
) -> DataFrame:
    """Rows of a table as parts. ``part_idx`` orders them and need not be dense."""
    return df.select(
        F.col(ctx_id).alias("ctx_id"),
        F.col(part_idx).cast("long").alias("part_idx"),
        F.lit(None).cast("string").alias("part_key"),
        (F.col(role) if role else F.lit(None).cast("string")).alias("role"),
        F.col(text).alias("text"),
        F.lit("list").alias("kind"),
    )


def to_messages(df: DataFrame, prompt: str) -> DataFrame:
    """Add ``messages`` and ``error`` from a prompt column holding text, messages or a VARIANT.

    Text becomes one user message and a message list stays; anything else is an error row. Text is
    never parsed: only a VARIANT or an array column can be a message list.
    """
    kind = dict(df.dtypes)[prompt]
    column = F.col(prompt)
    if kind == "string":
        text, listed = column, F.lit(None).cast(MESSAGES)
    elif kind == "variant":
        is_text = F.schema_of_variant(column) == "STRING"
        text = F.when(is_text, F.try_variant_get(column, "$", "string"))
        listed = F.try_variant_get(column, "$", MESSAGES)
    else:
        text, listed = F.lit(None).cast("string"), column.cast(MESSAGES)
    plain = F.when(text.isNotNull(), user_prompt(text)).cast(MESSAGES)
    messages = F.coalesce(plain, listed)
    return df.withColumn("messages", messages).withColumn(
        "error", F.when(F.col("messages").isNull(), "Invalid prompt type")
    )


def split_system(
    df: DataFrame, conversation: str, turn: str, role: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """(other messages, one system text per conversation): the last system message wins."""
    system = (
        df.where(F.col(role) == "system")
        .groupBy(conversation)
        .agg(F.max_by(text, turn).alias("system"))
    )
    return df.where(~F.col(role).eqNullSafe("system")), system
