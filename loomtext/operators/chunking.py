"""Cut contexts into chunks and pack parts into calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import whole_division
from loomtext.operators.ordering import (
    SLICE_ROWS,
    group_size,
    join_ordered,
    joined_back,
    ordered_scan,
    row_number,
    running_sum,
)
from loomtext.scratch import materialise
from loomtext.session import ship_package

#: Parts of a context that one task packs at a time.
PACK_ROWS = 200_000

# Fixed value: a section header line.
HEADER = "### (.+)"


def chunk_fixed(df: DataFrame, n_chars: int, text: str = "text") -> DataFrame:
    """Consecutive slices of ``n_chars`` characters, the last one short; empty text gives none.

    Replaces ``text`` by (chunk_idx, chunk), chunk_idx from 0.
    """
    # The cost of a substring grows with its distance from the start, so a text is cut into about as many
    # blocks as a block is into chunks. Bytes that are no characters stay as they are.
    n_chunks = F.ceil(F.length(text) / F.lit(n_chars))
    block = F.ceil(F.sqrt(n_chunks)).cast("int") * n_chars
    starts = F.sequence(F.lit(0), F.ceil(F.length(text) / block).cast("int") - 1)
    blocks = F.transform(starts, lambda b: F.substring(F.col(text), b * block + 1, block))

    def cut(piece):
        within = F.sequence(F.lit(0), whole_division(F.length(piece) - 1, n_chars).cast("int"))
        return F.transform(within, lambda i: F.substring(piece, i * n_chars + 1, F.lit(n_chars)))

    pieces = F.when(F.length(text) > 0, F.flatten(F.transform(blocks, cut)))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(pieces).alias("chunk_idx", "chunk")).withColumn(
        "chunk_idx", F.col("chunk_idx").cast("long")
    )


def assign_equal(
    parts: DataFrame, groups: int, slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Add ``chunk_idx``: ``groups`` runs of n div groups parts, the last taking the remainder.

    With fewer parts than groups every part falls in the last group; empty groups have no rows.
    """
    scanned = ordered_scan(
        parts, ["ctx_id"], ["part_idx"], {"_rn": row_number(), "_n": group_size()}, slice_rows
    )
    width = whole_division(F.col("_n"), groups)
    position = whole_division(F.col("_rn") - 1, F.greatest(width, F.lit(1)))
    index = F.when(width == 0, F.lit(groups - 1)).otherwise(
        F.least(position, F.lit(groups - 1))
    )
    return scanned.withColumn("chunk_idx", index.cast("long")).drop("_rn", "_n")


def chunk_equal(
    parts: DataFrame,
    groups: int,
    separator: str = "\n",
    piece_chars: int = 500_000,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Texts of the equal groups as (ctx_id, chunk_idx, piece_idx, n_items, text)."""
    assigned = assign_equal(parts, groups, slice_rows)
    return join_ordered(
        assigned, ["ctx_id", "chunk_idx"], ["part_idx"], "text", separator, piece_chars, slice_rows
    )


def chunk_by_header(df: DataFrame, text: str = "text", pattern: str = HEADER) -> DataFrame:
    """Sections (section_idx from 0, header, body) between Markdown headers.

    Text before the first header is dropped, as is a text without headers.
    """
    unix = "(?d)" + pattern
    headers = F.regexp_extract_all(F.col(text), F.lit(unix), F.lit(1))
    bodies = F.split(F.col(text), unix, -1)
    sections = F.arrays_zip(
        headers.alias("header"), F.slice(bodies, F.lit(2), F.size(headers)).alias("body")
    )
    others = [c for c in df.columns if c != text]
    if pattern == HEADER:
        df = df.where(F.contains(text, F.lit("### ")))
    return (
        df.select(*others, F.posexplode(sections).alias("section_idx", "_section"))
        .select(
            *others,
            F.col("section_idx").cast("long").alias("section_idx"),
            F.col("_section.header").alias("header"),
            F.col("_section.body").alias("body"),
        )
    )


def section_position(
    sections: DataFrame,
    keys: list[str],
    order: list[str],
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Add section number (from 0), number of sections, and whether it is the last."""
    scanned = ordered_scan(
        sections, keys, order, {"_rn": row_number(), "n_sections": group_size()}, slice_rows
    )
    return (
        scanned.withColumn("section_no", F.col("_rn") - 1)
        .withColumn("is_last", F.col("_rn") == F.col("n_sections"))
        .drop("_rn")
    )


def pack_docs(
    parts: DataFrame, per_call: int = 10, separator: str = "\n", slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """``per_call`` parts per sub-call, in order: (ctx_id, call_idx, n_items, text)."""
    scanned = ordered_scan(parts, ["ctx_id"], ["part_idx"], {"_rn": row_number()}, slice_rows)
    call = whole_division(F.col("_rn") - 1, per_call)
    items = F.array_sort(F.collect_list(F.struct("part_idx", "text")))
    return (
        scanned.withColumn("call_idx", call)
        .groupBy("ctx_id", "call_idx")
        .agg(F.count(F.lit(1)).alias("n_items"), items.alias("_items"))
        .select(
            "ctx_id",
            "call_idx",
            "n_items",
            F.array_join(F.col("_items.text"), separator).alias("text"),
        )
    )


def _length():
    """Characters of a part; a NULL text has none."""
    return F.coalesce(F.length("text"), F.lit(0)).cast("long")


def pack_spans(
    parts: DataFrame, budget: int = 500_000, slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Add ``call_idx`` by prefix sums: a part joins the call in whose span of ``budget`` it starts.

    Needs no sequential pass. A call may pass the budget by part of its last item; ``pack_chars`` does
    not.
    """
    sized = parts.withColumn("_length", _length())
    scanned = ordered_scan(
        sized, ["ctx_id"], ["part_idx"], {"_upto": running_sum("_length")}, slice_rows
    )
    call = whole_division(F.col("_upto") - F.col("_length"), budget)
    return scanned.withColumn("call_idx", call).drop("_length", "_upto")


def _bin_starts(before: np.ndarray, upto: np.ndarray, budget: int, limit: int) -> list[int]:
    """Row numbers in a slice that open a call, given that the open call ends at ``limit``."""
    starts = []
    row = int(np.searchsorted(upto, limit, side="right"))
    while row < len(upto):
        starts.append(row)
        row = max(row + 1, int(np.searchsorted(upto, before[row] + budget, side="right")))
    return starts


def pack_chars(
    parts: DataFrame, budget: int = 500_000, slice_rows: int = PACK_ROWS
) -> DataFrame:
    """Add ``call_idx``: fill each call up to ``budget`` characters, parts whole and in order.

    A part longer than the budget gets a call of its own. NULL contexts are a context, NULL texts have no
    characters, and parts of one number follow each other by length. A call's extent depends on where the one
    before it ended, so a context's parts form a chain. Only three numbers per part travel to Python;
    a chain longer than ``slice_rows`` parts is cut into slices. Each slice is first walked from every
    start it could be entered at (the parts within one budget of its beginning) and hands on the
    limit of the call left open. Then the slices of a context are linked, and each numbers its rows
    from its true entry.
    """
    ship_package(parts.sparkSession)
    sized = parts.select("ctx_id", "part_idx", _length().alias("_length"))
    scanned = ordered_scan(
        sized,
        ["ctx_id"],
        ["part_idx"],
        {"_upto": running_sum("_length"), "_rn": row_number()},
    )
    spans = scanned.select(
        "ctx_id",
        "part_idx",
        (F.col("_upto") - F.col("_length")).alias("before"),
        F.col("_upto").alias("upto"),
        F.col("_rn").alias("place"),
        whole_division(F.col("_rn") - 1, slice_rows).alias("slice"),
    )
    longest = sized.groupBy("ctx_id").count().agg(F.max("count")).first()[0] or 0
    id_type = sized.schema["ctx_id"].dataType.simpleString()
    part_type = sized.schema["part_idx"].dataType.simpleString()

    def number(rows: pd.DataFrame, limit: int, first_call: int) -> pd.DataFrame:
        rows = rows.sort_values("place")
        starts = _bin_starts(rows["before"].values, rows["upto"].values, budget, limit)
        opened = np.searchsorted(np.asarray(starts), np.arange(len(rows)), side="right")
        rows["call_idx"] = first_call + opened
        rows["_length"] = rows["upto"] - rows["before"]
        return rows[["ctx_id", "part_idx", "_length", "call_idx"]]

    schema = f"ctx_id {id_type}, part_idx {part_type}, _length long, call_idx long"
    if longest <= slice_rows:
        numbered = spans.groupBy("ctx_id").applyInPandas(
            lambda rows: number(rows, -1, -1), schema
        )
    else:
        spans = materialise(spans, "spans")
        entries = _slice_entries(spans, budget, id_type)
        numbered = (
            spans.groupBy("ctx_id", "slice")
            .cogroup(entries.groupBy("ctx_id", "slice"))
            .applyInPandas(
                lambda rows, entry: number(
                    rows, int(entry["limit_in"].iloc[0]), int(entry["call_in"].iloc[0])
                ),
                schema,
            )
        )
    sized_parts = parts.withColumn("_length", _length())
    placed = joined_back(
        sized_parts, numbered, ["ctx_id", "part_idx"], ["_length"], ["call_idx"]
    )
    return placed.drop("_length")


def _slice_entries(spans: DataFrame, budget: int, id_type: str) -> DataFrame:
    """(ctx_id, slice, limit_in, call_in): the open call's limit and number on entering each slice.

    Slices are linked by doubling: a slice's exits are joined to those of the slice 1, 2, 4, ... further
    on, and each round the entries known so far lead to as many new ones. So a context of any length
    takes a logarithmic number of rounds, and a task sees the exits of two slices at most.
    """
    exit_schema = (
        f"ctx_id {id_type}, slice long, entry long, entry_upto long, limit_out long, opened long, "
        "cover long"
    )

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        before, upto = rows["before"].values, rows["upto"].values
        # Next start of every row, then, from the back, the last start of the chain and its length.
        following = np.maximum(
            np.searchsorted(upto, before + budget, side="right"), np.arange(len(upto)) + 1
        )
        last, length = np.arange(len(upto)), np.ones(len(upto), dtype=np.int64)
        for row in range(len(upto) - 1, -1, -1):
            if following[row] < len(upto):
                last[row] = last[following[row]]
                length[row] = length[following[row]] + 1
        # A call open on entry began before this slice, so it ends within one budget of the start.
        cover = before[0] + budget
        count = max(1, int(np.searchsorted(before, cover, side="right")))
        return pd.DataFrame(
            {
                "ctx_id": rows["ctx_id"].iloc[0],
                "slice": rows["slice"].iloc[0],
                "entry": np.arange(count),
                "entry_upto": upto[:count],
                "limit_out": before[last[:count]] + budget,
                "opened": length[:count],
                "cover": cover,
            }
        )

    def advance(limits, exits: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Limits after passing the slices that ``exits`` covers, and the calls opened there."""
        exits = exits.sort_values("entry")
        if len(exits) == 0:
            return limits, np.zeros(len(limits), dtype=np.int64)
        at = np.searchsorted(exits["entry_upto"].values, limits, side="right")
        enters, at = at < len(exits), np.minimum(at, len(exits) - 1)
        passed = np.where(enters, exits["limit_out"].values[at], limits)
        return passed, np.where(enters, exits["opened"].values[at], 0)

    def lengthen(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if len(near) == 0 or len(far) == 0:
            return near
        limits, opened = advance(near["limit_out"].values, far)
        reached, cover = near["entry_upto"].max(), near["cover"].iloc[0]
        longer = near.assign(limit_out=limits, opened=near["opened"].values + opened)
        if reached > cover:
            return longer
        # The near slices can lie within one call altogether; it is then entered in the far ones.
        far = far.sort_values("entry")
        beyond = far[far["entry_upto"] > reached]
        count = int(np.searchsorted(beyond["entry_upto"].values, cover, side="right")) + 1
        beyond = beyond.head(count)[["entry", "entry_upto", "limit_out", "opened"]].assign(
            ctx_id=near["ctx_id"].iloc[0], slice=near["slice"].iloc[0], cover=cover
        )
        beyond["entry"] = near["entry"].max() + 1 + np.arange(len(beyond))
        return pd.concat([longer, beyond[longer.columns]])

    def enter(known: pd.DataFrame, exits: pd.DataFrame) -> pd.DataFrame:
        limits, opened = advance(known["limit_in"].values, exits)
        return known.assign(limit_in=limits, call_in=known["call_in"].values + opened)

    def paired(left: DataFrame, right: DataFrame):
        # Both sides come from the same table, so the keys of one need names of their own.
        renamed = right.withColumnsRenamed({"ctx_id": "_ctx_id", "slice": "_slice"})
        return left.groupBy("ctx_id", "slice").cogroup(renamed.groupBy("_ctx_id", "_slice"))

    def of_slices(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """Rows of the chosen (ctx_id, slice), of which ctx_id may be NULL."""
        keys = chosen.select(F.col("ctx_id").alias("_ctx_id"), F.col("slice").alias("_slice"))
        same = F.col("ctx_id").eqNullSafe(F.col("_ctx_id")) & (F.col("slice") == F.col("_slice"))
        return rows.join(keys, same, "left_semi")

    exits = materialise(
        spans.groupBy("ctx_id", "slice").applyInPandas(walk, exit_schema), "exits"
    )
    slices = exits.where("entry = 0").select("ctx_id", "slice")
    last = slices.agg(F.max("slice")).first()[0] or 0
    known = slices.where("slice = 0").select(
        "*", F.lit(-1).cast("long").alias("limit_in"), F.lit(-1).cast("long").alias("call_in")
    )
    reach = 1
    while reach <= last:
        here = of_slices(exits, known)
        entered = paired(known, here).applyInPandas(enter, known.schema)
        ahead = of_slices(entered.withColumn("slice", F.col("slice") + reach), slices)
        known = materialise(known.unionByName(ahead), "entries")
        if 2 * reach <= last:
            far = exits.withColumn("slice", F.col("slice") - reach).where("slice >= 0")
            exits = materialise(paired(exits, far).applyInPandas(lengthen, exit_schema), "exits")
        reach *= 2
    return known
