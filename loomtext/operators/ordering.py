"""Ordered scans within a key (numbering, running sums, last value seen) that survive a hot key.

A window over ``partitionBy(key)`` sorts a whole key in one task, with all columns of its rows. That is the
cheapest plan while keys are short, and it is taken if none has more than ``SLICE_ROWS`` rows. Otherwise the
rows are cut to the columns the scan reads, range-partitioned on the whole (key, order) tuple and written once,
so a key with any share of the rows spreads over as many partitions as its size asks for, whatever the type of
the order columns and however often one value repeats. Every partition scans its own part of a key; of the keys
that reach over a boundary, at most two a partition, the totals of earlier parts are added. Then the outputs
are joined to the full rows by their tuples. Both plans give the same rows for every input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

from loomtext.functions.text import whole_division
from loomtext.scratch import materialise

#: Rows of one key that a task may sort.
SLICE_ROWS = 20_000
WIDE = (StringType, BinaryType, ArrayType, MapType, StructType, VariantType)


@dataclass(frozen=True)
class Scan:
    """One output of an ordered scan: ``kind`` is number, sum, last, size or total."""

    kind: str
    column: str | None = None


def row_number() -> Scan:
    """1-based position within the key."""
    return Scan("number")


def running_sum(column: str) -> Scan:
    """Sum of ``column`` up to and including this row."""
    return Scan("sum", column)


def last_seen(column: str) -> Scan:
    """Latest non-null ``column`` up to and including this row."""
    return Scan("last", column)


def group_size() -> Scan:
    """Number of rows of the whole key."""
    return Scan("size")


def group_total(column: str) -> Scan:
    """Sum of ``column`` over the whole key."""
    return Scan("total", column)


def _sort_column(name: str) -> Column:
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def _evaluate(scan: Scan, running, whole) -> Column:
    if scan.kind == "number":
        return F.row_number().over(running).cast("long")
    if scan.kind == "sum":
        return F.sum(scan.column).over(running.rowsBetween(Window.unboundedPreceding, 0))
    if scan.kind == "last":
        frame = running.rowsBetween(Window.unboundedPreceding, 0)
        return F.last(scan.column, ignorenulls=True).over(frame)
    if scan.kind == "size":
        return F.count(F.lit(1)).over(whole)
    return F.sum(scan.column).over(whole)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Scan],
    slice_rows: int | None = SLICE_ROWS,
    carry: bool = False,
) -> DataFrame:
    """Add ``outputs`` to every row of ``df``.

    ``order`` names columns of any sortable type, ``-name`` for descending. Rows with one key and equal order
    columns follow each other by the scanned columns, or in any order if these are equal too. NULL keys are
    a key of their own. Columns beside these stay out of a scan over slices if one of them may be long;
    ``carry`` says that all are short.
    """
    keys, order = list(keys), list(order)
    slice_rows = SLICE_ROWS if slice_rows is None else slice_rows
    lead = [name.lstrip("-") for name in order]
    scanned = list(dict.fromkeys(s.column for s in outputs.values() if s.column))
    sizes = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (sizes[0] or 0) <= slice_rows:
        within = [_sort_column(c) for c in [*order, *_sortable(df, scanned)]]
        running, whole = Window.partitionBy(*keys).orderBy(*within), Window.partitionBy(*keys)
        return df.select(
            "*", *(_evaluate(scan, running, whole).alias(name) for name, scan in outputs.items())
        )
    slices = -(-sizes[1] // slice_rows)
    narrow = list(dict.fromkeys([*keys, *lead, *scanned]))
    others = [c for c in df.columns if c not in narrow]
    if carry or not any(isinstance(df.schema[c].dataType, WIDE) for c in others):
        return _scan(df, keys, order, scanned, outputs, slices).select(*df.columns, *outputs)
    found = _scan(df.select(*narrow), keys, order, scanned, outputs, slices)
    return joined_back(df, found, [*keys, *lead], _sortable(df, scanned), list(outputs))


def _sortable(df: DataFrame, columns: list[str]) -> list[str]:
    def sortable(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return all(sortable(f.dataType) for f in kind.fields)
        if isinstance(kind, ArrayType):
            return sortable(kind.elementType)
        return not isinstance(kind, MapType | VariantType)

    return [c for c in columns if sortable(df.schema[c].dataType)]


def _scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    scanned: list[str],
    outputs: dict[str, Scan],
    slices: int,
) -> DataFrame:
    within = [_sort_column(c) for c in [*order, *_sortable(rows, scanned)]]
    along = [*map(_sort_column, keys), *within]
    dealt = rows.repartitionByRange(slices, *along)
    # Written, so that a lost task or a second reader meets the same boundaries.
    written = materialise(dealt.withColumn("_scan_part", F.spark_partition_id()), "scan")
    # A struct compares null fields as equal, so a null key stays one group in the join below.
    parted = written.withColumn("_scan_key", F.struct(*keys))
    running = Window.partitionBy("_scan_key", "_scan_part").orderBy(*within)
    whole = Window.partitionBy("_scan_key", "_scan_part")
    names = {name: f"_local_{name}" for name in outputs}
    local = parted.select(
        "*", *(_evaluate(scan, running, whole).alias(names[name]) for name, scan in outputs.items())
    )
    carry = _carried(parted, running, outputs)
    joined = local.join(F.broadcast(carry), ["_scan_key", "_scan_part"], "left")
    combined = []
    for name, scan in outputs.items():
        here, before = F.col(names[name]), F.col(f"_carry_{name}")
        if scan.kind == "last":
            value = F.coalesce(here, before)
        elif scan.kind in ("size", "total"):
            value = F.coalesce(before, here)
        elif scan.kind == "number":
            value = here + F.coalesce(before, F.lit(0))
        else:
            value = F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))
        combined.append(value.alias(name))
    return joined.select(*rows.columns, *combined)


def _carried(parted: DataFrame, running, outputs: dict[str, Scan]) -> DataFrame:
    """(_scan_key, _scan_part, a column for every output) of the keys that lie in several partitions: what earlier parts
    hand on, or the total of all parts. At most two keys of a partition reach beyond it."""
    last = [name for name, scan in outputs.items() if scan.kind == "last"]
    # Only the last value seen needs an order within the part.
    seen = parted
    if last:
        seen = parted.select(
            "*",
            F.row_number().over(running).alias("_scan_rank"),
            *(_evaluate(outputs[name], running, None).alias(f"_seen_{name}") for name in last),
        )
    ends = []
    for name, scan in outputs.items():
        if scan.kind == "last":
            # In a struct, as max_by passes over rows of which the value is NULL in no other way.
            end = F.max_by(F.struct(f"_seen_{name}"), "_scan_rank")[f"_seen_{name}"]
        elif scan.kind in ("number", "size"):
            end = F.count(F.lit(1))
        else:
            end = F.sum(scan.column)
        ends.append(end.alias(f"_end_{name}"))
    every = Window.partitionBy("_scan_key")
    parts = (
        seen.groupBy("_scan_key", "_scan_part").agg(*ends)
        .withColumn("_scan_parts", F.count(F.lit(1)).over(every))
        .where("_scan_parts > 1")
    )
    earlier = every.orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, scan in outputs.items():
        end = F.col(f"_end_{name}")
        if scan.kind == "last":
            value = F.last(end, ignorenulls=True).over(earlier)
        elif scan.kind in ("size", "total"):
            value = F.sum(end).over(every)
        else:
            value = F.sum(end).over(earlier)
        carried.append(value.alias(f"_carry_{name}"))
    return parts.select("_scan_key", "_scan_part", *carried)


def joined_back(
    df: DataFrame, found: DataFrame, tuple_: list[str], ties: list[str], outputs: list[str]
) -> DataFrame:
    """The rows of ``df`` with the outputs that ``found`` has for their tuples."""
    found = materialise(found, "scanned")
    most = found.groupBy(*tuple_).count().agg(F.max("count")).first()[0] or 0
    on = ["_scan_tuple"]
    left = df.withColumn("_scan_tuple", F.struct(*tuple_))
    right = found.withColumn("_scan_tuple", F.struct(*tuple_))
    if most > 1:
        # Rows of one tuple are told apart by their place among them, the same on both sides.
        on.append("_scan_place")
        own = Window.partitionBy("_scan_tuple")
        left = left.withColumn("_scan_place", F.row_number().over(own.orderBy(*(ties or [F.lit(0)]))))
        by = [*ties, *outputs]
        right = right.withColumn("_scan_place", F.row_number().over(own.orderBy(*_orderable(found, by))))
    joined = left.join(right.select(*on, *outputs), on)
    return joined.select(*df.columns, *outputs)


def _orderable(df: DataFrame, columns: list[str]) -> list:
    return _sortable(df, columns) or [F.lit(0)]


def join_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str = "\n",
    piece_chars: int = 500_000,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Join the texts of a key in order into pieces: rows (keys, piece_idx, n_items, text).

    A piece takes the items that start within its span of ``piece_chars`` characters (separators
    counted), so no row grows with the size of a key; joining the pieces with the separator gives the
    whole text. Keys below the limit come out as one piece, number 0.
    """
    keys, order = list(keys), list(order)
    if "piece_idx" in keys + order:
        raise ValueError("piece_idx is an output of join_ordered; rename that column.")
    scanned = ordered_scan(
        df.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
            "_weight", F.length("_text") + F.lit(max(1, len(separator)))
        ),
        keys,
        order,
        {"_upto": running_sum("_weight")},
        slice_rows=slice_rows,
    )
    piece = whole_division(F.col("_upto") - F.col("_weight"), piece_chars)
    items = F.array_sort(F.collect_list(F.struct(*order, "_text")))
    return (
        scanned.withColumn("piece_idx", piece)
        .groupBy(*keys, "piece_idx")
        .agg(F.count(F.lit(1)).alias("n_items"), items.alias("_items"))
        .select(
            *keys,
            "piece_idx",
            "n_items",
            F.array_join(F.col("_items._text"), separator).alias("text"),
        )
    )
