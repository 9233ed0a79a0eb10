"""First-wins deduplication: keys, row order, and who comes first.

No step puts all rows of a key into one task. Winners come from a grouped
minimum, which Spark combines before the shuffle. Their positions are gathered as
bitmaps, a bit for each row, and wide rows are marked where they lie; only if the
bitmaps are too large to be sent to all tasks do rows meet their winner by position.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from rowsieve.functions.text import compact_key, norm_key, or_empty
from rowsieve.operators.columns import blank_test, col_ref, find_column, text_of
from rowsieve.operators.small import conf_bytes
from rowsieve.session import checkpointed
from rowsieve.spec import CleanseSpec, KeyMode

# Bits of whole-number types, and of what a decimal of 38 digits can hold.
INTEGRAL_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
DECIMAL_BITS = 126
# Positions the library assigns itself are never negative.
POSITIONS = {"_file_ord", "_sheet_ord", "_row", "_part", "_pos"}


def order_key(df: DataFrame, order) -> Column:
    """One value that sorts rows by ``order``.

    Whole-number columns are packed into one decimal where they fit: a minimum
    over it stays in hash aggregation, over a struct it would have to sort.
    """
    if len(order) == 1:
        return F.col(order[0])
    widths = packed_widths(df, order)
    if widths is None:
        return F.struct(*[F.col(c) for c in order])
    packed = F.col(order[0]).cast("decimal(38,0)")
    for c, bits in zip(order[1:], widths[1:]):
        value = F.col(c).cast("decimal(38,0)")
        if c not in POSITIONS:
            value = value + F.lit(Decimal(2 ** (bits - 1)))
        packed = (packed * F.lit(Decimal(2**bits)) + value).cast("decimal(38,0)")
    return packed


def packed_widths(df: DataFrame, order) -> list[int] | None:
    """Bits of each order column in a packed position, or None if they cannot be packed."""
    kinds = dict(df.dtypes)
    if any(kinds[c] not in INTEGRAL_BITS for c in order):
        return None
    widths = [INTEGRAL_BITS[kinds[c]] - (c in POSITIONS or not i) for i, c in enumerate(order)]
    return widths if sum(widths) <= DECIMAL_BITS else None


def unpacked(pos: Column, order, widths: list[int]) -> dict[str, Column]:
    """The order columns of a packed position, as whole numbers."""
    if len(order) == 1:
        return {order[0]: pos.cast("bigint")}
    out, left = {}, pos
    for i, c in enumerate(order[:-1]):
        below = F.lit(Decimal(2 ** sum(widths[i + 1 :])))
        rest = F.pmod(left, below)
        out[c] = F.call_function("div", left - rest, below)
        left = rest
    out[order[-1]] = left.cast("decimal(38,0)")
    for c, bits in zip(order[1:], widths[1:]):
        if c not in POSITIONS:
            out[c] = out[c].cast("decimal(38,0)") - F.lit(Decimal(2 ** (bits - 1)))
    return {c: value.cast("bigint") for c, value in out.items()}


def with_keys(df: DataFrame, spec: CleanseSpec, data_cols) -> tuple[DataFrame, list[str], Column]:
    """``df`` plus its key columns, their names, and whether the key is empty.

    An empty single key never makes rows equal. Several key columns do, even if
    all of them are blank.
    """
    if spec.key_mode is KeyMode.NONE:
        return df, [], F.lit(True)
    if spec.key_mode is KeyMode.ROW:
        names = list(data_cols)
    elif spec.key_mode is KeyMode.SINGLE:
        names = list(spec.key_columns[:1])
    else:
        names = list(spec.key_columns)
    if spec.key_mode is KeyMode.SINGLE and names and find_column(df, names[0]) is None:
        text_of(df, names[0])  # warns that the column is missing
        names = []
    if not names:
        return df, [], F.lit(True)
    keys = [f"_k{i}" for i in range(len(names))]
    if spec.key_mode is KeyMode.ROW and len(names) > 1:
        # Lengths make the joined text unambiguous, so one narrow key serves any width.
        out = df.withColumns({k: key_text(df, n, spec.case_sensitive) for k, n in zip(keys, names)})
        pieces = [p for k in keys for p in (F.length(k).cast("string"), F.lit(":"), F.col(k))]
        out = out.withColumn("_key", F.concat(*pieces)).drop(*keys)
        return out.withColumn("_key", compact_key(F.col("_key"))), ["_key"], F.lit(False)
    plain = {k: col_ref(find_column(df, n)) for k, n in zip(keys, names) if has_plain_key(df, n)}
    text = {k: key_text(df, n, spec.case_sensitive) for k, n in zip(keys, names) if k not in plain}
    out = df.withColumns(plain | text)
    out = out.withColumns({k: compact_key(F.col(k)) for k in text}) if text else out
    return out, keys, blank_test(df, names[0]) if len(names) == 1 else F.lit(False)


def has_plain_key(df: DataFrame, name: str) -> bool:
    """Numbers, dates and booleans are equal exactly if their texts are; null is the empty text."""
    found = find_column(df, name)
    return found is not None and isinstance(df.schema[found].dataType, (T.NumericType, T.BooleanType, T.DateType))


def key_text(df: DataFrame, name: str, case_sensitive: bool) -> Column:
    if has_plain_key(df, name):
        return or_empty(text_of(df, name))
    return norm_key(text_of(df, name), case_sensitive)


def winners(contenders: DataFrame, group_cols, order) -> DataFrame:
    """Position ``_pos`` of the earliest row of each group; nothing else is shuffled."""
    placed = contenders.withColumn("_pos", order_key(contenders, order))
    return placed.groupBy(*group_cols).agg(F.min("_pos").alias("_pos")).select("_pos")


BLOCK_BITS = 15  # positions of a block, one bit each: 4 KiB
BLOCK_BYTES = (1 << BLOCK_BITS) // 8


def mark_first(df: DataFrame, first: DataFrame, order) -> DataFrame:
    """Add ``_first``: is this row's position among the winners'?

    Bitmaps of the winners' positions go to all tasks if their measured size allows it,
    and no wide row moves. Above that rows are spread by their unique position, so
    neither a hot key nor a mass of rows without one ends up in one task.
    """
    widths = packed_widths(df, order)
    if widths is not None:
        seen = Observation()
        blocks = checkpointed(winner_blocks(first, order, widths).observe(seen, F.count("*").alias("blocks")))
        if seen.get["blocks"] * (BLOCK_BYTES + 64) <= conf_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"):
            return mark_by_bitmap(df, blocks, order)
    placed = df.withColumn("_pos", checked(order_key(df, order), order))
    found = placed.join(first.withColumn("_first", F.lit(True)), "_pos", "left")
    return found.withColumn("_first", F.coalesce("_first", F.lit(False))).drop("_pos")


def block_columns(values: dict[str, Column], order) -> tuple[list[Column], Column]:
    """The block of a position (``_in0`` on), and its bit there: that of the row number, or else the first column."""
    dense = "_row" if "_row" in order else order[0]
    high = F.shiftright(values[dense], BLOCK_BITS)
    rest = [values[c] for c in order if c != dense]
    return [c.alias(f"_in{i}") for i, c in enumerate([high, *rest])], values[dense].bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def winner_blocks(first: DataFrame, order, widths: list[int]) -> DataFrame:
    """(_in0.., _bits): a bitmap for each block of positions that holds winners."""
    block, bit = block_columns(unpacked(F.col("_pos"), order, widths), order)
    placed = first.select(*block, bit.alias("_bit"))
    return placed.groupBy(*[c for c in placed.columns if c != "_bit"]).agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def mark_by_bitmap(df: DataFrame, blocks: DataFrame, order) -> DataFrame:
    """``df`` with ``_first`` from broadcast ``blocks``; rows stay where they are."""
    block, bit = block_columns({c: F.col(c).cast("bigint") for c in order}, order)
    names = [f"_in{i}" for i in range(len(block))]
    placed = df.select("*", *block, checked(bit, order).alias("_bit")).join(F.broadcast(blocks), names, "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    mark = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return placed.withColumn("_first", F.coalesce(mark, F.lit(False))).drop(*names, "_bit", "_bits")


def checked(value: Column, order) -> Column:
    """``value``, or a failure of the query where a position that the user names is null."""
    if library_made(order):
        return value
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in order])
    return F.when(missing, refuse("has a null")).otherwise(value)


def library_made(order) -> bool:
    """Positions that the library assigns are unique and not null."""
    return set(order) <= POSITIONS


def repeated(df: DataFrame, order, like: DataFrame) -> DataFrame:
    """No row, in the shape of ``like`` (``_pos``); the query fails if two rows share a position.

    Only the columns of ``order`` are read.
    """
    times = df.groupBy(*[F.col(c) for c in order]).count().filter("count > 1")
    return times.select(refuse("repeats").cast(like.schema["_pos"].dataType).alias("_pos"))


def refuse(what: str) -> Column:
    """Fail the query: which of several rows comes first would be left to chance."""
    return F.raise_error(F.lit(f"the row order {what}; Lineage.order must be unique and not null"))


def keep_first(df: DataFrame, group_cols, order, among: Column | None = None) -> DataFrame:
    """Only the earliest row of each group, and every row that does not meet ``among``.

    Spark applies the limit of one row per group inside every map task as well,
    so a hot key reaches its final task as one row per map task. A row that takes
    no part is a group of its own.
    """
    by = [F.col(c) for c in group_cols]
    if among is not None:
        by = [F.when(among, c) for c in by] + [F.when(~among, order_key(df, order))]
    window = Window.partitionBy(*by).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
