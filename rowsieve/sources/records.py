"""CSV files of any size read by many tasks, whatever their cells contain.

A line end inside a quoted cell does not end the record, so whether a line starts
a record depends on all lines before it. Each line is reduced to what it does to
the state "inside a quoted cell": it fixes the state or flips it or leaves it.
A task adds up such effects along its split and puts lines together wherever they are
known to belong to one record, so that lines are not shuffled; the effects of whole splits
add up over the splits, of which there is one row each. Only records that cross the end of a
split, or begin before anything in it fixes the state, meet in a shuffle; no task ever reads
a whole file. Lines end at CR, LF or both, and a line end inside a cell reads as LF; lines
of white space only hold no record.

Codes say what a split has done up to some line: bit 0 is the state if the split begins
outside a quoted cell, bit 1 tells whether beginning inside one changes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowsieve.operators.small import join_small
from rowsieve.session import checkpointed, scratch_path, stage
from rowsieve.sources.files import ROW_BITS, literal, plain_name, row_position

# Parts of a line of cells, with " as quote and "" as escaped quote.
QUOTED_REST = r'[^"]*+(?:""[^"]*+)*+'
CELL = rf'(?:"{QUOTED_REST}"[^,]*+|[^",][^,]*+)?+'
OPENS = rf'^(?:{CELL},)*+"{QUOTED_REST}\z'
STAYS = rf"^{QUOTED_REST}\z"
REOPENS = rf'^{QUOTED_REST}"[^,]*+,(?:{CELL},)*+"{QUOTED_REST}\z'

CELL_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "maxCharsPerColumn": "-1",
    "maxColumns": str(1 << 20),
    "mode": "PERMISSIVE",
}
#: Records of more characters than this, put together from several lines, fail their file.
MAX_RECORD = 1 << 28
UNCLOSED = "A quoted cell is not closed"
TOO_LONG = "A record has more than {} characters"

# Codes: known to be inside a cell; state as at the beginning of the split, or the other one.
INSIDE, LEAVES, FLIPS = 1, 2, 3
PIECE_SCHEMA = (
    "_file string, _row bigint, _line string, _lines bigint, _length bigint, _filled boolean, _before int, _after int"
)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their place and the code of what each does by itself."""
    quoted = F.col("_line").contains('"')
    opens = quoted & F.col("_line").rlike(OPENS)
    inside = ~quoted | F.col("_line").rlike(STAYS) | F.col("_line").rlike(REOPENS)
    lines = spark.read.text([literal(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("_path"),
        row_position(spark, splittable=True).alias("_row"),
        F.col("value").alias("_line"),
    )
    code = opens.cast("int") + F.when(opens != inside, 2).otherwise(0)
    return lines.select("_path", "_row", "_line", code.alias("_code"), (F.trim("_line") != "").alias("_filled"))


def running_codes(codes: np.ndarray, begins: np.ndarray, last: int) -> np.ndarray:
    """Codes after ``last`` and after each line; lines at ``begins`` are the first of a split."""
    codes = np.concatenate(([last], codes))
    anchors = np.concatenate(([True], begins | (codes[1:] < LEAVES)))
    at = np.maximum.accumulate(np.where(anchors, np.arange(len(codes)), 0))
    flips = np.cumsum(codes == FLIPS)
    return codes[at] ^ ((flips - flips[at]) & 1)


def joined_lines(lines: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines), "\n")


def piece_batch(paths: pa.Array, lines: pa.Array, rows, count, length, filled, before, after) -> pa.RecordBatch:
    paths = paths.dictionary_encode()
    files = pa.array([plain_name(p) for p in paths.dictionary.to_pylist()], pa.string()).take(paths.indices)
    numbers = [pa.array(rows, pa.int64()), lines, pa.array(count, pa.int64()), pa.array(length, pa.int64())]
    codes = [pa.array(before, pa.int32()), pa.array(after, pa.int32())]
    return pa.RecordBatch.from_arrays(
        [files, *numbers, pa.array(filled, pa.bool_()), *codes],
        ["_file", "_row", "_line", "_lines", "_length", "_filled", "_before", "_after"],
    )


class OpenPiece:
    """The lines so far of a cell that is not closed where a batch ends."""

    def __init__(self, path: pa.Array, row: int, before: int):
        self.path, self.row, self.before = path, row, before
        self.parts, self.count, self.length = [], 0, 0

    def add(self, lines: pa.Array, length: int, max_record: int) -> None:
        self.count += len(lines)
        self.length += length
        if self.length <= max_record:
            self.parts.append(lines)
        else:
            self.parts.clear()  # the file is broken, so that the text is not needed

    def batch(self, after: int) -> pa.RecordBatch:
        lines = pa.concat_arrays(self.parts) if self.parts else pa.nulls(1, pa.string())
        line = joined_lines(lines, np.array([0, len(lines)])) if self.parts else lines
        # A line that opens a cell has a quote, so that it is not blank.
        return piece_batch(self.path, line, [self.row], [self.count], [self.length], [True], [self.before], [after])


def line_pieces(batches: Iterator[pa.RecordBatch], max_record: int) -> Iterator[pa.RecordBatch]:
    """The lines of a task's splits, each joined to the one before it if that surely ends inside a cell."""
    place, last, held = None, LEAVES, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        paths, lines = batch.column("_path"), batch.column("_line")
        rows, filled = batch.column("_row").to_numpy(), batch.column("_filled").to_numpy(zero_copy_only=False)
        blocks, lengths = rows >> ROW_BITS, pc.utf8_length(lines).to_numpy().astype(np.int64) + 1
        begins = np.ones(n, bool)
        begins[0] = place != (paths[0].as_py(), blocks[0])
        begins[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
        states = running_codes(batch.column("_code").to_numpy(), begins, last)
        before, after = np.where(begins, LEAVES, states[:-1]), states[1:]
        starts = np.flatnonzero(before != INSIDE)
        first = int(starts[0]) if len(starts) else n
        if first:
            held.add(lines[:first], int(lengths[:first].sum()), max_record)
        if held is not None and first < n:
            yield held.batch(int(after[first - 1]) if first else last)
            held = None
        end = n
        if len(starts) and after[-1] == INSIDE:
            end, starts = int(starts[-1]), starts[:-1]
            held = OpenPiece(paths[end:end + 1], int(rows[end]), int(before[end]))
            held.add(lines[end:], int(lengths[end:].sum()), max_record)
        if len(starts):
            offsets = np.append(starts, end)
            yield piece_batch(
                paths.take(pa.array(starts)), joined_lines(lines, offsets), rows[starts], np.diff(offsets),
                np.add.reduceat(lengths[:end], starts), filled[starts], before[starts], after[offsets[1:] - 1],
            )
        place, last = (paths[n - 1].as_py(), blocks[-1]), int(states[-1])
    if held is not None:
        yield held.batch(last)


def running_effect(fixed: Column, flips: Column, window) -> tuple[Column, Column]:
    """(state as of the last fixed one, corrected by all flips; flips so far)."""
    flipped = F.sum(flips).over(window)
    return F.last((fixed + flipped) % 2, ignorenulls=True).over(window), flipped


def state_of(code: str, start: str) -> Column:
    """State that a code stands for, given the one in which its split begins."""
    return F.col(code).bitwiseAND(1).bitwiseXOR(F.shiftright(code, 1).bitwiseAND(F.col(start)))


def find_records(spark: SparkSession, paths: list[str], max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame, str]:
    """(``_file``, ``_row``, ``_line`` of the data records, ``_file`` and ``_broken``, the staged pieces).

    One scan joins the lines of a split as far as it can tell and stages these pieces with
    their codes; the others are put together from there. How long each record gets is known
    before its pieces meet: a file with an unclosed quote or a record of several lines above
    ``max_record`` is broken, as the reason in ``_broken`` says, and gives no records.
    """
    path = scratch_path(spark, "lines")
    found = read_lines(spark, paths).mapInArrow(lambda batches: line_pieces(batches, max_record), PIECE_SCHEMA)
    pieces = stage(found, path).withColumn("_block", F.shiftright("_row", ROW_BITS))
    blocks = pieces.groupBy("_file", "_block").agg(
        F.max_by("_after", "_row").alias("_end"), F.min(F.when(F.col("_filled"), F.col("_row"))).alias("_lead")
    )
    over_blocks = Window.partitionBy("_file").orderBy("_block")  # one row per block
    known = F.col("_end") < LEAVES
    base, flipped = running_effect(F.when(known, F.col("_end")), F.when(F.col("_end") == FLIPS, 1).otherwise(0), over_blocks)
    ends = blocks.withColumns({"_b": base, "_f": flipped}).withColumn(
        "_state", ((F.coalesce("_b", F.lit(0)) + F.col("_f")) % 2).cast("int")
    )
    starts = ends.select(
        F.struct("_file", "_block").alias("_at"),
        F.lag("_state", 1, 0).over(over_blocks).alias("_start"),
        # The header is the record that begins with the first line that is not blank.
        F.min("_lead").over(Window.partitionBy("_file")).alias("_header"),
    )
    placed = join_small(pieces.withColumn("_at", F.struct("_file", "_block")), starts, "_at").withColumns(
        {"_before": state_of("_before", "_start"), "_after": state_of("_after", "_start")}
    )

    whole = (F.col("_before") == 0) & (F.col("_after") == 0)
    single = placed.filter(whole).select("_file", "_row", "_line", "_lines", "_length", "_header")
    # Only pieces of records are put together, named after the first line of theirs; a block
    # that begins inside a record takes its name from the blocks before.
    parts = placed.filter(~whole)
    begun = F.when(F.col("_before") == 0, F.col("_row"))
    carried = parts.groupBy("_file", "_block").agg(F.max(begun).alias("_last")).select(
        F.struct("_file", "_block").alias("_at"),
        F.last("_last", ignorenulls=True).over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
    )
    in_block = Window.partitionBy("_file", "_block").orderBy("_row")
    own = parts.withColumn("_first", F.last(begun, ignorenulls=True).over(in_block))
    named = join_small(own, carried, "_at").withColumn("_first", F.coalesce("_first", "_carried"))
    lengths = named.groupBy("_file", "_first").agg(
        F.sum("_length").alias("_length"), F.max_by("_after", "_row").alias("_open")
    ).unionByName(
        single.filter(F.col("_lines") > 1).select("_file", F.col("_row").alias("_first"), "_length", F.lit(0).alias("_open"))
    )
    why = F.when(F.col("_open") == 1, F.lit(UNCLOSED)).when(F.col("_length") > max_record, F.lit(TOO_LONG.format(max_record)))
    broken = checkpointed(
        lengths.withColumn("_broken", why).filter(F.col("_broken").isNotNull())
        .groupBy("_file").agg(F.min_by("_broken", "_first").alias("_broken"))
    )
    if not broken.isEmpty():
        single, named = (
            join_small(part, broken, "_file").filter(F.col("_broken").isNull()).drop("_broken") for part in (single, named)
        )
    texts = F.array_sort(F.collect_list(F.struct("_row", "_line")))
    joined = named.groupBy("_file", "_first", "_header").agg(
        F.array_join(F.transform(texts, lambda p: p["_line"]), "\n").alias("_line")
    )
    records = single.select("_file", "_row", "_line", "_header").unionByName(joined.withColumnRenamed("_first", "_row"))
    data = records.filter((F.trim("_line") != "") & (F.col("_row") != F.col("_header")))
    return data.select("_file", "_row", "_line"), broken, path


def width_classes(widths: Iterable[int]) -> list[int]:
    """The widest of the widths that are near each other, that is below one power of two."""
    widest: dict[int, int] = {}
    for width in widths:
        power = (max(1, width) - 1).bit_length()
        widest[power] = max(width, 1, widest.get(power, 1))
    return sorted(widest.values())


def cells_of(records: DataFrame, widths: Iterable[int]) -> DataFrame:
    """``records`` with the ``_cells`` of ``_line`` in its place.

    ``_width`` says how many cells a row's file has, ``widths`` which numbers there are. Each
    class of widths has a parser of its own inside the one scan, so that a row is never wider
    than the class of its own file.
    """
    classes = width_classes(widths)
    own = [
        (F.col("_width") <= top) & (F.col("_width") > below) for below, top in zip([-1, *classes], classes)
    ]
    parsed, cells = [], None
    for i, (top, here) in enumerate(zip(classes, own)):
        record = F.from_csv("_line", ", ".join(f"c{j} string" for j in range(top)), CELL_OPTIONS)
        parsed.append(F.when(here, record).alias(f"_record{i}"))
        # One expression as text: thousands of columns built one by one take minutes.
        array = F.expr(f"array({', '.join(f'_record{i}.c{j}' for j in range(top))})")
        cells = F.when(here, array) if cells is None else cells.when(here, array)
    rest = [c for c in records.columns if c != "_line"]
    return records.select(*rest, *parsed).select(*rest, cells.alias("_cells"))
