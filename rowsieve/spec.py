"""Options of a cleansing run and the checks made before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, Flag

# Default multi-value delimiters, one character each.
DEFAULT_DELIMITERS = ";,|\n\r"


class SheetMode(Enum):
    ALL = "all"
    BY_NAME = "by_name"
    FIRST_N = "first_n"


class KeyMode(Enum):
    SINGLE = "single"
    MULTIPLE = "multiple"
    ROW = "row"
    NONE = "none"


class Validation(Flag):
    NONE = 0
    EMAIL = 1
    NOT_EMPTY = 2


class OutputFormat(Enum):
    PARQUET = "parquet"
    CSV = "csv"


class Destination(Enum):
    NEW = "new"
    IN_PLACE = "in_place"


class Chunking(Enum):
    NONE = "none"
    PER_SHEET = "per_sheet"
    MERGED_SHEETS = "merged_sheets"
    SEPARATE_FILES = "separate_files"


class SpecError(ValueError):
    """The options contradict each other or cannot be met."""


@dataclass(frozen=True)
class Lineage:
    """Which columns of a frame say where a row came from.

    ``order`` must be non-null and unique per row: it decides which of several
    equal rows comes first. ``sheet`` and ``file`` name the columns holding the
    row's table and file; both are optional for plain tables. Where no row can be
    blank in all its data columns, ``blank_rows=False`` saves reading them to find out.
    """

    order: tuple[str, ...]
    sheet: str | None = None
    file: str | None = None
    extra: tuple[str, ...] = ()
    blank_rows: bool = True

    @property
    def columns(self) -> tuple[str, ...]:
        named = [*self.order, *(c for c in (self.sheet, self.file) if c), *self.extra]
        return tuple(dict.fromkeys(named))


# Lineage carried by every frame read from files (see rowsieve.sources).
FILE_LINEAGE = Lineage(
    order=("_file_ord", "_row"), sheet="_sheet", file="_file", extra=("_sheet_ord",)
)


@dataclass(frozen=True)
class CleanseSpec:
    sheets: SheetMode = SheetMode.ALL
    sheet_patterns: tuple[str, ...] = ()
    first_n: int = 1

    key_mode: KeyMode = KeyMode.SINGLE
    key_columns: tuple[str, ...] = ()
    case_sensitive: bool = False

    explode_multi: bool = False
    delimiters: str = DEFAULT_DELIMITERS

    validation: Validation = Validation.NONE
    validation_column: str = ""

    # True: one bucket, and one dedup scope, per source sheet.
    # False: one bucket named after the unique sheet and one scope overall.
    keep_sheets: bool = True

    emit_unique: bool = True
    emit_duplicates: bool = False
    emit_invalid: bool = False
    unique_name: str = "Unique"
    duplicates_name: str = "Duplicates"
    invalid_name: str = "Invalid"

    output_dir: str | None = None
    format: OutputFormat = OutputFormat.PARQUET
    destination: Destination = Destination.NEW

    chunking: Chunking = Chunking.NONE
    chunk_rows: int = 10_000

    @property
    def per_file(self) -> bool:
        """Sources replaced in place are deduplicated each on their own."""
        return self.destination is Destination.IN_PLACE

    @property
    def rows_per_chunk(self) -> int:
        return max(1, self.chunk_rows)

    @property
    def effective_chunking(self) -> Chunking:
        """Splitting each sheet needs sheets to be kept, unless every table is a CSV of its own."""
        if self.chunking is Chunking.PER_SHEET and not self.keep_sheets and self.format is not OutputFormat.CSV:
            return Chunking.NONE
        return self.chunking

    @property
    def effective_validation_column(self) -> str:
        if self.validation_column.strip():
            return self.validation_column
        return self.key_columns[0] if self.key_columns else ""

    def check(self) -> "CleanseSpec":
        if self.validation and not self.effective_validation_column.strip():
            raise SpecError("validation needs a validation column or a key column")
        if self.destination is Destination.IN_PLACE:
            if self.chunking is not Chunking.NONE:
                raise SpecError("chunked output is not possible when replacing sources in place")
            if self.sheets is not SheetMode.ALL:
                raise SpecError("replacing sources in place would lose the sheets not selected")
        elif not (self.emit_unique or self.emit_duplicates or self.emit_invalid):
            raise SpecError("choose at least one bucket to write")
        return self
