"""Spark-native cleansing, validation and first-wins deduplication of tabular data."""

from rowsieve.operators.route import cleanse, duplicates, invalid, unique_rows
from rowsieve.spec import (
    Chunking,
    CleanseSpec,
    Destination,
    KeyMode,
    Lineage,
    OutputFormat,
    SheetMode,
    Validation,
)

__all__ = [
    "Chunking",
    "CleanseSpec",
    "Destination",
    "KeyMode",
    "Lineage",
    "OutputFormat",
    "SheetMode",
    "Validation",
    "cleanse",
    "duplicates",
    "invalid",
    "unique_rows",
]
