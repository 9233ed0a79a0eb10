"""Spreadsheet share links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Where an id stands in a share link, and the export address.
ID_IN_PATH = r"/spreadsheets/d/([A-Za-z0-9_\-]{20,})"
ID_IN_QUERY = r"[?&]id=([A-Za-z0-9_\-]{20,})"
EXPORT_PREFIX = "https://docs.google.com/spreadsheets/d/"
EXPORT_SUFFIX = "/export?format=xlsx"


def sheet_id(url: Column) -> Column:
    """Document id of a share link, null when the link holds none."""
    in_path = F.nullif(F.regexp_extract(url, ID_IN_PATH, 1), F.lit(""))
    in_query = F.nullif(F.regexp_extract(url, ID_IN_QUERY, 1), F.lit(""))
    return F.coalesce(in_path, in_query)


def export_url(url: Column) -> Column:
    return F.concat(F.lit(EXPORT_PREFIX), sheet_id(url), F.lit(EXPORT_SUFFIX))
