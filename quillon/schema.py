"""Row types of the engine's tables and the codec of symbol kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

FILES = "relative_path string, mtime_ms bigint, size_bytes bigint, symbol_count int"
SYMBOLS = "name string, name_fold string, kind tinyint, relative_path string, line_number int, col int, tokens array<string>"
LINES = "relative_path string, line_number int, line string"
RESULTS = "file_path string, relative_path string, line_number int, line_content string, match_start int, match_length int"
CHANGES = "relative_path string, op string, ts timestamp"
SCHEMA_VERSION = 2

# Codes of the symbol kinds, by position.
KINDS = ("function", "class", "struct", "enum", "typedef", "namespace", "macro", "variable", "union")


def encode_kind(kind: Column) -> Column:
    """The code of a kind's name, null for a name that is none."""
    return F.when(kind.isin(*KINDS), F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("tinyint")


def decode_kind(code: Column) -> Column:
    """The name of a code; ``variable`` for codes that stand for none."""
    named = F.when(code.between(0, len(KINDS) - 1), F.element_at(F.array(*map(F.lit, KINDS)), code.cast("int") + 1))
    return F.coalesce(named, F.lit("variable"))


@dataclass(frozen=True)
class SearchOptions:
    case_sensitive: bool = False
    whole_word: bool = False
    regex: bool = False
