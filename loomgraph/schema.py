"""The graph tables and their fixed vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of symbols and relationships, confidences, prefixes of unresolved targets.
SYMBOL_KINDS = ("module", "class", "function", "method", "interface", "type_alias", "enum", "constant", "variable", "import", "namespace")
EDGE_KINDS = ("calls", "imports", "inherits", "implements", "references", "decorates", "contains")
CONFIDENCES = ("extracted", "inferred", "ambiguous")
EXTERNAL, UNRESOLVED = "<external>::", "<unresolved>::"

FILES = "path string, language string, content_hash string, symbol_count long, relationship_count long, size_bytes long, is_test boolean"
SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, start_line int, start_col int, end_line int, end_col int, docstring string, signature string, decorators array<string>, language string, is_test boolean"
RELATIONSHIPS = "source_id string, target_id string, kind string, file_path string, start_line int, start_col int, end_line int, end_col int, confidence string"


@dataclass(frozen=True)
class GraphTables:
    """Symbols (one row an id) and relationships (a multigraph whose ends may be missing)."""

    symbols: DataFrame
    relationships: DataFrame
    files: DataFrame


def is_sentinel(target: Column) -> Column:
    """Whether an edge's target names something that was not found."""
    return target.startswith(EXTERNAL) | target.startswith(UNRESOLVED)


def is_test_path(path: Column) -> Column:
    """A directory test, tests, spec or __tests__ within the path, or a file named like a test."""
    return path.rlike(r"(?i)[/\\](tests?|spec|__tests__)[/\\]|[/\\](test_[^/\\]*|[^/\\]*_test|[^/\\]*\.spec|[^/\\]*\.test)\.[^./\\]+$")


def page(limit: int, most: int = 500) -> int:
    """A limit within 1 and ``most``."""
    return max(1, min(int(limit), most))


def check_kind(kind: str) -> str:
    if kind not in SYMBOL_KINDS:
        raise ValueError(f"kind must be one of {', '.join(SYMBOL_KINDS)}")
    return kind


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
