"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and what they are without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without marks; null has none."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(TOKEN), F.lit(0))


def expanded(name: Column) -> Column:
    """An identifier as words: parted at underscores and where a capital follows a small letter."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "_", " "), "([a-z])([A-Z])", "$1 $2")))


def token_estimate(text: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def matches_symbol(hit: Column, expected: Column) -> Column:
    """Equal in any case, or the end of a qualified name."""
    h, e = F.lower(hit), F.lower(expected)
    return (h == e) | h.endswith(F.concat(F.lit("::"), e)) | h.endswith(F.concat(F.lit("."), e))


def matches_file(hit: Column, expected: Column) -> Column:
    return F.lower(hit).endswith(F.lower(expected))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for the whole text: * and ? match any character."""
    plain = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c for c in glob)
    return f"(?s)^{plain}$"
