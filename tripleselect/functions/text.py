"""Text Column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the cleaner deletes (all but [A-Za-z0-9 ]; written out, since Java takes
# several times as long for the negated class) and the token separator.
KEEP_CHARS_PATTERN = r"[\x00-\x1f!-/:-@\[-`{-\x{10FFFF}]+"
TOKEN_SEPARATOR = " +"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Delete every character outside ``[A-Za-z0-9 ]``.

    Tabs and newlines are deleted, not replaced, so the words around them
    join.  A null text becomes the empty string.
    """
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), KEEP_CHARS_PATTERN, "")


def tokens(col, lower: bool = True) -> Column:
    """Array of non-empty tokens of an already-cleaned text."""
    c = _c(col)
    if lower:
        c = F.lower(c)
    return F.filter(F.split(c, TOKEN_SEPARATOR), lambda t: t != "")


def token_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens(clean_text(...))`` of an Arrow batch: the tokens of all texts
    in order, and the number of the text that each is from."""
    clean = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), KEEP_CHARS_PATTERN, ""))
    words = pc.split_pattern(clean, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    words = words.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), row[some.to_numpy(zero_copy_only=False)]


def run_name(col, prefix: str | None = None, suffix: str = ".pkl") -> Column:
    """Run file name without its suffix (a suffix, not a character set),
    optionally prefixed with ``prefix.``."""
    pat = suffix.replace(".", "\\.") + "$"
    base = F.regexp_replace(_c(col), pat, "")
    return F.concat_ws(".", F.lit(prefix), base) if prefix else base


def tsv_safe(col) -> Column:
    """Text safe for a line-per-record TSV: tabs and line breaks become a
    space, null becomes empty."""
    return F.regexp_replace(F.coalesce(_c(col).cast("string"), F.lit("")), "[\t\r\n]", " ")
