"""Text column functions with Python's notion of blanks, plus Unicode composition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove blanks (Unicode ones too) at both ends; the built-in trim knows the space only."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Blank-separated tokens; none for a blank text."""
    return F.filter(F.split(c, rf"(?U){BLANK}+"), lambda t: t != "")


def words(c: Column) -> Column:
    """Words of a label in a blank-joined line: runs of two or more blanks of any kind part words, and so does a single space."""
    padded = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), rf"(?U){BLANK}{{2,}}", " ")
    return F.filter(F.split(padded, " "), lambda w: w != "")


def words_of(label: str) -> list[str]:
    """:func:`words` of a plain string."""
    return [w for w in re.sub(r"\s\s+", " ", f" {label} ").split(" ") if w]


def may_split(c: Column) -> Column:
    """False for labels that surely are one word."""
    return c.rlike(rf"(?U){BLANK}") | (c == "")


@arrow_udf(T.StructType([T.StructField("nfc", T.StringType()), T.StructField("marks", T.StringType())]))
def compose(label: pa.Array) -> pa.Array:
    """NFC form of a label and the distinct combining marks in it.

    Spark has no function for either. Each distinct label of a batch is handled once.
    """
    coded = label.dictionary_encode()
    nfc = [unicodedata.normalize("NFC", s) for s in coded.dictionary.to_pylist()]
    marks = ["".join(sorted({c for c in s if unicodedata.combining(c)})) for s in nfc]
    table = pa.StructArray.from_arrays([pa.array(nfc, pa.string()), pa.array(marks, pa.string())], ["nfc", "marks"])
    return table.take(coded.indices)


def only_marks(c: Column, marks: Column) -> Column:
    """True for a non-empty text made of combining marks alone."""
    return (c != "") & (F.call_function("translate", c, marks, F.lit("")) == "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Plain projections get merged, which would paste a costly expression into every lambda that mentions
    it; a generator of one row is not merged.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(one)))
