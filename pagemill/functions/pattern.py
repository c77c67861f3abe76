"""Regular expressions with one meaning for Unicode text, whatever the engine's defaults.

Patterns are written for Unicode classes (``\\w``, ``\\d``, ``\\s``, ``\\b``) and line feeds only; ``unicode`` adds the flags that
make Spark's Java engine read them so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode(pattern: str) -> str:
    """``pattern`` with Unicode character classes and ``\\n`` as the only line terminator."""
    return f"(?Ud){pattern}"


def found(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs anywhere in ``text``."""
    return text.rlike(unicode(pattern))


def whole(text: Column, pattern: str) -> Column:
    """Whether all of ``text`` is one match of ``pattern``."""
    return text.rlike(unicode(rf"\A(?:{pattern})\z"))


def starts(text: Column, pattern: str) -> Column:
    return text.rlike(unicode(rf"\A(?:{pattern})"))


def group(text: Column, pattern: str, index: int = 0) -> Column:
    """Group ``index`` of the first match, or null."""
    return F.when(found(text, pattern), F.regexp_extract(text, unicode(pattern), index))


def groups(text: Column, pattern: str, index: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(index))


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(unicode(pattern))), F.lit(0))


def stripped(text: Column) -> Column:
    """``text`` without Unicode white space at its ends."""
    return F.regexp_replace(text, unicode(r"\A\s+|\s+\z"), "")


def compact(text: Column) -> Column:
    """``text`` without any Unicode white space."""
    return F.regexp_replace(text, unicode(r"\s+"), "")
