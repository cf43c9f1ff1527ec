"""Text cleaning: normal form, scan artefacts, whitespace, control characters."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, SPACE_NOT_NEWLINE, inert_ranges, slice_text, strip

_DIGIT = r"\p{Nd}"
_CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
_LOOSE_SPACE = rf"[{SPACE_NOT_NEWLINE.replace(' ', '', 1)}][{SPACE_NOT_NEWLINE}]*| [{SPACE_NOT_NEWLINE}]+"


@F.arrow_udf(T.StringType())
def _to_nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()],
                    type=pa.string())


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only rows holding a character that could change leave the JVM."""
    may_change = _beyond_ascii(text) & text.rlike(rf"[^\x00-\x7f](?<![{inert_ranges()}])")
    return F.coalesce(_to_nfkc(F.when(may_change, text)), text)


def fix_ocr(text: Column) -> Column:
    """Letters read in place of digits, only between two digits."""
    zeros = F.regexp_replace(text, rf"(?<={_DIGIT})[Ol](?={_DIGIT})", "0")
    return F.regexp_replace(zeros, rf"(?<={_DIGIT})I(?={_DIGIT})", "1")


def normalize_ws(text: Column) -> Column:
    """Runs of non-newline whitespace become one space, 3+ newlines become two."""
    return F.regexp_replace(F.regexp_replace(text, _LOOSE_SPACE, " "), r"\n{3,}", "\n\n")


def collapse_ws(text: Column) -> Column:
    """Every whitespace run, newlines included, becomes one space."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_CONTROL}]", "")


def strip_text(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def needs_cleaning(text: Column, preserve_structure: bool = True) -> Column:
    """Cheap test for anything the cleaning steps would change (may say yes too often).

    Plain prose passes a few substring tests and two small pattern scans, and is
    kept as it is.
    """
    edge = F.lit(False)
    for blank in (" ", "\n"):
        edge = edge | F.startswith(text, F.lit(blank)) | F.endswith(text, F.lit(blank))
    lines = F.lit("\n\n\n") if preserve_structure else F.lit("\n")
    foreign_space = _beyond_ascii(text) & text.rlike(rf"[^\x00-\x7f](?<=[{SPACE}])")
    return (F.contains(text, F.lit("  ")) | F.contains(text, lines) | edge
            | text.rlike(r"[\x00-\x09\x0b-\x1f\x7f]") | text.rlike(rf"{_DIGIT}[OlI]{_DIGIT}") | foreign_space)


def clean_text(text: Column, preserve_structure: bool = True, normal_form: bool = True) -> Column:
    """All cleaning steps in order; null becomes the empty string.

    ``normal_form=False`` skips NFKC, for input known to be normalized already.
    """
    spaced = normalize_ws if preserve_structure else collapse_ws

    def steps(normal: Column) -> Column:
        fixed = strip(strip_control(spaced(fix_ocr(normal))))
        return F.coalesce(F.when(needs_cleaning(normal, preserve_structure), fixed).otherwise(normal), F.lit(""))

    return steps(nfkc(text) if normal_form else text)


def split_sentences(text: Column) -> Column:
    pieces = F.split(text, rf"(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(pieces, strip), lambda s: s != F.lit(""))


def char_window(text: Column, position: Column, reach: int = 50) -> Column:
    return slice_text(text, position - reach, position + reach)
