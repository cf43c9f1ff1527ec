"""Small column helpers shared by every stage."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace, letters and digits of a Unicode-aware regex engine, spelled out so
# that matching does not depend on the JVM's own idea of \s, \w and \b.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_NOT_NEWLINE = SPACE.replace(r"\n", "", 1)
WORD = r"\p{L}\p{N}_"
_SHORTHANDS = [
    (r"\b", rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"),
    (r"\w", rf"[{WORD}]"),
    (r"\s", rf"[{SPACE}]"),
    (r"\S", rf"[^{SPACE}]"),
    (r"\d", r"\p{Nd}"),
    (r"\D", r"\P{Nd}"),
]


def jvm_regex(pattern: str) -> str:
    """Spell out the shorthand classes of ``pattern`` for the JVM regex engine."""
    for shorthand, spelled in _SHORTHANDS:
        pattern = pattern.replace(shorthand, spelled)
    return pattern.replace("(?i)", "(?iu)")


_SAVED: dict = {}


def saved_column(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function builds, per JVM and arguments.

    Columns are unresolved expressions, free to use in any number of queries.
    Large ones take thousands of calls into the JVM to put together, so the
    stages build theirs once per process.
    """
    @wraps(build)
    def saved(*args) -> Column:
        key = (id(SparkContext._gateway), build.__module__, build.__qualname__, args)
        if key not in _SAVED:
            _SAVED[key] = build(*args)
        return _SAVED[key]

    return saved


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Column expressions are trees: naming a sub-expression twice evaluates it
    twice, and the optimizer may inline a projected column into a lambda that
    runs per element. A fold over no elements is an explicit binding: its start
    is the value and its finish the body. A one-element ``transform`` would
    copy the result and derive its type again for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row, whatever uses it.

    The optimizer copies a projected expression into filters it pushes down and
    into later projections. A generator is a boundary it does not cross. What it
    generates is projected first: generators evaluate their own expressions
    without generated code, and derive their types for every row. An outer
    generator, as a filter on the array would be inferred for the other kind.
    """
    held = f"__{name}"
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, F.array(value).alias(held)).select(*kept, F.explode_outer(held).alias(name))


def exploded(df: DataFrame, elements: Column | str, *keep: str, position: str = "ordinal",
             element: str = "d") -> DataFrame:
    """``posexplode`` that does not filter on (and so recompute) the array first."""
    rows = df.select(*keep, F.posexplode_outer(elements).alias(position, element))
    return rows.filter(F.col(position).isNotNull())


def literal_sql(value) -> str:
    """SQL text of a constant: lists become arrays, dicts structs, tuples of pairs maps."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {literal_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(literal_sql, value)) + ")"
    if isinstance(value, tuple):
        return "map(" + ", ".join(f"{literal_sql(k)}, {literal_sql(v)}" for k, v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value) + "D" if isinstance(value, float) else str(value)


def constant(value) -> Column:
    """A constant array, struct or map, handed to Spark as one expression."""
    return F.expr(literal_sql(value))


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a constant table, null when absent."""
    return F.element_at(constant(tuple(table.items())), key)


def one_of(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points ``[start, end)`` of ``text``; both ends are clamped at zero."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(end - first, F.lit(0)))


BLOCK = 4096
_RUN = 256


def text_blocks(text: Column) -> Column:
    """The text as pieces of 4096 characters.

    ``substring`` walks a string from its start. Cutting many windows out of a
    long text goes through these pieces, so each cut walks two of them at most.
    """
    count = F.floor((F.length(text) - 1) / BLOCK).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count), lambda b: F.substring(text, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(pieces)


def slice_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """Like :func:`slice_text`, on the pieces of a text; ``end`` may lie beyond it."""
    first = F.greatest(start, F.lit(0))
    width = F.greatest(end - first, F.lit(0))
    block = F.floor(first / BLOCK).cast("int")
    count = F.when(width > 0, F.floor((first + width - 1) / BLOCK).cast("int") - block + 1).otherwise(F.lit(0))
    joined = F.substring(F.array_join(F.slice(blocks, block + 1, count), ""), first - block * BLOCK + 1, width)
    return F.when(F.size(blocks) == 1, F.substring(F.get(blocks, F.lit(0)), first + 1, width)).otherwise(joined)


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sum, maximum or the like of an integer array, inclusive.

    A fold that appends copies its array at every step. Runs of 256 are folded
    on their own and shifted by the running value of the runs before them, so
    the work stays close to linear in documents with very many spans.
    """
    none = F.array().cast("array<int>")

    def scan(values: Column) -> Column:
        return F.aggregate(values, none, lambda done, x: F.concat(done, F.array(F.when(
            F.size(done) > 0, combine(F.get(done, F.size(done) - 1), x)).otherwise(x))))

    def shifted(runs: Column) -> Column:
        lasts = scan(F.transform(runs, lambda run: F.get(run, F.size(run) - 1)))
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(lasts, 1, F.size(runs) - 1))
        return F.flatten(F.zip_with(runs, before, lambda run, last: F.transform(
            run, lambda x: F.when(last.isNull(), x).otherwise(combine(last, x)))))

    def cut(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(_RUN))
        runs = F.transform(starts, lambda at: scan(F.slice(values, at, F.lit(_RUN))))
        return F.when(F.size(values) <= 1, values).when(F.size(values) > _RUN, let(runs, shifted)).otherwise(scan(values))

    return let(numbers, cut)


def running_max(numbers: Column) -> Column:
    """Running maximum of an integer array; an array in order, as most are, is its own."""
    def rising(values: Column) -> Column:
        return F.forall(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.get(values, i) >= F.get(values, i - 1))

    return let(numbers, lambda values: F.when(F.size(values) <= 1, values).when(rising(values), values).otherwise(
        running(values, F.greatest)))


def _with_heads(keys: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(sorted, heads)``: elements ``(key, i)`` in the order of their keys, and for each the place of its first equal."""
    def heads(ordered: Column) -> Column:
        return running(F.transform(ordered, lambda s, j: F.when(
            (j > 0) & s["key"].eqNullSafe(F.get(ordered, j - 1)["key"]), F.lit(0)).otherwise(j)), F.greatest)

    ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
    return let(ordered, lambda o: let(F.struct(o.alias("sorted"), heads(o).alias("heads")), lambda b: body(b["sorted"], b["heads"])))


def first_alike(keys: Column) -> Column:
    """For each element of an array the index of the first element equal to it; nulls equal each other."""
    def firsts(ordered: Column, heads: Column) -> Column:
        placed = F.transform(ordered, lambda s, j: F.struct(s["i"].alias("i"), F.get(ordered, F.get(heads, j))["i"].alias("first")))
        return F.transform(F.array_sort(placed), lambda p: p["first"])

    return F.when(F.size(keys) == 1, F.array(F.lit(0))).otherwise(_with_heads(keys, firsts))


def rank_alike(keys: Column) -> Column:
    """For each element of an array its number, from 1, among the elements equal to it."""
    def ranks(ordered: Column, heads: Column) -> Column:
        placed = F.transform(ordered, lambda s, j: F.struct(s["i"].alias("i"), (j - F.get(heads, j) + 1).alias("rank")))
        return F.transform(F.array_sort(placed), lambda p: p["rank"])

    return F.when(F.size(keys) == 1, F.array(F.lit(1))).otherwise(_with_heads(keys, ranks))


def first_level(score: Column, floors: list[tuple[str, float]], lowest: str = "LOW") -> Column:
    """Name of the highest band whose floor ``score`` reaches."""
    level = F.lit(lowest)
    for name, floor in reversed(floors):
        level = F.when(score >= F.lit(floor), F.lit(name)).otherwise(level)
    return level


def exact_round(value: Column, places: int, bound: bool = False) -> Column:
    """Round a double half-to-even on its exact binary value.

    SQL ``round`` works on the shortest decimal text, which moves a value by one
    unit in the last place at apparent ties. The rounding direction is decided
    here from ``value * scale - (2k + 1)``, with the product's rounding error
    recovered by splitting ``value`` in two halves. ``bound`` tells that the value
    is a plain column, so that naming it several times costs nothing.
    """
    scale = 2.0 * 10**places

    def parts(v: Column) -> dict[str, Column]:
        return {"v": v, "h": v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v), "p": v * F.lit(scale),
                "k": F.floor(v * F.lit(10.0**places)).cast("double")}

    def decide(s: dict[str, Column] | Column) -> Column:
        error = (s["h"] * F.lit(scale) - s["p"]) + (s["v"] - s["h"]) * F.lit(scale)
        excess = (s["p"] - (s["k"] * F.lit(2.0) + F.lit(1.0))) + error
        up = (excess > 0) | ((excess == 0) & (s["k"] % F.lit(2.0) != 0))
        return (s["k"] + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(10.0**places)

    if bound:
        return decide(parts(value))
    return let(value, lambda v: let(F.struct(*[part.alias(name) for name, part in parts(v).items()]), decide))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(constant(words), lambda word: F.contains(text, word))


def words_of(text: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(rf"[^{SPACE}]"), F.lit(True))


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and, aligned, the ASCII digit of each."""
    digits = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def ascii_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits, other characters unchanged."""
    foreign, plain = _decimal_digits()
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, foreign, plain)).otherwise(text)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


@lru_cache(maxsize=1)
def inert_ranges() -> str:
    """Character-class body of long runs of characters NFKC can never change.

    A character is inert when it is its own normal form, has no combining class
    and never combines with a preceding character. Derived from the Unicode
    tables by rule; short runs are left out, so the class may only err towards
    normalizing text that did not need it.
    """
    composing = set()
    for code in range(sys.maxunicode + 1):
        if not 0xAC00 <= code <= 0xD7A3:
            composing.update(unicodedata.normalize("NFD", chr(code))[1:])
    composing.update(chr(c) for c in range(0x1161, 0x11C3))

    def inert(code: int) -> bool:
        char = chr(code)
        return (unicodedata.category(char) not in ("Cn", "Cs") and not unicodedata.combining(char)
                and char not in composing and unicodedata.is_normalized("NFKC", char))

    ranges, start = [], None
    for code in range(0x10000):
        if inert(code):
            start = code if start is None else start
        elif start is not None:
            if code - start >= (1 if start < 0x250 or 0x2010 <= start <= 0x2030 else 64):
                ranges.append((start, code - 1))
            start = None
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in ranges)
