"""k-anonymity: the least generalization under which every record shares its quasi-identifiers with k - 1 others.

Each quasi-identifier has a hierarchy of ever coarser forms. A node of the lattice gives every column a level; all rows with equal
generalized values are one class, and rows of classes below ``k`` are suppressed. More generalization merges classes, so the number of
suppressed rows never grows upwards: a node that suppresses few enough rows settles all nodes above it, one that suppresses too many
all nodes below. Of the nodes that are few enough the one with the least loss is taken.

The table is grouped once, by all values as they are; nodes are counted on these groups, several in one job as grouping sets. Heights of the
lattice are taken from the middle, so that most nodes are settled without being counted.

Nulls: a null is a value like any other, stays null up to the level before the last, and shares classes with nulls. Empty tables give empty results at the
lowest levels. Repeated rows count as records. Columns other than the quasi-identifiers are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anonymize
from ..functions.text import digits_only, let, lookup
from .lineage import checkpointed

K, HIDDEN, TOGETHER, MOST_COLUMNS = 5, "*", 16, 60
Level = Callable[[Column], Column]


def _plain(value: Column) -> Column:
    return value.cast("string")


def _hidden(_value: Column) -> Column:
    return F.lit(HIDDEN)


def _decade(value: Column) -> Column:
    return let(anonymize.ascii_digits(digits_only(value)), lambda d: F.when(d == "", F.lit("[AGE_RANGE]")).otherwise(
        F.concat(F.regexp_replace(F.left(d, F.length(d) - 1), "^0+", ""), F.lit("0s"))))


def _year(value: Column) -> Column:
    return let(F.split(value, r"[/\-.]", -1), lambda p: F.when(
        F.size(p) == 3, F.when(F.length(p[2]) == 4, p[2]).when(F.length(p[0]) == 4, p[0])
        .otherwise(F.concat(F.lit("XX/XX/"), p[2]))).otherwise(F.lit("[DATE_GENERALIZED]")))


def _digits_kept(short: int, enough: int, masked: str, instead: str) -> Level:
    return lambda value: let(digits_only(value), lambda d: F.when(
        F.length(d) >= enough, F.concat(F.left(d, F.lit(short)), F.lit(masked))).otherwise(F.lit(instead)))


# How the values of an identifier type are generalized, from the value itself to nothing of it. Every level is a function of the one before.
_REGION = (_plain, anonymize.generalize_region, _hidden)
_DATE = (_plain, anonymize.generalize_date, _year, _hidden)
RULES: dict[str, tuple[Level, ...]] = {
    "AGE": (_plain, anonymize.generalize_age, _decade, _hidden),
    "PINCODE": (_plain, anonymize.generalize_pincode, _digits_kept(2, 4, "XXXX", "[PIN_GENERALIZED]"), _hidden),
    "DATE": _DATE,
    "DATE_OF_BIRTH": _DATE,
    "PHONE": (_plain, anonymize.generalize_phone, _digits_kept(2, 10, "XXXXXXXX", "[PHONE_GENERALIZED]"), _hidden),
    "LOCATION": _REGION,
    "ADDRESS": _REGION,
    "GENDER": (_plain, _hidden),
}
DEFAULT_RULE: tuple[Level, ...] = (_plain, anonymize.generalize_default, _hidden)


@dataclass(frozen=True)
class Hierarchy:
    """A quasi-identifier column and its forms; ``weight`` scales what its generalization costs."""

    column: str
    levels: tuple[Level, ...]
    weight: float = 1.0


def of_type(column: str, entity_type: str, weight: float = 1.0) -> Hierarchy:
    """The hierarchy of a column that holds values of an identifier type."""
    return Hierarchy(column, RULES.get(entity_type, DEFAULT_RULE), weight)


def number_bands(column: str, widths: list[int], weight: float = 1.0) -> Hierarchy:
    """Numbers, then intervals of growing width; every width divides the next."""
    if any(w <= 0 for w in widths) or any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("every width must divide the next")

    def band(width: int) -> Level:
        return lambda v: let(F.floor(v / width) * width, lambda low: F.when(v.isNotNull(), F.concat(
            low.cast("string"), F.lit(" to "), (low + width).cast("string"))))

    return Hierarchy(column, (_plain, *(band(w) for w in widths), _hidden), weight)


def by_parents(column: str, parents: list[dict[str, str]], weight: float = 1.0) -> Hierarchy:
    """Values, then their parents by rule tables (value to parent, parent to grandparent); a value without a parent is hidden."""
    def climb(steps: int) -> Level:
        def level(value: Column) -> Column:
            out = _plain(value)
            for table in parents[:steps]:
                out = F.when(out.isNotNull(), F.coalesce(lookup(table, out), F.lit(HIDDEN)))
            return out
        return level

    return Hierarchy(column, (_plain, *(climb(i + 1) for i in range(len(parents))), _hidden), weight)


def on_lists(column: str, levels: tuple[Level, ...], weight: float = 1.0) -> Hierarchy:
    """The hierarchy for a column of lists: the distinct generalized values in order, null where there are none."""
    def each(level: Level) -> Level:
        return lambda values: F.when(F.size(values) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(values, level))), "|"))

    return Hierarchy(column, (*(each(level) for level in levels[:-1]), _hidden), weight)


@dataclass(frozen=True)
class KAnonymous:
    """``rows`` to publish, the chosen ``levels`` by column, the number of ``suppressed`` rows, and their generalized values (``small``)."""

    rows: DataFrame
    levels: dict[str, int]
    suppressed: int
    small: DataFrame


class Lattice:
    """Counts of suppressed rows for the nodes of the generalization lattice of a table."""

    def __init__(self, df: DataFrame, hierarchies: list[Hierarchy], k: int) -> None:
        self.hierarchies, self.k, self.counted = hierarchies, k, 0
        if sum(len(h.levels) for h in hierarchies) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} levels in all")
        whole = df.groupBy(*(F.col(h.column).alias(f"q{i}") for i, h in enumerate(hierarchies))).agg(F.count("*").alias("n"))
        forms = [level(F.col(f"q{i}")).alias(f"q{i}_{j}") for i, h in enumerate(hierarchies) for j, level in enumerate(h.levels)]
        self.base = checkpointed(whole.select("n", *forms))  # by all values as they are; every level beside them
        self.rows = self.base.agg(F.sum("n")).first()[0] or 0
        self.nodes = list(product(*(range(len(h.levels)) for h in hierarchies)))

    def names(self, node: tuple[int, ...]) -> list[str]:
        return [f"q{i}_{j}" for i, j in enumerate(node)]

    def loss(self, node: tuple[int, ...]) -> float:
        return sum(h.weight * j / max(1, len(h.levels) - 1) for h, j in zip(self.hierarchies, node))

    def suppressed(self, nodes: list[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
        """Rows in classes below k for each node; up to ``TOGETHER`` nodes in one job."""
        out = {}
        for at in range(0, len(nodes), TOGETHER):
            part = nodes[at:at + TOGETHER]
            used = sorted({c for node in part for c in self.names(node)})
            place = {c: 1 << (len(used) - 1 - i) for i, c in enumerate(used)}
            sets = self.base.groupingSets([[F.col(c) for c in self.names(node)] for node in part], *(F.col(c) for c in used))
            classes = sets.agg(F.grouping_id().alias("node"), F.sum("n").alias("n"))
            lost = F.sum(F.when(F.col("n") < self.k, F.col("n")).otherwise(0)).alias("lost")
            found = {r.node: r.lost for r in classes.groupBy("node").agg(lost).collect()}  # one row a node
            for node in part:
                mark = sum(bit for c, bit in place.items() if c not in self.names(node))
                out[node] = found.get(mark, 0)
            self.counted += len(part)
        return out

    def least(self, limit: int) -> tuple[int, ...]:
        """The node with the least loss that suppresses ``limit`` rows at most; of equals the one with fewest, then the lowest levels."""
        few, many = set(), set()
        by_height: dict[int, list] = {}
        for node in self.nodes:
            by_height.setdefault(sum(node), []).append(node)

        def settle(low: int, high: int) -> None:
            if low > high:
                return
            middle = (low + high) // 2
            unknown = [n for n in by_height[middle] if n not in few and n not in many]
            for node, lost in self.suppressed(unknown).items():
                if lost <= limit:
                    few.update(n for n in self.nodes if all(a >= b for a, b in zip(n, node)))
                else:
                    many.update(n for n in self.nodes if all(a <= b for a, b in zip(n, node)))
            settle(low, middle - 1)
            settle(middle + 1, high)

        settle(0, max(by_height))
        if not few:
            return self.nodes[-1]
        least = min(self.loss(n) for n in few)
        equals = sorted(n for n in few if self.loss(n) <= least + 1e-12)
        lost = self.suppressed(equals) if len(equals) > 1 else {equals[0]: 0}
        return min(equals, key=lambda n: (lost[n], n))


def k_anonymize(df: DataFrame, hierarchies: list[Hierarchy], k: int = K, max_suppressed: float = 0.0) -> KAnonymous:
    """``df`` with its quasi-identifiers generalized as little as possible so that every class has ``k`` rows.

    At most the share ``max_suppressed`` of the rows is left out for it. Where even hidden values cannot make classes of ``k`` (a table with fewer
    rows), all rows are left out. ``small`` gives the generalized values of what was left out, with row counts.
    """
    lattice = Lattice(df, hierarchies, k)
    node = lattice.least(int(max_suppressed * lattice.rows))
    columns = [h.column for h in hierarchies]
    named = [F.col(c).alias(h.column) for c, h in zip(lattice.names(node), hierarchies)]
    small = checkpointed(lattice.base.groupBy(*named).agg(F.sum("n").alias("n")).filter(F.col("n") < k))
    suppressed = small.agg(F.sum("n")).first()[0] or 0
    chosen = {h.column: h.levels[j](F.col(h.column)) for h, j in zip(hierarchies, node)}
    rows = df.withColumns(chosen)
    if suppressed:  # few rows, so the planner keeps the table where it is
        left_out = small.select(*(F.col(c).alias(f"_small_{c}") for c in columns))
        same = [F.col(c).eqNullSafe(F.col(f"_small_{c}")) for c in columns]
        rows = rows.join(left_out, on=same, how="left_anti")
    return KAnonymous(rows, dict(zip(columns, node)), suppressed, small)


def document_records(spans: DataFrame, types: list[str]) -> DataFrame:
    """One record per document: ``doc_id`` and, for each type, the distinct values the document has."""
    return spans.filter(F.col("entity_type").isin(*types)).groupBy("doc_id").agg(
        *(F.collect_set(F.when(F.col("entity_type") == t, F.col("value"))).alias(t) for t in types))


def k_anonymize_spans(spans: DataFrame, types: list[str], k: int = K, max_suppressed: float = 0.0) -> tuple[DataFrame, dict[str, int]]:
    """Spans ``(doc_id, value, entity_type, ...)`` with ``replacement``, and the level of each type.

    A record is a document with one of the ``types`` at least; afterwards ``k`` documents share all its quasi-identifiers, whichever
    of the values in it a reader looks at. Documents left out have these values redacted; spans of other types have a null replacement.
    """
    records = checkpointed(document_records(spans, types))
    hierarchies = [on_lists(t, RULES.get(t, DEFAULT_RULE)) for t in types]
    found = k_anonymize(records, hierarchies, k, max_suppressed)
    kind, value = F.col("entity_type"), F.col("value")
    generalized = F.lit(None).cast("string")
    for t in types:
        levels = RULES.get(t, DEFAULT_RULE)
        generalized = F.when(kind == t, levels[found.levels[t]](value)).otherwise(generalized)
    if not found.suppressed:
        return spans.withColumn("replacement", generalized), found.levels
    kept = found.rows.select("doc_id", F.lit(True).alias("_published"))
    joined = spans.join(kept, "doc_id", "left")
    redacted = F.when(kind.isin(*types), anonymize.redact(kind))
    return joined.withColumn("replacement", F.when(F.col("_published"), generalized).otherwise(redacted)).drop("_published"), found.levels
