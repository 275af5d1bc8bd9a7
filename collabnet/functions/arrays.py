"""Array helpers (F10-F18, F37, F41). Missing lists count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(c: Column, element: str = "string") -> Column:
    """Null list -> empty list."""
    return F.coalesce(c, F.array().cast(f"array<{element}>"))


def empty_to_null(c: Column) -> Column:
    """Empty list -> null."""
    return F.when(F.size(c) > 0, c)


def blank_to_null(c: Column) -> Column:
    """Empty string -> null."""
    return F.nullif(c, F.lit(""))


def drop_nulls(c: Column, element: str = "string") -> Column:
    """List without its nulls; a null list gives an empty one."""
    return F.array_compact(or_empty(c, element))


def concat_distinct(*cols: Column) -> Column:
    """Distinct non-null elements of several lists, in order."""
    return F.array_distinct(F.array_compact(F.concat(*[or_empty(c) for c in cols])))


def flatten_distinct(c: Column) -> Column:
    """Distinct elements of a list of lists (F13); null inner lists are skipped."""
    return F.array_distinct(F.flatten(F.filter(c, lambda x: x.isNotNull())))


def lower_distinct(c: Column) -> Column:
    """Distinct lower-cased elements."""
    return F.array_distinct(F.transform(c, F.lower))


def head(c: Column) -> Column:
    """First element or null."""
    return F.get(c, F.lit(0))


def tail(c: Column) -> Column:
    """All but the first element; null unless there are at least two."""
    return F.when(F.size(c) > 1, F.slice(c, 2, F.size(c)))


def longer(a: Column, b: Column) -> Column:
    """The longer list; on equal length the second; null counts as shorter than empty."""
    return F.when(F.coalesce(F.size(a), F.lit(-1)) > F.coalesce(F.size(b), F.lit(-1)), a).otherwise(b)


def split_roles(c: Column) -> Column:
    """Comma-separated roles -> trimmed non-empty list; null -> empty."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda r: F.trim(r))
    return F.filter(parts, lambda r: r != "")


def sum_or_one(c: Column) -> Column:
    """Sum of the non-null elements, 1 if there are none."""
    kept = F.array_compact(c)
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.size(kept) == 0, F.lit(1).cast("bigint")).otherwise(total)


def as_list(c: Column) -> Column:
    """Scalar -> one-element list, null -> empty list."""
    return F.array_compact(F.array(c))


def tagged(lists: dict[str, Column]) -> Column:
    """All elements of several lists as one list of (list, value), for one explode."""

    def tag(name: str, c: Column) -> Column:
        return F.transform(or_empty(c), lambda x: F.struct(F.lit(name).alias("list"), x.alias("value")))

    return F.concat(*[tag(name, c) for name, c in lists.items()])
