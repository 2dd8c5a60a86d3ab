"""Conditions as a tree in prefix notation, and scopes below a row of a hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import condition
from . import lookup

#: A condition (field, operator, value), or one of the operators & and | (two terms follow) and ! (one follows).
Term = tuple[str, str, object] | str
#: The rows of a hierarchy, their key and the column with the key of the row above.
Hierarchy = tuple[DataFrame, str, str]


def _read(terms: Sequence[Term], at: int, leaf) -> tuple[Column, int]:
    """The term that begins at a place, as a column, and the place after it."""
    if at >= len(terms):
        raise ValueError("an operator lacks a term")
    term = terms[at]
    if term in ("&", "|"):
        a, at = _read(terms, at + 1, leaf)
        b, at = _read(terms, at, leaf)
        return (a & b if term == "&" else a | b), at
    if term == "!":
        a, at = _read(terms, at + 1, leaf)
        return ~a, at
    if isinstance(term, str) or len(term) != 3:
        raise ValueError(f"no condition and no operator: {term!r}")
    return leaf(*term), at + 1


def column(terms: Sequence[Term], leaf=condition) -> Column:
    """All terms as one condition; terms that no operator joins must all hold, and no terms hold always.

    A comparison with null holds neither as it is nor under '!', but for =, !=, in and not in, which tell null from values.
    """
    made, at = None, 0
    while at < len(terms):
        one, at = _read(terms, at, leaf)
        made = one if made is None else made & one
    return F.lit(True) if made is None else made


def matching(df: DataFrame, terms: Sequence[Term], hierarchies: Mapping[str, Hierarchy] | None = None) -> DataFrame:
    """The rows of df that satisfy the tree; filters without child_of reach the files.

    (field, 'child_of', key or keys) holds where the field's value is one of the keys or lies below one in the field's
    hierarchy, at any depth; each such scope is found once and joined by its distinct keys.
    """
    columns, scopes = df.columns, []

    def leaf(field: str, operator: str, value: object) -> Column:
        if operator != "child_of":
            return condition(field, operator, value)
        nodes, key, parent = (hierarchies or {})[field]
        kind = dict(nodes.dtypes)[key]
        roots = df.sparkSession.createDataFrame([(v,) for v in (value if isinstance(value, (list, tuple, set)) else [value])], f"k {kind}")
        mark = f"__below{len(scopes)}"
        scopes.append((field, lookup.below(nodes, key, parent, roots, "k").select(F.col(key).alias(f"{mark}k"), F.lit(True).alias(mark)), mark))
        return F.coalesce(F.col(mark), F.lit(False))

    where = column(terms, leaf)
    for field, keys, mark in scopes:
        df = df.join(keys, F.col(field) == F.col(f"{mark}k"), "left")
    return df.where(where).select(*columns)
