"""Clipped n-gram counts of two token arrays, inside one row.

A predicted and a reference text stand in the same row, so their n-grams can be
compared there: nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaprep.functions.bind import bind


def _repeats(grams: Column) -> Column:
    """The grams without one occurrence of each distinct gram."""
    return bind(
        F.sort_array(grams),
        lambda ordered: F.filter(ordered, lambda g, i: g == F.get(ordered, i - 1)),
    )


def _shared(left: Column, right: Column) -> Column:
    """Size of the multiset intersection, by one pass over the sorted union."""

    def tagged(grams: Column, side: int) -> Column:
        return F.transform(
            grams, lambda g: F.struct(g.alias("gram"), F.lit(side).alias("side"))
        )

    def step(state: Column, entry: Column) -> Column:
        same = state["gram"] == entry["gram"]
        open_left = F.when(same, state["open"]).otherwise(0)
        matched = same & (entry["side"] == 1) & (state["open"] > 0)
        return F.struct(
            entry["gram"].alias("gram"),
            (open_left + 1 - 2 * entry["side"]).alias("open"),
            (state["shared"] + matched.cast("int")).alias("shared"),
        )

    start = F.struct(
        F.lit("").alias("gram"), F.lit(0).alias("open"), F.lit(0).alias("shared")
    )
    union = F.sort_array(F.concat(tagged(left, 0), tagged(right, 1)))
    return F.aggregate(union, start, step, lambda state: state["shared"])


def clipped_each(
    pairs: Sequence[tuple[Column, Column]],
    body: Callable[[Column, Column, Column], Column] = lambda matches, left, right: matches,
) -> Column:
    """For each pair of gram arrays, `body(matches, left, right)`, as an array.

    The matches are the sum over grams of the smaller of the two counts. The
    distinct grams in common come from the fast hash-based built-in. Only the
    repeats, usually few, go through the slower counting pass.
    """

    def one(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        distinct = F.size(F.array_intersect(left, right))
        matches = distinct + _shared(_repeats(left), _repeats(right))
        return bind(matches, lambda m: body(m, left, right))

    given = [F.struct(a.alias("left"), b.alias("right")) for a, b in pairs]
    return F.transform(F.array(*given), one)


def clipped_matches(left: Column, right: Column) -> Column:
    """Sum over grams of the smaller of the two counts."""
    return F.get(clipped_each([(left, right)]), F.lit(0))
