"""String similarity as Column expressions.

``ratio`` is 200 * LCS(a, b) / (|a| + |b|), the normalised insert-delete ratio.  The
longest common subsequence is a fold over the characters of one string that
carries one row of the table, so it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import text


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    chars_b = F.transform(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda j: F.substring(b, j, F.lit(1)))
    chars_a = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)))

    def next_row(row: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            hit = F.element_at(chars_b, j) == ch
            value = F.when(hit, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j)))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(chars_a, start, next_row), -1))


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when(a == b, 100.0).otherwise(200.0 * lcs(a, b) / total)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """A cheap test that every pair with that ratio passes.

    The shorter length bounds the common subsequence, and the edit distance is at
    most the insert-delete distance that the ratio allows.
    """
    total = F.length(a) + F.length(b)
    return (200.0 * F.least(F.length(a), F.length(b)) >= threshold * total) & (F.levenshtein(a, b) <= (1 - threshold / 100.0) * total + 1e-9)


def ratio_from(a: Column, b: Column, threshold: float) -> Column:
    """The ratio, null where the cheap test already shows it below the threshold.

    The test lies inside the expression, so it comes first wherever the optimizer
    moves a filter on the ratio.
    """
    return F.when(may_reach(a, b, threshold), ratio(a, b))


def token_ratio(a: Column, b: Column) -> Column:
    ordered = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    return ratio(ordered(a), ordered(b))


def _within(short: Column, long: Column) -> Column:
    size = F.length(short)
    stretches = F.transform(F.sequence(F.lit(1), F.length(long) - size + 1), lambda i: F.substring(long, i, size))
    ends = F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(long, F.lit(1), n))
    ends = F.concat(ends, F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(long, F.length(long) - n + 1, n)))
    return F.array_max(F.transform(F.array_distinct(F.concat(stretches, ends)), lambda x: ratio(short, x)))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a stretch of the longer one; of equally long ones either way.

    A stretch has the shorter string's length, or lies at an end of the longer one and
    is shorter than that.
    """
    n, m = F.length(a), F.length(b)
    found = F.when(n < m, _within(a, b)).when(n > m, _within(b, a)).otherwise(F.greatest(_within(a, b), _within(b, a)))
    return F.when(a == b, 100.0).when((n == 0) | (m == 0), 0.0).otherwise(found)


def best_ratio(a: Column, b: Column) -> Column:
    """The best of the three scores of strings that are normalised already."""
    return F.greatest(ratio(a, b), token_ratio(a, b), partial_ratio(a, b))


def best_of(a: Column, b: Column) -> Column:
    """The best of the three scores of two strings as they are written."""
    return text.let(F.struct(text.fuzzy_key(a).alias("a"), text.fuzzy_key(b).alias("b")), lambda k: best_ratio(k["a"], k["b"]))


def is_match(a: Column, b: Column, threshold: float = 85) -> Column:
    """Whether two strings as they are written are alike; one that normalises to nothing matches only its like."""
    keys = F.struct(text.fuzzy_key(a).alias("a"), text.fuzzy_key(b).alias("b"))
    return text.let(keys, lambda k: F.when((k["a"] == "") | (k["b"] == ""), k["a"] == k["b"]).otherwise(best_ratio(k["a"], k["b"]) >= threshold))
