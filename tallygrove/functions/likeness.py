"""How alike two names are: twice the longest common subsequence over both lengths.

In Python for header lists, which are few and mapped on the driver; as a column
expression for names in tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    """0..100; 100 for equal names."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter name with a part of the longer one that is as long, or shorter at its ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def likeness(a: Column, b: Column) -> Column:
    """ratio() of two columns of names, 0..1."""

    def row(above: Column, x: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            best = F.when(F.substr(b, j, F.lit(1)) == x, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(new, j - 1)))
            return F.concat(new, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    letters = F.filter(F.split(a, ""), lambda c: c != "")
    common = F.element_at(F.aggregate(letters, F.array_repeat(F.lit(0), F.length(b) + 1), row), -1)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(2.0 * common / (F.length(a) + F.length(b)))
