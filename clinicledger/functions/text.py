"""String predicates with the reports' comparison rules.

The report database compares strings ignoring trailing blanks, and its
default collation ignores case. Spark compares exactly, so tests of codes and
names go through ``text_in`` / ``text_equals``, which name that collation;
pattern tests use ``lower``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: the report database's equality: neither case nor trailing blanks count
TEXT_COLLATION = "UTF8_LCASE_RTRIM"


def text_key(col: Column | str) -> Column:
    """``col`` under the report database's collation, for tests and join keys."""
    return F.collate(_col(col), TEXT_COLLATION)


def text_in(col: Column | str, values: Sequence[str]) -> Column:
    """``col IN (values)`` by the report database's rules; NULL gives NULL."""
    return text_key(col).isin(list(values))


def text_equals(col: Column | str, value: str) -> Column:
    """``col = value`` by the report database's rules. A value without
    letters has one spelling but for trailing blanks, so its prefix is tested
    too: that test, unlike a collated one, reaches the scan."""
    same = text_key(col) == F.lit(value)
    bare = value.rstrip(" ")
    if bare and bare.isascii() and not any(c.isalpha() for c in bare):
        return same & _col(col).startswith(bare)
    return same


def prefix_in(col: Column | str, n: int, values: Sequence[str]) -> Column:
    """``LEFT(col, n) IN (values)`` ignoring case and trailing blanks on both sides.

    ``'HCPC - BH visit'`` has the 10-character prefix ``'HCPC - BH '``, which
    equals ``'HCPC - BH'`` under trailing-blank-insensitive comparison.
    """
    return text_in(F.left(_col(col), F.lit(n)), values)


def contains_none(col: Column | str, substrings: Sequence[str], ignore_case: bool = True) -> Column:
    """``col NOT LIKE '%s1%' AND col NOT LIKE '%s2%' ...``.

    NULL ``col`` gives NULL, so a filter drops the row (as ``NOT LIKE`` does).
    """
    c = _col(col)
    if ignore_case:
        c = F.lower(c)
        substrings = [s.lower() for s in substrings]
    out = None
    for s in substrings:
        term = ~c.contains(F.lit(s))
        out = term if out is None else (out & term)
    return out if out is not None else F.lit(True)
