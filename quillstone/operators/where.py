"""Filter syntax trees compiled to columns: ``$and``, ``$or``, ``$eq``, ``$ne``, ``$in``, ``$nin`` and bare equality.

Both legs of retrieval use the same compiled filter. A missing field is null: ``$eq`` fails on it, ``$ne`` and
``$nin`` hold. Unknown operators raise ValueError rather than being ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("$eq", "$ne", "$in", "$nin")


def build(type_: str | None = None, pmid: str | None = None, raw: dict | None = None) -> dict | None:
    """The filter of the shorthands; a raw one replaces them."""
    if raw is not None:
        return raw
    clauses = [{k: v} for k, v in (("type", type_), ("pmid", pmid)) if v]
    return both(*clauses)


def both(*clauses: dict | None) -> dict | None:
    """All clauses that there are, by ``$and`` if several."""
    given = [c for c in clauses if c]
    return None if not given else given[0] if len(given) == 1 else {"$and": given}


def _test(c: Column, op: str, want) -> Column:
    if op in ("$eq", "$ne"):
        same = F.equal_null(c, F.lit(want))
        return same if op == "$eq" else ~same
    if op in ("$in", "$nin"):
        named = [v for v in want if v is not None]
        among = F.coalesce(c.isin(named), F.lit(False)) if named else F.lit(False)
        if None in want:
            among = among | c.isNull()
        return among if op == "$in" else ~among
    raise ValueError(f"unknown filter operator {op}")


def compile_where(tree: dict | None, columns: list[str]) -> Column:
    """The filter as a column; fields that aren't columns are missing in every row."""
    if not tree:
        return F.lit(True)
    for key, join, none in (("$and", lambda a, b: a & b, True), ("$or", lambda a, b: a | b, False)):
        if key in tree:
            return reduce(join, [compile_where(t, columns) for t in tree[key]], F.lit(none))
    tests = []
    for name, condition in tree.items():
        c = F.col(name) if name in columns else F.lit(None).cast("string")
        if isinstance(condition, dict):
            tests += [_test(c, op, want) for op, want in condition.items()]
        else:
            tests.append(F.coalesce(c.cast("string"), F.lit("None")) == str(condition))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
