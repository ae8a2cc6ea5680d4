"""Bitmap indexes of rows: filters answered by bits, as filters of ranking and as counts of facets, without the rows.

Rows are known by a whole number, the key. 64 neighbouring keys are a word; for each value of a field and each word in which it occurs, one row holds
their bits. So a frequent value takes 16 bytes for 64 rows before Parquet packs them, a rare one no more than a list of its keys would. The empty field
holds the bits of all rows, which ``$ne`` and ``$nin`` need. A filter reads its own values' words, in one aggregation by word for any
number of filters, which combines them in the task that reads them first; what is then shuffled is words, not rows.

Values are compared as text. A list is in the bits of each of its values; a null, an empty list and a field that the index doesn't have
count as missing, as in ``where``. Rows with a null key can't be found. Rows that share a key are one row with the values of all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillstone.operators.where import OPERATORS

#: The field that all rows have.
ALL = ""


def entries(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of rows, made within each row; a missing value is null."""
    lists = {f for f in fields if isinstance(rows.schema[f].dataType, ArrayType)}
    none = F.array(F.lit(None).cast("string"))
    values = lambda f: F.when(F.size(f) > 0, F.array_distinct(F.col(f).cast("array<string>"))).otherwise(none) if f in lists else F.array(F.col(f).cast("string"))
    named = lambda f: F.transform(values(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    every = F.array(F.struct(F.lit(ALL).alias("field"), F.lit(None).cast("string").alias("value")))
    return rows.select(F.col(key).cast("long").alias("key"), F.explode(F.concat(every, *map(named, fields))).alias("x")).select("key", "x.field", "x.value")


def words(of: DataFrame) -> DataFrame:
    """(field, value, word, bits) of entries (key, field, value)."""
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    return of.where("key IS NOT NULL").groupBy("field", "value", F.shiftright("key", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def write_bitmaps(of: DataFrame, path: str) -> DataFrame:
    """Stores the words of entries in order of field, value and word, so that a reader skips all but its values' and a value of any size is spread over files."""
    words(of).repartitionByRange("field", "value", "word").sortWithinPartitions("field", "value", "word").write.parquet(path)
    return read_bitmaps(of.sparkSession, path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _test(field: str, op: str, want, among: Callable[[str, list], Column]) -> Column:
    """The bits of the rows that meet one condition; ``among`` gives those that have any of some values (texts, or None for a missing one)."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    if op in ("$eq", "$ne"):
        want = [want]
    elif op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op}")
    held = among(field, [text(v) for v in want])
    return held if op in ("$eq", "$in") else F.col("every").bitwiseAND(F.bitwise_not(held))


def compile_bits(tree: dict | None, among: Callable[[str, list], Column]) -> Column:
    """The filter, with the meaning that ``where.compile_where`` gives it, as bits of a word."""
    every, both, either = F.col("every"), lambda a, b: a.bitwiseAND(b), lambda a, b: a.bitwiseOR(b)
    if not tree:
        return every
    if "$and" in tree:
        return reduce(both, [compile_bits(t, among) for t in tree["$and"]], every)
    if "$or" in tree:
        return reduce(either, [compile_bits(t, among) for t in tree["$or"]], F.lit(0).cast("long"))
    tests = []
    for field, condition in tree.items():
        if isinstance(condition, dict):
            tests += [_test(field, op, want, among) for op, want in condition.items()]
        else:  # bare equality reads a missing value as "None"
            tests.append(among(field, ["None", None] if str(condition) == "None" else [str(condition)]))
    return reduce(both, tests, every)


def select_all(index: DataFrame, filters: dict[str, dict | None], fields: list[str]) -> DataFrame:
    """(word, and a column of bits for each filter): the rows that meet each filter, all from one pass. ``fields``: those that the index has."""
    asked: list[Column] = []

    def any_of(field: str, values: list) -> Column:
        if field not in fields:  # missing in every row
            return F.col("every") if None in values else F.lit(0).cast("long")
        named = [v for v in values if v is not None]
        tests = [F.col("value").isin(named)] * bool(named) + [F.col("value").isNull()] * (None in values)
        asked.append((F.col("field") == field) & reduce(lambda a, b: a | b, tests, F.lit(False)))
        return F.col(f"b{len(asked) - 1}")

    bits = {name: compile_bits(tree, any_of) for name, tree in filters.items()}
    of_all = F.col("field") == ALL
    own = index.where(reduce(lambda a, b: a | b, asked, of_all))
    held = lambda cond: F.coalesce(F.bit_or(F.when(cond, F.col("bits"))), F.lit(0).cast("long"))
    rows = own.groupBy("word").agg(held(of_all).alias("every"), *[held(c).alias(f"b{i}") for i, c in enumerate(asked)])
    return rows.select("word", *[b.alias(name) for name, b in bits.items()])


def select(index: DataFrame, tree: dict | None, fields: list[str]) -> DataFrame:
    """(word, bits) of the rows that meet the filter."""
    return select_all(index, {"bits": tree}, fields).where("bits <> 0")


def among(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the chosen words (word, bits)."""
    held = chosen.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    return rows.join(held, (F.shiftright(F.col(key), 6) == F.col("_word")) & (F.getbit(F.col("_bits"), F.col(key).bitwiseAND(63).cast("int")) == 1)).drop("_word", "_bits")


def keys(chosen: DataFrame) -> DataFrame:
    """(key) of the chosen words' rows."""
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return chosen.select("word", F.explode(set_bits).alias("bit")).select((F.shiftleft("word", 6) + F.col("bit")).alias("key"))


def facets(index: DataFrame, filters: dict[str, dict | None], of: list[str], fields: list[str]) -> DataFrame:
    """(filter, field, value, n): how many rows that meet each filter have each value of the fields ``of``; values that none has are left out."""
    names = {f"f{i}": name for i, name in enumerate(filters)}
    chosen = select_all(index, {c: filters[name] for c, name in names.items()}, fields)
    own = index.where(F.col("field").isin(of)).join(chosen, "word")
    sums = own.groupBy("field", "value").agg(*[F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(c)))).alias(c) for c in names])
    each = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(c).alias("n")) for c, name in names.items()])
    return sums.select("field", "value", F.explode(each).alias("x")).select("x.filter", "field", "value", "x.n").where("n > 0")
