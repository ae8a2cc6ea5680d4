"""Positional postings: which rows hold a phrase word for word, and Boolean searches made of phrases, without reading a text.

A posting is a term in a row with the term's places there, ascending; Parquet keeps them as differences. Postings lie in the files of the tasks that read
the rows, each batch of rows in order of term, so a reader skips all pages but those of its words, and a term that every row holds is spread over files. A phrase starts from its rarest word's
postings; those of its other words are looked up by word and row, shifted by their place in the phrase, and intersected. So what is moved grows
with the rarest word, not with words like "the".

Words are those of ``tokenize``. A null text has none; a phrase without words is in no row; a phrase with a word that no row holds is in none either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstone.functions.text import tokenize
from quillstone.operators.search import Concept, select, terms_of

#: Words are looked up by value up to so many, which lets the reader skip files and pages; the steps of a funnel are bits of a number.
LOOKUP, MOST_STEPS = 1000, 62
#: Postings that leave a task at a time.
STEP = 1 << 17


@dataclass(frozen=True)
class Positions:
    """postings (term, lang, id, at), terms (term, df)."""

    postings: DataFrame
    terms: DataFrame


def placed(docs: DataFrame) -> DataFrame:
    """(term, lang, id, at) of rows (id, lang, text), made and put in order of the term by the task that reads them, a batch at a time: nothing is shuffled."""
    schema = StructType([StructField("term", StringType()), docs.schema["lang"], docs.schema["id"], StructField("at", ArrayType(IntegerType()))])

    def place(batches):
        for b in batches:
            words = b.column(2)
            n = words.value_lengths().to_numpy(zero_copy_only=False)
            row, terms = np.repeat(np.arange(len(b)), n), words.flatten().dictionary_encode()
            if not len(row):
                continue
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            by = pc.sort_indices(terms.dictionary).to_numpy()
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            key = rank[terms.indices.to_numpy()] * len(b) + row
            order = np.argsort(key, kind="stable")  # so places ascend
            key = key[order]
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            ends, at = np.append(first, len(key)), at[order]
            for i in range(0, len(first), STEP):
                own = first[i : i + STEP]
                low, high, of = own[0], ends[i + len(own)], pa.array(row[order[own]])
                lists = pa.ListArray.from_arrays(pa.array(ends[i : i + len(own) + 1] - low, pa.int32()), pa.array(at[low:high], pa.int32()))
                yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(by[key[own] // len(b)])), b.column(1).take(of), b.column(0).take(of), lists], names=["term", "lang", "id", "at"])

    return docs.select("id", "lang", tokenize(F.coalesce("text", F.lit(""))).alias("w")).mapInArrow(place, schema)


def write_positions(docs: DataFrame, path: str) -> Positions:
    # the second format's pages hold integers as differences, where there is no dictionary
    placed(docs).write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#at.list.element", "false").parquet(f"{path}/postings")
    postings = docs.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return read_positions(docs.sparkSession, path)


def read_positions(spark: SparkSession, path: str) -> Positions:
    return Positions(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def holding(index: Positions, phrases: DataFrame) -> DataFrame:
    """(key, phrase, id, places) of phrases (key, phrase), any number of them: the rows that hold each, and where it begins, from word 0."""
    asked = phrases.select("key", "phrase").distinct().select("key", "phrase", tokenize(F.col("phrase")).alias("w"))
    each = asked.select("key", "phrase", F.size("w").alias("of"), F.posexplode("w").alias("off", "term"))
    words = [r["term"] for r in each.select("term").distinct().limit(LOOKUP + 1).collect()]
    few = lambda df: df.where(F.col("term").isin(words)) if len(words) <= LOOKUP else df
    postings = few(index.postings).select("term", "id", "at")
    rarest = Window.partitionBy("key", "phrase").orderBy(F.coalesce("df", F.lit(0)), "off")
    each = each.join(few(index.terms), "term", "left").withColumn("nth", F.row_number().over(rarest)).drop("df")
    shifted = F.transform("at", lambda x: x - F.col("off"))
    first = each.where("nth = 1").join(postings, "term").select("key", "phrase", "of", "id", shifted.alias("begin"))
    other = first.where("of > 1").select("key", "phrase", "id").join(each.where("nth > 1").select("key", "phrase", "off", "term"), ["key", "phrase"])
    other = other.join(postings, ["term", "id"]).groupBy("key", "phrase", "id").agg(F.collect_list(shifted).alias("others"))
    found = first.join(other, ["key", "phrase", "id"], "left").where("of = 1 OR size(others) = of - 1")
    return found.select("key", "phrase", "id", F.array_sort(F.aggregate(F.coalesce("others", F.array().cast("array<array<int>>")), F.col("begin"), F.array_intersect)).alias("places")).where("size(places) > 0")


def steps_held(index: Positions, concepts: list[Concept], sensitivity: str = "balanced", language: str = "en") -> tuple[list[Concept], DataFrame]:
    """The concepts that count, and (id, held): rows with a term of any, a bit of ``held`` being set for each concept that they have."""
    chosen = select(concepts, sensitivity)
    if len(chosen) > MOST_STEPS:
        raise ValueError(f"at most {MOST_STEPS} concepts")
    asked = [(i, t) for i, c in enumerate(chosen) for t in terms_of(c, sensitivity)]
    phrases = index.postings.sparkSession.createDataFrame(asked, "key int, phrase string")
    own = Positions(index.postings.where(F.col("lang") == language), index.terms)
    return chosen, holding(own, phrases).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, key)")).alias("held"))


def matching(index: Positions, concepts: list[Concept], sensitivity: str = "balanced", language: str = "en") -> DataFrame:
    """(id): rows of the language that hold a term of each concept, word for word."""
    chosen, rows = steps_held(index, concepts, sensitivity, language)
    return rows.where(F.col("held") == (1 << len(chosen)) - 1).select("id")


def funnel(index: Positions, concepts: list[Concept], sensitivity: str = "balanced", language: str = "en") -> DataFrame:
    """(step, concept, total_count): rows that hold the first concepts together, all steps from one pass over the postings."""
    chosen, rows = steps_held(index, concepts, sensitivity, language)
    one = rows.agg(*[F.count_if(F.col("held").bitwiseAND((2 << i) - 1) == (2 << i) - 1).alias(f"s{i}") for i in range(len(chosen))])
    steps = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(c.name).alias("concept"), F.col(f"s{i}").alias("total_count")) for i, c in enumerate(chosen)])
    return one.select(F.explode(steps).alias("x")).select("x.*")
