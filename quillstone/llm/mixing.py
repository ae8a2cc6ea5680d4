"""Mixing sources to target weights: a Pfair schedule of blocks.

After Baruah et al., "Proportionate Progress" (1996). Block i (from 1) of a source of weight w is released at slot
floor((i - 1) / w) and due by slot ceil(i / w); each slot goes to the released block that is due first. With one block a
slot and weights that add up to one every deadline is met, so at any slot each source is less than one block away from
its share. Weights are the exact fractions that the target numbers stand for, and the schedule covers the whole output, so this
holds against the targets to the last slot. One task deals the slots in order, a batch at a time: it holds two entries for each
source, and takes some microseconds a block of ``block_rows`` documents.

Every document is kept. A source with too few documents for its weight starts again from its first (the next epoch)
until the source that is largest for its weight has come once to its end, so weights hold over the whole output; the
last epoch of a source may be part of one. Target weights are a parameter; without them a source weighs its number of
documents to the power ``temperature``.

Defined results: null is a source of its own. Null and repeated doc_ids are documents like others. More than MOST_SOURCES sources and sources without a
stated weight raise ValueError; stated ones without documents are left out and the rest scaled up. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, ranked

BLOCK_ROWS, TEMPERATURE, PERIOD = 16, 0.8, 4096
#: PERIOD: the slots of a batch.
#: Tables on sources and slots are broadcast up to so many rows, which is some megabytes; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: The driver holds a number for each source, and refuses more than so many.
MOST_SOURCES = 100_000


def exact_weights(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights."""
    of = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in of.values()))
    return {s: int(w * common) for s, w in of.items()}


def slots(parts: dict, n: int) -> Iterator[tuple[int, object, int, int, int]]:
    """(slot, source, block, release, deadline) of the first ``n`` slots; ``parts`` are whole weights."""
    total, order = sum(parts.values()), sorted(parts, key=str)
    waiting = [(0, k, 1) for k in range(len(order))]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // parts[order[k]]), k, i, release))
        due, k, i, release = heapq.heappop(ready)
        yield slot, order[k], i - 1, release, due
        heapq.heappush(waiting, (i * total // parts[order[k]], k, i + 1))


def schedule(parts: dict, period: int) -> list[tuple[int, object, int, int, int]]:
    """The slots of one period; ``parts`` are whole weights that add up to it."""
    return list(slots(parts, period))


def schedule_table(spark: SparkSession, parts: dict, n: int, batch: int) -> DataFrame:
    """(_slot, _s, _block, _release, _deadline) of the first ``n`` slots."""
    schema = pa.schema([("_slot", pa.int64()), ("_s", pa.string()), ("_block", pa.int64()), ("_release", pa.int64()), ("_deadline", pa.int64())])

    def rows(batches):
        for b in batches:
            if b.num_rows:
                for some in batched(slots(parts, n), batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return spark.range(0, 1, 1, 1).mapInArrow(rows, "_slot long, _s string, _block long, _release long, _deadline long")


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table with a broadcast hint if that is known to be cheap."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, period: int = PERIOD, order: list[str] | None = None) -> DataFrame:
    """Adds epoch, block, release, deadline, slot and position (all long) to ``docs``, whose rows come once an epoch.

    ``order``: columns that tell rows of a source apart (doc_id by default). The driver holds a number for each source.
    Slots are made ``period`` at a time.
    """
    spark, order = docs.sparkSession, order or ["doc_id"]
    own = [c for c in docs.columns if c not in ("epoch", "block", "release", "deadline", "slot", "position")]
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights is not None and (missing := [s for s in counts if s not in weights]):
        raise ValueError(f"no target weight for sources {missing[:5]}")
    target = {s: weights[s] if weights is not None else n**temperature for s, n in counts.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("target weights must be positive: a document of a source without weight would be lost")
    parts = exact_weights(target)
    blocks = {s: math.ceil(n / block_rows) for s, n in counts.items()}
    # the largest source for its weight fixes how many slots are dealt
    ends, n_slots = {}, 0
    if parts:
        worst = max(parts, key=lambda s: Fraction(blocks[s], parts[s]))
        ends = {s: blocks[worst] * a // parts[worst] for s, a in parts.items()}
        n_slots = -(-blocks[worst] * sum(parts.values()) // parts[worst])
    table = spark.createDataFrame([(s, n, ends[s] * block_rows) for s, n in counts.items()], "_s string, _rows long, _end long")
    dealt = schedule_table(spark, parts, n_slots, period)
    if n_slots > BROADCAST_ROWS:
        dealt = materialise(dealt, "slots")  # its size is then known, so that Spark doesn't broadcast it unasked
    at = ranked(docs.select(*own), ["source"], order, sum(counts.values()), "_rank")
    at = at.join(small(table, len(counts)), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # documents of the block that closes a source's first epoch are all dealt, whatever the end
    last = F.greatest(F.col("_end") - 1, F.col("_rank"))
    at = at.withColumn("_g", F.explode(F.sequence(F.col("_rank"), last, F.col("_rows"))))
    at = at.withColumn("block", F.expr(f"_g div {block_rows}")).withColumn("epoch", F.expr("_g div _rows"))
    at = at.join(small(dealt, n_slots), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
    out = at.withColumns({"release": F.col("_release"), "deadline": F.col("_deadline"), "slot": F.col("_slot")})
    out = out.withColumn("position", F.col("slot") * block_rows + F.col("_g") % block_rows)
    return out.select(*own, "epoch", "block", "release", "deadline", "slot", "position")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
