"""Packing documents into sequences: shortest-pack-first over the length histogram.

After Krell et al., "Efficient Sequence Packing without Cross-contamination" (2021). Documents become pieces of at most
``width`` tokens: full ones, and a rest. Only the histogram of piece lengths, at most ``width`` numbers, comes to the
driver. There lengths are placed longest first, each into the open pattern with the fewest tokens that has room; as
many sequences as share a pattern are one count, so the work depends on the number of lengths, not of documents. The
pattern table goes back to the pieces by the rank of a piece among those of its length.

Where documents come in an order that training should follow, ``pack_in_order`` packs windows of that order, of a bounded number of documents
each, by the same method, a window in a task. Inside a window pieces of a length take their places in order, and sequences are numbered by
the median place of their pieces; windows follow each other. There are as many windows as the rows need, and the driver holds none of them.

What is left of a sequence is padding up to ``width``; a sequence whose tokens number a power of two needs none.

Defined results: a null or empty text has one token, the end mark. Null and repeated doc_ids are packed like others:
each row of the input is its own document. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, ranked
from quillstone.llm.tokens import tokenizer

WIDTH, END, FILE = 4096, 2, "word_bpe_49k.json"
#: Documents of a window of ``pack_in_order``.
WINDOW_ROWS = 10_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, width: int = WIDTH, end: int = END, file: str = FILE, folder: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (PIECES and the long columns ``more``) of each row's token sequence, the end mark included: full ones of ``width``, then the rest."""
    kinds = PIECES + "".join(f", {c} long" for c in more)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in kinds.split(", ")])

    def cut(batches):
        encode = tokenizer(file, folder).encode
        for b in batches:
            rows = []
            for doc_id, text, *own in zip(b.column(0).to_pylist(), b.column(1), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                rows += [(doc_id, s, len(ids[s : s + width]), zlib.crc32(ids[s : s + width].tobytes()), len(ids), *own) for s in range(0, len(ids), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(schema), schema=schema)

    return docs.select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in more]).mapInArrow(cut, kinds)


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times), ...], sequences) that hold each length as often as it counts.

    Longest first into the shortest open pattern with room, until that is no longer the shortest: one piece into each sequence
    that shares it, then the next. Where fewer pieces are left than sequences share the pattern, it is split, so there are
    about as many steps as lengths and splits. Where no pattern has room, sequences are opened and filled one by one.
    """
    space: dict[int, list] = defaultdict(list)  # tokens in the pattern -> [(pattern, sequences)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            open_ = sorted(u for u, held in space.items() if held and u + length <= width)[:2]
            if open_:
                used = open_[0]
                pattern, n = space[used].pop()
                level = used if space[used] else open_[1] if len(open_) > 1 else width
                times = min(max(1, left // n), (width - used) // length, (level - used) // length + 1)
            else:
                used, pattern, times = 0, [], min(left, width // length)
                n = left // times
            take = min(n, left // times)
            if n > take:
                space[used].append((pattern, n - take))
            if pattern and pattern[-1][0] == length:
                pattern, more = pattern[:-1], pattern[-1][1]
            else:
                more = 0
            space[used + length * times].append(([*pattern, (length, more + times)], take))
            left -= take * times
    return [x for held in space.values() for x in held]


def slots(patterns: list[tuple[list[tuple[int, int]], int]], sequence: int = 0) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: arrays (first rank, first sequence, offset, times) of runs of pieces, in order of rank.

    Ranks first_rank.. of a length go to the pattern's sequences one after another, ``times`` pieces to each. ``sequence``: the first one's number.
    """
    runs: dict[int, list] = defaultdict(list)
    nxt: dict[int, int] = defaultdict(int)
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            runs[length].append((nxt[length], sequence, offset, times))
            nxt[length] += n * times
            offset += length * times
        sequence += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def placed(length: np.ndarray, rank: np.ndarray, where: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, from their ranks among those of their length and the runs of ``slots``."""
    seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length):
        own = np.nonzero(length == n)[0]
        first, first_seq, offset, times = where[int(n)]
        run = np.searchsorted(first, rank[own], "right") - 1
        k = rank[own] - first[run]
        seq[own] = first_seq[run] + k // times[run]
        off[own] = offset[run] + k % times[run] * n
    return seq, off


def pack(docs: DataFrame, width: int = WIDTH, end: int = END, file: str = FILE, folder: str | None = None) -> DataFrame:
    """One row per piece: PIECES and (sequence_id, offset) long. Text columns of ``docs``: doc_id, text."""
    cut = materialise(pieces(docs, width, end, file, folder), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``width`` rows
    at = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], sum(counts.values()))
    held = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(counts, width)))  # runs of a histogram of ``width`` lengths

    def place(batches):
        for b in batches:
            seq, off = placed(b.column("length").to_numpy(), b.column("rank").to_numpy(), held.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = [c.split()[0] for c in PIECES.split(", ")]
    return at.select(*names, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_in_order(docs: DataFrame, window: str, place: str, width: int = WIDTH, end: int = END, file: str = FILE, folder: str | None = None) -> DataFrame:
    """As ``pack``, in order of the whole numbers ``window``, whose rows one task holds, and ``place`` within it."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("start", "ascending")])
        length, at = t.column("length").to_numpy(), t.column("place").to_numpy()
        by = np.argsort(length, kind="stable")
        n, first = np.unique(length[by], return_index=True)
        rank = np.zeros(len(length), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(first, np.diff([*first, len(by)]))
        seq, off = placed(length, rank, slots(pack_histogram(dict(zip(n.tolist(), np.diff([*first, len(by)]).tolist(), strict=True)), width)))
        by = np.lexsort((at, seq))
        _, first, size = np.unique(seq[by], return_index=True, return_counts=True)
        number = np.zeros(len(first), np.int64)
        number[np.argsort(at[by][first + size // 2], kind="stable")] = np.arange(len(first))
        return pa.table([*(t.column(c) for c in names), t.column("window"), pa.array(number[seq]), pa.array(off)], names=[*names, "window", "sequence_id", "offset"])

    cut = pieces(docs.withColumns({"window": F.coalesce(window, F.lit(0)), "place": F.coalesce(place, F.lit(0))}), width, end, file, folder, ("window", "place"))
    own = materialise(cut.groupBy("window").applyInArrow(one, PIECES + ", window long, sequence_id long, offset long"), "packed")
    sizes = own.groupBy(F.col("window").alias("_w")).agg((F.max("sequence_id") + 1).alias("n"))
    before = sizes.select("_w", (F.sum("n").over(Window.orderBy("_w")) - F.col("n")).alias("before"))  # a row for each WINDOW_ROWS documents
    return own.join(before, F.col("window") == F.col("_w")).select(*names, (F.col("sequence_id") + F.col("before")).alias("sequence_id"), "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
