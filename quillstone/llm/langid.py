"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, anything but letters (as Unicode says) becomes a space, and n-grams of two and three characters are hashed to
``2 ** BITS`` buckets. Counts by language and bucket are summed on the executors; the driver gets at most languages
times buckets of them, makes the log-probability matrix and broadcasts it (0.25 MB a language). A batch of texts is one
sparse matrix of buckets by text, in numpy: its rows' buckets one after another, which the log-probability matrix is looked up
at and summed up by row, some _BLOCK characters at a time. Texts are read whole.

Training reads at most about ``train_rows`` labelled rows of each language, chosen by a hash of doc_id and text; priors and the set
of languages come from all labelled rows. More than MOST_LANGS languages are refused, as a language is then no language.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is any text where nothing was
learned. Ties go to the language first in order. Null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import kept

BITS, TRAIN_ROWS, SMOOTHING, UNKNOWN, MOST_LANGS = 15, 2000, 0.5, "und", 1000
#: Characters are taken in blocks of so many, which bounds the memory of a batch and of a very long text.
_BLOCK = 1 << 16


def letters() -> np.ndarray:
    """Whether each code point is a letter, made once in a process."""
    return kept("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def code_points(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(letters()[c], c, np.uint32(32))


def hashed(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of two and of three code points that start at each place but the last, and the last two."""
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    return (two * np.uint32(0x165667B1)) >> np.uint32(32 - bits), (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def buckets(text: str, bits: int = BITS):
    """Arrays of buckets of the text's n-grams, block by block."""
    text = text.lower()
    for at in range(0, len(text), _BLOCK):
        part = text[max(0, at - 2) : at + _BLOCK] if at else " " + text[:_BLOCK]
        if at + _BLOCK >= len(text):
            part += " "
        two, three = hashed(code_points(part), bits)
        yield two[1 if at else 0 :]  # the bigram two before a block's start is the last block's
        yield three


def together(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of several texts that aren't empty: buckets, text by text, and where each text's begin; first of bigrams, then of trigrams."""
    held = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in held])
    for short, found in enumerate(hashed(code_points("".join(held)), bits), 1):
        inside = np.ones(len(found), bool)  # n-grams that reach into the next text are none
        for k in range(1, short + 1):
            inside[ends[:-1] - k] = False
        yield found[inside], np.concatenate([[0], ends[:-1] - short * np.arange(1, len(held))])


class Model:
    """Languages in order, log priors, and the log-probability matrix (buckets, languages)."""

    def __init__(self, langs: list[str], rows: dict[str, int], counts: np.ndarray, smoothing: float = SMOOTHING):
        self.langs = langs
        self.prior = np.log(np.array([rows[x] for x in langs], dtype=float) / max(1, sum(rows.values())))
        self.matrix = np.log((counts + smoothing) / (counts.sum(0) + smoothing * len(counts))).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log prior and log likelihood of each text (rows) under each language (columns)."""
        bits, out = int(np.log2(len(self.matrix))), np.tile(self.prior, (len(texts), 1))
        block: list[int] = []

        def add() -> None:
            if block:
                for at, starts in together([texts[i] for i in block], bits):
                    out[block] += np.add.reduceat(self.matrix[at], starts, axis=0, dtype=np.float64)
                block.clear()

        size = 0
        for i, text in enumerate(texts):
            if len(text) > _BLOCK:
                for b in buckets(text, bits):
                    out[i] += self.matrix[b].sum(0, dtype=np.float64)
                continue
            if size + len(text) > _BLOCK:
                add()
                size = 0
            if text:
                block.append(i)
                size += len(text)
        add()
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        if own:
            score = self.scores([texts[i] for i in own])
            best = score.argmax(1)
            sure = 1 / np.exp(score - score[np.arange(len(own)), best][:, None]).sum(1)
            for i, k, x in zip(own, best, sure, strict=True):
                out[i] = self.langs[k], float(x)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS, smoothing: float = SMOOTHING) -> Model:
    """Fits on rows (doc_id, text, lang); those with a null text or language are left out."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(rows) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(rows)
    share = F.create_map(*[x for k, n in rows.items() for x in (F.lit(k), F.lit(min(1.0, train_rows / n)))]) if rows else F.lit(None)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)) if rows else labelled.limit(0)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                for x in buckets(text.as_py(), bits):
                    held += np.bincount(x, minlength=1 << bits)
        for lang, held in total.items():
            at = np.nonzero(held)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at])], names=["lang", "bucket", "n"])

    summed = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << bits, len(langs)))
    t = summed.toArrow()  # at most languages times buckets
    at = {x: i for i, x in enumerate(langs)}
    counts[t.column("bucket").to_numpy(), np.array([at[x] for x in t.column("lang").to_pylist()], dtype=int)] = t.column("n").to_numpy()
    return Model(langs, rows, counts, smoothing)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with lang_pred and score; texts are read whole."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    def rows(batches):
        of = held.value.predict_all
        for b in batches:
            found = of(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*own, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + ["lang_pred string", "score double"])
    return docs.select(*own, "text").mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
