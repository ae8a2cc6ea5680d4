"""Ranking: BM25, exact cosine, reciprocal-rank fusion, and the query strategies over them.

BM25 is Okapi's with k1 1.5 and b 0.75; idf is ln(N - df + .5) - ln(df + .5), and negative ones become a quarter of the mean
idf over all terms. Order is by rounded score, then by insertion order, then by id, so that equal scores keep their place in every run.

Postings are stored in blocks of at most BLOCK, a row each, in order of the term and within it of impact (what a posting adds to a score but for
the idf), with the block's largest impact. Top-k questions are pruned by these bounds, after MaxScore (Turtle and Flood, 1995) and block-max
indexes (Ding and Suel, 2011), for any number of questions at once: the best blocks of a question's terms give a score that k rows reach; terms
that together can't reach it bring no candidates, nor do blocks that can't with all other terms at their best; candidates whose score so far can't
reach it with what is left go before any row is looked up. Scores of those left come from their own rows' term counts, so they are exact.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from quillstone.functions.text import tokenize
from quillstone.operators import bitmaps
from quillstone.sources.versions import stored

K1, B, EPSILON, RRF_K, POOL = 1.5, 0.75, 0.25, 60, 4


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of rows (id, text). Terms are counted where a row lies; only where ids repeat are the counts shuffled, to be summed up."""
    own = counted(docs.select("id", "text")).select("id", F.explode("tfs").alias("term", "n"), "dl").select("id", "term", F.col("n").cast("long").alias("tf"), "dl")
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return own
    return own.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.select(F.size(tokenize(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): idf after the floor for negative ones."""
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))  # one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def impact(tf: Column, dl: Column, avg: Column) -> Column:
    """What a term adds to a row's score but for the idf. At another mean length ``m`` it is at most ``m / avg`` times that, if that is more than 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


#: Words that are counted at once, but for those of one row.
WORDS = 1 << 19


def counted(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, its length dl and counts of its terms tfs (map), of a row each."""
    own = [c for c in docs.columns if c not in ("text", "dl", "tfs")]
    made = [StructField("dl", LongType()), StructField("tfs", MapType(StringType(), IntegerType()))]

    def parts(batches):
        for b in batches:
            lot = np.cumsum(b.column(len(own)).value_lengths().to_numpy(zero_copy_only=False)) // WORDS
            ends = [0, *(np.nonzero(np.diff(lot))[0] + 1).tolist(), len(b)]
            yield from (b.slice(low, high - low) for low, high in zip(ends, ends[1:], strict=False))

    def count(batches):
        for b in parts(batches):
            words = b.column(len(own))
            of = np.repeat(np.arange(len(b)), words.value_lengths().to_numpy(zero_copy_only=False))
            terms = words.flatten().dictionary_encode()
            # a row and a term as one number: equal ones lie side by side once they are in order
            wide = max(1, len(terms.dictionary))
            key, times = np.unique(of * wide + terms.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(b) + 1) * wide)
            tfs = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), terms.dictionary.take(pa.array(key % wide)), pa.array(times, pa.int32()))
            cols = [*b.columns[: len(own)], words.value_lengths().cast(pa.int64()), tfs]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "dl", "tfs"])

    words = tokenize(F.coalesce("text", F.lit("")))
    return docs.select(*own, words.alias("_t")).mapInArrow(count, StructType([*(docs.schema[c] for c in own), *made]))


BLOCKS = "kind int, term string, block int, bound double, avg double, posts array<struct<id:{id},tf:int,dl:long>>"
#: Postings of a block.
BLOCK = 128


def blocked(forward: DataFrame, avg: float, part: Column) -> DataFrame:
    """(_part, kind, term, block, bound, avg, posts) of rows (id, kind, dl, tfs): blocks of postings from the largest impact down, ``part`` dealing rows out."""
    avg = avg or 1.0
    post = forward.select(part.alias("_part"), "kind", "id", "dl", F.explode("tfs").alias("term", "tf"))
    one = F.struct((-impact(F.col("tf"), F.col("dl"), F.lit(avg))).alias("x"), "id", F.col("tf").cast("int").alias("tf"), "dl")
    lists = post.groupBy("_part", "kind", "term").agg(F.sort_array(F.collect_list(one)).alias("p"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((size(p) - 1) div {BLOCK} AS INT)")), lambda k: F.slice("p", k * BLOCK + 1, F.lit(BLOCK)))
    lists = lists.select("_part", "kind", "term", F.posexplode(cut).alias("block", "p"))
    posts = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["tf"].alias("tf"), x["dl"].alias("dl")))
    return lists.select("_part", "kind", "term", F.col("block").cast("int"), (-F.get("p", F.lit(0))["x"]).alias("bound"), F.lit(avg).alias("avg"), posts.alias("posts"))


#: Postings that a task puts in order at once. So many list entries go into a batch of rows at most.
RUN, BATCH = 1 << 21, 1 << 19


def packed(forward: DataFrame, avg: float) -> DataFrame:
    """As ``blocked``, for rows that lie in files: each task packs what it reads, RUN postings at a time, so no posting is shuffled. A run is in order of term, kind and block."""
    avg, size, run_of = avg or 1.0, BLOCK, RUN
    schema = BLOCKS.format(id=forward.schema["id"].dataType.simpleString())

    def run(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        tfs = rows["tfs"].combine_chunks()
        ids, kind, dl = rows["id"].combine_chunks(), rows["kind"].to_numpy(), rows["dl"].to_numpy()
        row = np.repeat(np.arange(len(ids)), np.diff(tfs.offsets.to_numpy()))
        if not len(row):
            return
        words = tfs.keys.dictionary_encode()
        by = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        tf, word = tfs.items.to_numpy(), place[words.indices.to_numpy()]
        x = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avg))
        order = np.lexsort((row, -x, kind[row], word))
        word, row = word[order], row[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (kind[row[1:]] != kind[row[:-1]])])
        first = np.nonzero(new)[0]
        nth = np.arange(len(row)) - first[np.cumsum(new) - 1]
        at = np.nonzero(nth % size == 0)[0]
        ends = np.append(at, len(row))
        terms = words.dictionary.take(pa.array(by[word[at]]))
        step = max(1, BATCH // size)
        for i in range(0, len(at), step):
            own, low, high = at[i : i + step], ends[i], ends[min(i + step, len(at))]
            posts = pa.StructArray.from_arrays([ids.take(pa.array(row[low:high])), pa.array(tf[order[low:high]], pa.int32()), pa.array(dl[row[low:high]], pa.int64())], ["id", "tf", "dl"])
            lists = pa.ListArray.from_arrays(pa.array(ends[i : i + len(own) + 1] - low, pa.int32()), posts)
            cols = [pa.array(kind[row[own]], pa.int32()), terms.slice(i, len(own)), pa.array(nth[own] // size, pa.int32()), pa.array(x[order[own]]), pa.array(np.full(len(own), avg)), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "term", "block", "bound", "avg", "posts"])

    def runs(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(3).keys)
            if n >= run_of:
                yield from run(held)
                held, n = [], 0
        if held:
            yield from run(held)

    return forward.select("id", "kind", "dl", "tfs").mapInArrow(runs, schema)


def ordered(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Rows in order over ``parts`` files, so that a reader skips all but those of its terms, or ids."""
    return df.repartitionByRange(parts, by[0]).sortWithinPartitions(*by)


def floor_of(terms: DataFrame, n: int) -> float:
    """What negative idfs become, from the counts (term, df) of all terms among ``n`` rows."""
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return (terms.agg(F.avg(raw)).first()[0] or 0.0) * EPSILON


#: Scores are compared rounded to nine digits, so what bounds them is taken a little wider.
MARGIN = 1e-8
#: Terms go without blocks while all of them together can add less than this part of a question's pruning score; the rest of it sorts candidates out.
SPARED = 1.0
#: Rows that are scored whole for the pruning score of a question, for each of the k asked for.
TRIED = 4
#: Ids of found rows are looked up by value up to so many, which lets the reader skip files and pages.
LOOKUP = 1000


#: Questions of so many terms in all go to the rows' counts instead of being pruned, and so many products are made at once.
SCANNED, PRODUCTS = 100_000, 1 << 22


def scan(forward: DataFrame, asked: DataFrame, terms: list, avg: float, k: int) -> DataFrame:
    """(qid, kind, id, seq, score) of rows (id, kind, seq, dl, tfs) with a term of a question: of each question and kind the best ``k`` of each task, and those near the last of them.

    ``terms``: the rows (qid, term, w) of ``asked``, a stated set of questions. Each batch of rows is held against all of them; what leaves a task is k rows
    a question and kind, and rows of scores that rounding could make equal. Of equal scores those first by seq and id count.
    """
    schema = StructType([asked.schema["qid"], *(forward.schema[c] for c in ("kind", "id", "seq")), StructField("score", DoubleType())])
    if not terms:
        return forward.sparkSession.createDataFrame([], schema).select("qid", "kind", "id", "seq", "score")
    qids, words = sorted({r["qid"] for r in terms}), sorted({r["term"] for r in terms})
    nth_q, nth_w = ({x: i for i, x in enumerate(of)} for of in (qids, words))
    by_word = sorted((nth_w[r["term"]], nth_q[r["qid"]], r["w"]) for r in terms)
    word, question, w = (np.array(c) for c in zip(*by_word, strict=True))
    fan, begin = np.bincount(word, minlength=len(words)), np.searchsorted(word, np.arange(len(words)))
    n_q, step, positive, avg = len(qids), max(1, PRODUCTS // len(terms)), bool((w > 0).all()), avg or 1.0
    kind_of_qid = asked.select("qid").schema["qid"].dataType

    def best(held: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """What can still be among the best k of a question and kind, and the scores that are needed."""
        held = held.take(pc.sort_indices(held, sort_keys=[("q", "ascending"), ("kind", "ascending"), ("score", "descending"), ("seq", "ascending"), ("id", "ascending")], null_placement="at_start"))
        q, kind, score = (held[c].to_numpy() for c in ("q", "kind", "score"))
        new = np.append(True, (q[1:] != q[:-1]) | (kind[1:] != kind[:-1]))
        other = new | np.append(True, score[1:] != score[:-1])
        since = lambda firsts: np.arange(len(q)) - np.nonzero(firsts)[0][np.cumsum(firsts) - 1]
        group, last = np.cumsum(new) - 1, np.full(new.sum(), -np.inf)
        at = since(new) == k - 1
        last[group[at]] = score[at]
        return held.filter(pa.array((score >= last[group] - MARGIN) & (since(other) < k))), np.stack([q[new], kind[new], last])

    def task(batches):
        held, bound, needed = None, 1 << 16, {}
        for b in batches:
            tfs, kinds = b.column(4), b.column(1).to_numpy()
            of = pc.fill_null(pc.index_in(tfs.keys, pa.array(words)), -1).to_numpy()
            row = np.repeat(np.arange(len(b)), np.diff(tfs.offsets.to_numpy()))[of >= 0]
            tf, dl, of = tfs.items.to_numpy()[of >= 0], b.column(3).to_numpy()[row], of[of >= 0]
            x = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
            for low in range(0, len(b), step):
                n = min(step, len(b) - low)
                s = slice(*np.searchsorted(row, [low, low + n]))
                many = fan[of[s]]
                at = np.repeat(begin[of[s]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                key = np.repeat(row[s] - low, many) * n_q + question[at]
                score = np.bincount(key, w[at] * np.repeat(x[s], many), n * n_q)
                hit = score > 0 if positive else np.bincount(key, minlength=n * n_q) > 0
                least = np.stack([needed.get(c, np.full(n_q, -np.inf)) for c in kinds[low : low + n]]).ravel() if needed else -np.inf
                hit = np.nonzero(hit & (score >= least))[0]
                own = pa.array(low + hit // n_q)
                some = pa.table({"q": pa.array(hit % n_q), "kind": b.column(1).take(own), "id": b.column(0).take(own), "seq": b.column(2).take(own), "score": pa.array(score[hit])})
                held = some if held is None else pa.concat_tables([held, some])
                if held.num_rows > bound:
                    held, last = best(held)
                    bound = max(bound, 2 * held.num_rows)
                    for c in np.unique(last[1]):
                        own = last[1] == c
                        needed.setdefault(int(c), np.full(n_q, -np.inf))[last[0][own].astype(int)] = last[2][own] - MARGIN
        if held is not None and held.num_rows:
            held, _ = best(held)
            of = pa.array(qids, to_arrow_type(kind_of_qid)).take(held["q"].combine_chunks())
            yield from pa.table({"qid": of, **{c: held[c] for c in ("kind", "id", "seq", "score")}}).to_batches()

    found = forward.select("id", "kind", "seq", "dl", "tfs").mapInArrow(task, schema)
    return found.select("qid", "kind", "id", "seq", F.round("score", 9).alias("score"))


@dataclass(frozen=True)
class Index:
    """What questions read, all without the text.

    blocks (BLOCKS), runs in order of the term; terms (term, df); forward (id, kind, seq, dl, tfs); rows (id, seq and more), in order of the id; the
    corpus's numbers. Rows of a ``kind`` have blocks of their own.
    """

    blocks: DataFrame
    terms: DataFrame
    forward: DataFrame
    rows: DataFrame
    n: int
    avgdl: float
    floor: float

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf, dl)."""
        return self.blocks.select("term", F.explode("posts").alias("p")).select("p.id", "term", F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl"))

    def idf(self, wanted: list[str] | None = None) -> DataFrame:
        """(term, idf) of the terms wanted, or of all."""
        of = self.terms if wanted is None else self.terms.where(F.col("term").isin(wanted))
        of = of.groupBy("term").agg(F.sum("df").alias("df"))
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return of.select("term", F.when(raw < 0, F.lit(self.floor)).otherwise(raw).alias("idf"))

    def _impact(self, tf: Column, dl: Column) -> Column:
        return impact(tf, dl, F.lit(self.avgdl or 1.0))

    def asked(self, query: list[str]) -> DataFrame:
        """(qid, term, w) of one question; a term asked for twice counts twice."""
        wanted = sorted(set(query))
        times = F.create_map(*[F.lit(x) for t in wanted for x in (t, query.count(t))])
        return F.broadcast(self.idf(wanted).select(F.lit(0).alias("qid"), "term", (times[F.col("term")] * F.col("idf")).alias("w")))  # as many rows as terms asked for

    def scores(self, query: list[str]) -> DataFrame:
        """(id, score) of all rows that hold a query term."""
        if not query:
            return self.rows.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
        own = self.postings.where(F.col("term").isin(sorted(set(query)))).join(self.asked(query), "term")
        return own.groupBy("id").agg(F.sum(F.col("w") * self._impact(F.col("tf"), F.col("dl"))).alias("score"))

    def _meeting(self, found: DataFrame, where: Column | DataFrame) -> DataFrame:
        """The found rows that meet the filter: a condition on the columns of ``rows``, or words of a bitmap index (word, bits) keyed by seq, with which ``rows`` isn't read."""
        if isinstance(where, Column):
            return found.join(self.rows.where(where).select("id"), "id", "left_semi")
        of = found if "seq" in found.columns else found.join(self.forward.select("id", "seq"), "id")
        return bitmaps.among(of, where, "seq").select(*found.columns)

    def bounds(self, asked: DataFrame, k: int, where: Column | DataFrame | None = None, kinds: list[int] | None = None, few: bool = False) -> tuple[DataFrame, DataFrame]:
        """What prunes questions (qid, term, w), w being positive: the blocks that could matter to them, and a row for each term of a question and kind.

        That row is (qid, kind, term, w, ub, u, theta, essential, rest, whole): ub the most that the term can add, u the sum of these, theta a score that ``k`` rows
        which meet ``where`` reach (0 if that isn't known), rest the most that a candidate's score can lack of what essential terms' kept blocks gave it,
        whole whether none of an essential term's blocks is left out.
        """
        blocks = self.blocks if kinds is None else self.blocks.where(F.col("kind").isin(kinds))
        own = blocks.withColumn("bound", F.col("bound") * F.greatest(F.lit(1.0), F.lit(self.avgdl or 1.0) / F.col("avg"))).join(asked, "term")
        best = own.groupBy("qid", "kind", "term").agg(F.first("w").alias("w"), (F.first("w") * F.max("bound")).alias("ub"))
        head = self._partial(own.where(F.col("block") * BLOCK < k).withColumn("whole", F.lit(False)))
        if where is not None:
            head = self._meeting(head, where)
        # of those that the best blocks speak for most, some more than k are scored whole: theta is then near what it can be at best
        place = lambda c: F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc(c)))
        tried = head.withColumn("place", place("partial")).where(F.col("place") <= TRIED * k).select("qid", "kind", "id", "known")
        whole = self._added(F.broadcast(tried), self._adding(asked, ["term"])) if few else self._scored(tried, asked, ["qid"])  # TRIED * k rows a kind
        theta = whole.withColumn("place", place("score")).where(F.col("place") <= k).groupBy("qid", "kind").agg(F.when(F.count("*") == k, F.min("score")).alias("theta"))
        question = Window.partitionBy("qid", "kind")
        out = best.join(theta, ["qid", "kind"], "left").withColumns({"theta": F.coalesce("theta", F.lit(0.0)) - MARGIN, "u": F.sum("ub").over(question)})
        out = out.withColumn("essential", F.sum("ub").over(question.orderBy("ub", "term")) >= SPARED * F.col("theta"))
        lacks = F.when(F.col("essential"), F.greatest(F.lit(0.0), F.col("theta") - (F.col("u") - F.col("ub")))).otherwise(F.col("ub"))
        return blocks, out.withColumns({"rest": F.sum(lacks).over(question), "whole": F.col("essential") & (lacks <= 0)})

    def _partial(self, own: DataFrame, *more: str) -> DataFrame:
        """(qid, kind, id, partial, known and more) of blocks (BLOCKS, qid, w, whole): what they add to scores, and what those of whole terms add."""
        of = own.select("qid", "kind", "w", "whole", *more, F.explode("posts").alias("p"))
        adds = F.col("w") * self._impact(F.col("p.tf"), F.col("p.dl"))
        sums = [F.sum(adds).alias("partial"), F.sum(F.when(F.col("whole"), adds).otherwise(0.0)).alias("known")]
        return of.groupBy("qid", "kind", F.col("p.id").alias("id")).agg(*sums, *[F.first(c).alias(c) for c in more])

    def _scored(self, found: DataFrame, words: DataFrame, on: list[str]) -> DataFrame:
        """(qid, kind, id, seq, score) of rows (qid, kind, id, known): what is known of the score, and what ``words`` (on, term, w) add by the rows' own counts of terms."""
        words = words.groupBy(*on).agg(F.collect_list(F.struct("term", "w")).alias("words"))
        found = found.join(words, on, "left").join(self.forward.select("id", "seq", "dl", "tfs"), "id")
        each = F.transform("words", lambda x: x["w"] * F.coalesce(self._impact(F.try_element_at("tfs", x["term"]), F.col("dl")), F.lit(0.0)))
        added = F.coalesce(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        return found.select("qid", "kind", "id", "seq", F.round(F.col("known") + added, 9).alias("score"))

    def _adding(self, words: DataFrame, on: list[str]) -> DataFrame:
        """(qid, kind, id, adds): what the postings of ``words`` (on, qid, w) add to scores."""
        of = self.blocks.select("kind", "term", "posts").join(F.broadcast(words.select("qid", "w", *on)), on)  # as many rows as terms asked for
        of = of.select("qid", "kind", "w", F.explode("posts").alias("p"))
        return of.select("qid", "kind", F.col("p.id").alias("id"), (F.col("w") * self._impact(F.col("p.tf"), F.col("p.dl"))).alias("adds"))

    def _added(self, found: DataFrame, adding: DataFrame) -> DataFrame:
        """(qid, kind, id, score) of found rows (qid, kind, id, known), each of which has a posting among ``adding``."""
        sums = adding.join(found, ["qid", "kind", "id"]).groupBy("qid", "kind", "id").agg(F.first("known").alias("known"), F.sum("adds").alias("adds"))
        return sums.select("qid", "kind", "id", F.round(F.col("known") + F.col("adds"), 9).alias("score"))

    def few_best(self, query: list[str], k: int, where: Column | DataFrame | None = None, kinds: list[int] | None = None) -> DataFrame:
        """As ``best``, for one question: scores come from the postings of its own terms, so the counts of rows aren't read, and what is moved grows with these postings."""
        spark, wanted = self.rows.sparkSession, sorted(set(query))
        own = replace(self, blocks=self.blocks.where(F.col("term").isin(wanted)))
        blocks, bounds = own.bounds(self.asked(query), k, where, kinds, few=True)
        bounds = F.broadcast(spark.createDataFrame(bounds.collect(), bounds.schema))  # a row for each term asked for and kind
        part = own._partial(own.sources(blocks, bounds), "theta", "rest")
        left = part.where(F.col("partial") + F.col("rest") >= F.col("theta")).select("qid", "kind", "id", F.col("known").alias("adds"), F.lit(True).alias("left"))
        more = own._adding(bounds.where("NOT whole"), ["kind", "term"]).withColumn("left", F.lit(False))
        out = left.unionByName(more).groupBy("qid", "kind", "id").agg(F.sum("adds").alias("adds"), F.max("left").alias("left")).where("left")
        out = out.select("qid", "kind", "id", F.round("adds", 9).alias("score"))
        out = out if where is None else own._meeting(out, where)
        # rows that share the last score stay, as their seq decides
        place = F.rank().over(Window.partitionBy("qid", "kind").orderBy(F.desc("score")))
        out = out.withColumn("place", place).where(F.col("place") <= k).drop("place")
        return out.join(self.forward.select("id", "seq"), "id").select("qid", "kind", "id", "seq", "score")

    def best(self, asked: DataFrame, k: int, where: Column | DataFrame | None = None, kinds: list[int] | None = None, keep=None) -> DataFrame:
        """(qid, kind, id, seq, score): of each question and kind the best ``k`` rows that meet ``where``, and some more. ``keep``: stores what is read twice."""
        blocks, bounds = self.bounds(asked, k, where, kinds)
        bounds = bounds if keep is None else keep(bounds, "bounds")
        part = self._partial(self.sources(blocks, bounds), "theta", "rest")
        left = part.where(F.col("partial") + F.col("rest") >= F.col("theta")).select("qid", "kind", "id", "known")
        out = self._scored(left, bounds.where("NOT whole"), ["qid", "kind"])
        return out if where is None else self._meeting(out, where).select(*out.columns)

    def sources(self, blocks: DataFrame, bounds: DataFrame) -> DataFrame:
        """The blocks that bring candidates, with (qid, w, whole, theta, rest)."""
        wide = F.col("bound") * F.greatest(F.lit(1.0), F.lit(self.avgdl or 1.0) / F.col("avg"))
        return blocks.join(bounds.where("essential"), ["kind", "term"]).where(wide * F.col("w") + F.col("u") - F.col("ub") >= F.col("theta"))

    def top(self, query: list[str], k: int, where: Column | DataFrame | None = None, kinds: list[int] | None = None) -> DataFrame:
        """The best ``k`` of the rows that meet ``where`` and are of the kinds: all their columns, score and lex_rank. Rows without a query term score 0 and are ranked too.

        Where ``k`` rows with a query term are found, which is asked at once, nothing else of the rows is read but these.
        """
        order = [F.desc("score"), F.col("seq"), F.col("id")]
        if query and self.floor >= 0:
            hits = [r for r in self.few_best(query, k, where, kinds).orderBy(*order).limit(k).select("id", "score").collect() if r["score"] > 0]
            if len(hits) == k:
                found = self.rows.sparkSession.createDataFrame(hits, self.rows.select("id", F.lit(0.0).alias("score")).schema)
                own = self.rows.where(F.col("id").isin([r["id"] for r in hits])) if k <= LOOKUP else self.rows
                return number(own.join(F.broadcast(found), "id"), order, "lex_rank")  # k rows
        kept = self.rows if kinds is None else self.rows.join(self.forward.where(F.col("kind").isin(kinds)).select("id"), "id", "left_semi")
        kept = kept if where is None else kept.where(where) if isinstance(where, Column) else self._meeting(kept, where)
        hits = kept.join(self.scores(query).withColumn("score", F.round("score", 9)), "id")
        if self.floor < 0:
            top = kept.join(hits.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(*order).limit(k)
        else:
            # fewer than k hits leave a place to rows without any, of which the first 2k rows hold enough
            first = kept.orderBy("seq", "id").limit(2 * k)
            found = hits.join(F.broadcast(first.select("id")), "id", "left_semi")  # 2k rows
            rest = first.join(found.select("id"), "id", "left_anti").withColumn("score", F.lit(0.0))
            top = hits.orderBy(*order).limit(k).unionByName(rest).orderBy(*order).limit(k)
        return number(top, order, "lex_rank")

    def batch(self, questions: DataFrame, strategies: dict[str, list[int] | None], k: int, padded: bool = False) -> DataFrame:
        """(strategy, qid, id, score, place): the best ``k`` rows of each strategy, which are kinds of rows (None: all), for all questions (qid, text) at once.

        Hits only, unless ``padded``: then rows without a term of the question score 0 and are ranked too, as in ``top``. Up to SCANNED terms of all questions are held
        against each row where it lies, so rows' counts aren't shuffled; more are pruned by bounds, but for negative idfs.
        """
        asked = questions.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        asked = asked.join(self.idf(), "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("w"))
        asked = stored(asked, "asked")
        terms = asked.limit(SCANNED + 1).collect()  # the questions asked
        if len(terms) <= SCANNED:
            hits = scan(self.forward, asked, terms, self.avgdl, k)
        elif self.floor < 0:
            hits = self._partial(self.blocks.join(asked, "term").withColumn("whole", F.lit(True))).join(self.forward.select("id", "seq"), "id").withColumn("score", F.round("partial", 9))
        else:
            hits = self.best(asked, k, keep=stored)
        of = [F.when(F.lit(True) if c is None else F.col("kind").isin(c), F.lit(s)) for s, c in strategies.items()]
        if padded:
            hits = hits.select("qid", "kind", "id", "seq", "score")
            first = F.row_number().over(Window.partitionBy("kind").orderBy("seq", "id"))
            # 2k rows of each kind are enough for a question with fewer than k hits
            few = F.broadcast(self.forward.select("kind", "id", "seq").withColumn("first", first).where(F.col("first") <= 2 * k).drop("first"))
            none = questions.select("qid").distinct().join(few, F.lit(True)).join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
            hits = hits.unionByName(none.withColumn("score", F.lit(0.0)).select(*hits.columns))
        each = hits.withColumn("strategy", F.explode(F.filter(F.array(*of), lambda x: x.isNotNull())))
        place = F.row_number().over(Window.partitionBy("strategy", "qid").orderBy(F.desc("score"), "seq", "id"))
        return each.withColumn("place", place).where(F.col("place") <= k).select("strategy", "qid", "id", "score", "place")


def write_index(rows: DataFrame, path: str, parts: int | None = None, kind: Column | None = None) -> Index:
    """Writes the index of rows (id, seq, text and more) into a new folder; the corpus's numbers come last, so a folder with them is whole."""
    spark = rows.sparkSession
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered(rows.drop("text"), n, "id").write.mode("overwrite").parquet(f"{path}/rows")
    own = (F.lit(0) if kind is None else kind).cast("int").alias("kind")
    # rows stay in the tasks that read them: counting words is dear, and what it makes is large
    counted(rows.select("id", own, "seq", "text")).write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    total = forward.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    packed(forward, total["avgdl"] or 0.0).write.mode("overwrite").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("term", F.size("posts.tf").cast("long").alias("df"))
    ordered(sizes.groupBy("term").agg(F.sum("df").alias("df")), n, "term").write.mode("overwrite").parquet(f"{path}/terms")
    floor = floor_of(spark.read.parquet(f"{path}/terms"), total["n"])
    numbers = json.dumps({"n": total["n"], "avgdl": total["avgdl"] or 0.0, "floor": floor})
    spark.createDataFrame([(numbers,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    numbers = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "forward", "rows")), **numbers)


def number(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks from 1 of a top-k result, which is as small as k."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(id, dist, dense_rank): the k nearest of rows (id, v) to the one row of ``query`` (q), by cosine distance."""
    kept = vectors if where is None else vectors.where(where)
    asked = query.limit(1).select("q", dot(F.col("q"), F.col("q")).alias("qq"))
    v, q = F.col("v"), F.col("q")
    dist = kept.crossJoin(F.broadcast(asked)).select("id", F.round(1 - dot(v, q) / F.sqrt(dot(v, v) * F.col("qq")), 9).alias("dist"))
    return number(dist.orderBy("dist", "id").limit(k), [F.col("dist"), F.col("id")], "dense_rank")


def fuse(den: DataFrame, lex: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(id, dense_rank, lex_rank, score): reciprocal ranks of both lists added up; ties by id."""
    part = lambda c: F.coalesce(F.lit(1.0) / (rrf_k + F.col(c)), F.lit(0.0))
    both = den.select("id", "dense_rank").join(lex.select("id", "lex_rank"), "id", "full_outer")
    return both.withColumn("score", F.round(part("dense_rank") + part("lex_rank"), 9)).orderBy(F.desc("score"), "id").limit(k)


def expand(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, source_id, pos, text): source rows of each claim in the order it names them; unknown ids are left out."""
    ids = claims.select("id", F.posexplode("source_chunk_ids").alias("pos", "source_id"))
    return ids.join(rows.select(F.col("id").alias("source_id"), "text"), "source_id").select("id", "source_id", F.col("pos").cast("long").alias("pos"), "text")


def merge(claim_hits: DataFrame, chunk_hits: DataFrame, claims: DataFrame, skip_covered: bool = True) -> DataFrame:
    """Claim hits, then chunk hits that no claim hit cites (section 0 and 1): fewer than k may be left of these."""
    if skip_covered:
        cited = claims.join(claim_hits.select("id"), "id", "left_semi").select(F.explode("source_chunk_ids").alias("id"))
        chunk_hits = chunk_hits.join(cited, "id", "left_anti")
    return claim_hits.withColumn("section", F.lit(0).cast("long")).unionByName(chunk_hits.withColumn("section", F.lit(1).cast("long")))


def merged_batch(claims: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, id, part, place) of hits (qid, id, place): claims, then the chunks that no claim hit of the question cites."""
    cited = claims.join(rows.select("id", "source_chunk_ids"), "id").select("qid", F.explode("source_chunk_ids").alias("id"))
    left = chunks.join(cited, ["qid", "id"], "left_anti")
    part = lambda df, n: df.select("qid", "id", F.lit(n).alias("part"), "place")
    return part(claims, 0).unionByName(part(left, 1))


#: Kind of a claim's row; all others are 0.
CLAIM = 1


def kind_of(type_: Column) -> Column:
    return F.equal_null(type_, F.lit("claim")).cast("int")


def kinds_of(where: dict | None) -> tuple[list[int] | None, dict | None]:
    """The kinds that a filter on claims alone means, and what is left of the filter."""
    if where == {"type": "claim"}:
        return [CLAIM], None
    return ([0], None) if where == {"type": {"$ne": "claim"}} else (None, where)


#: Vectors are compared with so many questions at a time: a product of so many columns.
ASKED_AT_ONCE = 512


def dense_batch(vectors: DataFrame, questions: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(qid, kind, id, place): for each question (qid, vector) the k nearest of rows (id, kind, v) of each kind, by cosine distance to nine digits, then id.

    Each batch of rows is held against the questions, a stated set, as a product of matrices; what leaves a task is k rows a question and kind.
    """
    schema = "qid long, kind int, id string, dist double"
    if questions:
        q = np.array([v for _, v in questions], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        qids = np.array([n for n, _ in questions])

    def near(batches):
        for b in batches:
            ids, kind = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1) if len(ids) else np.zeros((0, q.shape[1]))
            norm = np.sqrt((v * v).sum(1))
            for c in np.unique(kind):
                own = np.nonzero((kind == c) & (norm > 0))[0]
                own = own[np.argsort(ids[own], kind="stable")]
                for at in range(0, len(q), ASKED_AT_ONCE):
                    dist = np.round(1 - (v[own] @ q[at : at + ASKED_AT_ONCE].T) / norm[own, None], 9)
                    best = np.argsort(dist, axis=0, kind="stable")[:k]
                    n, m = best.shape
                    cols = np.repeat(qids[at : at + ASKED_AT_ONCE], n), np.full(n * m, c, np.int32), ids[own][best.T.ravel()], dist.T[np.repeat(np.arange(m), n), best.T.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["qid", "kind", "id", "dist"])

    spark = vectors.sparkSession
    found = vectors.select("id", "kind", "v").mapInArrow(near, schema) if questions else spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("qid", "kind").orderBy("dist", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def fused_batch(index: Index, questions: DataFrame, vectors: DataFrame, strategies: dict[str, list[int] | None], k: int) -> DataFrame:
    """(strategy, qid, id, score, place): the best ``k`` of both legs fused, as for one question, for all questions (qid, text, vector) at once."""
    pool = k * POOL
    lex = index.batch(questions, strategies, pool, padded=True).select("strategy", "qid", "id", F.col("place").alias("lex_rank"))
    asked = [(r["qid"], r["vector"]) for r in questions.select("qid", "vector").where("vector IS NOT NULL").dropDuplicates(["qid"]).collect()]  # the questions asked
    den = dense_batch(vectors.join(index.forward.select("id", "kind"), "id"), asked, pool)
    den = stored(den, "near")
    of = [F.when(F.lit(True) if c is None else F.col("kind").isin(c), F.lit(s)) for s, c in strategies.items()]
    den = den.withColumn("strategy", F.explode(F.filter(F.array(*of), lambda x: x.isNotNull())))
    place = lambda *by: F.row_number().over(Window.partitionBy("strategy", "qid").orderBy(*by))
    den = den.withColumn("dense_rank", place("dist", "id")).where(F.col("dense_rank") <= pool).select("strategy", "qid", "id", "dense_rank")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    both = den.join(lex, ["strategy", "qid", "id"], "full_outer").withColumn("score", F.round(part("dense_rank") + part("lex_rank"), 9))
    return both.withColumn("place", place(F.desc("score"), "id")).where(F.col("place") <= k).select("strategy", "qid", "id", "score", "place")


def evaluate(index: Index, questions: DataFrame, k: int, claims_k: int, vectors: DataFrame | None = None) -> DataFrame:
    """(strategy, qid, pmid, rank): papers that each strategy returns for each question (qid, text), all questions at once.

    With vectors (id, v) of rows and a vector of each question both legs are fused; the pool of a leg is then as for one question.

    ``index.rows`` holds pmid and source_chunk_ids; claims are rows of the kind CLAIM. Strategies: chunks, claims, mixed, and merged, which asks for
    ``claims_k`` claims. A paper may come several times.
    """
    kinds = {"claims": [CLAIM], "chunks": [0], "mixed": None}
    if vectors is None:
        hits = index.batch(questions, kinds, max(k, claims_k))
    else:
        hits = fused_batch(index, questions, vectors, kinds, k)
        if claims_k != k:  # a pool of its own
            own = fused_batch(index, questions, vectors, {"cited": [CLAIM]}, claims_k)
            hits = hits.unionByName(own)
    hits = stored(hits, "hits")  # k rows a question and strategy, read five times
    cited = "claims" if vectors is None or claims_k == k else "cited"
    single = hits.where((F.col("place") <= k) & (F.col("strategy") != "cited")).select("strategy", "qid", "id", F.lit(0).alias("part"), "place")
    of = lambda s, n: hits.where((F.col("strategy") == s) & (F.col("place") <= n)).select("qid", "id", "place")
    merged = merged_batch(of(cited, claims_k), of("chunks", k), index.rows).withColumn("strategy", F.lit("merged"))
    both = single.unionByName(merged.select(*single.columns)).join(index.rows.select("id", "pmid"), "id")
    rank = F.row_number().over(Window.partitionBy("strategy", "qid").orderBy("part", "place"))
    return both.select("strategy", "qid", "pmid", rank.cast("long").alias("rank"))


def scores_of(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(strategy, qid, hit, recall, mrr) of rows (strategy, qid, pmid, rank), first place of a pmid counting."""
    first = ranked.where("pmid IS NOT NULL").groupBy("strategy", "qid", "pmid").agg(F.min("rank").alias("rank"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("strategy", "qid").orderBy("rank")))
    n = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    found = place.join(relevant.withColumn("rel", F.lit(1)), ["qid", "pmid"], "left")
    per = found.groupBy("strategy", "qid").agg(F.sum(F.coalesce("rel", F.lit(0))).alias("got"), F.min(F.when(F.col("rel") == 1, F.col("place"))).alias("best"))
    asked = n.crossJoin(F.broadcast(ranked.select("strategy").distinct()))  # strategies are a handful
    out = asked.join(per, ["strategy", "qid"], "left")
    got = F.coalesce("got", F.lit(0))
    return out.select("strategy", "qid", (got > 0).cast("long").alias("hit"), F.round(got / F.col("n"), 6).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)), 6).alias("mrr"))
