"""License scans, centroids and source divergence: brute force, odd rows, groups of any size."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillstone.llm import centroids, divergence, licenses
from tests.llm.test_llm import DOCS, ODD

# 11 license scans


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def scanned(text, templates, step, containment):
    """What a scan has to find, with every block compared with every clause."""
    w = words_of(text)
    places = [(label, k) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    found = [(label, len(set(own) & set(w[k : k + 2 * step])) / len(own)) for k in range(0, len(w), step) for _, label, own, o in licenses.clauses_of(templates, step, containment) if len(set(own) & set(w[k : k + 2 * step])) >= o]
    base = sorted({p[0] for p in places})
    at = [p[1] for p in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(f[0] for f in found)})), 1.0 if at else max((f[1] for f in found), default=0.0)


def test_licenses_against_every_block(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["cc", "by", "all", "rights", "reserved", "General", "public", "LICENSE", "é"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    templates = [(f"t{k % 5}", " ".join(rng.choices(vocabulary[:40], weight[:40], k=rng.choice([1, 3, 9, 20])))) for k in range(12)]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weight, k=rng.choice([0, 1, 5, 30, 400]))) for _ in range(120)]
    # a clause across the border of two windows, at each place
    texts += [" ".join(["x"] * k + templates[3][1].split() + ["x"] * 9) for k in range(20)]
    texts += ["CC-by cc by", "all rights all rights reserved", "general public license general public licenses", None, "", " \x00 ", "cc byé"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for step, containment in ((8, 0.7), (16, 1.0), (8, 0.5)):
        got = {r[0]: tuple(r)[1:] for r in licenses.scan(df, templates, step=step, containment=containment).collect()}
        assert got == {k: scanned(t, templates, step, containment) for k, t in enumerate(texts)}
    blocks = {(r["doc_id"], r["first_word"], r["clause"]) for r in licenses.found_blocks(df, templates, step=8, containment=0.7).collect()}
    own = licenses.clauses_of(templates, 8, 0.7)
    assert blocks == {(k, a, n) for k, t in enumerate(texts) for w in [words_of(t)] for a in range(0, len(w), 8) for n, _, c, o in own if len(set(c) & set(w[a : a + 16])) >= o}


def test_licenses_of_odd_rows(spark):
    df = spark.createDataFrame([*ODD, (9, "so " * 30_000 + "CC BY " + "so " * 30_000 + " Released under the MIT License.", "en", "a", 0)], DOCS)
    df = df.withColumns({"labels": F.lit(1), "n_base": F.lit("x"), "_row": F.lit(2), "extra": F.lit(3)})
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "extra", *licenses.RESULTS]
    got = out.collect()
    assert len(got) == len(ODD) + 1 and {r["labels"] for r in got if r["doc_id"] != 9} == {""}
    long = next(r for r in got if r["doc_id"] == 9)
    assert (long["n_words"], long["n_base"], long["first_word"], long["last_word"], long["base_labels"], long["labels"], long["score"]) == (60_007, 1, 30_000, 30_000, "cc-by", "cc-by,mit", 1.0)
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, templates=[]).where("labels <> ''").count() == 1
    with pytest.raises(ValueError, match="clauses"):
        licenses.clauses_of([("a", "b")] * (licenses.MOST_CLAUSES + 1))


# 12 centroids


def lloyd(vectors, ids, k, rounds):
    """Rounds without trees, in Python's whole numbers."""
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in zip(ids, vectors, strict=True) if i is not None)[:k]
    z = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(z))
    for _ in range(rounds):
        own = defaultdict(list)
        for v in vectors:
            own[near(v)[1]].append(v)
        z = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(z)]
    return [near(v) for v in vectors], z


@pytest.mark.parametrize("dim,size", [(2, 3), (3, 100), (64, 2), (2, 30_000)])
def test_centroids_against_rounds_without_trees(spark, dim, size):
    rng = np.random.default_rng(dim)
    v = rng.integers(-size, size, (300, dim)) / 4  # with ties, and many equal vectors where there are few values
    ids = [*range(298), 5, None]
    df = spark.createDataFrame([(i, x) for i, x in zip(ids, v.tolist(), strict=True)], "vec_id long, embedding array<double>")
    got = centroids.cluster(df, k=5, rounds=4, dim=dim, scale=4, lot=90, leaf=4).collect()
    near, z = lloyd([[int(np.floor(4 * y)) for y in x] for x in v], ids, 5, 4)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    want = [(i, c, d, inertia[c], sum(inertia.values()), marks[c]) for i, (d, c) in zip(ids, near, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_trees_prune_and_give_whole_nodes():
    rng = np.random.default_rng(1)
    z = np.array([[0, 0], [1000, 0], [0, 1000]])
    v = np.concatenate([c + rng.integers(-20, 20, (200, 2)) for c in z])
    order, nodes = centroids.grow(v, 8)
    assert sorted(order) == list(range(600)) and all(len(low) == 1 << n for n, (low, _, _) in enumerate(nodes))
    flat = [np.concatenate(x) for x in zip(*nodes, strict=True)]
    tree = centroids.Tree(v[order].astype("<i4").tobytes(), flat[0].astype("<i4").tobytes(), flat[1].astype("<i4").tobytes(), flat[2].astype("<i8").tobytes(), 2)
    left = sum(len(tree.rows(level, nodes)[0]) for level, nodes, _, may in tree.filtered(z) if may is not None)
    assert left < 60  # only where groups meet in a node
    n, sums = tree.totals(z)
    assert n.tolist() == [200] * 3 and (sums == [v[k : k + 200].sum(0) for k in (0, 200, 400)]).all()
    # a tie on the border of a box isn't pruned: both vectors are as near to either
    flat = np.array([[5, 0], [5, 9]])
    order, nodes = centroids.grow(flat, 1)
    box = [np.concatenate(x) for x in zip(*nodes, strict=True)]
    tree = centroids.Tree(flat[order].astype("<i4").tobytes(), box[0].astype("<i4").tobytes(), box[1].astype("<i4").tobytes(), box[2].astype("<i8").tobytes(), 2)
    assert tree.assigned(np.array([[10, 0], [0, 0]]))[0].tolist() == [0, 0]
    big = np.array([[centroids.MOST, -centroids.MOST]])
    assert centroids.squares(big, -big).tolist() == [[2 * (2 * centroids.MOST) ** 2]]


def test_centroids_of_odd_vectors(spark):
    one = [1.0] * 64
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [*one[:-1], None]), (5, [*one[:-1], float("nan")]), (6, [*one[:-1], float("inf")]), (7, one), (7, one), (None, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "label": F.lit(1)})
    got = sorted(map(tuple, centroids.cluster(df).select("vec_id", "cluster", "distance", "inertia").collect()), key=str)
    assert got == [(7, 1, 0, 0), (7, 1, 0, 0), (None, 0, 0, 0)]  # the first round gives all to 0, of two equal centroids
    assert centroids.cluster(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="larger than"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


# 13 source divergence


def audited(docs, top):
    """(text, lang, source) rows, in Python's whole numbers."""
    n, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        found = re.findall(divergence.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in seen[lang].items() if d >= 3]
        own = sorted(s for x, s in groups if x == lang)
        counts = {s: {t: n[lang, s][t] for t in kept} for s in own}
        counts[None] = {t: sum(counts[s][t] for s in own) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, t, v, k) for k, (v, t) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)] + ["é", "É", "Ωmega", "漢字", "\U0001f600", "UPPER", "a1b"]
    docs = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 40]))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "é", None, "c"])) for _ in range(150)]
    docs += [("once only", "xx", "a"), ("", "xx", "b"), (None, "yy", "a"), ("word " * 5000, "en", "d"), ("word", "en", "a"), ("word", "en", "b")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "value": F.lit("x"), "doc_id": F.lit(None).cast("long")})
    for sizes in ({}, {"block": 16, "groups": 2, "top": 3}):
        got = divergence.audit(df, **sizes)
        assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
        assert sorted(map(tuple, got.collect())) == audited(docs, sizes.get("top", 200))
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_shuffles_counts_once(spark, monkeypatch):
    shuffles = []

    def seen(df, name, *a):
        if name in ("term-counts", "kept-terms"):
            shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return materialise(df, name, *a)

    materialise = divergence.materialise
    monkeypatch.setattr(divergence, "materialise", seen)
    assert divergence.audit(spark.createDataFrame([("a b", "en", "a")] * 3 + [("b", "en", "b")], "text string, lang string, source string")).count() == 4
    assert sum(shuffles) == 1


def test_divergence_counts_of_lots(monkeypatch):
    rng = random.Random(7)
    pieces = ["a", "B", "é", "É", "\x85", "\xa0", "\u2028", "\x00", "\x1f", "@", "[", "`", "{", "\x7f", " ", "\n", "9", "漢", "\U0001f600", "Z", "z"]
    texts = ["".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 60]))) for _ in range(300)] + ["", " ", "word " * 500]
    langs, sources = ([rng.choice(x) for _ in texts] for x in (["en", "fr", ""], ["a", "é", ""]))
    monkeypatch.setattr(divergence, "LOT", 200)
    monkeypatch.setattr(divergence, "LOT_ROWS", 5)
    own = pa.array(["before", *texts])[1:]
    cut = divergence.lots(pc.binary_length(own).to_numpy())
    assert [k for start, size in cut for k in range(start, start + size)] == list(range(len(texts)))
    assert all(n == 1 or n <= 5 and sum(len(t.encode()) for t in texts[k : k + n]) <= 200 for k, n in cut) and any(n == 5 for _, n in cut)
    assert divergence.lots(np.zeros(0, np.int64)) == []
    for start, size in [*cut, (0, len(texts))]:
        at = slice(start, start + size)
        n, docs = Counter(), Counter()
        for text, *group in zip(texts[at], langs[at], sources[at], strict=True):
            found = re.findall(divergence.TERM, "".join(c.lower() if c.isascii() else c for c in text))
            n.update((*group, t) for t in found)
            docs.update((*group, t) for t in set(found))
        wanted = [(*k, n[k], docs[k]) for k in n] + [(*g, " " + g[1], 0, 0) for g in set(zip(langs[at], sources[at], strict=True))]
        got = divergence.term_counts(own[at], langs[at], sources[at])
        assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(wanted)


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.share(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total
    with pytest.raises(ValueError, match="64 bits"):
        divergence.share(np.array([1]), 10**16)
