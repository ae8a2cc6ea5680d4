"""The training-data operators: against SQL or brute force, and with nulls, empty tables, repeats, long texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import common, embed_dedup, langid, minhash, mixing, packing, pii, quality, queries, simhash, token_rollup, url_filter, warc
from quillstone.llm.tokens import WordBpe, tokenizer
from tests.oracle import compare, connect
from tests.oracle import rows as rows_of

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "Straße 12\tÉté \x00 x", None, "b", 3),
    (5, "long " * 60_000, "fr", "a", 1), (6, "\n\n \n", "de", None, 2), (7, "mail me at a.b@c.de or +49 (30) 1234-567, password=deadbeef01deadbeef", "en", "a", 9), (8, "<|endoftext|> 漢字 \U0001f600", "zz", "b", 1),
]


@pytest.fixture
def odd(spark):
    """Rows with each kind of trouble, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({"kept": F.lit("mine"), "slot": F.lit(1), "n_words": F.lit(-1), "score": F.lit("s"), "fp": F.lit(0), "n_0": F.lit(5), "length": F.lit(2)})


def texts(table="documents", column="text"):
    key = {"documents": "doc_id"}[table]
    return dict(connect(D).execute(f"SELECT {key}, {column} FROM {table}").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(queries.queries()[name], queries.oracle_sql()[name], spark, D)


def test_quality_counts_null_and_empty_as_one_text(spark, tmp_path):
    """A host where a line is in just over a hundredth of the texts, but not if null and empty were two."""
    rows = [(k, f"own words number {k} of this text and some more so that it is long enough\n" + ("the line that comes again" if k < 21 else f"line {k}"), "en", "a", 0) for k in range(2098)]
    rows += [(2098, "", "en", "a", 0), (2099, None, "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = rows_of(quality.op8_quality(spark, f"file://{tmp_path}").toArrow())
    assert got == rows_of(sql.execute(quality.ORACLE).to_arrow_table())
    assert sum(r[got[0].index("removed_words")] > 0 for r in got[1]) == 21


# 1 url filters


def test_cascade_is_exact(spark):
    rng = random.Random(1)
    keys = [(f"h{rng.randrange(400)}/p{rng.randrange(20)}", rng.random() < 0.3) for _ in range(6000)]
    listed = {k for k, x in keys if x}
    df = spark.createDataFrame(keys, "key string, listed boolean")
    for shards in (None, 3):
        out = url_filter.with_listed(df.select("key"), F.col("key"), df, shards, hashes=2).collect()
        assert len(out) == 6000 and all(r["listed"] == (r["key"] in listed) for r in out)
    assert len(url_filter.build_cascade(df, hashes=2).levels) > 2
    with pytest.raises(ValueError, match="more shards"):
        url_filter.build_cascade(df, most_bytes=10)
    assert url_filter.shards_for(10) == 1 and url_filter.shards_for(60_000_000) == 2


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?utm_a=1", "x://sub.example.com/de/", "x://notexample.com/de/", "ftp://w.org/fr/a#b", "x://net", "x://net/", "q://h.net?x", "a://b://c/d"]
    got = [tuple(r)[2:] for r in url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), F.col("url").rlike("utm_")).orderBy("page_id").collect()]
    e = ("", "", None, False, "allow")
    assert got == [e, e, e, ("a.example.net", "/en/x", "example.net/en/", True, "allow"), ("sub.example.com", "/de/", "example.com/de/", False, "block"), ("notexample.com", "/de/", None, False, "allow"),
                   ("w.org", "/fr/a", "org/fr/", False, "allow"), ("net", "", None, False, "allow"), ("net", "/", "net/", False, "block"), ("h.net", "", None, False, "allow"), ("b:", "//c/d", None, False, "allow")]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), F.lit(True)).count() == 0
    rows = [(None, "x://h.net/", "mine", 1), (1, "x://h.net/", "mine", 2), (1, None, "mine", 3)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict int"), F.lit(False))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "listed", "verdict"]
    assert sorted(map(tuple, got.select("page_id", "host", "rule", "verdict").collect()), key=str) == sorted([(None, "h.net", "net/", "block"), (1, "h.net", "net/", "block"), (1, "", None, "allow")], key=str)


# 2 warc


def test_warc_round_trip(spark):
    html = [None, "", "x\r\n\r\nWARC/1.1\r\n0\r\n\r\n", "é" * 40_000, "same", "same", "same", None]
    rows = [(i, f"http://h/{i} x", h) for i, h in enumerate(html)]
    path = common.new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment_bytes=1000, chunk_bytes=77)
    got = {r["page_id"]: r for r in warc.with_lengths(warc.read_warc(spark, path)).collect()}
    assert len(got) == 8
    for i, h in enumerate(html):
        want, newest = (h or "").encode(), max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i]["payload_bytes"] == len(want) and got[i]["refers_to"] == (None if newest == i else newest)
        assert got[i]["record_type"] == ("response" if newest == i else "revisit")
        if newest == i:
            assert bytes(got[i]["payload"]) == want
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), p := common.new_path(spark, "w"))
    assert warc.read_warc(spark, p).count() == 0


def test_warc_of_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, "u", "same"), (None, "u", "same"), (4, "u", "same"), (4, "u", "other"), (4, "u", "other"), (2, None, "same"), (None, "u", None)]
    want = Counter([(None, "response", None), (None, "response", None), (4, "response", None), (4, "response", None), (4, "response", None), (2, "revisit", 4), (None, "response", None)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    for most in (warc.BROADCAST_ROWS, 0):  # by broadcast, and by a shuffle
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        warc.write_warc(df, path := common.new_path(spark, "w"))
        assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()) == want


def test_segments_are_checked():
    assert warc.reassemble([(2, 4, b"cd"), (1, None, b"ab")], "r") == b"abcd"
    for parts in ([(1, None, b"ab"), (3, 4, b"cd")], [(1, None, b"ab"), (2, 5, b"cd")]):
        with pytest.raises(ValueError, match="record r"):
            warc.reassemble(parts, "r")
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
    import gzip

    assert warc.gunzip(b"".join(gzip.compress(x) for x in (b"a" * 200_000, b"", b"b"))) == b"a" * 200_000 + b"b"


# 3 mixing


def test_schedule_stays_within_a_block():
    parts = {"a": 156, "b": 64, "c": 35, None: 1}
    done = Counter()
    for slot, s, block, release, due in mixing.schedule(parts, 256):
        assert done[s] == block and release <= slot < due
        done[s] += 1
        assert all(abs(done[x] - (slot + 1) * a / 256) < 1 for x, a in parts.items())
    assert done == parts


def test_mixing_keeps_each_document(spark, odd, monkeypatch):
    out = mixing.mix(odd, block_rows=2, period=16).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0) == Counter((r[0], r[3]) for r in ODD)
    assert len({r["position"] for r in out}) == len(out) and out[0]["kept"] == "mine"
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(900)], "doc_id long, source string")
    out = mixing.mix(df, weights={"big": 0.5, "small": 0.5, "none": 1}, block_rows=10).collect()
    n = Counter(r["source"] for r in out)
    assert n["big"] == 600 and n["small"] == 600 and len({r["doc_id"] for r in out}) == 900
    for r in out:  # a block's rows share its slot
        assert r["position"] // 10 == r["slot"] and r["release"] <= r["slot"] < r["deadline"]
    with pytest.raises(ValueError, match="no target weight"):
        mixing.mix(df, weights={"big": 1})
    assert mixing.mix(df.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix(df, weights={"big": 0.5, "small": 0.5, "none": 1}, block_rows=10).collect()) == sorted(out)


def test_mixing_stays_within_a_block_of_its_targets_to_the_end(spark):
    n = {"hot": 40_000, "mid": 4_000, "tiny": 5}
    df = spark.createDataFrame([(i, s) for s, k in n.items() for i in range(k)], "doc_id long, source string")
    out = mixing.mix(df, block_rows=1).select("slot", "source", "epoch", "doc_id").toPandas().sort_values("slot")
    share = {s: k**0.8 / sum(x**0.8 for x in n.values()) for s, k in n.items()}
    slot = out["slot"].to_numpy() + 1
    for s, w in share.items():
        own = (out["source"] == s).to_numpy().cumsum()
        assert np.abs(own - w * slot)[:-3].max() < 1 and own[-1] >= n[s]  # past the last whole block slots may stay empty
    assert len(out[out["epoch"] == 0].drop_duplicates(["source", "doc_id"])) == sum(n.values()) and out["slot"].is_unique


def test_weights_hold_from_one_document_to_a_million():
    n = {"one": 1, "thousand": 1000, "million": 10**6}
    parts = mixing.exact_weights({s: k**0.8 for s, k in n.items()})
    total, done = sum(parts.values()), Counter()
    for slot, s, block, _, _ in mixing.slots(parts, 300_000):
        assert done[s] == block
        done[s] += 1
        if slot % 997 == 0:
            assert all(abs(done[x] - (slot + 1) * a / total) < 1 for x, a in parts.items())
    assert done["one"] <= 5  # its weight is 16 in a million


def test_mixing_query_is_an_earliest_deadline_schedule(spark):
    """The whole query against a schedule made slot by slot from fractions."""
    n = Counter(connect(D).execute("SELECT source FROM documents").fetchall())
    n = {s: k for (s,), k in n.items()}
    w = {s: Fraction(k**mixing.TEMPERATURE) for s, k in n.items()}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    rows = mixing.op3_mixing(spark, D).collect()
    at = {}
    for r in rows:
        at.setdefault(r["slot"], set()).add((r["source"], r["block"], r["release"], r["deadline"]))
        assert r["position"] // mixing.BLOCK_ROWS == r["slot"]
    nxt = dict.fromkeys(w, 0)
    for slot in range(max(at) + 1):
        ready = [(math.ceil((nxt[s] + 1) / w[s]), s) for s in w if math.floor(nxt[s] / w[s]) <= slot]
        due = min(ready)[0]
        s = min(s for d, s in ready if d == due)
        assert at.get(slot, {(s, nxt[s], math.floor(nxt[s] / w[s]), due)}) == {(s, nxt[s], math.floor(nxt[s] / w[s]), due)}
        nxt[s] += 1
    seen = Counter((r["doc_id"], r["source"]) for r in rows if r["epoch"] == 0)
    assert seen == Counter(connect(D).execute("SELECT doc_id, source FROM documents").fetchall())


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark.range(5).selectExpr("id AS doc_id", "string(id) AS source"))


def test_ranks_in_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 10 else None, i) for i in range(3000)], "g string, i long")
    out = defaultdict(list)
    for r in common.ranked(df, ["g"], ["i"], 3000, bucket_rows=50).collect():
        out[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in out.values()) and len(out["hot"]) == 2700


# 4 token rollups


def test_rollup_batches_count_once(spark, odd):
    counts = common.materialise(token_rollup.count_tokens(odd, ["word_bpe_49k.json"]), "c")
    t = tokenizer("word_bpe_49k.json").library
    want = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD)
    roll = token_rollup.Rollup(spark, common.new_path(spark, "roll"))
    load = token_rollup.delta(counts, 1, "v1", "n_0")
    assert roll.totals().count() == 0
    assert roll.commit("a", load) and not roll.commit("a", load)
    sums = lambda: tuple(roll.totals().agg(F.sum("docs"), F.sum("tokens")).first())
    assert sums() == (9, want)
    roll.commit("b", token_rollup.delta(counts.where("doc_id = 3"), -1, "v1", "n_0"))
    before = sums()
    roll.compact()
    assert sums() == before and before[0] == 7 and not roll.commit("b", load)
    roll.commit("c", token_rollup.delta(counts.where("doc_id IS NULL OR doc_id <> 3"), -1, "v1", "n_0"))
    roll.commit("empty", load.limit(0))
    assert roll.totals().count() == 0
    roll.compact()
    assert roll.totals().count() == 0 and not roll.commit("a", load)
    for i in range(3):
        roll.commit(f"more{i}", load)
        roll.compact()
    assert len(roll._names("snapshots")) == 2 and roll._names("batches") == [] and sums() == (27, 3 * want) and not roll.commit("empty", load)
    with pytest.raises(ValueError, match="batch id"):
        roll.commit("../x", load)


def test_rollup_query(spark):
    t = {v: tokenizer(v) for v in token_rollup.VERSIONS}
    rows = connect(D).execute("SELECT source, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)").fetchall()
    want = defaultdict(lambda: [0, 0])
    for source, lang, text in rows:
        v = token_rollup.VERSIONS[lang != "en"]
        n = len(t[v].library.encode(text, add_special_tokens=False).ids) if isinstance(t[v], WordBpe) else len(t[v].model.encode(text))
        w = want[source, lang, v.rsplit(".", 1)[0]]
        w[0] += 1
        w[1] += n
    got = {tuple(r)[:3]: list(r)[3:] for r in token_rollup.op4_token_rollup(spark, D).collect()}
    assert got == dict(want)


def test_fast_ids_are_the_librarys():
    t = tokenizer("word_bpe_49k.json")
    rng = random.Random(3)
    pool = ["a", "B", "'s", "'LL", "é", "ß", " ", "\n", "\t", "0", "42", "!?", "--", "<|", "<|endoftext|>", "漢", "\x00", "\x1c", "I'M", "_", "\u00a0", "µ", "e\u0301", "ÿ", "×", "word", "Ñandú"]
    for _ in range(400):
        s = "".join(rng.choices(pool, k=rng.randrange(30)))
        assert t.encode(s).tolist() == t.library.encode(s, add_special_tokens=False).ids, s


# 5 simhash


def brute_fp(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: [(id, fp)]; the smallest id reachable over links, by id and fp."""
    nodes = sorted({f for _, f in fps})
    up = {f: f for f in nodes}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {(i, f): least.get(root(f)) for i, f in fps}


def test_simhash_query(spark):
    fps = [(i, brute_fp(t)) for i, t in texts().items()]
    want = brute_components(fps)
    got = simhash.op5_simhash(spark, D).collect()
    assert len(got) == len(fps)
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got} == want


def test_near_pairs_are_all_found(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, 1, 3, 7, 15, 2**64 - 1, 2**63, 2**63 + 5, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA, 0x55555555AAAAAAAA]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for f in fps for _ in range(3)]
    fps = sorted(set(fps))
    signed = lambda f: f - (f >> 63 << 64)
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_cells_are_shared_and_distances_rule_out(spark):
    """The grid bounds, it doesn't encode: words share cells, and each step takes candidates away that the next need not see."""
    rng = random.Random(9)
    words = spark.createDataFrame([(w,) for w in {rng.getrandbits(16) for _ in range(60_000)}], "w long")
    n, cells = words.select(F.count("*"), F.count_distinct(simhash.counts(F.col("w")))).first()
    assert cells <= 3**8 < n / 5  # a half's low 16 bits are eight segments
    signed = lambda f: f - (f >> 63 << 64)
    low = [rng.getrandbits(32) for _ in range(40)]
    points = spark.createDataFrame([(signed(rng.choice(low) ^ 3 * rng.getrandbits(1) | rng.getrandbits(32) << 32),) for _ in range(3000)], "fp long").distinct()
    met = simhash.met_pairs(points)
    near = met.where(simhash.manhattan(F.col("a"), F.col("b")) <= 3)
    exact = simhash.near_pairs(points)
    assert met.count() > near.count() > exact.count()
    assert all((r["a"] ^ r["b"]) % 2**64 for r in met.collect())


def test_manhattan_distance_is_at_most_hammings(spark):
    rng = random.Random(10)
    signed = lambda f: f - (f >> 63 << 64)
    pairs = [(a := rng.getrandbits(64), a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))) for _ in range(500)]
    count = lambda f: [(f >> 2 * s & 3).bit_count() for s in range(32)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = {(r["a"] % 2**64, r["b"] % 2**64): r["m"] for r in df.withColumn("m", simhash.manhattan(F.col("a"), F.col("b"))).collect()}
    assert all(got[a, b] == sum(abs(x - y) for x, y in zip(count(a), count(b), strict=True)) <= (a ^ b).bit_count() for a, b in pairs)


def test_simhash_odd_rows(spark, odd):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    want = brute_components([(r[0], brute_fp(r[1])) for r in ODD])
    assert {(i, f % 2**64): c for (i, f), c in got.items()} == want
    kept = simhash.deduplicate(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({1: 1, 3: 1, None: 1, 5: 1, 7: 1, 8: 1})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and kept[0]["kept"] == "mine"
    two = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "wholly other words are in this one")], "doc_id long, text string")
    assert simhash.deduplicate(two).count() == 2


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 100)] + [(5000, 5000)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(i, i) == 0 for i in range(201)) and all(got.get(1000 + i, 1000) == 1000 for i in range(100))


# near copies by Jaccard similarity


def test_near_copies_go_at_jaccard_of_four_fifths(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(20)]
    rows = []
    for i, w in enumerate(base):
        near, far = w[:], w[:]
        for at in (20, 90, 160):  # 15 of 196 shingles change: 181 / 211
            near[at] = word()
        for at in range(10, 190, 20):  # 45 of 196: 151 / 241
            far[at] = word()
        rows += [(4 * i + 1, " ".join(near), "en", "s", 0), (4 * i, " ".join(w), "en", "s", 0), (4 * i + 2, " ".join(far), "en", "s", 0), (4 * i + 3, " ".join(w).upper(), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert max((brute_fp(a[1]) ^ brute_fp(b[1])).bit_count() for a, b in zip(rows[::4], rows[1::4], strict=True)) > 3
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, df, D).collect()) == sorted(i for k in range(20) for i in (4 * k, 4 * k + 2))
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_chains_in_a_bucket_are_compared_across_components(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100]), "en", "s", 0) for i in range(40)]  # neighbours 92 / 100, four apart 80 / 112
    found = {r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(found) == 1


def jaccard_components(rows, similarity=0.8):
    """[(id, text)]: the components of all texts by brute force, as sets of places."""
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-6 and (not a | b or len(a & b) / len(a | b) >= similarity):
                up[root(i)] = root(j)
    out = defaultdict(set)
    for i in range(len(rows)):
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


def test_large_groups_are_compared_by_blocks(spark, monkeypatch):
    """Many texts that are alike but mostly not linked, in several blocks of a bucket, against brute force."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(minhash, "_ROWS", 7)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(64)]
    rows = []
    for i in range(90):
        w = base[:]
        for at in rng.sample([6, 16, 26, 36, 46, 56], 2):
            w[at] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows = list({r[1]: r for r in rows}.values())
    got = defaultdict(set)
    text = {}
    df = spark.createDataFrame(rows, DOCS)
    for p, t in df.select(F.xxhash64("text"), "text").collect():
        text[p] = [r[1] for r in rows].index(t)
    for r in simhash.near_copies(df).collect():
        got[r["component"]].add(text[r["h"]])
    want = jaccard_components([(r[0], r[1]) for r in rows])
    assert sorted(map(sorted, got.values())) == want and 1 < len(want) < len(rows)


def test_shared_counts_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(common, "_COLUMNS", 5)
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(-40, 40, k)) for k in rng.integers(0, 30, n)] for n in (9, 6))
    assert (common.shared_counts(x, y) == [[len(set(a) & set(b)) for b in y] for a in x]).all()
    assert common.shared_counts([], y).shape == (0, 6)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    links = rng.random((20, 30)) < 0.04
    least = common.forest(links)
    up = list(range(50))
    for _ in range(50):
        for i, j in np.argwhere(links):
            up[i] = up[20 + j] = min(up[i], up[20 + j])
    assert least.tolist() == up


def test_rows_of_one_id_with_different_texts_stay_and_copies_without_id_go(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (7, a), (1, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert Counter((r["doc_id"], r["text"]) for r in stage(spark, df, D).collect()) == Counter([(1, a), (1, b), (None, c)])


# 6 packing


def check_packing(got, rows, t):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in seqs.values():
        at = 0
        for off, n in sorted(held):
            assert off == at
            at += n
        assert at <= packing.WIDTH
    return len(seqs), sum(r["length"] for r in got)


def test_packing_query(spark):
    n, tokens = check_packing(packing.op6_packing(spark, D).collect(), texts().items(), tokenizer(packing.FILE).library)
    assert tokens / (n * packing.WIDTH) > 0.97


def test_packing_odd_rows(spark, odd):
    rows = odd.dropDuplicates(["doc_id"])
    check_packing(packing.pack(rows).collect(), [(r["doc_id"], r["text"]) for r in rows.collect()], tokenizer(packing.FILE).library)
    assert packing.pack(odd).where("doc_id = 3").count() == 2 and packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{}, {5: 3}, {4096: 7, 1: 1}, {10: 100_000, 4000: 3}, {n: n % 7 + 1 for n in range(1, 4097, 3)}])
def test_patterns_hold_each_length(counts):
    got = Counter()
    for pattern, n in packing.pack_histogram(counts):
        assert sum(k * t for k, t in pattern) <= packing.WIDTH and n > 0
        for k, t in pattern:
            got[k] += t * n
    assert got == Counter(counts)


def test_patterns_are_shortest_pack_first():
    """Against a packer that places one piece after another, longest first, into the pack with the fewest tokens that has room."""
    rng = random.Random(12)
    for width, most in ((64, 64), (64, 20), (100, 100), (257, 40)):
        for _ in range(40):
            counts = Counter(rng.randrange(1, most + 1) for _ in range(rng.randrange(1, 120)))
            packs = []
            for length in sorted(counts.elements(), reverse=True):
                room = [u for u in packs if u + length <= width]
                if room:
                    packs.remove(min(room))
                packs.append((min(room) if room else 0) + length)
            got = Counter()
            for pattern, n in packing.pack_histogram(counts, width):
                got[sum(k * t for k, t in pattern)] += n
            assert got == Counter(packs), counts


def test_windows_are_packed_in_order(spark):
    rows = [(i, "word " * (i % 50 + 1), i // 100) for i in range(400)]
    df = spark.createDataFrame(random.Random(1).sample(rows, 400), "doc_id long, text string, w int").withColumns({"rank": F.lit(1), "p": 3 * F.col("doc_id")})
    got = packing.pack_in_order(df, "w", "p", width=64).collect()
    check_packing(got, [r[:2] for r in rows], tokenizer(packing.FILE).library)
    spans = [(min(s), max(s)) for k in range(4) for s in [[r["sequence_id"] for r in got if r["doc_id"] // 100 == k]]]
    assert spans[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["doc_id"], r["start"]))
    middle = [sorted(held[k])[len(held[k]) // 2][0] for k in sorted(held)]
    assert middle == sorted(middle)  # inside a window too
    assert packing.pack_in_order(df.limit(0), "w", "p").count() == 0


def test_the_pipelines_order_reaches_packing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_ROWS", 50)
    rows = [(i, "word " * (i % 50 + 100), "en", "a", 0) for i in range(400)]
    spark.createDataFrame(rows, DOCS).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/d")
    stage = dict(corpus_pipeline.STAGES)["packing"]
    got = stage(spark, spark.read.parquet(f"{tmp_path}/d"), D).collect()
    check_packing(got, [r[:2] for r in rows], tokenizer(packing.FILE).library)
    place = sorted((r["sequence_id"], r["doc_id"]) for r in got)
    far = max(abs(d - sorted(r["doc_id"] for r in got)[k]) for k, (_, d) in enumerate(place))
    assert far <= 50  # nothing leaves its window
    assert stage(spark, spark.createDataFrame(rows[:5], DOCS), D).count() == 5


# 7 language id


def test_langid_query(spark):
    lang = texts(column="lang")
    got = langid.op7_langid(spark, D).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_scores_are_those_of_naive_bayes(spark):
    """Priors, counts and scores worked out by hand from the n-grams of the training texts."""
    rows = [(i, t, x) for i, (t, x) in enumerate([("Der Hund, ein Tier!", "de"), ("das Haus", "de"), ("the dog", "en"), ("A HOUSE and 2 dogs", "en"), ("le chien", "fr"), (None, "fr"), ("x", None)])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        c = [ord(x) if x.isalpha() else 32 for x in f" {text.lower()} "]
        m = 2**32
        for i in range(len(c) - 1):
            two = (c[i] * 0x9E3779B1 + c[i + 1] * 0x85EBCA6B) % m
            yield (two * 0x165667B1 % m) >> 32 - langid.BITS
            if i + 2 < len(c):
                three = ((two ^ two >> 15) * 0xC2B2AE35 + c[i + 2] * 0x27D4EB2F) % m
                yield (three * 0x9E3779B1 % m) >> 32 - langid.BITS

    held = {x: Counter(g for _, t, y in rows if t and y == x for g in grams(t)) for x in ("de", "en", "fr")}
    for text in ("ein Haus", "dogs — and\nthe house", "chien", "Ωmega 漢字", "a"):
        want = [math.log(n / 5) + sum(math.log((held[x][g] + 0.5) / (sum(held[x].values()) + 0.5 * 2**langid.BITS)) for g in grams(text)) for x, n in (("de", 2), ("en", 2), ("fr", 1))]
        lang, score = model.predict(text)
        assert lang == ("de", "en", "fr")[int(np.argmax(want))] and score == pytest.approx(1 / sum(math.exp(w - max(want)) for w in want), rel=1e-4)
    many = [r[1] for r in rows] * 50 + ["long " * 30_000, "", "é"]
    assert model.predict_all(many) == [model.predict(t) for t in many]


def test_sample_of_rows_without_ids_is_bounded(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text number ', id, ' of many') AS text", "'en' AS lang")
    few, all_ = langid.train(df, train_rows=300), langid.train(df, train_rows=3000)
    at = next(langid.buckets("of"))[0]
    assert few.matrix.shape == all_.matrix.shape and not (few.matrix == all_.matrix).all() and few.langs == ["en"] and np.isfinite(few.matrix[at]).all()
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.range(4).selectExpr("id AS doc_id", "'t' AS text", "string(id) AS lang"))


def test_langid_odd_rows(spark, odd):
    model = langid.train(odd)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 6)] == ["und"] * 3 and got[5]["lang_pred"] == "fr" and got[5]["kept"] == "mine"
    empty = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert [model.predict(t)[0] == "und" for t in ("½ ² 12 _", "12 ß", "漢")] == [True, False, False]


def test_ngrams_of_blocks_are_those_of_the_whole(monkeypatch):
    text = "The quick-brown fox, ÉTÉ 12 " * 40
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "_BLOCK", 97)
    assert (np.sort(np.concatenate(list(langid.buckets(text)))) == whole).all()


# 8 quality


def test_quality_odd_rows(spark, odd):
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"] and by[5]["n_words"] == 60_000 == by[5]["n_repeat_words"]
    assert quality.judge(odd.limit(0)).count() == 0 and quality.clean(odd).columns == odd.columns


def test_boilerplate_goes_and_clean_lines_stay(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, f"Cookie  NOTICE here\n{own(i)}", "en", "s", 0) for i in range(60)] + [(100 + i, "cookie notice here\nu%d" % i + " z" * 2, "en", "s", 0) for i in range(5)] + [(200, own(200), "en", "s", 0), (201, own(200), "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    assert set(out) == {*range(60), 200, 201} and all(out[i] == own(i) for i in range(60)) and out[200] == own(200)


def test_pipeline_catches_repeated_lines_in_hosts_of_any_size(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, ("Share this page\n" if i < 30 else "") + own(i), "en", "hot", 0) for i in range(4000)]
    rows += [(5000 + i, ("share THIS page\n" if i < 11 else "once\n" if i < 15 else "") + own(5000 + i), "en", "small", 0) for i in range(50)]
    stage = dict(corpus_pipeline.STAGES)["quality rules"]
    out = {r["doc_id"]: r["text"] for r in stage(spark, spark.createDataFrame(rows, DOCS), D).collect()}
    assert set(out) == {r[0] for r in rows} and not any("page" in t.lower() for t in out.values())
    assert sum("once" in t for t in out.values()) == 4


# 9 embeddings


def test_embeddings_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 8))
    near = [(base[i] + 0.05 * rng.standard_normal(8)).tolist() for i in range(30) for _ in range(4)]
    vecs = [*base.tolist(), *near, near[0], None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]]
    rows = [*((i, v) for i, v in enumerate(vecs)), (None, near[0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    link = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.95} for i in ok}
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            continue
        seen, todo = {r["vec_id"]}, [r["vec_id"]]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (r["n_links"], r["component_id"]) == (len(link.get(r["vec_id"], ())), min(seen)), r
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_links(rows):
    """[(id, vector)]: links and component of each place."""
    v = np.array([x for _, x in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    least = np.array([i for i, _ in rows])
    for _ in rows:
        least = np.minimum(least, np.where(near, least[None], 10**9).min(1))
    return near.sum(1), least


@pytest.mark.parametrize("limits", [{}, {"hot": 3, "block": 5}, {"hot": 0, "block": 1000}])
def test_repeated_ids_and_hot_filters(spark, limits):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = [(i, base[i % 12] + 0.09 * rng.standard_normal(16)) for i in range(120)]
    rows += [(i, base[i % 12] + 0.05 * rng.standard_normal(16)) for i in range(40)] + rows[:5] + [(200, rows[3][1]), (3, -base[0]), (7, -base[0] * 2)]
    df = spark.createDataFrame([(i, v.tolist(), "mine", 1) for i, v in rows], "vec_id long, embedding array<float>, kept string, id int")
    n, least = brute_links([(i, v.tolist()) for i, v in rows])
    want = Counter((i, int(k), int(c)) for (i, _), k, c in zip(rows, n, least, strict=True))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, **limits).collect()) == want


@pytest.mark.parametrize("size", [64, 640, 2000, 8945])  # directions for 500, 51,200, 500,000 and ten million vectors
def test_recall_just_above_the_threshold(size):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 150, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    cos = rng.uniform(0.95, 0.96, (150, 1))
    b = cos * a + np.sqrt(1 - cos**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    passes, met = embed_dedup.passes_for(size), np.zeros(150, bool)
    for k in range(embed_dedup.CODES):
        rotation, code = embed_dedup.directions(64, size, embed_dedup.SEED, k)
        tau = embed_dedup.threshold_for(code, passes)
        met |= [len(np.intersect1d(x, y)) > 0 for x, y in zip(*(embed_dedup.decode(x @ rotation, code, tau, round(passes)) for x in (a, b)), strict=True)]
    assert met.all()


def test_near_vectors_share_filters_at_the_size_of_millions():
    rng, size = np.random.default_rng(3), 8945  # the directions for ten million vectors
    a, b = rng.standard_normal((2, 200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    passes, shared = embed_dedup.passes_for(size), np.zeros(200)
    for k in range(embed_dedup.CODES):
        rotation, code = embed_dedup.directions(64, size, embed_dedup.SEED, k)
        tau = embed_dedup.threshold_for(code, passes)
        both = zip(*(embed_dedup.decode(x @ rotation, code, tau, round(passes)) for x in (a, b)), strict=True)
        shared += [len(np.intersect1d(x, y)) for x, y in both]
    assert shared.min() >= 8 and embed_dedup.passes_for(64) == embed_dedup.PASSES


# 10 pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return [[m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in PATTERNS.items()]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    pool = list("a1.@-+ ()9_%é\n") + ["1.2.3.4", "255", "@x.y", "4242 4242 4242 4242", "+1 (", "0", "999"]
    for _ in range(4000):
        s = "".join(rng.choices(pool, k=rng.randrange(25)))
        assert pii.base_spans(s) == brute_spans(s), s
    for s in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+" * 100_000, "@" * 100_000):
        pii.candidates(s, pii.base_spans(s))  # linear in time


def test_pii_query(spark):
    rows = texts()
    got = {r["doc_id"]: r for r in pii.op10_pii(spark, D).collect()}
    assert set(got) == set(rows)
    secrets = {i: len(re.findall(r"password=|token = ", t)) for i, t in rows.items()}
    for i, t in rows.items():
        spans = brute_spans(t)
        base = ",".join(f"{k}:{s}:{e}" for k, own in zip(PATTERNS, spans, strict=True) for s, e in own)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[i]["spans"].startswith(base)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == list(map(len, spans))
        assert got[i]["spans"].count("secret:") == secrets[i]


def test_redaction(spark, odd):
    out = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert out[7] == "mail me at [EMAIL] or [PHONE], password=[SECRET]" and out[1] is None and out[3] == "one two" and out[5] == ODD[5][1]
    assert pii.spans(odd.limit(0)).count() == 0 and pii.redact(odd).columns == odd.columns


def planted(secrets, seed=1):
    """Texts with codes that are no secrets, many of them labelled, and with secrets: (text, start, end, is secret)."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexed, upper, both = "0123456789abcdef", common.UPPER, common.UPPER + common.LOWER + "0123456789"
    day = lambda: f"20{rng.randrange(10, 25)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
    out = []

    def add(before, code, after, secret):
        out.append((before + code + after, len(before), len(before) + len(code), secret))

    for _ in range(900):
        add("buy sku: ", pick(upper, 2) + pick("0123456789", 8) + pick(upper, 4), " now", False)
    for _ in range(600):
        add("build id=", day() + pick(hexed, 4), " passed", False)
    for _ in range(300):
        add("posted ", "2024-05-06", " by us", False)
        add("see ", "post-" + pick("123456789", 5) + "-on-things", " there", False)
    for _ in range(200):
        add("commit ", pick(hexed, 40), " merged", False)
        add("checksum: ", pick(hexed, 32), ".", False)
    for _ in range(secrets):
        add(rng.choice(["password=", 'token = "', "api_key: ", "secret='"]), rng.choice([pick(hexed, 16), pick(hexed, 40), pick(both, 20), "hunter2", "correcthorsebattery", pick(both, 12)]), rng.choice(['"', "'", " "]), True)
    return out


@pytest.mark.parametrize("secrets", [0, 5, 50, 800])
def test_labelled_codes_are_no_secrets(secrets):
    rows, counts = [], Counter()
    for text, start, end, true in planted(secrets):
        found = pii.candidates(text, pii.base_spans(text))
        assert (start, end) in [f[:2] for f in found] and len(found) == 1, text
        counts[found[0][2]] += 1
        rows.append((found[0][2], true))
    accepted = pii.Model(dict(counts)).accepted
    said = [code in accepted for code, _ in rows]
    right = sum(x and true for x, (_, true) in zip(said, rows, strict=True))
    assert right >= 0.98 * secrets and sum(said) - right <= 0.01 * max(secrets, 1)


def test_frames_of_many_values_number_things(spark):
    """Ordinary words after a secret's name, all but the digits alike, are no secrets; those that are stay ones, in the same texts' corpus."""
    rows = [f"the next token: word{i:05d} and so on" for i in range(5000)] + [f"his password={x}, keep it" for x in ("hunter2", "correcthorsebattery", "k9Qx7Lw2Zp4T", "9f86d081884c7d65")] * 5
    rows += [t for t, *_ in planted(50)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    assert len(got) == len(rows) and sum("secret" in got[i] for i in range(5000)) == 0
    assert all("secret:13:" in got[i] for i in range(5000, 5020))
    truth = [x[3] for x in planted(50)]
    said = ["secret" in got[5020 + i] for i in range(len(truth))]
    assert sum(a and b for a, b in zip(said, truth, strict=True)) >= 49 and sum(a and not b for a, b in zip(said, truth, strict=True)) == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[17] == rows[17] and out[5000] == "his password=[SECRET], keep it" and out[len(rows) - 2] is None


def test_frames():
    at = lambda t, run: pii.frame_of(t, t.index(run), t.index(run) + len(run))
    one, two = at("The NEXT token: word01234", "word01234"), at("the next token: word98765", "word98765")
    assert one[0] == two[0] and one[1] != two[1] and at("the next token: word123", "word123")[0] != one[0] and at("a new token: word01234", "word01234")[0] != one[0]
    assert at("token = 9f86d081884c7d65", "9f86d081884c7d65") is None and at("x 12345678", "12345678") is None and at("x=correcthorse", "correcthorse") is None
    assert pii.frame_of("a" * 200_000 + "1" * 200_000, 0, 400_000) is not None and pii.frame_of("a1" * 200_000, 0, 400_000) is None


def test_classifier_is_the_ridge_solution():
    """The gradient of the penalised likelihood, summed up one code at a time, is zero at the weights; what they accept is where the score is positive."""
    counts = Counter(pii.candidates(t, [[], [], [], []])[0][2] for t, *_ in planted(60, 3))
    model = pii.Model(dict(counts))
    codes = sorted(counts)
    p, _, _ = pii.posteriors(np.array([pii.votes(c) for c in codes]), np.array([counts[c] for c in codes], float))
    gradient = [-pii.RIDGE * w for w in model.weights]
    for c, own in zip(codes, p, strict=True):
        x = pii.Model.features(c)
        score = sum(w * v for w, v in zip(model.weights, x, strict=True))
        for k, v in enumerate(x):
            gradient[k] += counts[c] * (own - 1 / (1 + math.exp(-score))) * v
        assert (c in model.accepted) == (score >= 0)
    assert max(map(abs, gradient)) < 1e-3


def test_posteriors_are_those_of_em():
    """One labeler and one vote at a time, in plain Python."""
    counts = Counter(pii.candidates(t, [[], [], [], []])[0][2] for t, *_ in planted(60, 2))
    patterns = Counter()
    for c, n in counts.items():
        patterns[pii.votes(c)] += n
    total = sum(patterns.values())
    belief = {y: [list(pii.ANCHORS[x][y]) for x in pii.LABELERS] for y in (0, 1)}
    clip = lambda x: min(max(x, 0.001), 0.999)
    rates, prior = {y: [[clip(b) for b in row] for row in belief[y]] for y in (0, 1)}, pii.PRIOR
    for _ in range(51):
        p = {}
        for v in patterns:
            like = [math.prod(rates[y][k][x] for k, x in enumerate(v)) * (prior if y else 1 - prior) for y in (0, 1)]
            p[v] = like[1] / sum(like)
        prior = (sum(n * p[v] for v, n in patterns.items()) / total + pii.PRIOR_WEIGHT * pii.PRIOR) / (1 + pii.PRIOR_WEIGHT)
        for y in (0, 1):
            own = {v: n * (p[v] if y else 1 - p[v]) for v, n in patterns.items()}
            mass = sum(own.values())
            for k, name in enumerate(pii.LABELERS):
                weight = pii.ANCHORS[name][2] * (mass + 1)
                rates[y][k] = [clip((sum(n for v, n in own.items() if v[k] == x) + weight * belief[y][k][x]) / (mass + weight)) for x in range(3)]
    votes = list(patterns)
    got, gave, told = pii.posteriors(np.array(votes), np.array([patterns[v] for v in votes], float))
    assert got == pytest.approx([p[v] for v in votes], abs=1e-6) and gave == pytest.approx(prior, abs=1e-9)
    assert np.allclose(told, [rates[0], rates[1]], atol=1e-9)


def test_named_values():
    find = lambda t: [t[s:e] for s, e in pii.named_values(t)]
    assert find("password=hunter2. Then") == ["hunter2"] and find("Passwd : 'correcthorsebattery'") == ["correcthorsebattery"]
    assert find("the password is long; token: yes; x=abcdefgh") == [] and find("secret==abcdef api_key=> zyxwvu9") == ["abcdef", "zyxwvu9"]
    text = "password=joe@example.com and pwd=12345678"
    assert [text[s:e] for s, e, _ in pii.candidates(text, pii.base_spans(text))] == ["12345678"]
    for s in ("password=" * 30_000, "=" * 200_000, "password=" + "a" * 200_000, "token:" + " " * 200_000):
        pii.candidates(s, pii.base_spans(s))  # linear in time


def test_pii_spans_of_odd_rows(spark, odd):
    got = [r for r in pii.spans(odd).collect()]
    assert len(got) == len(ODD) and Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    by = {r["doc_id"]: r["spans"] for r in got}
    assert by[1] == by[2] == by[3] == by[5] == "" and by[7] == "email:11:19,phone:23:40,secret:51:69"


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, D), "stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for n, df in seen.items()}
    kept = {r["doc_id"] for r in quality.op8_quality(spark, D).where("kept").select("doc_id").collect()}
    assert set(ids["quality rules"]) == kept
    rows = seen["quality rules"].select("doc_id", "text").collect()
    groups = jaccard_components(rows)
    assert ids["simhash near-dedup"] == Counter(min(rows[i][0] for i in g) for g in groups)
    assert ids["pii"] == ids["simhash near-dedup"]
    clean = dict(map(tuple, seen["pii"].select("doc_id", "text").collect()))
    assert not any(any(brute_spans(t)) for t in clean.values())
    assert set(ids["mixing"]) == set(ids["pii"])
    mixed = seen["mixing"].collect()
    check_packing_rows = Counter()
    for r in seen["packing"].collect():
        check_packing_rows[r["doc_id"]] += r["length"]
    t = tokenizer(packing.FILE).library
    n = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in clean.items()}
    assert check_packing_rows == Counter({i: n[i] * k for i, k in Counter(r["doc_id"] for r in mixed).items()})


def test_pipeline_on_odd_rows(spark, odd):
    own = " ".join(f"w{k}" for k in range(20))
    more = [(None, own, "en", None, 1), (None, own, "en", None, 1), (9, own + " and more words that differ at all of it from what the others hold", None, "a", None), (9, "x " + " ".join(f"v{k}" for k in range(15)), "en", "b", 0)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0
        docs = common.materialise(stage(spark, docs, D), "stage")
        seen[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert seen["quality rules"] == Counter({None: 2, 9: 2}) and seen["simhash near-dedup"] == seen["pii"] == Counter({None: 1, 9: 2})
    assert set(seen["mixing"]) == set(seen["packing"]) == {None, 9} and corpus_pipeline.run(spark, D).columns == docs.columns


def test_ranks_shuffle_the_rows_once(spark):
    """Groups may be null; ranks of each go from 0 up, and rows with their texts pass one exchange, the counts three."""
    from quillstone.llm.common import ranked

    df = spark.range(0, 300, 1, 3).selectExpr("id AS doc_id", "if(id % 3 = 0, null, concat('s', id % 3)) AS source", "repeat('x', 50) AS text")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ranked(df, ["source"], ["doc_id"], 300, bucket_rows=20)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        got = out.groupBy("source").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {r["source"] for r in got} == {None, "s1", "s2"} and all(r["r"] == list(range(100)) for r in got)
