"""Chunks by tokens: against one-by-one packing, an independent count, and the words that went in."""

import random

import public_tokenizers
import pytest

from quillstone.operators import articles as A
from quillstone.operators import token_chunks as C

BLOCKS = "doc_key string, pos int, kind string, heading string, text string"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module", params=FILES)
def file(request):
    return public_tokenizers.path(request.param)


def encoder(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def chunks(spark, data, file, most):
    got = C.token_chunks(spark.createDataFrame(data, BLOCKS).repartition(3), file, most).collect()
    return sorted(got, key=lambda r: (r["doc_key"] or "", r["chunk"]))


def made(rng, n):
    word = lambda: "".join(rng.choices("abcdefghij ééß中文🙂-.'0123"[:rng.choice([10, 24])].replace(" ", ""), k=rng.randrange(1, 12)))
    return " ".join(word() for _ in range(n))


def test_every_chunk_fits_and_all_words_are_kept_in_order(spark, file):
    rng, of = random.Random(4), encoder(file)
    data = [(f"d{d}", p, "text", f"A {d} > part {p // 5}", made(rng, rng.choice([1, 5, 30, 400]))) for d in range(6) for p in range(14)]
    data.append(("long", 0, "text", "H", "x1-é" * 3000 + " and " + "word " * 2000))
    got = chunks(spark, data, file, 48)
    for r in got:
        n = len(of.encode(r["text"], add_special_tokens=False).ids) + of.num_special_tokens_to_add(False)
        assert n == r["tokens"] <= 48
    for key in {d[0] for d in data}:
        own = [r for r in got if r["doc_key"] == key]
        assert [r["chunk"] for r in own] == list(range(len(own)))
        body = "".join(r["text"].removeprefix(r["heading"].replace(" > ", "\n") + "\n") for r in own)
        assert "".join(body.split()) == "".join("".join(t.split()) for k, _, _, _, t in data if k == key)


def test_paragraphs_are_merged_as_long_as_they_fit(spark, file):
    rng, of = random.Random(8), encoder(file)
    count = lambda t: len(of.encode(t, add_special_tokens=False).ids) + of.num_special_tokens_to_add(False)
    data = [(f"d{d}", p, "text", rng.choice(["One", "One > Two"]) if p % 4 == 0 else "One", " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 20)))) for d in range(5) for p in range(20)]
    want = []
    for key in sorted({d[0] for d in data}):
        heading, n = None, 0
        for _, _, _, h, t in [d for d in data if d[0] == key]:
            joined = want[-1][3] + "\n" + t if n and h == heading else ""
            if joined and count(joined) <= 64:
                want[-1] = (key, n - 1, h, joined)
            else:
                want.append((key, n, h, h.replace(" > ", "\n") + "\n" + t))
                heading, n = h, n + 1
    assert [(r["doc_key"], r["chunk"], r["heading"], r["text"]) for r in chunks(spark, data, file, 64)] == want


def test_what_is_left_out_and_odd_rows(spark, file):
    data = [(None, 0, "text", None, "of no paper"), ("a", 0, "text", None, "x"), ("a", 0, "text", None, "x"), ("a", 1, "figure", "H", "a figure"), ("a", 2, "text", "References", "left out"), ("a", 3, "text", "H", None), ("a", 4, "text", "H", " \n\t"),
            ("a", 5, "text", " > ".join(["a very long heading of many words"] * 20), "b  \n c"), ("a", 6, "text", "word " * 400, "d"), ("a", 7, "text", "", "<|endoftext|>")]
    got = [(r["doc_key"], r["chunk"], r["text"].split("\n")[-1]) for r in chunks(spark, data, file, 40)]
    assert got == [(None, 0, "of no paper"), ("a", 0, "x"), ("a", 1, "b c"), ("a", 2, "d"), ("a", 3, "<|endoftext|>")]
    assert chunks(spark, [], file, 40) == []
    with pytest.raises(ValueError, match="at least"):
        chunks(spark, data, file, 8)


def test_a_tokenizer_that_counts_more_for_the_whole_is_not_taken_on_trust():
    m = C.Measure(open(public_tokenizers.path(FILES[0]), encoding="utf-8").read(), 40)
    counts = m.counts
    m.counts = lambda texts: [n + 9 * t.strip().count("\n") for n, t in zip(counts(texts), texts, strict=True)]
    got = list(C.packed([("a", "", f"word{i} word", 4) for i in range(30)], m))
    assert all(r[3] <= 40 for r in got) and " ".join(r[4] for r in got).split() == [w for i in range(30) for w in (f"word{i}", "word")]


def test_rows_of_a_library_by_tokens(spark):
    file = public_tokenizers.path(FILES[0])
    blocks = spark.createDataFrame([("p", i, "text", "Intro", "hyphen-ated1234 words " * 90) for i in range(9)], BLOCKS)
    papers = spark.createDataFrame([("p", "1", "A title", ["t"], "An abstract.")], "doc_key string, pmid string, title string, tags array<string>, abstract string")
    got = A.library_rows(blocks, papers, "none", file).where("type = 'text'").collect()
    assert len(got) > 5 and all(len(encoder(file).encode(r["text"]).ids) <= 512 for r in got)
    assert sorted(r["id"] for r in got) == sorted(f"p::text::{i}" for i in range(len(got)))


def test_no_key_is_gathered(spark):
    df = C.token_chunks(spark.createDataFrame([], BLOCKS), public_tokenizers.path(FILES[0]), 64)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Exchange") == 1
    assert A.words_for("none") == 384


def test_words_are_counted_once_and_as_the_tokenizer_counts_texts(file):
    rng, of, definition = random.Random(5), encoder(file), open(file, encoding="utf-8").read()
    m = C.Measure(definition, 64, C.ranked(definition))
    asked, encoded = [], m.encoded
    m.encoded = lambda texts: asked.extend(texts) or encoded(texts)
    plain = ["\nthe don't 12 x-1's word, " + "word 'tis\nÉté " * 400 + "end"]
    assert m.counts(plain) == m.counts(plain * 3)[1:2] == [len(of.encode(plain[0], add_special_tokens=False).ids)]
    assert len(asked) < 20 and max(map(len, asked), default=0) < 20  # no text is encoded whole
    of.encode_special_tokens = True
    odd = ["".join(rng.choices("ab é ß \n\t  ́\u0085\x1cΣσ1'st中.🙂᠎​　  <|endoftext|>", k=rng.randrange(30))) for _ in range(3000)] + ["", " ", "\n", " \n", "a ", "a  b"]
    assert m.counts(odd) == [len(e.ids) for e in of.encode_batch(odd, add_special_tokens=False)]


def test_only_vocabularies_that_tell_their_merges_are_ranked():
    import json

    rules = json.load(open(public_tokenizers.path(FILES[0]), encoding="utf-8"))
    assert C.ranked(json.dumps(rules)) and not C.ranked(open(public_tokenizers.path(FILES[1]), encoding="utf-8").read())
    merges = rules["model"]["merges"]
    rules["model"]["merges"] = [*merges[:9], merges[10], merges[9], *merges[11:]]
    assert not C.ranked(json.dumps(rules))
