"""Chunks measured in the model's own tokens: neighbouring paragraphs under one heading, merged as long as they fit.

Paragraphs are dealt to tasks by paper and read there in order; a task holds the chunk that it fills and the batch of paragraphs that it measures, never
a whole paper. The tokenizer is a file of the ``tokenizers`` library; the driver reads it once, and each worker makes it once a task.

A paragraph goes to the open chunk if it fits, else to a new one; a paragraph that fits in none is cut between words, a word that fits in none between characters.
What is counted is a paragraph with the white space before it. Tokenizers that never merge across white space (byte-level and word-end BPE, WordPiece) then
give the chunk exactly the sum. No chunk is taken on trust, though: one that the tokenizer counts beyond the limit is cut again.

Texts hold the same words over and over. Of tokenizers whose rules are among ``APART``, a task asks for each word once and adds up what it remembers; a text with
white space other than single spaces and line breaks between words, and any text of other tokenizers, is encoded whole. The counts are the same.

Defined results: blank and null paragraphs and skipped sections are left out, and white space within a paragraph is one space. Special tokens that the
tokenizer adds count. Headings stand in front, the outermost going first while they take more than half of the limit. A null heading is like none. A null
paper is a paper; paragraphs with equal ``pos`` come in order of their text.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

#: Paragraphs are measured so many at a time; the least limit leaves room for any character beside headings and special tokens.
MEASURED, LEAST = 256, 32
#: A piece of a word has at most so many characters for each token of its room.
MOST_CHARS = 32
_CASES = r"'s|'t|'re|'ve|'m|'ll|'d"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Normalizers and pre-tokenizers of BPE files under which no token, and nothing that decides on one, reaches over a space or line break before a word.
APART = [
    (None, BYTES),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _CASES + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, BYTES | {"use_regex": False}]},
    ),
]
#: How byte-level files part a text (fixed pattern); a word with what stands before it, or white space without a word; words of printable ASCII and Latin-1's letters.
_PARTS = _CASES + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD, _PLAIN = re.compile(r"[ \n]?[^ \n]+|[ \n]+"), re.compile(r"[ \n]?[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: A task remembers words of so many characters, each counting WORD more.
REMEMBERED, WORD = 1 << 26, 100
CHUNKS = "doc_key string, chunk long, heading string, tokens int, text string"


def _apart(rules: dict) -> bool:
    """Whether words are counted apart under a file's rules."""
    model = rules["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and all(t.get("special") for t in rules.get("added_tokens") or [])
    return plain and (rules.get("normalizer"), rules.get("pre_tokenizer")) in APART


def ranked(definition: str) -> bool:
    """Whether a byte-level file's merges are told by its vocabulary: each merge has a token of its own, in their order, and each token by itself ends as that token.

    Then symbols that together are a token were always its merge's, so an encoder that joins by the rank of the outcome gives the same tokens.
    """
    rules = json.loads(definition)
    model = rules["model"]
    if not _apart(rules) or rules["pre_tokenizer"] != BYTES or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    from tokenizers import Tokenizer

    vocab, special = model["vocab"], {t["content"] for t in rules.get("added_tokens") or []}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    own = {t: i for t, i in vocab.items() if t not in special}
    if len(own) != 256 + len(made) or any(i >= k for i, k in zip(made, made[1:], strict=False)) or max(i for t, i in own.items() if len(t) == 1) >= made[0]:
        return False
    bare = Tokenizer.from_str(json.dumps(rules | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None}))
    return all(e.ids == [i] for e, i in zip(bare.encode_batch_fast([*own], add_special_tokens=False), own.values(), strict=True))


def _by_rank(rules: dict):
    """An encoder of plain words for a file that is ``ranked``."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves, the rest follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in rules.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in t): i for t, i in rules["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("words", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Tokens of words, each asked for when it is first met; infinite: white space that may be one token with what is beside it."""

    def __init__(self, measure: Measure):
        self.measure, self.size = measure, 0

    def __missing__(self, word: str) -> float:
        if self.measure.fast and _PLAIN.fullmatch(word):
            n = len(self.measure.fast.encode_ordinary(word))
        else:
            n = math.inf if any(map(str.isspace, word[1:])) else self.measure.encoded([word])[0]
        self[word] = n
        self.size += len(word) + WORD
        return n


class Measure:
    """Counts tokens, and cuts texts to a number of them. ``by_rank``: what ``ranked`` says of the definition."""

    def __init__(self, definition: str, most: int, by_rank: bool = False):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_str(definition)
        self.of.no_truncation()
        self.of.no_padding()
        self.of.encode_special_tokens = True  # their names in a text are text
        self.most = most
        self.special = self.of.num_special_tokens_to_add(False)
        rules = json.loads(definition)
        self.apart = _apart(rules)
        self.fast = _by_rank(rules) if by_rank else None
        self.known = Words(self)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def recall(self) -> Words:
        if self.known.size > REMEMBERED:
            self.known = Words(self)
        return self.known

    def apart_of(self, words: list[str]) -> list[int] | None:
        """Tokens of each word of a text, with what stands before it; None where they don't add up to the text's."""
        if not self.apart:
            return None
        n = [*map(self.recall().__getitem__, words)]
        return None if math.inf in n else n

    def counts(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.encoded(texts)
        of = self.recall().__getitem__
        sums = [sum(map(of, _WORD.findall(t))) for t in texts]
        whole = iter(self.encoded([t for t, n in zip(texts, sums, strict=True) if n == math.inf]))
        return [next(whole) if n == math.inf else n for n in sums]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def head(self, heading: str) -> tuple[str, int]:
        """The headings that stand in front of a chunk, and their tokens."""
        path = [p for p in heading.split(" > ") if p.strip()]
        while path:
            lines = "\n".join(path)
            if 2 * (n := self.count(lines)) <= self.most:
                return lines, n
            path = path[1:]
        return "", 0

    def fitting(self, text: str, budget: int) -> int:
        """How many characters from the text's begin make at most ``budget`` tokens, by what it counts for them; at least one."""
        text = text[: MOST_CHARS * budget]  # so that a word of any length is read once, not once for each piece
        ends = [e for _, e in self.of.encode(text, add_special_tokens=False).offsets]
        at = ends[min(budget, len(ends)) - 1] if ends else len(text)
        while at > 1 and self.count(text[:at]) > budget:
            at -= max(1, at // 16)
        return max(1, at)

    def pieces(self, paragraph: str, budget: int) -> Iterator[tuple[str, int]]:
        """A long paragraph's pieces, each with its tokens behind a line break: whole words as far as they fit."""
        words = paragraph.split(" ")
        n = self.apart_of([f" {w}" for w in words])
        adds = n is not None
        n = n if adds else self.counts([f" {w}" for w in words])
        joined = lambda at, end: self.count("\n" + words[at]) + sum(n[at + 1 : end]) if adds else self.count("\n" + " ".join(words[at:end]))
        at = 0
        while at < len(words):
            end, used = at, 0
            while end < len(words) and used + n[end] <= budget:
                used += n[end]
                end += 1
            while end > at and (used := joined(at, end)) > budget:
                end -= 1
            if end > at:
                yield " ".join(words[at:end]), used
                at = end
            else:  # a word that is too long by itself
                k = max(1, self.fitting("\n" + words[at], budget) - 1)
                piece, rest = words[at][:k], words[at][k:]
                yield piece, self.count("\n" + piece)
                words[at : at + 1] = [rest] if rest else []
                n[at : at + 1] = [] if not rest else self.counts([f" {rest}"]) if len(rest) <= MOST_CHARS * budget else [budget + 1]


def packed(paragraphs: Iterable[tuple[str | None, str, str, int]], measure: Measure) -> Iterator[tuple[str | None, int, str, int, str]]:
    """(doc_key, chunk, heading, tokens, text) of paragraphs (doc_key, heading, text, tokens) in order, a paper's side by side."""
    run, paper, number = None, object(), 0
    lines, used, head, room = [], 0, "", 0

    def settled(some: list[str]) -> Iterator[tuple[str, int]]:
        """The lines as a chunk, or as several if the tokenizer counts more for it than for its parts."""
        if not some:
            return
        text = "\n".join([head, *some] if head else some)
        n = measure.count(text) + measure.special
        if n <= measure.most or (len(some) == 1 and len(some[0]) == 1):
            yield text, n
            return
        if len(some) == 1:
            at = some[0].rfind(" ", 1, len(some[0]) // 2 + 1)
            some = [some[0][:at], some[0][at + 1 :]] if at > 0 else [some[0][: len(some[0]) // 2], some[0][len(some[0]) // 2 :]]
        yield from settled(some[: len(some) // 2])
        yield from settled(some[len(some) // 2 :])

    def whole() -> Iterator[tuple]:
        nonlocal lines, used, number
        for text, n in settled(lines):
            yield run[0], number, run[1], n, text
            number += 1
        lines, used = [], 0

    for key, heading, text, n in paragraphs:
        if run != (key, heading):
            yield from whole()
            if paper != key:
                paper, number = key, 0
            run = (key, heading)
            head, taken = measure.head(heading)
            room = measure.most - measure.special - taken
        for piece, size in [(text, n)] if n <= room else measure.pieces(text, room):
            if used + size > room:
                yield from whole()
            lines.append(piece)
            used += size
    yield from whole()


def token_chunks(blocks: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """(doc_key, chunk, heading, tokens, text) of blocks (doc_key, pos, kind, heading, text): chunks of at most ``most`` tokens, special ones counted.

    ``tokenizer``: the path of its file on the driver.
    """
    if most < LEAST:
        raise ValueError(f"a chunk takes at least {LEAST} tokens")
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    by_rank = ranked(definition)
    squashed = F.trim(F.regexp_replace("text", r"\s+", " "))
    kept = blocks.where((F.col("kind") == "text") & ~X.skipped_section(F.col("heading")))
    kept = kept.select("doc_key", "pos", F.coalesce("heading", F.lit("")).alias("heading"), squashed.alias("text")).where("text <> ''")

    def rows(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        measure = Measure(definition, most, by_rank)

        def measured():
            for b in batches:
                for at in range(0, b.num_rows, MEASURED):
                    some = b.slice(at, MEASURED)
                    texts = some.column(2).to_pylist()
                    yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts, measure.counts([f"\n{t}" for t in texts]), strict=True)

        out: list[tuple] = []
        for one in packed(measured(), measure):
            out.append(one)
            if len(out) == MEASURED:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out):
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    ordered = kept.repartition("doc_key").sortWithinPartitions("doc_key", "pos", "text").select("doc_key", "heading", "text")
    return ordered.mapInArrow(rows, CHUNKS)
