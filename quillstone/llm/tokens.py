"""Token ids of the public tokenizers, fast and the same as their own libraries give."""

from __future__ import annotations

import json
import re

import numpy as np

from quillstone.llm.common import kept

#: Texts of these characters alone take the fast way: ASCII without rare controls, and Latin-1's letters.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
#: Pre-tokens of lower-cased plain text, as the tokenizer file's own pattern splits it.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: Pre-tokens go to the encoder in blocks of so many, which bounds the memory of a very long text.
_BLOCK = 50_000


def _byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Ids of a word-level BPE file whose last symbol of a word carries ``</w>``.

    The library spends most of its time on offsets and strings that aren't asked for. Here the end of a word becomes
    a space byte, so that the vocabulary is a plain table of byte strings by rank for another BPE encoder; ids are
    the same, since a symbol with its end mark ranks below all merges and so is joined first. Texts with other
    characters, or with what may be a special token, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self._library = path, None
        symbols, end, ranks = _byte_symbols(), "</w>", {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        for token, i in vocab.items():
            if token.startswith("<|"):
                continue
            last = token.endswith(end) and len(token) > len(end)
            ranks[bytes(symbols[c] for c in (token[: -len(end)] if last else token)) + b" " * last] = i
        self.fast = tiktoken.Encoding("word_bpe", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        """The library's tokenizer, loaded when the first text needs it: it takes as much memory again."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.match(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        words = _PRE.findall(text.lower())
        parts = [self.fast.encode_to_numpy(" ".join(words[i : i + _BLOCK]) + " ", disallowed_special=()) for i in range(0, len(words), _BLOCK)]
        return np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.zeros(0, np.uint32)


class Pieces:
    """Ids of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.uint32)


def tokenizer(name: str, folder: str | None = None):
    """The tokenizer of a vocabulary file, loaded once in a process. ``folder``: where the files are; else the installed package's."""

    def load():
        if folder is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        else:
            path = f"{folder}/{name}"
        return (Pieces if name.endswith(".model") else WordBpe)(str(path))

    return kept(f"tokenizer {name} {folder}", load)
