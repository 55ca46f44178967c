"""Token ids as the tokenizers library gives them, at several times its speed.

Text of common characters is merged by tiktoken's byte-pair core, which is loaded with the merges of the same file: whole
for a byte-level vocabulary, word by word for one with word ends, whose words come from a cache bounded in entries and in
bytes. Words with other characters go to the tokenizers library: a text is cut for it at single spaces, where both supported
kinds of pre-tokenizer always cut too. A text for which that is not safe (white space next to white space, control
characters, or the string of a special token) goes there whole. Tests hold the ids against the tokenizers library's own.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import groupby

import numpy as np
import regex

COMMON = "ɐ"  # below: characters that normalisation to NFC leaves alone and that have plain lower-case forms ...
ODD = "İ"  # ... but for this one
SPACES = ("  ", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")  # a text with one of them may have white space in a row
CONTROL = re.compile("[\x00-\x08\x0e-\x1f]")
TEXT, RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|", r"\s+(?!\S)|\s+"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_WORDS = 400_000  # of a generation; when it is full it replaces the one before
CACHE_WORD = 64  # the longest word that is kept, in characters; with CACHE_WORDS, some 160 MB a worker at most
END = b"\xff"  # stands for an end-of-word suffix: never a byte of UTF-8

_ENCODERS: dict[tuple, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words(dict):
    """Ids of words of common characters as bytes, by word, for an encoder with word ends."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.merge, self.code = encoder._core(r".+").encode_single_piece, {r: encoder.ids[r : r + 1].tobytes() for r in encoder.ranks.values()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            low, code = word.lower(), self.code
            if low[-1] in ".,!?;:" and low[:-1].isalpha():
                out = self[word[:-1]] + self[word[-1]]
            else:
                out = b"".join([code[r] for x in ([low] if low.isalpha() else PIECES.findall(low)) for r in self.merge(x.encode() + END)])
        if len(word) <= CACHE_WORD:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Ids of texts as little-endian bytes; kind is "byte" (a space belongs to the word after it) or "word" (white space is dropped, letters are lower-cased, words end with a suffix)."""

    def __init__(self, path: str, kind: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        spec = json.loads(text)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)", re.IGNORECASE)
        self.kind, self.dtype, self.n_ids = kind, np.dtype(dtype), self.tokenizer.get_vocab_size()
        if self.n_ids > np.iinfo(self.dtype).max:
            raise ValueError(f"ids do not fit {dtype}")
        letters, suffix = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
        raw = lambda s: bytes(letters[c] for c in s.removesuffix(suffix)) + (END if suffix and s.endswith(suffix) else b"")
        vocab, merges = spec["model"]["vocab"], [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.ranks = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(512 + len(merges), self.dtype)  # by rank
        for c, b in letters.items():
            self.ids[b] = vocab.get(c) or 0
        if suffix:  # the last byte joins its suffix before anything else
            for c, b in letters.items():
                self.ranks[bytes([b]) + END] = 256 + b
                self.ids[256 + b] = vocab[c + suffix]
        for k, (a, b) in enumerate(merges):
            if self.ranks.setdefault(raw(a) + raw(b), 512 + k) == 512 + k:
                self.ids[512 + k] = vocab[a + b]

        self.words = Words(self) if kind == "word" else None

    def _core(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe

    @cached_property
    def plain(self):
        """The core for texts without white space in a row, which need no look-ahead."""
        return self._core(TEXT + r"\s+").encode_ordinary

    @cached_property
    def spaced(self):
        return self._core(TEXT + RUNS).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, text: str, in_a_row: bool) -> bytes:
        """Ids of text of common characters."""
        if self.kind == "byte":
            return self.ids[np.array((self.spaced if in_a_row else self.plain)(text), np.uint32)].tobytes()
        return b"".join([self.words[x] for x in text.replace("\n", " ").split(" ") if x])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special.search(text) or CONTROL.search(text):
            return self.whole(text)
        in_a_row = any(x in text for x in SPACES)
        if text.isascii() or (max(text) < COMMON and ODD not in text):
            return self._merged(text, in_a_row)
        if in_a_row or text[0].isspace() or text[-1].isspace():
            return self.whole(text)
        out, lead = [], ""
        for common, parts in groupby(text.split(" "), lambda x: x.isascii() or (max(x) < COMMON and ODD not in x)):
            run = lead + " ".join(parts)
            out.append(self._merged(run, False) if common else self.whole(run))
            lead = " " if self.kind == "byte" else ""
        return b"".join(out)


def encoder(path: str, kind: str, dtype: str = "<u4") -> Encoder:
    """The process's encoder; it keeps the last one asked for."""
    key = (path, kind, dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
