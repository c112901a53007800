"""Byte-level BPE of whole texts through a bounded cache of text runs.

A run is what lies between two single spaces, with its leading space. The pre-tokeniser's pattern never
matches across the place before a white-space character that follows a non-space one, so the ids of a text
are the ids of its runs, one after another; only runs not seen before reach a library.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

_DOUBLE = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
# Alphabets on which both libraries' Unicode tables agree (a test goes through them); other runs take the slower library.
_PLAIN = re.compile(r"[\x00-՗Ḁ-῿‐-‧‰-⁞]*")


def runs(text: str) -> list[str]:
    """The runs of a text; joined they give the text."""
    if not text:
        return []
    parts = text.split(" ") if not (_DOUBLE.search(text) or text[0] == " " or text[-1] == " ") else _SINGLE.split(text)
    first, rest = parts[0], parts[1:]
    return [first, *[" " + x for x in rest]]


class RunEncoder:
    """Ids of one run, from the vocabulary file that the JSON tokenizer reads."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_ordinary

    def ids(self, run: str) -> list[int]:
        # both hold the same vocabulary; special strings and rarer scripts are left to the JSON tokenizer
        if len(run) < 400 and "<|" not in run and _PLAIN.fullmatch(run):
            return self.quick(run)
        return self.library.encode(run, add_special_tokens=False).ids


_encoder: RunEncoder | None = None


def encoder() -> RunEncoder:
    """One encoder per Python worker."""
    global _encoder
    if _encoder is None:
        _encoder = RunEncoder()
    return _encoder


class BoundedCache(dict):
    """key -> value, but for very long texts; holds ``most`` entries, then starts again from ``frequent``."""

    def __init__(self, make, most: int, frequent: dict | None = None):
        super().__init__(frequent or {})
        self.make, self.most, self.frequent = make, most, frequent or {}

    def __missing__(self, run):
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        value = self.make(run)
        if not isinstance(run, str | bytes) or len(run) < 200:
            self[run] = value
        return value


def packed(run: str) -> bytes:
    """Ids of a run as little-endian unsigned 32-bit integers."""
    return np.asarray(encoder().ids(run), "<u4").tobytes()


def count(run: str) -> int:
    return len(encoder().ids(run))
