"""Ids and bytes of public subword vocabularies inside tasks."""

from __future__ import annotations

import json
import re
from functools import cached_property

import sentencepiece
import tiktoken
import tokenizers

from finsearch.llm.bpe import PIECES, byte_letters

LONG_BLANK = 100_000  # longer runs of white space exceed the stack of the faster library's pattern


class ByteLevel:
    """A byte-level vocabulary in a tokenizers file, read by the faster of two libraries that agree.

    ``special``: strings of special tokens inside a text get their ids, as they do in the file's own
    library by default; otherwise they are plain text.
    """

    def __init__(self, path: str, special: bool = False):
        self.path, self.special = path, special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", PIECES)  # this dialect writes four digits in braces
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.bytes = {i: b for b, i in ranks.items()}

    @cached_property
    def patient(self) -> tokenizers.Tokenizer:
        own = tokenizers.Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        own.encode_special_tokens = not self.special
        return own

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_BLANK and re.search(rf"\s{{{LONG_BLANK}}}", text):
            return self.patient.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all") if self.special else self.fast.encode_ordinary(text)


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of every id, its word mark as a space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on after a word's end, so that words have their ids alone
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
