"""Byte-pair encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece of text has exactly one last token in its encoding. The tokens that end at
a byte come from an automaton over the vocabulary; of those, the one whose pair with the last
token of the shorter prefix is compatible is kept. Back-pointers from the end give the exact ids
in time linear in the text, however long a piece without white space is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import text_of, worker_memo

# The pre-tokenizer pattern of byte-level BPE, with Unicode's White_Space spelled out.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Vocabulary, automaton and pair tests of one tokenizer file.

    Holds at most ``memo`` encoded pieces; the rest are encoded again, with the same result.
    """

    def __init__(self, path: str, memo: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {text: bytes(letters[c] for c in text) for text in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {ids[text]: data for text, data in raw.items()}
        self.merged: dict[int, tuple[int, int]] = {}  # pair -> (rank, id of the merged token)
        self.halves: dict[int, tuple[int, int, int]] = {}  # id -> (rank, left id, right id)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merged[a << 32 | b] = (rank, c)
            self.halves.setdefault(c, (rank, a, b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.automaton = ahocorasick.Automaton()
        self.pairs: dict[int, bool] = {}
        for token, data in sorted((t, d) for t, d in self.bytes_of.items() if t not in self.special.values()):
            self.automaton.add_word(data.decode("latin-1"), (len(data), token))
        self.automaton.make_automaton()
        self.alone = {t for t in self.bytes_of if self._reachable(t)}
        self.split = regex.compile(PIECES)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = memo

    def _reachable(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes: its halves are, and they are compatible up to its merge."""
        if token not in self.halves:
            return len(self.bytes_of[token]) == 1
        rank, a, b = self.halves[token]
        return self._compatible(a, b, rank)

    def _compatible(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of rank below ``before`` joins the border of two tokens while they are being built.

        Goes back through the later of the two last merges: at each state of the border, the pair
        that stands there must not merge earlier than the merge that removed that state.
        """
        limit = before
        while True:
            hit = self.merged.get(left << 32 | right)
            if hit is not None and hit[0] < limit:
                return False
            left_made, right_made = self.halves.get(left), self.halves.get(right)
            if left_made is None and right_made is None:
                return True
            if right_made is None or (left_made is not None and left_made[0] > right_made[0]):
                # the pair stood here until the left token was made; ties go to the leftmost place
                limit, left = left_made[0], left_made[2]
            else:
                limit, right = right_made[0] + 1, right_made[1]

    def pair(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._compatible(left, right, 1 << 60)
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the pre-tokenizer."""
        data = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(data)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        pairs, alone = self.pairs, self.alone
        for end, (length, token) in self.automaton.iter(data):
            end += 1
            if last[end] >= 0 or token not in alone:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    ok = self.pair(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of added tokens become their ids."""
        ids: list[int] = []
        memo = self.memo
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(self.special[part])
                continue
            for piece in self.split.findall(part):
                known = memo.get(piece)
                if known is None:
                    known = self.piece(piece)
                    if len(piece) <= 64:
                        if len(memo) >= self.most:
                            memo.clear()
                        memo[piece] = known
                ids += known
        return ids

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per worker process."""
    return worker_memo(("bpe", path), lambda: Encoder(path))


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row; a null text counts as empty and has no ids.

    Other columns are left out, repeated rows are encoded each, a null id stays null. ``tokenizer``
    is the path of a byte-level BPE file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            ids = pa.array((own.encode(t) for t in batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    source = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` for rows of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            texts = pa.array((own.decode(i or ()) for i in batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    source = encoded.select(id_col, ids_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the text they decode to.

    Encodes and decodes in one pass, so that neither ids nor texts leave the task. Empty and null
    texts have no tokens and the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            counts, hashes, texts = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
