"""Language identification with Bloom filters that return the set of languages of an n-gram.

The filter is bit-sliced: each slot holds a bit mask with one bit per language, so the masks of
an n-gram's slots, combined by AND, are all languages that contain it. A text's n-grams are looked up
at once; per language the hits are counted, the share of false positives expected from how full
its slice is gets taken off, and the highest corrected share wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import text_of, worker_memo

SIZES = (2, 3, 4)  # n-gram lengths in letters, word borders included
HASHES = 3
SLOTS_PER_GRAM = 10  # per language; filters of this size err in about 2 % of the lookups and less
MIN_SHARE = 0.0001  # an n-gram belongs to a language if it occurs at least this often per character
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 22  # code points that are worked on at a time


def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or a space if it is none."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one space around every word, and the text each belongs to."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    codes = worker_memo("letters", _letters)[points]
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    after = np.append(codes[1:], 32)
    keep = (codes != 32) | (after != 32) | last
    return codes[keep].astype(np.uint64), owner[keep]


def _mixed(values: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash (constants of a published finalizer)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, and the text each belongs to. N-grams stay within a word and its borders."""
    codes, owner = _codes(texts)
    hashes, owners = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, dtype=np.uint64)
        inside = owner[:n] == owner[size - 1 :]
        for at in range(size):
            value = value * np.uint64(0x110000) + codes[at : at + n] if at < 3 else _mixed(value) + codes[at : at + n]
            if 0 < at < size - 1:
                inside &= codes[at : at + n] != 32
        hashes.append(_mixed(value[inside]))
        owners.append(owner[:n][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(hashes: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    """The places of every n-gram in the filter."""
    step = _mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(HASHES):
        yield (hashes + np.uint64(i) * step) % np.uint64(n_slots)


def pieces_of(texts: list[str], most: int = PIECE) -> Iterator[list[str]]:
    """Runs of texts of bounded total length; a longer text is alone."""
    size, held = 0, []
    for text in texts:
        if held and size + len(text) > most:
            yield held
            size, held = 0, []
        held.append(text)
        size += len(text)
    if held:
        yield held


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some texts and how often they occur; every distinct word is cut up once."""
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update(_words(text))
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for part in pieces_of(list(counts), PIECE // 4):
        hashes, owner = grams(part)
        weight = np.array([counts[w] for w in part], dtype=np.int64)
        values, at = np.unique(hashes, return_inverse=True)
        found.append((values, np.bincount(at, weight[owner], len(values)).astype(np.int64)))
    values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in found]), len(values)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    """Languages, most frequent first, the bit-sliced filter, and the share of lookups that each slice answers by chance."""

    languages: tuple[str, ...]
    masks: np.ndarray  # (slots, words) of 64 languages each
    chance: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for part in pieces_of(texts):
            for name, score in zip(*self._predict(part)):
                names.append(name)
                scores.append(score)
        return names, scores

    def _hits(self, words: list[str]) -> np.ndarray:
        """A row per word: its n-grams in each language, and all of them."""
        hashes, owner = grams(words)
        places = list(_slots(hashes, len(self.masks)))
        out = np.zeros((len(words), len(self.languages) + 1))
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            found = column[places[0]]
            for place in places[1:]:
                found = found & column[place]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                hit = (found >> np.uint64(bit) & np.uint64(1)).astype(bool)
                out[:, 64 * word + bit] = np.bincount(owner[hit], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def _predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n, languages = len(texts), len(self.languages)
        number: dict[str, int] = {}
        spelt = [[number.setdefault(w, len(number)) for w in _words(t)] for t in texts]
        hits = [self._hits(part) for part in pieces_of(list(number), PIECE // 4)]
        hits = np.concatenate(hits) if hits else np.zeros((0, languages + 1))
        at = np.array([i for own in spelt for i in own], dtype=np.int64)
        owner = np.repeat(np.arange(n), [len(own) for own in spelt])
        sums = np.stack([np.bincount(owner, hits[at, c], n) for c in range(languages + 1)], axis=1)
        share, total = sums[:, :-1], sums[:, -1]
        share = share / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        # texts without a letter have no n-gram; without any hit nothing decides
        best = share.argmax(axis=1) if languages else np.zeros(n, int)
        names, scores = [], []
        for i in range(n):
            top = float(share[i, best[i]]) if languages else 0.0
            known = total[i] > 0 and languages > 0
            names.append(self.languages[best[i]] if known else UNKNOWN)
            scores.append(top if known else 0.0)
        return names, scores


def learn(docs: DataFrame, min_share: float = MIN_SHARE, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """A filter from all rows with a text and a language. Without any such row there is no language.

    Occurrences per (language, n-gram) are counted batch by batch and then by a shuffle over the
    n-grams, so a common n-gram is one row per batch. An n-gram belongs to a language if it occurs
    more than once, and at least ``min_share`` times per character of the language: of each size there
    are at most 1 / ``min_share`` such n-grams and language, so the model does not grow with the corpus.
    """
    source = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                values, counts = gram_counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

    sizes = {r["lang"]: (r["docs"], r["length"]) for r in source.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("length")).collect()}
    languages = tuple(sorted(sizes, key=lambda x: (-sizes[x][0], x)))
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return LanguageFilter((), np.zeros((1, words), np.uint64), np.zeros(0))
    spark = docs.sparkSession
    floors = [(lang, i, max(2, int(np.ceil(min_share * sizes[lang][1])))) for i, lang in enumerate(languages)]
    floor = spark.createDataFrame(floors, "lang string, bit int, floor long")
    counts = source.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counts.join(F.broadcast(floor), "lang").where("n >= floor")
    masks_of = [F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    table = kept.groupBy("gram").agg(*masks_of).toArrow()
    hashes = table.column("gram").to_numpy().view(np.uint64)
    n_slots = max(64, SLOTS_PER_GRAM * len(hashes))
    masks = np.zeros((n_slots, words), np.uint64)
    for w in range(words):
        own = table.column(f"w{w}").to_numpy().view(np.uint64)
        for place in _slots(hashes, n_slots):
            np.bitwise_or.at(masks[:, w], place, own)
    chance = np.array([float((masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) ** HASHES for i in range(len(languages))])
    return LanguageFilter(languages, masks, chance)


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    Only the text is read. A null text and one without a letter are ``und`` with score 0; ties go to
    the language with more documents in training, then to the name that sorts first. Columns of these names that were there before are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # plain arrays: a broadcast object would need its class on the workers
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilter(*shipped.value)
        for batch in batches:
            names, scores = own.predict([t or "" for t in batch.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest, "lang_pred", "score"],
            )

    source = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in rest)
    return source.mapInArrow(run, ", ".join(x for x in (kinds, "lang_pred string, score double") if x))


def least_scores(docs: DataFrame, model: LanguageFilter, share: float = 0.02, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang_pred, least)``: the score that all but a ``share`` of the rightly named texts of a language reach.

    ``docs`` are texts with a known language that the model did not see. How many of a text's n-grams a language knows
    depends on how many signs it has, so a bound on scores has to be its own. One row per language at most; languages without
    such a text, and null or empty texts, have none.
    """
    asked = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("known"), F.col(text_col).alias("text"))
    right = predict(asked, model).where((F.col("known") == F.col("lang_pred")) & (F.col("score") > 0))
    return right.groupBy("lang_pred").agg(F.percentile_approx("score", share).alias("least"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are kept from training: those whose id, as text, has a CRC-32 divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
