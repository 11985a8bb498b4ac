"""English suffix stripping (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix pairs of the published algorithm, steps 2, 3 and 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous "
    "ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

MEMO_WORDS = 500_000  # whose stems a task remembers


def _pairs(spec: str) -> list[tuple[str, str]]:
    pairs = [tuple(word.split(":")) for word in spec.split()]
    return sorted(pairs, key=lambda pair: -len(pair[0]))


_STEP2, _STEP3 = _pairs(STEP2), _pairs(STEP3)
_STEP4 = sorted(STEP4.split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    """Consonants as c and vowels as v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """consonant-vowel-consonant at the end, the last one not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, pairs: list[tuple[str, str]]) -> str:
    for suffix, other in pairs:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of one lowercase word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), "")
        if "v" in _shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    suffix = next((s for s in _STEP4 if word.endswith(s)), None)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_words(term: Column) -> Column:
    """Stems of a word column, each distinct word of a task stemmed once, of ``MEMO_WORDS`` at a time."""

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = {}
        for batch in batches:
            if len(known) > MEMO_WORDS:
                known.clear()
            known.update((word, stem(word)) for word in batch.dropna().unique() if word not in known)
            yield batch.map(known.get)

    return stems(term)
