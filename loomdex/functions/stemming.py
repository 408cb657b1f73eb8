"""Word folding and stemming for full-text terms: diacritics go, then suffixes by Porter's published rules (1980); and exact token counts."""

from __future__ import annotations

import base64
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of steps 2 to 4 with what replaces them.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def fold(word: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _shape(stem: str) -> str:
    """``v`` and ``c`` for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall(r"v+c+", _shape(stem)))


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def _plural(w: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            return w[: len(w) - len(suffix)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: len(w) - len(suffix)]
        if w.endswith(suffix):
            if "v" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_short(stem) else stem
    return w


def stem(word: str) -> str:
    """The stem of a folded word; words of one or two letters, and others than a to z, stay."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z]+", word):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: len(w) - len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_short(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of folded words, each distinct word of a batch once."""
    known = {w: stem(fold(w)) for w in words.dropna().unique()}
    return words.map(known)


def exact_tokens(ranks_path: str, pattern: str):
    """A column function that counts a text's tokens by a byte-pair vocabulary file; the estimate where its library isn't installed."""
    try:
        import tiktoken
    except ImportError:
        return lambda text: F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))
    known: dict = {}

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        if not known:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
            known["own"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.fillna("").map(lambda t: len(known["own"].encode_ordinary(t)))

    return count
