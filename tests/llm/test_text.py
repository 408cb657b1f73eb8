"""Vectorised words, shingles and tokens against plain code."""

import random
import re

import pyarrow as pa
import pytest

from loomdex.llm.text import Tokens, shingle_sets, sliced, tokens, words

ALPHABET = "abé 'strevlmd\n\t1!ßΣİ　\xa0\x1cǅ\U0001f600"


def unaltered(path):
    """The library's own tokenizer of a file, used as the vocabularies' description says."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


def fuzz(n, size, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("spaced", [True, False])
def test_tokens_equal_the_library(byte_bpe, word_bpe, spaced):
    path = byte_bpe if spaced else word_bpe
    texts = [*fuzz(3000, 14, 1), None, "", "It's we'll they've I'd 'S '", "a  b\n\n c\t d", "x" * 3000, "1234 12ab"]
    library = unaltered(path)
    batched = []
    for part in sliced(pa.record_batch({"t": pa.array(texts)}), "t", 2000):
        batched += tokens(path, spaced).batch(part.column(0).to_pylist())
    assert [x.tolist() for x in batched] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("spaced", [True, False])
def test_every_code_point_splits_as_the_library_does(byte_bpe, word_bpe, spaced):
    path = byte_bpe if spaced else word_bpe
    t, library = Tokens(path, spaced), unaltered(path)
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0077\U000e006c\U000e0073\U000e007f"
    texts = [flag, f"abc{flag}def", "abc\U000e0100def", "\u845b\U000e0100\u845b", "ab\U000f0000cd", "\U00032000\U000323b0a"]
    texts += [f"ab{chr(c)}cd {chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33500 or 0xE0000 <= c < 0xE1000 or c % 97 == 0)]
    for i in range(0, len(texts), 10_000):
        part = texts[i : i + 10_000]
        assert [x.tolist() for x in t.batch(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("spaced", [True, False])
def test_random_mixes_of_all_letters(byte_bpe, word_bpe, spaced):
    """Letters of every plane side by side, marks, newer letters than Python knows, and the special tokens' strings."""
    path = byte_bpe if spaced else word_bpe
    r = random.Random(12)
    rare = [chr(r.randrange(0x110000)) for _ in range(4000)] + [chr(c) for c in (0x1C89, 0x1C8A, 0xA7CB, 0xA7DA, 0xA7DC, 0x105C0, 0x10D50, 0x323B0, 0x16EA0, 0x130, 0x3A3, 0x345, 0x1E9E, 0x212B, 0x1100, 0x1161)]
    rare = [c for c in rare if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(r.choice([r.choice(rare), r.choice(ALPHABET), r.choice(["<|endoftext|>", "<|startoftext|>", "'s", "'re"])]) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    library = unaltered(path)
    assert [x.tolist() for x in tokens(path, spaced).batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_table_starts_anew(byte_bpe):
    from loomdex.llm.text import _Table

    t = Tokens(byte_bpe, True)
    t.table = _Table(4)
    assert [x.tolist() for x in t.batch(["one two three four five six seven eight nine ten"] * 2)] == [t.library.encode("one two three four five six seven eight nine ten", add_special_tokens=False).ids] * 2


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_words_and_shingles():
    texts = [*fuzz(500, 30, 2), None, "", "A b", "a B", "\x0b\x0cx"]
    known = {}
    h, at = words(pa.array(texts))
    for t, i, j in zip(texts, at[:-1], at[1:], strict=True):
        w = plain_words(t)
        assert len(w) == j - i
        assert all(known.setdefault(x, y) == y for x, y in zip(w, h[i:j].tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    for t, g in zip(texts, shingle_sets(pa.array(texts), 3), strict=True):
        w = plain_words(t)
        assert len(g) == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else min(1, len(w)))
