import random

import pytest

from loomdex.llm.text import vocabulary

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, path string, copies int"


def messy_rows():
    """Nulls, empties, copies, near copies, a very long text, odd characters; extra columns with clashing names."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120)
    swapped = base.split()
    swapped[60] = "zzzz"
    texts = [None, "", " \n\t ", "one", "Two words", "two WORDS", base, base, " ".join(swapped), base.upper(), text(6000), "x" * 50_000, "a\x1cb 'tis it's <|endoftext|> \U0001f600", text(15), text(16)]
    texts += [text(40) for _ in range(10)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "p", 7) for i, t in enumerate(texts)]
    rows += [rows[6], (90, "null source", None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), FIELDS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def byte_bpe():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return vocabulary("word_bpe_49k.json")
