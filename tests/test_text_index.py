"""Text searches over the gram index against searches of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomdex.operators import retrieval, text_index


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(6)
    words = ["license", "Licence", "def", "foo_bar", "ÄRGER", "ΣΑΣ", "x", "naïve", "(c)", "2024", "\U0001f600smile", "abcabcabc"]
    rows = [(f"p{i:03}", "\n".join(" ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(r.randint(0, 12)))) for i in range(200)]
    rows += [("null", None), ("empty", ""), ("ab", "ab"), ("once", "zq" * 300 + "needle here"), ("far", "nee" + "x" * 61 + "dle"), ("long", "y" * 50_000 + " license\n" + "z" * 70 + "license")]
    return spark.createDataFrame(rows, "path string, content string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    text_index.STRIPE = 16
    return text_index.build(texts.filter("path < 'p150'"), f"file://{tmp_path_factory.mktemp('grams')}/i").add(texts.filter("path >= 'p150'"), "1")


@pytest.mark.parametrize("needle", ["license", "LICEN", "foo_bar def", "ärger", "σας", "\U0001f600smile", "abcabcabcabc", "abcabcabc", "needle here", "needle", "x", "ab", "", "absent text", "a\nb", "(c) 2024", "y" * 200 + " licen"])
def test_substrings(index, texts, needle):
    want = rows_of(retrieval.grep(texts.fillna("", "content"), needle, 2))
    assert rows_of(index.grep(needle, 2)) == want and rows_of(index.grep(needle, 2, 3)) == want[:3]


@pytest.mark.parametrize("pattern", [r"licen[sc]e +foo", r"(?i)LICENSE", r"\bdef\b.*2024$", r"abc(abc)+ x", r"license|naïve", r"(needle) (here)?", r"\p{Lu}RGER", r"[a-z]{3}_bar", r"^x?$", r"ΣΑΣ def"])
def test_patterns(index, texts, pattern):
    want = rows_of(retrieval.line_hits(texts.fillna("", "content"), lambda line: line.rlike(pattern), 1))
    assert rows_of(index.match(pattern, 1)) == want


@pytest.mark.parametrize("pattern,want", [("abc(def)?ghi", ["abc", "ghi"]), ("(abcd)+e", ["abcd"]), ("abc|defg", []), ("foo(bar)baz", ["foobarbaz"]), ("fo.bar^baz", ["barbaz"]), ("a{2}bcdé", ["bcd"]), (r"\p{L}", []), ("x*abc", ["abc"]), ("(?=abc)def", ["def"]), ("ABC\nDEF", ["abc", "def"])])
def test_literals(pattern, want):
    assert text_index.literals(pattern) == want


def test_literals_are_in_every_match():
    r = random.Random(1)
    for _ in range(300):
        pattern = "".join(r.choice(["abc", "de", "(fg)", "h?", "i+", "[jk]", ".", "(lm|no)", "p{2,3}", "\\d", "^", "(?:qr)*"]) for _ in range(r.randint(1, 6)))
        for _ in range(200):
            text = "".join(r.choice("abcdefghijklmnopqr12") for _ in range(12))
            if m := re.search(pattern, text):
                assert all(x in m.group() for x in text_index.literals(pattern)), pattern


def test_few_files_are_candidates(index):
    assert index.candidates(["needle here"]).count() == 1
    assert index.candidates(["needle"]).count() == 1  # all its grams are in another file too, but in no line
    assert index.candidates(["ab"]) is None
    assert index.among(["absent text"]).count() == 0
    assert "part" in index.files().columns and index.files().filter(F.length("path") > 0).count() == 206
