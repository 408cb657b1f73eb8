"""Toxicity, quality, mixing, licences and URL reputation."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import bags, license_scan, mixing, quality, toxicity, url_reputation
from tests.llm.test_text import fuzz


def test_sentences_against_plain_code():
    texts = [*fuzz(300, 25, 4), "One two. Three!\nfour", "", None, "...", "a. b."]
    starts, rows, where, hashes = bags.sentence_features(pa.array(texts))
    known, base = {}, 0
    found = {}
    for s, h in zip(where.tolist(), hashes.tolist(), strict=True):
        found.setdefault(s, set()).add(h)
    for n, t in enumerate(texts):
        t = t or ""
        pieces = [p for p in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t)] or [""]
        assert rows[n + 1] - rows[n] == len(pieces)
        at = base
        for i, p in enumerate(pieces):
            assert starts[rows[n] + i] == at
            at += len(p.encode())
            words = [w for w in re.split(r"[\x20\x09-\x0D\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", p) if w]
            low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode() for w in words]
            want = {w for w in low} | {(w[:k], k) for w in low for k in bags.STEMS if len(w) > k}
            got = found.get(rows[n] + i, set())
            assert len(got) == len(want)
            known.setdefault(frozenset(map(str, want)), got)
            assert known[frozenset(map(str, want))] == got
        base += len(t.encode())


def toxic_rows(n, seed):
    r = random.Random(seed)
    clean = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        sents = [" ".join(r.choice(clean) for _ in range(8)) for _ in range(r.randint(2, 9))]
        bad = r.random() < 0.3
        if bad:
            sents.insert(r.randint(0, len(sents)), f"you utter {r.choice(['rotter', 'blighter', 'scoundrelish', 'scoundrels'])} there")
        out.append((i, ". ".join(sents) + ".", int(bad)))
    return out


def test_toxicity_learns_and_locates(spark):
    df = spark.createDataFrame(toxic_rows(900, 1), "doc_id long, text string, y int")
    labels = df.filter(toxicity.fold(F.col("doc_id")) != 1).select("doc_id", "y")
    model = toxicity.train(df, labels)
    scored = toxicity.score(df, model, ("doc_id", "text", "y")).filter(toxicity.fold(F.col("doc_id")) == 1).collect()
    assert np.mean([(r["score"] >= 0.7) == bool(r["y"]) for r in scored]) > 0.98
    for r in scored:
        if r["y"] and r["score"] >= 0.7:
            assert any(re.search("rotter|blighter|scoundrel", r["text"].encode()[s["start"] : s["end"]].decode()) for s in r["sentences"])


def test_toxicity_edges(messy, empty, spark):
    none = spark.createDataFrame([], "doc_id long, y int")
    model = toxicity.train(messy, none)
    rows = toxicity.score(messy, model, ("doc_id", "score")).collect()
    assert len(rows) == messy.count() and {r["score_"] for r in rows} == {0.0} and {r["score"] for r in rows} <= {0.5, None}
    one = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, y int")
    assert all(abs(r["score"] - 1) < 1e-9 for r in toxicity.score(messy, toxicity.train(messy, one)).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, y int")
    fitted = toxicity.train(messy, both)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(messy, fitted).collect())
    assert toxicity.score(empty, fitted).count() == 0
    assert toxicity.sample_of(both, 5).count() == 5


def test_toxicity_fit_holds_a_block_and_drops_no_document():
    known = np.sort(bags.sentence_features(pa.array(["rotter some other words here"]))[3])
    texts = ["some other words here. " * 400 + ("you rotter. " if i % 3 == 0 else "") for i in range(60)]

    def rows(times):
        for _ in range(times):
            yield from toxicity._found(known, iter([pa.record_batch({"doc_id": list(range(60)), "text": texts, "y": [float(i % 3 == 0) for i in range(60)]})]))

    def peak(times):
        tracemalloc.start()
        fitted = toxicity.fit(rows(times), known, 20_000)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, fitted

    (small, one), (large, same) = peak(2), peak(12)
    assert large < 1.5 * small
    for times, blocked in ((2, one), (12, same)):  # every document counts, in blocks or at once
        whole = toxicity.fit(rows(times), known)
        assert np.allclose(blocked["weights"], whole["weights"], atol=1e-4) and abs(blocked["bias"] - whole["bias"]) < 1e-4


def test_toxicity_sends_no_text_to_the_fit(spark, monkeypatch):
    df = spark.createDataFrame(toxic_rows(200, 3), "doc_id long, text string, y int")
    frame, seen = type(df), []
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: (seen.append(self.columns), f(self, *a))[1])
    toxicity.train(df, df.select("doc_id", "y"))
    assert seen and not any("text" in c for c in seen)


def plain_score(text, model, known):
    """Noisy-or of a text's sentences from words and strings; ``known`` maps a feature's string to its weight."""
    sentences = [p for p in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text)] or [""]
    none = 1.0
    for p in sentences:
        words = [w for w in re.split(r"[\x20\x09-\x0D\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", p.lower()) if w]
        uses = {}
        for w in words:
            for feature in [w, *(f"{w[:k]}*" for k in bags.STEMS if len(w) > k)]:
                uses[feature] = uses.get(feature, 0) + 1
        z = model["bias"] - model["size"] * math.log(len(sentences)) + sum(known.get(f, 0.0) * min(n, toxicity.MOST_COUNT) for f, n in uses.items())
        none *= 1 - 1 / (1 + math.exp(-z))
    q = min(max(1 - none, 1e-12), 1 - 1e-12)
    return 1 / (1 + math.exp(-(math.log(q / (1 - q)) + model["shift"])))


def test_score_is_the_noisy_or_of_plain_code(spark):
    hashes = bags.sentence_features(pa.array(["rotter", "scoundrel", "w1"]))  # words, then beginnings
    names = ["rotter", "scoundrel", "w1", "rot*", "sco*", "rott*", "scou*", "rotte*", "scoun*", "scound*"]
    weight = dict(zip(names, np.linspace(-1, 4, len(names)).tolist(), strict=True))
    order = np.argsort(hashes[3])
    model = {"hashes": hashes[3][order].view(np.int64).tolist(), "weights": [list(weight.values())[i] for i in order], "bias": -3.0, "size": 0.6, "shift": 0.8}
    r = random.Random(3)
    texts = ["", "rotter", "Rotter! rotten rot. w1 w1 w1 w1 w1\nscoundrels, scoundrel"] + ["".join(r.choice([" ", " ", ". ", "\n"]) + r.choice(["rotter", "rotting", "scoundrels", "scout", "w1", "w12", "x"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    assert all(math.isclose(got[i], plain_score(t, model, weight), rel_tol=1e-9, abs_tol=1e-12) for i, t in enumerate(texts))


def test_slope_is_the_gradient():
    r = np.random.default_rng(4)
    n = r.integers(3, 9, 30)
    doc = np.sort(np.concatenate([np.arange(30)] + [r.integers(0, 30, 20)]))
    s, f, c = r.integers(0, len(doc), 200), r.integers(0, 7, 200), r.integers(1, 4, 200).astype(float)
    y, theta = r.integers(0, 2, 30).astype(float), np.concatenate([r.normal(size=7), [-2.0, 0.4]])

    def loss(t):
        none = toxicity.forward(t, s, f, c, doc, n)[3]
        return float(np.sum((1 - y) * none - y * np.log(-np.expm1(-none))))

    near = [(loss(theta + d) - loss(theta - d)) / 2e-6 for d in 1e-6 * np.eye(9)]
    assert np.allclose(toxicity.slope(theta, y, s, f, c, doc, n), near, rtol=1e-4, atol=1e-6)


def test_threshold_against_all_cuts():
    r = np.random.default_rng(1)
    for _ in range(20):
        q = np.round(r.random(40), 1) + 0.05
        y = (q + r.normal(0, 0.3, 40) > 0.6).astype(float)
        if y.any():
            at = toxicity.threshold(y, q)
            f1 = lambda t: 2 * y[q > t].sum() / ((q > t).sum() + y.sum())
            assert math.isclose(f1(at), max(f1(t) for t in sorted(set(q))[:-1]))
    assert toxicity.threshold(np.array([1.0, 0.0]), np.array([0.5, 0.5])) is None


def test_toxicity_query_finds_held_out_documents(spark):
    """Recall and precision on rows that learning never saw, over the small tables; some labels are noise without any sign."""
    import os

    from loomdex.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert caught / sum(r["toxic"] for r in rows) >= 0.85
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.03 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def quality_rows(n):
    r = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        t = " ".join(r.choice(words) for _ in range(60))
        rows.append((i, t if good else r.choice([t.upper().replace(" ", "!! "), " ".join(["same"] * 60), t.replace(" ", " | ")]), f"h{i % 5}", "p", int(good)))
    return rows


def test_quality(spark):
    df = spark.createDataFrame(quality_rows(600), "doc_id long, text string, host string, path string, y int")
    got = quality.classify(df, df.filter("doc_id % 3 <> 1").select("doc_id", "y"), ("doc_id", "y")).filter("doc_id % 3 = 1").collect()
    assert np.mean([r["keep"] == bool(r["y"]) for r in got]) > 0.97


def test_sites_shrink(spark):
    rows = [(i, "big", "p", 1 if i % 10 else 0) for i in range(400)] + [(400 + i, "bad", "p", 0) for i in range(100)] + [(900, "tiny", "p", 0)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, y int")
    s = {r["host"]: r for r in quality.sites(df, df.select("doc_id", "y")).collect()}
    assert s["bad"]["path_mean"] < 0.1 < s["tiny"]["path_mean"] < s["big"]["path_mean"] and abs(s["big"]["host_mean"] - 0.9) < 0.02


def test_quality_edges(messy, empty, spark):
    docs = messy.withColumns({"host": F.col("source"), "path": F.col("lang")})
    for labels in ([], [(4, 1)], [(i, i % 2) for i in range(20)] + [(3, None), (None, 1)]):
        y = spark.createDataFrame(labels, "doc_id long, y int")
        rows = quality.classify(docs, y, ("doc_id", "score")).collect()
        assert len(rows) == messy.count() and all(0 <= r["score_"] <= 1 for r in rows)
        assert quality.classify(empty.withColumns({"host": F.col("source"), "path": F.col("lang")}), y, model={"share": 0.5}).count() == 0


def fill(sizes, share=1.5, most=2.0):
    """Targets by dealing the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, rest = {}, set(order), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in left)
        over = {s for s in left if rest * w[s] / total > most * sizes[s]} if total else set()
        if not over:
            return out | {s: rest * w[s] / total for s in left}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        left -= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 100, 1000, 5000]) for s in [None, "", *(f"s{i}" for i in range(r.randint(1, 12)))]}
    sizes["s0"] = 77
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix(messy, empty, spark):
    rows = mixing.mix(messy.drop("copies").withColumn("size", F.lit(1))).collect()
    assert len(rows) == messy.count() and all(0 <= r["copies"] <= 2 for r in rows)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(0, None)]["size_"] == 0 and by[(4, "Two words")]["size_"] == 2
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).columns == empty.columns
    out = mixing.repeated(messy)
    assert out.dtypes == messy.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.repeated(messy.repartition(5)).collect()))
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    near = mixing.mix(many).groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) / F.first("target")).alias("r")).collect()
    assert all(abs(r["r"] - 1) < 0.05 for r in near)


def test_many_rows_of_one_key_are_drawn_a_part_at_a_time(spark):
    """A third of all rows are one row, a third have no id and one text: nothing is gathered beyond a turn, and the targets are met."""
    rows = [(1, "s", "a b c")] * 1500 + [(None, "s", "x y")] * 1500 + [(10 + i, "t" if i % 2 else "s", "w " * (i % 30)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.mix(df).groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) / F.first("target")).alias("near"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    assert sum(r["n"] for r in got) == len(rows) and all(abs(r["near"] - 1) < 0.02 and r["most"] <= 2 for r in got)


def pairs(sizes, f, draws):
    """Which documents are taken: one undecided is held, and the chances of it and of the next are moved until one is decided."""
    taken, held = set(), None
    for i, (n, u) in enumerate(zip(sizes, draws)):
        if not n:
            taken |= {i} if u < f else set()
            continue
        if held is None:
            held, first = [i, f], u
            continue
        j, p = held
        ratio = n / sizes[j]
        up, down = min(1.0 - p, f * ratio), min(p, (1.0 - f) * ratio)
        if u * (up + down) < down:
            if 1.0 - p <= f * ratio:
                taken.add(j)
                held = [i, max(0.0, f - (1.0 - p) / ratio)]
            else:
                held = [j, p + f * ratio]
        elif p <= (1.0 - f) * ratio:
            held = [i, min(1.0, f + p / ratio)]
        else:
            taken.add(i)
            held = [j, p - (1.0 - f) * ratio]
    if held and first < held[1]:
        taken.add(held[0])
    return taken


def test_every_document_has_the_same_chance_and_the_words_come_near():
    """The rule in plain code, which the next test holds the operator against, over many draws."""
    r = random.Random(11)
    sizes = sorted((min(500, int(r.paretovariate(1.1) * 30)) for _ in range(40)), reverse=True) + [0, 0]
    for f in (0.07, 0.5, 0.83):
        runs = 6000
        drawn = [pairs(sizes, f, [r.random() for _ in sizes]) for _ in range(runs)]
        for i in range(len(sizes)):
            assert abs(sum(i in d for d in drawn) / runs - f) < 4.5 * math.sqrt(f * (1 - f) / runs), (f, i)
        assert max(abs(sum(sizes[i] for i in d) - f * sum(sizes)) for d in drawn) <= max(sizes)
        assert f != 0.5 or np.mean([abs(sum(sizes[i] for i in d) - f * sum(sizes)) for d in drawn]) < 0.01 * sum(sizes)


def plain_mix(rows, share=1.5, most=2.0, seed=0):
    """copies by (doc_id, size): the draws of ``mix`` in plain code over ``rows(doc_id, source, size)``."""
    import hashlib

    sizes, cells, out = {}, {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = fill(sizes, share, most)
    number = {s: sum(1 for _, t, _ in rows if t == s) for s in sizes}
    for d, s, n in rows:
        h = hashlib.md5(f"{'' if d is None else d}#{seed}".encode()).hexdigest()
        u, v = (int(h[i : i + 13], 16) / 2**52 for i in (0, 13))
        cells.setdefault((s, int(v * max(1, number[s] // mixing.CELL))), []).append((-n, u, d))
    for (s, _), own in cells.items():
        rate = want[s] / sizes[s] if sizes[s] else 1.0
        ordered = sorted(own, key=lambda x: (x[0], x[1], x[2] is None, x[2]))
        for low in range(0, len(ordered), mixing.MOST_TOGETHER):
            turn = ordered[low : low + mixing.MOST_TOGETHER]
            keys = [f"{'' if d is None else d}@{low + i}#{seed}" for i, (_, _, d) in enumerate(turn)]
            taken = pairs([-n for n, _, _ in turn], rate - math.floor(rate), [int(hashlib.md5(k.encode()).hexdigest()[:13], 16) / 2**52 for k in keys])
            for i, (n, _, d) in enumerate(turn):
                out[d, -n] = math.floor(rate) + (i in taken)
    return out, want


def test_draws_against_plain_code_and_near_the_target(spark):
    r = random.Random(8)
    rows = [(i, f"s{i % 7}" if i % 7 else None, min(20_000, int(r.paretovariate(0.8) * 20)) if i % 11 else 0) for i in range(350)] + [(1000 + i, "hot", r.randint(0, 500)) for i in range(900)]
    df = spark.createDataFrame([(d, s, " ".join(["w"] * n)) for d, s, n in rows], "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(df).collect()
    want, targets = plain_mix(rows)
    assert {(x["doc_id"], x["size"]): x["copies"] for x in got} == want
    taken = {}
    for x in got:
        taken[x["source"]] = taken.get(x["source"], 0) + x["copies"] * x["size"]
    assert all(abs(taken[s] / targets[s] - 1) < 0.05 for s in taken)
    # 400 sources alike but for their documents' ids: a document's extra copy comes as often as the rate's fraction says
    sizes = [9000, 2000, 700, 300, 300, 40, 7, 1, 0]
    alike = spark.createDataFrame([(k * 100 + i, f"s{k}", n) for k in range(400) for i, n in enumerate(sizes)], "doc_id long, source string, n long")
    out = mixing.mix(alike, share=1.3, weights=(1,), words=F.col("n")).groupBy((F.col("doc_id") % 100).alias("i")).agg(F.avg("copies").alias("copies"), F.avg(F.col("target") / F.col("source_size")).alias("rate")).collect()
    assert len(out) == len(sizes) and all(abs(x["rate"] - 1.3) < 1e-9 and abs(x["copies"] - 1.3) < 4 * math.sqrt(0.21 / 400) for x in out)


def test_real_licence_texts(spark):
    t = dict(license_scan.TEXTS)
    bsd = "Copyright (c) 2020, Jane Roe\nAll rights reserved.\n\n" + t["BSD-3-Clause"].replace(": ", ":\n\n").replace(". ", ".\n\n")
    head = "      GNU GENERAL PUBLIC LICENSE\n         Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n      Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"
    source = "/*\n * Foo is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * Foo is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details.\n */\nint main() {}"
    long = " ".join(f"license w{i}" for i in range(10_000))
    rows = [
        (1, "a/LICENSE", bsd), (2, "a/x.c", "int x;"), (3, "g/COPYING", head), (4, "g/y/y.c", "y"), (5, "h/z.c", source), (6, "i/a.py", "# SPDX-License-Identifier: MIT\nx = 1"),
        (7, "i/b.rs", "// SPDX-License-Identifier: Apache-2.0\n"), (8, "j/LICENSE-MIT", "MIT License\n\nCopyright (c) 2021 X\n\n" + t["MIT"]), (9, "j/k.c", long), (10, "k/LICENSE", long), (11, "k/l.c", None),
    ]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "GPL-3.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: "MIT", 7: "Apache-2.0", 8: "MIT", 9: "MIT", 10: None, 11: None}


def test_licence_ties_go_by_name(spark):
    rows = [(1, "x/LICENSE", "SPDX-License-Identifier: MIT"), (2, "x/COPYING", "SPDX-License-Identifier: ISC"), (3, "x/y.c", ""), (4, "z.c", "# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: ISC")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("ISC", "own"), 3: ("ISC", "inherited"), 4: ("ISC", "own")}


def test_licenses(spark, empty, messy):
    rows = [
        (1, "a/b/c/x.py", "code\nReleased under the MIT License.\nmore code here" + " and there" * 9),
        (2, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.\n" + "Terms apply. " * 40),
        (3, "a/b/c/d/y.py", "nothing"),
        (4, "a/z.py", "A long remark that merely mentions that a license of some sort might be needed by whoever reads along"),
        (5, None, "Licensed under CC BY-NC 4.0."),
        (6, "a/b/q.py", None),
        (7, "LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (8, "top.py", ""),
        (8, "top.py", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "own", None), 3: ("Apache-2.0", "inherited", "a/b"), 4: ("GPL-3.0", "inherited", ""), 5: ("CC-BY-NC-4.0", "own", None),
        6: ("Apache-2.0", "inherited", "a/b"), 7: ("GPL-3.0", "own", None), 8: ("GPL-3.0", "inherited", ""),
    }
    assert license_scan.scan(df).count() == len(rows)
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(messy).count() == messy.count()


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("http://A.Example.org/en/1?x#y", "a.example.org", "/en/1"), ("https://h", "h", ""), ("h/x", "", ""), (None, "", ""), ("a://b?c://d/e", "b", ""), ("x://h#f/g", "h", ""), ("://", "", ""), ("s://É.com\n/p\nq", "É.com\n", "/p\nq")],
)
def test_url_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(url_reputation.host_of(F.col("url")), url_reputation.path_of(F.col("url"))).head()) == (host, path)


def test_rules(spark):
    cases = {
        ("example.org", "/en/12"): ("example.org/en/1", "block"), ("m.example.org", "/en/2"): ("org/", "allow"), ("example.org", ""): (None, None), ("badexample.org", "/es/"): ("org/", "allow"), ("x.org", "/es/"): ("org/", "allow"),
        ("a.b.com", "/de/9"): ("com/de/", "block"), ("com", "/fr/"): ("com/fr/", "allow"), ("", ""): (None, None), ("net", "/de/"): (None, None),
    }
    df = spark.createDataFrame(list(cases), "host string, path string")
    got = {(r["host"], r["path"]): (r["rule"], r["rule_verdict"]) for r in url_reputation.ruled(df, url_reputation.RULES).collect()}
    assert got == cases
    assert url_reputation.ruled(df, ()).filter("rule IS NOT NULL").count() == 0


def test_reputation(spark):
    pages = [(i, f"http://bad.site{i % 3}.net/p{i}") for i in range(300)] + [(300 + i, f"http://ok{i % 9}.fine.net/{i}") for i in range(300)] + [(900, "http://new.site0.net/"), (901, None), (902, "junk"), (903, "http://sole.example/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(600) if i % 2] + [(None, 1), (901, None), (5555, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_reputation.judge(df, outcomes).collect()}
    assert len(got) == len(pages) and got[0]["verdict"] == "block" and got[300]["verdict"] == "allow"
    assert got[900]["mean"] > got[903]["mean"] and got[901]["host"] == "" and got[902]["path"] == ""
    nothing = url_reputation.judge(df, outcomes.limit(0)).collect()
    assert {r["verdict"] for r in nothing} == {"allow"} and {round(r["mean"], 9) for r in nothing} == {0.5}
    assert url_reputation.judge(df.limit(0), outcomes).count() == 0


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [("a.b.example.org", "example.org", "org"), ("shop.example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1", ""), ("localhost", "localhost", "localhost"), ("", "", "")],
)
def test_domains(spark, host, domain, suffix):
    df = spark.createDataFrame([(host,)], "host string")
    assert tuple(df.select(url_reputation.domain_of(F.col("host")), url_reputation.suffix_of(F.col("host"))).head()) == (domain, suffix)


def test_reputation_query_blocks_bad_hosts(spark, tmp_path):
    """Hosts whose documents are labelled bad more often than the pages at large are blocked, rules go before."""
    from loomdex.llm.queries import QUERIES

    hosts = ["good.net", "spam.co.uk", "deep.spam.co.uk", "mixed.net", "example.org"]
    pages = [(i, f"http://{hosts[i % 5]}/en/{i}?q") for i in range(1000)] + [(5000, "http://other.spam.co.uk/x"), (5000, "http://other.spam.co.uk/x"), (5001, None), (5002, "http://deep.spam.co.uk/fr/")]
    bad = {"good.net": 0.02, "spam.co.uk": 0.9, "deep.spam.co.uk": 0.95, "mixed.net": 0.3, "example.org": 0.9}
    r = random.Random(1)
    labels = [(i, int(r.random() > bad[hosts[i % 5]]), 0) for i in range(1000) if i % 3]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = QUERIES["op10_url_reputation"](spark, f"file://{tmp_path}").collect()
    assert len(rows) == len(pages)
    verdicts = {h: {x["verdict"] for x in rows if x["host"] == h and x["rule"] is None} for h in {x["host"] for x in rows}}
    assert verdicts["good.net"] == {"allow"} and verdicts["spam.co.uk"] == verdicts["deep.spam.co.uk"] == {"block"} and verdicts["mixed.net"] == {"allow"}
    assert verdicts["other.spam.co.uk"] == {"block"}  # by its domain alone
    assert {x["verdict"] for x in rows if x["rule"] == "org/"} == {"allow"} and {x["verdict"] for x in rows if x["rule"] == "example.org/en/1"} == {"block"}


def plain_sites(rows, most=quality.MOST_STRENGTH):
    """path means in plain code of ``rows(host, path, y or None)``."""

    def strength(groups):
        over = sum(n * (g / n - mu) ** 2 - mu * (1 - mu) for n, g, mu in groups if n > 1)
        room = sum((n - 1) * mu * (1 - mu) for n, g, mu in groups if n > 1)
        return min(most, max(1.0, 1 / max(1e-6, min(1.0, over / room)) - 1)) if room else most

    def count(key):
        out = {}
        for h, p, y in rows:
            n, g = out.get(key(h, p), (0, 0))
            out[key(h, p)] = (n + (y is not None), g + (y or 0))
        return out

    (n, g), hosts, paths = count(lambda h, p: 0)[0], count(lambda h, p: h), count(lambda h, p: (h, p))
    mu = (g + 1) / (n + 2)
    k = strength([(n, g, mu) for n, g in hosts.values()])
    host_mean = {h: (g + k * mu) / (n + k) for h, (n, g) in hosts.items()}
    kp = strength([(n, g, host_mean[h]) for (h, _), (n, g) in paths.items()])
    return {(h, p): ((g + kp * host_mean[h]) / (n + kp), host_mean[h], mu) for (h, p), (n, g) in paths.items()}


def test_posteriors_against_plain_code(spark):
    r = random.Random(6)
    rows = []
    for i in range(500):
        h, p = r.choice(["a", "b", "c", None]), r.choice(["x", "y", None])
        rows.append((i, "some words", h, p, None if r.random() < 0.3 else int(r.random() < {"a": 0.9, "b": 0.4, "c": 0.6, None: 0.5}[h])))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, y int")
    want = plain_sites([(h, p, y) for _, _, h, p, y in rows])
    model = {"share": 0.4}
    got = quality.classify(df, df.select("doc_id", "y"), ("doc_id", "host", "path"), model=model).collect()
    assert len(got) == len(rows)
    for x in got:
        path_mean, host_mean, mu = want[x["host"], x["path"]]
        logit = lambda q: math.log(q / (1 - q))
        score = 1 / (1 + math.exp(-(logit(0.4) + logit(path_mean) - logit(mu))))
        assert math.isclose(x["path_mean"], path_mean) and math.isclose(x["host_mean"], host_mean) and math.isclose(x["score"], score) and x["keep"] == (score >= 0.5)


def test_quality_query_on_unseen_documents(spark, tmp_path):
    """Accuracy of op6 on labels that the fit didn't get: a third is taken out of the labels' table."""
    import os

    from loomdex.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.fold(F.col("doc_id")) == 1
    labels.filter(~held).write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = QUERIES["op6_quality_classifier"](spark, f"file://{tmp_path}").join(labels.filter(held), "doc_id").collect()
    assert np.mean([r["keep"] == bool(r["quality"]) for r in rows]) >= 0.9
