"""Phrases of a word graph against counters over all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableprobe.llm import phrase_graph


def plain(rows, s):
    words, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        words[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, s.most + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= s.least}
        rows = []
        for p, a in found.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * b >= s.percent * a for q, b in found.items()):
                continue
            score, _, left, right = min((s.scale * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, text, left, right) in enumerate(sorted(rows)[: s.top], 1):
            out.append((lang, rank, text.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocab = ["the", "The", "a", "cat", "dog s", "é", "x\x00y", "sat", "ÀB", "on", "mat"] + [f"w{k}" for k in range(30)]
    passage = " ".join(rng.choice(vocab) for _ in range(25))
    out = [(None, None), ("en", ""), ("en", " \t "), ("fr", "...,,;"), ("en", "one"), (None, "a\ta\t a a a a a a.a a"), ("de", "long" * 5000)]
    for _ in range(120):
        parts = [rng.choice(vocab[: rng.choice((4, 41))]) + rng.choice(["", "", "", ".", ", ", "\n", "\r\n", "!?"]) for _ in range(rng.randrange(30))]
        out.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t"]).join([*parts, passage if rng.random() < 0.3 else "end"])))
    return out


@pytest.mark.parametrize("seed,bits,slice_words", [(1, 26, 1000), (2, 13, 60), (3, 26, 1_000_000)])
def test_against_counters(spark, seed, bits, slice_words):
    rows, s = texts(seed), phrase_graph.Settings(least=3, top=40, slot_bits=bits, slice_words=slice_words)
    df = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "lang string, text string, n int, `phrase a.b` string").repartition(3)
    got = sorted(tuple(r)[:8] for r in phrase_graph.phrases(df, s).collect())
    assert got == plain(rows, s) and len(got) > 40


def test_other_lengths_and_no_phrases(spark):
    rows = texts(5)
    df = spark.createDataFrame(rows, "lang string, text string")
    for most in (2, 3, 5):
        s = phrase_graph.Settings(most=most, least=4, top=1000)
        assert sorted(tuple(r)[:8] for r in phrase_graph.phrases(df, s).collect()) == plain(rows, s)
    assert phrase_graph.phrases(df.filter("false")).count() == 0
    assert phrase_graph.phrases(df.limit(3)).count() == 0


def test_passages_are_single_paths(spark):
    rng = random.Random(1)
    passages = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate((4, 5, 17, 70))]
    rows = [(k, " ".join([f"r{rng.randrange(10**12)}", p, f"r{rng.randrange(10**12)}"])) for p in passages for k in range(6)] + [(9, passages[2] + ". " + passages[2])]
    df = spark.createDataFrame(rows, "k int, text string").select(F.lit("en").alias("lang"), "text")
    s = phrase_graph.Settings(least=6)
    edges, nodes = [c.filter("f >= 6") for c in phrase_graph.shorter(phrase_graph.graph(df, s), s)][:1:-1]
    got = {(r["passage"], r["f"]) for r in phrase_graph.paths(phrase_graph.compacted(edges, nodes, s), s).collect()}
    assert got == {(p, 8 if k == 2 else 6) for k, p in enumerate(passages)}


def test_steps_of_slots():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (10, 300, 100_000):
        slots = np.sort(rng.integers(0, top, 500))
        assert (phrase_graph._slots(phrase_graph._steps(slots)) == slots).all()
    assert len(phrase_graph._slots(b"")) == 0


def test_rows_of_the_graph_are_phrases_that_count(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(8)]
    rows = [("en", " ".join(rng.choice(words) for _ in range(512))) for _ in range(8)] + [("en", "w1 w2 w3 w4 w5")] * 40
    s = phrase_graph.Settings(least=30, slice_words=300)
    for times in (1, 3):  # pairs come 64 times, most of three and four words 8 times a copy
        df = spark.createDataFrame(rows * times, "lang string, text string").repartition(4)
        got = {r["phrase"]: r["n"] for r in phrase_graph.graph(df, s).collect()}
        counts = Counter()
        for _, text in rows * times:
            w = text.split()
            counts.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
        often = {" ".join(p) for p, f in counts.items() if f >= s.least}
        assert got.pop("") == sum(f for p, f in counts.items() if len(p) == 1)
        assert set(got) <= often and "w1 w2 w3 w4" in got
        assert sorted(tuple(r)[:8] for r in phrase_graph.phrases(df, s).collect()) == plain(rows * times, s)


def test_slots_that_are_shared_and_slots_that_grow(spark):
    rows = texts(11)
    df = spark.createDataFrame(rows, "lang string, text string")
    few = phrase_graph.Settings(least=3, top=1000, slot_bits=13, most_slot_bits=13, slot_bytes=1)
    more = phrase_graph.Settings(least=3, top=1000, slot_bits=13, most_slot_bits=20, slot_bytes=1)
    size = sum(len((text or "").encode()) for _, text in rows)
    assert 2**13 < size < 2**20
    assert phrase_graph._sized(df, few).slot_bits == 13 and 2 ** (phrase_graph._sized(df, more).slot_bits - 1) <= size <= 2 ** phrase_graph._sized(df, more).slot_bits
    assert phrase_graph._sized(df.filter("false"), more).slot_bits == 13
    for s in (few, more):
        assert sorted(tuple(r)[:8] for r in phrase_graph.phrases(df, s).collect()) == plain(rows, s)
