"""Packing beside lexical neighbours: whole documents, gapless sequences, and BM25 against plain loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableprobe.llm import lexical_packing
from tableprobe.llm.lexical_packing import Settings, Shard, Statistics

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def checked(rows, pieces, s):
    """Each id of each document lies in one piece, sequences have no gaps; returns documents by sequence."""
    bpe = Tokenizer.from_file(FILES[0])
    bpe.no_truncation()
    bpe.no_padding()
    want = sorted(([*bpe.encode(t or "", add_special_tokens=False).ids, s.end_id] for _, t in rows), key=len)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    if len({i for i, _ in rows}) == len(rows):
        for (i, _), ids in zip(sorted(rows, key=lambda r: len(bpe.encode(r[1] or "", add_special_tokens=False).ids)), want, strict=True):
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, crc(ids[at : at + p["length"]]), len(ids)) and p["length"] > 0
                at += p["length"]
            assert at == len(ids)
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == s.window or at < s.window and at & (at - 1) == 0
    return by_sequence


def topics(seed, n):
    """Texts of five topics with words of their own among common ones."""
    rng = random.Random(seed)
    names = ["ocean tide reef coral shark whale harbour sail", "bread flour oven yeast dough butter crust bake", "engine piston valve torque gear clutch diesel motor",
             "guitar chord melody rhythm drum violin tempo song", "orbit planet comet lunar rocket stellar galaxy probe"]
    common = "the of and to in is was for with on as by at from that this it".split()
    return [(k, " ".join(rng.choice(names[k % 5].split()) if rng.random() < 0.4 else rng.choice(common) for _ in range(rng.randrange(20, 90)))) for k in range(n)]


def test_pieces_are_whole(spark):
    s = Settings(window=64, shard_rows=20, tried=4)
    rows = topics(1, 150) + [(1000, None), (1001, ""), (1002, "<|endoftext|> a <|endoftext|>"), (1003, "word " * 2000), (None, "no id"), (1004, "é ß " * 50)] + [(2000 + k, "one text many times") for k in range(60)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, row int, `start a.b` string").repartition(4)
    by_sequence = checked(rows, lexical_packing.lexical_packing(df, *FILES, s).collect(), s)
    assert len(by_sequence) > 20
    odd = [(5, "same"), (5, "same"), (None, "x"), (None, None)]
    checked(odd, lexical_packing.lexical_packing(spark.createDataFrame(odd, "doc_id int, text string"), *FILES, s).collect(), s)
    assert lexical_packing.lexical_packing(df.filter("false"), *FILES, s).count() == 0


def test_neighbours_share_topics(spark):
    s = Settings(window=256, shard_rows=64)
    rows = topics(2, 600)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_sequence = checked(rows, lexical_packing.lexical_packing(df, *FILES, s).collect(), s)
    shares = [Counter(p["doc_id"] % 5 for p in own).most_common(1)[0][1] / len(own) for own in by_sequence.values() if len(own) > 2]
    assert np.mean(shares) > 0.9  # by chance about 0.4


def test_scores_are_bm25():
    rng, s, size = np.random.default_rng(1), Settings(k1=1.4, b=0.6), 60
    ids = [rng.integers(0, 40, n).astype("<u4") for n in (30, 1, 0, 50, 12, 30)]
    idf, mean = rng.random(size).astype("f4"), 17.0
    index = Shard(ids, Statistics(idf, mean), s)
    for seed, own in enumerate(ids):
        want = [sum(idf[t] * c * (s.k1 + 1) / (c + s.k1 * (1 - s.b + s.b * len(x) / mean)) for t, c in Counter(x.tolist()).items() if t in set(own.tolist())) for x in ids]
        assert index.scores(seed) == pytest.approx(want)


def test_statistics_count_all_documents(spark):
    rows = [(0, "a b a"), (1, "a"), (2, None), (3, "c" * 40)]
    encoded = lexical_packing.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *FILES)
    stats = lexical_packing.statistics(encoded, 50257)
    df = Counter(t for r in encoded.collect() for t in set(np.frombuffer(r["ids"], "<u2").tolist()))
    assert all(stats.idf[t] == pytest.approx(math.log(1 + (4 - n + 0.5) / (n + 0.5)), rel=1e-5) for t, n in df.items())
    assert stats.mean_length == sum(r["n"] for r in encoded.collect()) / 4


def test_greedy_choice_of_a_shard():
    """The best neighbour that fits comes whole; one that does not is cut and goes on as the seed."""
    stats, s = Statistics(np.ones(10, "f4"), 4.0), Settings(window=12)
    ids = [np.array(x, "<u4") for x in ([1, 2, 3], [5, 5, 6, 7, 8], [1, 2, 3, 4], [1, 9, 9, 9, 9, 9])]
    filler = lexical_packing.Filler(s)
    filler.shard(0, [len(x) + 1 for x in ids], Shard(ids, stats, s))
    filler.finish()
    assert filler.placed == [(0, 0, 4, 0, 0), (2, 0, 5, 0, 4), (3, 0, 3, 0, 9), (3, 3, 4, 1, 0), (1, 0, 4, 1, 4), (1, 4, 2, 2, 0)]
