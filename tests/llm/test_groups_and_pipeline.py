"""Near-duplicates, components, sharding and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.llm import components, embedding_dedup, quality_rules, ring_sharding, sketch_dedup

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def least(self, ids):
        out = {}
        for k, x in enumerate(ids):
            r = self.find(k)
            out[r] = x if r not in out or (x is not None and (out[r] is None or x < out[r])) else out[r]
        return [out[self.find(k)] for k in range(len(ids))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)] + [(7, 7), (None, 3)]
    sets = Sets(500)
    for a, b in edges:
        if a is not None:
            x, y = sets.find(a), sets.find(b)
            sets.up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = sets.least(list(range(500)))
    assert got and all(least[k] == v for k, v in got.items()) and {x for e in edges if e[0] not in (None, e[1]) for x in e} == set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vecs = [(c + s * rng.standard_normal(16)).astype("f4").tolist() for c in centres for s in (0, 0, 0.05, 0.1, 0.2, 0.3, 0.3)] + rng.standard_normal((150, 16)).astype("f4").tolist()
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(vecs)] + [(1000 + i, v, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links_and_components(df, embedding_dedup.Settings(bucket=8, block=6)).collect()}
    x = np.array(vecs, "f4").astype("f8")
    near = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= 0.9
    sets = Sets(len(vecs))
    for i, j in zip(*np.nonzero(near), strict=True):
        sets.up[sets.find(i)] = sets.find(j)
    least = sets.least(list(range(len(vecs))))
    assert {k: v for k, v in got.items() if k < 1000} == {k: (int(near[k].sum()) - 1, least[k], least[k] == k) for k in range(len(vecs))}
    assert {k: v for k, v in got.items() if k >= 1000} == {1000 + i: (0, 1000 + i, True) for i in range(len(bad))}
    assert embedding_dedup.links_and_components(df.filter("false")).count() == 0


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-170, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1e300]), (7, [0.0, 0.0]), (None, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links_and_components(df).collect()}
    assert got == {1: (4, 1, True), 2: (4, 1, False), 3: (4, 1, False), 4: (4, 1, False), None: (4, 1, False), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True)}


def brute(rows, n, percent):
    sets = [sketch_dedup.shingle_set(sketch_dedup.normalised(t), n) for _, t in rows]
    groups = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                groups.up[groups.find(i)] = groups.find(j)
    least = groups.least([k for k, _ in rows])
    return [(k, len(s), c, k == c) for (k, _), s, c in zip(rows, sets, least, strict=True)]


def planted(seed=5):
    """Copies, near copies in chains, and a passage that most texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "one two", "One TWO", "one"]
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(rng.randrange(20, 60))]))
    base = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(150)] = word()
        texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    for _ in range(12):  # a chain
        at = rng.randrange(len(base) - 6)
        base = base[:at] + [word() for _ in range(3)] + base[at + 3 :]
        texts.append(" ".join(base))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "list_rows"), [(5, 80, 128), (3, 85, 3), (3, 60, 2)])
def test_near_copies_against_all_pairs(spark, n, percent, list_rows):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash"))
    s = sketch_dedup.Settings(words=n, percent=percent, list_rows=list_rows, block_rows=6, block=7, filter_bits=12)
    got = sorted(tuple(r) for r in sketch_dedup.components(df, s).collect())
    assert got == sorted(brute(rows, n, percent))


def hub(n, percent, copies, seed, size=120):
    """An original and copies of it just above the threshold, each with scattered words of its own."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(size)]
    whole = sketch_dedup.shingle_set(" ".join(base).encode(), n)
    for _ in range(copies):
        copy, spots = list(base), list(range(size))
        rng.shuffle(spots)
        for spot in spots:
            was, copy[spot] = copy[spot], word()
            own = sketch_dedup.shingle_set(" ".join(copy).encode(), n)
            if 100 * len(whole & own) < percent * len(whole | own):
                copy[spot] = was
        out.append(" ".join(copy))
    return [*out, " ".join(base)]


@pytest.mark.parametrize(("n", "percent", "copies"), [(3, 85, 300), (5, 80, 3000)])
def test_a_hub_keeps_all_its_copies(spark, n, percent, copies):
    df = spark.createDataFrame(list(enumerate(hub(n, percent, copies, 3))), "doc_id long, text string")
    got = sketch_dedup.components(df, sketch_dedup.Settings(words=n, percent=percent)).select("component_id").distinct().collect()
    assert [tuple(r) for r in got] == [(0,)]  # all resemble their original


def test_pairs_in_a_corpus_of_one_passage(spark):
    """400 texts share most of their words, at 0.82 of each other; 100 pairs among them are linked, at 0.86."""
    rng, rows = random.Random(9), []
    word = lambda: f"{rng.getrandbits(40):x}"
    passage = [word() for _ in range(900)]
    for k in range(300):
        rows.append(passage + [word() for _ in range(100)])
        if k < 100:
            rows.append(rows[-1][:-50] + [word() for _ in range(50)])
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    got = sketch_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), sketch_dedup.Settings(words=3, percent=85))
    linked = {(r["component_id"], r["doc_id"]) for r in got.filter("not kept").collect()}
    assert linked == {(2 * k, 2 * k + 1) for k in range(100)}


def scattered(count, size, own, seed):
    """Copies of an original that is not among them, each with so many words replaced; every pair of neighbours at
    an even place also shares its replacements."""
    rng = random.Random(seed)
    word = lambda: f"{rng.getrandbits(40):x}"
    base, out = [word() for _ in range(size)], []
    for k in range(count):
        copy = list(base)
        spots = range(3, size - 3, size // own) if k % 4 else rng.sample(range(3, size - 3), own)
        for at in spots:
            copy[at] = word()
        out.append(" ".join(copy))
        if k % 4 == 0:
            out.append(" ".join(copy[:-1] + [word()]))
    return list(enumerate(out))


@pytest.mark.parametrize("own", [4, 7, 12])
def test_a_group_without_its_original(spark, own):
    rows = scattered(150, 150, own, own)
    s = sketch_dedup.Settings(words=3, percent=85, list_rows=4, block_rows=16, block=5)
    got = sorted(tuple(r) for r in sketch_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), s).collect())
    assert got == sorted(brute(rows, 3, 85))


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:55_000])), (3, " ".join(long[:40_000])), (4, "a b c")]
    got = sorted(tuple(r) for r in sketch_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), sketch_dedup.Settings(words=3, percent=85, list_rows=2)).collect())
    assert got == sorted(brute(rows, 3, 85))


def test_one_row_of_each_component(spark):
    one, two = "one two three four five six", "un deux trois quatre cinq six"
    rows = [(1, one, "a"), (2, two, "b"), (2, one, "c"), (3, two, "d"), (1, one, "e"), (None, "seven eight", "f"), (4, None, "g"), (4, None, "g"), (5, " ", "h"), (6, two.upper(), "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chosen string")
    got = sketch_dedup.representatives(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted([(r[0], r[1]) for r in kept], key=str) == sorted([(1, one), (2, two), (None, "seven eight"), (4, None), (4, None), (5, " ")], key=str)
    assert set(kept) <= set(rows)
    assert sketch_dedup.representatives(df.filter("false")).count() == 0


def test_near_copies_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in sketch_dedup.components(spark.read.parquet(f"{SF}/documents.parquet"), sketch_dedup.Settings(words=3, percent=85)).collect())
    assert got == sorted(brute(rows, 3, 85))


def test_estimates_of_texts_that_contain_each_other(spark):
    """k = 32 of 40 to 60 shingles: what is cut off must stay out of the union's least values."""
    rng, rows, pairs = random.Random(11), [], []
    for small, large in [(40, 47), (51, 60), (44, 51)] * 400:
        words = [f"{rng.getrandbits(40):x}" for _ in range(large + 2)]
        rows += [(len(rows), " ".join(words[: small + 2])), (len(rows) + 1, " ".join(words))]
        pairs.append((len(rows) - 2, len(rows) - 1))
    s = sketch_dedup.Settings(words=3, percent=85)
    got = sketch_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string"), s)
    assert all(r["sketch"] == sorted(r["sketch"]) for r in got.collect())
    side = lambda name: got.select(F.col("doc_id").alias(name), F.struct("n_shingles", "sketch").alias(f"x{name}"))
    both = spark.createDataFrame(pairs, "a long, b long").join(side("a"), "a").join(side("b"), "b")
    likely = {tuple(r) for r in both.filter(sketch_dedup._likely(F.col("xa"), F.col("xb"), s)).select("a", "b").collect()}
    assert likely == set(pairs)


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in sketch_dedup.components(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (9, 9, True)], key=str)
    assert sketch_dedup.components(df.filter("false")).count() == 0


def test_ring_shards(spark):
    rows = [(i, f"text {i % 50}") for i in range(2000)] + [(7, "hot")] * 3000 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = ring_sharding.assign(df).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {i: t for i, t in rows}
    for r in got:
        if r["doc_id"] is None:
            assert (r["size"], r["text_crc32"]) == (1, 0)
        elif r["doc_id"] != 7:
            data = text[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert ring_sharding.assign(df.filter("false")).count() == 0


def test_ring_moves_little(spark):
    df = spark.createDataFrame([(i, "x") for i in range(4000)], "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in ring_sharding.assign(df, n_shards=8, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring_sharding.assign(df, n_shards=9, slack=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35
    sizes = [list(a.values()).count(s) for s in range(8)]
    assert max(sizes) <= 4000 * 1.25 / 8 + 1


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    passing = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.POLICIES["v2"]).filter("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == passing
    told = corpus_pipeline.language(spark, kept, SF)
    assert told.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    assert len(rows) > 0.95 * len(passing)
    want = {k for k, _, c, stays in brute(rows, 5, 80) if stays}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_near_dedup", "best_fit_packing"]


def test_stage_keeps_one_of_a_large_group(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*hub(5, 80, 330, 7), "some other text of six words"])], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [0, 331]
