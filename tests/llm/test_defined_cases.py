"""Nulls, repeated rows, ties, empty tables and clashing columns of operators and stages, and plain replays of their methods."""

import bisect
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableprobe.llm import chunk_bpe, embedding_dedup, language_id, packing, ring_sharding, token_scan, zip_warc
from tableprobe.llm.common import run_dir

SF = "/root/testdata/sf0.001"
WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


# ---- 1 embeddings


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_with_null_and_repeated_ids(spark, kind):
    rows = [(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (None, [2.0, 4.0], 7), (2, [-1.0, 5.0], 7), (None, None, 7)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, links long").withColumn("component", F.lit("clash"))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links_and_components(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (None, 0, None, True)], key=str)


# ---- 2 packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_packing_against_a_plain_replay(rule, seed):
    """Every open bin is looked at for each piece; what remains in the bins is the same."""
    cap = packing.Capacity(tokens=1000, documents=5, attention=400_000, weights=(1.0, 0.3, 0.2))
    lengths = np.sort(np.random.default_rng(seed).integers(1, 600, 250))[::-1].copy()
    full, bins = (cap.tokens, cap.documents, cap.attention), []
    for n in lengths.tolist():
        need, best = (n, 1, n * n), None
        for k, left in enumerate(bins):
            after = [a - b for a, b in zip(left, need, strict=True)]
            if min(after) >= 0:
                if rule == "norm":
                    value = -sum(w * (a / f) ** 2 for w, a, f in zip(cap.weights, after, full, strict=True))
                else:
                    value = sum(w * (d / f) * (a / f) for w, d, a, f in zip(cap.weights, need, left, full, strict=True))
                if best is None or value > best[0]:
                    best = (value, k)
        if best is None:
            bins.append(list(full))
            best = (0, len(bins) - 1)
        bins[best[1]] = [a - b for a, b in zip(bins[best[1]], need, strict=True)]
    found = packing.best_fit(lengths, cap, rule)
    left = [(1000 - own.sum(), 5 - len(own), 400_000 - (own**2).sum()) for own in (lengths[found == b] for b in range(found.max() + 1))]
    assert sorted(map(tuple, bins)) == sorted(left)


def test_packing_of_nulls_repeated_rows_and_clashing_columns(spark):
    long = "stone " * 9000
    rows = [(None, "a b"), (1, long), (1, long), (2, None), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "bin", "length", "fill", "piece", "grp")})
    n = len(Tokenizer.from_file(WORD).encode(long, add_special_tokens=False).ids) + 1
    assert n > 8192
    pieces = [(1, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))] * 2 + [(None, 0, 0, 3)] + [(2, 0, 0, 1)] * 3
    got = packing.pack(packing.pieces(df, WORD, with_ids=False).withColumns({"fill": F.lit("clash"), "row": F.lit("clash")})).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got), key=str) == sorted(pieces, key=str)
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == [0, *np.cumsum([k for _, k in sorted(s)])[:-1]] and sum(k for _, k in s) <= 4096


# ---- 3 chunk BPE


def test_wrong_joins_are_repaired(monkeypatch):
    """Cuts in the midst of words: chunks are encoded anew until both sides of every join agree."""
    encoder, t = chunk_bpe.ChunkEncoder(BYTE, RANKS, P.PATTERN), Tokenizer.from_file(BYTE)
    monkeypatch.setattr(chunk_bpe, "cuts", lambda data: (np.unique([0, *range(11, len(data), 11), len(data)]), None))
    for text in ("nothing said here, of harbours and lanterns; 1234567 of them!", "it's\nwhat we'll say: understanding understandings", "x" * 40):
        before = encoder.repaired
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert encoder.repaired > before


def test_chunks_of_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a word"), (1, "a word"), (1, "a word"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "route", "ids", "n_tokens", "decoded")})
    ids = np.array(Tokenizer.from_file(BYTE).encode("a word", add_special_tokens=False).ids, "<u4").tobytes()
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in chunk_bpe.encode(df, BYTE, RANKS, P.PATTERN, decoded=True).collect()]
    want = [(k, len(ids) // 4, ids, "a word") for k in (None, 1, 1)] + [(2, 0, b"", "")] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunk_bpe.encode(df.filter("false"), BYTE, RANKS, P.PATTERN).count() == 0


# ---- 5 WARC


def test_packages_of_repeated_rows(spark):
    """The largest id of a payload may come twice: both are responses. Records are spread over several packages."""
    rows = [(5, "u", "p"), (5, "u", "p"), (3, "u", "p"), (3, "v", "p"), (None, "w", "p"), (1, None, "q" * 100_000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("n", "sha1", "head", "refers_to")})
    packages = zip_warc.write_packages(zip_warc.roles(pages).repartition(3), run_dir(spark, "warc"))
    assert packages.count() > 1
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in zip_warc.read_records(zip_warc.locate(packages)).collect()]
    want = [(5, 1, "response", None)] * 2 + [(3, 1, "revisit", 5)] * 2 + [(None, 1, "revisit", 5), (1, 100_000, "response", None), (None, 0, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- 6 language


def plain_ngrams(text, n):
    line = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    line = " " * (n - 2) + line + " " if line else ""
    return [line[k : k + n] for k in range(len(line) - n + 1)]


def test_languages_against_plain_sets(spark):
    """Shares of n-grams that a language holds, told from sets: the corrected popcounts come near them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = language_id.Settings()
    model = language_id.train(docs.filter(~language_id.held_out()), s)
    counts, rows = defaultdict(Counter), docs.collect()
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts[r["lang"]].update(plain_ngrams(r["text"], s.n))
    sets = {lang: {g for g, n in c.items() if n >= max(2, s.floor * c.total())} for lang, c in counts.items()}
    langs, scores = language_id.score([r["text"] for r in rows], model)
    assert model.languages == tuple(sorted(sets))
    for r, lang, score in zip(rows, langs, scores, strict=True):
        grams = plain_ngrams(r["text"], s.n)
        shares = {k: sum(g in v for g in grams) / len(grams) for k, v in sets.items()} if grams else {}
        assert score == pytest.approx(max(shares.values(), default=0), abs=0.03)
        assert (lang == "und") == (not grams) and shares.get(lang, 0) >= max(shares.values(), default=0) - 0.03


def test_languages_of_nulls_ties_and_repeated_rows(spark):
    learn = spark.createDataFrame([(k, "abcd efgh", lang) for k in range(3) for lang in ("l2", "l1")] + [(None, "abcd", None)], "doc_id long, text string, lang string")
    model = language_id.train(learn, language_id.Settings(places=1 << 12))
    rows = [(None, "abcd", "x"), (1, "abcd", "x"), (1, "abcd", "x"), (2, None, "x"), (3, "12", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(df, model).collect()]
    assert sorted(got, key=str) == sorted([(None, "l1"), (1, "l1"), (1, "l1"), (2, "und"), (3, "und")], key=str)
    assert language_id.predict(df.filter("false"), model).count() == 0


# ---- 8 separator scan


def test_scan_of_nulls_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit("clash"), "ordinal": F.lit("clash")})
    for some, want in ((df, [(None, 2), (1, 2), (1, 2), (2, 0), (2, 0)]), (df.filter("false"), [])):
        folder = run_dir(spark, "tokens")
        written = token_scan.write_token_files(some, folder, WORD, 49407)
        counts = token_scan.scan(token_scan.token_files(spark, folder), folder, 49407)
        got = [(r["doc_id"], r["n_tokens"]) for r in written.join(counts, ["file", "ordinal"], "full").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# ---- 9 ring


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_against_a_plain_replay(spark, slack):
    """Keys walk clockwise one at a time: cells in their order, keys of a cell by their hash, the next shard at each turn."""
    rows = [(k % 700, f"text {k % 90}") for k in range(1500)] + [(None, None)] * 7 + [(3, None)] * 9 + [(9, "hot")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "slot": F.lit("clash"), "n": F.lit(1)})
    size, crc = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = df.select("doc_id", size.alias("size"), crc.alias("crc"), F.shiftrightunsigned(F.xxhash64("doc_id"), 52).alias("cell"), F.xxhash64("doc_id", size, crc, F.lit(0).cast("long")).alias("h"))
    nodes = []
    for shard in range(8):
        for v in range(64):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            nodes.append((h % 4096, h, shard))
    nodes.sort()
    cells = defaultdict(list)
    for r in keyed.collect():
        cells[r["cell"]].append((r["h"], r["doc_id"], r["size"], r["crc"]))
    total = len(rows)
    bound = [-(-total * 5 // 32)] * 8 if slack else [total // 8 + (s < total % 8) for s in range(8)]
    taken, want = [0] * 8, []
    waiting = {c: sorted(keys, key=lambda k: k[0])[::-1] for c, keys in cells.items()}
    for turn in range(8):
        for cell in sorted(waiting):
            first = bisect.bisect_left(nodes, (cell,))
            shard = list(dict.fromkeys(nodes[(first + k) % len(nodes)][2] for k in range(len(nodes))))[turn]
            while waiting[cell] and taken[shard] < bound[shard]:
                want.append((*waiting[cell].pop()[1:], shard, taken[shard]))
                taken[shard] += 1
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in ring_sharding.assign(df, slack=slack).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- stages of the pipeline


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("lang_pred", "score", "stays", "kept", "n_words", "chosen", "digest", "row", "fill")}
    good = base.filter("n_chars > 400 and lang is not null").limit(3)
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (-1, "", None, "s", 0), (-2, None, None, None, None), (-3, "%% 12 " * 20, "en", "s", 9)], base.schema)
    twice = good.limit(1).withColumn("doc_id", F.lit(None).cast(base.schema["doc_id"].dataType))
    docs = base.unionByName(good).unionByName(odd).unionByName(twice).withColumns(clash)
    rows = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        found = Counter(map(tuple, kept.collect()))
        assert found and not found - rows, name  # rows as they were, none made up
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        if name != "minhash_near_dedup":
            assert all(r[1] for r in found), name
            assert all(found[r] == rows[r] for r in found), name
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert pieces.filter("piece = 0").count() == sum(rows.values())
    assert corpus_pipeline.pack(spark, docs.filter("false"), SF).count() == 0
