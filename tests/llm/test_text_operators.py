"""Operators on texts against plain Python, exact round trips and held-out accuracy."""

import array
import base64
import hashlib
import io
import math
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableprobe.llm import chunk_bpe, language_id, masked_lm, packing, quality_rules, token_scan, zip_warc
from tableprobe.llm.common import run_dir
from tableprobe.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = [None, "", " \t\n", "a", "word " * 30, "x" * 5000, "é́ Σας İ K", "a<|endoftext|>b c", "it's we'll  9th\n\n$$$ %%% |", "\x1c a b　c", "日本語 テスト", "Q" * 70 + " z"]


def frame(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 2 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_word_memo_equals_tokenizer(texts):
    t = Tokenizer.from_file(WORD)
    want = [array.array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    encode = WordEncoder(WORD)
    assert encode.by_words
    assert [x.tobytes() for x in encode(texts)] == want
    assert [x.tobytes() for x in encode(texts[::-1])] == want[::-1]  # from the memo


def test_packing_holds_every_piece_once(spark, docs):
    cut = packing.pieces(docs.select("doc_id", "text").unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000)), WORD)
    got = packing.pack(cut, packing.Capacity()).collect()
    t, of = Tokenizer.from_file(WORD), {}
    for r in got:
        of.setdefault(r["doc_id"], {})[r["piece"]] = r
    for r in [*docs.collect(), *[{"doc_id": 10_000 + i, "text": x} for i, x in enumerate(ODD)]]:
        ids = array.array("I", [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]).tobytes()
        parts = [of[r["doc_id"]][k] for k in range(len(of[r["doc_id"]]))]
        assert b"".join(bytes(p["ids"]) for p in parts) == ids
        assert [p["start"] for p in parts] == list(range(0, len(ids) // 4, 4096)) and all(p["length"] == 4096 for p in parts[:-1])
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 4096) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    cap = packing.Capacity(tokens=100, documents=3, attention=5000)
    lengths = np.sort(np.random.default_rng(1).integers(1, 70, 300))[::-1].copy()
    bins = packing.best_fit(lengths, cap, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 5000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), cap)


def test_norm_is_best_fit():
    assert packing.best_fit(np.array([60, 50, 40, 38]), packing.Capacity(tokens=100, attention=10**6)).tolist() == [0, 1, 0, 1]


def test_packing_of_nothing(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), WORD)).count() == 0


# ---- 3 chunk BPE


@pytest.fixture(scope="module")
def encoder():
    return chunk_bpe.ChunkEncoder(BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=30))
def test_chunks_equal_tokenizer(parts):
    encoder = chunk_bpe.chunk_encoder(BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = Tokenizer.from_file(BYTE)
    text = " ".join(parts)
    ids = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
    assert encoder.text(encoder.encode(text)) == t.decode(ids, skip_special_tokens=False)


def test_joins_are_repaired(encoder):
    data = b"some words here and " * 3
    left, right = encoder.chunk(b"say hel"), encoder.chunk(b"lo there")
    assert not encoder.agree(left, right)
    assert encoder.agree(encoder.chunk(data), encoder.chunk(b" and more"))


def test_query_round_trip(spark, docs):
    both = docs.select("doc_id", "text").unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000))
    got = {r["doc_id"]: r for r in chunk_bpe.encode(both, BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded=True).collect()}
    t, rows = Tokenizer.from_file(BYTE), both.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[r["doc_id"]]["ids"]), "<u4").tolist() == ids and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["decoded"] == t.decode(ids, skip_special_tokens=False)
    again = chunk_bpe.decode(spark.createDataFrame([(1, got[0]["ids"]), (2, None)], "k int, ids binary"), BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r["k"]: r["text"] for r in again.collect()} == {1: got[0]["decoded"], 2: ""}


def test_copies_share_chunks():
    encoder = chunk_bpe.ChunkEncoder(BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = " ".join(f"word{k * k % 997}" for k in range(2000))
    encoder.encode(text)
    first = encoder.encoded
    encoder.encode("a new beginning " + text)
    assert encoder.encoded - first <= 3 and encoder.reused >= first - 3


# ---- 4 quality rules


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if n[w] > 1:
            hit |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_ledger_against_plain_python(spark, docs):
    more = [*ODD, "a b c d e " * 4, "x y\nx y\n\nx y\n", "p q r s t u p q r s t"]
    both = docs.select("doc_id", "text").unionByName(frame(spark, more).withColumn("doc_id", F.col("doc_id") + 10_000))
    text = {r["doc_id"]: r["text"] for r in both.collect()}
    book = quality_rules.ledger(both)
    for r in book.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(text[r["doc_id"]])
    policy = quality_rules.POLICIES["v2"]
    kept = {r["doc_id"] for r in quality_rules.apply_policy(book, policy).filter("kept").collect()}
    clash = both.withColumns({"n_words": F.lit("mine"), "_words": F.lit(1), "failure_bits": F.lit(2.5)})
    rows = quality_rules.accepted(clash, policy).collect()
    assert {r["doc_id"] for r in rows} == kept and rows[0].asDict().keys() == set(clash.columns) and rows[0]["n_words"] == "mine"
    bits = [r["failure_bits"] for r in book.collect()]
    for r in quality_rules.ablation(book, policy).collect():
        assert r["n_failed"] == sum(b & r["bit"] != 0 for b in bits) and r["n_only"] == sum(b == r["bit"] for b in bits)


def test_rules_on_no_rows_and_repeated_rows(spark):
    assert quality_rules.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert [r["failure_bits"] & 1 for r in quality_rules.ledger(twice).collect()] == [1, 1, 1]


def test_policies_agree_with_labels(spark):
    base = "/root/testdata/sf0.01"
    book = quality_rules.apply_policy(quality_rules.ledger(spark.read.parquet(f"{base}/documents.parquet")), quality_rules.POLICIES["v2"])
    pairs = book.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in pairs) / len(pairs) > 0.97


# ---- 5 WARC


def test_packages_round_trip(spark):
    html = ["<p>a</p>", None, "<p>a</p>", "", "é" * 9, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(None, None, "solo")], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    packages = zip_warc.write_packages(zip_warc.roles(pages.repartition(2)), run_dir(spark, "warc"))
    got = {r["page_id"]: r for r in zip_warc.read_records(zip_warc.locate(packages, index_bytes=7)).collect()}
    heads = {h: max(i for i, x in enumerate(html) if (x or "") == (h or "")) for h in html}
    for i, h in enumerate(html):
        data, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if heads[h] == i else ("revisit", heads[h]))
        assert r["payload"] is None or bytes(r["payload"]) == data
    assert got[None]["record_type"] == "response"
    small = zip_warc.roles(pages, min_bytes=100)
    assert small.filter("refers_to is not null").count() == 0
    none = zip_warc.write_packages(zip_warc.roles(pages.filter("false")), run_dir(spark, "warc"))
    assert zip_warc.read_records(zip_warc.locate(none)).count() == 0


def test_records_of_one_package_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * 300) for i in range(200)], "page_id long, url string, html string")
    packages = zip_warc.write_packages(zip_warc.roles(pages.coalesce(1)), run_dir(spark, "warc"))
    read = zip_warc.read_records(zip_warc.locate(packages), stretch=4000).withColumn("task", F.spark_partition_id())
    rows = read.collect()
    assert len(rows) == 200 and len({r["task"] for r in rows}) > 3


def test_blocks_are_scanned_by_many_tasks(spark):
    folder = run_dir(spark, "tokens")
    token_scan.write_token_files(frame(spark, ["a b c d e f g h"] * 400).coalesce(1), folder, WORD, 49407)
    files = token_scan.token_files(spark, folder)
    blocks = token_scan.blocks(files, 2, block_tokens=64, task_bytes=512).withColumn("task", F.spark_partition_id()).collect()
    assert len(blocks) > 20 and len({r["task"] for r in blocks}) > 3
    got = token_scan.scan(files, folder, 49407, block_tokens=64, task_bytes=512).collect()
    assert len(got) == 400 and {r["n_tokens"] for r in got} == {8}


def test_zip64_directory(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr("b.txt", b"world!")
    raw = data.getvalue()
    end = raw.rfind(b"PK\x05\x06")
    n, size, at = struct.unpack_from("<HII", raw, end + 10)
    entries, wide, k = raw[at : at + size], b"", 0
    while k < len(entries):
        n_name = struct.unpack_from("<H", entries, k + 28)[0]
        head, (length,), (offset,) = bytearray(entries[k : k + 46 + n_name]), struct.unpack_from("<I", entries, k + 24), struct.unpack_from("<I", entries, k + 42)
        head[20:28] = b"\xff" * 8
        head[42:46] = b"\xff" * 4
        extra = struct.pack("<HHQQQ", 1, 24, length, length, offset)
        head[30:32] = struct.pack("<H", len(extra))
        wide += bytes(head) + extra
        k += 46 + n_name
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(wide), at)
    where = at + len(wide)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "z64.zip"
    path.write_bytes(raw[:at] + wide + record + struct.pack("<4sIQI", b"PK\x06\x07", 0, where, 1) + last)
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        found = {m.name: f.read_at(m.size, zip_warc.data_at(f, m)) for m in zip_warc.members(f, f.size())}
    assert found == {"a.txt": b"hello", "b.txt": b"world!"}
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "no.zip")) as f, pytest.raises(ValueError):
        zip_warc.members(f, f.size())


# ---- 6 language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter("not held_out"))
    rows = language_id.predict(docs, model).filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    odd = language_id.predict(frame(spark, [None, "", "123 %%%", "a"]).withColumn("score", F.lit("mine")), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in odd[:3]] == [("und", 0.0)] * 3 and odd[3]["lang_pred"] in model.languages


def test_filters_hold_what_was_learned_and_correct_false_positives(spark):
    texts = ["abcd efgh"] * 3 + ["wxyz stuv"] * 3
    rows = frame(spark, texts, lang=["l1"] * 3 + ["l2"] * 3)
    model = language_id.train(rows, language_id.Settings(places=1 << 12))
    langs, scores = language_id.score(["abcd efgh", "wxyz stuv", "qqqq"], model)
    assert langs[:2] == ["l1", "l2"] and scores[0] == scores[1] == 1.0 and scores[2] < 0.2
    assert language_id.train(rows.filter("false")).languages == ()
    assert language_id.predict(rows, language_id.train(rows.filter("false"))).first()["lang_pred"] == "und"


def test_ngrams_by_hand():
    _, n = language_id.ngrams(["ab, cd", None, "a", "!"], 3)
    assert n.tolist() == [5, 0, 1, 0]  # " ab cd " and " a " in threes


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + 50 * k) for k in range(70)]
    rows = frame(spark, [(x * 4 + " ") * 5 for x in letters], lang=[f"l{k:02d}" for k in range(70)])
    model = language_id.train(rows, language_id.Settings(places=1 << 14))
    assert language_id.score([(x * 4 + " ") * 5 for x in letters], model)[0] == list(model.languages)


# ---- 7 masked LM


def test_network_is_a_distribution_and_learns():
    s = masked_lm.Settings(classes=4, members=4, width=8, batch=64)
    net, rng = masked_lm.Network(s), np.random.default_rng(0)
    context = rng.integers(0, 16, (5, 4)).astype("int32")
    every = np.arange(16, dtype="int32")
    for row in context:
        assert np.exp(net.log_probs(np.repeat(row[None], 16, 0), every).astype("f8")).sum() == pytest.approx(1, abs=1e-4)
    target = ((context := rng.integers(2, 16, (4000, 4)).astype("int32"))[:, 1] + 1) % 16
    before = net.log_probs(context, target).mean()
    for k in range(0, 4000, 64):
        net.step(context[k : k + 64], target[k : k + 64])
    assert net.log_probs(context, target).mean() > before + 0.5


def test_scores_against_plain_loops(spark, docs):
    s = masked_lm.Settings(classes=8, members=8, width=8, rounds=1, stride=2)
    some = docs.select("doc_id", "text").unionByName(frame(spark, [None, " ", "one"]).withColumn("doc_id", F.col("doc_id") + 10_000))
    vocab = masked_lm.vocabulary(some, s)
    counts = Counter(w for r in some.collect() for w in masked_lm.words(r["text"]))
    assert list(vocab) == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: s.vocabulary - 2]]
    net = masked_lm.train(some, vocab, s)
    got = {r["doc_id"]: r for r in masked_lm.score(some, net, vocab).collect()}
    for r in some.limit(5).collect() + [{"doc_id": 10_002, "text": "one"}]:
        ids = [0, 0, *[vocab[w] for w in masked_lm.words(r["text"])], 0, 0]
        total = 0.0
        for i in range(2, len(ids) - 2):
            h = np.tanh(net.bias + sum(net.emb[o][ids[i + d]] for o, d in enumerate((-2, -1, 1, 2))))
            a, b = h @ net.wc.T + net.bc, h @ net.ww[ids[i] // 8].T + net.bw[ids[i] // 8]
            total += a[ids[i] // 8] - np.log(np.exp(a).sum()) + b[ids[i] % 8] - np.log(np.exp(b).sum())
        assert got[r["doc_id"]]["log_prob"] == pytest.approx(total, rel=1e-3, abs=1e-3)
    assert [(got[k]["n_words"], got[k]["log_prob"], got[k]["mean_log_prob"]) for k in (10_000, 10_001)] == [(0, 0.0, None)] * 2
    fresh = masked_lm.score(some, masked_lm.Network(s), vocab).agg(F.sum("log_prob")).first()[0]
    assert sum(r["log_prob"] for r in got.values()) > fresh


def test_rare_words_cost_their_spelling(spark):
    s = masked_lm.Settings(classes=2, members=2, width=4)
    texts = ["aa aa aa bb bb bb", "cat car cat", None, "", "zq\x7f Xw9 é", "aa zq\x7f", "cat car cat"]
    some = frame(spark, texts)
    counts = masked_lm.word_counts(some)
    vocab = masked_lm.vocabulary(some, s, counts=counts)
    table = masked_lm.spelling(counts, vocab)
    assert list(vocab) == [b"aa", b"cat"] and np.exp(table).sum(1) == pytest.approx(1)
    pairs = Counter(p for t in texts for w in masked_lm.words(t) if w not in vocab for p in zip([256, *w], [*w, 256], strict=True))
    cost = lambda w: sum(np.log((pairs[a, b] + 1) / (sum(n for (x, _), n in pairs.items() if x == a) + 257 - (a == 256))) for a, b in zip([256, *w], [*w, 256], strict=True))
    net = masked_lm.Network(s)
    base, got = ({r["doc_id"]: r["log_prob"] for r in masked_lm.score(some, net, vocab, spelled=x).collect()} for x in (None, table))
    for k, t in enumerate(texts):
        assert got[k] - base[k] == pytest.approx(sum(cost(w) for w in masked_lm.words(t) if w not in vocab), abs=1e-9)


def test_rounds_learn_every_position_once():
    s = masked_lm.Settings()
    place = np.concatenate([np.arange(n) for n in [1, 2, 3, 4] * 10])
    turns = [set(np.flatnonzero(masked_lm.learned(place, turn, s))) for turn in range(s.rounds)]
    assert sorted(x for t in turns for x in t) == list(range(len(place)))


def test_positions_against_plain_loops():
    vocab = masked_lm.Vocabulary([b"a", b"b", b"\xc3\xa9"])
    texts = ["a x b", None, "", "A\tb\x1cc \u00e9 \n b", "b"]
    got = masked_lm.Positions(texts, vocab, 2)
    want = []
    for k, t in enumerate(texts):
        ids = [0, 0, *(vocab[w] for w in masked_lm.words(t)), 0, 0]
        want += [([ids[i - 2], ids[i - 1], ids[i + 1], ids[i + 2]], ids[i], k, i - 2) for i in range(2, len(ids) - 2)]
    every = slice(None)
    assert list(zip(got.context(every).tolist(), got.target.tolist(), got.of.tolist(), got.place.tolist(), strict=True)) == want
    none = masked_lm.Positions([None, " "], vocab, 2)
    assert len(none.target) == len(none.context(every)) == 0


def test_large_logits_stay_finite():
    net = masked_lm.Network(masked_lm.Settings(classes=4, members=4, width=8))
    net.bc[0], net.bw[1, 2] = 500, -500
    assert np.isfinite(net.log_probs(np.zeros((16, 4), "int32"), np.arange(16, dtype="int32"))).all()


def test_model_of_nothing_and_of_clashing_columns(spark):
    s = masked_lm.Settings(classes=2, members=2, width=4)
    none = spark.createDataFrame([], "doc_id long, text string")
    vocab = masked_lm.vocabulary(none, s)
    net = masked_lm.train(none, vocab, s)
    assert list(vocab) == [] and (net.flat == masked_lm.Network(s).flat).all() and masked_lm.score(none, net, vocab).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 3), (2, "a " * 300_000, 4)], "doc_id long, text string, log_prob long")
    vocab = masked_lm.vocabulary(df, s)
    got = masked_lm.score(df, masked_lm.train(df.repartition(40), vocab, s), vocab).collect()
    assert len(got) == 4 and len({r["log_prob"] for r in got if r["n_words"] == 2}) == 1 and max(r["n_words"] for r in got) == 300_000


# ---- 8 separator scan


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_scan_stitches_blocks(spark, block):
    folder = run_dir(spark, "tokens")
    files = {"tokens-0.bin": [5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 8, 8], "tokens-1.bin": [9], "tokens-2.bin": [], "tokens-3.bin": [1, 2]}
    store, top = pafs.FileSystem.from_uri(folder)
    store.create_dir(top)
    for name, ids in files.items():
        with store.open_output_stream(f"{top}/{name}") as f:
            f.write(np.array(ids, "<u2").tobytes())
    got = sorted(tuple(r) for r in token_scan.scan(token_scan.token_files(spark, folder), folder, 9, block_tokens=block).collect())
    assert got == [
        ("tokens-0.bin", 0, 0, 1, True), ("tokens-0.bin", 1, 2, 0, True), ("tokens-0.bin", 2, 3, 7, True), ("tokens-0.bin", 3, 11, 2, False),
        ("tokens-1.bin", 0, 0, 0, True), ("tokens-3.bin", 0, 0, 2, False),
    ]


def test_counts_of_written_documents(spark, docs):
    folder = run_dir(spark, "tokens")
    both = docs.select("doc_id", "text").unionByName(frame(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(3)
    written = token_scan.write_token_files(both, folder, WORD, 49407)
    counts = token_scan.scan(token_scan.token_files(spark, folder), folder, 49407, block_tokens=1000)
    got = {r["doc_id"]: r["n_tokens"] for r in written.join(counts, ["file", "ordinal"]).collect()}
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    assert got == {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in both.collect()}
