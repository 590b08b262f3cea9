"""Hashes of spans, and what holds where they collide."""

import numpy as np
import pytest

from tableprobe.llm import rolling, sketch_dedup, tokens
from tableprobe.llm.sketch_dedup import Settings


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_built_to_collide(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    x, y = thue_morse(n)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, bpe = tokens.WordEncoder(path), Tokenizer.from_file(path)
    bpe.no_truncation()
    texts = [f"{x} {y}", x, y, f"{y} and {x}"]
    assert [z.tolist() for z in own(texts)] == [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    words = [x, y, "c", "d", "e"]
    text = " ".join(words + words[::-1] + [y, x, "c"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = len(sketch_dedup.shingle_set(sketch_dedup.normalised(text), 3))
    assert sketch_dedup.components(df, Settings(words=3, percent=85)).first()["n_shingles"] == want


def test_equal_hashes_are_compared(monkeypatch):
    """With a hash of a few values, ids and counts stay right."""
    import public_tokenizers
    from tokenizers import Tokenizer

    weak = lambda eight, starts, ends: (ends - starts).astype("uint64") % np.uint64(3)
    monkeypatch.setattr(tokens, "span_hashes", weak)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, bpe = tokens.WordEncoder(path), Tokenizer.from_file(path)
    bpe.no_truncation()
    texts = ["one two three", "six", "ten, ten", None, "one"]
    assert [z.tolist() for t in texts for z in own([t])] == [bpe.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(sketch_dedup, "span_hashes", weak)
    norms = [b"a b c d e f a b c", b"", b"a", b"xx yy zz xx yy zz"]
    count, _, _ = sketch_dedup._sketches(norms, 3, 32)
    assert count.tolist() == [len(sketch_dedup.shingle_set(x, 3)) for x in norms]


def test_spans():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 3, 5000).astype("uint8")
    starts = rng.integers(0, 4900, 3000)
    ends = starts + rng.integers(0, 30, 3000)
    h = rolling.span_hashes(rolling.chunks(raw), starts, ends)
    of = {}
    for x, a, b in zip(h.tolist(), starts, ends, strict=True):
        assert of.setdefault(x, raw[a:b].tobytes()) == raw[a:b].tobytes()
    assert len(of) == len({raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
    i = rng.integers(0, 3000, 3000)
    same = rolling.same_spans(raw, starts, ends, raw, starts[i], ends[i])
    assert same.tolist() == [raw[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(starts, ends, starts[i], ends[i], strict=True)]
