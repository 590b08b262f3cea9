"""Product quantisation against plain loops over Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tableprobe.llm import member_lloyd


def plain(rows, s):
    """(codes and errors by place in rows, codebooks) of (id, vector) rows."""
    fine = [(k, i, v) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    fine = [r for r in fine if len(r[2]) == len(fine[0][2])]
    cut = [p * len(fine[0][2]) // s.parts for p in range(s.parts + 1)] if fine else []
    whole = {k: [math.floor(Fraction(x) * s.scale) for x in v] for k, _, v in fine}
    books = [[whole[k][cut[p] : cut[p + 1]] for k, _, _ in fine[: s.entries]] for p in range(s.parts)] if fine else [[]] * s.parts

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[cut[p] : cut[p + 1]], e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(s.rounds if fine else 0):
        members = [[[] for _ in book] for book in books]
        for v in whole.values():
            for p in range(s.parts):
                members[p][near(p, v)[1]].append(v[cut[p] : cut[p + 1]])
        books = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if own else e for own, e in zip(members[p], books[p], strict=True)] for p in range(s.parts)]
    coded = {}
    for k, v in whole.items():
        got = [near(p, v) for p in range(s.parts)]
        coded[k] = ("".join(f"{n:02x}" for _, n in got), sum(d for d, _ in got))
    return coded, books


@pytest.mark.parametrize("seed,width,parts", [(1, 16, 8), (2, 10, 4), (3, 3, 8)])
def test_against_plain_loops(spark, seed, width, parts):
    rng, s = np.random.default_rng(seed), member_lloyd.Settings(parts=parts, entries=5, rounds=4, scale=4096, least_owners=3)
    vecs = (rng.standard_normal((4, width))[rng.integers(0, 4, 90)] + 0.3 * rng.standard_normal((90, width))).tolist()
    vecs += [vecs[0]] * 40 + [None, [], [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [None] * width, [1.0] * (width + 1)]
    rows = [(int(rng.integers(0, 60)) if k % 17 else None, v) for k, v in enumerate(vecs)]
    label = [None if k % 5 == 0 else k % 3 for k in range(len(rows))]
    df = spark.createDataFrame([(i, v, c, "x", 1) for (i, v), c in zip(rows, label, strict=True)], "vec_id long, embedding array<double>, label int, code string, `a b.c` int").repartition(5)
    coded, books = plain(rows, s)
    want = []
    for k, (code, error) in coded.items():
        want.append((rows[k][0], code, error, sum(e for j, (_, e) in coded.items() if label[j] == label[k])))
    got = member_lloyd.compress(df, s).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(want, key=order)
    text = ",".join(str(x) for book in books for e in book for x in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_extreme_components_are_exact(spark):
    s = member_lloyd.Settings(parts=2, entries=2, rounds=3, scale=4096)
    vecs = [[1e300, -1e-300, 5.0, 0.1], [-1e300, 2.0, 5.0, 0.1], [1e300, 1.0, 7.5, -0.1], [9e15, 1.0, 7.5, -0.1], [1e16, 3.0, 2.5, 2.0**60]]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in member_lloyd.compress(spark.createDataFrame([(k, v, 1) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int"), s).collect()}
    coded, _ = plain(list(enumerate(vecs)), s)
    assert got == {k: (c, e if e < 2**63 else None) for k, (c, e) in coded.items()}


def test_empty_table_and_round_trip(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert member_lloyd.compress(empty).count() == 0
    s = member_lloyd.Settings(parts=2, entries=4, rounds=2, scale=4)
    df = spark.createDataFrame([(k, [float(k % 4), 0.25, -1.5, 2.0], 0) for k in range(40)], "vec_id long, embedding array<float>, label int")
    rows, books = member_lloyd.usable(df, s, "vec_id", "embedding")
    books = member_lloyd.train(rows, books, s)
    assert [[len(e) for e in b] for b in books] == [[2] * 4] * 2
    back = {r["id"]: r["vec"] for r in member_lloyd.decode(member_lloyd.encode(rows, books, s), books, s).collect()}
    assert back == {k: [float(k % 4), 0.25, -1.5, 2.0] for k in range(40)}
    with pytest.raises(ValueError):
        member_lloyd.compress(df, member_lloyd.Settings(entries=300))


def test_columns_of_any_name_travel_along(spark):
    """pack and the two decoders keep columns whose names hold dots, blanks and backticks."""
    import public_tokenizers

    from tableprobe.llm import chunk_bpe, packing

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(k, "some text", k) for k in range(5)], "doc_id long, text string, `a.b c``d` int")
    cut = packing.pieces(df, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).join(df.drop("text"), "doc_id")
    assert {(r["doc_id"], r["a.b c`d"]) for r in packing.pack(cut).collect()} == {(k, k) for k in range(5)}
    encoded = chunk_bpe.encode(df, *files).join(df.drop("text"), "doc_id")
    assert {(r["text"], r["a.b c`d"]) for r in chunk_bpe.decode(encoded, *files).collect()} == {("some text", k) for k in range(5)}
