"""Language identification by language-bitmask n-gram filters.

The filters of all languages are one bit-sliced Bloom filter: place p of the table holds a word whose bit l
says that language l set p, so the words at an n-gram's places, joined by AND, name every language that
contains it. A text's popcount per language, corrected for the rate of false positives that the language's
own fill gives, decides.

N-grams are runs of ``n`` characters of lower-cased letters, white space and all else being one blank. A
language's filter holds the n-grams that make up at least ``floor`` of its training n-grams.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the first language in
alphabetical order; documents without a language train nothing; with no training rows all is ``und``;
repeated rows count each; other columns pass through untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.tokens import release, sliced


@dataclass(frozen=True)
class Settings:
    n: int = 4
    places: int = 1 << 20
    probes: int = 2
    #: Least share of a language's n-grams.
    floor: float = 2e-6
    #: About so many documents of each language are learned from, chosen by a hash of their id.
    train_docs: int = 4000


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: tuple[str, ...]
    #: places x words of 64 languages.
    table: np.ndarray
    #: Per language, the chance that an n-gram it lacks seems present.
    false_rate: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of the texts, and how many each text has. A text with a
    letter begins with n - 2 blanks and ends with one, so that it has an n-gram."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join([f"{t} " for t in low]).encode("utf-32-le", "surrogatepass"), "<u4")
    text_of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0x20)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of blanks
    codes, text_of = codes[keep].astype("uint64"), text_of[keep]
    if not len(codes):
        return np.zeros(0, "uint64"), np.zeros(len(low), "int64")
    starts = np.repeat(np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]]), n - 2)
    codes, text_of = np.insert(codes, starts, 0x20), np.insert(text_of, starts, text_of[starts])
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
    same = text_of[: len(h)] == text_of[n - 1 :]
    return _mixed(h[same]), np.bincount(text_of[: len(h)][same], minlength=len(low))


def _places(h: np.ndarray, s: Settings) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(s.places)).astype("int64") for k in range(s.probes)]


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of docs with a language. The driver gets a table of settings.places rows at most."""
    s = settings
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Model(s, (), np.zeros((s.places, words), "uint64"), np.zeros(0))
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, s.train_docs / sizes[k])))])
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out(lang):
            h, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), "string"), pa.array(h.view("int64")), pa.array(n, "int64")], ["lang", "h", "n"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                for part in sliced(t for t, x in zip(texts, langs, strict=True) if x == lang):
                    held.setdefault(lang, []).append(ngrams(part, s.n)[0])
                    if sum(map(len, held[lang])) > 8_000_000:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    counts = chosen.select("text", "lang").mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.greatest(F.lit(2), s.floor * F.col("total")))  # totals: a row a language
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])[F.col("lang")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lang = batch.column(0).to_numpy().view("uint64"), batch.column(1).to_numpy()
            for p in _places(h, s):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array(lang // 64, "int32"), pa.array((np.uint64(1) << (lang % 64).astype("uint64")).view("int64"))], ["p", "w", "bits"]
                )

    placed = frequent.select("h", number.cast("int").alias("lang")).mapInArrow(place, "p long, w int, bits long")
    found = placed.groupBy("p", "w").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((s.places, words), "uint64")
    table[found["p"].to_numpy(), found["w"].to_numpy()] = found["bits"].to_numpy().view("uint64")
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(s, languages, table, fill**s.probes)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the share of its n-grams that the language holds, corrected for
    false positives by (share - rate) / (1 - rate)."""
    h, n = ngrams(texts, model.settings.n)
    if not model.languages or not len(h):
        return ["und"] * len(texts), np.zeros(len(texts))
    places = _places(h, model.settings)
    ends = np.cumsum(n)
    shares = np.zeros((len(model.languages), len(texts)))
    for w in range(model.table.shape[1]):
        words = model.table[:, w]
        hits = words[places[0]]
        for p in places[1:]:
            hits &= words[p]
        for k in range(64 * w, min(64 * w + 64, len(model.languages))):
            running = np.r_[0, np.cumsum((hits >> np.uint64(k % 64)).astype("uint8") & 1, dtype="int64")]
            shares[k] = (running[ends] - running[ends - n]) / np.maximum(n, 1)
    rate = np.minimum(model.false_rate, 0.999)[:, None]
    shares = np.clip((shares - rate) / (1 - rate), 0, 1)
    best = shares.argmax(0)
    return [model.languages[b] if c else "und" for b, c in zip(best, n, strict=True)], np.where(n > 0, shares.max(0), 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # settings.places words a 64 languages: 8 MB
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in sliced(x.as_py() for x in batch.column(at)):
                found = score(part, shared.value)
                langs += found[0]
                scores += found[1].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, "string"), pa.array(scores, "float64")], [*batch.schema.names, "lang_pred", "score"])
        release()

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The test fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
