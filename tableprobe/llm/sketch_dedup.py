"""Near-dedup by bottom-k sketches from one hash function.

Documents with equal word sequences are one class. A class keeps the ``k`` least hashes of its shingles.
A pair whose union sketch estimates a similarity near the threshold shares at least ``Settings.shared`` retained
values, so, with values ordered from the rarest to the most common, it shares one of the first that are needed to
leave fewer than that. Inverted lists of these values hold every such pair.

Lists of at most ``list_rows`` classes give their pairs at once, so at most ``list_rows - 1`` an entry. What the
union sketch estimates far below the threshold goes. All classes of a longer list are sketched anew with a k that
covers their whole sets, and listed again. With whole sets the bound is exact: the place of a value in the order of
a set limits what can follow it, hence the sizes of the sets that can be linked through it, and a list is kept for
each range of sizes. A class with enough values of its own stands in no list. In these lists all are paired with the
head, the class whose values are the most common; then those outside its component meet the others of the list, block
by block, and each task returns a spanning forest of its links. So what is written grows with the members of
a list, whatever its length, and no pair is left out. All links are verified by exact Jaccard over the full sets of
shingles before they count.

Defined cases: null texts and texts without a word have no shingles and link with nothing; a text of fewer
words than a shingle has one shingle, all its words; a null id is kept with the class it belongs to, where
the least id is not null; equal rows are equal documents; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import WORD_CHAR, durable
from tableprobe.llm.components import connected_components
from tableprobe.llm.rolling import chunks, same_spans, span_hashes
from tableprobe.llm.tokens import release, sliced


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Link where percent_of * union <= 100 * intersection.
    percent: int = 80
    k: int = 32
    #: Classes of a list whose pairs are formed at once; all classes of longer lists are sketched anew, whole.
    list_rows: int = 16
    #: Whole sets that meet as many others in one task, and shingles in them.
    block_rows: int = 128
    block_shingles: int = 1_000_000
    #: Lists of whole sets are split by ranges of their sizes, each so many times the one before.
    size_step: float = 1.1
    #: Standard deviations that an estimate may lie below the threshold.
    margin: float = 4.5
    #: Texts that are verified against one copy of a text at a time.
    block: int = 256
    #: Bits of the filter that spares texts without a candidate the shuffle: 8 MB, whatever the data.
    filter_bits: int = 26

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - self.margin * math.sqrt(t * (1 - t) / self.k)

    def shared(self, size: int) -> int:
        """Values that a sketch of this size shares with any whose union sketch meets the least estimate: the
        union sketch is no smaller than either."""
        return max(1, math.ceil(self.least_estimate * size - 1e-9))


def normalised(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one blank between them."""
    return b" ".join((text or "").encode().lower().split())


def shingle_set(norm: bytes, n: int) -> set[bytes]:
    words = norm.split(b" ") if norm else []
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def _sketches(norms: list[bytes], n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: number of distinct shingles; the least k hashes, text by text; how many each has. Shingles of one hash
    are compared; where they differ, a text's are counted as they are."""
    raw = np.frombuffer(b" ".join(norms) + b" ", "uint8")
    text_at = np.r_[0, np.cumsum([len(x) + 1 for x in norms])]
    blank = np.flatnonzero(raw == 0x20)
    ends = blank[np.r_[True, blank[1:] != blank[:-1] + 1] if len(blank) else slice(0)]
    starts = np.r_[0, blank[:-1] + 1]
    keep = starts < blank  # an empty text has no word
    starts, ends = starts[keep], blank[keep]
    of = np.searchsorted(text_at, starts, "right") - 1
    per_text = np.bincount(of, minlength=len(norms))
    first = np.r_[0, np.cumsum(per_text)[:-1]]
    short = np.flatnonzero((per_text > 0) & (per_text < n))
    i = np.arange(max(0, len(of) - n + 1))
    i = i[of[i] == of[i + n - 1]]
    eight = chunks(raw)
    begin, stop = np.r_[starts[i], starts[first[short]]], np.r_[ends[i + n - 1], ends[first[short] + per_text[short] - 1]]
    h, doc = span_hashes(eight, begin, stop), np.r_[of[i], short]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    again = np.flatnonzero(~new)
    one, other = order[again], order[again - 1]
    unlike = np.unique(doc[again[~same_spans(raw, begin[one], stop[one], raw, begin[other], stop[other])]])
    h, doc = h[new], doc[new]
    count = np.bincount(doc, minlength=len(norms))
    rank = np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    kept = np.minimum(count, k)
    for d in unlike.tolist():
        count[d] = len(shingle_set(norms[d], n))
    return count, (h[rank < k] ^ np.uint64(1 << 63)).view("int64"), kept  # signed order, as Spark's, is the order of h


def sketches(docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the words; null without words), n_shingles, sketch and text_hash of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in sliced(x.as_py() for x in batch.column(1)):
                norms = [normalised(t) for t in part]
                count, values, kept = _sketches(norms, s.words, s.k)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], "int32"), pa.array(values))
                digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in norms]
                ids, hashes = (batch.column(c).slice(at, len(part)) for c in (0, 2))
                at += len(part)
                yield pa.RecordBatch.from_arrays([ids, pa.array(digest, "binary"), pa.array(count, "int64"), lists, hashes], ["doc_id", "digest", "n_shingles", "sketch", "text_hash"])
        release()

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, f"doc_id {kind}, digest binary, n_shingles long, sketch array<long>, text_hash long")


def _listed(classes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The entries (key, cls) of all inverted lists; key and n of the lists of two classes or more."""
    values = classes.select("cls", F.size("sketch").alias("size"), F.explode("sketch").alias("key"))
    counts = durable(values.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    common = values.join(counts, "key").groupBy("cls", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("found"))
    first = F.array(*[F.lit(n - s.shared(n) + 1 if n else 0) for n in range(s.k + 1)])[F.col("size")]
    own = first - (F.col("size") - F.size("found"))  # values of this class only come first
    listed = durable(common.filter(own > 0).select("cls", F.explode(F.slice("found", 1, own)).alias("e")).select("e.key", "cls"))
    return listed, durable(listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))


def _likely(x: Column, y: Column, s: Settings) -> Column:
    """Whether the union sketch of two classes (n_shingles, sketch) estimates a similarity near the threshold or above."""
    sized = F.least(x["n_shingles"], y["n_shingles"]) * 100 >= F.greatest(x["n_shingles"], y["n_shingles"]) * s.percent
    union = F.slice(F.array_sort(F.array_union(x["sketch"], y["sketch"])), 1, s.k)
    both = F.size(F.array_intersect(union, F.array_intersect(x["sketch"], y["sketch"])))
    return sized & (both >= F.lit(s.least_estimate) * F.size(union))


def _short_pairs(listed: DataFrame, sizes: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The likely pairs (a, b), a < b, of lists of at most list_rows classes."""
    entries = listed.join(sizes.filter(F.col("n") <= s.list_rows), "key").join(classes.select("cls", "n_shingles", "sketch"), "cls")
    lists = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "n_shingles", "sketch"))).alias("m"))
    firsts = lists.select("m", F.posexplode(F.slice("m", 1, F.size("m") - 1)).alias("i", "x"))
    later = F.filter(F.slice("m", F.col("i") + 2, F.size("m")), lambda y: _likely(F.col("x"), y, s))
    return firsts.select(F.col("x.cls").alias("a"), F.explode(F.transform(later, lambda y: y["cls"])).alias("b")).distinct()


def _whole(texts: DataFrame, s: Settings) -> DataFrame:
    """cls, n and vals (hashes of all shingles, ascending) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in sliced(batch.column(1).to_pylist()):
                count, values, kept = _sketches(part, s.words, 1 << 62)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], "int32"), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(kept, "int64"), lists], ["cls", "n", "vals"])
                at += len(part)
        release()

    return texts.select("cls", "norm").mapInArrow(run, "cls long, n long, vals array<long>")


def _whole_lists(whole: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Entries (key, r, cls, n, most, small) of the lists of whole sets, and key, r, head and the head's n and most of
    lists of two classes or more. most is what two sets share at most where key is the rarest value that they
    share. r is the range of sizes of the smaller set; small tells whether the class may be the smaller one."""
    t, p = s.percent, 100 + s.percent
    values = whole.select("cls", "n", F.explode("vals").alias("key"))
    counts = durable(values.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    common = values.join(counts, "key").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("found"), F.sum("df").alias("weight"))
    # Values of this class only come first; where less than a percent of the set is left, nothing is linked by it.
    first = F.greatest(F.lit(0), F.size("found") - F.ceil(F.col("n") * t / 100).cast("int") + 1)
    entry = common.select("cls", "n", "weight", F.size("found").alias("all"), F.posexplode(F.slice("found", 1, first)).alias("i", "e"))
    entry = entry.select("cls", "n", "weight", F.col("e.key").alias("key"), (F.col("all") - F.col("i")).cast("long").alias("most"))
    step = F.lit(math.log(s.size_step))
    span = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")
    low, high = F.ceil(F.col("n") * t / 100), F.least(F.col("n"), F.floor(F.col("most") * p / t - F.col("n")))
    ranged = entry.filter(low <= high).withColumn("r", F.explode(F.sequence(span(low), span(high))))
    small = (F.col("most") * p >= 2 * t * F.col("n")) & (F.col("r") == span(F.col("n")))
    listed = durable(ranged.select("key", "r", "cls", "n", "most", "weight", small.alias("small")))
    head = F.max(F.when(F.col("small"), F.struct("weight", "cls", "n", "most"))).alias("h")
    heads = listed.groupBy("key", "r").agg(F.count("*").alias("rows"), head).filter("rows > 1 and h is not null")
    return listed, durable(heads.select("key", "r", F.col("h.cls").alias("head"), F.col("h.n").alias("head_n"), F.col("h.most").alias("head_most")))


def _texts(docs: DataFrame, wanted: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """cls and text (words with one blank between) of the wanted classes (cls, digest)."""
    size = 1 << s.filter_bits
    mark = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % size
    words = wanted.select(F.shiftright(mark, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (mark % 64).cast("int")).alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size >> 6, "uint64")
    table[got["w"].to_numpy()] = got["bits"].to_numpy().view("uint64")
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2 ** filter_bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, norms = [], []
            for text in batch.column(0):
                norm = normalised(text.as_py())
                digest = hashlib.blake2b(norm, digest_size=16).digest()
                bit = int.from_bytes(digest[:4], "big") % size
                if norm and int(shared.value[bit >> 6]) >> (bit & 63) & 1:
                    digests.append(digest)
                    norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(digests, "binary"), pa.array(norms, "binary")], ["digest", "norm"])
        release()

    some = docs.select(F.col(text_col)).mapInArrow(run, "digest binary, norm binary")
    return some.dropDuplicates(["digest"]).join(wanted, "digest").select("cls", "norm")  # copies go within tasks first


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those pairs (a, b), a durable table, whose full shingle sets meet the threshold. b's texts go to a's, a block at a time."""
    blocks = durable(pairs.groupBy("a").agg(F.ceil(F.count("*") / s.block).cast("int").alias("g")))
    members = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("g")).cast("int")).join(texts.withColumnRenamed("cls", "b"), "b")
    heads = blocks.join(texts.withColumnRenamed("cls", "a"), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = heads.select("a", "block", F.lit(None).cast("long").alias("b"), "norm").unionByName(members.select("a", "block", "b", "norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, set()
        for batch in batches:
            out = ([], [])
            for row in batch.to_pylist():
                own = shingle_set(row["norm"], s.words)
                if row["b"] is None:
                    now, held = row["a"], own
                elif row["a"] == now:
                    both = len(held & own)
                    if 100 * both >= s.percent * (len(held) + len(own) - both):
                        out[0].append(row["a"])
                        out[1].append(row["b"])
                else:
                    raise ValueError("a text is missing")
            yield pa.RecordBatch.from_arrays([pa.array(x, "int64") for x in out], ["a", "b"])

    dealt = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return durable(dealt.mapInArrow(run, "a long, b long"))


TASK = ["key", "r", "ub", "mb"]


def _by_task(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls work with whole tasks, of rows that come sorted by TASK, and the places where each begins and the last ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _ended(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            keys = [held[c].to_numpy() for c in TASK]
            edges = np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1]
            if batch is None:
                edges = np.r_[edges, held.num_rows]
            if len(edges) > 1:
                yield work(held.slice(0, int(edges[-1])).combine_chunks(), edges)
                held = held.slice(int(edges[-1]))
        release()

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _codes(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].combine_chunks().dictionary_encode().indices.to_numpy()


def _open(rows: pa.Table, s: Settings) -> Callable[[int, int, int], tuple[np.ndarray, np.ndarray]]:
    """For a task at p, whose side 1 begins at cut and which ends at q: which pairs of the two sides stand in different
    components and may be linked by their sizes and places; and the percent that they must reach, times both sizes."""
    n, most, component = rows["n"].to_numpy(), rows["most"].to_numpy(), _codes(rows, "component")

    def of(p: int, cut: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        least = s.percent * (n[p:cut, None] + n[None, cut:q])
        sized = np.minimum(n[p:cut, None], n[None, cut:q]) * 100 >= np.maximum(n[p:cut, None], n[None, cut:q]) * s.percent
        placed = np.minimum(most[p:cut, None], most[None, cut:q]) * (100 + s.percent) >= least
        return (component[p:cut, None] != component[None, cut:q]) & sized & placed, least

    return of


def _shared(value: np.ndarray, owner: np.ndarray, cut: int, rows: int) -> np.ndarray:
    """How many values each row before cut shares with each row from it on. value: of row owner, each once a row."""
    _, value = np.unique(value, return_inverse=True)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    both = np.zeros((cut, rows - cut))
    for low in range(0, int(value[-1]) + 1, 4096):  # so many distinct values at a time
        x, y = np.searchsorted(value, (low, low + 4096))
        holds = np.zeros((rows, 4096), "f4")
        holds[owner[x:y], value[x:y] - low] = 1
        both += holds[:cut] @ holds[cut:].T
    return both


def _near(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> np.ndarray:
    """Which pairs of rows (i, j) the union sketch estimates near the threshold or above. Sketches are rows of k ascending
    values, filled up with the largest."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        both = np.sort(np.concatenate([sketch[a], sketch[b]], 1), 1)
        place = np.arange(2 * s.k)[None] < (size[a] + size[b])[:, None]
        new = np.concatenate([np.ones((len(a), 1), bool), both[:, 1:] != both[:, :-1]], 1)
        rank = np.cumsum(new & place, 1)
        shared = (~new & place & (rank <= s.k)).sum(1)
        out[at : at + 20_000] = shared >= s.least_estimate * np.minimum(rank[:, -1], s.k)
    return out


def _hopeful(s: Settings) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """The rows that have a likely partner in their task, without their sketches."""

    def work(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        side, kept = rows["side"].to_numpy(), np.zeros(rows.num_rows, bool)
        lists = rows["sketch"].combine_chunks()
        flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        sketch = np.full((rows.num_rows, s.k), np.iinfo("int64").max)
        sketch[np.arange(s.k)[None] < size[:, None]] = flat
        least, ends, of = np.array([s.shared(k) for k in range(s.k + 1)]), np.r_[0, np.cumsum(size)], _open(rows, s)
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            cut = p + int(np.searchsorted(side[p:q], 1))
            open_, _ = of(p, cut, q)
            if open_.any():
                both = _shared(flat[ends[p] : ends[q]], np.repeat(np.arange(q - p), size[p:q]), cut - p, q - p)
                i, j = np.nonzero(open_ & (both >= np.maximum(least[size[p:cut]][:, None], least[size[cut:q]][None])))
                near = _near(sketch, size, i + p, j + cut, s)
                kept[i[near] + p] = kept[j[near] + cut] = True
        return pa.RecordBatch.from_struct_array(rows.drop_columns(["sketch"]).filter(pa.array(kept)).to_struct_array().combine_chunks())

    return work


def _forest(s: Settings) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """A spanning forest of the links between different components in each task: of each of side 0 with each of side 1."""

    def work(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        side, n, component, of = rows["side"].to_numpy(), rows["n"].to_numpy(), _codes(rows, "component"), _open(rows, s)
        flat, ends = rows["vals"].combine_chunks().flatten().to_numpy(), np.r_[0, np.cumsum(n)]
        out: tuple[list[int], list[int]] = ([], [])
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            cut = p + int(np.searchsorted(side[p:q], 1))
            open_, least = of(p, cut, q)
            if not open_.any():
                continue
            both = _shared(flat[ends[p] : ends[q]], np.repeat(np.arange(q - p), n[p:q]), cut - p, q - p)
            up: dict[int, int] = {}
            for i, j in zip(*np.nonzero(open_ & (both * (100 + s.percent) >= least)), strict=True):
                x, y = int(component[p + i]), int(component[cut + j])
                while x in up:
                    x = up[x]
                while y in up:
                    y = up[y]
                if x != y:
                    up[x] = y
                    out[0].append(p + i)
                    out[1].append(cut + j)
        names = rows["cls"].combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(pa.array(x, "int64")) for x in out], ["a", "b"])

    return work


def _across(listed: DataFrame, heads: DataFrame, label: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join the components of label within the lists of whole sets. Of a pair in different
    components, one at least stands outside that of the list's head: so many blocks of such classes meet all blocks.
    They meet by their sketches first; whole sets follow only for those that have a likely partner."""
    named = lambda df, name, to: df.join(label.select(F.col("node").alias(name), F.col("component").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))
    mains = durable(named(heads, "head", "main").select("key", "r", "main"))
    placed = durable(named(listed, "cls", "component").join(mains, ["key", "r"]))
    outside = (F.col("component") != F.col("main")).cast("int")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / s.block_rows), F.ceil(size / s.block_shingles)).cast("int")
    sizes = placed.groupBy("key", "r").agg(blocks(F.sum(outside), F.sum(outside * F.col("n"))).alias("gu"), blocks(F.count("*"), F.sum("n")).alias("gm"))
    sizes = durable(sizes.filter("gu > 0"))
    block = lambda g: F.pmod(F.xxhash64("cls"), F.col(g)).cast("int")
    every = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    place = lambda side, ub, mb: F.struct(F.lit(side).alias("side"), ub.alias("ub"), mb.alias("mb"))
    members = F.transform(every("gu"), lambda x: place(1, x, block("gm")))
    others = F.when(outside == 1, F.transform(every("gm"), lambda x: place(0, block("gu"), x))).otherwise(F.array().cast("array<struct<side:int,ub:int,mb:int>>"))
    spread = placed.join(sizes, ["key", "r"]).join(whole.select("cls", F.slice("vals", 1, s.k).alias("sketch")), "cls").withColumn("t", F.explode(F.concat(members, others)))
    rows = spread.select("key", "r", "t.ub", "t.mb", "t.side", "cls", "component", "n", "most", "sketch")
    met = lambda df, work, schema: df.repartition(*TASK).sortWithinPartitions(*TASK, "side").mapInArrow(_by_task(work), schema)
    hopeful = durable(met(rows, _hopeful(s), "key long, r int, ub int, mb int, side int, cls long, component long, n long, most long"))
    found = met(hopeful.join(whole.select("cls", "vals"), "cls").select(*hopeful.columns, "vals"), _forest(s), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """Verified links (a, b) of classes, enough to connect all that links connect."""
    listed, sizes = _listed(classes, s)
    pairs = durable(_short_pairs(listed, sizes, classes, s))
    hot = durable(listed.join(sizes.filter(F.col("n") > s.list_rows), "key").select("cls").distinct())
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(hot).distinct()
    texts = durable(_texts(docs, durable(wanted.join(classes.select("cls", "digest"), "cls")), s, text_col))
    if not hot.head(1):
        return _verified(pairs, texts, s)
    whole = durable(_whole(texts.join(hot, "cls"), s))
    listed, heads = _whole_lists(whole, s)
    reach = F.least("most", "head_most") * (100 + s.percent) >= s.percent * (F.col("n") + F.col("head_n"))
    stars = listed.join(heads, ["key", "r"]).filter((F.col("cls") != F.col("head")) & reach)
    stars = durable(stars.select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct())
    links = _verified(durable(pairs.union(stars).distinct()), texts, s)
    more = durable(_across(listed, heads, connected_components(links), whole, s))
    return links.union(_verified(more, texts, s)) if more.head(1) else links


def _placed(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, text_hash, component and component_id of every row."""
    rows = durable(sketches(docs, s, id_col, text_col))
    least = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = durable(least.withColumn("cls", F.monotonically_increasing_id()))  # fixed by being written
    label = connected_components(_links(docs, classes, s, text_col))
    named = classes.select("cls", "digest", "doc_id").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    named = durable(named.withColumn("component", F.coalesce("component", "cls")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = durable(named.join(least, "component").select("digest", "component", "component_id"))
    placed = rows.drop("sketch").join(of_class, "digest", "left")
    return placed.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def components(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept of every row."""
    placed = _placed(docs, s, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, whole, for each component: one with the least id, also where rows or ids repeat. Rows without
    a word link with nothing and all stay."""
    worded = F.coalesce(F.col(text_col).rlike(WORD_CHAR), F.lit(False))
    least = _placed(docs.filter(worded), s, id_col, text_col).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("x"))
    name = "chosen"
    while name in docs.columns:
        name += "_"
    # As one text: a null id then joins like any other.
    chosen = least.select(F.struct("x.doc_id", "x.text_hash").alias(name)).select(F.to_json(name).alias(name))
    own = F.to_json(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")))
    stay = docs.filter(worded).withColumn(name, own).join(chosen, name, "left_semi")
    return stay.dropDuplicates([name]).select(*docs.columns).unionByName(docs.filter(~worded))
