"""Fixed phrases of a corpus, from a weighted de Bruijn graph of its words.

Texts are lower-cased (A-Z), split into pieces at marks and line ends, and pieces into words. The longest grams, of
``most`` words, are the graph's edges: each leads from the node of its first ``most - 1`` words to that of its last. Edges
are summed over the corpus, and so are the shorter grams where no edge begins. All shorter counts follow from the graph: a
node occurs as often as its edges leave it, plus the times that it stands where none leaves; a gram one word shorter as
often as the nodes that begin with it occur, plus the times that it stands where no node begins, and so on down to words.
Nodes that a single edge enters and a single edge leaves are compacted, so that a passage of any length which is repeated
as a whole is one path.

A phrase counts where it occurs ``least`` times, and then so do all grams in it. So two passes before count grams in tables
of 2 ** slot_bits slots: the first words and pairs, the second the longer grams all of whose pairs passed. From each place
the longest gram is taken whose slot, and those of all grams in it, hold ``least``. No occurrence of a phrase that counts
is lost, and hardly a gram arises that occurs less often: a task's rows are bounded by the grams that count. Slots that
several share let more through than need be, which changes no result; with long corpora there are more slots.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count each; words are taken as they are,
of any length; an empty table, or one without phrases, gives no rows; other columns are ignored. Counts are exact, scores
are divisions of decimals rounded down.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.llm.common import discard, durable, saved
from tableprobe.llm.tokens import release

#: What parts pieces, and letters that lose their case, as bytes: 0xFF is in no UTF-8 text.
MARKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(0x41, 0x5B)) + MARKS, bytes(range(0x61, 0x7B)) + b"\xff" * len(MARKS))
_END = b"\xff"
_RANGES = 1024


@dataclass(frozen=True)
class Settings:
    most: int = 4
    least: int = 30
    #: A candidate goes where a longer one that holds it has this percent of its occurrences.
    percent: int = 80
    scale: int = 2_000_000
    top: int = 2000
    #: Slots grow with the text, one for slot_bytes of it, from 2 ** slot_bits to 2 ** most_slot_bits, 31 bits at most.
    slot_bits: int = 26
    most_slot_bits: int = 29
    slot_bytes: int = 100
    #: Words of a language that are counted together in a task.
    slice_words: int = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with 0xFF where a piece ends."""
    return (text or "").encode().translate(_PLAIN).replace(_END, b" \xff ").split() + [_END]


def _slices(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[tuple[str, list[bytes]]]:
    """language and words of many texts; a task holds twice slice_words or so, and one text, whatever its languages."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, new = held.setdefault(lang, []), words_of(text.as_py())
            own += new
            total += len(new)
            full = [lang] if len(own) > s.slice_words else list(held) if total > 2 * s.slice_words else []
            for name in full:
                total -= len(held[name])
                yield name, held.pop(name)
    yield from held.items()


class Slice:
    """A slice as arrays: the distinct words, the number of each place's word, whether a piece ends there, and slots."""

    def __init__(self, lang: str, words: list[bytes], s: Settings):
        self.words = list(dict.fromkeys(words))
        number = dict(zip(self.words, range(len(self.words)), strict=True))
        self.at = np.fromiter(map(number.__getitem__, words), "int32", len(words))
        self.end = self.at == number.get(_END, -1)
        seed, bits = xxhash.xxh3_64_intdigest(lang.encode()), np.uint64(64 - s.slot_bits)
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), "uint64", len(self.words))
        self.shift = bits

    def slots(self, at: np.ndarray, n: int) -> np.ndarray:
        """The slots of the grams of n words that begin at these places."""
        x = self.hash[self.at[at]]
        with np.errstate(over="ignore"):
            for k in range(1, n):
                x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ self.hash[self.at[at + k]]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> self.shift).astype("int32")

    def begins(self, most: int, keep: Mapping[int, np.ndarray]) -> Iterator[np.ndarray]:
        """For 1, 2, .. most words, the places where a gram begins that passes, as all grams in it do: bits of slots
        (keep, by number of words) tell which pass, and all pass of a length without bits."""
        at = np.flatnonzero(~self.end)
        for n in range(1, most + 1):
            if n > 1:
                at = at[:-1][np.diff(at) == 1]  # grams one word shorter begin here and at the next place
            if n in keep:
                slots = self.slots(at, n)
                at = at[(keep[n][slots >> 3] >> (7 - (slots & 7)).astype("uint8") & 1).astype(bool)]
            yield at


def _steps(slots: np.ndarray) -> bytes:
    """Ascending slots as bytes: the step to each from the one before, 255 standing for 255 and no slot yet."""
    steps = np.diff(slots, prepend=0)
    long, rest = steps // 255, (steps % 255).astype("uint8")
    out = np.full(len(steps) + int(long.sum()), 255, "uint8")
    out[np.cumsum(long + 1) - 1] = rest
    return out.tobytes()


def _slots(steps: bytes) -> np.ndarray:
    raw = np.frombuffer(steps, "uint8")
    return np.cumsum(raw, dtype="int64")[raw < 255]


def _sized(texts: DataFrame, s: Settings) -> Settings:
    """Settings with as many slots as the texts need."""
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return replace(s, slot_bits=max(s.slot_bits, min(s.most_slot_bits, math.ceil(math.log2(size / s.slot_bytes + 1)))))


def often(texts: DataFrame, s: Settings, lengths: range, keep: Mapping[int, Broadcast]) -> np.ndarray:
    """Bits of the slots that hold at least ``least`` grams of these numbers of words, of texts (lang, text): 2 **
    slot_bits bits. Grams with a shorter one that does not pass are not counted. Tasks send their slots as steps, about a
    byte each, by range of slots; a range's are added up as they come."""
    per = (1 << s.slot_bits) // _RANGES

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: bits.value for n, bits in keep.items()}
        for lang, words in _slices(batches, s):
            own = Slice(lang, words, s)
            slots = np.sort(np.concatenate([own.slots(at, n) for n, at in enumerate(own.begins(lengths[-1], known), 1) if n in lengths]))
            # A slot counts as often as least at most: more add nothing.
            first = np.r_[True, slots[1:] != slots[:-1]] if len(slots) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
            slots = slots[np.arange(len(slots)) - begin < s.least]
            cut = np.searchsorted(slots, np.arange(_RANGES + 1) * per)
            parts = [_steps(slots[p:q] - k * per) for k, (p, q) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            full = [k for k, x in enumerate(parts) if x]
            yield pa.RecordBatch.from_arrays([pa.array(full, "int32"), pa.array([parts[k] for k in full], "binary")], ["r", "steps"])
        release()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = -1, np.zeros(per, "int64")
        held: list[np.ndarray] = []
        out: list[tuple[int, bytes]] = []

        def add() -> None:
            if held:
                np.add(count, np.bincount(np.concatenate(held), minlength=per), out=count)
                held.clear()

        def end() -> None:
            if now >= 0:
                add()
                out.append((now, np.packbits(count >= s.least).tobytes()))
                count[:] = 0

        for batch in batches:
            for r, steps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    end()
                    now = r
                held.append(_slots(steps.as_py()))
                if len(held) == 64:
                    add()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], "int32"), pa.array([b for _, b in out], "binary")], ["r", "bits"])

    sent = texts.select("lang", "text").mapInArrow(told, "r int, steps binary")
    bits = sent.repartition("r").sortWithinPartitions("r").mapInArrow(added, "r int, bits binary")
    table = np.zeros((_RANGES, per // 8), "uint8")
    for row in bits.collect():  # _RANGES rows, 2 ** slot_bits bits
        table[row["r"]] = np.frombuffer(row["bits"], "uint8")
    return table.ravel()


def _grams(own: Slice, keep: Mapping[int, np.ndarray], s: Settings) -> tuple[list[str], np.ndarray]:
    """The longest gram, of ``most`` words at most, that passes from each place of a slice, and how often each occurs."""
    longest = np.zeros(len(own.at), "int8")
    for n, at in enumerate(own.begins(s.most, keep), 1):
        longest[at] = n
    texts, counts = [], []
    for n in range(1, s.most + 1):
        starts = np.flatnonzero(longest == n)
        if len(starts):
            code = own.at[starts].astype("int64")
            for k in range(1, n):
                _, code = np.unique(code, return_inverse=True)
                code = code.ravel().astype("int64") * len(own.words) + own.at[starts + k]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            rows = np.stack([own.at[starts[first] + k] for k in range(n)], 1).tolist()
            texts.extend(b" ".join([own.words[w] for w in row]).decode() for row in rows)
            counts.append(count)
    return texts, np.concatenate(counts) if counts else np.zeros(0, "int64")


def graph(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, phrase, n: the edges (phrases of ``most`` words), the shorter phrases where no longer one begins that passes,
    and, for the empty phrase, the number of all words, of texts (lang, text)."""
    s, keep = _sized(texts, s), {}
    for lengths in (range(1, 3), range(3, s.most + 1)):
        if lengths:
            bits = texts.sparkSession.sparkContext.broadcast(often(texts, s, lengths, dict(keep)))  # 2 ** slot_bits bits
            keep |= dict.fromkeys(lengths, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: bits.value for n, bits in keep.items()}
        for lang, words in _slices(batches, s):
            own = Slice(lang, words, s)
            phrases, counts = _grams(own, known, s)
            phrases.append("")
            n = pa.array(np.r_[counts, (~own.end).sum()], "int64")
            for at in range(0, len(phrases), 50_000):
                part = pa.array(phrases[at : at + 50_000], "string")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), "string"), part, n.slice(at, len(part))], ["lang", "phrase", "n"])
        release()

    found = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def shorter(grams: DataFrame, s: Settings = Settings()) -> list[DataFrame]:
    """lang, phrase, f of grams of 1, 2, .. most words, as graph() has them: what leaves them, and where nothing does. All
    that occur ``least`` times are there, and right; others may be there, short of occurrences."""
    grams = grams.filter("phrase <> ''").withColumn("w", _n_words(F.col("phrase")))
    now = durable(grams.filter(F.col("w") == s.most).select("lang", "phrase", F.col("n").alias("f")))
    out = [now]
    for w in range(s.most - 1, 0, -1):
        leave = now.select("lang", F.substring_index("phrase", " ", w).alias("phrase"), "f")
        end = grams.filter(F.col("w") == w).select("lang", "phrase", F.col("n").alias("f"))
        now = durable(leave.unionByName(end).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
        out.insert(0, now)
    return out


def compacted(edges: DataFrame, nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, phrase, n, head and place of edges (lang, phrase, f): the first edge of the path that an edge is on, and its
    place there. A path goes on through a node where both edges occur as often as the node (lang, phrase, f) itself, so
    no other edge enters or leaves it, and no piece begins or ends there. Each round doubles the steps back."""
    spark, keep = edges.sparkSession, s.most - 1
    last, first = F.substring_index("phrase", " ", -keep), F.substring_index("phrase", " ", keep)
    node = nodes.select("lang", F.col("phrase").alias("node"), F.col("f").alias("node_f"))
    through = lambda side: edges.select("lang", "phrase", "f", side.alias("node")).join(node, ["lang", "node"]).filter("f = node_f")
    into = through(last).select("lang", "node", F.col("phrase").alias("before"))
    links = through(first).join(into, ["lang", "node"]).select("lang", "phrase", "before")
    state = edges.join(links, ["lang", "phrase"], "left").select("lang", "phrase", "f", F.coalesce("before", "phrase").alias("head"), F.col("before").isNotNull().cast("long").alias("place"))
    path, schema = saved(state), state.schema
    while True:
        now = spark.read.schema(schema).parquet(path)
        ahead = now.filter("place > 0")
        back = ahead.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        if not ahead.join(back, ["lang", "head"], "left_semi").head(1):
            return now
        moved = now.join(back, ["lang", "head"], "left")
        was, path = path, saved(moved.select("lang", "phrase", "f", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
        discard(spark, was)


def paths(edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, passage and f of the paths of compacted edges: passages that occur as a whole, with their words."""
    word = F.when(F.col("place") == 0, F.col("phrase")).otherwise(F.substring_index("phrase", " ", -1))
    listed = F.array_sort(F.collect_list(F.struct("place", word.alias("word"))))
    return edges.groupBy("lang", "head", "f").agg(listed.alias("w")).select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("passage"), "f")


def _scored(candidates: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """candidates (lang, phrase, a) with l, r and score of the cut that scores lowest, the first of equals."""
    w = _n_words(F.col("phrase"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), w - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("x"))
    cut = cut.withColumn("y", F.expr("substr(phrase, length(x) + 2)"))
    of = lambda name, to: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    both = cut.join(of("x", "l"), ["lang", "x"]).join(of("y", "r"), ["lang", "y"])
    score = F.expr(f"(cast(a AS decimal(28,0)) * {s.scale}) div (cast(l AS decimal(28,0)) + r)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def _held(candidates: DataFrame, s: Settings) -> DataFrame:
    """lang, phrase and most: what the most frequent longer candidate that holds a phrase of two words or more has."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.array_join(F.slice("w", k, n), " ")))
    longer = candidates.withColumn("w", words).filter(F.size("w") > 2)
    return longer.select("lang", "a", F.explode(F.flatten(cuts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def _ranked(found: DataFrame, s: Settings) -> DataFrame:
    """The first ``top`` rows of each language, numbered: sorted by range, counted by task, numbered by prefix sums, so
    that no task holds a language."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    sorted_ = found.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for lang in batch.column("lang").to_pylist():
                n = n + 1 if lang == now else 1
                now = lang
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(nth), "int32"), pa.array(nth, "int64")], [*batch.schema.names, "task", "nth"])

    numbered = durable(sorted_.mapInArrow(number, f"{kinds}, task int, nth long"))
    sizes = numbered.groupBy("lang", "task").agg(F.max("nth").alias("size"))
    before = Window.partitionBy("lang").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = sizes.select("lang", "task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = numbered.filter(F.col("nth") <= s.top).join(starts, ["lang", "task"])
    return placed.withColumn("rank", F.col("start") + F.col("nth")).filter(F.col("rank") <= s.top).drop("task", "nth", "start")


def phrases(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and path_words: words of the passage that is always repeated as a whole
    around a phrase of ``most`` words (null for shorter ones)."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grams = durable(graph(texts, s))
    frequent = [c.filter(F.col("f") >= s.least) for c in shorter(grams, s)]
    edges, nodes = frequent[-1], frequent[-2]
    on = durable(compacted(edges, nodes, s))
    sizes = on.groupBy("lang", "head").agg((F.count("*") + s.most - 1).alias("path_words"))
    longest = on.join(sizes, ["lang", "head"]).select("lang", "phrase", F.col("f").alias("a"), "path_words")
    # A node inside a path occurs as often as the edges around it, which hold it: it can be no result.
    inside = on.filter("place > 0").select("lang", F.substring_index("phrase", " ", s.most - 1).alias("phrase"))
    counts = frequent[0]
    for c in frequent[1:]:
        counts = counts.unionByName(c)
    candidates = longest
    for c in frequent[1:-1]:
        candidates = candidates.unionByName(c.select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("path_words")))
    candidates = durable(candidates)
    open_ = candidates.join(inside, ["lang", "phrase"], "left_anti").join(_held(candidates, s), ["lang", "phrase"], "left")
    open_ = open_.filter(f"most is null or 100 * cast(most as decimal(28,0)) < {s.percent} * cast(a as decimal(28,0))")
    scored = durable(_scored(open_.select("lang", "phrase", "a"), counts, s))
    total = grams.filter("phrase = ''").select("lang", F.col("n"))
    found = _ranked(scored, s).join(total, "lang").join(candidates.select("lang", "phrase", "path_words"), ["lang", "phrase"])
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "path_words")
