"""Document scores by masked pseudo-likelihood.

A bidirectional window network predicts each word from the ``reach`` words on either side: position-wise
embeddings are summed, passed through tanh, and a two-level softmax (class, then word within class) gives a
proper distribution over the vocabulary. A document's score is the sum of the log-probabilities of its words,
each given its neighbours on both sides. Words are told apart by 64-bit hashes of their bytes.

The vocabulary is the ``Settings.vocabulary`` - 2 most frequent words of all documents, a fixed bound. To the network any other
word is the one rare word; which one it is costs its spelling besides: the log-probability of its bytes, each given
the one before, and of its end, from counts of all rare words of all documents. So every word is predicted. Training is plain numpy inside tasks: in each
round every partition takes steps on its documents' own positions from the round's common parameters, and
changes are averaged by weight, a bounded number of them in each task, level by level. All documents take part; a
round learns the words at one place in ``stride`` of each document, and as many rounds as that learn each word once.
As each partition takes its own steps, parameters depend on how documents are dealt to partitions, within noise.

Defined cases: null and empty texts have no words, log_prob 0 and no mean; a corpus without words leaves the initial
parameters; repeated rows, and rows with a null id, are scored each; other columns are ignored; an empty table gives no
rows; whole texts are read in any length. Scores are finite: the softmax is taken from its maximum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import durable
from tableprobe.llm.rolling import chunks, same_spans, span_hashes
from tableprobe.llm.tokens import SLICE_CHARS, sliced

PAD, RARE, FIRST = 0, 1, 2
#: The symbol before a word's first byte and after its last.
EDGE = 256


@dataclass(frozen=True)
class Settings:
    classes: int = 64
    members: int = 64
    width: int = 16
    reach: int = 2
    stride: int = 2
    rounds: int = 2
    batch: int = 16384
    rate: float = 0.1
    seed: int = 5
    #: Floats that travel together when changes are averaged, and changes that one task averages.
    piece: int = 16384
    fan: int = 16

    @property
    def vocabulary(self) -> int:
        return self.classes * self.members


class Network:
    """Parameters in one vector, with views: emb, bias, class and member weights."""

    def __init__(self, s: Settings, flat: np.ndarray | None = None):
        v, d = s.vocabulary, s.width
        shapes = {"emb": (2 * s.reach, v, d), "bias": (d,), "wc": (s.classes, d), "bc": (s.classes,), "ww": (s.classes, s.members, d), "bw": (s.classes, s.members)}
        if flat is None:
            rng = np.random.default_rng(s.seed)
            flat = np.concatenate([(rng.standard_normal(int(np.prod(x))) * (0.1 if len(x) > 1 and x[-1] == d else 0)).astype("f4") for x in shapes.values()])
        self.s, self.flat, at = s, flat, 0
        self.squares: dict[str, np.ndarray] = {}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.bias + self.emb[0][context[:, 0]]
        for o in range(1, context.shape[1]):
            z += self.emb[o][context[:, o]]
        return np.tanh(z)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, within = self.hidden(context), np.empty(len(target), "f4")
        of_class = np.concatenate([_log_share(h[k : k + 2048] @ self.wc.T + self.bc, target[k : k + 2048] // self.s.members) for k in range(0, max(1, len(target)), 2048)])
        order, edges = self._by_class(target)
        part, member = h[order], target[order] % self.s.members
        for c in range(self.s.classes):
            a, b = edges[c], edges[c + 1]
            if a < b:
                within[order[a:b]] = _log_share(part[a:b] @ self.ww[c].T + self.bw[c], member[a:b])
        return of_class + within

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions class by class, and where each class begins."""
        of = (target // self.s.members).astype("u2")
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(self.s.classes + 1))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step down the gradient of a batch's summed loss."""
        n = len(target)
        h = self.hidden(context)
        dh, of_class, change, bias = np.empty_like(h), target // self.s.members, 0, 0
        for k in range(0, n, 2048):  # what stays in a core's cache
            some = slice(k, k + 2048)
            p = h[some] @ self.wc.T
            p += self.bc
            _softmax(p)[np.arange(len(p)), of_class[some]] -= 1
            dh[some] = p @ self.wc
            change, bias = change + p.T @ h[some], bias + p.sum(0)
        self._move("wc", ..., change)
        self._move("bc", ..., bias)
        order, edges = self._by_class(target)
        part, member, back = h[order], target[order] % self.s.members, np.empty_like(dh)
        for c in range(self.s.classes):
            a, b = edges[c], edges[c + 1]
            if a < b:
                p = _softmax(part[a:b] @ self.ww[c].T + self.bw[c])
                p[np.arange(b - a), member[a:b]] -= 1
                back[a:b] = p @ self.ww[c]
                self._move("ww", c, p.T @ part[a:b])
                self._move("bw", c, p.sum(0))
        dh[order] += back
        dz = dh * (1 - h * h)
        self._move("bias", ..., dz.sum(0))
        for o in range(context.shape[1]):
            order = np.argsort(context[:, o].astype("u2"), kind="stable")
            ids = context[order, o]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            self._move("emb", (o, ids[first]), np.add.reduceat(dz[order], first))

    def _move(self, name: str, where, gradient: np.ndarray) -> None:
        squares = self.squares.setdefault(name, np.full_like(getattr(self, name), 1e-2))
        squares[where] += gradient * gradient
        getattr(self, name)[where] -= self.s.rate * gradient / np.sqrt(squares[where])


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place."""
    logits -= logits.max(1)[:, None]
    np.exp(logits, out=logits)
    logits *= np.float32(1) / logits.sum(1)[:, None]
    return logits


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of softmax at one place of each row. The logits are overwritten."""
    logits -= logits.max(1)[:, None]
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each word begins and ends, and the text that it is in."""
    parts = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", "uint8")
    gap = _GAP[raw]
    starts, ends = np.flatnonzero(~gap & np.r_[True, gap[:-1]]), np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    return raw, starts, ends, np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")


class Vocabulary:
    """The numbers of words, found by their hashes and compared by their bytes."""

    def __init__(self, some: list[bytes]):
        self.places = {w: k for k, w in enumerate(some, FIRST)}
        raw, starts, ends, _ = _spans([w.decode() for w in some])
        found = span_hashes(chunks(raw), starts, ends)
        order = np.argsort(found)
        self.hashes, self.numbers = np.r_[found[order], np.uint64(0)], np.r_[(order + FIRST).astype("int32"), np.int32(RARE)]
        self.letters, self.starts, self.ends = raw, np.r_[starts[order], 0], np.r_[ends[order], 0]
        # The first hash of each leading 16 bits, and how many share them at most.
        self.first = np.searchsorted(found[order] >> np.uint64(48), np.arange(1 << 16))
        self.depth = int(np.bincount((found >> np.uint64(48)).astype("int64"), minlength=1).max(initial=0))

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.places)

    def __contains__(self, word: bytes) -> bool:
        return word in self.places

    def __getitem__(self, word: bytes) -> int:
        return self.places.get(word, RARE)

    def numbered(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = span_hashes(chunks(raw), starts, ends)
        at, out = self.first[(own >> np.uint64(48)).astype("int64")], np.full(len(own), RARE, "int32")
        for k in range(self.depth):
            near = np.minimum(at + k, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[near] == own) & (near < len(self.hashes) - 1))
            word = near[hit]
            same = same_spans(raw, starts[hit], ends[hit], self.letters, self.starts[word], self.ends[word])
            out[hit[same]] = self.numbers[word[same]]
        return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), "binary"), pa.array(list(held.values()), "int64")], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        yield out()

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, s: Settings, text_col: str = "text", counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words of all documents; the driver gets these only. Counts of counts by sixteenths of their
    magnitude tell first from which count on words come into question, so that no more are sent than share the last one."""
    counts = word_counts(docs, text_col) if counts is None else counts
    size = s.vocabulary - FIRST
    level = F.floor(F.log2("n") * 16).cast("int")
    least, found = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 16 for each power of 2 at most
        least, found = r["level"], found + r["count"]
        if found >= size:
            break
    top = counts.filter(level >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    return Vocabulary([bytes(r["word"]) for r in top])


def _steps(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty words, one after the other: each symbol, the one before it, and the word's number."""
    size = np.array([len(w) + 1 for w in some], "int64")
    raw, ends = np.full(int(size.sum()), EDGE, "int64"), np.cumsum(size) - 1
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    raw[inside] = np.frombuffer(b"".join(some), "uint8")
    return raw, np.r_[EDGE, raw[:-1]], np.repeat(np.arange(len(some)), size)


def spelling(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Log-probabilities of a byte or the end after a byte or the start, by rare words' counts and one more each."""
    terms = counts.sparkSession.sparkContext.broadcast(vocab)  # at most s.vocabulary words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(257 * 257), terms.value
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in known]
            if rows:
                symbol, before, of = _steps([w for w, _ in rows])
                total += np.bincount(before * 257 + symbol, np.array([n for _, n in rows], "f8")[of], 257 * 257)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, "int64"), pa.array(total[at].astype("int64"))], ["at", "n"])

    table = np.ones(257 * 257)
    for r in counts.select("word", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 257 * 257 at most
        table[r["at"]] += r["n"]
    table = table.reshape(257, 257)
    table[EDGE, EDGE] = 0  # no word is empty
    with np.errstate(divide="ignore"):
        return np.log(table / table.sum(1, keepdims=True))


class Positions:
    """The words of texts: the number (target), the text (of) and the place there of each; context gives the neighbours."""

    def __init__(self, texts: list[str | None], vocab: Vocabulary, reach: int):
        self.texts, self.reach, self.spans = len(texts), reach, _spans(texts)
        raw, starts, ends, self.of = self.spans
        self.target = vocab.numbered(raw, starts, ends)
        self.place = np.arange(len(self.of)) - np.searchsorted(self.of, np.arange(len(texts) + 1))[self.of]
        self._ids = np.full(len(self.of) + reach * (len(texts) + 1), PAD, "int32")
        self._at = np.arange(len(self.of)) + reach * (self.of + 1)  # with so much padding before each text
        self._ids[self._at] = self.target

    def context(self, some) -> np.ndarray:
        at = self._at[some]
        return np.stack([self._ids[at + o] for o in range(-self.reach, self.reach + 1) if o], 1)

    def spelled(self, letters: np.ndarray) -> np.ndarray:
        """What the spelling of its rare words costs each text."""
        raw, starts, ends, of = self.spans
        rare = np.flatnonzero(self.target == RARE)
        size = ends[rare] - starts[rare] + 1  # with the end
        last = np.cumsum(size) - 1
        symbol = raw[np.repeat(starts[rare] - (last - size + 1), size) + np.arange(size.sum())].astype("int64")
        symbol[last] = EDGE
        before = np.r_[EDGE, symbol[:-1]][: len(symbol)]  # the end of one is the start of the next
        return np.bincount(np.repeat(of[rare], size), letters[before, symbol], self.texts)


def learned(place: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Which words a round learns, by their places in their texts."""
    return (place + turn) % s.stride == 0


def train(docs: DataFrame, vocab: Vocabulary, s: Settings = Settings(), text_col: str = "text") -> Network:
    """Parameters after s.rounds rounds over all documents."""
    net, sc = Network(s), docs.sparkSession.sparkContext
    terms = sc.broadcast(vocab)  # at most s.vocabulary words
    for turn in range(s.rounds):
        start = sc.broadcast(net.flat)  # a size fixed by the settings

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own, seen = Network(s, start.value.copy()), 0
            for batch in batches:
                for part in sliced(batch.column(0).to_pylist(), 2 * SLICE_CHARS):
                    found = Positions(part, terms.value, s.reach)
                    chosen = np.flatnonzero(learned(found.place, turn, s))
                    chosen = np.random.default_rng([s.seed, turn, len(found.target)]).permutation(chosen)
                    for k in range(0, len(chosen), s.batch):
                        own.step(found.context(chosen[k : k + s.batch]), found.target[chosen[k : k + s.batch]])
                    seen += len(chosen)
            if seen:
                change = (own.flat - start.value) * np.float32(seen)
                for k in range(0, len(change), s.piece):
                    yield pa.RecordBatch.from_pylist(
                        [{"piece": k // s.piece, "branch": TaskContext.get().partitionId(), "weight": float(seen), "change": change[k : k + s.piece].tobytes()}], schema
                    )

        schema = pa.schema([("piece", "int32"), ("branch", "int32"), ("weight", "float64"), ("change", "binary")])

        def add(rows: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, "f4") for x in rows["change"].to_pylist()], 0, dtype="f8").astype("f4")
            weight = float(np.sum(rows["weight"].to_numpy()))
            return pa.Table.from_pylist([{"piece": rows["piece"][0].as_py(), "branch": rows["branch"][0].as_py() // s.fan, "weight": weight, "change": total.tobytes()}], schema)

        sql = "piece int, branch int, weight double, change binary"
        changes = durable(docs.select(text_col).mapInArrow(run, sql))
        tasks = changes.agg(F.max("branch")).first()[0] or 0
        summed = changes
        while True:  # s.fan changes a task, level by level
            summed, tasks = summed.groupBy("piece", F.floor(F.col("branch") / s.fan).cast("int").alias("up")).applyInArrow(add, sql), tasks // s.fan
            if not tasks:
                break
        flat = net.flat.copy()
        for r in summed.collect():  # as many rows as the parameters have pieces
            part = np.frombuffer(bytes(r["change"]), "f4") / np.float32(r["weight"])
            flat[r["piece"] * s.piece : r["piece"] * s.piece + len(part)] += part
        net = Network(s, flat)
    return net


def score(docs: DataFrame, net: Network, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", spelled: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, log_prob (sum over words) and mean_log_prob of every whole text. Without the table
    spelled a rare word costs only that it is rare."""
    kind, sc, s = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext, net.s
    terms, flat = sc.broadcast(vocab), sc.broadcast(net.flat)
    letters = sc.broadcast(spelled)  # 257 * 257 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(s, flat.value)
        for batch in batches:
            n, total = [], []
            for part in sliced(batch.column(1).to_pylist()):
                found = Positions(part, terms.value, s.reach)
                cuts = [slice(k, k + s.batch) for k in range(0, len(found.target), s.batch)]
                logs = [own.log_probs(found.context(x), found.target[x]) for x in cuts]
                n.append(np.bincount(found.of, minlength=len(part)))
                total.append(np.bincount(found.of, np.concatenate(logs).astype("f8") if logs else None, minlength=len(part)).astype("f8"))
                if letters.value is not None:
                    total[-1] += found.spelled(letters.value)
            n = np.concatenate(n) if n else np.zeros(0, "int64")
            total = np.concatenate(total) if total else np.zeros(0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, "int64"), pa.array(total), mean], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, mean_log_prob double")
