"""Tokenizers inside tasks: one per worker process, with memos that live from batch to batch."""

from __future__ import annotations

import base64
import functools
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tableprobe.llm.rolling import chunks, same_spans, span_hashes

#: Characters of text that are split into words at a time; words that a memo holds before it starts anew.
SLICE_CHARS = 500_000
MEMO_WORDS = 450_000
#: The normaliser, the word pattern and the end of words of the tokenizers that WordEncoder takes word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"


def _table(chars: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_LETTER = _table(range(0x61, 0x7B))
#: The second bytes of the lower-case letters from U+00DF on, behind 0xC3.
_LATIN = _table([*range(0x9F, 0xB7), *range(0xB8, 0xC0)])
#: ASCII marks but the apostrophe, which may belong to the letters behind it.
_MARK = _table([x for x in range(0x21, 0x7F) if x != 0x27 and not chr(x).isalnum()])


class WordEncoder:
    """ids of whole texts. A tokenizer that lower-cases, drops white space and parts letters from marks is applied to
    words, each distinct one once while the memo holds it; any other to texts as they are."""

    def __init__(self, path: str, encode_special_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = encode_special_tokens
        told = json.loads(self.tokenizer.to_str())
        pre = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        model = told["model"]
        self.by_words = (
            told["normalizer"] == _NORMALIZER and pre[0].get("pattern") == {"Regex": _WORDS} and pre[0].get("invert") and not told["post_processor"]
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and not pre[1].get("add_prefix_space") and model.get("end_of_word_suffix") == _WORD_END
        )
        self.ends = np.array([w.endswith(_WORD_END) for w, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]) if self.by_words else None
        self.forget()

    def forget(self) -> None:
        """The memo: hashes of words, ascending; where the ids of each begin and how many they are; the ids of all; where
        its letters begin and end; the letters of all."""
        self.known, self.flat, self.letters = np.zeros(0, "uint64"), np.zeros(0, "<u4"), np.zeros(0, "uint8")
        self.start, self.length, self.word, self.word_end = (np.zeros(0, "int64") for _ in range(4))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Words of letters in one call, as a token at a word's end is known as such; others one by one."""
        texts = [w.decode() for w in words]
        found: list[np.ndarray | None] = [None] * len(words)
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(letters), 20_000):
            part = letters[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                for k, p, q in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    found[k] = ids[p:q]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, one in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = np.array(one.ids, "<u4")
        length = np.array([len(x) for x in found], "int64")
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.flat = np.concatenate([self.flat, *found])
        size = np.array([len(w) for w in words], "int64")
        until = len(self.letters) + np.cumsum(size)
        self.word, self.word_end = np.insert(self.word, at, until - size), np.insert(self.word_end, at, until)
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), "uint8")])

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """None where two different words of the texts, or of the texts and the memo, have one hash."""
        raw = np.frombuffer(b" ".join(texts) + b" ", "uint8")
        blank = raw == 0x20
        # A mark behind a letter begins a word: fewer forms of words, and the tokenizer parts the two anyway.
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        cut = np.r_[False, letter[:-1] & _MARK[raw[1:]]]
        starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | cut))
        ends = np.flatnonzero(blank | cut)
        ends = ends[np.searchsorted(ends, starts, "right")]
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, text_at)
        own, first, of = np.unique(span_hashes(chunks(raw), starts, ends), return_index=True, return_inverse=True)
        of = of.ravel()
        if not same_spans(raw, starts, ends, raw, starts[first][of], ends[first][of]).all():
            return None
        if len(self.known) > MEMO_WORDS:
            self.forget()
        at = np.searchsorted(self.known, own)
        new = np.flatnonzero(np.r_[self.known, np.uint64(0)][at] != own) if len(self.known) else np.arange(len(own))
        if len(new):
            data = raw.tobytes()
            self._learn(own[new], [data[p:q] for p, q in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, own)
        if not same_spans(raw, starts[first], ends[first], self.letters, self.word[at], self.word_end[at]).all():
            self.forget()
            return None
        number = at[of]
        length = self.length[number]
        until = np.r_[0, np.cumsum(length)]
        ids = self.flat[np.repeat(self.start[number] - until[:-1], length) + np.arange(until[-1])]
        cuts = until[bounds]
        return [ids[p:q] for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        for part in sliced(texts, 2 * SLICE_CHARS):
            # Texts that may hold special tokens are encoded as they are.
            plain = [k for k, t in enumerate(part) if t and (not self.by_words or "<|" in t)]
            odd = dict(zip(plain, self.tokenizer.encode_batch_fast([part[k] for k in plain], add_special_tokens=False), strict=True))
            known: list[np.ndarray] | None = [np.zeros(0, "<u4")] * len(part)
            if self.by_words:
                known = self._by_words([b"" if k in odd or not t else t.replace("\n", " ").encode().lower() for k, t in enumerate(part)])
                if known is None:
                    known = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
            for k, ids in enumerate(known):
                yield np.array(odd[k].ids, "<u4") if k in odd else ids


class ByteEncoder:
    """ids of whole texts by a byte-level BPE of which the ranks are given, as the tokenizer of its JSON file encodes them."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(json_path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(*ranks.values(), *self.special.values()) + 1
        self.bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; null counts as empty."""
        odd = any(x in text for x in self.special) if text else False
        return np.array(array("I", self.bpe.encode(text, allowed_special="all") if odd else self.bpe.encode_ordinary(text or "")))


@functools.cache
def byte_encoder(json_path: str, ranks_path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(json_path, ranks_path, pattern)


def sliced(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts in lists of about so many characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def release() -> None:
    """Gives back what Arrow holds unused: at a task's end, as the worker process stays."""
    pa.default_memory_pool().release_unused()


@functools.cache
def word_encoder(path: str, encode_special_tokens: bool = False) -> WordEncoder:
    return WordEncoder(path, encode_special_tokens)
