"""Hashes of byte spans, for whole arrays of spans at once, and whether spans are equal byte by byte.

A span is taken eight bytes at a time; each chunk is mixed in by a multiplication and shifts, which is no polynomial that
texts could be built against. Where equality decides a result, callers compare bytes."""

from __future__ import annotations

import numpy as np

_MIX, _LAST = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)


def chunks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; what span_hashes reads."""
    padded = np.zeros(len(raw) + 8, "uint8")
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def span_hashes(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    left = ends - starts
    h = (left.astype("uint64") + np.uint64(1)) * _LAST
    live = np.flatnonzero(left > 0)
    at, left = starts[live], left[live]
    while len(live):
        part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype("uint64")))
        x = (h[live] ^ part) * _MIX
        h[live] = x ^ (x >> np.uint64(32))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    h = (h ^ (h >> np.uint64(29))) * _LAST
    return h ^ (h >> np.uint64(31))


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which spans of raw have the same bytes as those of other, one by one."""
    left = ends - starts
    same = left == other_ends - others
    one, two = chunks(raw), chunks(other)
    live = np.flatnonzero(same & (left > 0))
    at, to, left = starts[live], others[live], left[live]
    while len(live):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype("uint64"))
        unlike = ((one[at] ^ two[to]) & mask) != 0
        same[live[unlike]] = False
        more = np.flatnonzero(~unlike & (left > 8))
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same
