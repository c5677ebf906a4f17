"""Run-length Burrows-Wheeler index of a bounded text, and its matching statistics.

The index keeps the runs of the transform and, for each run, the suffix positions at its
two ends (the sampled run ends). They determine how far each suffix agrees with its
neighbours in suffix order: a suffix in the middle of a run agrees one byte less than the
suffix one position to its left, so only run ends need a comparison of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Byte that ends each piece. It occurs in no UTF-8 text.
END = 0xFF


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end of the text sorts before every byte."""
    n = len(text)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text.astype(np.uint64) + np.uint64(1)
    key = (key[:-1] << np.uint64(9)) | key[1:]
    key = (key[:-2] << np.uint64(18)) | key[2:]
    key = (key[:-3] << np.uint64(27)) | (key[3:] & np.uint64((1 << 27) - 1))
    order, rank, groups = _ranked(key[:n])
    span = 6
    while groups < n:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - span)] = rank[span:] + 1
        order, rank, groups = _ranked(rank * (n + 1) + ahead)
        span *= 2
    return order


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(key)
    ordered = key[order]
    step = np.append(0, (ordered[1:] != ordered[:-1]).astype(np.int64)).cumsum()
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return order, rank, int(step[-1]) + 1


@dataclass
class RunIndex:
    """Runs of the transform (symbol, length) and the samples (suffix at a run end,
    its neighbour across the run border, length on which the two agree)."""

    symbols: np.ndarray
    lengths: np.ndarray
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]


def build(text: np.ndarray) -> RunIndex:
    sa = suffix_array(text)
    bwt = np.where(sa > 0, text[sa - 1].astype(np.int16), -1)
    border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    first = np.append(0, border)
    agree = agreement(text, sa[border], sa[border - 1])
    heads = np.append(sa[0], sa[border]), np.append(0, agree)
    tails = np.append(sa[border - 1], sa[-1]), np.append(agree, 0)
    return RunIndex(bwt[first], np.diff(np.append(first, len(bwt))), heads, tails)


def agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a[i] and b[i]."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    left = n - np.maximum(a, b)
    live = np.arange(len(a))
    while len(live):
        at = out[live]
        x = words[np.minimum(a[live] + at, n)]
        y = words[np.minimum(b[live] + at, n)]
        differ = x != y
        step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[live] = np.minimum(at + step, left[live])
        live = live[(step == 8) & (at + 8 < left[live])]
    return out


def matching_statistics(index: RunIndex, n: int) -> np.ndarray:
    """For each position, the longest string that starts there and also starts elsewhere.

    Streams the text from left to right: at a sampled position the value is the sample's,
    at any other it is one less than at the position before.
    """
    best = np.zeros(n, np.int64)
    place = np.arange(n)
    for position, agree in (index.heads, index.tails):
        at = np.full(n, -1, np.int64)
        at[position] = position
        last = np.maximum.accumulate(at)
        value = np.zeros(n, np.int64)
        value[position] = agree
        best = np.maximum(best, value[np.maximum(last, 0)] - (place - last))
    return best


def repeated_starts(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows that occur a second time in the pieces."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    statistics = matching_statistics(build(text), len(text))
    out, at = [], 0
    for p in pieces:
        count = len(p) - window + 1
        # A match that runs over the piece's end is as long as the piece allows, or longer.
        out.append(np.flatnonzero(statistics[at : at + max(count, 0)] >= window))
        at += len(p) + 1
    return out
