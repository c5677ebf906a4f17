"""Anchored segments: how windows of a sequence find their equals without a shuffle of all windows.

A window of W items has an anchor, the least hash among its k-mers. The anchor depends
on the window's content alone, so equal windows have equal anchors. Consecutive windows
with one anchor form a segment; a segment costs one short row instead of a row for each
window. Every window lies in exactly one segment.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Longest segment in windows; longer ones (periodic text) are cut, which changes no anchor.
MAX_WINDOWS = 2048


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kmer_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items (uint64), by doubling: n - k + 1 values."""
    parts, done, power, span, h = None, 0, _MULTIPLIER, 1, items
    rest = k
    while rest:
        if rest & 1:
            if parts is None:
                parts, done = h, span
            else:
                n = len(items) - (done + span) + 1
                parts = parts[:n] * power + h[done : done + n]
                done += span
        rest >>= 1
        if rest:
            h = h[: len(h) - span] * power + h[span:]
            with np.errstate(over="ignore"):
                power = power * power
            span *= 2
    return mixed(parts)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


def segments(items: np.ndarray, offsets: np.ndarray, window: int, k: int, block: int = 1 << 16):
    """Segments of the sequences items[offsets[i]:offsets[i+1]] (uint64 items).

    Returns arrays (sequence, start in it, windows, anchor as int64, weight). Weight 2 says
    that the anchor's k-mer occurs again nearby, so that a window may recur inside this very
    segment. Items are taken in blocks: memory does not grow with the length of a sequence.
    """
    out = []
    total = int(offsets[-1])
    starts, stops = offsets[:-1], offsets[1:] - window + 1  # windows start in [start, stop)
    keep = stops > starts
    cuts = np.unique(np.concatenate([starts[keep], stops[keep]]))
    for lo in range(0, total - window + 1, block):
        chunk = items[lo : min(total, lo + block + window - 1)]
        if len(chunk) < window:
            break
        hashes = kmer_hashes(chunk, k)
        low = sliding_min(hashes, window - k + 1)
        n = len(low)
        at = np.flatnonzero(low[1:] != low[:-1]) + 1
        inside = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, lo + n)] - lo
        at = np.unique(np.concatenate([[0], at, inside]))
        size = np.diff(np.append(at, n))
        if size.max(initial=0) > MAX_WINDOWS:
            at = np.concatenate([np.arange(a, a + s, MAX_WINDOWS) for a, s in zip(at, size)])
            size = np.diff(np.append(at, n))
        seq = np.searchsorted(offsets, at + lo, side="right") - 1
        valid = at + lo < stops[np.minimum(seq, len(stops) - 1)]
        at, size, seq = at[valid], size[valid], seq[valid]
        anchor = low[at]
        few = np.sort(hashes[hashes <= anchor.max(initial=0)])
        weight = 1 + np.isin(anchor, few[1:][few[1:] == few[:-1]])
        out.append((seq, at + lo - offsets[seq], size, anchor.view(np.int64), weight))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > ends[:-1])
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]
