"""XXH64 of many short byte strings at once, by numpy: the published algorithm, spans of one length together."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# Fixed values of the algorithm.
_P1, _P2, _P3 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_P4, _P5 = _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)
#: Longer strings, and lengths that few strings share, go to the library one at a time.
LONGEST, FEW = 160, 4
_CHUNK = 1 << 15


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(state + lane * _P2, 31) * _P1


def _equal_lengths(data: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    # One row a string, its bytes gathered once; words of eight and four are views of the rows.
    width = -(-length // 8) * 8
    text = np.zeros((len(starts), width), np.uint8)
    text[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    lanes = text.view("<u8")
    at = 0
    with np.errstate(over="ignore"):
        if length >= 32:
            first = [np.full(len(starts), (seed + x) % (1 << 64), _U) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
            while length - at >= 32:
                first = [_round(v, lanes[:, at // 8 + i]) for i, v in enumerate(first)]
                at += 32
            out = sum(_rotated(v, bits) for v, bits in zip(first[1:], (7, 12, 18), strict=True)) + _rotated(first[0], 1)
            for v in first:
                out = (out ^ _round(np.zeros_like(v), v)) * _P1 + _P4
        else:
            out = np.full(len(starts), (seed + int(_P5)) % (1 << 64), _U)
        out = out + _U(length)
        while length - at >= 8:
            out = _rotated(out ^ _round(np.zeros_like(out), lanes[:, at // 8]), 27) * _P1 + _P4
            at += 8
        if length - at >= 4:
            out = _rotated(out ^ (text.view("<u4")[:, at // 4].astype(_U) * _P1), 23) * _P2 + _P3
            at += 4
        for i in range(at, length):
            out = _rotated(out ^ (text[:, i].astype(_U) * _P5), 11) * _P1
        out = (out ^ (out >> _U(33))) * _P2
        out = (out ^ (out >> _U(29))) * _P3
        return out ^ (out >> _U(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each span of the bytes."""
    out = np.empty(len(starts), _U)
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, LONGEST + 1).astype(np.uint16), kind="stable")
    short = lengths[order]
    edges = np.flatnonzero(np.diff(np.minimum(short, LONGEST + 1), prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        length = int(short[lo])
        if length > LONGEST or hi - lo < FEW:
            for i in order[lo:hi].tolist():
                out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
            continue
        for at in range(lo, hi, _CHUNK):
            own = order[at : min(hi, at + _CHUNK)]
            out[own] = _equal_lengths(data, starts[own], length, seed)
    return out
