"""Burrows-Wheeler transforms of string collections, merged by interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: the end of a string, a missing byte, then bytes from BYTE on, then anything larger.
END, VOID, BYTE = 0, 1, 2


@dataclass(frozen=True)
class Transform:
    """``bwt[i]`` precedes the i-th suffix, which starts at ``place[i]`` of ``owner[i]``."""

    bwt: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def build(strings: np.ndarray, first: int = 0) -> Transform:
    """Transform of the rows of a matrix, each ended by END, with suffixes sorted by doubled prefixes."""
    rows, width = strings.shape
    text = np.concatenate((strings, np.zeros((rows, 1), strings.dtype)), axis=1).ravel().astype(np.int64)
    n, step = len(text), 1
    ends = np.arange(width, n, width + 1)
    rank = text.copy()
    while step <= width:
        # beyond a string's end nothing is compared: ends of strings all look the same
        follow = np.zeros(n, dtype=np.int64)
        at = np.arange(n - step)
        inside = (at % (width + 1)) + step <= width
        follow[at[inside]] = rank[at[inside] + step] + 1
        _, rank = np.unique(rank * (int(follow.max()) + 1) + follow, return_inverse=True)
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = text[np.where(order % (width + 1) == 0, ends[order // (width + 1)], order - 1)]
    return Transform(before.astype(np.int32), first + order // (width + 1), order % (width + 1))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """Merged transform and its blocks: suffixes with equal first ``depth`` symbols have one number.

    The interleave starts with all of ``a`` before ``b``. A round reads the
    preceding symbols in the order of the interleave and sorts them stably, which
    orders the suffixes by one more symbol; blocks split where the symbol or the
    block that it came from changes, which is where common prefixes end. No
    suffix is sorted again. Rounds stop at ``depth`` or when no block splits.
    """
    n = len(a.bwt) + len(b.bwt)
    mark = np.zeros(n, dtype=np.int8)
    mark[len(a.bwt) :] = 1
    block = np.zeros(n, dtype=np.int64)
    symbol = np.empty(n, dtype=np.int32)
    wide = int(max(a.bwt.max(initial=0), b.bwt.max(initial=0))) >= 1 << 16
    for _ in range(depth):
        symbol[mark == 0] = a.bwt
        symbol[mark == 1] = b.bwt
        order = np.argsort(symbol if wide else symbol.astype(np.uint16), kind="stable")
        s, o = symbol[order], block[order]
        split = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]) | (o[1:] != o[:-1]))))
        again = np.array_equal(split, block) and np.array_equal(mark[order], mark)
        mark, block = mark[order], split
        if again:
            break
    out = Transform(np.empty(n, np.int32), np.empty(n, np.int64), np.empty(n, np.int64))
    for k, t in enumerate((a, b)):
        at = mark == k
        out.bwt[at], out.owner[at], out.place[at] = t.bwt, t.owner, t.place
    return out, block


def repeated(strings: np.ndarray, depth: int, shard: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, block) of all suffixes of the rows of ``strings``, in an order by their first ``depth`` symbols.

    Suffixes of one block agree in ``depth`` symbols. Shards are transformed one
    by one and their transforms merged in pairs.
    """
    parts = [build(strings[at : at + shard], at) for at in range(0, len(strings), shard)]
    none = Transform(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    while len(parts) > 2:
        parts = [merge(*parts[k : k + 2], depth)[0] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    whole, block = merge(parts[0], parts[1] if len(parts) > 1 else none, depth)
    return whole.owner, whole.place, block
