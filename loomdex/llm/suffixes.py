"""Sorting of suffixes by prefix doubling."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, h: int = 1, depth: int | None = None) -> np.ndarray:
    """The suffix array of `text`, which ends in 0. Each 0 counts as a symbol of its own, lowest, by position.

    With h over 1, text[i] stands for h symbols from i; with a depth, suffixes are sorted by so many symbols at least,
    and `text` must go on for as many zeros.
    """
    n = len(text)
    plain = np.flatnonzero(text)
    order = np.concatenate([np.flatnonzero(text == 0), plain[np.argsort(text[plain])]])
    first = np.ones(n, bool)
    ranked = text[order]
    first[1:] = (ranked[1:] != ranked[:-1]) | (ranked[1:] == 0)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = first & np.append(first[1:], True)
    open_ = order[~alone]
    while len(open_) and (depth is None or h < depth):
        key = rank[open_] * n + rank[open_ + h]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group = key // n
        m = np.arange(len(open_))
        head = np.ones(len(open_), bool)
        head[1:] = group[1:] != group[:-1]
        slot = group + m - np.maximum.accumulate(np.where(head, m, 0))
        order[slot] = open_
        fresh = np.ones(len(open_), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[open_] = slot[np.maximum.accumulate(np.where(fresh, m, 0))]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order
