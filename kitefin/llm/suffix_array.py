"""Suffix arrays of many strings at once, by grouping suffixes that share their Lyndon prefix.

Linear grouping construction: suffixes start in groups by first symbol. Groups are processed from the highest down;
each suffix of a group gets a pointer to the previous suffix of a smaller group, and the suffixes pointed at move to
new groups behind what is left of theirs, in the order of how often they were pointed at. At the end a group holds the
suffixes with one Lyndon prefix, and a single pass from the smallest suffix up follows the pointers and emits each
group's order; nothing is renamed or sorted recursively. A step handles one group of every string of the batch, with
arrays over all of them, so that the work is numpy's and not the interpreter's.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    n = ends - starts
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(first - starts, n)


def suffix_arrays(symbols: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings that stand one after the other, string k from base[k] up to base[k + 1].

    Each string must end with a symbol that is smaller than all its others and occurs there only. The result holds
    positions in `symbols`; the suffixes of string k, in order, are at base[k] up to base[k + 1].
    """
    group, pointer = _lyndon_groups(symbols, base)
    return _emit(group, pointer, base)


def _lyndon_groups(symbols: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix, as where its group starts in the order, and its pointer, -1 for none."""
    total = len(symbols)
    string = np.repeat(np.arange(len(base) - 1), np.diff(base))
    at = np.lexsort((symbols, string))  # suffixes in the order so far
    place = np.empty(total, np.int64)
    place[at] = np.arange(total)
    head = np.flatnonzero(np.r_[True, (np.diff(symbols[at]) != 0) | (np.diff(string[at]) != 0)]) if total else np.zeros(0, np.int64)
    size = np.zeros(total + 1, np.int64)
    size[head] = np.diff(np.r_[head, total])
    group = np.empty(total, np.int64)
    group[at] = np.repeat(head, size[head])
    is_first = np.zeros(total + 1, bool)
    is_first[base] = True
    pointer, known, pointed = np.full(total, -1, np.int64), np.zeros(total, bool), np.zeros(total, bool)
    low, top = base[:-1].copy(), base[1:].copy()
    while True:
        left = top > low
        low, top = low[left], top[left]
        if not len(top):
            return group, pointer
        start = group[at[top - 1]]
        members = at[_ranges(start, top)]
        top = start
        # The previous suffix of a smaller group: pointers of suffixes in higher groups, or in this one, lead there.
        j = np.where(is_first[members], -1, members - 1)
        open_, mine = np.arange(len(members)), group[members]
        while len(open_):
            go = j[open_] >= 0
            go[go] = group[j[open_[go]]] >= mine[open_[go]]
            done = open_[~go]
            pointer[members[done]] = j[done]
            known[members[done]] = True
            open_ = open_[go]
            ready = open_[known[j[open_]]]
            j[ready] = pointer[j[ready]]
        aims = pointer[members]
        aims, count = np.unique(aims[aims >= 0], return_counts=True)
        if not len(aims):
            continue
        # What is pointed at goes to the end of its group's range, by count, each count a group of its own.
        order = np.lexsort((count, group[aims]))
        aims, count = aims[order], count[order]
        old = group[aims]
        new_old = np.r_[True, old[1:] != old[:-1]]
        run = np.flatnonzero(new_old)
        many = np.diff(np.r_[run, len(aims)])
        tail = np.repeat(old[run] + size[old[run]] - many, many)
        to = tail + np.arange(len(aims)) - np.repeat(run, many)
        pointed[aims] = True
        inside, free = at[to], place[aims]
        inside, free = inside[~pointed[inside]], free[free < tail]
        at[free], place[inside] = inside, free
        at[to], place[aims] = aims, to
        pointed[aims] = False
        size[old[run]] -= many
        cut = np.flatnonzero(new_old | np.r_[True, count[1:] != count[:-1]])
        n = np.diff(np.r_[cut, len(aims)])
        group[aims] = np.repeat(to[cut], n)
        size[to[cut]] = n


def _emit(group: np.ndarray, pointer: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = np.zeros(len(group), np.int64)
    front = np.arange(len(group))
    placed = np.zeros(len(group), bool)
    length = np.diff(base)
    order = np.argsort(-length, kind="stable")
    low, length = base[:-1][order], length[order]
    low, length = low[length > 0], length[length > 0]
    last = low + length - 1
    out[low], placed[last] = last, True
    for k in range(int(length.max(initial=0))):
        if length[-1] <= k:
            still = np.searchsorted(-length, -k, "left")  # lengths fall; those over k are in front
            low, length = low[:still], length[:still]
        at = out[low + k]
        j = np.where(at > low, at - 1, -1)
        while len(j):
            j = j[j >= 0]
            j = j[~placed[j]]
            start = group[j]
            out[front[start]] = j
            front[start] += 1
            placed[j] = True
            j = pointer[j]
    return out
