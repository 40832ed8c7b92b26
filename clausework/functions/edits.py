"""Edit distances of a block of titles to a block of official titles, without a pass over single pairs."""

from __future__ import annotations

import numpy as np

#: Pairs whose rows of the table are held at once, and the distance of a title or an official title that is missing.
CELLS, MISSING = 1 << 18, 2 * 10**6


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    width = max(1, int(sizes.max(initial=1)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width), sizes


def closest(titles: list, officials: list) -> tuple[np.ndarray, np.ndarray]:
    """For every title the rounded distance (1 - edit ratio in millionths) of its closest official title and that one's number, the first of equals.

    Neighbouring titles share the rows of the table for the start they have in common, so sorted titles cost a few rows each.
    """
    far, nth = np.full(len(titles), MISSING, np.int64), np.zeros(len(titles), np.int64)
    asked = np.flatnonzero([t is not None for t in titles])
    known = np.flatnonzero([o is not None for o in officials])
    if not len(asked) or not len(known):
        return far, nth
    text, sizes = _codes([titles[i] for i in asked])
    pattern, lengths = _codes([officials[i] for i in known])
    common = np.argmin(np.c_[text[1:] == text[:-1], np.zeros(len(text) - 1, bool)], axis=1)
    signs = np.unique(pattern)
    small = np.uint8 if max(text.shape[1], pattern.shape[1]) < 255 else np.uint16 if max(text.shape[1], pattern.shape[1]) < 65_535 else np.uint32
    code = np.searchsorted(signs, text)
    code = np.where(signs[np.minimum(code, len(signs) - 1)] == text, code, len(signs))
    pattern = np.searchsorted(signs, pattern)
    step = max(256, CELLS // len(asked))
    best, pick = far[asked], nth[asked]
    used, code = np.unique(code, return_inverse=True)
    code = code.reshape(text.shape)
    for low in range(0, len(known), step):
        part, ends = pattern[low : low + step], lengths[low : low + step]
        shared = int(np.argmin(np.r_[(part == part[0]).all(axis=0), False]))  # one column stands for the start that all have in common
        differ = [(used[:, None] != part[None, : 1 if j < shared else None, j]).view(np.uint8) for j in range(part.shape[1])]
        table = [np.full((1, 1), j, small) for j in range(part.shape[1] + 1)]
        node = np.zeros(len(asked), np.int64)
        edits = np.zeros((len(asked), len(part)), small)

        def keep(depth):
            done = np.flatnonzero(sizes == depth)
            for size in np.unique(ends) if len(done) else ():
                of = np.flatnonzero(ends == size)
                row = table[size].take(node[done], axis=0)
                edits[np.ix_(done, of)] = row[:, of] if row.shape[1] > 1 else row

        keep(0)
        for depth in range(text.shape[1]):
            begins = np.r_[0, np.flatnonzero(common <= depth) + 1]
            parent, sign = node[begins], code[begins, depth]
            over = table[0].take(parent, axis=0)
            below = [np.full((len(begins), 1), depth + 1, small)]
            for j, unlike in enumerate(differ):
                after = table[j + 1].take(parent, axis=0)
                new = np.minimum(after, below[j])
                new += 1
                below.append(np.minimum(new, over + unlike.take(sign, axis=0)))
                over = after
            table = below
            node = np.zeros(len(asked), np.int64)
            node[begins[1:]] = 1
            node = np.cumsum(node)
            keep(depth + 1)
        ratio = 1.0 - edits / np.maximum(np.maximum(sizes[:, None], ends[None, :]), 1)
        distance = 10**6 - np.floor(ratio * 10**6 + 0.5).astype(np.int64)
        first = np.argmin(distance, axis=1)
        least = distance[np.arange(len(asked)), first]
        better = least < best
        best, pick = np.where(better, least, best), np.where(better, known[low + first], pick)
    far[asked], nth[asked] = best, pick
    return far, nth
