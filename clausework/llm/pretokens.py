"""Cutting texts into the matches of the byte-level pre-tokenizer, a slice of texts at a time in numpy.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches follow from the
class of each character and of its neighbours, so they are found with array operations over all texts of a slice.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SIGN, BLANK = 0, 1, 2, 3
#: The short forms that are matches of their own after an apostrophe.
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices ``start, start + 1, …`` of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@functools.lru_cache(maxsize=2)
def character_classes(path: str) -> np.ndarray:
    """Class of every code point as the tokenizer of ``path`` sees it.

    Two public tables of different age give the classes; where they disagree (characters assigned between
    their versions), the tokenizer itself is asked whether the character joins a letter, digit or sign.
    """
    import regex
    from tokenizers import Tokenizer

    points = np.r_[0:0xD800, 0xE000:0x110000]
    text = "".join(map(chr, points))
    new = np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        new[[ord(c) for c in regex.findall(pattern, text)]] = kind
    old = new.copy()
    major = np.array([unicodedata.category(c)[0] for c in text])
    old[points] = np.where(new[points] == BLANK, BLANK, np.where(major == "L", LETTER, np.where(major == "N", NUMBER, SIGN)))
    unsure = np.flatnonzero(new != old)
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for kind, prefix in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")):
        found = cut("".join(f"{prefix}{chr(c)}\n" for c in unsure))
        new[unsure[[a // 3 for _, (a, b) in found if b - a == 2 and a % 3 == 0]]] = kind
    return new


class Pieces(NamedTuple):
    """Matches of a slice: their bytes, and how many belong to each text."""

    values: pa.BinaryArray
    per_text: np.ndarray


def _runs(points: np.ndarray, classes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where matches start: ``edge`` marks characters that no match may cross to."""
    kind = classes[points]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(start)
    last = np.r_[first[1:], len(points)] - 1
    run = kind[first]
    follows = np.r_[~edge[first[1:]], False]  # another run follows in the same text
    # The last blank of a run stands apart if something follows; a space goes with what follows.
    tail = last[(run == BLANK) & follows]
    start[tail] = True
    start[tail[points[tail] == 0x20] + 1] = False
    # A lone apostrophe that starts a match takes a short form with it.
    lone = np.flatnonzero((run == SIGN) & (first == last) & (points[first] == 0x27) & start[first] & follows)
    lone = lone[run[lone + 1] == LETTER]
    at, room = first[lone] + 1, last[lone + 1] - first[lone]
    taken = np.zeros(len(at), np.int64)
    one, two = points[at], points[np.minimum(at + 1, len(points) - 1)]
    for form in SHORT_FORMS:
        fits = one == ord(form[0])
        if len(form) == 2:
            fits &= (room > 1) & (two == ord(form[1]))
        taken[fits] = len(form)
    at, taken = at[taken > 0], taken[taken > 0]
    start[at] = False
    ends = at + taken
    start[ends[ends < len(points)]] = True
    return start


def cut_texts(texts: pa.StringArray, classes: np.ndarray, special: bytes = b"") -> Pieces:
    """Matches of all ``texts`` (no nulls). Occurrences of ``special`` are pieces of their own, cut out first."""
    raw = "".join(texts.to_pylist())
    data = raw.encode()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    if not data:
        return Pieces(pa.array([], pa.binary()), np.zeros(len(texts), np.int64))
    ascii_only = len(data) == len(raw)
    points = np.frombuffer(data, np.uint8) if ascii_only else np.frombuffer(raw.encode("utf-32-le"), "<u4")
    place = None
    if not ascii_only:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width  # byte offset of each character

    def char(offsets):
        return offsets if place is None else np.searchsorted(place, offsets)

    edge = np.zeros(len(points) + 1, bool)
    edge[char(np.r_[0, ends])] = True
    names = _occurrences(data, special, ends) if special else np.zeros(0, np.int64)
    edge[char(names)] = True
    edge[char(names + len(special))] = True
    edge = edge[:-1]
    start = _runs(points, classes, edge)
    for a in char(names):
        start[a + 1 : a + len(special)] = False
    starts = np.flatnonzero(start)
    starts = starts if place is None else place[starts]
    offsets = np.r_[starts, len(data)].astype(np.int32)
    values = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    bounds = np.searchsorted(starts, np.r_[0, ends])
    return Pieces(values, np.diff(bounds))


def _occurrences(data: bytes, name: bytes, ends: np.ndarray) -> np.ndarray:
    """Non-overlapping occurrences of ``name`` that lie in one text, leftmost first in each text."""
    found, at = [], data.find(name)
    while at >= 0:
        end = ends[np.searchsorted(ends, at, "right")]
        inside = at + len(name) <= end
        found += [at] if inside else []
        at = data.find(name, at + (len(name) if inside else 1))
    return np.array(found, np.int64)
