"""Vectorised pre-tokenisation for the published byte-level and word-level patterns.

The byte-level pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Every
alternative is a run of one character class, apart from a leading blank, the last white space before a word, and the
English contractions, so the matches follow from class changes alone. The word-level pattern is the same without white
space, with digits one by one.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import pre_tokenizers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point as the tokenizer libraries have it: runs of one class among all code points in a row
    come out as one match of the pattern, and one character of each run, between two others of a class, names it."""
    if not _classes:
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for base in range(0, len(table), 1 << 14):
            points = [c for c in range(base, base + (1 << 14)) if not 0xD800 <= c < 0xE000]
            if not points:
                continue
            for _, (a, b) in split("".join(map(chr, points))):
                c = chr(points[b - 1])  # a blank may stand before the run
                kind = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + c + x)) == 1), SPACE)
                table[points[a] : points[b - 1] + 1] = kind
        table[0x20] = SPACE
        _classes.append(table)
    return _classes[0]


def shared(spark: SparkSession) -> Broadcast:
    """The classes, made by the driver, for adopt() in workers: a byte for each code point."""
    return spark.sparkContext.broadcast(classes())


def adopt(table: np.ndarray) -> None:
    if not _classes:
        _classes.append(table)


def _contractions(points: np.ndarray, marks: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Code points after each apostrophe that a contraction takes: 0, 1 or 2."""
    last = len(points) - 1
    one = np.where(marks + 1 < stops, points[np.minimum(marks + 1, last)], 0)
    two = np.where(marks + 2 < stops, points[np.minimum(marks + 2, last)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    return np.where(short, 1, np.where(long, 2, 0))


def byte_level(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pre-tokens, number of pre-tokens before each offset); pre-tokens cover everything."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)  # where a text starts, and the end
    edge[offsets] = True
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= edge[:-1]
    # White space before a word of the same text: its last character stands apart, and a blank joins the word.
    words = np.flatnonzero(begins & (kind != SPACE))
    words = words[words > 0]
    words = words[(kind[words - 1] == SPACE) & ~edge[words]]
    begins[words - 1] = True
    joined = words[points[words - 1] == 0x20]
    begins[joined] = False
    # An apostrophe alone in its run, not after a blank: a contraction may take the next letters.
    marks = np.flatnonzero(begins & (points == 0x27))
    if len(marks):
        marks = marks[(marks + 1 < n)]
        marks = marks[(kind[marks + 1] == LETTER) & ~edge[marks + 1]]
    if len(marks):
        stops = offsets[np.searchsorted(offsets, marks, "right")]
        taken = _contractions(points, marks, stops)
        marks, taken, stops = marks[taken > 0], taken[taken > 0], stops[taken > 0]
        begins[marks + 1] = False
        after = marks + 1 + taken
        begins[after[after < stops]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def word_level(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number before each offset) for lower-case text: no white space, digits one by one."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= edge[:-1] | (kind == NUMBER)
    marks = np.flatnonzero(begins & (points == 0x27))
    if len(marks):
        marks = marks[(marks + 1 < n)]
        marks = marks[(kind[marks + 1] == LETTER) & ~edge[marks + 1]]
    if len(marks):
        stops = offsets[np.searchsorted(offsets, marks, "right")]
        taken = _contractions(points, marks, stops)
        marks, taken, stops = marks[taken > 0], taken[taken > 0], stops[taken > 0]
        begins[marks + 1] = False
        after = marks + 1 + taken
        begins[after[after < stops]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)
