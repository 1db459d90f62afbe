"""Style features of whole texts, and bounded labelled samples, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .lang_id import held_out
from .textscan import LOWER, NOT_SPACE, byte_class, per_text, word_hashes, words

_UPPER, _DIGIT, _HIGH = byte_class((65, 90)), byte_class((48, 57)), byte_class((128, 255))
_LETTER = byte_class((65, 90), (97, 122)) | _HIGH
_MARK = byte_class((33, 47), (58, 64), (91, 96), (123, 126))
_COMMON_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:'-\"()", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_PIPE = np.isin(np.arange(256), np.frombuffer(b"|{}[]<>=\\_~^", np.uint8))

STYLE = (
    "log_words", "word_length", "upper_share", "digit_share", "mark_share", "odd_mark_share", "shout_marks", "table_marks", "high_share",
    "unique_share", "repeated_word", "marked_words", "capital_words", "stop_share", "line_words", "repeated_lines", "longest_word", "space_share",
)


def style(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STYLE features for each text; zeros for empty texts."""
    n_bytes = np.diff(off)
    starts, ends, at = words(data, off, NOT_SPACE)
    n = np.diff(at)
    by, per_word = np.maximum(n_bytes, 1), np.maximum(n, 1)
    count = lambda table: per_text(table[data], off)
    h = word_hashes(LOWER[data], starts, ends)
    text_of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text_of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    unique = np.bincount(text_of[order][new], minlength=len(n))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    first, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
    l_start, l_end, l_at = words(data, off, np.arange(256) != 10)
    lines = np.maximum(np.diff(l_at), 1)
    lh = word_hashes(data, l_start, l_end)
    l_text = np.repeat(np.arange(len(n)), np.diff(l_at))
    l_order = np.lexsort((lh, l_text))
    l_new = np.ones(len(lh), bool)
    l_new[1:] = (lh[l_order][1:] != lh[l_order][:-1]) | (l_text[l_order][1:] != l_text[l_order][:-1])
    longest = np.zeros(len(n))
    np.maximum.at(longest, text_of, ends - starts)
    letters = np.maximum(count(_LETTER), 1)
    return np.stack([
        np.log1p(n), (n_bytes - count(~NOT_SPACE)) / per_word, count(_UPPER) / letters, count(_DIGIT) / by, count(_MARK) / by, count(_MARK & ~_COMMON_MARK) / by,
        count(np.arange(256) == 33) / per_word, count(_PIPE) / per_word, count(_HIGH) / by, unique / per_word, per_text(same, at) / per_word, per_text(_MARK[last] & ~_COMMON_MARK[last], at) / per_word,
        per_text(_UPPER[first], at) / per_word, per_text(_STOP[last], at) / per_word, np.log1p(n / lines), 1 - np.bincount(l_text[l_order][l_new], minlength=len(n)) / lines * (n > 0), np.log1p(longest), count(~NOT_SPACE) / by,
    ], axis=1) * (n > 0)[:, None]


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(doc_id, text, *columns) of at most `most` documents to learn from.

    Rows that are not held out, with all labels; of several labels for a document the mean counts, from
    0.5 as 1. The ones with the least hash of their id are taken, so the sample is the same each time.
    """
    known = labels.where(~held_out(F.col("doc_id"))).dropna(subset=["doc_id", *columns])
    chosen = known.groupBy("doc_id").agg(*((F.avg(c) >= 0.5).cast("int").alias(c) for c in columns))
    chosen = chosen.join(docs.select("doc_id").dropna().distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
