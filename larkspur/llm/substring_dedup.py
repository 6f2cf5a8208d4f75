"""Substring deduplication by level-wise doubling of repeated word windows.

Levels are window lengths, each twice the one before (13, 25 and 50 words for a width of 50; odd
halves are rounded up, and the two halves then share a word).  The first level looks at the windows of its
length in all documents.  At each further level a start stays a candidate only if both halves of
its longer window repeated at the level before; only these are named and counted again.  At the
last level a window is found if a document with a smaller id holds it.

Names of windows are exchanged in buckets by :mod:`larkspur.llm.windows`.

Defined results: a null text has no words; texts shorter than a window keep all words; of
documents with one id none counts as earlier than another, and a null id counts as the largest;
a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from larkspur.llm import windows
from larkspur.llm.hashing import Polynomial

SHORTEST = 16  # windows of the first level have fewer words


def levels(width: int) -> list[int]:
    """Window lengths in ascending order, the last one ``width``."""
    out = [width]
    while out[0] >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Doubling(windows.Method):
    unit, by_id = windows.Words, True

    def __init__(self, width: int):
        self.width, self.lengths = width, levels(width)
        self.passes = len(self.lengths)

    def candidates(self, p: int, alive: np.ndarray | None, found: np.ndarray | None, starts: Callable[[int], np.ndarray], units: Callable[[], np.ndarray]) -> np.ndarray:
        fits = starts(self.lengths[p])
        if found is None:
            return fits
        shift = self.lengths[p] - self.lengths[p - 1]  # where the second half begins
        second = np.append(found, np.zeros(shift, bool))[shift:]
        return found & second & fits

    def names(self, p: int, units: np.ndarray, at: np.ndarray, poly: Polynomial) -> np.ndarray:
        return windows.stretches(units, at, (0, self.lengths[p]), poly)


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words joined by one space.

    A word goes when a window of ``width`` words that covers it also starts in a document with a
    smaller id.  With ``digest`` the last column is kept_sha256 instead.
    """
    show = (lambda text: hashlib.sha256(text).hexdigest()) if digest else bytes.decode
    out = windows.remove(docs, id_col, text_col, Doubling(width), "substring", show, "string")
    return out.selectExpr("id AS doc_id", "n AS n_words", "n_gone AS n_removed", "kept AS kept_sha256" if digest else "kept")
