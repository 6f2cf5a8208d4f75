"""Suffix-array deduplication, as a radix sort of suffixes that stops at the threshold.

Suffixes need an order only through their first ``width`` bytes (400): those that are equal so
far are the repeated windows.  The sort goes from the most significant digit on.  Digits are the
``DIGITS`` successive stretches of these bytes, and a pass orders (group, suffix) rows: by the group that
the digits before have left the suffix in, and by the fingerprint of the next digit.  The rows are dealt
into buckets by the leading bits of that key and sorted by the others inside each bucket, so equal
keys stand together and are the groups of the next pass.  A group of one leaves the sort at each pass;
the groups left after the last one are exactly the repeated windows.

Most suffixes are alone in the first digit already, so a thinning pass goes ahead: a quarter of the
width is fingerprinted at every place, and only the places whose fingerprint ends in ``THIN`` zero
bits are sorted.  One that is alone there cannot lie in a repeated window, and no window around it
enters the sort.  All others do.

The order is that of the digits' fingerprints, not of the alphabet, which no result depends on.
Keys are exchanged in buckets by :mod:`larkspur.llm.windows`.

Defined results: a null text has no bytes; texts shorter than the width keep all bytes; rows
with one id are separate documents; a null id stays null; a table without rows gives none; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from larkspur.llm import windows
from larkspur.llm.hashing import FIRST, Polynomial

DIGITS = 2
THIN = 3


class Radix(windows.Method):
    unit = windows.Bytes

    def __init__(self, width: int):
        digits = min(DIGITS, width)
        self.width, self.passes = width, 1 + digits
        self.stretch = max(1, width // 4)  # of the thinning pass
        self.cuts = tuple(width * i // digits for i in range(digits + 1))

    def candidates(self, p: int, alive: np.ndarray | None, found: np.ndarray | None, starts: Callable[[int], np.ndarray], units: Callable[[], np.ndarray]) -> np.ndarray:
        if p == 0:
            mask, hashed = starts(self.stretch), units()
            for lo in range(0, len(mask), windows.BLOCK):
                places = np.flatnonzero(mask[lo : lo + windows.BLOCK])
                names = self.names(0, hashed[lo : lo + windows.BLOCK + self.stretch], places, FIRST)
                mask[lo + places] = (names & np.uint64((1 << THIN) - 1)) == 0
            return mask
        if p > 1:
            return found
        # A place that is alone rules out the windows that begin up to width - stretch before it.
        alone = np.flatnonzero(alive & ~found)
        reach = self.width - self.stretch
        return windows.fill(starts(self.width), np.maximum(alone - reach, 0), alone + 1, False)

    def names(self, p: int, units: np.ndarray, at: np.ndarray, poly: Polynomial) -> np.ndarray:
        """Thinning: the stretch.  Then: the group after the digits before, and the digit of the pass."""
        return windows.stretches(units, at, self.cuts[: p + 1] if p else (0, self.stretch), poly)


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the kept bytes (as binary).

    A byte goes when a string of ``width`` bytes that covers it starts anywhere else too.  With
    ``digest`` the last column is kept_sha256 instead.
    """
    show = (lambda data: hashlib.sha256(data).hexdigest()) if digest else bytes
    out = windows.remove(docs, id_col, text_col, Radix(width), "suffix", show, "string" if digest else "binary")
    return out.selectExpr("id AS doc_id", "n AS n_bytes", "n_gone AS n_removed", "spans AS n_spans", "kept AS kept_sha256" if digest else "kept")
