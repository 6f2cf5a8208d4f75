"""Hierarchical multi-length packing of tokenised documents.

A task tokenises its documents and packs them by itself, in rounds of bounded size, so nothing
is shuffled and a lost task is packed again in the same way.

1. Route.  Context sizes are the window and its halves (1024, 512, 256, 128).  A document longer than the
   window is cut into full windows; it, or what remains of it, goes to the tier of the smallest
   context size that holds it.
2. Pack.  Tiers are packed from the longest on, each into windows of its own context size: the
   longest waiting piece of the tier opens a window.
3. Fill.  The gap is closed by waiting pieces, all from shorter tiers unless the tier is the shortest:
   by one or two pieces that fit exactly, else by the longest that fits, and so on.
4. Cut.  Only where no waiting piece fits is a piece cut to close the gap; the rest of it is
   routed again by its length.

So every window is full and has its context size.  What a task has left when less than a window of its
shortest tier waits closes in windows of smaller powers of two, so no window needs padding.  Windows of one
length are dealt into step groups whose cost (the sum of squared piece lengths, as in attention)
is balanced.  :func:`report` counts what was cut.

Ids are those of the byte-level BPE in ``vocabulary``.  They are computed from its rank file by a
compiled encoder which gives the same ids about five times faster than the JSON form; strings of the
JSON form's added tokens are taken out first and get their own ids, as there.

Defined results: a null or empty text is the end id alone, as one piece; repeated rows are packed
as separate documents; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
ROUND_TOKENS = 2_000_000  # tokens that a task holds at once, but for one longer document
GROUP = 8  # windows of a step group
TIERS = 4  # context sizes: the window and its halves
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, tier int, step_group long"
)


def added_tokens(json_file: str) -> dict[str, int]:
    """Strings of a tokenizer's JSON form that are tokens of their own, with their ids."""
    with open(json_file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=4)
def _ranks(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(rank_file: str, pattern: str, added: dict[str, int]) -> Callable[[str], list[int]]:
    """Text to ids.  The leftmost, then longest, string of ``added`` is a token; the texts between are encoded alone."""
    plain = _ranks(rank_file, pattern).encode_ordinary
    if not added:
        return plain
    split = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=lambda x: (-len(x), x))) + ")").split
    seldom = tuple(added)

    def encode(text: str) -> list[int]:
        if not any(x in text for x in seldom):
            return plain(text)
        return [i for part in split(text) if part for i in ([added[part]] if part in added else plain(part))]

    return encode


class Tiers:
    """Waiting pieces (document, start, length) by length, in tiers of context sizes."""

    def __init__(self, window: int, tiers: int):
        self.sizes = [window >> i for i in range(tiers) if window >> i]
        self.by_length: list[list] = [[] for _ in range(window + 1)]
        self.window, self.tokens = window, 0
        self.mask = self.back = 0  # bit n of mask, and bit window - n of back: pieces of length n wait

    def add(self, piece: tuple) -> None:
        n = piece[2]
        self.by_length[n].append(piece)
        self.mask |= 1 << n
        self.back |= 1 << (self.window - n)
        self.tokens += n

    def pop(self, n: int) -> tuple:
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask ^= 1 << n
            self.back ^= 1 << (self.window - n)
        self.tokens -= n
        return piece

    def longest(self, at_most: int) -> int:
        """Length of the longest waiting piece of at most ``at_most``; 0 without one."""
        return max(0, (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1)

    def exact(self, gap: int) -> list[int]:
        """Lengths of one or two waiting pieces that fill ``gap``."""
        if self.mask >> gap & 1:
            return [gap]
        pairs = self.mask & (self.back >> (self.window - gap)) & ~1
        n = pairs.bit_length() - 1
        if pairs and gap == 2 * n and len(self.by_length[n]) < 2:
            pairs ^= 1 << n
            n = pairs.bit_length() - 1
        return [n, gap - n] if pairs else []

    def close(self, gap: int) -> list[tuple]:
        """Pieces that fill ``gap``; as many tokens wait."""
        out = []
        while gap:
            fit = self.exact(gap) or [n for n in [self.longest(gap)] if n]
            if fit:
                pieces = [self.pop(n) for n in fit]
            else:  # nothing fits: cut the longest piece, so that few documents are cut
                doc, start, n = self.pop(self.longest(self.window))
                self.add((doc, start + gap, n - gap))
                pieces = [(doc, start, gap)]
            out += pieces
            gap -= sum(p[2] for p in pieces)
        return out

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Full windows of each context size, longest tier first; at the end also smaller powers of two."""
        for i, size in enumerate(self.sizes):
            below = self.sizes[i + 1] if i + 1 < len(self.sizes) else 0
            while self.tokens >= size and (n := self.longest(size)) > below:
                opened = self.pop(n)
                yield [opened, *self.close(size - n)]
        while last and self.tokens:
            yield self.close(min(self.window, 1 << (self.tokens.bit_length() - 1)))


def tier_of(length: int, window: int) -> int:
    """Context size that a piece is routed to: the smallest power of two that holds it, up to the window."""
    return min(window, 1 << (length - 1).bit_length())


def report(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """One row: documents, those longer than the window, those cut to close a gap, windows, tokens, padding."""
    least = F.ceil(F.max("doc_tokens") / window)
    docs = pieces.groupBy("sequence_id", "sequence_length").agg(F.sum("length").alias("held"))
    width = F.col("sequence_length")
    padded = F.when(width.bitwiseAND(width - 1) == 0, width).otherwise(window)
    windows = docs.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("held").alias("n_tokens"), F.sum(padded - F.col("held")).alias("padding"))
    # Pieces of a document with a repeated id add up to several times its tokens.
    cut = pieces.groupBy("doc_id", "doc_tokens").agg((F.sum("length") / F.max("doc_tokens")).alias("copies"), F.count(F.lit(1)).alias("n"), least.alias("least"))
    counts = cut.agg(
        F.sum("copies").cast("long").alias("n_docs"),
        F.sum(F.when(F.col("least") > 1, F.col("copies")).otherwise(0)).cast("long").alias("n_longer"),
        F.sum(F.least("copies", F.col("n") - F.col("least") * F.col("copies"))).cast("long").alias("n_cut"),
    )
    return counts.crossJoin(windows)


def pack(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    window: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    added: dict[str, int] | None = None,
    tiers: int = TIERS,
) -> DataFrame:
    """One row per piece: see SCHEMA.  ``window`` is a power of two.

    start and offset count ids in the document and in the window; ids_crc32 is that of the
    piece's ids as little-endian unsigned 32-bit numbers; doc_tokens counts the end id too; tier is the
    context size that the piece is routed to.  ``added`` are strings that are tokens of their own.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(rank_file, pattern, added or {})
        first = TaskContext.get().partitionId() << 33
        pool, ids, made, groups = Tiers(window, tiers), {}, 0, 0
        open_pieces: dict[int, int] = {}
        key = 0

        def rows(windows: list[list[tuple]]) -> pd.DataFrame:
            nonlocal made, groups
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(windows):
                by_length.setdefault(sum(p[2] for p in w), []).append(i)
            group = [0] * len(windows)
            for _, members in sorted(by_length.items()):
                members.sort(key=lambda i: (-sum(p[2] ** 2 for p in windows[i]), i))
                k = -(-len(members) // GROUP)
                for j, i in enumerate(members):  # to and fro, so that costs even out
                    turn, at = divmod(j, k)
                    group[i] = first + groups + (at if turn % 2 == 0 else k - 1 - at)
                groups += k
            out = []
            for i, w in enumerate(windows):
                total, offset = sum(p[2] for p in w), 0
                for doc, start, n in w:
                    doc_id, tokens = ids[doc]
                    crc = zlib.crc32(tokens[start : start + n].tobytes())
                    out.append((doc_id, start, n, crc, len(tokens), first + made + i, offset, total, tier_of(n, window), group[i]))
                    offset += n
                    open_pieces[doc] -= n
                    if not open_pieces[doc]:
                        del open_pieces[doc], ids[doc]
            made += len(windows)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        ready: list[list[tuple]] = []
        held = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["id"], pdf["text"]):
                tokens = np.array([*encode(text or ""), END_ID], dtype="<u4")
                ids[key] = (None if pd.isna(doc_id) else int(doc_id), tokens)
                open_pieces[key] = n = len(tokens)
                full = n - n % window
                ready += [[(key, s, window)] for s in range(0, full, window)]
                if n > full:
                    pool.add((key, full, n - full))
                key, held = key + 1, held + n
                if held >= ROUND_TOKENS:
                    yield rows(ready + list(pool.windows(False)))
                    ready, held = [], pool.tokens
        if open_pieces:
            yield rows(ready + list(pool.windows(True)))

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(task, SCHEMA)
