"""SentencePiece encoding and decoding by a streaming Viterbi search.

Every position of the text that a piece ends at keeps one backpointer: the last piece of the best
path there.  For a BPE model the best path is the one that merging would make, and a path is that one
exactly when each two neighbouring pieces are what merging makes of their joined text; so a
piece survives at a position if it fits the piece before it.  Only positions within the longest
piece's length ahead can be ends of open paths, so a ring of that many ends is all that the search
holds; texts are read on without looking back.  When the paths of all ends of the ring go through one
boundary, the ids before it are committed and forgotten.  Where no piece can span a boundary (before a
word mark that follows other text) paths always converge, so the ids of short runs between such
boundaries are remembered.

Ids equal those of the library for BPE models with byte fallback and without other normalisation
than the word marks; other models are refused.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded one by one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 400_000  # runs and pairs that a codec keeps at most
SHORT = 48  # longer runs are not remembered


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.byte = {}
        self.ids, self.score = {}, {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        if len(self.byte) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a BPE model with byte fallback and leading word marks only is needed")
        probe = " AÅ  b\tﬁ①"
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("models that normalise text are not supported")
        self.longest = max(map(len, self.ids))
        alone = "\n" if not any("\n" in p for p in self.ids) else ""
        self.runs = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else "")).finditer
        self.remembered: dict[str, list[int]] = {}
        self.fitting: dict[int, bool] = {}
        if not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("every sign of a piece has to be a piece")
        # A tree of the pieces that merging can make: sign -> (id or -1, tree of what may follow).
        self.tree: dict = {}
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if self.merged(piece) == [piece]:
                here = self.tree
                for sign in piece[:-1]:
                    here = here.setdefault(sign, (-1, {}))[1]
                here[piece[-1]] = (i, here[piece[-1]][1] if piece[-1] in here else {})
        shown = [p.replace(MARK, " ").encode() for p in self.text]
        for value, i in self.byte.items():
            shown[i] = bytes([value])
        self.shown = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else s for i, s in enumerate(shown)]

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best joined neighbours first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves two pieces as they are when they meet."""
        one, two = self.text[before], self.text[piece]
        if len(self.fitting) >= REMEMBERED:
            self.fitting.clear()
        known = self.fitting[before << 16 | piece] = self.merged(one + two) == [one, two]
        return known

    def search(self, run: str) -> Iterator[int]:
        """The ids of the pieces of ``run``, committed as soon as all surviving paths agree on them.

        Signs without a piece come as -1 - code point.  An end is (piece, end before, position): ends that
        no open path goes through are let go of, and :meth:`_agreed` cuts what is committed.
        """
        size, tree, fitting, fits, longest = len(run), self.tree, self.fitting, self.fits, self.longest
        room = longest + 1
        ring: list = [None] * room
        here = [None, None, 0]  # the end that the search stands on
        root, seen = here, longest
        for at in range(size):
            if at:
                slot = at % room
                # Without a piece that ends here, the sign before is one of its own.
                here = ring[slot] or [-1 - ord(run[at - 1]), here, at]
                ring[slot] = None
            before = here[0]
            end, follow = at, tree
            pair = -1 if before is None or before < 0 else before << 16
            while end < size:
                step = follow.get(run[end])
                if step is None:
                    break
                piece, follow = step
                end += 1
                if piece >= 0 and ring[end % room] is None:
                    if pair < 0:
                        ring[end % room] = [piece, here, end]
                    else:
                        known = fitting.get(pair | piece)
                        if known or known is None and fits(before, piece):
                            ring[end % room] = [piece, here, end]
            if at >= seen:
                seen = at + longest
                agreed = self._agreed([here, *filter(None, ring)])
                yield from self._path(agreed, root)
                agreed[1], root = None, agreed
        if size:
            last = ring[size % room] or [-1 - ord(run[-1]), here, size]
            yield from self._path(last, root)

    def _agreed(self, ends: list[list]) -> list:
        """The last end that the paths to all ``ends`` go through."""
        open_ends = {e[2]: e for e in ends}
        while len(open_ends) > 1:
            before = open_ends.pop(max(open_ends))[1]
            open_ends[before[2]] = before
        return open_ends.popitem()[1]

    def _path(self, end: list, root: list) -> list[int]:
        out = []
        while end is not root:
            out.append(end[0])
            end = end[1]
        return out[::-1]

    def _ids(self, pieces: Iterator[int]) -> list[int]:
        out = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            else:
                out.extend(self.byte[b] for b in chr(-1 - p).encode())
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.remembered
        for found in self.runs(MARK + text.replace(" ", MARK)):
            run = found[0]
            ids = known.get(run)
            if ids is None:
                ids = self._ids(self.search(run))
                if len(run) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[run] = tuple(ids)  # the collector leaves tuples of numbers alone
            out += ids
        return out

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.shown.__getitem__, ids))
        return data.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: doc_id and ids (array of int); with ``digest`` their number, the CRC-32 of them
    as little-endian unsigned 32-bit numbers, and length and SHA-256 of the decoded text."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(model_file)
        for pdf in batches:
            out = []
            for id_, text in zip(pdf["id"], pdf["text"]):
                ids = tool.encode(text)
                if digest:
                    back = tool.decode(ids)
                    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
                    out.append((id_, len(ids), crc, len(back), hashlib.sha256(back.encode()).hexdigest(), back == text))
                else:
                    out.append((id_, ids))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_sha256 string, round_trip boolean" if digest else "doc_id long, ids array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInPandas(task, schema)


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids; null ids give an empty text."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(model_file)
        for pdf in batches:
            texts = [tool.decode(ids if ids is not None else ()) for ids in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["id"].astype("Int64"), "text": texts})

    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInPandas(task, "doc_id long, text string")
