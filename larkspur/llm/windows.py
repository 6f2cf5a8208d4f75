"""Chunks of texts, and which names of their windows other chunks hold too.

A chunk is one row: the units (words or bytes) of many documents, or a piece of a very long one,
and a mask of the window starts that are still candidates.  One pass of an operator names all
candidate windows and asks which names occur again:

1. each chunk deals its distinct names into buckets by their leading bits, sorts each bucket by
   the bits that follow, and sends it as one packed blob;
2. a bucket marks the names that two chunks hold, as one bit per name and chunk;
3. each chunk reads its bits and says which candidates go on to the next pass.

Every candidate of every document takes part.  A name that a third of all rows hold comes once
from each chunk, so a bucket grows with its share of the names and with the number of chunks, never with
the square of a group.  A pass is dealt in slices of the buckets where the names of all buckets would
take more disk than the texts do.  ``CHUNK`` and ``BUCKET`` may be raised with the memory of the
executors; a blob holds about CHUNK * BUCKET / (all candidates) names.

A filter pass compares 32 bits beside those of the bucket, so that about one candidate in 250 stays by
chance until a later pass; the last pass compares 64 bits beside those of the bucket (70 bits and
more, growing with the number of buckets).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.hashing import FIRST, SECOND, Polynomial, byte_units, hash_words, mix
from larkspur.llm.storage import delete, discard, materialize, new_path, release
from larkspur.llm.texts import NO_ID

CHUNK = 4 << 20  # bytes of text in a chunk, but for one word
BUCKET = 16 << 20  # names in a bucket, about
BLOCK = 1 << 16  # starts that are hashed at once
_U = np.uint64
TABLE = "chunk long, rows array<long>, ids array<long>, at array<long>, own array<int>, sizes array<int>, whole array<boolean>, bytes long, data binary, alive binary, n_alive long"
COLUMNS = [c.split()[0] for c in TABLE.split(", ")]
STATE = "chunk long, alive binary, n_alive long"


class Words:
    """Units are words; texts come back as words joined by one space."""

    @staticmethod
    def cut(data: bytes) -> list[bytes]:
        return data.split()

    join = staticmethod(b" ".join)
    units = staticmethod(hash_words)

    @staticmethod
    def step(words: list[bytes], size: int) -> int:
        """Units of a piece of about ``size`` bytes."""
        return size * len(words) // max(1, sum(map(len, words)) + len(words))

    @staticmethod
    def kept(words: list[bytes], gone: np.ndarray) -> bytes:
        return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


class Bytes:
    """Units are bytes."""

    cut = staticmethod(bytes)
    join = staticmethod(b"".join)
    units = staticmethod(lambda data: byte_units(np.frombuffer(data, np.uint8)))

    @staticmethod
    def step(data: bytes, size: int) -> int:
        return size

    @staticmethod
    def kept(data: bytes, gone: np.ndarray) -> bytes:
        return np.frombuffer(data, np.uint8)[~gone].tobytes()


class Method:
    """What an operator adds: the unit, the width, and candidates and names by pass."""

    unit: type
    width: int
    passes: int
    chunk = CHUNK
    by_id = False  # a window counts as found only where a document with a smaller id holds it

    def candidates(self, p: int, alive: np.ndarray | None, found: np.ndarray | None, starts: Callable[[int], np.ndarray], units: Callable[[], np.ndarray]) -> np.ndarray:
        """Mask of the starts that pass ``p`` looks at; the pass before looked at ``alive`` and found ``found`` again."""
        raise NotImplementedError

    def names(self, p: int, units: np.ndarray, at: np.ndarray, poly: Polynomial) -> np.ndarray:
        """64-bit names of the windows of pass ``p`` that start at the positions ``at``."""
        raise NotImplementedError


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers as their differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def stretches(units: np.ndarray, at: np.ndarray, cuts: tuple[int, ...], poly: Polynomial) -> np.ndarray:
    """Names of windows from the fingerprints of their stretches cuts[0]:cuts[1], cuts[1]:cuts[2] ..., in turn."""
    out = np.empty(len(at), _U)
    edges = np.searchsorted(at, np.arange(0, len(units) + BLOCK, BLOCK))
    for lo, a, b in zip(range(0, len(units), BLOCK), edges[:-1], edges[1:]):
        if a == b:
            continue
        prefix = poly.prefix(units[lo : lo + BLOCK + cuts[-1]])
        start = at[a:b] - lo
        dense = b - a == start[-1] - start[0] + 1
        first = int(start[0])
        name = np.zeros(b - a, _U)
        for x, y in zip(cuts[:-1], cuts[1:]):
            if dense:
                s, e = slice(first + x, first + x + b - a), slice(first + y, first + y + b - a)
            else:
                s, e = start + x, start + y
            name = name * _U(0x9E3779B97F4A7C15) + poly.window(prefix, s, e)
        out[a:b] = mix(name)
    return out


def fill(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: bool) -> np.ndarray:
    """Set the ranges lo:hi, both ascending, of ``mask``."""
    if len(lo):
        apart = np.flatnonzero(lo[1:] > hi[:-1])
        for a, b in zip(lo[np.append(0, apart + 1)].tolist(), hi[np.append(apart, len(hi) - 1)].tolist()):
            mask[a:b] = value
    return mask


def starts_in(sizes: np.ndarray, own: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of the starts of runs of ``length`` units that lie in a window of ``width`` units.

    Windows stay in their piece and start among the units that are its own.
    """
    ends = np.cumsum(sizes)
    first = ends - sizes
    last = np.minimum(first + own, ends - width + 1)
    some = last > first
    return fill(np.zeros(int(ends[-1]) if len(ends) else 0, bool), first[some], last[some] + width - length, True)


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` units the windows that begin at ``starts`` (ascending) cover."""
    return fill(np.zeros(n, bool), starts, starts + width, True)


class Chunks:
    """The stored texts, bucketed by chunk: a pass joins its masks and bits to them and never shuffles them."""

    def __init__(self, rows: DataFrame, label: str):
        self.spark = rows.sparkSession
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, f"{label}-chunks")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.sql(f"CREATE TABLE {self.name} ({TABLE}) USING parquet CLUSTERED BY (chunk) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        rows.repartition(buckets, "chunk").write.insertInto(self.name)

    def read(self, state: DataFrame | None, hits: DataFrame | None = None) -> DataFrame:
        """All chunks with the mask of ``state``, or their first one, and with the bits of ``hits``."""
        table = self.spark.table(self.name)
        if state is not None:
            table = table.drop("alive", "n_alive").join(state.hint("shuffle_hash"), "chunk", "left")
        return table if hits is None else table.join(hits.hint("shuffle_hash"), "chunk", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)


def chunks(docs: DataFrame, id_col: str, text_col: str, method: Method, label: str) -> Chunks:
    unit, width = method.unit, method.width

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 33
        chunk = row = held = 0
        parts: list[tuple] = []

        def flush() -> pd.DataFrame:
            rows, ids, at, own, seqs, whole = map(list, zip(*parts))
            sizes = np.array([len(s) for s in seqs], np.int32)
            data = unit.join(s if isinstance(s, bytes) else unit.join(s) for s in seqs if len(s))
            alive = method.candidates(0, None, None, lambda n: starts_in(sizes, np.array(own), width, n), lambda: unit.units(unit.cut(data)))
            return pd.DataFrame(
                [(task + chunk, rows, ids, at, own, sizes, whole, len(data), zstandard.compress(data, 1), packed(alive), int(alive.sum()))],
                columns=COLUMNS,
            )

        for pdf in batches:
            for id_, data in zip(pdf["id"], pdf["data"]):
                seq = unit.cut(data)
                step = max(width, unit.step(seq, method.chunk))
                for a in range(0, max(1, len(seq)), step):
                    rest = len(seq) - a
                    own = rest if rest < step + width else step
                    parts.append((task + row, id_, a, own, seq[a:] if own == rest else seq[a : a + step + width - 1], a == 0 and own == rest))
                    held += len(data) if own == rest and not a else method.chunk
                    if held >= method.chunk:
                        yield flush()
                        parts, held, chunk = [], 0, chunk + 1
                    if own == rest:
                        break
                row += 1
        if parts:
            yield flush()

    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    return Chunks(slim.mapInPandas(build, TABLE), label)


class Named:
    """The candidates of a chunk in the order of bucket and name, with the runs of equal names."""

    def __init__(self, method: Method, p: int, row, buckets: int):
        last = p == method.passes - 1
        self.sizes, self.own = np.asarray(row["sizes"], np.int64), np.asarray(row["own"], np.int64)
        self.n = int(self.sizes.sum())
        self.seq = method.unit.cut(zstandard.decompress(row["data"]))
        self.alive = unpacked(row["alive"], self.n)
        self.at = np.flatnonzero(self.alive)
        self.units = method.unit.units(self.seq)
        first = method.names(p, self.units, self.at, FIRST)
        self.bucket = ((first >> _U(32)) * _U(buckets)) >> _U(32)
        self.rest = method.names(p, self.units, self.at, SECOND) if last else first.astype(np.uint32)

    def sort(self, only: np.ndarray | None = None) -> None:
        """``only``: the candidates to take."""
        if only is not None:
            self.at, self.bucket, self.rest = self.at[only], self.bucket[only], self.rest[only]
        order = deal(self.bucket)
        self.at, self.bucket, self.rest = self.at[order], self.bucket[order], self.rest[order]
        new = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(order) else order
        for a, b in zip(new, np.append(new[1:], len(order))):  # a bucket's part of a chunk fits the cache
            inner = np.argsort(self.rest[a:b])
            self.at[a:b], self.rest[a:b] = self.at[a:b][inner], self.rest[a:b][inner]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.rest[1:] != self.rest[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.heads = np.flatnonzero(new)  # the first candidate of each distinct name
        self.run = np.cumsum(new) - 1

    def ids(self, row) -> np.ndarray:
        """The document id of each candidate."""
        piece = np.searchsorted(np.cumsum(self.sizes), self.at, side="right")
        return np.asarray(row["ids"], np.int64)[piece]


def deal(bucket: np.ndarray) -> np.ndarray:
    """The order of the buckets' numbers; numbers of 16 bits are dealt by two counting passes."""
    few = len(bucket) == 0 or int(bucket.max()) < 1 << 16
    return np.argsort(bucket.astype(np.uint16 if few else np.uint32), kind="stable")


def rows_of(pdf: pd.DataFrame) -> Iterator[dict]:
    names = list(pdf.columns)
    for values in zip(*(pdf[c] for c in names)):
        yield dict(zip(names, values))


def _send(table: DataFrame, method: Method, p: int, buckets: int, lo: int, hi: int) -> DataFrame:
    """(bucket, chunk, names, ids): a blob of distinct names for each bucket from lo to hi."""
    ask_ids = method.by_id and p == method.passes - 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in rows_of(pdf):
                c = Named(method, p, row, buckets)
                c.sort((c.bucket >= _U(lo)) & (c.bucket < _U(hi)) if (lo, hi) != (0, buckets) else None)
                rest, bucket = c.rest[c.heads], c.bucket[c.heads]
                least = np.minimum.reduceat(c.ids(row), c.heads) if ask_ids and len(c.heads) else None
                del c
                cuts = np.searchsorted(bucket, np.arange(lo, hi + 1, dtype=_U))
                out = []
                for k, a, b in zip(range(lo, hi), cuts[:-1], cuts[1:]):
                    if a < b:
                        out.append((k, row["chunk"], pack_sorted(rest[a:b]), zstandard.compress(least[a:b].tobytes(), 1) if ask_ids else None))
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "chunk", "names", "ids"])

    return table.select("chunk", "ids", "own", "sizes", "data", "alive").where("n_alive > 0").mapInPandas(send, "bucket long, chunk long, names binary, ids binary")


def _elsewhere(method: Method, p: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a bucket: (chunk, bucket, bits), a bit for each name that another chunk holds (under a smaller id)."""
    last = p == method.passes - 1
    kind = np.uint64 if last else np.uint32
    ask_ids = method.by_id and last

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        each = [unpack_sorted(x, kind) for x in pdf["names"]]
        every = np.concatenate(each)
        if ask_ids:
            ids = [np.frombuffer(zstandard.decompress(x), np.int64) for x in pdf["ids"]]
            order = np.argsort(every)
            every = every[order]
            heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            least = np.minimum.reduceat(np.concatenate(ids)[order], heads)
            several = np.diff(np.append(heads, len(every))) > 1
            twice, least = every[heads][several], least[several]
        else:
            every.sort()
            twice = every[1:][every[1:] == every[:-1]]
        for i, (chunk, bucket) in enumerate(zip(pdf["chunk"], pdf["bucket"])):
            if not len(twice):
                break
            place = np.minimum(np.searchsorted(twice, each[i]), len(twice) - 1)
            bits = twice[place] == each[i]
            if ask_ids:
                bits &= least[place] < ids[i]
            if bits.any():
                out.append((chunk, bucket, packed(bits)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])

    return meet


def _found(c: Named, row, method: Method, p: int) -> np.ndarray:
    """Mask of the chunk's candidates whose name occurs again; ``c`` is sorted."""
    mask = np.zeros(c.n, bool)
    if not len(c.at):
        return mask
    sure = np.zeros(len(c.heads), bool)
    bucket = c.bucket[c.heads]
    for hit in row["hits"] if row["hits"] is not None else ():
        a, b = np.searchsorted(bucket, np.array([hit["bucket"], hit["bucket"] + 1], _U))
        sure[a:b] = unpacked(hit["bits"], b - a)
    if method.by_id and p == method.passes - 1:
        ids = c.ids(row)
        mask[c.at] = sure[c.run] | (ids > np.minimum.reduceat(ids, c.heads)[c.run])
    else:
        sure |= np.diff(np.append(c.heads, len(c.at))) > 1
        mask[c.at] = sure[c.run]
    return mask


def run(docs: DataFrame, id_col: str, text_col: str, method: Method, label: str, finish: Callable[[dict, Named, np.ndarray], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """All passes; ``finish`` gives the rows of a chunk from the starts whose window occurs again."""
    spark = docs.sparkSession
    table, state, stored = chunks(docs, id_col, text_col, method, label), None, []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = table.read(None).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    for p in range(method.passes):
        last = p == method.passes - 1
        n = (table.read(None) if state is None else state).agg(F.coalesce(F.sum("n_alive"), F.lit(0))).first()[0]
        slices = max(1, -(-n * ((16 if method.by_id else 8) if last else 4) // max(1, texts)))
        buckets = max(slices * tasks, -(-n // BUCKET))
        cuts = [buckets * k // slices for k in range(slices + 1)]
        hits = None
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            sent = _send(table.read(state), method, p, buckets, lo, hi)
            some = materialize(sent.groupBy("bucket").applyInPandas(_elsewhere(method, p), "chunk long, bucket long, bits binary"), f"{label}-hits")
            stored.append(some)
            hits = some if hits is None else hits.unionByName(some)
            release(spark)
        told = table.read(state, hits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("hits")))

        def absorb(batches: Iterator[pd.DataFrame], p: int = p, buckets: int = buckets) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in rows_of(pdf):
                    c = Named(method, p, row, buckets)
                    c.sort()
                    found = _found(c, row, method, p)
                    alive = method.candidates(p + 1, c.alive, found, lambda n: starts_in(c.sizes, c.own, method.width, n), lambda: c.units)
                    yield pd.DataFrame({"chunk": [row["chunk"]], "alive": [packed(alive)], "n_alive": [int(alive.sum())]})

        def end(batches: Iterator[pd.DataFrame], p: int = p, buckets: int = buckets) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in rows_of(pdf):
                    c = Named(method, p, row, buckets)
                    c.sort()
                    yield pd.DataFrame(finish(row, c, _found(c, row, method, p)), columns=columns)

        if last:
            out = materialize(told.drop("bytes", "n_alive").mapInPandas(end, schema), f"{label}-parts")
        else:
            out = materialize(told.select("chunk", "ids", "own", "sizes", "data", "alive", "hits").mapInPandas(absorb, STATE), f"{label}-state")
        for old in stored:
            discard(old)
        state, stored = out, [out]
        release(spark)
    table.drop()
    return out


PART = "row long, id long, at long, n long, n_gone long, spans long, kept {kind}, data binary, gone binary"
PART_COLUMNS = ["row", "id", "at", "n", "n_gone", "spans", "kept", "data", "gone"]


def remove(docs: DataFrame, id_col: str, text_col: str, method: Method, label: str, show: Callable[[bytes], object], kind: str) -> DataFrame:
    """Per document: id, n (units), n_gone, spans (maximal removed runs) and ``show`` of the units kept.

    Documents in one piece are finished where their chunk is; pieces of a longer one meet first.
    """
    schema = PART.format(kind=kind)

    def spans(gone: np.ndarray) -> int:
        return int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())

    def finish(row: dict, c: Named, found: np.ndarray) -> list[tuple]:
        gone = covered(np.flatnonzero(found), c.n, method.width)
        out, a = [], 0
        for name, id_, at, own, size, whole in zip(*(row[k] for k in ("rows", "ids", "at", "own", "sizes", "whole"))):
            part, mask = c.seq[a : a + size], gone[a : a + size]
            if whole:
                n = int(mask.sum())
                data = method.unit.kept(part, mask) if n else part if isinstance(part, bytes) else method.unit.join(part)
                out.append((name, id_, 0, size, n, spans(mask) if n else 0, show(data), None, None))
            else:
                data = part[:own]
                out.append((name, id_, at, own, 0, 0, None, data if isinstance(data, bytes) else method.unit.join(data), packed(mask)))
            a += size
        return out

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        seq = method.unit.cut(method.unit.join(pdf["data"]))
        gone = np.zeros(len(seq) + method.width, bool)
        for at, n, bits in zip(pdf["at"], pdf["n"], pdf["gone"]):
            size = min(n + method.width - 1, len(seq) - at)
            gone[at : at + size] |= unpacked(bits, size)
        gone = gone[: len(seq)]
        first = pdf.iloc[0]
        return pd.DataFrame(
            [(first["row"], first["id"], 0, len(seq), int(gone.sum()), spans(gone), show(method.unit.kept(seq, gone)), None, None)], columns=PART_COLUMNS
        )

    parts = run(docs, id_col, text_col, method, label, finish, PART_COLUMNS, schema)
    long_ones = parts.where("data is not null").groupBy("row").applyInPandas(whole, schema)
    out = parts.where("data is null").unionByName(long_ones)
    return out.withColumn("id", F.nullif(F.col("id"), F.lit(NO_ID)))
