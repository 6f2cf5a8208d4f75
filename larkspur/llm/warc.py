"""WARC archives: write, normalise a monolithic gzip into one member per record, read by offset.

Pages become response and revisit records.  A task writes its pages as one archive whose gzip
stream holds all records (the monolithic form).  The normaliser inflates such a file once, as a
stream, rewrites every record as a gzip member of its own, and writes a sidecar index of one JSON
line per record with offset and length.  Records are then read by seeking.  No step holds more of
a file than one buffer; a record's block is never held as a whole by the normaliser and reader.

Files are written under a temporary name and renamed when complete, and a task repeats the same
names, so a lost executor leaves no half archive behind a name that is read.

Defined results: a null html is an empty payload; a null url is written as about:blank and comes back so;
payloads of under ``MIN_REVISIT`` bytes are
always responses; rows that repeat the largest page_id of a payload are all responses; a null
page_id is a revisit if another page has the payload and else a response; a table without pages
gives no archives and no records; other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.storage import materialize, new_path

MIN_REVISIT = 1000
LEVEL = 1
BUFFER = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS


def _filesystem(uri: str):
    """A filesystem that executors can use, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Target:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str | None) -> str:
    """A header value: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "about:blank")


def _name(page_id) -> str:
    return f"<urn:page:{'none' if pd.isna(page_id) else int(page_id)}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found.group(1)) if found else None


def record(page_id, url: str | None, payload: bytes, digest: str, length: int, refers_to) -> Iterator[bytes]:
    """The bytes of a record.  A revisit keeps the HTTP head, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = not pd.isna(refers_to)
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    yield body
    yield b"\r\n\r\n"


class _Inflater:
    """Plain bytes of a gzip stream of one or many members, read piece by piece."""

    def __init__(self, stream):
        self.stream, self.engine, self.held, self.ended = stream, zlib.decompressobj(GZIP), b"", False

    def _more(self) -> bool:
        while not self.ended:
            data = self.engine.unconsumed_tail or (self.engine.unused_data if self.engine.eof else b"") or self.stream.read(BUFFER)
            if self.engine.eof:
                if not data:
                    break
                self.engine = zlib.decompressobj(GZIP)
            elif not data:
                raise EOFError("gzip stream ends inside a member")
            out = self.engine.decompress(bytes(data), BUFFER)
            if out:
                self.held += out
                return True
        self.ended = True
        return False

    def line(self) -> bytes:
        """Up to and with the next line feed; what is left at the end of the stream."""
        while b"\n" not in self.held:
            if not self._more():
                break
        out, sep, self.held = self.held.partition(b"\n")
        return out + sep

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise EOFError("record ends early")
            piece, self.held = self.held[:size], self.held[size:]
            size -= len(piece)
            yield piece


def records(plain: _Inflater) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(head, fields, block) of each record; the block has to be read before the next record."""
    while True:
        first = plain.line()
        while first in (b"\r\n", b"\n"):
            first = plain.line()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head, fields = [first], {}
        while (line := plain.line()).strip():
            head.append(line)
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield b"".join(head) + b"\r\n", fields, plain.take(int(fields["content-length"]))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to monolithic archives in ``folder``; returns their (path, records)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    slim = materialize(rows.select("page_id", "digest", "size"), "warc-digests")
    large = slim.where(F.col("size") >= MIN_REVISIT)
    last = large.groupBy("digest", "size").agg(F.max("page_id").alias("last"))
    # A row per page and payload, so the join with the pages below deals hot payloads out evenly.
    revisits = large.join(last, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
    revisits = materialize(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("last").alias("refers_to")), "warc-revisits")
    on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    routed = rows.join(revisits, on, "left").select("page_id", "url", "payload", "digest", "size", "refers_to").sortWithinPartitions("page_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        uri, count, target = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if target is None:
                    target, gzip = _Target(uri), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                for piece in record(r.page_id, r.url, r.payload, r.digest, r.size, r.refers_to):
                    target.write(gzip.compress(piece))
                count += 1
        if target is not None:
            target.write(gzip.flush())
            target.done()
            yield pd.DataFrame({"path": [uri], "records": [count]})

    return materialize(routed.mapInPandas(write, "path string, records long"), "warc-archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in column ``path`` into ``folder``.

    Each record becomes a gzip member; ``<archive>.idx`` gets a JSON line per record.  Returns the
    index: path, offset, length, record_id, record_type.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source in pdf["path"]:
                fs, path = _filesystem(source)
                target = f"{folder}/{path.rpartition('/')[2]}"
                out, side, offset, index = _Target(target), _Target(target + ".idx"), 0, []
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, fields, block in records(_Inflater(stream)):
                        gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        length = out.write(gzip.compress(head))
                        for piece in block:
                            length += out.write(gzip.compress(piece))
                        length += out.write(gzip.compress(b"\r\n\r\n") + gzip.flush())
                        row = {"path": target, "offset": offset, "length": length, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"]}
                        side.write(json.dumps(row).encode() + b"\n")
                        index.append(row)
                        offset += length
                        if len(index) >= 10_000:
                            yield pd.DataFrame(index)
                            index = []
                out.done()
                side.done()
                if index:
                    yield pd.DataFrame(index)

    schema = "path string, offset long, length long, record_id string, record_type string"
    tasks = max(1, archives.count())
    return materialize(archives.select("path").repartition(tasks).mapInPandas(rewrite, schema), "warc-index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of ``folder``."""
    return spark.read.schema("path string, offset long, length long, record_id string, record_type string").json(f"{folder}/*.idx")


def read_records(index: DataFrame) -> DataFrame:
    """Per record of the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload that is read, and have to match its
    head; those of a revisit are what its head says.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.path != name:
                    fs, path = _filesystem(r.path)
                    name, file = r.path, fs.open_input_file(path)
                file.seek(r.offset)
                for _, fields, block in records(_Inflater(_Slice(file, r.length))):
                    rows.append(_parsed(fields, block))
            yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype(
                {"page_id": "Int64", "refers_to": "Int64"}
            )

    return index.select("path", "offset", "length").mapInPandas(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


class _Slice:
    def __init__(self, file, length: int):
        self.file, self.left = file, length

    def read(self, size: int) -> bytes:
        data = self.file.read(min(size, self.left))
        self.left -= len(data)
        return data


def _parsed(fields: dict[str, str], block: Iterator[bytes]) -> tuple:
    head, rest = b"", b""
    for piece in block:
        head += piece
        if b"\r\n\r\n" in head:
            head, _, rest = head.partition(b"\r\n\r\n")
            break
    said = re.search(rb"(?i)\r\nContent-Length: (\d+)", head)
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    length = int(said.group(1))
    if fields["warc-type"] == "response":
        seen, size = hashlib.sha1(rest), len(rest)
        for piece in block:
            seen.update(piece)
            size += len(piece)
        if (seen.hexdigest(), size) != (digest, length):
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its head")
    page, refers = _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))
    return page, fields.get("warc-target-uri"), length, digest, fields["warc-type"], refers


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages``, normalise the archives and read every record back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    archives = write_archives(pages, f"{folder}/monolithic")
    return read_records(normalise(archives, f"{folder}/records"))
