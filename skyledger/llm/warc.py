"""WARC archives with a two-level capture index.

Pages are written as gzip members, one per record, into archive files of the shared
folder. The index sorts captures by reversed-host URL key: each of its files holds
compressed blocks of index lines and, behind them, a sparse directory with the first
key and the place of every block. A look-up finds the file by the files' first keys,
the block by binary search in that file's directory, the line by binary search in the
block, and then reads just the bytes of the record.

Tasks write under names no other attempt uses; a file counts once its name stands in
the table the stage has written, so lost executors and repeated tasks leave only files
nobody reads. Files go through pyarrow's file systems, so the shared folder may be a
mount or a store.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, shared_dir

LEAST_PAYLOAD = 100  # bytes from which an equal payload is a revisit
BLOCK_LINES = 1024
READ_BYTES = 8 << 20  # of packed records that one task looks up, about
_LINE = "key string, page_id long, record_type string, file string, offset long, length long"
_PARTS = "first_key string, first_id long, file string, at long, length long, lines long, stored long"


def reversed_host_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL, without its fragment; '' of NULL, ')' and the text itself where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _record(url: str, page_id, kind: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Target-URI: " + "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or ""),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> dict:
    """The headers of a gzip member's record, its payload, and the payload's length as its HTTP headers say."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": fields, "payload": payload, "size": size}


def _page_of(name: str):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as archives under `folder`; a line per record: key, page_id, record_type, file, offset, length.

    Of equal payloads of at least LEAST_PAYLOAD bytes those of the smallest page_id are
    responses (several, if rows share that id), the others revisits. Rows with a NULL
    page_id are revisits of an equal page with one, responses if there is none.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumns(
        {"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256), "key": reversed_host_key(F.col("url"))}
    )
    firsts = rows.select("page_id", "size", "digest").filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest")
    firsts = firsts.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    # another form of the key than the grouping's, so that a payload many pages share can be split in the join
    firsts = firsts.select(F.struct("digest").alias("d"), "first_id")
    rows = rows.withColumn("d", F.struct("digest")).join(firsts, "d", "left").drop("d")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, out = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                lines = []
                for r in batch.itertuples(index=False):
                    refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    kind = "response" if refers is None else "revisit"
                    data = _record(r.url, page_id, kind, r.digest, r.size, refers, r.html.encode("utf-8", "surrogatepass"))
                    if out is None:
                        system, name = _file(path)
                        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(name, compression=None)
                    out.write(data)
                    lines.append((r.key, page_id, kind, path, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(lines, columns=["key", "page_id", "record_type", "file", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInPandas(write, _LINE))


def _sortable(page_id):
    return (0, 0) if page_id is None else (1, page_id)


def _pack(lines: list[tuple]) -> bytes:
    text = "\n".join("\t".join(["" if x is None else str(x) for x in (re.sub(r"[%\t\n\r]", lambda m: f"%{ord(m[0]):02X}", r[0]), *r[1:])]) for r in lines)
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list[tuple]:
    out = []
    for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"):
        key, page_id, *rest = line.split("\t")
        key = re.sub(r"%(25|09|0A|0D)", lambda m: chr(int(m[1], 16)), key)
        out.append((key, int(page_id) if page_id else None, *rest))
    return out


def build_index(lines: DataFrame, folder: str) -> list[tuple]:
    """Write the sorted index under `folder`; a row per index file (first_key, first_id, file, place and length of its directory, lines, bytes of their records), in key order.

    The rows are as many as sorted partitions, and are all the driver holds.
    """
    order = ["key", "page_id", "file", "offset"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, total, stored, directory, held, out = f"{folder}/index-{uuid.uuid4().hex}", 0, 0, 0, [], [], None

        def flush(block: list[tuple]) -> None:
            nonlocal at, out
            if out is None:
                system, name = _file(path)
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(name, compression=None)
            data = _pack(block)
            out.write(data)
            directory.append((block[0][0], block[0][1], at, len(data)))
            at += len(data)

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["page_id"]]
            held += zip(batch["key"], ids, batch["record_type"], batch["file"], batch["offset"].tolist(), batch["length"].tolist())
            total += len(batch)
            stored += int(batch["length"].sum())
            while len(held) >= BLOCK_LINES:
                flush(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            flush(held)
        if out is not None:
            data = _pack(directory)
            out.write(data)
            out.close()
            yield pd.DataFrame([(*directory[0][:2], path, at, len(data), total, stored)], columns=["first_key", "first_id", "file", "at", "length", "lines", "stored"]).astype({"first_id": "Int64"})

    parts = cut(ordered.mapInPandas(write, _PARTS)).collect()
    return sorted([tuple(p) for p in parts], key=lambda p: (p[0].encode("utf-8", "surrogatepass"), _sortable(p[1])))


class Reader:
    """Look-ups in one task; files, directories and blocks just used stay at hand."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts
        self.firsts = [self._order(p[0], p[1]) for p in parts]
        self.open: OrderedDict[str, object] = OrderedDict()
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    @staticmethod
    def _order(key: str, page_id) -> tuple:
        return key.encode("utf-8", "surrogatepass"), _sortable(page_id)  # as Spark sorts text

    def read(self, path: str, at: int, length: int) -> bytes:
        handle = self.open.pop(path, None)
        if handle is None:
            system, name = _file(path)
            handle = system.open_input_file(name)
            if len(self.open) >= 64:
                self.open.popitem(last=False)[1].close()
        self.open[path] = handle
        return handle.read_at(length, at)

    def _lines(self, path: str, at: int, length: int) -> tuple[list, list]:
        got = self.kept.pop((path, at), None)
        if got is None:
            lines = _unpack(self.read(path, at, length))
            got = [self._order(r[0], r[1]) for r in lines], lines
            if len(self.kept) >= 8:
                self.kept.popitem(last=False)
        self.kept[path, at] = got
        return got

    def find(self, key: str, page_id) -> list[tuple]:
        """All index lines of a key and page."""
        want, out = self._order(key, page_id), []
        # lines that are equal may run over blocks and files: start before the first that could hold one
        for p in range(max(0, bisect.bisect_left(self.firsts, want) - 1), len(self.parts)):
            if self.firsts[p] > want:
                break
            firsts, directory = self._lines(*self.parts[p][2:5])
            for d in range(max(0, bisect.bisect_left(firsts, want) - 1), len(directory)):
                if firsts[d] > want:
                    break
                keys, lines = self._lines(self.parts[p][2], int(directory[d][2]), int(directory[d][3]))
                out += lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]
        return out


def look_up(captures: DataFrame, parts: list[tuple]) -> DataFrame:
    """Records of (key, page_id) pairs, through the index: page_id, record_type, payload, payload_bytes, payload_digest, refers_to.

    A pair given several times is looked up once; a pair of several records gives them all.
    """
    shared = captures.sparkSession.sparkContext.broadcast(parts)  # one row per index file
    asked = captures.select("key", "page_id").distinct()
    # keys are small beside the records they lead to, so the tasks are numbered by those
    tasks = max(1, -(-sum(p[6] for p in parts) // READ_BYTES))
    asked = asked.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for batch in batches:
            out = []
            for key, page_id in zip(batch["key"], batch["page_id"]):
                for line in reader.find(key, None if pd.isna(page_id) else int(page_id)):
                    record = parse_record(reader.read(line[3], int(line[4]), int(line[5])))
                    fields = record["headers"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(record["payload"]).hexdigest() != digest:
                        raise ValueError(f"damaged record at {line[3]}, {line[4]}")
                    refers = _page_of(fields.get("WARC-Refers-To"))
                    out.append((_page_of(fields["WARC-Record-ID"]), kind, record["payload"], record["size"], digest, refers))
            columns = ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return asked.mapInPandas(read, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def capture_rows(pages: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives through their index.

    NULL html is an empty payload, a NULL url has the empty key. Repeated rows are records
    of their own. Other columns play no part; an empty table gives an empty result.
    """
    folder = f"{shared_dir(pages.sparkSession)}/llm-warc-{uuid.uuid4().hex}"
    parts = build_index(write_archives(pages, folder), folder)
    captures = pages.select(reversed_host_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    found = look_up(captures, parts)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Plain SQL for the same rows.
CAPTURE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
