"""Deterministic sharded WARC writer, and a reader.

Each page becomes one gzip member. Pages with equal payloads (of at least ``least`` bytes) are found by digest: the one
with the smallest page_id is a response, the others are revisits of it. Archives hold ascending ranges of page_id, cut where exact
byte counts say so: counts per bucket of ids, finer where a bucket is too large, and by payload digest within an id that is too
large by itself. So the cuts, and with them all bytes of all archives, follow from the rows and not from their layout. Within a range
rows are sorted, and a file is closed when the next member would pass ``roll`` compressed bytes. Dates, ids and headers depend on
the rows only; record ids are UUIDs of (page_id, payload digest, number among such rows), so no two are equal.

Tasks write under a temporary folder and names that hold their attempt. A second job renames the files of the successful attempts,
in parallel; the manifest, with each file's records and bytes, is written under a temporary name and renamed last. A root that has
a manifest is refused. Readers open only what the manifest lists and raise on a file that is cut, longer or has other records
than listed. Payload digests are computed anew from the bytes that are read.

Defined results: a null html is an empty payload, of any length otherwise; a null url has no target header, and any other comes back
as it was; rows that repeat a page_id each get a record, and those with the smallest page_id of their payload are all responses; a null
page_id is a response that nothing refers to; an empty table gives a manifest without files; other columns, whatever their names, are
ignored. Rows equal in page_id and payload go to one task, which streams them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, looked_up, released, scratch, stored, table

DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes after which a file is closed.
ROLL = 1 << 30
#: Buckets of ids that are counted at a time.
BUCKETS = 4096
_MEMBERS = "part int, page_id long, url string, digest string, size long, refers_to long, member binary"
_FILES = "temp string, part int, number int, records long, bytes long"
_LISTED = "name string, records long, bytes long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_UNFIT = re.compile("[\x00-\x20\x7f]")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{number}')}>"


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None = None, number: int = 0) -> bytes:
    """One WARC/1.1 record; without a payload, a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    odd = url is not None and (not url or _UNFIT.search(url))
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, number)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~' + chr(39)) if odd else url}"] if url is not None else []),
        *([f"Page-URL: {json.dumps(url)}"] if odd else []), *([f"Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if payload is None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def about(part: int, number: int) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: lattis\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'file/{part}/{number}')}>", f"WARC-Date: {DATE}", f"WARC-Filename: {_name(part, number)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(part: int, number: int) -> str:
    return f"archive-{part:06d}-{number:04d}.warc.gz"


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in kind.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True) if rows else ([],) * len(kinds), kinds, strict=True)], list(names))


def _members(deal: Dealer):
    """Response members; the first of equal (page_id, payload) rows has number 0, others get theirs from the writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, u, h in zip(*(b.column(c) for c in ("page_id", "url", "html")), strict=True):
                p, u, payload = p.as_py(), u.as_py(), (h.as_py() or "").encode()
                digest = base32_sha1(payload)
                rows.append((deal(p, base64.b32decode(digest).hex()), p, u, digest, len(payload), None, member(record(p, u, digest, len(payload), payload))))
                if len(rows) == 256:
                    yield _batch(rows, _MEMBERS)
                    rows = []
            yield _batch(rows, _MEMBERS)

    return run


def _revisits(deal: Dealer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield _batch([(deal(r["page_id"], r["digest"]), r["page_id"], None, base64.b32encode(bytes.fromhex(r["digest"])).decode(), 0, r["first"], None) for r in rows], _MEMBERS)

    return run


def _writer(at: str, roll: int):
    """Rows of one range, sorted by page_id, digest and (first) refers_to: a row without a member says that those after it with its
    page_id and digest are revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs.FileSystem.from_uri(at)
        attempt = TaskContext.get().taskAttemptId()
        done, out, size, n, part = [], None, 0, 0, None
        last, to, number = None, None, 0
        for b in batches:
            for part, p, u, d, length, refers, m in zip(*(b.column(c) for c in ("part", "page_id", "url", "digest", "size", "refers_to", "member")), strict=True):
                part, key, m = part.as_py(), (p.as_py(), d.as_py()), m.as_py()
                if key != last:
                    last, to, number = key, None, 0
                if m is None:
                    to = refers.as_py()
                    continue
                if to is not None:
                    m = member(record(*key[:1], u.as_py(), key[1], length.as_py(), None, to, number))
                elif number:
                    whole = zlib.decompress(m, 31)
                    payload = whole[len(whole) - 4 - length.as_py() : -4]
                    m = member(record(key[0], u.as_py(), key[1], len(payload), payload, None, number))
                number += 1
                if out is not None and size + len(m) > roll:
                    out.close()
                    done.append((size, n))
                    out = None
                if out is None:
                    out, size, n = fs.open_output_stream(f"{base}/{part}-{attempt}-{len(done)}"), 0, 0
                    size += out.write(member(about(part, len(done))))
                out.write(m)
                size, n = size + len(m), n + 1
        if out is not None:
            out.close()
            done.append((size, n))
        yield _batch([(f"{part}-{attempt}-{k}", part, k, rows, size) for k, (size, rows) in enumerate(done)], _FILES)

    return run


def _mover(source: str, root: str):
    """Renames files; one that an earlier attempt has renamed is left as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs.FileSystem.from_uri(root)
        _, old = arrow_fs.FileSystem.from_uri(source)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                name = _name(r["part"], r["number"])
                if fs.get_file_info(f"{old}/{r['temp']}").type != arrow_fs.FileType.NotFound:
                    fs.move(f"{old}/{r['temp']}", f"{base}/{name}")
                info = fs.get_file_info(f"{base}/{name}")
                if info.type != arrow_fs.FileType.File or info.size != r["bytes"]:
                    raise OSError(f"{name} wasn't renamed")
                rows.append((name, r["records"], r["bytes"]))
            yield _batch(rows, _LISTED)

    return run


def part_bytes(total: int) -> int:
    """Payload bytes of one range, from those of all: many ranges for a small table, about 4 GB each for a large one."""
    return min(4 << 30, max(16 << 20, total // 1024))


def ranges(narrow: DataFrame, total: int) -> list[tuple[int, int]]:
    """Where each range starts, in order: (page_id, first 16 bits of the digest). Buckets of ids are counted, and those that are too
    large are cut again; the driver gets at most BUCKETS rows for the table and for each bucket over a range's size."""
    most = part_bytes(total)
    lo, hi = narrow.agg(F.min("page_id"), F.max("page_id")).first()
    leaves, open_ = [], [(lo, hi)] if lo is not None else []
    while open_:
        found = []
        for lo, hi in open_:
            step = -(-(hi - lo + 1) // BUCKETS)
            k = F.expr(f"cast((cast(page_id as decimal(38, 0)) - {lo}BD) div {step}BD as bigint)").alias("k")
            mine = narrow.where(F.col("page_id").between(lo, hi)).groupBy(k).agg(F.sum("size").alias("n")).collect()
            found += [(lo + r.k * step, min(hi, lo + (r.k + 1) * step - 1), r.n) for r in mine]
        open_ = [(a, b) for a, b, n in found if n > most and a < b]
        leaves += [(a, b, n) for a, b, n in found if n <= most or a == b]
    sized = []
    for a, _, n in sorted(leaves):
        if n <= most:
            sized.append((a, 0, n))
        else:  # one page_id with too many rows: cut by digest
            k = F.expr("cast(conv(substr(digest, 1, 4), 16, 10) as int) div 16").alias("k")
            sized += sorted((a, 16 * r.k, r.n) for r in narrow.where(F.col("page_id") == a).groupBy(k).agg(F.sum("size").alias("n")).collect())
    starts, held = [], 0
    for a, d, n in sized:
        if not starts or held + n > most:
            starts.append((a, d))
            held = 0
        held += n
    return starts


class Dealer:
    """The range of a row. Rows without a page_id are dealt by digest to ``rest`` ranges behind the others."""

    def __init__(self, starts: list[tuple[int, int]], rest: int):
        self.starts, self.rest = starts, rest

    def __call__(self, page_id: int | None, sha1: str) -> int:
        at = int(sha1[:4], 16)
        return len(self.starts) + at * self.rest // 65536 if page_id is None else max(0, bisect_right(self.starts, (page_id, at)) - 1)


def write_archives(pages: DataFrame, root: str, roll: int = ROLL, least: int = 0) -> dict:
    """Writes page_id, url and html of pages under root; returns the manifest."""
    spark = pages.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    if fs.exists(path(f"{root}/manifest.json")):
        raise FileExistsError(f"{root} has archives already")
    html = F.expr("coalesce(cast(html as string), '')")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # duplicates are decided on narrow rows
    narrow = stored(rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").cast("long").alias("size")))
    count, total, loose = narrow.agg(F.count("*"), F.sum("size"), F.sum(F.expr("if(page_id is null, size, 0)"))).first()
    known, total = narrow.where("page_id is not null"), total or 0
    deal = Dealer(ranges(known, total), -(-(loose or 0) // part_bytes(total)) + 1)
    first = known.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("most"), F.count("*").alias("copies")).where("first < most").drop("most")
    dup = looked_up(known.select("page_id", "digest"), first, "digest", count, "inner").where("page_id > first").distinct()
    # one exchange of the members; which of them are revisits comes along as rows of its own
    made = rows.mapInArrow(_members(deal), _MEMBERS).union(dup.mapInArrow(_revisits(deal), _MEMBERS))
    order = ["page_id", "digest", F.col("refers_to").desc_nulls_last(), "url"]
    temp = f"{root}/_temporary-{uuid.uuid4().hex}"
    fs.mkdirs(path(temp))
    files = stored(made.repartitionById(len(deal.starts) + deal.rest, "part").sortWithinPartitions(*order).mapInArrow(_writer(temp, roll), _FILES))
    dropped(narrow)
    del made, dup, first, known
    released(spark)
    listed = files.repartition(max(1, min(1000, files.count()))).mapInArrow(_mover(temp, root), _LISTED)
    manifest = {"date": DATE, "files": [r.asDict() for r in sorted(listed.collect(), key=lambda r: r.name)]}  # a row a file of up to ``roll`` bytes
    fs.delete(path(temp), True)
    dropped(files)
    out = fs.create(path(f"{root}/.manifest.tmp"), True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(path(f"{root}/.manifest.tmp"), path(f"{root}/manifest.json")):
        raise OSError(f"the manifest of {root} wasn't renamed")
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.gz, one member in memory at a time."""
    rest, machine, data = b"", zlib.decompressobj(31), []
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            if data:
                raise EOFError("the archive ends within a record")
            return
        data.append(machine.decompress(chunk))
        rest = machine.unused_data
        if machine.eof:
            head, _, block = b"".join(data).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            if len(block) != int(headers["Content-Length"]) + 4:
                raise ValueError(f"{headers['WARC-Record-ID']} has another length than stated")
            yield headers, block[:-4]
            machine, data = zlib.decompressobj(31), []


def _reader(root: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs.FileSystem.from_uri(root)
        for b in batches:
            for listed in b.to_pylist():
                name, rows, n = listed["name"], [], 0
                if fs.get_file_info(f"{base}/{name}").size != listed["bytes"]:
                    raise ValueError(f"{name} has another size than the manifest lists")
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in records(f):
                        if base32_sha1(block) != head["WARC-Block-Digest"][5:]:
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']}")
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, revisit = int(http.decode().rpartition("Content-Length: ")[2]), head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"][5:] if revisit else base32_sha1(payload)
                        url, page, to = head.get("WARC-Target-URI"), head.get("Page-ID"), head.get("Refers-To-Page-ID")
                        rows.append((page and int(page), json.loads(head["Page-URL"]) if "Page-URL" in head else url, size, digest, head["WARC-Type"], to and int(to), payload.decode() if with_payload and not revisit else None))
                        n += 1
                        if len(rows) == 500:
                            yield _batch(rows, _READ)
                            rows = []
                if n != listed["records"]:
                    raise ValueError(f"{name} has {n} records, the manifest lists {listed['records']}")
                yield _batch(rows, _READ)

    return run


def read_archives(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives that the manifest lists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
    f = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    files = [(x["name"], x["records"], x["bytes"]) for x in json.loads(bytes(f.readAllBytes()).decode())["files"]]
    f.close()
    return spark.createDataFrame(files, _LISTED).repartition(max(1, len(files))).mapInArrow(_reader(root, with_payload), _READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
