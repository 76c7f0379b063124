"""Substring dedup by de Bruijn compaction over tokens.

1.  Edges. Every 13 consecutive words are one edge of a de Bruijn graph between the nodes of their first and last 12 words, kept as a
    64-bit hash with its source coordinates (doc_id, word). Edges are dealt by hash into buckets of bounded size, in hops of at
    most FAN ways, so the rows that are shuffled grow as the input does. A step of about 8 MB of text first settles repeats among
    its own documents, so a passage that is everywhere reaches a bucket once a step.
2.  Repeats. A bucket finds the smallest document of each edge; each edge of a larger document becomes a claim on that source. Claims
    that follow one another in both documents make one run.
3.  Compaction. The repeated edges, each once, are the runs' places in the sources. Their nodes' in- and out-degrees are counted over
    all sources; sources are cut into segments where a node branches, and where the only edge into a node and the only one out
    of it lie in different sources, their segments are joined. Pointer doubling finds each segment's path and its place there.
    A circle of segments without a branch falls apart into its segments.
4.  Verification. A document's runs become spans of paths: pieces that follow one another along a path are one span. The words of
    each path are read at its source coordinates, and a span counts only if its words are equal (128-bit digests). Documents
    with a span that isn't (a hash collision, or rows that share a doc_id) are done again run by run.

Each word that a verified span covers is removed: exactly the words of those 13-word windows that also start in a
document with a smaller doc_id.

Defined results: null or empty text has no words; under 13 words nothing is removed; texts of any length are read whole; rows with a
null doc_id keep all their words and are no source; rows that share a doc_id are one document and each get a row (their claims
go to one task, which sorts and spills); the smallest of equal sources is the first word of the smallest doc_id; repeats within one
document stay; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ids_and_text, raw, released, steps, stored, table, trimmed, windows, word_hashes, word_spans

WINDOW = 13
#: Bytes of text of one step, and about so many bytes of text of one bucket.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
#: Ways of one hop, edges that a further hop takes at a time, edges of a block of the range join, and of a path before it is cut.
FAN, HOP_EDGES, BLOCK, CHUNK = 512, 1 << 20, 256, 1 << 20
#: Links that one task of a round of pointer doubling writes.
LINKS = 1 << 18


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays of one length, as byte planes under zstd."""
    z = zstandard.ZstdCompressor(level=1)
    return z.compress(b"".join(np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, out, at = len(got) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        w = np.dtype(k).itemsize
        planes = got[at : at + n * w].reshape(w, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(k).ravel(), dtype=k))
        at += n * w
    return out


_ASKED = "id int, bucket long, hashes binary, at binary, settled binary"
_CLAIMS = "doc_id long, pos int, src long, at int, local boolean"


def _row(*values) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in _ASKED.split(", ")])


def _dealt(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, leads: np.ndarray, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Edges in groups of ``width`` buckets, packed; leads tells which have local claims on them."""
    group = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) // width
    # within a group in order of place, so that places pack well
    order = np.lexsort((pos, doc, group))
    h, doc, pos, leads, group = h[order], doc[order], pos[order], leads[order], group[order]
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(h)]
    for x, y in pairwise(cuts):
        if x < y:
            g = int(group[x])
            yield _row(g, g * width, h[x:y].tobytes(), _pack(doc[x:y], pos[x:y], leads[x:y]), None)


def _settled(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, window: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]] | None:
    """The edges of one step: hash, document, word and whether local claims are on them; and the local claims. Arrays go as soon as they
    aren't needed, since two of these steps share an executor."""
    starts, ends, bounds = word_spans(data, offs)
    if len(starts) < window:
        return None
    h = windows(word_hashes(data, starts, ends), window)
    del starts, ends
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
    inside = np.flatnonzero(row[window - 1 :] == row[: len(h)]).astype(np.int32)
    if not len(inside):
        return None
    h, row = h[inside], row[inside]
    pos = (inside - bounds[row]).astype(np.int32)
    del inside
    doc = ids[row]
    del row
    order = np.lexsort((pos, doc, h)).astype(np.int32)
    h, doc, pos = h[order], doc[order], pos[order]
    del order
    new = np.concatenate([[True], h[1:] != h[:-1]])
    lead = np.flatnonzero(new).astype(np.int32)[np.cumsum(new, dtype=np.int32) - 1]
    late = doc > doc[lead]  # repeats an earlier document of this step
    led = lead[late]
    del new, lead
    local = doc[late], pos[late], doc[led], pos[led]
    leads = np.zeros(len(h), np.int8)
    leads[led] = 1
    return tuple(x[~late] for x in (h, doc, pos, leads)), local


def _edges(buckets: int, width: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in steps(offs, BATCH_BYTES):
                if (found := _settled(data, offs[i : j + 1], ids[i:j], window)) is None:
                    continue
                edges, local = found
                if len(local[0]):
                    bucket = int(edges[0][0] % np.uint64(buckets))
                    yield _row(bucket // width, bucket, None, None, _pack(*local))
                dealt = _dealt(*edges, buckets, width)
                del found, edges, local
                yield from dealt
            trimmed()

    return run


def _unpacked(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    places = [_unpack(b, np.int64, np.int32, np.int8) for _, b in parts]
    return np.concatenate([np.frombuffer(a, np.uint64) for a, _ in parts]), *(np.concatenate(x) for x in zip(*places, strict=True))


def _again(buckets: int, width: int):
    """A further hop: the edges of one group, dealt into smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["settled"] is not None:
                    yield _row(r["bucket"] // width, r["bucket"], None, None, r["settled"])
                    continue
                parts.append((r["hashes"], r["at"]))
                n += len(r["hashes"]) // 8
                if n >= HOP_EDGES:
                    yield from _dealt(*_unpacked(parts), buckets, width)
                    parts, n = [], 0
        if parts:
            yield from _dealt(*_unpacked(parts), buckets, width)

    return run


def _claimed(local: bool, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = (*cols, np.full(len(cols[0]), local))
    names = [x.split()[0] for x in _CLAIMS.split(", ")]
    for a in range(0, len(cols[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in cols], names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: its edges that repeat one of a smaller document, with the source's coordinates; and those that have local claims on
    them, which are then claims on themselves if they are the source."""
    parts = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["settled"] is not None:
                yield from _claimed(True, *_unpack(r["settled"], np.int64, np.int32, np.int64, np.int32))
            else:
                parts.append((r["hashes"], r["at"]))
    if not parts:
        return
    h, doc, pos, leads = _unpacked(parts)
    del parts
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    multi = leads[order] > 0
    multi[1:] |= same
    multi[:-1] |= same
    order = order[multi]
    h, doc, pos, leads = h[order], doc[order], pos[order], leads[order]
    order = np.lexsort((pos, doc, h))
    h, doc, pos, leads = h[order], doc[order], pos[order], leads[order]
    if len(h):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.flatnonzero((doc > doc[lead]) | (leads > 0))
        late = late[np.lexsort((pos[late], doc[late]))]
        yield from _claimed(False, doc[late], pos[late], doc[lead[late]], pos[lead[late]])


def claims(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, pos, src, at, local): edges that repeat one of a smaller document, and its first place there. A local claim is on the
    smallest document of its step only; that place then has a claim of its own."""
    buckets = max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    widths = [1]
    while -(-buckets // widths[0]) > FAN:
        widths.insert(0, widths[0] * FAN)
    asked = docs.where("doc_id is not null").mapInArrow(_edges(buckets, widths[0], window), _ASKED).repartitionById(-(-buckets // widths[0]), "id")
    for w in widths[1:]:
        asked = asked.mapInArrow(_again(buckets, w), _ASKED).repartitionById(-(-buckets // w), "id")
    return asked.mapInArrow(_repeats, _CLAIMS)


def runs(claimed: DataFrame) -> DataFrame:
    """(doc_id, start, n, src, at): claims that follow one another in the document and in its source. Local claims are led on to the
    source of all."""
    order = "over (partition by doc_id order by pos, src, at"
    c = claimed.selectExpr("*", f"coalesce(lag(src) {order}) = src and lag(at) {order}) = at - 1 and lag(pos) {order}) = pos - 1 and lag(local) {order}) = local, false) as follows")
    c = c.selectExpr("*", f"sum(if(follows, 0, 1)) {order} rows between unbounded preceding and current row) as run")
    c = c.groupBy("doc_id", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"), F.min("src").alias("src"), F.min("at").alias("at"), F.min("local").alias("local"))
    c = stored(c.drop("run"))
    known, local = c.where("not local").drop("local"), c.where("local")
    a = local.selectExpr("*", f"explode(sequence(at div {BLOCK}, (at + n - 1) div {BLOCK})) as block")
    b = known.selectExpr("doc_id as k_id", "start as q", "start + n as end", "src as k_src", "at as k_at", f"explode(sequence(start div {BLOCK}, (start + n - 1) div {BLOCK})) as k_block")
    j = a.join(b, F.expr(f"src = k_id and block = k_block and at < end and q < at + n and greatest(at, q) div {BLOCK} = block"))
    led = j.selectExpr("doc_id", "start + greatest(at, q) - at as start", "least(at + n, end) - greatest(at, q) as n", "k_src as src", "k_at + greatest(at, q) - q as at")
    return known.where("src < doc_id").union(led)


def intervals(found: DataFrame) -> DataFrame:
    """(src, lo, hi): the repeated edges lo .. hi - 1 of each source, each edge once."""
    places = found.groupBy("src", "at").agg(F.max("n").alias("n"))
    order = "over (partition by src order by at rows between unbounded preceding and"
    e = places.selectExpr("src", "at", "at + n as end", f"max(at + n) {order} 1 preceding) as before")
    e = e.selectExpr("*", f"sum(if(at <= before, 0, 1)) {order} current row) as island")
    return e.groupBy("src", "island").agg(F.min("at").alias("lo"), F.max("end").alias("hi")).drop("island")


_NODES = "node long, src long, q int, into boolean, out boolean"


def _nodes(window: int):
    """The nodes of a source's repeated edges, with whether such an edge comes in and goes out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            data, offs = raw(batch.column("text"))
            for r, (src, parts) in enumerate(zip(batch.column("src").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                if src == last:  # of rows that share a doc_id, the first makes the graph; verification settles the others
                    continue
                last = src
                starts, ends, _ = word_spans(data, offs[r : r + 2])
                h = windows(word_hashes(data, starts, ends), window - 1).view(np.int64)
                q = [np.arange(p["lo"], min(p["hi"], len(h) - 1) + 1) for p in parts]
                at = np.concatenate(q)
                into, out = (np.concatenate([x != x[end] if len(x) else x > 0 for x in q]) for end in (0, -1))
                for a in range(0, len(at), 1 << 16):
                    k = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at[k]]), pa.array(np.full(len(at[k]), src)), pa.array(at[k].astype(np.int32)), pa.array(into[k]), pa.array(out[k])], [x.split()[0] for x in _NODES.split(", ")])

    return run


def segments(places: DataFrame, cuts: DataFrame) -> DataFrame:
    """(src, q, end): the intervals cut at branching nodes."""
    points = places.selectExpr("src", "lo as q", "hi").unionByName(cuts.selectExpr("src", "q", "cast(null as int) as hi"))
    order = "over (partition by src order by q"
    p = points.selectExpr("src", "q", f"last(hi, true) {order} rows between unbounded preceding and current row) as hi", f"lead(q) {order}) as following")
    return p.selectExpr("src", "q", "least(coalesce(following, hi), hi) as end")


def heads(links: DataFrame) -> DataFrame:
    """links (src, q, up_src, up_q, dist): segments and the one before each -> the first segment of the path and the edges up to here,
    by pointer doubling. Segments in a circle are left out."""
    p = stored(links.selectExpr("*", "true as open"))
    n = max(1, p.count())
    for _ in range(n.bit_length() + 1):
        up = p.selectExpr("src as up_src", "q as up_q", "up_src as far_src", "up_q as far_q", "dist as more")
        new = p.where("open").join(up, ["up_src", "up_q"], "left").selectExpr("src", "q", "coalesce(far_src, up_src) as up_src", "coalesce(far_q, up_q) as up_q", "dist + coalesce(more, 0) as dist", "far_src is not null as open")
        new = stored(new.unionByName(p.where("not open")).coalesce(-(-n // LINKS)))
        dropped(p)
        p = new
        if not p.where("open").take(1):
            break
    return p.where("not open").drop("open")


def paths(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The compacted graph of the runs found: (src, q, end, path, off), where edge q of document src is edge off of a path."""
    places = stored(intervals(found))
    own = places.groupBy("src").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))  # no more than a document's words
    nodes = docs.where("doc_id is not null").join(own.hint("merge"), F.col("doc_id") == F.col("src")).select("src", "text", "parts").mapInArrow(_nodes(window), _NODES)
    nodes = nodes.selectExpr("*", "sum(int(into)) over (partition by node) as ins", "sum(int(out)) over (partition by node) as outs")
    marks = stored(nodes.where("(into and out and (ins > 1 or outs > 1)) or (ins = 1 and outs = 1 and into <> out)"))
    segs = stored(segments(places, marks.where("into and out").select("src", "q")))
    ends = marks.where("into and not out").selectExpr("node", "src as t_src", "q as t_q")
    begins = marks.where("out and not into").selectExpr("node", "src", "q")
    links = begins.join(ends, "node").join(segs.selectExpr("src as up_src", "q as up_q", "end"), F.expr("t_src = up_src and t_q = end"))
    first = heads(links.selectExpr("src", "q", "up_src", "up_q", "bigint(end - up_q) as dist"))
    out = segs.join(first, ["src", "q"], "left").selectExpr("src", "q", "end", "coalesce(up_src, src) as p_src", "coalesce(up_q, q) as p_q", "coalesce(dist, 0) as off")
    out = stored(out.selectExpr("src", "q", "end", f"xxhash64(p_src, p_q, off div {CHUNK}) as path", "off"))
    for x in (places, marks, segs, first):
        dropped(x)
    return out


def pieces(found: DataFrame, compact: DataFrame) -> DataFrame:
    """(doc_id, start, n, path, off): each run's parts on the segments of its source, by a range join on blocks of edges."""
    a = found.selectExpr("*", f"explode(sequence(at div {BLOCK}, (at + n - 1) div {BLOCK})) as block")
    b = compact.selectExpr("src as s_src", "q", "end", "path", "off", f"explode(sequence(q div {BLOCK}, (end - 1) div {BLOCK})) as s_block")
    j = a.join(b, F.expr(f"src = s_src and block = s_block and at < end and q < at + n and greatest(at, q) div {BLOCK} = block"))
    return j.selectExpr("doc_id", "start + greatest(at, q) - at as start", "least(at + n, end) - greatest(at, q) as n", "path", "off + greatest(at, q) - q as off")


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest() if 0 <= start and start + n <= len(words) else bytes(16)


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_ENDS = f"{_KEPT}, spans array<struct<path: long, off: long, n: int, digest: binary>>, parts array<struct<path: long, off: long, words: binary>>"
_SPAN = pa.list_(pa.struct([("path", pa.int64()), ("off", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())]))
_PART = pa.list_(pa.struct([("path", pa.int64()), ("off", pa.int64()), ("words", pa.binary())]))


def spans(own: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, edges, path, off) of a document's pieces; those that follow one another along a path are one."""
    out: list[list[int]] = []
    for p in sorted(own, key=lambda p: (p["path"], p["off"] - p["start"], p["start"])):
        if out and out[-1][2] == p["path"] and out[-1][3] - out[-1][0] == p["off"] - p["start"] and out[-1][0] + out[-1][1] == p["start"]:
            out[-1][1] += p["n"]
        else:
            out.append([p["start"], p["n"], p["path"], p["off"]])
    return [tuple(x) for x in out]


def _ends(window: int, with_text: bool):
    """What is left of a document without its spans, the spans' digests, and the words of its own segments as parts of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*(pa.int64(),) * 3, pa.string(), pa.string(), _SPAN, _PART)
        names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans", "parts"]
        for batch in batches:
            data, offs = raw(batch.column("text"))
            rows, size = [], 0
            for r, (doc, own, mine) in enumerate(zip(*(batch.column(c) for c in ("doc_id", "own", "mine")), strict=True)):
                words = data[offs[r] : offs[r + 1]].tobytes().split()
                proofs, cover, left = [], np.zeros(len(words) + 1, np.int64), words
                for start, n, path, off in spans(own.as_py() or []):
                    proofs.append({"path": path, "off": off, "n": n, "digest": _digest(words, start, n + window - 1)})
                    if start + n + window - 1 <= len(words):
                        cover[start] += 1
                        cover[start + n + window - 1] -= 1
                if proofs:
                    left = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
                parts = [{"path": m["path"], "off": m["off"], "words": b" ".join(words[m["q"] : m["end"] + window - 1])} for m in mine.as_py() or []]
                kept = b" ".join(left)
                rows.append((doc.as_py(), len(words), len(words) - len(left), kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest(), proofs, parts))
                size += len(kept) if with_text else sum(len(p["words"]) for p in parts)
                if len(rows) >= 1000 or size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _verify(window: int):
    """Rows of a path, sorted: its parts (with words), then the spans asked for. Yields the spans whose words the path doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, words, first = None, [], 0
        for batch in batches:
            bad = []
            for i, r in enumerate(zip(*(batch.column(c) for c in ("path", "off", "n", "digest", "words")), strict=True)):
                p, off = r[0].as_py(), r[1].as_py()
                if p != path:
                    path, words, first = p, [], off
                if (own := r[4].as_py()) is not None:
                    own = own.split()
                    have = off - first  # a part begins with the node that the part before it ends with
                    if have + window - 1 == len(words) or not words:
                        words += own[window - 1 :] if words else own
                elif _digest(words, off - first, r[2].as_py() + window - 1) != r[3].as_py():
                    bad.append(i)
            yield batch.select(["path", "off", "n", "digest"]).take(pa.array(bad, pa.int64()))

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (if asked for) and kept_sha256."""
    docs = ids_and_text(docs, id_col, text_col)
    found = stored(runs(claims(docs, window)))
    released(docs.sparkSession)
    compact = paths(docs, found, window)
    released(docs.sparkSession)
    # one exchange of the texts: each document's pieces, and its own segments as a source
    own = pieces(found, compact).selectExpr("doc_id as key", "struct(start, n, path, off) as own", "cast(null as struct<q: int, end: int, path: bigint, off: bigint>) as mine")
    mine = compact.selectExpr("src as key", "cast(null as struct<start: int, n: int, path: bigint, off: bigint>) as own", "struct(q, end, path, off) as mine")
    asked = own.union(mine).groupBy("key").agg(F.collect_list("own").alias("own"), F.collect_list("mine").alias("mine"))  # no more than a document's words
    known = docs.where("doc_id is not null")
    ends = stored(known.join(asked, F.col("doc_id") == F.col("key"), "left").select("doc_id", "text", "own", "mine").mapInArrow(_ends(window, with_text), _ENDS))
    released(docs.sparkSession)
    words = ends.select(F.explode("parts").alias("p")).groupBy("p.path", "p.off").agg(F.min("p.words").alias("words"))
    wanted = ends.select(F.explode("spans").alias("s")).select("s.*").distinct()
    rows = words.selectExpr("path", "off", "0 as n", "cast(null as binary) as digest", "words").unionByName(wanted.selectExpr("*", "cast(null as binary) as words"))
    rows = rows.withColumn("asks", F.col("words").isNull()).repartition("path").sortWithinPartitions("path", "asks", "off")
    bad = stored(rows.drop("asks").mapInArrow(_verify(window), "path long, off long, n int, digest binary"))
    done = ends.select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")
    if bad.take(1):
        odd = stored(ends.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").join(bad, ["path", "off", "n", "digest"], "left_semi").select("doc_id").distinct())
        slow = run_by_run(known.join(odd, "doc_id", "left_semi"), found.join(odd, "doc_id", "left_semi"), known, window, with_text)
        done = done.join(odd, "doc_id", "left_anti").union(slow)
    dropped(compact)
    return done.union(docs.where("doc_id is null").mapInArrow(_remove(window, with_text), _KEPT))


def _sources(window: int):
    """The digests of all runs as the source has them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column("src_text"))
            out, last, words = [], None, []
            for i, found in enumerate(batch.column("runs").to_pylist()):
                text = data[offs[i] : offs[i + 1]].tobytes()
                if text != last:
                    last, words = text, text.split()
                out.append([{"start": r["start"], "n": r["n"], "digest": _digest(words, r["at"], r["n"] + window - 1)} for r in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "runs"])

    return run


def _remove(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column("text"))
            found = batch.column("found") if "found" in batch.schema.names else None
            for i, j in steps(offs):
                total, gone, texts, digests = [], [], [], []
                for r in range(i, j):
                    words = data[offs[r] : offs[r + 1]].tobytes().split()
                    cover = np.zeros(len(words) + 1, np.int64)
                    for f in (found[r].as_py() or []) if found is not None else []:
                        start, size = f["start"], f["n"] + window - 1
                        if start + size <= len(words) and f["digest"] == _digest(words, start, size):
                            cover[start] += 1
                            cover[start + size] -= 1
                    total.append(len(words))
                    if cover.any():
                        stay = np.cumsum(cover)[:-1] == 0
                        gone.append(int(len(words) - stay.sum()))
                        words = [words[k] for k in np.flatnonzero(stay).tolist()]
                    else:
                        gone.append(0)
                    kept = b" ".join(words)
                    texts.append(kept.decode("utf-8", "replace") if with_text else None)
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(x, k) for x, k in ((total, pa.int64()), (gone, pa.int64()), (texts, pa.string()), (digests, pa.string())))], [x.split()[0] for x in _KEPT.split(", ")])

    return run


def run_by_run(docs: DataFrame, found: DataFrame, sources: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Removes only runs of docs that are equal, one by one, in some row of their source. A task gets a source once for each document
    that asks it; of one document it gets at most the runs that its words make."""
    mine = found.groupBy("doc_id", "src").agg(F.collect_list(F.struct("start", "n", "at")).alias("runs"))
    origin = mine.join(sources.selectExpr("doc_id as origin", "text as src_text"), F.col("src") == F.col("origin"))
    proven = origin.select("doc_id", "runs", "src_text").mapInArrow(_sources(window), "doc_id long, runs array<struct<start: int, n: int, digest: binary>>")
    per = proven.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("found")).withColumnRenamed("doc_id", "f_id")
    return docs.join(per, F.col("doc_id") == F.col("f_id"), "left").select("doc_id", "text", "found").mapInArrow(_remove(window, with_text), _KEPT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w WHERE len(words) >= {WINDOW}),
x AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY md5(array_to_string(words[p:p + {WINDOW - 1}], ' '))) AS late FROM u),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM x, range({WINDOW}) t(k) WHERE late),
l AS (SELECT doc_id, words[p] AS word, p FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
k AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.p) AS kept, count(*) AS n FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
