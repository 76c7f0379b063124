"""Near duplicates: many universal hash minima with banding, verification and connected components.

Documents are linked when 100 * |A n B| >= 75 * |A u B| for their sets of five-word shingles.

1.  One pass gives each document its set size, a digest of its words, 128 minima of multiply-shift hashes (one byte
    of each is kept as signature) and 32 band keys of four minima. A pair at 0.75 shares no band with probability
    (1 - 0.75^4)^32 = 5e-6. Equal word sequences collapse to their smallest doc_id.
2.  Every document of a band's bucket is paired with the bucket's smallest doc_id. Size bounds and the signature (only
    where it is over seven standard deviations off) reject pairs; the others are confirmed on full sets.
3.  Buckets whose documents still lie in several components are dealt into blocks of bounded size. Narrow rows (size, signature,
    band keys) of every pair of blocks tell which documents have a partner of another component that could be linked, a pair only
    in the first band that it shares. Only the texts of those go on: one task a pair of blocks compares them on full sets and returns
    a spanning forest of the links that it finds.
4.  Alternating large-star and small-star steps give the components. Digests of copies and bands' buckets that hold over a
    thousandth of all rows are joined by broadcast (there are under a thousand), the others by a shuffle.

Defined results: null or empty text has an empty set and is linked with nothing; a text of under five words has its
whole sequence as one shingle; very long texts count whole; a null doc_id is linked with nothing and gets null; rows that share a
doc_id are one node, linked by each of their texts, and each keep a row; an empty table gives no rows; other columns, whatever their
names, are ignored (the stage returns them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh, held, ids_and_text, looked_up, mix, raw, steps, stored, table, windows, word_hashes, word_spans
from .components import components

SHINGLE, PERCENT, HASHES, BANDS = 5, 75, 128, 32
#: Documents and bytes of text of a block in step 3, and rows that its narrow part takes at a time.
BLOCK_DOCS, BLOCK_BYTES, NARROW_ROWS = 256, 2 << 20, 1 << 15
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]
_ROWS = HASHES // BANDS
#: Equal bytes of two signatures: 0.75 + 0.25/256 expected of 128; a true pair falls below this with probability under 1e-11.
LEAST_EQUAL = 63


def sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, one after another, and the row bounds."""
    starts, ends, bounds = word_spans(data, offs)
    h = word_hashes(data, starts, ends, lower=True)
    w, parts = windows(h, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            parts.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            parts.append(windows(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            parts.append(h[:0])
    out = np.concatenate(parts) if parts else h[:0]
    return out, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def minima(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits) of each row that isn't empty."""
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.empty((len(full), HASHES), np.uint32)
    at = bounds[full]
    for j in range(HASHES):
        v = ((x * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(v, at) if len(full) else 0
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(m), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(m), b + 1, np.uint64)
        for r in range(_ROWS):
            k = mix(k * np.uint64(0x2545F4914F6CDD1D) + m[:, b * _ROWS + r])
        keys[:, b] = k
    return keys.view(np.int64)


_SKETCH = "doc_id long, n long, key binary, sig binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held()
    for batch in batches:
        data, offs = raw(batch.column("text"))
        for i, j in steps(offs):
            x, bounds = sets(data, offs[i : j + 1])
            m = minima(x, bounds)
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            keys, low = band_keys(m).tolist(), (m & np.uint32(255)).astype(np.uint8)
            sig, bands = [None] * (j - i), [[]] * (j - i)
            for r, f in enumerate(full.tolist()):
                sig[f], bands[f] = low[r].tobytes(), keys[r]
            digest = [hashlib.blake2b(b" ".join(data[a:b].tobytes().lower().split()), digest_size=16).digest() for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds)), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "key", "sig", "bands"],
            )


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and signatures allow the similarity."""
    held()
    for b in batches:
        if not b.num_rows:
            continue
        s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield b.select(["a", "b"]).filter(pa.array((s == t).sum(axis=1) >= LEAST_EQUAL))


def _jaccard_ok(x: np.ndarray, y: np.ndarray) -> bool:
    """x and y hold distinct hashes in order."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)) or not len(x):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= PERCENT * (len(x) + len(y) - n)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs with both texts; the text of b comes in runs."""
    held()
    last, its = None, None
    for batch in batches:
        keep = []
        (da, oa), (db, ob) = raw(batch.column("text_a")), raw(batch.column("text_b"))
        for i, b in enumerate(batch.column("b").to_pylist()):
            own = db[ob[i] : ob[i + 1]]
            if last is None or last[0] != b or not np.array_equal(last[1], own):
                last, its = (b, own.copy()), sets(db, ob[i : i + 2])[0]
            keep.append(_jaccard_ok(sets(da, oa[i : i + 2])[0], its))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


_BLOCK = "bucket long, p int, q int, doc_id long, component long, home int, side int, n long, sig binary, bands array<long>"


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, p, q), with n, sig and bands: those that could be linked with one of another component of their group."""
    held()
    rest: list[pa.RecordBatch] = []
    for b in _with_end(batches):
        if b is not None:
            rest.append(b)
            if sum(x.num_rows for x in rest) < NARROW_ROWS:
                continue
        if not rest:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        key = [t.column(c).to_numpy() for c in ("bucket", "p", "q")]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])) if t.num_rows else np.zeros(0, np.int64)
        # the last group may go on in the next batch
        end = t.num_rows if b is None else int(new[-1])
        if end:
            yield from _flagged(t.slice(0, end))
        rest = t.slice(end).to_batches()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _flagged(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    group = np.cumsum(np.concatenate([[True], np.any([(k := t.column(c).to_numpy())[1:] != k[:-1] for c in ("bucket", "p", "q")], axis=0)]))
    home, side, comp, n, bucket = (t.column(c).to_numpy() for c in ("home", "side", "component", "n", "bucket"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    at = (bands == bucket[:, None]).argmax(axis=1)  # the band that this bucket is of
    hit = np.zeros(len(group), bool)
    for k in range(1, len(group)):
        i = np.flatnonzero(group[k:] == group[:-k])
        if not len(i):
            break
        j = i + k
        ok = (comp[i] != comp[j]) & ((side[i] < 0) | (home[i] != home[j])) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = (sig[i] == sig[j]).sum(axis=1) >= LEAST_EQUAL
        i, j = i[ok], j[ok]
        ok = (bands[i] == bands[j]).argmax(axis=1) == at[i]
        hit[i[ok]] = hit[j[ok]] = True
    yield from t.select([x.split()[0] for x in _BLOCK.split(", ")]).filter(pa.array(hit)).to_batches()


def _blocks(t: pa.Table) -> pa.Table:
    """Links between documents of different components of one pair of blocks: a spanning forest of them."""
    t = t.combine_chunks()
    data, offs = raw(t.column("text"))
    x, bounds = sets(data, offs)
    # rows that share a doc_id come with each other's texts; the size tells them apart, or both pass
    t = t.append_column("at", pa.array(np.arange(t.num_rows))).filter(pa.array((n := np.diff(bounds)) == t.column("n").to_numpy()))
    if not t.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    home, side = t.column("home").to_numpy(), t.column("side").to_numpy()
    node, comp, key = t.column("doc_id").to_numpy(), t.column("component").to_numpy(), t.column("bucket")[0].as_py()
    mine = [x[bounds[i] : bounds[i + 1]] for i in t.column("at").to_pylist()]
    n, sig = n[t.column("at").to_numpy()], np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    at = int(np.flatnonzero((bands == key).any(axis=0))[0])
    parent = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out: list[tuple[int, int]] = []
    left, right = (np.arange(len(node)),) * 2 if side[0] < 0 else (np.flatnonzero(home == side[0]), np.flatnonzero(home != side[0]))
    for i in left.tolist():
        js = right[(comp[right] != comp[i])]
        if side[0] < 0:
            js = js[js > i]
        js = js[(100 * np.minimum(n[js], n[i]) >= PERCENT * np.maximum(n[js], n[i]))]
        if at:
            js = js[~(bands[js, :at] == bands[i, :at]).any(axis=1)]
        js = js[(sig[js] == sig[i]).sum(axis=1) >= LEAST_EQUAL]
        for j in js.tolist():
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q and _jaccard_ok(mine[i], mine[j]):
                parent[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    docs = ids_and_text(docs, id_col, text_col)
    sketch = stored(docs.mapInArrow(_sketch, _SKETCH))
    full = "n > 0 and doc_id is not null"
    # n, sig and bands follow from the key
    one = stored(sketch.where(full).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sig", "bands"))))
    member = stored(sketch.select("doc_id", "n", "key"))
    dropped(sketch)
    total, texts = member.count(), one.count()
    # a doc_id with several texts is linked with the representative of each
    several = stored(member.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id"))
    shared = member.where(full).join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(one.selectExpr("key", "doc_id as rep"), "key").selectExpr("doc_id as a", "rep as b").where("a <> b")

    rows = one.select("doc_id", "n", F.explode("bands").alias("bucket"))
    lead = rows.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("most"), F.count("*").alias("copies")).where("lead < most").drop("most")
    bucket = stored(looked_up(rows, lead, "bucket", texts * BANDS, "inner"))
    pairs = bucket.where("doc_id <> lead").selectExpr("doc_id as a", "lead as b").distinct()
    # the same joins at every size, so that they grow as the input does
    light = one.selectExpr("doc_id", "n", "sig")
    pairs = pairs.hint("merge").join(light.selectExpr("doc_id as a", "n as n_a", "sig as sig_a"), "a").hint("merge").join(light.selectExpr("doc_id as b", "n as n_b", "sig as sig_b"), "b")
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b").mapInArrow(_plausible, "a long, b long").distinct()
    text = docs.where("doc_id is not null")
    with_a = pairs.hint("merge").join(text.selectExpr("doc_id as a", "text as text_a"), "a")
    links = stored(with_a.hint("merge").join(text.selectExpr("doc_id as b", "text as text_b"), "b").mapInArrow(_confirm, "a long, b long").union(shared))
    part = stored(components(links))

    # what is left: buckets that hold several components
    mine = bucket.select("doc_id", "bucket", "n").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").selectExpr("doc_id", "bucket", "n", "coalesce(component, doc_id) as component")
    open_ = mine.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("copies"), F.sum(F.expr("40 * n")).alias("bytes"))
    open_ = open_.where("lo <> hi").selectExpr("bucket", "copies", f"cast(greatest(ceil(copies / {BLOCK_DOCS}), ceil(bytes / {BLOCK_BYTES})) as int) as k")
    rest = looked_up(mine.drop("n"), open_, "bucket", texts * BANDS, "inner").join(one.select("doc_id", "n", "sig", "bands"), "doc_id").where("array_contains(bands, bucket)")
    rest = rest.withColumn("home", F.expr("cast(pmod(xxhash64(doc_id), k) as int)"))
    # every pair of blocks, and each block with itself (side -1): a narrow row goes to k tasks
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    rest = rest.selectExpr("doc_id", "bucket", "component", "home", "least(home, other) as p", "greatest(home, other) as q", "if(home = other, -1, least(home, other)) as side", "n", "sig", "bands")
    near = rest.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(_partners, _BLOCK)
    near = stored(near.distinct())
    more = stored(near.join(text, "doc_id").groupBy("bucket", "p", "q").applyInArrow(_blocks, "a long, b long").distinct())
    part = components(links.union(more)) if more.take(1) else part
    reps = one.selectExpr("key", "doc_id as rep", "copies").join(part.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("key", "copies", "coalesce(component, rep) as component")
    out = looked_up(member.where(full), reps, "key", total).selectExpr("doc_id", "n as n_shingles", "component as component_id")
    # an empty text of a doc_id that has others too
    other = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component"))
    out = out.union(member.where(f"not ({full})").join(other, "doc_id", "left").selectExpr("doc_id", "n", "coalesce(component, doc_id)"))
    for x in (bucket, near, more):
        dropped(x)
    return out.withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with all columns of docs."""
    gone = fresh(docs, "gone_id")
    them = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(them, docs["doc_id"] == F.col(gone), "left_anti")
