"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are normalised (lower case, runs of other characters than letters, digits and _ become one space). An
item of m characters may be hit with up to k = m // 10 edits. Split into n > k pieces, n - k pieces of any hit are exact,
and the starts that they imply lie within k of each other. An Aho-Corasick automaton over all pieces finds exact piece hits
in whole texts; where enough of them agree they give stretches of text, overlapping ones of an item are merged, and Myers'
bit-parallel distance verifies each stretch. Items under MIN_CHARS are found without edits and between word bounds.

The items are read in blocks of bounded size. One scan of the documents takes up to SCAN_BLOCKS of them, one automaton at a time over
slabs of text, so a benchmark of any size is read in parts whose size is known before they are broadcast.

Defined results: null or empty texts hit nothing; texts of any length are read whole; null items and items without a letter or digit
are skipped; of several places with equally few edits one is reported; repeated items and rows hit one by one; empty tables give no
rows; other columns, whatever their names, are ignored (the stage returns them).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, held, idle, ids_and_text, table

MIN_CHARS, PIECE, SHARE = 20, 8, 10
#: Characters of items in one block, blocks of one scan, and bytes of text of a slab.
BLOCK_CHARS, SCAN_BLOCKS, SLAB_BYTES = 1 << 20, 32, 32 << 20
_OTHER = re.compile(r"[\W]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(m: int) -> int:
    return m // SHARE if m >= MIN_CHARS else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): pieces of nearly equal length, PIECE or more where this leaves more than budget of them; one of a short item."""
    n = max(budget(len(item)) + 1, len(item) // PIECE) if len(item) >= MIN_CHARS else 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of pattern to any substring of text, if at most ``most``."""
    m, eq = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, m
    for c in text:
        x = eq.get(c, 0)
        v = x | minus
        x |= (((x & plus) + plus) ^ plus) | minus
        up, down = minus | ~(x | plus) & ones, plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & ones, (down << 1) & ones  # row 0 is 0 everywhere: a hit may start anywhere
        plus, minus = down | ~(v | up) & ones, up & v
        best = min(best, score)
    return best if best <= most else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        where, self.least = defaultdict(list), []
        for n, (_, t) in enumerate(self.items):
            cut = pieces(t)
            self.least.append(len(cut) - budget(len(t)))
            for at, piece in cut:
                where[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, length of the item) of each item found in a normalised text."""
        if not self.items:
            return []
        found = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                found[n].append(end + 1 - size - at)
        out = []
        for n, starts in sorted(found.items()):
            (item, t), best = self.items[n], None
            k, m = budget(len(t)), len(t)
            if m < MIN_CHARS:
                if any(text[s - 1 : s] in ("", " ") and text[s + m : s + m + 1] in ("", " ") for s in starts):
                    out.append((item, 0, m))
                continue
            starts.sort()
            near = self.least[n] - 1
            if len(starts) <= near:
                continue
            starts = {x for i, s in enumerate(starts[near:]) if s - starts[i] <= k for x in starts[i : i + near + 1]}
            a = b = None
            for s in [*sorted(starts), None]:
                if a is not None and (s is None or s - k > b):
                    got = myers(t, text[a:b], k)
                    best = got if best is None or got is not None and got < best else best
                    a = None
                if s is not None:
                    a, b = (max(0, s - k) if a is None else a), s + m + k
            if best is not None:
                out.append((item, best, m))
        return out


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    rows, size = [], 0
    for b in batches:
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            rows.append((d, normal(t.as_py())))
            size += len(rows[-1][1])
            if size >= SLAB_BYTES:
                yield rows
                rows, size = [], 0
    yield rows


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs and benchmark item found in it: doc_id, item_id, edits, item_chars."""
    spark, docs = docs.sparkSession, ids_and_text(docs, id_col, text_col)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def scan(first: int) -> DataFrame:
        # about SCAN_BLOCKS * BLOCK_CHARS characters, whatever the benchmark's size
        own: dict[int, list] = {b: [] for b in range(first, min(blocks, first + SCAN_BLOCKS))}
        for r in items.where(F.col("block").between(min(own), max(own))).orderBy("item_id", "text").toLocalIterator():
            own[r.block].append((r.item_id, normal(r.text)))
        mine, tag = spark.sparkContext.broadcast(own), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _slabs(batches):
                for b, listed in mine.value.items():
                    m = held((tag, b), lambda listed=listed: Matcher(listed))
                    found = [(d, *h) for d, t in rows for h in m.hits(t)]
                    cols = zip(*found, strict=True) if found else ([],) * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "item_chars"])
            idle()

        return docs.mapInArrow(run, "doc_id long, item_id long, edits long, item_chars long")

    out = scan(0)
    for b in range(SCAN_BLOCKS, blocks, SCAN_BLOCKS):
        out = out.union(scan(b))
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item, with all their columns."""
    key = fresh(docs, "bad_id")
    bad = matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"] == F.col(key), "left_anti")
