"""Edit-aware token counts.

A document's text is cut into pieces of whole pre-tokens. The pieces lie in the leaves of a segment tree whose nodes sum characters
and tokens. An edit (start, end, new text; code points, clipped to the text) descends by characters and re-encodes from a piece
before it, far enough that no earlier pre-token has seen the edit, to the first piece behind it where the pre-tokens meet the old ones
again; it updates the sums above the changed leaves. All other pieces keep their counts. A leaf that has grown too full is split, by
building the tree anew from its pieces' counts. Counts are those of the byte-level BPE of bpe.py over the new text, for patterns
whose matches depend on nothing behind the next run of white space and CONTEXT characters more.

``with_trees`` counts whole texts and packs each tree into a few bytes; ``edited`` unpacks it and applies edits.

Defined results: null text counts as empty; a null list of edits is no edit, a null replacement is empty; edits apply in
order, each to the text that the ones before it left; texts of any length are held whole; repeated rows are counted one by one; an
empty table gives no rows; other columns are kept by with_trees, whose own are named n_tokens and tree, lengthened by underscores
where docs has such columns, and ignored by edited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import RANKS, Slab, Tokenizer, slabs, tokenizer
from .common import fresh as fresh_name
from .common import idle, numbered, stored, table, trimmed

#: Pieces of a leaf, of a leaf that is split, characters of a piece of several pre-tokens, and characters behind which nothing is seen.
LEAF, FULL, PIECE, CONTEXT = 32, 128, 32, 4


def pieces(text: str, t: Tokenizer) -> list[tuple[int, int]]:
    """(characters, tokens) of the pieces of a text that begins where a pre-token does."""
    out, size, count = [], 0, 0
    for m in t.split.findall(text):
        size, count = size + len(m), count + len(t.match(m))
        if size >= PIECE:
            out.append((size, count))
            size = count = 0
    if size:
        out.append((size, count))
    return out


class CountTree:
    """sizes: characters of each piece; counts: tokens of each piece. Leaves hold LEAF pieces, and list them once touched."""

    def __init__(self, text: str, sizes: np.ndarray, counts: np.ndarray):
        self._text, self._sizes, self._counts, self.encoded = text, sizes, counts, 0
        first = np.arange(0, len(sizes), LEAF)
        chars, tokens = (np.add.reduceat(a, first) if len(a) else np.zeros(1, np.int64) for a in (sizes, counts))
        self._starts = list(accumulate(chars.tolist(), initial=0))
        self.n_leaves, self.width = len(chars), 1 << (len(chars) - 1).bit_length()
        self.touched: dict[int, list[tuple[str, int]]] = {}
        self.chars, self.tokens = ([0, *self._up(a)] for a in (chars, tokens))

    def _up(self, leaf: np.ndarray) -> list[int]:
        """Nodes 1 to 2 * width - 1."""
        levels = [leaf.tolist() + [0] * (self.width - len(leaf))]
        while len(below := levels[-1]) > 1:
            levels.append(list(map(add, below[::2], below[1::2])))
        return list(chain.from_iterable(levels[::-1]))

    def leaf(self, i: int) -> list[tuple[str, int]]:
        if (own := self.touched.get(i)) is None:
            part = slice(i * LEAF, (i + 1) * LEAF)
            cuts = list(accumulate(self._sizes[part].tolist(), initial=self._starts[i]))
            own = self.touched[i] = [(self._text[a:b], c) for a, b, c in zip(cuts, cuts[1:], self._counts[part].tolist(), strict=False)]
        return own

    def _sum(self, leaf: int) -> None:
        own = self.leaf(leaf)
        self.chars[self.width + leaf] = sum([len(p) for p, _ in own])
        self.tokens[self.width + leaf] = sum([c for _, c in own])

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def update(self, leaf: int) -> None:
        self._sum(leaf)
        i = (self.width + leaf) // 2
        while i:
            self._add(i)
            i //= 2

    def find(self, char: int) -> tuple[int, int, int]:
        """(leaf, piece, first character of the piece) of a character; the end belongs to the last piece."""
        i, at = 1, 0
        char = min(char, self.chars[1] - 1)
        while i < self.width:
            i *= 2
            if char - at >= self.chars[i]:
                at += self.chars[i]
                i += 1
        leaf = i - self.width
        for k, (p, _) in enumerate(self.leaf(leaf)):
            if char - at < len(p):
                return leaf, k, at
            at += len(p)
        return 0, 0, 0

    def _step(self, leaf: int, k: int, by: int) -> tuple[int, int] | None:
        k += by
        while not 0 <= k < len(self.leaf(leaf)):
            leaf += by
            if not 0 <= leaf < self.n_leaves:
                return None
            k = 0 if by > 0 else len(self.leaf(leaf)) - 1
        return leaf, k

    def _set(self, new: CountTree) -> None:
        self.__dict__.update(new.__dict__ | {"encoded": self.encoded})

    def edit(self, start: int, end: int, new: str, t: Tokenizer) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not n:
            sizes, counts = measured(new, t)
            self.encoded += len(sizes)
            self._set(CountTree(new, sizes, counts))
            return
        # back to a boundary whose pre-tokens have not seen the edit
        leaf, k, at = self.find(start)
        before = self.leaf(leaf)[k][0][: start - at]
        while at and len(before.lstrip()) < CONTEXT:
            leaf, k = self._step(leaf, k, -1)
            before = self.leaf(leaf)[k][0] + before
            at -= len(self.leaf(leaf)[k][0])
        # on to a boundary of both the old pieces and the new pre-tokens, with as much behind it
        last, j, begin = self.find(end)
        behind, ends, more = self.leaf(last)[j][0][end - begin :], {}, 1
        ends[len(behind)] = (last, j)
        to = (last, j)
        while True:
            for _ in range(more):
                if (then := self._step(*to, 1)) is None:
                    break
                to = then
                behind += self.leaf(to[0])[to[1]][0]
                ends[len(behind)] = to
            more *= 2
            whole, done = self._step(*to, 1) is None, len(before) + len(new)
            fresh, size, cut = [], 0, None
            for m in t.split.finditer(before + new + behind):
                size = m.end()
                place = size - done
                if place in ends and (whole and place == len(behind) or len(behind[place:].lstrip()) >= CONTEXT):
                    cut = place
                    break
            if cut is None and whole and not size:  # nothing is left
                cut = len(behind)
            if cut is not None:
                break
        last, j = ends[cut]
        string, at = before + new + behind[:cut], 0
        fresh = []
        for size, count in pieces(string, t):
            fresh.append((string[at : at + size], count))
            at += size
        self.encoded += len(fresh)
        if leaf == last:
            self.leaf(leaf)[k : j + 1] = fresh
            self.update(leaf)
        else:
            self.leaf(leaf)[k:] = fresh
            self.leaf(last)[: j + 1] = []
            for x in range(leaf + 1, last):
                self.touched[x] = []
            for x in range(leaf, last + 1):
                self.update(x)
        if len(self.touched[leaf]) > FULL:
            rows = [(len(p), c) for i in range(self.n_leaves) for p, c in self.leaf(i)]
            sizes, counts = np.array(rows, np.int64).reshape(-1, 2).T
            self._set(CountTree(self.text(), sizes, counts))

    def text(self) -> str:
        return "".join("".join(p for p, _ in self.touched[i]) if i in self.touched else self._text[self._starts[i] : self._starts[i + 1]] for i in range(self.n_leaves))

    def pack(self) -> bytes:
        pieces = [x for i in range(self.n_leaves) for x in self.leaf(i)]
        return pack(np.array([len(p) for p, _ in pieces], np.int64), np.array([c for _, c in pieces], np.int64))


def measured(text: str, t: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each piece of a text. Cuts at single spaces are boundaries of pre-tokens; longer stretches without one
    are cut into pieces() of their own."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, rest = t.cut(text)
    sizes, counts = np.empty(len(rest) + 1, np.int64), np.empty(len(rest) + 1, np.int64)
    sizes[0], counts[0] = len(first) - 1, len(t.whole(first)) if len(first) <= 2 * PIECE else 0
    sizes[1:], counts[1:] = np.fromiter(map(len, rest), np.int64, len(rest)), np.fromiter(map(len, t.ids(rest)), np.int64, len(rest))
    sizes += 1
    if sizes.max() > 2 * PIECE:
        cut = [p for k, (n, c) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)) for p in ([(n, c)] if n <= 2 * PIECE else pieces(" " + rest[k - 1] if k else first, t))]
        sizes, counts = np.array(cut, np.int64).T
    return (sizes, counts) if sizes.all() else (sizes[sizes > 0], counts[sizes > 0])


def measured_all(texts: pa.Array, t: Tokenizer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """measured() of each text of a slab."""
    slab = Slab(t, texts)
    sizes = pc.utf8_length(slab.pieces).to_numpy().copy()
    del slab.pieces
    sizes += 1
    sizes[slab.bounds[:-1]] -= 1
    odd = {*slab.odd, *(np.searchsorted(slab.bounds, np.flatnonzero((sizes > 2 * PIECE) | (sizes == 0)), "right") - 1).tolist()}
    for i, (a, b) in enumerate(zip(slab.bounds[:-1].tolist(), slab.bounds[1:].tolist(), strict=True)):
        yield measured(texts[i].as_py() or "", t) if i in odd else (sizes[a:b], slab.counts[a:b])


_BYTES, _BACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """The leaves of a tree: two whole numbers a piece, a byte each where that is enough."""
    both = np.array([sizes, counts])
    kind = np.uint8 if both.size == 0 or both.max() < 256 else np.uint32
    return bytes((np.dtype(kind).itemsize,)) + _BYTES.compress(both.astype(kind).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = {1: np.uint8, 4: np.uint32}[blob[0]]
    return tuple(np.frombuffer(_BACK.decompress(blob[1:]), kind).reshape(2, -1).astype(np.int64))


def _trees(path: str, at: int):
    """A batch for each slab of column ``at``, since the JVM holds a batch whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for i, texts in slabs(b.column(at)):
                total, trees = [], []
                for sizes, counts in measured_all(texts, t):
                    total.append(int(counts.sum()))
                    trees.append(pack(sizes, counts))
                rows = b.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(total, pa.int64()), pa.array(trees, pa.binary())], [*b.schema.names, "n_tokens", "tree"])
            trimmed()
        idle()

    return run


def with_trees(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with two more columns, the last ones: n_tokens, and tree, the packed leaves."""
    names, plain = [fresh_name(docs, "n_tokens"), fresh_name(docs, "tree")], numbered(docs)
    kinds = StructType([*plain.schema.fields, StructField("n_tokens", LongType()), StructField("tree", BinaryType())])
    return plain.mapInArrow(_trees(path or public_tokenizers.path(RANKS), docs.columns.index(text_col)), kinds).toDF(*docs.columns, *names)


def listed(edits: pa.Array) -> Iterator[list[tuple]]:
    """The (start, end, new) of each row; null lists and null edits are left out."""
    if pa.types.is_null(edits.type):
        yield from ([] for _ in edits)
        return
    parts = dict(zip((f.name for f in edits.type.value_type), edits.values.flatten(), strict=True))
    rows = list(zip(*(parts[k].to_pylist() for k in ("start", "end", "new")), strict=True))
    for a, b, some in zip(edits.offsets.to_pylist(), edits.offsets[1:].to_pylist(), edits.is_valid().to_pylist(), strict=False):
        yield [e for e in rows[a:b] if e[0] is not None and e[1] is not None] if some else []


_EDITED = "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_reencoded long, edited_sha256 string, text string, tree binary"


def edited(docs: DataFrame, path: str | None = None, keep: bool = True, tree_col: str | None = None) -> DataFrame:
    """docs with doc_id, text, edits (array of start, end, new) and the tree kept in tree_col -> counts and trees after the edits.
    Without tree_col, trees are built in the same pass."""
    path = path or public_tokenizers.path(RANKS)
    kept = [tree_col] if tree_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            rows = []
            for edits, d, text, *old in zip(listed(b.column("edits")), *(b.column(c) for c in ("doc_id", "text", *kept)), strict=True):
                now = text.as_py() or ""
                sizes, counts = unpack(old[0].as_py()) if old else measured(now, t)
                tree, n = CountTree(now, sizes, counts), int(counts.sum())
                for start, end, put in edits:
                    tree.edit(start, end, put or "", t)
                new = tree.text()
                rows.append((d.as_py(), n, tree.tokens[1], len(sizes), tree.encoded, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), new if keep else None, tree.pack() if keep else None))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()]
            cols = zip(*rows, strict=True) if rows else ([],) * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _EDITED.split(", ")])
            trimmed()
        idle()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits", *kept).mapInArrow(run, _EDITED)


#: The query's edits: a note in front, a word in the middle third replaced, the last characters cut.
EDITS = """array(struct(0 as start, 0 as end, 'Note 2024: ' as new),
  struct(int(length(coalesce(text, '')) div 3) as start, int(length(coalesce(text, '')) div 3 + 16) as end, ' edited text' as new),
  struct(int(length(coalesce(text, '')) - 2) as start, int(length(coalesce(text, '')) + 40) as end, '' as new))"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all documents are built and stored; the edits then start from the stored trees."""
    kept = stored(with_trees(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return edited(kept.withColumn("edits", F.expr(EDITS)), keep=False, tree_col="tree").drop("text", "tree")
