"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

Compilation. A token is usable if the merges of its own bytes give it back; its proper prefixes bound the lookahead.
The last token of an encoded prefix ending at byte i is the one token t that ends there such that the last token u before
it and t stay two tokens when their bytes are merged together. These pair tests are the only place where ranks are
compared; they are memoised.

Transducer. A state holds every live position (one from which a token could still grow): its node in the trie of tokens, and the
chain of tokens that ends there, from the last one that all live positions share. Reading a byte finds the new last token, drops
positions from which no token can grow, and emits the tokens that all live positions share. So lookahead is bounded by the longest
token. A shared token that no pair test can ask for any more is forgotten, which merges states. States and transitions are built when
inputs first need them; every input goes through them byte by byte. The tables have fixed sizes.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine, which holds back incomplete characters between
chunks.

Texts are split by the given pattern first. Cuts at single spaces between other characters never lie within a match, so
the pieces between such cuts are encoded one by one, and their words are remembered in a table of bounded size. A slab of texts is cut
and its different pieces are numbered in Arrow; each is looked up once, and the texts' ids are put together from the numbers.

Defined results: null text counts as empty and has no tokens; texts of any length are encoded whole; of pairs of one rank the leftmost
merges first; repeated rows are encoded one by one; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, idle, ids_and_text, raw, steps, table, trimmed

RANKS = "byte_bpe_multi_50k.tiktoken"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries of the tables; a tokenizer with less room has that share of them. They change the speed only.
MOST_STATES, MOST_PAIRS, MOST_PIECES = 200_000, 250_000, 700_000
#: Pieces of several matches that are split together.
AT_ONCE = 20_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], data: bytes, to: int = 1) -> list[bytes]:
    """Merges the adjacent pair of lowest rank, the leftmost first, until none or ``to`` parts are left. Only for short inputs."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > to:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: Keys of a state beside the bytes.
FINAL, LIVE, PASSING = -1, -2, -3


class Transducer:
    def __init__(self, ranks: dict[bytes, int], room: float = 1.0):
        self.most_states, self.most_pairs = int(MOST_STATES * room), int(MOST_PAIRS * room)
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        good, self.halves = {}, {}  # halves: the two tokens of a token's last merge; of a byte, itself twice
        for b, i in ranks.items():
            two = merged(ranks, b, 2) if len(b) > 1 else [b, b]
            if len(two) == 2:
                good[b], self.halves[i] = i, (ranks[two[0]], ranks[two[1]])
        #: a trie of the usable tokens: children by byte, and the token that ends at a node (-1 if none)
        self.kids, self.token = [{}], [-1]
        for b, i in good.items():
            node = 0
            for c in b:
                if (to := self.kids[node].get(c)) is None:
                    to = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self._pairs: dict[int, bool] = {}  # by (left + 1) << 20 | right, left -1 for the start
        #: bytes read, and transitions built for them
        self.read = self.built = 0
        self._reset()

    def _reset(self) -> None:
        """Only the start. A state maps bytes to (state, what is emitted), FINAL to the tokens that are left if the input ends there, and
        LIVE to its live positions: ((node, chain), ...)."""
        live = ((0, (-1,)),)
        self.start: dict = {FINAL: (), LIVE: live}
        self.states = {live: self.start}
        self.passing = 0  # states that found the tables full

    def stay_apart(self, left: int, right: int) -> bool:
        key = (left + 1) << 20 | right
        if (ok := self._pairs.get(key)) is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            ok = self._pairs[key] = left < 0 or self._apart(left, right)
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Undoes the merges of both tokens, latest first: no pair across the boundary may have merged before them."""
        ranks, bytes_of, halves, before = self.ranks, self.bytes_of, self.halves, 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], before) < before:
                return False
            for side in ("l", "r") if left > right else ("r", "l"):
                # of two merges of one rank, the left one is first
                if side == "l" and (inner := halves[left][1]) != left:
                    before, left = left, inner
                    break
                if side == "r" and (inner := halves[right][0]) != right:
                    before, right = right + 1, inner
                    break
            else:
                return True

    def step(self, live_: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The transition of a state on a byte: the new state's live positions and the tokens that are certain now."""
        kids, token, pairs, here, live = self.kids, self.token, self._pairs, None, []
        for node, chain_ in live_:
            if (to := kids[node].get(byte)) is not None:
                if here is None and (t := token[to]) >= 0:
                    ok = pairs.get((chain_[-1] + 1) << 20 | t)
                    if ok or ok is None and self.stay_apart(chain_[-1], t):
                        here = (*chain_, t)
                if kids[to]:
                    live.append((to, chain_))
        if here is None:
            raise ValueError("no token ends here: the ranks lack a byte")
        live.append((0, here))
        # tokens that all live chains share are settled; the first is settled already
        n, least = 1, min(len(c) for _, c in live)
        while n < least and all(c[n] == here[n] for _, c in live):
            n += 1
        sure = here[1:n]
        if sure:
            live = [(node, c[n - 1 :]) for node, c in live]
        if live[0][1][0] >= 0 and all(len(c) > 1 for _, c in live):  # no token can begin right behind the settled one any more
            live = [(node, (-2, *c[1:])) for node, c in live]
        return tuple(live), sure

    def rest(self, state: dict, data: Iterable[int], ids: list[int]) -> tuple[int, ...]:
        """Reads data, beginning with a transition that isn't known. What is met first is kept; when the tables are full, further states
        last for one input, and too many of them empty the tables."""
        for byte in data:
            if (go := state.get(byte)) is None:
                live, sure = self.step(state[LIVE], byte)
                self.built += 1
                if (to := self.states.get(live)) is None:
                    to = {FINAL: live[-1][1][1:], LIVE: live}
                    if len(self.states) < self.most_states:
                        self.states[live] = to
                    else:
                        to[PASSING] = True
                        self.passing += 1
                go = to, sure
                if PASSING not in state and PASSING not in to:
                    state[byte] = go
            state, sure = go
            ids += sure
        ids += state[FINAL]
        if self.passing > 4 * self.most_states:
            self._reset()
        return tuple(ids)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one match of the pattern."""
        state, ids, rest = self.start, [], iter(data)
        self.read += len(data)
        byte = -1
        try:
            for byte in rest:
                state, sure = state[byte]
                if sure:
                    ids += sure
        except KeyError:
            return self.rest(state, chain((byte,), rest), ids)
        return (*ids, *state[FINAL])


class Tokenizer:
    """Encodes whole texts. Holds the transducer and a table of the ids of matches that begin with a space, by their text after it, so a word
    is encoded once whatever stands behind it. When the table is full, its entries become the old generation: those that are met again come
    back, the others go with the next."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, room: float = 1.0):
        self.fst, self.split, self.most_pieces = Transducer(read_ranks(path), room), regex.compile(pattern), int(MOST_PIECES * room)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.marks: dict[str, tuple[int, ...]] = {}  # short matches without a leading space
        self.letters = pattern == public_tokenizers.PATTERN  # there, a space and letters are one match
        # the tables hold no circles, and without these calls every full collection walks them
        gc.freeze()
        gc.set_threshold(200_000, 20, 20)

    def match(self, m: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        if self.letters and m[0] == " " and not m[1:2].isspace() and len(m) > 1:
            return self.word(m[1:])
        if (ids := self.marks.get(m)) is None:
            ids = self.fst.encode(m.encode("utf-8", "surrogatepass"))
            if len(m) <= 3 and len(self.marks) < 10_000:
                self.marks[m] = ids
        return ids

    def whole(self, text: str) -> tuple[int, ...]:
        """The ids of a text that begins and ends where matches do."""
        found = self.split.findall(text)
        return self.match(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self.match, found)))

    def word(self, text: str) -> tuple[int, ...]:
        """The ids of a space and text, which are one match; of other patterns than PATTERN any number."""
        if (ids := self.pieces.get(text)) is None:
            if (ids := self.old.pop(text, None)) is None:
                ids = self.fst.encode((" " + text).encode("utf-8", "surrogatepass")) if self.letters else self.whole(" " + text)
            if len(text) <= 64:
                if len(self.pieces) >= self.most_pieces // 2:
                    self.old, self.pieces = self.pieces, {}
                self.pieces[text] = ids
        return ids

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without the space that each begins with."""
        first, *rest = _CUT.split(text)
        return first, rest

    def ids(self, rest: list[str]) -> list[tuple[int, ...]]:
        """The ids of pieces as cut. Those of several matches are split together, for between them only a match's first space is one."""
        out, several = list(map(self.pieces.get, rest)), []
        for at in [k for k, x in enumerate(out) if x is None]:
            text = rest[at]
            if text.isalpha() or not self.letters:
                out[at] = self.word(text)
            elif not text or " " in text or text[0].isspace() or text[-1].isspace():
                out[at] = self.whole(" " + text)
            else:
                several.append(at)
        for k in range(0, len(several), AT_ONCE):
            part = several[k : k + AT_ONCE]
            found = self.split.findall(" " + " ".join([rest[at] for at in part]))
            ids, first = list(map(self.match, found)), [i for i, m in enumerate(found) if m[0] == " "]
            for at, i, j in zip(part, first, [*first[1:], len(found)], strict=True):
                out[at] = ids[i] if j == i + 1 else tuple(chain.from_iterable(ids[i:j]))
        return out

    def encode(self, text: str) -> list[int]:
        first, rest = self.cut(text)
        return list(chain(self.whole(first), chain.from_iterable(self.ids(rest))))


#: Bytes of text of a slab, and of a text that is encoded by itself.
SLAB_BYTES, ALONE_BYTES = 8 << 20, 64 << 20
_WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts in which a space has white space, or nothing, beside it.
_ODD = rf"\A | \z| {_WHITE}|{_WHITE} "


class Slab:
    """A slab's pieces: place k of text i, bounds[i] <= k < bounds[i + 1], has the ids ids[number[k]]. Texts in ``odd`` have none here."""

    def __init__(self, t: Tokenizer, texts: pa.Array):
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.greater(pc.binary_length(texts), ALONE_BYTES))
        self.odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = pc.split_pattern(pc.if_else(odd, "", texts) if self.odd else texts, " ")
        self.bounds, self.pieces = cut.offsets.to_numpy().astype(np.int64), cut.values
        coded = self.pieces.dictionary_encode()
        words, first = coded.dictionary.to_pylist(), self.bounds[:-1]
        self.ids = t.ids(words) + [t.whole(x) for x in self.pieces.take(pa.array(first)).to_pylist()]  # first pieces have no space before them
        self.number = coded.indices.to_numpy().copy()
        self.number[first] = len(words) + np.arange(len(first))
        self.counts = np.fromiter(map(len, self.ids), np.int64, len(self.ids))[self.number]

    def joined(self, of: pa.Array, by: str | bytes) -> list:
        """For each text, its pieces' values joined."""
        lists = pa.ListArray.from_arrays(pa.array(self.bounds.astype(np.int32)), of.take(pa.array(self.number)))
        return pc.binary_join(lists, by).to_pylist()

    def lists(self) -> pa.Array:
        flat = pa.array(self.ids, pa.list_(pa.int32())).take(pa.array(self.number))
        return pa.ListArray.from_arrays(flat.offsets.take(pa.array(self.bounds)), flat.values)


def slabs(column: pa.Array, size: int = SLAB_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a column, in slabs of bounded size."""
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for i, j in steps(raw(texts)[1], size):
        yield i, texts.slice(i, j - i)


class Decoder:
    """Streaming decode: bytes of tokens through an incremental UTF-8 state machine."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        """The characters that are complete by now; the bytes of a begun character wait for the next call."""
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN, room: float = 1.0) -> Tokenizer:
    """Kept by a Python worker between tasks, until another operator asks for its own table."""
    return held((path, pattern, room), lambda: Tokenizer(path, pattern, room))


_ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
#: Bytes decoded at a time.
_CHUNK = 1 << 16


def _round_trip(data: bytes) -> str:
    """The digest of the decoded text of an id sequence's bytes, chunk by chunk."""
    machine, digest = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256()
    for at in range(0, max(1, len(data)), _CHUNK):
        digest.update(machine.decode(data[at : at + _CHUNK], at + _CHUNK >= len(data)).encode())
    return digest.hexdigest()


def _encode(path: str, with_ids: bool, room: float = 1.0, size: int = SLAB_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, room=room)
        bytes_of = t.fst.bytes_of.__getitem__
        for batch in batches:
            for i, texts in slabs(batch.column("text"), size):
                slab = Slab(t, texts)
                n = np.add.reduceat(slab.counts, slab.bounds[:-1])
                said = slab.joined(pa.array([",".join(map(str, x)) for x in slab.ids], pa.string()), ",")
                back = slab.joined(pa.array([b"".join(map(bytes_of, x)) for x in slab.ids], pa.binary()), b"")
                ids = slab.lists() if with_ids else pa.nulls(len(texts), pa.list_(pa.int32()))
                if slab.odd:
                    ids = ids.to_pylist()
                    for k in slab.odd:
                        own = t.encode(texts[k].as_py())
                        n[k], said[k], back[k], ids[k] = len(own), ",".join(map(str, own)), b"".join(map(bytes_of, own)), own if with_ids else None
                    ids = pa.array(ids, pa.list_(pa.int32()))
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in said]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(texts)), pa.array(n), ids, pa.array(sha, pa.string()), pa.array([_round_trip(x) for x in back], pa.string())],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
            trimmed()
        idle()

    return run


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", room: float = 1.0, size: int = SLAB_BYTES) -> DataFrame:
    """One row per row of docs: its ids, their number and digest, and the digest of the decoded text's bytes. room and size (bytes of a
    slab) trade memory of a worker against speed."""
    return ids_and_text(docs, id_col, text_col).mapInArrow(_encode(path or public_tokenizers.path(RANKS), with_ids, room, size), _ENCODED)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with a round trip's digest. In a pipeline the executors' heaps have grown before, so the workers
    take less room."""
    return encoded(docs, room=0.7, size=4 << 20)
