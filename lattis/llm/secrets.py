"""Secret scans by assignment-aware lexing.

A lexer with states reads the statements of each text that could assign something: comments, strings (quoted, triple quoted, raw,
byte and format strings, backticks, with their escapes decoded), brackets (within them a statement goes on over lines), line
continuations, operators and bare words. A parser makes name-literal pairs of its tokens: ``name = value``, ``name: value``,
``name => value``, ``name := value``, with dotted, quoted and annotated names, lists of names, ``export NAME value`` and its like,
``--name value``, indented block values (``name: |``), elements (``<name>value</name>``) and name and value attributes.

Constants propagate within a text: a bare value that names an earlier constant, ``a + b`` and neighbouring strings, and ``{name}`` in
format strings take those values; comments define none. Of alternatives (``get("x") or "y"``) and call arguments each literal counts
for itself, but not the key that a lookup is asked for. A literal is scored by its target's name (does a part of it mean a
secret?) and by its own form (length, character classes, entropy); a quoted literal of a name that means a secret by itself
counts in full unless it is a placeholder, whatever its form. Private key blocks in PEM form count as lexed wherever they stand. Base
patterns run beside the lexer on the same text, and their spans always stay.

Offsets count code points, ends are exclusive. Defined results: null text counts as empty; repeated rows are scanned
one by one; an empty table gives no rows; other columns, whatever their names, are ignored (the stage returns them). Texts and names
of any length are read whole; brackets or quotes that never close end with the text or line.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ids_and_text, numbered, table

#: Base patterns: kind, pattern, group that is measured, least length. They match in this order.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the run is maximal, so {16,} is + with shorter matches dropped
HEX = re.compile(r"[0-9a-f]{24,}")
_LIKELY = re.compile(rf"{_NAMES}")
_HEX_HINT = re.compile(r"[0-9][0-9a-f]{11}|[0-9a-f]{11}[0-9]|[0-9a-f]{24}")

#: Parts of names that mean a secret, with their scores.
TARGETS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "privatekey": 3, "secretkey": 3, "accesskey": 3,
    "private": 2, "auth": 2, "access": 1, "key": 1, "signature": 1, "salt": 1, "bearer": 2, "session": 1,
}
#: Private key blocks, whole or cut off; line breaks inside may be written as \n.
PEM = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----)[\s\S])*-----END (?P=kind)-----|(?:\s*[A-Z][A-Za-z-]+: [^\n]+)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]+\s*\Z)?)")
#: Quoted values of sensitive names that are no secrets: empty or masked ones, references, types and stock words.
PLACEHOLDER = re.compile(
    r"[\s*x.\-_?#]*|<[^<>]*>|\$\{[^{}]*\}|\$\w+|\{\{[^{}]*\}\}|\{\w*\}|%\(\w+\)s|%s|\[secret\]|change[\s_-]?me|placeholder|example|redacted|none|null|nil|undefined|true|false|todo|tbd|n/a"
    r"|[~.\w-]*/[~\w./-]*|[\w.-]+\.(?:pem|key|crt|cer|json|txt|ya?ml|env)|string|str|text|bytes|required|optional|(?:(?:your|my|the|example|sample|dummy|test|insert|enter)[\s_-]*)*(?:api[\s_-]?key|password|passwd|secret|token|credentials?)(?:[\s_-]*here)?",
    re.IGNORECASE,
)
#: Where a statement that assigns something may be.
_SIGN = re.compile(r"""[=:]|</|^[ \t]*(?:export|setenv|set|declare|local|readonly|ENV|ARG|\#define)[ \t]|--[A-Za-z]|\"{3}|'{3}""", re.MULTILINE)
_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\\\r?\n)|(?P<line>\n)
    |(?P<comment>(?:(?<=\s)|(?<![\s\S]))\#(?!define\b)[^\n]*|(?<![:/\w])//[^\n]*|/\*(?:(?!\*/)[\s\S])*(?:\*/)?|<!--(?:(?!-->)[\s\S])*(?:-->)?)
    |(?P<string>(?:(?<![A-Za-z0-9_])(?P<prefix>[rRbBuUfF]{1,2})(?=["'])|(?<![A-Za-z0-9_]))
      (?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`[^`]*`))
    |(?P<op>:=|=>|===?|!==?|<=|>=|->|\|\||\?\?|&&|[=:+(){}\[\],;?|<>&])|(?P<bare>[^\s"'`=:+(){}\[\],;?|<>&]+)|(?P<other>[\s\S])""",
    re.VERBOSE,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|]+""")
_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\n((?:[ \t]*\n)*)(?P<pad>[ \t]+)")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[)?(?P<value>[^<>\]]*[^<>\]\s])\s*(?:\]\]>)?\s*</(?P=name)\s*>")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|\r?\n|([\s\S]))")
_FIELD = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}")
_NAMED = re.compile(r"[A-Za-z_$][\w.$\-]*\Z")
_PAD, _EMPTY, _COMMA = re.compile(r"[ \t]*"), re.compile(r"(?:[ \t]*\n)*"), re.compile(r"[ \t]*,[ \t]*")
_GIVEN, _THEN = re.compile(r"[ \t]*(?::=|=>|[=:])"), re.compile(r"[ \t]*=(?!=)[ \t]*")
_LEADING = {"export", "setenv", "set", "declare", "local", "readonly", "ENV", "ARG", "#define"}
_LOOKUPS = {"get", "getenv", "env", "environ", "pop", "setdefault", "lookup", "fetch", "read", "load", "open", "getattr", "input", "prompt"}
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ENOUGH = 5


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return max((TARGETS.get(p, 0) for p in {*parts, *joined}), default=0)


def literal_score(value: str) -> int:
    """0 for words and placeholders, up to 4 for long mixed strings."""
    if len(value) < 8 or " " in value or len(set(value)) < 5 or not value.isascii():
        return 0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return (classes >= 2) + (len(value) >= 16) + (entropy(value) >= 3.0) + bool(re.search("[0-9]", value))


def _unquoted(token: str, prefix: str, known: dict[str, str]) -> str:
    """The value of a string token."""
    body = token[len(prefix) :]
    n = 3 if len(body) >= 6 and body[:3] in ('"""', "'''") else 1
    body = body[n:-n]
    if "\\" in body and "r" not in prefix.lower():
        body = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]) if m[3] else "", body)
    if "f" in prefix.lower() or token[0] == "`":
        body = _FIELD.sub(lambda m: known.get(m[1], m[0]), body)
    return body


class _Lexer:
    """Reads one text. ``found`` gets (name, literal, start, end, quoted)."""

    def __init__(self, text: str):
        self.text, self.found, self.known = text, [], {}

    def run(self) -> list[tuple[str, str, int, int, bool]]:
        text, at = self.text, 0
        while m := _SIGN.search(text, at):
            at = self.statement(max(at, text.rfind("\n", 0, m.start()) + 1))
        if "</" in text:
            self.found += [(m["name"], m["value"], m.start("value"), m.end("value"), True) for m in _ELEMENT.finditer(text)]
        return self.found

    def statement(self, at: int, end: int | None = None, comment: bool = False) -> int:
        """Reads tokens up to a line break outside brackets; where it ends."""
        text, depth, names, last, first, tag = self.text, 0, [], None, True, {}
        end = len(text) if end is None else end
        while at < end:
            m = _TOKEN.match(text, at, end)
            kind, token = m.lastgroup, m[0]
            at = m.end()
            if kind == "space":
                continue
            if kind == "comment":
                skip = 1 if token[0] == "#" else 2
                self.statement(m.start() + skip, at, True)
            elif kind == "line":
                if depth <= 0:
                    return at
                last = None
            elif kind in ("string", "bare"):
                name = _unquoted(token, m["prefix"] or "", self.known) if kind == "string" else token
                if kind == "bare" and (first and token in _LEADING or last in _LEADING and last is not None and token[0] != "-"):
                    last = token
                    if text[at : at + 1] in (" ", "\t") and token not in _LEADING:
                        at = self.after(name, at, end, comment)
                        last = None
                elif kind == "bare" and token[:2] == "--" and text[at : at + 1] == " " and name_score(token):
                    at, last = self.after(token, at, end, comment), None
                else:
                    if last is not None:  # words side by side are no list of names
                        names = []
                    last = name
                first = False
            elif kind == "op":
                if token in ("=", ":", "=>", ":=") and last is not None:
                    start = at
                    at, values = self.value(last, at, end, [*names, last], comment, token, depth)
                    if token == "=" and last.lower() in ("key", "name", "value", "id"):
                        tag[last.lower()] = (text[start:at], values)
                    names, last = [], None
                elif token == "," and last is not None:
                    names.append(last)
                    last = None
                else:
                    if token in "([{":
                        depth += 1
                    elif token in ")]}":
                        depth -= 1
                    if token not in "])":
                        names = []
                    last = last if token in ("]", ")") else None
                if token == ">" and "value" in tag and ("key" in tag or "name" in tag):
                    self.attributes(tag)
                if token in ("<", ">"):
                    tag = {}
                first = False
            else:
                last, first = None, False
        return at

    def attributes(self, tag: dict) -> None:
        """The attributes name (or key) and value of one tag are a pair."""
        for _, name, *_ in (tag.get("key") or tag["name"])[1]:
            for _, literal, start, end, quoted in tag["value"][1]:
                self.found.append((name, literal, start, end, quoted))

    def after(self, name: str, at: int, end: int, comment: bool) -> int:
        """A value that follows its name after a space."""
        if m := _GIVEN.match(self.text, at, end):
            return self.value(name, m.end(), end, [name], comment, "=", 0)[0]
        return self.value(name, at, end, [name], comment, " ", 0)[0]

    def value(self, name: str, at: int, end: int, names: list[str], comment: bool, sign: str, outer: int) -> tuple[int, list[tuple]]:
        """Reads one value, or one for each of several names; yields pairs. Where it ends, and what it read."""
        text, got = self.text, []
        if sign == ":" and (b := _BLOCK.match(text, _PAD.match(text, at).end())):
            return self.block(name, b)
        many = len(names) > 1 and sign == "="
        while True:
            at, literal, start, stop, quoted, more = self.expression(name, at, end, outer)
            # an annotation: its name's value comes behind the next sign
            if start is not None and sign == ":" and not quoted and (m := _THEN.match(text, stop, end)) and _NAMED.match(text[start:stop]):
                at, sign = m.end(), "="
                continue
            got.append((literal, start, stop, quoted, more))
            if not (many and len(got) < len(names) and (m := _COMMA.match(text, at, end))):
                break
            at = m.end()
        whose = names if many and len(got) == len(names) else [name] * len(got)
        out = []
        for to, (literal, start, stop, quoted, more) in zip(whose, got, strict=True):
            out += [(to if n == name else n, *x) for n, *x in more]
            if start is not None:
                out.append((to, literal, start, stop, quoted))
                if not comment:
                    self.known[to] = literal
        self.found += out
        return at, out

    def block(self, name: str, b: re.Match) -> tuple[int, list[tuple]]:
        """An indented block: the lines that go on with at least its first line's indent."""
        text, pad = self.text, b["pad"]
        start = at = b.end()
        stop = start
        while True:
            line = text.find("\n", at)
            stop = len(text) if line < 0 else line
            if line < 0:
                break
            rest = _EMPTY.match(text, line + 1).end()
            if not text.startswith(pad, rest) or not text[rest : rest + len(pad) + 1].strip():
                break
            at = rest
        literal = text[start:stop].replace("\n" + pad, "\n")
        got = [(name, literal, start, stop, True)]
        self.found += got
        self.known[name] = literal
        return stop, got

    def expression(self, name: str, at: int, end: int, outer: int) -> tuple:
        """(end, literal, start, stop, quoted, other pairs): strings and constants side by side or joined by + are one literal;
        alternatives and call arguments are others."""
        text, known = self.text, self.known
        literal, start, stop, quoted, more, joined, round_ = "", None, at, False, [], True, 0
        while at < end:
            m = _TOKEN.match(text, at, end)
            kind, token = m.lastgroup, m[0]
            if kind == "space" or kind == "line" and (round_ > 0 or outer > 0 and joined and start is None):
                at = m.end()
                continue
            if kind == "string" and (joined or start is not None and quoted):
                literal += _unquoted(token, m["prefix"] or "", known)
                start, stop, quoted, joined = (m.start() if start is None else start), m.end(), True, False
                at = m.end()
            elif not joined and token in ("or", "else", "if", "and", "||", "??", "?", "&&"):
                if start is not None:
                    more.append((name, literal, start, stop, quoted))
                literal, start, quoted, joined = "", None, False, True
                at = m.end()
            elif kind in ("bare", "op", "other") and joined and (kind != "op" or token in ("+", "&", "=", "?", ":") and start is None) and (b := _BARE.match(text, at, end)):
                word = b[0]
                if text[b.end() : b.end() + 1] == "(":
                    at = self.call(name, word, b.end() + 1, end, more)
                    joined = False
                    continue
                if "+" in word and all(x in known for x in word.split("+")):
                    literal += "".join(known[x] for x in word.split("+"))
                else:
                    if word[-1] == "+" and len(word) > 1 and word[:-1] in known:
                        word = word[:-1]
                    literal += known.get(word.lstrip("$"), word)
                start, joined = (b.start() if start is None else start), False
                at = stop = b.start() + len(word)
            elif kind == "op" and token == "+" and not joined:
                joined, at = True, m.end()
            elif kind == "op" and token == "(" and joined and start is None:
                round_ += 1
                at = m.end()
            elif kind == "op" and token == ")" and round_:
                round_ -= 1
                at = m.end()
            else:
                break
        return at, literal, start, stop, quoted, more

    def call(self, name: str, callee: str, at: int, end: int, more: list[tuple]) -> int:
        """The string arguments of a call, less the key that a lookup is asked for."""
        depth, n, lookup, last, given = 1, 0, callee.rpartition(".")[2] in _LOOKUPS, None, None
        while at < end and depth:
            m = _TOKEN.match(self.text, at, end)
            at = m.end()
            if m["op"] in ("=", ":", "=>"):
                given = last
            elif m["op"] is not None:
                depth += (m["op"] in ("(", "[", "{")) - (m["op"] in (")", "]", "}"))
                last = given = None
            elif m["string"] is not None:
                n, last = n + 1, _unquoted(m[0], m["prefix"] or "", self.known)
                if given is not None or n > 1 or not lookup:
                    more.append((given or name, last, m.start(), m.end(), True))
            elif m["bare"] is not None:
                last = m[0]
        return at


def pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end of the value, quoted) of each assignment."""
    return _Lexer(text).run()


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start and then kind: assign, access, hex, lexed."""
    text, found = text or "", []
    if _LIKELY.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _HEX_HINT.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    lexed = set()
    for name, literal, start, end, quoted in pairs(text):
        if by_name := name_score(name):
            if by_name + literal_score(literal) >= ENOUGH or by_name >= 3 and quoted and not PLACEHOLDER.fullmatch(literal):
                lexed.add((start, 3, end))
    return [(s, KINDS[k], e) for s, k, e in sorted([*found, *lexed])]


KINDS = ("assign", "access", "hex", "lexed")
_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string, redacted string"


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """text with every span, overlaps merged, replaced by [secret]."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = scan(text)
                said = [f"{k}:{s}:{e}" for s, k, e in spans]
                n = Counter(k for _, k, _ in spans)
                base = ",".join(x for x in said if x[0] != "l")
                row = [*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), redacted(text, spans) if with_text and spans else None]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def secrets(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with its spans; redacted holds the cleaned text where with_text and a span was found."""
    return ids_and_text(docs, id_col, text_col).mapInArrow(_scan(with_text), _FOUND)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret in text replaced by [secret]; n_chars follows the new text. No row goes."""

    k, n = (next((i for i, c in enumerate(docs.columns) if c.lower() == name), -1) for name in ("text", "n_chars"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(k)
            new = [x if x is None or not (s := scan(x)) else redacted(x, s) for x in (v.as_py() for v in t)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(new, t.type))
            if n >= 0:
                sizes = [old if x is None or x == y else len(x) for old, x, y in zip(batch.column(n).to_pylist(), new, t.to_pylist(), strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.column(n).type))
            yield batch

    plain = numbered(docs)
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
