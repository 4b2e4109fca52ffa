"""Secret scans: fixed patterns, and an assignment-aware lexer that follows constants to sensitive names.

The lexer reads source code (assignments, typed declarations, strings with prefixes, in triple quotes or joined, comments,
calls), JSON and YAML (keys, values on the next line, blocks), INI files and environments (bare words), and XML (elements,
key and value attributes).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so the length may be asked for at once
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "flow")

#: Parts of names, and how much each says that a value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "privatekey": 1.0, "signature": 0.5, "key": 0.5, "salt": 0.5,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "redacted", "<", "${", "{{")
FLOW_CHARS, FLOW_SCORE = 8, 0.55
#: White space that a passphrase may have.
SPACES = 6

_HINTS = (b"passw", b"secret", b"token", b"api")
_MARK = re.compile(r"[:=]")
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v]+)|(?P<line>\n)|(?P<open>/\*|<!--|\"\"\"|\'\'\')|(?P<comment>(?<![^\s;{}])(?:\#|//|--[ ])[^\n]*)
    |(?P<name>[$@]?[^\W\d][\w$]*(?:(?:\.|->|::|-)[^\W\d][\w$]*)*)|(?P<op>:=|=>|===?|=~|!==?|<=|>=|\+=|::|:(?=//)|[:=])|(?P<other>.)""",
    re.X | re.A | re.S,
)
_STRINGS = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*+"', re.S), "'": re.compile(r"'(?:[^'\\\n]|\\.)*+'", re.S), "`": re.compile(r"`[^`\n]*+`")}
_PREFIX = re.compile(r"(?:[rRbBuUfFL]{1,2}|[@$])(?=[\"'])")
_QUOTED = re.compile(r"[A-Za-z@$]*(\"\"\"|\'\'\'|[\"'`])")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.<>\[\]|?*& \t]*+=(?![=>])|[ \t]*[A-Za-z_][\w.]*(?:[\[<][^=\n]*[\]>])?\??[ \t]*=(?![=>])", re.A)
_ARRAY = re.compile(r"[ \t]*\[\d*\][ \t]*=(?!=)")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_BLOCK = re.compile(r"[ \t]*([|>][+-]?\d?)?[ \t]*\n")
_INDENT = re.compile(r"[ \t]*")
_PLAIN_KEY = re.compile(r"[\w$.-]+(?: [\w$.-]+)?", re.A)
_ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*"([^"<>\n]*+)"\s+value\s*=\s*"([^"<>\n]*+)\"""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


class Value(NamedTuple):
    text: str
    start: int
    end: int
    quoted: bool = True


def sensitivity(name: str) -> float:
    """How much the last part of a dotted name says that its value is secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2])]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *joined]), default=0.0)


def randomness(value: str) -> float:
    """Entropy in bits a character over 4, 1 at most."""
    n = len(value)
    return min(1.0, -sum(c / n * math.log2(c / n) for c in Counter(value).values()) / 4) if n else 0.0


def looks_random(word: str) -> bool:
    """Whether a bare word is a literal and no name: some part of it mixes letters and digits, or is long and of digits."""
    return any(len(w) >= FLOW_CHARS and any(map(str.isdigit, w)) and (any(map(str.isalpha, w)) or len(w) >= 16) for w in re.split(r"[._:-]", word))


@cache
def _outdent(indent: int) -> re.Pattern:
    return re.compile(r"\n[ \t]{0,%d}[^ \t\n]" % (indent - 1))


class Lexer:
    """Reads name-literal pairs from a text. Lines without a mark are skipped; the rest goes token by token.

    A name stands for its last literal until it is assigned something else or its block, by indentation, ends. Names that are
    assigned in comments or inside strings are reported but do not bind. Quotes and comments that are never closed are
    ordinary characters; the failed search is remembered, so a text is read in linear time.
    """

    def __init__(self, text: str, binds: bool = True):
        self.text, self.binds, self.known = text, binds, {}
        self.unclosed: dict[str, bool] = {}
        self.dead: dict[str, int] = {}  # up to where a quote does not open a string
        self.looked = 0

    def _closed(self, at: int, mark: str) -> int:
        """Where what was opened before `at` ends, after its closing mark; -1 if it is not closed."""
        if self.unclosed.get(mark):
            return -1
        end = self.text.find(mark, at)
        while end > 0 and mark[0] in "\"'" and self.text[end - 1] == "\\" and self.text[end - 2] != "\\":
            end = self.text.find(mark, end + 1)
        if end < 0:
            self.unclosed[mark] = True
            return -1
        return end + len(mark)

    def token(self, at: int) -> tuple[str, int, int]:
        """Kind, start and end of the token at a place."""
        text, start = self.text, at
        if (prefix := _PREFIX.match(text, at)) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            at = prefix.end()
        c = text[at]
        triple = c in "\"'" and text[at : at + 3] == 3 * c
        if c in _STRINGS and not triple:
            if at >= self.dead.get(c, 0) and not (c == "'" and at == start and at and text[at - 1].isalnum()):
                if m := _STRINGS[c].match(text, at):
                    return "string", start, m.end()
                end = text.find("\n", at)
                self.dead[c] = len(text) if end < 0 else end
            return ("other", at, at + 1) if at == start else ("name", start, at)
        m = _TOKEN.match(text, at)
        if m.lastgroup != "open":
            return m.lastgroup, start, m.end()
        end = self._closed(m.end(), {"/*": "*/", "<!--": "-->"}.get(m[0], m[0]))
        if end < 0:
            return ("other", at, m.end()) if at == start else ("name", start, at)
        return ("string" if triple else "comment"), start, end

    def _string(self, start: int, end: int) -> Value | None:
        """The literal of a string token; None if it is a pattern that takes values in."""
        m = _QUOTED.match(self.text, start)
        lo, hi = m.end(), end - len(m[1])
        body = self.text[lo:hi]
        prefix = self.text[start : m.start(1)].lower()
        return None if "f" in prefix and "{" in body or m[1] == "`" and "${" in body else Value(body, lo, hi)

    def _lookup(self, name: str, at: int) -> Value | None:
        found = self.known.get(name)
        if found is None:
            return None
        value, indent, end = found
        if indent:
            if _outdent(min(indent, 1000)).search(self.text, end, at):
                del self.known[name]
                return None
            self.known[name] = (value, indent, max(end, self.text.rfind("\n", end, at)))
        return value

    def _skip(self, at: int, lines: bool) -> int:
        while at < len(self.text):
            kind, _, end = self.token(at)
            if kind not in ("space", "comment") and not (lines and kind == "line"):
                break
            at = end
        return at

    def _expression(self, at: int) -> tuple[Value | None, int]:
        """The value of literals and known names, joined by + or two dots, by standing side by side, or in brackets; and where
        it ends. None if anything else takes part."""
        text, parts, depth = self.text, [], 0
        while True:
            at = self._skip(at, depth > 0)
            if at >= len(text):
                break
            if text[at] == "(" and not parts:
                depth, at = depth + 1, at + 1
                continue
            kind, start, end = self.token(at)
            if kind == "string":
                part = self._string(start, end)
            elif kind == "name" and text[end : end + 1] not in ("(", "["):
                part = self._lookup(text[start:end].lstrip("$@"), at)
            else:
                part = None
            if part is None:
                return None, at
            parts.append(part)
            at = end
            after = self._skip(at, depth > 0)
            if text[after : after + 2] == "..":
                at = after + 2
            elif text[after : after + 1] == "+" and text[after : after + 2] != "+=":
                at = after + 1
            elif kind == "string" and self.token(after)[0] == "string" if after < len(text) else False:
                at = after
            else:
                break
        if not parts:
            return None, at
        return Value("".join(p.text for p in parts), min(p.start for p in parts), max(p.end for p in parts)), at

    def _bare(self, at: int) -> Value | None:
        """A bare word of a configuration file that is no name. A word is looked at once, whatever marks it holds."""
        if at < self.looked:
            return None
        m = _BARE.match(self.text, at)
        self.looked = m.end() if m else at
        if not m or self.text[m.end() : m.end() + 1] in ("(", "["):
            return None
        word = m[0].rstrip(".,:!?")
        return Value(word, at, at + len(word), False) if looks_random(word) else None

    def _below(self, at: int, indent: int) -> tuple[Value | None, int]:
        """What stands on the lines after a key with nothing, or a block mark, behind it: a literal, or deeper lines."""
        text, m = self.text, _BLOCK.match(self.text, at)
        lines = []
        at = m.end()
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            lo = _INDENT.match(text, at, end).end()
            if lo == end and m[1]:
                at = end + 1
                continue
            if lo - at <= indent and not (not lines and text[lo : lo + 1] in "\"'"):
                break
            if not m[1]:
                found, after = self._expression(lo)
                if found is None and text[_BARE.match(text, lo).end() if _BARE.match(text, lo) else lo :][:1] not in (":", "="):
                    found = self._bare(lo)
                return found, after
            lines.append((lo, len(text[:end].rstrip()) if end == len(text) else lo + len(text[lo:end].rstrip())))
            at = end + 1
        if not lines:
            return None, m.end()
        return Value(" ".join(text[a:b] for a, b in lines), lines[0][0], lines[-1][1], False), lines[-1][1]

    def pairs(self) -> Iterator[tuple[str, Value]]:
        """(name, value) of every assignment of a literal, in order."""
        text, at = self.text, 0
        while mark := _MARK.search(text, at):
            line = text.rfind("\n", at, mark.start()) + 1 or at
            yield from self._line(line)
            at = max(self.at, mark.end())

    def _line(self, at: int) -> Iterator[tuple[str, Value]]:
        text, key, start = self.text, None, at
        indent = _INDENT.match(text, at).end() - at
        while at < len(text):
            kind, lo, end = self.token(at)
            at = end
            if kind == "line":
                break
            if kind == "space":
                continue
            if kind == "op" and key and text[lo:end] in ("=", ":", ":=", "=>", "+="):
                if text[lo:end] == ":" and (typed := _TYPE.match(text, end)):
                    end = typed.end()
                value, after = self._expression(end)
                if value is None and text[lo] == ":" and _BLOCK.match(text, end):
                    value, after = self._below(end, indent)
                if value is None:
                    value = self._bare(self._skip(end, False))
                    after = value.end if value else end
                if value is not None:
                    yield key, value
                    if value.quoted and text[lo:end] != "+=":
                        yield from self._nested(value)
                short = re.split(r"\.|->|::", key)[-1]
                for name in (key, short) if self.binds else ():
                    self.known.pop(name, None)
                    if value is not None and value.quoted:
                        self.known[name] = (value, indent, after)
                at, key = max(after, end), None
            elif kind == "name":
                key = text[lo:end].lstrip("$@")
                if array := _ARRAY.match(text, end):
                    at = array.end() - 1
            elif kind == "string":
                found = self._string(lo, end)
                key = found.text if found and _PLAIN_KEY.fullmatch(found.text) else None
                if found:
                    yield from self._nested(found)
            elif kind == "comment":
                yield from self._inner(lo + 1, end)
                key = None
            elif text[lo:end] not in ("]", "?"):
                key = None
        self.at = max(at, start + 1)

    def _inner(self, lo: int, hi: int) -> Iterator[tuple[str, Value]]:
        """Pairs inside a comment or a string; they bind nothing."""
        if self.binds and _MARK.search(self.text, lo, hi):
            for name, v in Lexer(self.text[lo:hi], False).pairs():
                yield name, Value(v.text, v.start + lo, v.end + lo, v.quoted)

    def _nested(self, value: Value) -> Iterator[tuple[str, Value]]:
        return self._inner(value.start, value.end) if value.end - value.start == len(value.text) else iter(())


def is_secret(name: str, value: Value) -> float:
    """The score of a literal that a name holds, 0 if it is no secret."""
    weight, low = sensitivity(name), value.text.lower()
    if not weight or len(value.text) < FLOW_CHARS or any(x in low for x in PLACEHOLDERS):
        return 0.0
    spaces = sum(map(str.isspace, value.text))
    if spaces and (weight < 0.9 or spaces > SPACES or value.text[-1] in ".!?"):  # a sentence, no passphrase
        return 0.0
    score = weight * randomness(value.text)
    return score if score >= FLOW_SCORE else 0.0


def flow(text: str) -> Iterator[Span]:
    """Literals that reach a name that says it holds a secret: see Lexer. The span is that of the literal or, over several,
    from the first to the last of them."""
    for name, value in Lexer(text).pairs():
        if score := is_secret(name, value):
            yield Span("flow", value.start, value.end, name, score)
    if "</" in text or "value" in text:
        for m in (*_ELEMENT.finditer(text), *_ATTRIBUTES.finditer(text)):
            body = m[2].strip()
            lo = m.start(2) + len(m[2]) - len(m[2].lstrip())
            if score := is_secret(m[1], Value(body, lo, lo + len(body))):
                yield Span("flow", lo, lo + len(body), m[1], score)


def scan(text: str) -> list[Span]:
    """All spans of a text in code points, by start, then kind, then end."""
    found = []
    low = text.encode().lower()
    if any(h in low for h in _HINTS):
        found += [Span("assign", *m.span(), m[1].lower(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"akia" in low:
        found += [Span("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [Span("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    found += dict.fromkeys(flow(text))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, name, score>>) of every row, over its whole text.

    Kinds: assign, access and hex are fixed patterns; flow comes from the lexer. Starts and ends are code points, the end
    exclusive. A null text counts as empty and has no span. Rows that repeat, null ids and other columns do no harm; an
    empty table gives an empty one. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[s._asdict() for s in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], [id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, name: string, score: double>>"
    )
