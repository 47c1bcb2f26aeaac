"""Secret scans: assignment-aware lexing of name-literal pairs, beside fixed token shapes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

from pyspark.sql import DataFrame

from .common import binary_text, map_rows

KINDS = ("assign", "access", "hex", "literal")

#: Patterns over UTF-8 bytes, so that letter case is folded for ASCII alone.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
HINT = re.compile(rb"pass|secret|token|api", re.I)

#: An assignment's operator; the name before it, read backwards; the value after it.
OPERATOR = re.compile(rb":=|=>|=(?!=)|:(?![:/])")
NAME_BACKWARDS = re.compile(rb"""[\x20\t]*\]?["']?([A-Za-z0-9_$.\-]+)""")
PREFIX = rb"(?:[A-Za-z][A-Za-z0-9]?|[@$]{1,2})?"  # of a string: b, rb, f, u8, @, ...
TRIPLE = rb"""(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3})"""
STRING = rb"""(?:""" + TRIPLE + rb"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
VALUE = re.compile(
    rb"[\x20\t]*(?P<value>(?:" + PREFIX + STRING + rb"|`[^`\n]*`|[A-Za-z_$][A-Za-z0-9_$.]*)"
    rb"(?:[\x20\t]*[+.][\x20\t]*(?:" + PREFIX + STRING + rb"|[A-Za-z_$][A-Za-z0-9_$]*))*)"
)
TERM = re.compile(PREFIX + rb"""(?:\"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')|`([^`\n]*)`|([A-Za-z_$][A-Za-z0-9_$.]*)""")
#: A type between a name's colon and its "=": str, &'static str, Option<&str>, list[str] | None, string?.
_TYPE = rb"(?:&[\x20\t]*+(?:'[a-z_]+[\x20\t]++)?)?(?:(?:mut|dyn|const|readonly)[\x20\t]++)?(?:[A-Za-z_][A-Za-z0-9_.]*+(?:::[A-Za-z0-9_]++)*+)?(?:<[^=;\n\"]{1,200}>|\[[^=\n\"]{0,200}\])*+[?!]?"
ANNOTATION = re.compile(rb"[\x20\t]*+" + _TYPE + rb"(?:[\x20\t]*+\|[\x20\t]*+" + _TYPE + rb")*+[\x20\t]*+=(?![=>])")
#: A declaration whose type stands between name and "=": var key string =, Dim key As String =.
DECLARED = re.compile(rb"[\x20\t]*+(?:(?:var|const|let|val|[Dd]im)[\x20\t]++([A-Za-z_]\w*+)[\x20\t]++(?:[Aa]s[\x20\t]++)?[A-Za-z_*\[\]][\w.*\[\]]*+|([A-Za-z_]\w*+)[\x20\t]++string)[\x20\t]*+(?==(?!=))")
#: A raw string over several lines; the head of an indented block.
RAW = re.compile(rb"[\x20\t]*`([^`]*+)`")
BLOCK = re.compile(rb"[\x20\t]*[|>][+-]?[1-9]?[+-]?[\x20\t]*\r?\n")
BLOCK_LINE = re.compile(rb"([\x20\t]*+)([^\n]*+)\n?")
#: Markup: an element and its text; a name and a value in neighbouring attributes.
ELEMENT = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</([A-Za-z_][A-Za-z0-9_.:\-]*+)\s*+>")
ATTRIBUTES = re.compile(rb"""\b(?:name|key)\s*+=\s*+["']([^"'<>\n]*+)["']\s++value\s*+=\s*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")
#: What precedes the name in a configuration-shaped line; its unquoted value, up to white space.
LINE_START = re.compile(rb"""[\x20\t]*(?:(?:export|set|setx|ENV|ARG)[\x20\t]+|-[\x20\t]+)?["']?\Z""")
BARE = re.compile(rb"""[\x20\t]*([^\s"'`]+)(?=\s|\Z)""")
ENV_NAME = re.compile(rb"[A-Z_][A-Z0-9_]*\Z")
#: Unquoted text that is code rather than a value: a call or index, a variable; words and dotted names.
CODE = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.]*[(\[{].*\Z|\$[A-Za-z_][A-Za-z0-9_]*\Z|[(\[{].*\Z|\$\(.*\Z", re.S)
WORDS = re.compile(rb"[A-Za-z_.]+\Z|[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+\Z")
NAME_PART = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Name parts that mark a sensitive target, with their scores; parts that take it back.
SENSITIVE = {b"password": 3.0, b"passwd": 3.0, b"pwd": 3.0, b"passphrase": 3.0, b"secret": 3.0, b"token": 2.5, b"apikey": 3.0, b"credential": 2.5, b"credentials": 2.5, b"auth": 1.5, b"private": 1.5, b"key": 1.0, b"api": 1.0, b"access": 1.0, b"signing": 1.0, b"bearer": 2.0}
HARMLESS = {b"public": -2.0, b"name": -1.5, b"url": -2.0, b"path": -1.5, b"file": -1.5, b"count": -2.0, b"length": -2.0, b"id": -0.5, b"type": -1.5}
PLACEHOLDER = re.compile(rb"(?i)^(?:x+|\*+|\.+|changeme|example|none|null|true|false|todo|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\})$")


class Value:
    """What scores need of a value, however often its parts repeat: size, byte counts, both ends.

    parts: byte spans and the values of constants, shared and not copied. A value of up to 16
    bytes is its head.
    """

    __slots__ = ("parts", "size", "counts", "head", "tail")

    def __init__(self, parts: list, pieces: list):
        self.parts, self.size, self.counts, self.head, self.tail = parts, 0, Counter(), b"", b""
        for x in pieces:
            if isinstance(x, bytes):
                n, head, tail = len(x), x, x
                self.counts.update(x)
            else:
                n, head, tail = x.size, x.head, x.tail
                self.counts.update(x.counts)
            if self.size < 16:
                self.head = (self.head + head)[:16]
            self.tail = (self.tail + tail)[-16:]
            self.size += n
        if self.size >> 300:  # doubled hundreds of times: shares are all that matter
            self.counts = Counter({k: max(1, v >> 200) for k, v in self.counts.items()})
            self.size = sum(self.counts.values())

    def placeholder(self) -> bool:
        """Every placeholder shape asks for both ends and, in between, for certain bytes alone."""
        return bool(PLACEHOLDER.match(self.head if self.size <= 16 else self.head + bytes(self.counts) + self.tail))


def entropy(counts: Counter, n: int) -> float:
    return -sum(c / n * log2(c / n) for c in counts.values()) if n else 0.0


def name_score(name: bytes) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return sum(SENSITIVE.get(p, 0.0) + HARMLESS.get(p, 0.0) for p in {*parts, *joined})


def literal_score(name: bytes, value: Value) -> float:
    """The name's score plus what the literal adds: length and entropy; placeholders lose all."""
    if value.size < 6 or value.placeholder():
        return 0.0
    named = name_score(name)
    return named + min(2.0, entropy(value.counts, value.size) / 2) + (0.5 if value.size >= 16 else 0.0) if named > 0 else 0.0


def name_before(text: bytes, at: int) -> tuple[int, int] | None:
    """The span of the whole name token that ends at an operator."""
    n = 160
    while True:
        window = text[max(0, at - n) : at][::-1]
        m = NAME_BACKWARDS.match(window)
        if n >= at or len(window.lstrip(b" \t")) > 2 and (not m or m.end() < len(window)):
            return m and (at - m.end(1), at - m.start(1))
        n *= 2


def bare_value(text: bytes, line: int, op: re.Match, name: tuple[int, int]) -> tuple[int, int] | None:
    """The span of the unquoted value of an operator on a configuration-shaped line."""
    if not LINE_START.match(text, line, name[0]) or not (m := BARE.match(text, op.end())):
        return None
    value = m[1].rstrip(b",;")
    shell = op[0] == b"=" and name[1] == op.start() and op.end() == m.start(1) and ENV_NAME.match(text, *name)
    if not value or CODE.match(value) or not shell and WORDS.match(value):
        return None
    return m.start(1), m.start(1) + len(value)


def block_value(text: bytes, line: int, op: re.Match, name: tuple[int, int]) -> tuple[int, int] | None:
    """The span of the block that a colon opens: the following lines, as far as they are indented more than the name's line."""
    if not LINE_START.match(text, line, name[0]) or not (m := BLOCK.match(text, op.end())):
        return None
    margin = len(text[line : name[0]]) - len(text[line : name[0]].lstrip(b" \t"))
    at, first, last = m.end(), None, None
    while at < len(text):
        row = BLOCK_LINE.match(text, at)
        if row[2].strip():
            if len(row[1]) <= margin:
                break
            first = row.start(2) if first is None else first
            last = row.start(2) + len(row[2].rstrip())
        at = row.end()
    return None if first is None else (first, last)


def marked_up(text: bytes, least: float) -> list[tuple[int, int]]:
    """Byte spans of the literals of markup: an element's text of one token, a value attribute after a name or key."""
    out = []
    if b"</" in text:
        for m in ELEMENT.finditer(text):
            if m[1] == m[3] and name_score(m[1]) > 0 and not WORDS.match(m[2]) and not CODE.match(m[2]) and literal_score(m[1], Value([], [m[2]])) >= least:
                out.append(m.span(2))
    if b"value" in text:
        for m in ATTRIBUTES.finditer(text):
            if name_score(m[1]) > 0 and literal_score(m[1], Value([], [m[m.lastindex]])) >= least:
                out.append(m.span(m.lastindex))
    return out


def lexed(text: bytes, least: float) -> list[tuple[int, int]]:
    """Byte spans of literals whose target's score reaches least.

    A constant keeps the spans and value of its literals; a name assigned from constants, or
    from literals joined by + or ., inherits them, and its own name scores them anew. However
    many literals make up a value, all of them are found. A type between name and "=" is passed
    over, and strings may have prefixes. The target may be a subscript (config["key"] = ...) or have
    its type behind it (var key string = ...); strings in three quotes or, after = and :=, in
    backquotes may run over lines, and so may the indented block after a sensitive `name: |`.
    Elements of one token and neighbouring name and value attributes are pairs as well.

    On a configuration-shaped line (a name, = or :, a value, from the line's start) the value may
    be unquoted. It ends at white space, without a closing comma or semicolon. Calls, variables and
    constants aren't values; nor are bare words and dotted names, except in NAME=value of capitals.
    """
    found: set[tuple[int, int]] = set(marked_up(text, least))
    if b"=" not in text and b":" not in text:
        return sorted(found)
    constants: dict[bytes, Value] = {}
    collected: set[int] = set()
    kept: list[Value] = []  # keeps the ids in collected from being given again
    end = line = seen = 0
    declared, declared_at = None, -1

    def terms(m):
        parts, pieces = [], []
        base = m.start("value")
        for t in TERM.finditer(m["value"]):
            if t[6] is None:
                k = t.lastindex
                pieces.append(t[k])
                parts.append((base + t.start(k), base + t.end(k)))
            elif t[6] in constants:
                pieces.append(constants[t[6]])
                parts.append(constants[t[6]])
        return parts, pieces

    for op in OPERATOR.finditer(text):
        line, seen = max(line, text.rfind(b"\n", seen, op.start()) + 1), op.start()
        if op.start() < end:
            continue
        at = name_before(text, op.start())
        if not at:
            continue
        if op[0] == b"=":
            if declared_at != line:
                declared, declared_at = DECLARED.match(text, line), line
            if declared and declared.end() == op.start():
                at = declared.span(declared.lastindex)
        name, parts = text[slice(*at)].lstrip(b".-0123456789"), []
        typed = ANNOTATION.match(text, op.end()) if op[0] == b":" else None
        if typed and (m := VALUE.match(text, typed.end())):
            parts, pieces = terms(m)
        if not parts and (m := VALUE.match(text, op.end())):
            parts, pieces = terms(m)
        if parts:
            end = m.end()
        elif op[0] in (b"=", b":=") and (m := RAW.match(text, op.end())):
            parts, pieces, end = [m.span(1)], [m[1]], m.end()
        elif op[0] == b":" and name_score(name) > 0 and (block := block_value(text, line, op, at)):
            parts, pieces, end = [block], [text[slice(*block)]], block[1]
        elif op[0] in (b"=", b":") and (bare := bare_value(text, line, op, at)) and not (typed and bare[1] < typed.end()):
            parts, pieces, end = [bare], [text[bare[0] : bare[1]]], bare[1]
        else:
            end = m.end() if m and not typed else end
            continue
        value = constants[name] = Value(parts, pieces)
        if literal_score(name, value) >= least:
            todo = [value]
            while todo:
                v = todo.pop()
                if id(v) in collected:
                    continue
                collected.add(id(v))
                kept.append(v)
                for x in v.parts:
                    if isinstance(x, Value):
                        todo.append(x)
                    elif x[0] < x[1]:
                        found.add(x)
    return sorted(found)


def scan(text: bytes, least: float = 4.0) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a UTF-8 text in code points, by start, then kind as in KINDS."""
    spans = []
    if (b"=" in text or b":" in text) and HINT.search(text):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    spans += [(a, b, 3) for a, b in lexed(text, least)]
    spans.sort(key=lambda x: (x[0], x[2], x[1]))
    if spans and not text.isascii():
        points = {}
        at = done = 0
        for p in sorted({x for s in spans for x in s[:2]}):
            done += len(text[at:p].decode("utf-8", "replace"))
            at = p
            points[p] = done
        spans = [(points[a], points[b], k) for a, b, k in spans]
    return [(a, b, KINDS[k]) for a, b, k in spans]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame, least: float = 4.0) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): its spans as arrays.

    Null text is empty and has no span. Repeated rows and null ids give a row each. One narrow
    pass without shuffle.
    """
    schema = "doc_id long, starts array<long>, ends array<long>, kinds array<string>"

    def make():
        def work(batch):
            got = [scan(t, least) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "starts": [[x[0] for x in s] for s in got], "ends": [[x[1] for x in s] for s in got], "kinds": [[x[2] for x in s] for s in got]}

        return work

    return map_rows(docs.select("doc_id", binary_text()), schema, make)


def scan_digest(docs: DataFrame, least: float = 4.0) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def make():
        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for t in batch.column("text").to_pylist():
                s = scan(t, least)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(sum(x[2] == k for x in s))
                out["base_sha256"].append(hashlib.sha256(joined(x for x in s if x[2] != "literal").encode()).hexdigest())
                out["spans"].append(joined(s))
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_rows(docs.select("doc_id", binary_text()), schema, make)


def redact_text(text: str, least: float = 4.0, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping or touching spans replaced by mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for a, b, _ in scan(text.encode(), least):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if runs else text


def redact(docs: DataFrame, least: float = 4.0) -> DataFrame:
    """docs with secrets in text replaced; n_chars follows where that column exists."""
    from .common import ship

    ship(docs.sparkSession)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = columns.index("text")
            texts = batch.column(at).to_pylist()
            new = [t if t is None else redact_text(t, least) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in columns:
                k = columns.index("n_chars")
                arrays[k] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, batch.column(k).to_pylist())], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
