"""Secrets in source and configuration text: fixed forms, and literals bound to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_only

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")
#: Hex digits to 'h', all else to a blank: a run of 24 is then found by a plain search.
_HEX_TABLE = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_HEX_RUN = b"h" * 24

#: Tokens of source and configuration text. A string may have a prefix (b, r, f, u) and may be tripled.
TOKEN = re.compile(
    r'''(?P<text>(?P<prefix>(?:[bBrRuUfF]{1,2})?)(?P<mark>"""|\'\'\'|"|'|`))'''
    r'''|(?P<op>:=|=>|\?=|\+=|===?|!=|<=|>=|\|\||&&|\?\?|[=:+,;()\[\]{}|&?<>])'''
    r'''|(?P<comment>//[^\n]*|\#[^\n]*)'''
    r'''|(?P<line>\n)'''
    r'''|(?P<word>(?:[^\s"'`=:+,;()\[\]{}|&?<>!]|!(?!=))+)''',
    re.A,
)
_ENDS = {m: re.compile(rf"(?:\\.|(?!{m}).)*?{m}", re.S) if len(m) == 3 else re.compile(rf"(?:\\.|[^{m}\\\n])*{m}") for m in ('"""', "'''", '"', "'")}
_ENDS["`"] = re.compile(r"(?:\\.|[^`\\])*`", re.S)
NAME = re.compile(r"[A-Za-z_$][\w$.-]*", re.A)
ASSIGNS = frozenset((":=", "=>", "=", ":", "?=", "+="))
#: Words before a name and its value that stand side by side, as in ``#define NAME "value"``.
DEFINES = frozenset(("define", "set", "setenv", "setq", "export", "defparameter"))
#: First words of calls that bind their argument to what the call is named for, or the second argument to the first.
SETTERS = frozenset(("set", "with", "put", "add", "use", "define", "update", "reset", "change", "header", "append", "insert"))
#: Calls whose first argument is a key to look up, not a value.
LOOKUPS = frozenset(("getenv", "env", "get", "getproperty", "getstring", "getordefault", "config", "lookup", "fetch", "pop", "setdefault"))
_DEFINED = re.compile(r"\b(?:define|set|setenv|setq|export|defparameter)\s", re.I)
#: Words that may stand before a value.
BEFORE = frozenset(("new", "await", "return", "const", "static", "final"))
CALL_TOKENS = 64  # of a call's arguments, looked at
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
#: A password in an address.
USERINFO = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:/@"'<>]*:(?P<value>[^\s/@"'<>]+)@""", re.A)
#: Element text and command-line options.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*)>(?P<value>[^<>\s]+)</(?P=name)>", re.A)
PROPERTY = re.compile(r"""<[\w.:-]+\s[^<>]*?\b(?:name|key)\s*=\s*["'](?P<name>[^"'<>]+)["'][^<>]*?\bvalue\s*=\s*["'](?P<value>[^"'<>]*)["']""", re.A)
BLOCK = re.compile(r"^(?P<pad>[ \t]*)(?:-[ \t]+)?(?P<name>[A-Za-z_][\w.-]*)[ \t]*:[ \t]*[|>][+-]?[ \t]*\n(?P<value>(?:(?P=pad)[ \t]+[^\n]*(?:\n|$))+)", re.A | re.M)
OPTION = re.compile(r"(?<!\S)--(?P<name>[A-Za-z][\w-]*)[ =](?P<value>[^\s-][^\s]*)", re.A)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What a part of a name adds; a literal needs 1.0 in all with what its own form adds.
SENSITIVE = {
    "password": 0.7, "passwd": 0.7, "pwd": 0.7, "passphrase": 0.7, "secret": 0.7, "credential": 0.6, "credentials": 0.6,
    "token": 0.6, "apikey": 0.7, "bearer": 0.6, "auth": 0.4, "private": 0.3, "access": 0.3, "api": 0.3, "key": 0.3,
    "signing": 0.3, "encryption": 0.3, "client": 0.1, "salt": 0.4, "pin": 0.4, "pass": 0.6,
}
PLACEHOLDERS = re.compile(r"(?i)^(?:change.?me|example|sample|test|dummy|none|null|true|false|undefined|your.*|<.*>|\$\{.*\}|%.*%|x+|\*+|\.+|todo|redacted)$")


def name_score(name: str) -> float:
    """How sensitive a target name sounds, from 0 to 1; camelCase, snake_case and dotted names alike."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts)))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret by its own form: length, entropy, mixed classes."""
    if len(value) < 6 or SCHEME.match(value) or PLACEHOLDERS.match(value) or any(c.isspace() for c in value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in (value.count(c) for c in set(value)))
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return 0.15 * (len(value) >= 8) + 0.15 * (len(value) >= 16) + 0.2 * (entropy >= 2.5) + 0.2 * (entropy >= 3.2) + 0.15 * (classes >= 2) + 0.1 * (classes >= 3)


@dataclass
class Token:
    kind: str  # text, op, line or word
    start: int
    end: int
    value: str
    bare: bool = True  # not a string literal
    glued: bool = False  # goes on with the word before, over a backslash at a line's end


def tokens(text: str) -> list[Token]:
    """The tokens of a text, in time linear in it. Strings come without prefix and marks, lines joined by a backslash as one, addresses whole."""
    out: list[Token] = []
    rest = re.compile(r"\S*")
    at, unclosed = 0, set()
    while at < len(text):
        m = TOKEN.search(text, at)
        if m is None:
            break
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("prefix", "mark") else "text"
        if kind == "text":
            mark = m["mark"]
            close = None if mark in unclosed else _ENDS[mark].match(text, at)
            if close is None:
                if len(mark) == 3 or mark == "`":  # no end: no later one of its kind has one either
                    unclosed.add(mark)
                continue
            out.append(Token("text", at, close.end() - len(mark), text[at : close.end() - len(mark)], False))
            at = close.end()
        elif kind == "comment":
            before = out[-1] if out else None
            if m[0].startswith("//") and before is not None and before.end == m.start() and before.value == ":":  # scheme://, no comment
                stop = rest.match(text, m.start()).end()
                first = out.pop().start
                if out and out[-1].kind == "word" and out[-1].end == first and SCHEME.match(text, out[-1].start):
                    first = out.pop().start
                out.append(Token("word", first, stop, text[first:stop]))
                at = stop
            else:  # what a comment says is read as well: secrets are commented out, too
                at = m.start() + (2 if m[0].startswith("//") else 1)
        elif kind == "line" and out and out[-1].kind == "word" and out[-1].end == m.start() and out[-1].value.endswith("\\"):
            before = out.pop()
            if len(before.value) > 1:
                out.append(Token("word", before.start, before.end - 1, before.value[:-1], glued=before.glued))
                more = TOKEN.match(text, at)
                if more is not None and more.lastgroup == "word":
                    out.append(Token("word", more.start(), more.end(), more[0], glued=True))
                    at = more.end()
        else:
            out.append(Token(kind, m.start(), m.end(), m[0]))
    return out


def _is(tok: Token, *values: str) -> bool:
    return tok.kind == "op" and tok.value in values


def _arguments(toks: list[Token], at: int) -> tuple[list[tuple[int, int]], int]:
    """Stretches of tokens of a call's arguments, ``at`` being its opening bracket, and the place after the closing one."""
    depth, args, first = 0, [], at + 1
    for k in range(at, min(len(toks), at + CALL_TOKENS)):
        if _is(toks[k], "(", "[", "{"):
            depth += 1
        elif _is(toks[k], ")", "]", "}"):
            depth -= 1
            if depth == 0:
                return [*args, (first, k)], k + 1
        elif depth == 1 and _is(toks[k], ","):
            args.append((first, k))
            first = k + 1
    return [], at + 1


def _call(toks: list[Token], at: int, skip: set[int]) -> tuple[list[list[Token]], int]:
    """Values among the arguments of a call whose name stands at ``at``, and the place after it and what is called on its result."""
    args, k = _arguments(toks, at + 1)
    if toks[at].value.rpartition(".")[2].lower() in LOOKUPS:
        args = args[1:]
    groups = [g for a, b in args for g in _values(toks, a, b, skip)[0]]
    while k + 1 < len(toks) and toks[k].kind == "word" and toks[k].value.startswith(".") and _is(toks[k + 1], "("):
        k = _arguments(toks, k + 1)[1]
    return groups, k


def _values(toks: list[Token], at: int, end: int, skip: set[int]) -> tuple[list[list[Token]], int]:
    """The literals and names of one value as groups: the pieces of a group are joined (side by side, by + or over lines), groups are alternatives.

    A call stands for the values among its arguments, a condition for its two outcomes (the colon between them goes to ``skip``).
    """
    groups: list[list[Token]] = []
    open_, more = False, False  # a condition's first outcome; the next operand goes on with the last group
    while at < end:
        lines = 0
        while at < end and (toks[at].kind == "line" or _is(toks[at], "(") or toks[at].kind == "word" and (toks[at].value in BEFORE or toks[at].value == "\\" or toks[at].value.startswith("!"))):
            lines += toks[at].kind == "line"
            at += 1
        if at == end or toks[at].kind not in ("text", "word") or lines and toks[at].bare:  # a name on the next line is the next statement's
            break
        if toks[at].bare and at + 1 < end and _is(toks[at + 1], "("):
            found, at = _call(toks, at, skip)
            groups += found
        elif toks[at].bare and at + 1 < end and _is(toks[at + 1], "["):  # an element of something: its key is no value
            at = _arguments(toks, at + 1)[1]
        else:
            if not (more and groups):
                groups.append([])
            groups[-1].append(toks[at])
            at += 1
            while at < end and (toks[at].kind == "text" and not groups[-1][-1].bare or toks[at].glued):
                groups[-1].append(toks[at])
                at += 1
        while at < end and _is(toks[at], ")") and at + 1 < end and (_is(toks[at + 1], "+", "||", "??", "?") or toks[at + 1].value == "or"):
            at += 1
        more = False
        if at < end and (_is(toks[at], "+", "&") or toks[at].kind == "word" and toks[at].value == "." and groups and not groups[-1][-1].bare):
            at, more = at + 1, True
        elif at < end and (_is(toks[at], "||", "??") or toks[at].kind == "word" and toks[at].value == "or"):
            at += 1
        elif at < end and _is(toks[at], "?"):
            groups, open_, at = [], True, at + 1
        elif at < end and open_ and _is(toks[at], ":"):
            skip.add(at)
            open_, at = False, at + 1
        else:
            break
    return groups, at


def _targets(toks: list[Token], at: int) -> list[str]:
    """Names that an assignment at ``at`` binds, by what stands before it: a name or string, name[...], name: type, or several by commas."""
    names: list[str] = []
    k = at - 1
    while k >= 0:
        depth = 0
        last = None
        if _is(toks[k], "]", ")", ">"):  # a subscript: its key names the target
            close = k
            while k >= 0 and close - k < 32:
                depth += (toks[k].value in ("]", ")", ">")) - (toks[k].value in ("[", "(", "<"))
                if depth == 0:
                    break
                last = toks[k] if toks[k].kind in ("text", "word") and last is None else last
                k -= 1
            k -= 1
            owner = toks[k].value if k >= 0 and toks[k].kind == "word" else ""
            names.append(f"{owner}.{last.value}" if last is not None else owner)
            k -= 1
        elif toks[k].kind in ("text", "word") and (not toks[k].bare or NAME.fullmatch(toks[k].value.lstrip("-*@"))):
            names.append(toks[k].value.lstrip("-*@"))
            k -= 1
        else:
            break
        if k >= 0 and toks[k].value == ":" and toks[at].value == "=" and len(names) == 1:  # the name stands before its type
            names.pop()
            k -= 1
            continue
        if k >= 0 and toks[k].value == "," and len(names) < 8:
            k -= 1
            continue
        break
    return names[::-1]


def _side_by_side(toks: list[Token], skip: set[int]) -> list[tuple[int, str, list[list[Token]]]]:
    """Bindings without a sign of assignment: ``define NAME value`` and calls that set something."""
    out = []
    for at, tok in enumerate(toks):
        if tok.kind != "word":
            continue
        if tok.value.lower() in DEFINES and at + 2 < len(toks) and toks[at + 1].kind == "word" and NAME.fullmatch(toks[at + 1].value) and toks[at + 2].kind in ("text", "word"):
            value = toks[at + 2]
            if not value.bare or any(c.isdigit() for c in value.value):
                out.append((tok.start, toks[at + 1].value, [[value]]))
        elif at + 2 < len(toks) and _is(toks[at + 1], "(") and NAME.fullmatch(tok.value.lstrip(".")):
            callee = tok.value.rpartition(".")[2]
            verb = (_NAME_PARTS.findall(callee) or [""])[0].lower()
            if verb not in SETTERS and SENSITIVE.get(verb, 0.0) < 0.6:
                continue
            args, _ = _arguments(toks, at + 1)
            values = [_values(toks, a, b, skip)[0] for a, b in args]
            if len(values) > 1 and len(values[0]) == 1 and not values[0][0][0].bare:
                out.append((tok.start, values[0][0][0].value, [g for g in values[1] if not g[0].bare]))
            elif values:
                out.append((tok.start, callee, [g for g in values[0] if not g[0].bare]))
    return out


def _certain(value: Token, sign: Token) -> bool:
    """A word without marks is a literal if it isn't just a name, or if it touches the sign."""
    plain = NAME.fullmatch(value.value) or value.value.strip(".-_").isalpha()  # a name, or a word of any language
    return not value.bare or not plain or any(c.isdigit() for c in value.value) or value.start == sign.end


def lex_pairs(text: str) -> list[tuple[str, list[tuple[tuple[int, int], ...]], list[int]]]:
    """(name, literals bound to it as the spans of their pieces, numbers of the pairs whose names its value uses), in text order.

    A small grammar over tokens: names, subscripts and annotated names before an assignment; values joined or as alternatives, in calls and
    conditions after it; several names with several values by position; definitions and setters without a sign; elements, properties, options,
    indented blocks and passwords in addresses. A bare name on the right stands for the literals last bound to it before or, failing that, first bound to it later.
    """
    toks = tokens(text)
    skip: set[int] = set()
    bound: list[tuple[int, str, list[list[tuple[int, int, str | None, bool]]]]] = []
    put = lambda at, name, groups, sign=None: bound.append((at, name, [[(v.start, v.end, v.value if v.bare else None, sign is None or v.glued or _certain(v, sign)) for v in g if v.end > v.start] for g in groups]))
    for at, tok in enumerate(toks):
        if tok.kind != "op" or tok.value not in ASSIGNS or at == 0 or at in skip:
            continue
        if tok.value == ":" and at + 2 < len(toks) and toks[at + 1].kind == "word" and toks[at + 2].value == "=":
            continue  # name: type = value is bound at the =
        names = _targets(toks, at)
        if not names:
            continue
        values, k = _values(toks, at + 1, len(toks), skip)
        several = [values]
        while len(several) < len(names) and k < len(toks) and _is(toks[k], ","):
            values, k = _values(toks, k + 1, len(toks), skip)
            several.append(values)
        if len(several) < len(names):
            names, several = names[-1:], several[:1]
        for name, own in zip(names, several, strict=False):
            put(tok.start, name, own, tok)
    for at, name, own in _side_by_side(toks, skip):
        put(at, name, own)
    plain = lambda a, b: [[(a, b, None, True)]]
    for pattern in (ELEMENT, PROPERTY, OPTION):
        if pattern is OPTION or "<" in text:
            bound += [(m.start(), m["name"], plain(*m.span("value"))) for m in pattern.finditer(text)]
    if "://" in text:
        bound += [(m.start(), "url.password", plain(*m.span("value"))) for m in USERINFO.finditer(text)]
    for m in BLOCK.finditer(text):
        lines = re.finditer(r"[^\n]*\S", m["value"])
        bound.append((m.start("name"), m["name"], [[(m.start("value") + x.start() + len(x[0]) - len(x[0].lstrip()), m.start("value") + x.end(), None, True)] for x in lines]))
    bound = [b for b in sorted(bound, key=lambda b: b[0]) if any(b[2])]

    where: dict[str, list[int]] = {}
    for i, (_, name, _) in enumerate(bound):
        where.setdefault(name, []).append(i)
    spans = [[p for p in (tuple((a, b) for a, b, word, sure in g if (word is None or word not in where) and sure) for g in own) if p] for _, _, own in bound]
    uses = [[_binding(where[word], i) for g in own for _, _, word, _ in g if word is not None and word in where] for i, (_, _, own) in enumerate(bound)]
    return [(name, own, [j for j in refs if j is not None and j != i]) for i, ((_, name, _), own, refs) in enumerate(zip(bound, spans, uses, strict=True))]


def _binding(places: list[int], i: int) -> int | None:
    """The last binding of a name before the i-th, else the first after it."""
    k = bisect_left(places, i)
    return places[k - 1] if k else next((p for p in places[k:] if p != i), None)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed forms, leftmost and non-overlapping for each kind."""
    out: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("latin-1", "replace").translate(_HEX_TABLE):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return _ordered(out)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def literal_spans(text: str, base: list[tuple[str, int, int]], least: float = 1.0) -> list[tuple[str, int, int]]:
    """Literals whose best target name and own form score at least ``least``, outside the base spans. Joined pieces are scored as one literal."""
    if not any(x in text for x in "=:(") and "--" not in text and "</" not in text and not _DEFINED.search(text):
        return []
    best: dict[tuple[tuple[int, int], ...], float] = {}
    pairs = lex_pairs(text)
    reached: set[int] = set()
    # constants are propagated backwards: from the most sensitive names down, each pair once, through the names a value uses
    for start in sorted((i for i, (name, _, _) in enumerate(pairs) if name_score(name)), key=lambda i: -name_score(pairs[i][0])):
        score, ahead = name_score(pairs[start][0]), [start]
        while ahead:
            i = ahead.pop()
            if i not in reached:
                reached.add(i)
                for span in pairs[i][1]:
                    best[span] = max(best.get(span, 0.0), score)
                ahead.extend(pairs[i][2])
    out = set()
    for pieces, score in best.items():
        form = literal_score("".join(text[a:b] for a, b in pieces))
        if form and score + form >= least:
            out |= {("literal", a, b) for a, b in pieces if not any(x < b and a < y for _, x, y in base)}
    return sorted(out)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(least: float):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text or "")
                base.append(own)
                every.append(_ordered(own + literal_spans(text or "", own, least)))
            counts = [pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64()) for kind in KINDS[:3]]
            digest = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in every],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digest), spans],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return step

    return make


def scan_secrets(docs: DataFrame, least: float = 1.0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts by fixed form, a digest of those spans, and all spans.

    Fixed forms are assignments to a sensitive name, access key ids and long hex runs. The lexer adds kind
    ``literal``: it cuts a text into tokens, reads name-literal pairs of assignments, mappings, elements, options and
    blocks off them, propagates constants through names and concatenations, and scores each literal by the most sensitive name
    that it reaches and by its form. Fixed spans are never altered; a literal inside one isn't repeated.

    Spans are code points, end exclusive, in text order. Null and empty texts have none. Each row is
    judged alone: repeated rows give equal rows, an empty table an empty result. Other columns are not read.
    """
    source = text_only(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(
        source, _scan(least),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>",
    )
