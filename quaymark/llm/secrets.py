"""Secret scans: fixed patterns, and assignment-aware lexing.

The patterns find assignments to sensitive names, access key ids and long hex
runs. The lexer cuts source and configuration syntax into tokens (plain,
triple-quoted and prefixed strings, private keys over several lines, names,
assignment signs, elements, flags) and reads bindings from them: one or more
targets (``a = b = "x"``, typed and dotted names, ``"name": "x"``,
``d["name"] = "x"``, ``<name>x</name>``, ``--name x``) and a value. A value is
a string, a bare word, a YAML block, a list of strings, or a concatenation of
strings and names. What a string holds is lexed again, as connection strings
hold assignments.

A name in a value stands for its last binding before, or without one its
first binding after. Constants propagate from the targets: the score of a
sensitive name passes along these references to each binding they reach, once,
so the cost is linear in the text. A literal scores by the most sensitive
target it reaches plus its own randomness (of all pieces of its
concatenation); scores of ``MIN_SCORE`` or more are reported with kind
``named``, each piece where it stands. Words are no secrets: a literal of letters alone counts from ``LONG_LETTERS`` on,
one with white space only under a name of a password or passphrase that no
sentence leads up to. Nothing has a greatest length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base patterns, as the result contract states them.
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")
ASSIGN_LEAST = 12

# Words of sensitive names and their scores.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3,
    "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "authorization": 2,
    "private": 1, "access": 1, "client": 1, "signing": 1, "encryption": 1, "session": 1, "api": 1,
    "key": 1.5, "bearer": 2, "salt": 2, "dsn": 2, "cert": 1, "license": 1,
}
# Literals that are placeholders.
PLACEHOLDERS = {
    "true", "false", "null", "none", "undefined", "example", "changeme", "change_me", "password",
    "secret", "token", "your_password", "your_token", "xxxxxxxx", "todo", "redacted", "placeholder",
}
MIN_SCORE = 3.5
#: Under names of this score a literal may hold white space, as passphrases do.
STRONG = 3
LEAST_LITERAL = 8
#: Shorter literals of nothing but letters, one case but for the first, are words.
LONG_LETTERS = 24
#: Names under which a literal may hold white space; words that may stand before them in code.
PASS = re.compile(r"pass|pwd", re.I)
KEYWORDS = set("const let var val export set final static public private protected string str def readonly env define local declare global".split())
#: Names of a lesser score are not sensitive.
LEAST_NAME = 2

# Possessive quantifiers keep the cost linear in hostile texts.
NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
OPEN = r"(?<![A-Za-z0-9_\\])(?:(?:[bBfFrRuU]{1,2}|@|\$)(?=[\"']))?"
TRIPLE = r"(?:\"{3}(?P<t1>(?:[^\"\\]++|\\.|\"(?!\"\"))*+)\"{3}|'{3}(?P<t2>(?:[^'\\]++|\\.|'(?!''))*+)'{3})"
STRING = r"(?:\"(?P<s1>(?:[^\"\\\n]++|\\.)*+)\"|'(?P<s2>(?:[^'\\\n]++|\\.)*+)'|`(?P<s3>[^`\n]*+)`)"
PRIVATE = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"
PEM = r"(?P<pem>" + PRIVATE + r"(?!\\)(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]*-----)"
ASSIGNED = r"(?P<op>:=|=>|=(?![=~])|:(?![:/]))"
TOKEN = re.compile(
    rf"{OPEN}(?:{TRIPLE}|{STRING})|(?<![A-Za-z0-9_$.-])(?P<name>{NAME})[ \t]*+{ASSIGNED}"
    rf"|<(?P<tag>{NAME})(?:[ \t][^<>]*+)?>|(?<!\S)--(?P<flag>{NAME})[ \t]++(?=\S)",
    re.S,
)
AFTER = re.compile(rf"[ \t]*+\]?[ \t]*+{ASSIGNED}")
CHAIN = re.compile(rf"(?P<name>{NAME})[ \t]*+(?::=|=(?![=~>]))")
TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:<[^<>\n=]*+>|\[[^\[\]\n=]*+\])?[ \t]*+=(?![=~>])")
LITERAL = re.compile(rf"[\"'`]?{PEM}|{OPEN}(?:{TRIPLE}|{STRING})|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]++)", re.S)
SPACE = re.compile(r"(?:[ \t]|\\\n)*+(?:\n\s*+(?=[\"'`]|-----BEGIN ))?")
JOIN = re.compile(r"(?:\s|\\\n)*+(?:\+|\|\||\.\.|&|(?<=\s)\.(?=\s))(?:\s|\\\n)*+(?=[\"'`A-Za-z_$(])")
BESIDE = re.compile(r"[ \t]*+(?:\\\n\s*+)?(?=[bBfFrRuU]{0,2}[\"'])")
BESIDE_LINES = re.compile(r"\s*+(?=[bBfFrRuU]{0,2}[\"'])")
BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*+(?:#[^\n]*+)?\n")
COMMA = re.compile(r"\s*+,\s*+(?=[bBfFrRuU]{0,2}[\"'])")
IS_PRIVATE = re.compile(PRIVATE)
IS_NAME = re.compile(rf"{NAME}\Z")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> float:
    """Sum of the sensitive words in a name, cut at case, digits and punctuation."""
    parts = {p.lower() for p in PART.findall(name)} | {re.sub(r"[^a-z]", "", name.lower())}
    return sum(SENSITIVE.get(p, 0) for p in parts)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def is_words(value: str) -> bool:
    """Whether a literal is a word, or words joined by hyphens, dots or apostrophes: letters of one case but for the first of each."""
    parts = re.split("[-.'’_]", value.strip("-.'’_!?,;:"))
    return all(p.isalpha() and (p[1:].islower() or p.isupper() or len(p) == 1) for p in parts if p)


def literal_score(value: str, spaced: bool = False) -> float:
    """0 for placeholders, short or repeated values, words, addresses of pages, and wordy ones unless ``spaced``; up to 2 for random ones and private keys."""
    if IS_PRIVATE.match(value):
        return 2.0
    if len(value) < LEAST_LITERAL or "_".join(value.lower().split()) in PLACEHOLDERS or re.search(r"\$\{|\{\{|%\(", value):
        return 0.0
    if re.search(r"\s", value):
        if not spaced:
            return 0.0
    elif (len(value) < LONG_LETTERS and is_words(value)) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*+://[^@?]*+\Z", value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(2.0, max(0.0, entropy(value) - 2.0)) * (0.5 + 0.25 * min(kinds, 2))


def in_sentence(text: str, at: int) -> bool:
    """Whether a word that is no keyword leads up to ``at`` on its line."""
    begin = max(text.rfind("\n", 0, at) + 1, at - 64)
    before = text[begin:at].rstrip("\"'`$*-.")
    if not before.endswith((" ", "\t")):
        return False
    words = before.split()
    return bool(words) and words[-1].strip(",;()").isalpha() and words[-1].strip(",;()").lower() not in KEYWORDS


class Binding:
    """Targets and the value they get: its literal pieces (start, end) and the names in it."""

    __slots__ = ("names", "pieces", "refs", "at")

    def __init__(self, names: list[str], at: int) -> None:
        self.names, self.pieces, self.refs, self.at = names, [], [], at


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))


def _inside(m: re.Match) -> tuple[int, int]:
    """Span of what a string token holds; of triple-quoted ones without the blanks around it."""
    for group in ("t1", "t2"):
        if m[group] is not None:
            return _trimmed(m.string, *m.span(group))
    return m.span(next(g for g in ("s1", "s2", "s3") if m[g] is not None))


def _block(text: str, at: int, key: int, end: int) -> tuple[int, int, int]:
    """Start, end and next position of the YAML block at ``at``: its lines are indented more than the key's line."""
    line = text[text.rfind("\n", 0, key) + 1 : key]
    indent = len(line) - len(line.lstrip(" -"))
    stop = at
    while stop < end:
        close = text.find("\n", stop, end)
        close = end if close < 0 else close
        row = text[stop:close]
        if row.strip() and len(row) - len(row.lstrip(" ")) <= indent:
            break
        stop = min(close + 1, end)
    return *_trimmed(text, at, stop), stop


def _value(text: str, at: int, end: int, op: str, key: int, found: Binding) -> tuple[int, list[tuple[int, int]]]:
    """Read the value at ``at`` into ``found``: the position after it, and spans of strings in it."""
    done, held, depth = at, [], 0
    at = SPACE.match(text, at, end).end()
    if op == ":" and (m := BLOCK.match(text, at, end)):
        start, stop, after = _block(text, m.end(), key, end)
        if start < stop:
            found.pieces.append((start, stop))
        return after, held
    if op == ":" and (m := TYPE.match(text, at, end)):
        at = SPACE.match(text, m.end(), end).end()
    while m := CHAIN.match(text, at, end):
        found.names.append(m["name"])
        done = at = SPACE.match(text, m.end(), end).end()
    listed = text.startswith("[", at)
    while at < end and text[at] in "([":
        depth += 1
        more = BESIDE_LINES.match(text, at + 1, end)
        at = more.end() if more else at + 1
    while m := LITERAL.match(text, at, end):
        bare = m["bare"]
        if bare is None:
            span = m.span("pem") if m["pem"] else _inside(m)
            found.pieces.append(span)
            held.append(span)
        elif bare.endswith(":") or bare in ("+", "&", "|") or (m.end() < end and text[m.end()] in "(["):
            break  # another key, an operator, a call or a subscript
        elif IS_NAME.match(bare):
            found.refs.append((bare, m.start(), m.end()))
        else:
            found.pieces.append(m.span("bare"))
        done = at = m.end()
        if more := JOIN.match(text, at, end):
            at = more.end()
            while at < end and text[at] == "(":
                depth, at = depth + 1, at + 1
        elif listed and (more := COMMA.match(text, at, end)):
            at = more.end()
        elif bare is None and (more := (BESIDE_LINES if depth else BESIDE).match(text, at, end)):
            at = more.end()
        else:
            break
    return done, held


def bindings(text: str) -> list[Binding]:
    """The bindings of a text in order, those inside strings after those around them."""
    found: list[Binding] = []
    ranges = [(0, len(text))]
    for begin, end in ranges:  # grows by what strings hold
        at = begin
        while m := TOKEN.search(text, at, end):
            at, name, op = m.end(), m["name"] or m["flag"], m["op"]
            inner: list[tuple[int, int]] = []
            if m["tag"]:
                close = text.find("<", at, end)
                if text.startswith(f"</{m['tag']}", close) and text[at:close].strip():
                    whole = Binding([m["tag"]], m.start())
                    whole.pieces.append(_trimmed(text, at, close))
                    found.append(whole)
                continue
            if name is None:  # a string: a key, or text to look into
                span = _inside(m)
                after = AFTER.match(text, at, end)
                if after and ("]" not in after[0] or (m.start() > begin and text[m.start() - 1] == "[")):
                    name, op, at = text[span[0] : span[1]], after["op"], after.end()
                else:
                    inner.append(span)
            if name is not None:
                bound = Binding([name], m.start())
                at, inner = _value(text, at, end, op or " ", m.start(), bound)
                if bound.pieces or bound.refs:
                    found.append(bound)
            ranges += [x for x in inner if x != (begin, end) and any(c in text[x[0] : x[1]] for c in "=:")]
    return found


def named_literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals that reach a sensitive name, with their best score."""
    found = bindings(text)
    places: dict[str, list[int]] = {}
    for i, bound in enumerate(found):
        for name in bound.names:
            places.setdefault(name, []).append(i)
    own = [max(map(name_score, bound.names)) for bound in found]
    reach: dict[int, tuple[float, bool]] = {}
    pieces = [list(bound.pieces) for bound in found]
    for first in sorted(range(len(found)), key=lambda i: -own[i]):
        if own[first] < LEAST_NAME:
            break
        todo = [first]
        while todo:
            i = todo.pop()
            if i in reach:
                continue
            reach[i] = own[first], own[first] >= STRONG and any(map(PASS.search, found[first].names))
            for name, start, end in found[i].refs:
                at = places.get(name)
                if at is None:  # a bare word that names nothing is a literal
                    pieces[i].append((start, end))
                    continue
                k = bisect_left(at, i)
                if k:
                    todo.append(at[k - 1])
                else:
                    todo += [j for j in at[:2] if j != i][:1]
    best: dict[tuple[int, int], float] = {}
    for i, (sensitive, phrase) in reach.items():
        joined = "".join(text[a:b] for a, b in sorted(pieces[i]))
        spaced = phrase and not in_sentence(text, found[i].at)
        if (random := literal_score(joined, spaced)) >= 0.5 and sensitive + random >= MIN_SCORE:
            for span in pieces[i]:
                if span[0] < span[1]:
                    best[span] = max(best.get(span, 0.0), sensitive + random)
    return [(*span, score) for span, score in sorted(best.items())]


def may_name(text: str) -> bool:
    """Whether a text has an assignment and a part of a sensitive name at all."""
    if not any(sign in text for sign in ("=", ":", "</", "--")):
        return False
    low = text.lower()
    return any(word in low for word in SENSITIVE)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; offsets in code points."""
    text = text or ""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if may_name(text):
        spans += [(start, end, "named") for start, end, _ in named_literals(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with each run of overlapping spans replaced by ``[SECRET]``."""
    if text is None:
        return None
    out, done = [], 0
    for start, end, _ in sorted(find_secrets(text) if spans is None else spans):
        if start >= done:
            out += [text[done:start], "[SECRET]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            spans = find_secrets(text)
            base = [s for s in spans if s[2] != "named"]
            counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        yield pd.DataFrame(
            rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans"]
        ).astype({"doc_id": "Int64"})


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text), whole texts.

    Returns ``doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans``:
    base_sha256 hashes the pattern spans, spans lists all. A null or empty
    text has none (the hash of the empty string). Repeated rows repeat; an empty
    table gives no rows.
    """
    return docs.select("doc_id", "text").mapInPandas(
        _scan,
        "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string",
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; n_chars follows if present. Null texts stay null, repeated rows repeat."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
