"""Secret scan: fixed patterns, plus assignments lexed from source and configuration text."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns: name, separator and literal; key id; long hex run.
_NAMES = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
# every base name holds one of these
_HINTS = ("passw", "secret", "token", "api_key", "apikey")

KINDS = ("assign", "access", "hex", "literal", "constant")

# Parts of names that hold secrets, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "auth": 0.6, "bearer": 0.7,
    "key": 0.55, "salt": 0.55, "cookie": 0.55, "dsn": 0.55, "pin": 0.8,
}
# Literals that stand for a secret and are none.
PLACEHOLDERS = {
    "changeme", "change_me", "example", "placeholder", "password", "passwd", "secret", "token", "none", "null", "true", "false", "undefined",
    "redacted", "dummy", "default", "string", "your_password", "your_token", "your_api_key", "yourpassword",
}
LEAST_SCORE = 0.5
LEAST_CHARS = 6
# characters of a joined value that are looked at as they stand; of the rest only their counts
HEAD_CHARS = 64
# counts of characters are scaled down beyond this, so constants that double stay numbers
MANY = 1e200

_LEX = re.compile(
    r"""(?P<comment>\#(?![0-9A-Fa-f]{3,8}\b)|//(?=\x20))
      |(?P<text>'''(?s:.*?)'''|\"\"\"(?s:.*?)\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
      |(?P<use>\$\{[A-Za-z_][\w.-]*\}|\$\([A-Za-z_][\w.-]*\)|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%)
      |(?P<op>:=|=>|==|!=|<=|>=|::|:(?!//)|=)
      |(?P<plus>\+|\.\.)
      |(?P<word>[A-Za-z0-9_][\w./+@~-]*)
      |(?P<line>\n|;)
      |(?P<other>[^\s])""",
    re.VERBOSE,
)
# a bare value runs to the next space or closing mark
_BARE = re.compile(r"[^\s,;)\]}\"'`]+")
_PADDING = re.compile(r"={1,2}(?=[\s,;)\]}\"'`]|\Z)")
_PHRASE = re.compile(r"[^\n;#,\]}\"'`]+")
# a slash, then plain words between slashes and dots
_PATH = re.compile(r"/(?:[a-z0-9_.-]+|[A-Z][A-Z_]*|[A-Z]?[a-z_]+)(?:/[\w.-]*)*")
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Part:
    """A literal with its place, or a name that stands for one."""

    value: str
    start: int
    end: int
    name: bool = False


@dataclass(frozen=True)
class Pair:
    name: str
    at: int
    parts: tuple[Part, ...]


def _tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    for m in _LEX.finditer(text):
        yield m.lastgroup, m.group(), m.start(), m.end()


def _literal(kind: str, raw: str, start: int, end: int) -> Part | None:
    if kind == "text":
        quote = 3 if raw[:3] in ("'''", '"""') else 1
        return Part(raw[quote:-quote], start + quote, end - quote)
    if kind == "use":
        return Part(raw.strip("${}()%"), start, end, name=True)
    return Part(raw, start, end, name=bool(re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", raw)))


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in order: ``name op value (+ value)*`` with a type between (``name: type = value``) skipped.

    Names may be quoted or dotted; values are quoted texts, bare words, and uses such as ``${NAME}`` or plain names.
    """
    out: list[Pair] = []
    stack: list[tuple[str, str, int, int]] = []  # the last tokens of the line, at most two are looked at
    stream = list(_tokens(text))
    i, n, n_text = 0, len(stream), len(text)
    while i < n:
        kind, raw, start, end = stream[i]
        if kind == "line":
            stack.clear()
        elif kind == "op" and raw in (":", "=", ":=", "=>") and stack and stack[-1][0] in ("word", "text"):
            name = _literal(*stack[-1])
            j = i + 1
            # name: type = value
            if raw == ":" and j + 1 < n and stream[j][0] == "word" and stream[j + 1][:2] == ("op", "="):
                j += 2
            parts: list[Part] = []
            if j < n and stream[j][:2] == ("other", "/"):
                # a bare value may start with a slash
                begin, end = _BARE.match(text, stream[j][2]).span()
                parts.append(Part(text[begin:end], begin, end))
                while j < n and stream[j][2] < end:
                    j += 1
            slashed = bool(parts)
            while not slashed and j < n and stream[j][0] in ("text", "use", "word"):
                part = _literal(*stream[j])
                if stream[j][0] == "word" and stream[j][3] < n_text and (text[stream[j][3]] in "&%^!*$" or _PADDING.match(text, stream[j][3])):
                    end = _BARE.match(text, stream[j][2]).end()
                    part = Part(text[stream[j][2] : end], stream[j][2], end)
                elif stream[j][0] == "word" and not parts and "passphrase" in name.value.lower():
                    # several bare words are one phrase
                    phrase = _PHRASE.match(text, stream[j][2]).group().rstrip()
                    if " " in phrase:
                        part = Part(phrase, stream[j][2], stream[j][2] + len(phrase))
                parts.append(part)
                j += 1
                while j < n and stream[j][2] < part.end:
                    j += 1
                if j < n and stream[j][0] == "plus":
                    j += 1
                    continue
                if j < n and stream[j][0] == "use" and stream[j][2] == stream[j - 1][3]:
                    continue
                break
            if parts and name is not None:
                out.append(Pair(name.value, start, tuple(parts)))
            # the value may itself be a name: key = other = value
            stack = [stream[j - 1]] if j > i + 1 else []
            i = max(j, i + 1)
            continue
        elif kind != "comment":
            stack = stack[-1:] + [(kind, raw, start, end)]
        i += 1
    return out


def name_score(name: str) -> float:
    """How much the target name speaks of a secret: the best weight of its parts and of neighbouring parts joined."""
    parts = [p.lower() for p in _SPLIT_NAME.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


@dataclass(frozen=True)
class Value:
    """What is known of a value that several parts may make up: its first characters, and how often each character occurs."""

    head: str
    size: float
    counts: dict[str, float]
    bare: bool  # nothing but names: no literal is known

    @staticmethod
    def of(text: str, bare: bool = False) -> Value:
        return Value(text[:HEAD_CHARS], float(len(text)), {c: float(n) for c, n in Counter(text).items()}, bare)

    def __add__(self, other: Value) -> Value:
        counts = dict(self.counts)
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0.0) + n
        size = self.size + other.size
        if size > MANY:
            size, counts = size / MANY, {c: n / MANY for c, n in counts.items()}
        head = self.head if len(self.head) >= HEAD_CHARS else (self.head + other.head)[:HEAD_CHARS]
        return Value(head, max(size, float(len(head))), counts, self.bare and other.bare)


def literal_score(value: Value, phrase: bool = False) -> float:
    """How much a literal looks like a secret: varied characters of several kinds, no placeholder, no path or link, and no sentence
    unless it is a passphrase."""
    low = value.head.lower()
    if value.size < LEAST_CHARS or low in PLACEHOLDERS or low.startswith(("<", "${", "{{", "http://", "https://", "./")) or len(value.counts) <= 2:
        return 0.0
    if value.head.startswith("/") and _PATH.fullmatch(value.head):
        return 0.0
    if value.counts.get(" ", 0) > 4 and not phrase:
        return 0.0
    total = sum(value.counts.values())
    bits = -sum(c / total * math.log2(c / total) for c in value.counts.values() if c > 0)
    chars = "".join(value.counts)
    kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.35 + 0.1 * kinds + 0.08 * bits)


class Constants:
    """What names stand for in one text: what a name was given last before its use, or else first after it.

    Each pair is worked out once, however many names lead to it, and joined values are never built: a text of n pairs takes
    steps in proportion to n, also where constants double.
    """

    def __init__(self, found: list[Pair]) -> None:
        self.found = found
        self.given: dict[str, list[int]] = {}
        for i, p in enumerate(found):
            self.given.setdefault(p.name, []).append(i)
        self.values: dict[int, Value] = {}

    def target(self, i: int, part: Part) -> int | None:
        places = self.given.get(part.value) if part.name else None
        if not places:
            return None
        k = bisect_left(places, i)
        if k > 0:
            return places[k - 1]
        k = bisect_right(places, i)
        return places[k] if k < len(places) else None

    def value(self, i: int) -> Value:
        """The value of a pair; a name that leads back to a pair it is part of counts as its own spelling."""
        open_: set[int] = set()
        stack = [(i, False)]
        while stack:
            k, done = stack.pop()
            if k in self.values:
                continue
            parts = self.found[k].parts
            if not done:
                open_.add(k)
                stack.append((k, True))
                targets = {self.target(k, p) for p in parts} - {None}
                stack.extend((t, False) for t in targets if t not in open_ and t not in self.values)
                continue
            made = None
            for p in parts:
                t = self.target(k, p)
                one = self.values[t] if t in self.values else Value.of(p.value, p.name)
                made = one if made is None else made + one
            self.values[k] = made
            open_.discard(k)
        return self.values[i]

    def literals(self, starts: list[int]) -> set[tuple[int, int, str]]:
        """Spans of the literals that the given pairs lead to; those of other pairs are constants."""
        spans: set[tuple[int, int, str]] = set()
        seen, stack = set(starts), [(i, "literal") for i in starts]
        first = set(starts)
        while stack:
            i, kind = stack.pop()
            for p in self.found[i].parts:
                t = self.target(i, p)
                if t is None or t == i:
                    if p.end > p.start:
                        spans.add((p.start, p.end, kind))
                elif t not in seen or (t in first and kind == "literal"):
                    if t in first:
                        first.discard(t)  # also reached through a name: its literals are constants too
                    seen.add(t)
                    stack.append((t, "constant"))
        # a place is reported once, as a constant if any name led to it
        return {s for s in spans if s[2] == "constant" or (s[0], s[1], "constant") not in spans}


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of literals that sensitive names get, directly or through constants.

    A chain of names is followed to its literals, and those are the spans (kind ``constant``).
    """
    if "=" not in text and ":" not in text:
        return []
    found = pairs(text)
    constants = Constants(found)
    starts = []
    for i, pair in enumerate(found):
        weight = name_score(pair.name)
        if weight <= 0.0:
            continue
        value = constants.value(i)
        looks = literal_score(value, "passphrase" in pair.name.lower()) * (0.6 if value.bare and not any(ch.isdigit() for ch in value.counts) else 1.0)
        if weight * looks >= LEAST_SCORE:
            starts.append(i)
    return sorted(constants.literals(starts))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _NAMES.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def ordered(spans: list[tuple[int, int, str]]) -> str:
    rows = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in rows)


def scan_text(text: str | None) -> tuple[int, int, int, int, int, str, str]:
    """Counts per kind, the digest of the base spans, and all spans as text; lexed spans inside a base span add nothing."""
    text = text or ""
    base = base_spans(text)
    begins = sorted((a, b) for a, b, _ in base)
    reach = list(accumulate((b for _, b in begins), max))  # how far the spans up to each one reach
    inside = lambda s: (k := bisect_right(begins, (s[0], math.inf))) > 0 and s[1] <= reach[k - 1]
    extra = [s for s in lexed_spans(text) if not inside(s)]
    kinds = Counter(s[2] for s in base + extra)
    digest = hashlib.sha256(ordered(base).encode()).hexdigest()
    return (*(kinds.get(k, 0) for k in KINDS), digest, ordered(base + extra))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, counts per kind, ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined).

    Whole texts are scanned, each in time in proportion to its length; positions are code points, ends exclusive. A null text
    counts as empty and has no spans; repeated rows give repeated results, null keys stay, other columns are ignored, and an
    empty table gives an empty result.
    """
    names = ["n_assign", "n_access", "n_hex", "n_literal", "n_constant", "base_sha256", "spans"]
    kinds = ["long"] * 5 + ["string"] * 2

    @F.pandas_udf(", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_text(t) for t in texts], columns=names)

    return docs.select(F.col(key), scanned(F.col(text)).alias("s")).select(key, "s.*")
