"""Secrets in texts: fixed token shapes, and literals assigned to sensitive names.

The base spans follow three fixed patterns. On top of them an assignment-aware lexer reads source
and configuration syntax (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``export NAME=literal``, ``name := literal``, ``name: type = literal``) into pairs of a name and a
literal, follows names that are assigned from other names anywhere in the text (also ``$NAME`` and
``${NAME}``), and scores every literal by the names it reaches.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.llm.common import struct_udf, value_udf

Span = tuple[int, int, str]

KINDS = ("assign", "access", "hex", "literal")

# The patterns of the base spans.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A name, and what stands right of its sign: a quoted literal or a bare word.
NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*)["']?[\x20\t]*\Z""")
VALUE = re.compile(
    r"""[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|(\$\{[A-Za-z_]\w*\}|[^\s"'`,;(){}\[\]<>]+))"""
)
SIGN = re.compile(r":=|=>|[:=](?![:=])")
# The type of a declared name, between its colon and the sign of its literal.
TYPE = re.compile(r"""[\x20\t]*[&*]?[A-Za-z_'][\w.|?&*<>\[\],'\x20\t]{0,80}=(?![=>])""")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))\Z")
WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LONGEST_NAME = 128

# How strongly a part of a name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "token": 0.9, "bearer": 0.7,
    "auth": 0.6, "private": 0.5, "access": 0.4, "key": 0.5, "signature": 0.4, "salt": 0.4,
    # Neighbouring parts that say more together.
    "encryptionkey": 1.0, "decryptionkey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0,
    "masterkey": 1.0, "cipherkey": 1.0, "hmackey": 1.0, "aeskey": 1.0, "sshkey": 1.0, "licensekey": 0.9,
}
# Literals that only stand for a secret.
PLACEHOLDERS = {"changeme", "example", "placeholder", "undefined", "required", "optional"}
THRESHOLD = 0.75


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target name is; its parts add up, unless two neighbours say more."""
    parts = [w.lower() for w in WORDS_OF_NAME.findall(name)]
    pairs = [SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.0, max([sum(SENSITIVE.get(p, 0.0) for p in parts), *pairs]))


def literal_score(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret value."""
    lowered = literal.lower()
    if len(literal) < 6 or lowered in PLACEHOLDERS or len(set(literal)) < 4:
        return 0.0
    return min(1.0, entropy(literal) / 3.0)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: (start, end, kind), code points, end exclusive."""
    found: list[Span] = []
    lowered = text.lower()
    if any(stem in lowered for stem in STEMS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def assignments(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """The (name, value, start, end, quoted) of every assignment; the span is the value's.

    A name longer than ``LONGEST_NAME`` is read by its last characters. A type between name and
    literal is neither.
    """
    read = 0
    for sign in SIGN.finditer(text):
        if sign.start() < read:
            continue  # the second sign of a typed declaration
        value = VALUE.match(text, sign.end())
        kind = TYPE.match(text, sign.end()) if sign[0] == ":" else None
        if kind and (typed := VALUE.match(text, kind.end())):
            # Without quotes it may be a value with an equals sign in it.
            if typed.lastindex < 4 or text[kind.end() - 2] in " \t":
                value, read = typed, kind.end()
        if value is None:
            continue
        name = NAME.search(text[max(0, sign.start() - LONGEST_NAME) : sign.start()])
        if name:
            group = value.lastindex
            yield name[1], value[group], *value.span(group), group < 4


def reference(value: str, quoted: bool) -> str | None:
    """The name that a value refers to: a bare name, ``$NAME`` or ``${NAME}``."""
    found = REFERENCE.match(value)
    if found:
        return found[1] or found[2]
    return value if not quoted and IDENTIFIER.match(value) else None


def literal_spans(text: str) -> list[Span]:
    """Spans of the literals whose names, direct or by way of constants, are sensitive.

    A name stands for its last definition before the use, or else for the first one after it.
    """
    if "=" not in text and ":" not in text:
        return []
    rows = list(assignments(text))
    defined: dict[str, list[int]] = {}
    for i, (name, *_) in enumerate(rows):
        defined.setdefault(name, []).append(i)
    ends: dict[int, int] = {}  # the row whose literal a row stands for

    def end_of(i: int) -> int:
        path: list[int] = []
        on_path: set[int] = set()
        while i not in ends and i not in on_path:
            path.append(i)
            on_path.add(i)
            _, value, _, _, quoted = rows[i]
            places = defined.get(reference(value, quoted) or "", [])
            at = bisect_left(places, i)
            if at:
                i = places[at - 1]
            elif any(p != i for p in places[:2]):
                i = next(p for p in places[:2] if p != i)
        last = ends.get(i, i)
        ends.update(dict.fromkeys(path, last))
        return last

    found: set[Span] = set()
    for i, (name, *_) in enumerate(rows):
        weight = name_score(name)
        if weight:
            _, literal, a, b, quoted = rows[end_of(i)]
            unknown = literal.startswith("${") and reference(literal, quoted)
            if not unknown and weight * literal_score(literal) >= THRESHOLD:
                found.add((a, b, "literal"))
    return list(found)


def spans_of(text: str) -> list[Span]:
    """Base and literal spans by start, then kind."""
    both = base_spans(text) + literal_spans(text)
    return sorted(both, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` of the spans, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span], mask: str = "[REDACTED]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mask."""
    out, at, reach = [], 0, -1
    for start, end, _ in sorted(spans):
        if start >= reach:
            out += [text[at:start], mask] if start >= at else [mask]
        reach = max(reach, end)
        at = max(at, end)
    return "".join([*out, text[at:]])


FIELDS = {
    "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string",
    "spans": "string", "n_literal": "bigint",
}


def summary(text: str) -> tuple[int, int, int, str, str, int]:
    """The values of ``FIELDS`` for one text."""
    spans = spans_of(text)
    kinds = Counter(kind for _, _, kind in spans)
    base = joined([s for s in spans if s[2] != "literal"])
    digest = hashlib.sha256(base.encode()).hexdigest()
    return kinds["assign"], kinds["access"], kinds["hex"], digest, joined(spans), kinds["literal"]


def find_secrets(df: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """``df`` with a struct column of counts, spans and the digest of the base spans.

    Null and empty texts have no spans. Texts are read whole; repeated rows give repeated results.
    Every row stands for itself, so nothing is shuffled.
    """
    scan = struct_udf(FIELDS, lambda: summary)
    return df.withColumn(out, scan(F.coalesce(F.col(text), F.lit(""))))


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all secrets in its texts masked; null stays null, clean texts stay as they are."""
    mask = value_udf("string", lambda: lambda t: None if t is None else redacted(t, spans_of(t)))
    return df.withColumn(text, mask(F.col(text)))
