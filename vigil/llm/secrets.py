"""Operator 9: secrets, with structural confirmation of encoded candidates.

The base finds assignments, access key ids and long hexadecimal runs by pattern.
The method then takes base64 and hexadecimal candidates, decodes them, and reports
those whose content is a key: a signed token whose header is JSON with an
algorithm, a DER structure whose nested lengths all fit, or an SSH key whose
length-prefixed fields do. Candidates run over line breaks, also escaped ones as in JSON
or code, where all lines but the last have one length; within a PEM frame lines may have
any length; hexadecimal bytes may be parted by colons. These spans are added; base spans stay.

Edge cases: null and empty texts have no spans; whole texts are read whatever
their length; equal rows give equal results, one each; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.spans import Span, Taken, joined, mapper, sha256

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, _WORDS[:4])) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_MORE = re.compile(r"[A-Za-z0-9+/_-]++")
_BREAK = re.compile(r"(?:\\r\\n|\\n|\\r|\r\n|\n|\r)[\x20\t]*+")
_PADDING = re.compile(r"={0,2}")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::\s*+[0-9A-Fa-f]{2}){23,}+(?![0-9A-Fa-f])")
_HEXADECIMAL = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_FRAMED = re.compile(r"\\[rnt]|[\s\"',\\]+")
LEAST = 24  # letters of a candidate
_SSH_KINDS = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _longest_word(text) >= 24:
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return spans


def _longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def unbase64(text: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, length = data[at], data[at + 1]
    at += 2
    if length >= 0x80:
        count = length & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        length = int.from_bytes(data[at : at + count], "big")
        if length < 0x80:
            return None
        at += count
    return None if at + length > end else (tag, at, at + length)


def is_der(data: bytes) -> bool:
    """Whether all of ``data`` is one DER sequence with an integer or object id in it."""
    first = _element(data, 0, len(data))
    if first is None or first[0] != 0x30 or first[2] != len(data) or len(data) < 16:
        return False
    useful, todo = False, [first]
    while todo:
        _, at, end = todo.pop()
        while at < end:
            inner = _element(data, at, end)
            if inner is None or inner[0] & 0x1F == 0x1F:
                return False
            tag, start, stop = inner
            useful |= tag in (0x02, 0x06) and stop > start
            if tag & 0x20:
                todo.append(inner)
            at = stop
    return useful


def _fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int]:
    """Length-prefixed fields from ``at`` on, ``most`` at most, and where they end; the first that doesn't fit ends them."""
    found: list[bytes] = []
    while at + 4 <= len(data) and (most is None or len(found) < most):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            break
        found.append(data[at + 4 : end])
        at = end
    return found, at


def is_public_key(data: bytes) -> bool:
    """Length-prefixed fields, of which the first names a key type."""
    fields, end = _fields(data)
    return end == len(data) and len(fields) >= 2 and fields[0] in _SSH_KINDS


_MAGIC = b"openssh-key-v1\0"


def is_private_key(data: bytes) -> bool:
    """The magic, cipher, derivation and its options, a count, that many public keys, and the private part in blocks of eight."""
    if not data.startswith(_MAGIC):
        return False
    names, at = _fields(data, len(_MAGIC), 3)
    count = int.from_bytes(data[at : at + 4], "big")
    if len(names) < 3 or not names[0].isascii() or not 1 <= count <= 64 or at + 4 > len(data):
        return False
    parts, end = _fields(data, at + 4, count + 1)
    return end == len(data) and len(parts) == count + 1 and all(map(is_public_key, parts[:-1])) and 0 < len(parts[-1]) and len(parts[-1]) % 8 == 0


def is_ssh(data: bytes) -> bool:
    return is_private_key(data) or is_public_key(data)


def is_signed_token(header: str, payload: str) -> bool:
    decoded = [unbase64(header), unbase64(payload)]
    try:
        parsed = [json.loads(x) for x in decoded if x is not None]
    except (ValueError, RecursionError):
        return False
    return len(parsed) == 2 and isinstance(parsed[0], dict) and isinstance(parsed[0].get("alg"), str) and isinstance(parsed[1], dict)


def framed(text: str) -> Iterator[tuple[int, int, str]]:
    """Place and content of PEM frames; a frame ends at the next dashes."""
    for m in _BEGIN.finditer(text):
        end = text.find("-----", m.end())
        mark = f"-----END {m[1]}-----"
        if end >= 0 and text.startswith(mark, end):
            yield m.start(), end + len(mark), _FRAMED.sub("", text[m.end() : end])


def runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Readings of each run of base64 or hexadecimal letters, the longest first.

    A run goes on over a line break while lines have the length of the first; the line
    after them may be shorter, or else is other text.
    """
    done = 0
    for m in _LINE.finditer(text):
        if m.start() < done:
            continue
        size, parts, ends = len(m[0]), [m[0]], [m.end()]
        while len(parts[-1]) == size:
            gap = _BREAK.match(text, ends[-1])
            more = _MORE.match(text, gap.end()) if gap else None
            if more is None or len(more[0]) > size:
                break
            parts.append(more[0])
            ends.append(more.end())
        done = ends[-1]
        readings = []
        for n in dict.fromkeys((len(parts), len(parts) - (len(parts[-1]) < size), 1)):
            whole = "".join(parts[:n])
            if n and len(whole) >= LEAST:
                padding = _PADDING.match(text, ends[n - 1])
                readings.append((m.start(), padding.end(), whole + padding[0]))
        if readings:
            yield readings


def _kind(letters: str) -> str | None:
    """What the letters encode, as hexadecimal or as base64."""
    data = [bytes.fromhex(letters)] if _HEXADECIMAL.fullmatch(letters) else []
    data += [x for x in [unbase64(letters)] if x is not None]
    return next((kind for x in data for kind, test in (("der", is_der), ("ssh", is_ssh)) if test(x)), None)


def confirmed_spans(text: str) -> list[Span]:
    """Spans of candidates whose decoded structure was parsed."""
    spans: list[Span] = []
    taken = Taken()

    def report(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end))
        taken.add(start, end)

    if "-----BEGIN " in text:
        for start, end, letters in framed(text):
            if _kind(letters):
                report("pem", start, end)
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            if taken.free(*m.span()) and is_signed_token(m[1], m[2]):
                report("jwt", *m.span())
    if _longest_word(text) < 16:
        return spans
    for m in _COLONS.finditer(text):
        data = bytes.fromhex("".join(c for c in m[0] if c.isalnum()))
        kind = "der" if is_der(data) else "ssh" if is_ssh(data) else None
        if kind and taken.free(*m.span()):
            report(kind, *m.span())
    for readings in runs(text):
        for start, end, letters in readings:
            kind = _kind(letters) if taken.free(start, end) else None
            if kind:
                report(kind, start, end)
                break
    return spans


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _row(text: str) -> tuple:
    base = base_spans(text)
    counts = [sum(kind == s[0] for s in base) for kind in BASE_KINDS]
    return (*counts, sha256(joined(base, BASE_KINDS)), joined(base + confirmed_spans(text), KINDS))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans. A map over the rows, with no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapper(_row, _SCHEMA), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
