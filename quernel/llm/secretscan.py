"""Secret scans: patterns find candidates, structure confirms keys and signed tokens.

Base kinds are by pattern alone. Confirmed kinds are reported only after
decoding and parsing (see keys): `jwt` signed tokens, `pem`, `der64` and
`derhex` private keys. Candidates are found in one pass over the text and
the work on each is bounded, so the time is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm.common import per_row, rewritten, slim
from quernel.llm.keys import KEY_BYTES, OPENSSH, decoded64, is_private_key, is_signed_token, pem_keys

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der64", "derhex")

_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key")
#: A first part from where one may start; what follows it is only looked at, so that any part may be a first one.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11,}+)(?=\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{4,}+))")
#: Base64url of JSON that starts with white space, or has it after its brace.
_JWT_BLANK = re.compile(r"e[w-z0-9]|I[A-P]|C[Q-Za-v]|D[Q-Za-f]")
#: Base64 of a DER sequence (0x30) starts with M; of an OpenSSH key with these letters.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{38,}+={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9a-fA-F])(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)[0-9a-fA-F]{46,}+")
#: The first line of the same over several lines, and base64 of "-----BEGIN ".
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{14,}+(?=[ \t]*(?:\r?\n|\\r|\\n))")
_PEM64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n))LS0tLS1CRUdJTi")
_RUN = re.compile(r"[A-Za-z0-9+/]+")
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/])")
_PADDING = re.compile(r"={0,2}")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost without overlap in each kind."""
    if _ASSIGN_HINT.search(text.lower() if text.isascii() else text.translate(_LOWER)):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield "assign", *m.span()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", *m.span()
    for m in HEX.finditer(text):
        yield "hex", *m.span()


_LOWER = {c: c + 32 for c in range(65, 91)}


class Lines64:
    """Base64 over several lines: from a place on, the characters of all runs that line breaks alone part.

    The runs of a text are found once, from the first place that is asked for.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.before, self.last = text, [], [], [0], []
        self.joined = ""

    def _scan(self, start: int) -> None:
        first, parts, m = 0, [], _RUN.search(self.text, start)
        while m:
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.before.append(self.before[-1] + m.end() - m.start())
            parts.append(m[0])
            if b := _BREAK.match(self.text, m.end()):
                m = _RUN.match(self.text, b.end())
                continue
            self.last += [len(self.starts) - 1] * (len(self.starts) - first)
            first = len(self.starts)
            m = _RUN.search(self.text, m.end())
        self.last += [len(self.starts) - 1] * (len(self.starts) - first)
        self.joined = "".join(parts)

    def take(self, start: int, most: int, whole: bool = False) -> tuple[str, int]:
        """Up to `most` characters from `start` on, and where in the text they end (the run of the last one, if whole)."""
        if not self.starts or start < self.starts[0]:
            self.__init__(self.text)
            self._scan(start)
        i = bisect_right(self.starts, start) - 1
        at = self.before[i] + start - self.starts[i]
        to = min(at + most, self.before[self.last[i] + 1])
        run = bisect_right(self.before, to - 1) - 1
        return self.joined[at:to], self.ends[run] if whole else self.starts[run] + to - self.before[run]


def key_bytes(head: bytes) -> int | None:
    """Length of a whole encoding, as its first bytes tell: of DER, or of an OpenSSH key."""
    if head.startswith(OPENSSH):
        at = len(OPENSSH)
        for left in (3, None, 1):  # cipher, kdf and its options; public keys; private ones
            if left is None:
                left, at = int.from_bytes(head[at : at + 4], "big"), at + 4
                if left > 16:
                    return None
            for _ in range(left):
                if at + 4 > len(head):
                    return None
                at += 4 + int.from_bytes(head[at : at + 4], "big")
        return at
    k = head[1] & 0x7F if len(head) >= 8 and head[1] & 0x80 else 0
    if head[:1] != b"0" or len(head) < 8 or k > 3 or head[2 + k] not in (0x02, 0x30):
        return None
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if k else 2 + head[1]


def _wrapped_end(text: str, lines: Lines64, start: int) -> int | None:
    """Where a key's base64 over several lines ends, if one starts here: its own lengths tell."""
    ssh = text.startswith("b3Blb", start)
    head = decoded64(text[start : start + 12]) if not ssh else decoded64((x := lines.take(start, 2 * KEY_BYTES)[0])[: len(x) // 4 * 4])
    n = key_bytes(head or b"")
    if not n or n > KEY_BYTES:
        return None
    need = -(-n * 4 // 3)
    chars, end = lines.take(start, need)
    if len(chars) < need or "\n" not in text[start:end] and "\\n" not in text[start:end] or not is_private_key(decoded64(chars)):
        return None
    return _PADDING.match(text, end).end()


def _pem64_end(text: str, lines: Lines64, start: int, following: int) -> int | None:
    """Where base64 of PEM blocks ends behind the last private key in it, before the next base64 of PEM."""
    chars, _ = lines.take(start, following - start)
    whole = len(chars) // 4 * 4
    data = (decoded64(chars[:whole]) or b"") + (decoded64(chars[whole:]) or b"")
    ends = [end for _, end in pem_keys(data.decode("latin-1"))]
    if not ends:
        return None
    tail = ends[-1] + len(data[ends[-1] :]) - len(data[ends[-1] :].lstrip(b"\r\n"))
    return _PADDING.match(text, lines.take(start, min(len(chars), -(-tail * 4 // 3)), whole=True)[1]).end()


def tokens(text: str) -> Iterator[tuple[int, int]]:
    for m in _JWT.finditer(text):
        at = m[1].find("eyJ")
        if at < 0:
            if not _JWT_BLANK.match(m[1]):
                continue
            at = 0
        if is_signed_token(m[1][at:], m[2], m[3]):
            yield m.start() + at, m.end(3)


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what structure confirms. A key in PEM isn't reported again as the base64 inside."""
    for start, end in tokens(text):
        yield "jwt", start, end
    pems = list(pem_keys(text)) if "PRIVATE KEY-----" in text else []
    for start, end in pems:
        yield "pem", start, end
    lines = Lines64(text)
    if "LS0tLS1CRUdJTi" in text:
        done, places = 0, [m.start() for m in _PEM64.finditer(text)]
        for start, following in zip(places, [*places[1:], len(text)], strict=True):
            if start >= done and (end := _pem64_end(text, lines, start, following)):
                done = end
                yield "pem", start, end
    wrapped, done = set(), 0
    pem_starts = [start for start, _ in pems]
    for m in _WRAPPED.finditer(text):
        i = bisect_right(pem_starts, m.start()) - 1
        if m.start() >= done and not (i >= 0 and m.start() < pems[i][1]) and (end := _wrapped_end(text, lines, m.start())):
            wrapped.add(m.start())
            done = end
            yield "der64", m.start(), end
    for m in _BASE64.finditer(text):
        if m.start() not in wrapped and is_private_key(decoded64(m[0])):
            yield "der64", *m.span()
    for m in _HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and len(m[0]) <= 2 * KEY_BYTES and is_private_key(bytes.fromhex(m[0])):
            yield "derhex", *m.span()


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as KINDS lists them, then end. None in a null or empty text."""
    if not text:
        return []
    found = [*base_spans(text), *confirmed_spans(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


_SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """The secrets of every whole text.

    A null or empty text has none (and the digest of the empty string). Null
    doc_ids and repeated rows pass through; an empty table gives no rows.
    """

    def of(doc_id, text):
        found = spans(text)
        base = [s for s in found if s[0] in KINDS[:3]]
        kinds = [s[0] for s in base]
        return doc_id, *(kinds.count(k) for k in KINDS[:3]), sha256(listed(base).encode()).hexdigest(), listed(found)

    return per_row(slim(docs), lambda: of, _SCAN, SCAN_SCHEMA)


MASK = "[secret]"


def masked(text: str | None) -> str | None:
    """The text with each secret, or run of overlapping ones, replaced by MASK."""
    found = spans(text)
    if not found:
        return text
    parts, at = [], 0
    for _, start, end in found:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs, same columns, with the secrets of text masked (and n_chars, if there, counted anew where it changed).

    Null and empty texts stay as they are; repeated rows repeat, and other
    columns pass through. An empty table gives no rows.
    """

    def clean(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index("text")
        texts = part.column(at).to_pylist()
        new = [masked(t) for t in texts]
        changed = [i for i, (a, b) in enumerate(zip(texts, new, strict=True)) if a is not b]
        if not changed:
            return part
        part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
        if (at := part.schema.get_field_index("n_chars")) >= 0:
            counts = part.column(at).to_pylist()
            for i in changed:
                counts[i] = len(new[i])
            part = part.set_column(at, part.schema.field(at), pa.array(counts, part.schema.field(at).type))
        return part

    return rewritten(docs, clean)
