"""Encodings of private keys, read to their last length: DER, OpenSSH, PEM, and signed tokens.

Each reader knows the fields it may find and takes all bytes or none. The work
on a candidate is bounded by its fields, however long it is or nested it claims
to be.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

#: No private key's encoding is longer.
KEY_BYTES = 1 << 14
OPENSSH = b"openssh-key-v1\0"


class Malformed(ValueError):
    """The bytes are not what the reader reads."""


def oid(dotted: str) -> bytes:
    """Content of a DER object identifier."""
    first, second, *rest = map(int, dotted.split("."))
    out = b""
    for arc in (40 * first + second, *rest):
        groups = [arc & 0x7F]
        while arc := arc >> 7:
            groups.append(0x80 | arc & 0x7F)
        out += bytes(reversed(groups))
    return out


#: Algorithms of private keys, by what their key octets hold.
RSA = {oid("1.2.840.113549.1.1.1"), oid("1.2.840.113549.1.1.10")}
EC = {oid("1.2.840.10045.2.1")}
NUMBER = {oid("1.2.840.10040.4.1"), oid("1.2.840.113549.1.3.1"), oid("1.2.840.10046.2.1")}  # DSA, Diffie-Hellman
OCTETS = {oid("1.3.101.110"): 32, oid("1.3.101.111"): 56, oid("1.3.101.112"): 32, oid("1.3.101.113"): 57}
#: Password-based encryption; the last eight take a salt and a number of rounds.
PBES2 = oid("1.2.840.113549.1.5.13")
KDFS = {oid("1.2.840.113549.1.5.12"), oid("1.3.6.1.4.1.11591.4.11")}
PBES1 = {oid(f"1.2.840.113549.1.5.{i}") for i in (1, 3, 4, 6, 10, 11)} | {oid(f"1.2.840.113549.1.12.1.{i}") for i in range(1, 7)}
#: Strings of a public and of a private key by OpenSSH's name of its type, the name and comment included.
SSH_STRINGS = {b"ssh-rsa": (3, 8), b"ssh-dss": (5, 7), b"ssh-ed25519": (2, 4), **{b"ecdsa-sha2-nistp" + n: (3, 5) for n in (b"256", b"384", b"521")}}


def items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the DER items that fill `data`; no more than 16, as no key has more side by side."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(found) == 16:
            raise Malformed
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or not data[at]:
                raise Malformed
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                raise Malformed
        if at + n > len(data):
            raise Malformed
        found.append((tag, data[at : at + n]))
        at += n
    return found


def nested(content: bytes) -> None:
    """Every length inside is right; for parameters of few kinds, so their size is bounded."""
    if len(content) > 2048:
        raise Malformed
    ends, at = [len(content)], 0
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        if at + 2 > ends[-1]:
            raise Malformed
        tag, n = content[at], content[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 2 or at + k > ends[-1]:
                raise Malformed
            n, at = int.from_bytes(content[at : at + k], "big"), at + k
        if at + n > ends[-1]:
            raise Malformed
        if tag & 0x20:
            ends.append(at + n)
        else:
            at += n


def _need(condition: object) -> None:
    if not condition:
        raise Malformed


def _number(item: tuple[int, bytes]) -> int:
    """A DER integer, not negative and without a byte too many."""
    tag, content = item
    _need(tag == 2 and content and content[0] < 0x80 and (len(content) == 1 or content[0] or content[1] & 0x80))
    return int.from_bytes(content, "big")


def _one(data: bytes, tag: int) -> bytes:
    found = items(data)
    _need(len(found) == 1 and found[0][0] == tag)
    return found[0][1]


def _rsa(fields: list[tuple[int, bytes]]) -> None:
    """Version 0 with eight numbers, or 1 with further primes."""
    version = _number(fields[0])
    _need(len(fields) == 9 + version and version <= 1)
    _need(all(_number(f) for f in fields[1:9]))
    if version:
        _need(fields[9][0] == 0x30)
        for tag, prime in items(fields[9][1]):
            _need(tag == 0x30 and len(items(prime)) == 3)


def _ec(fields: list[tuple[int, bytes]]) -> None:
    """Version 1, the number's octets, then maybe the curve and the public point."""
    _need(2 <= len(fields) <= 4 and _number(fields[0]) == 1 and fields[1][0] == 4 and 16 <= len(fields[1][1]) <= 80)
    tags = [tag for tag, _ in fields[2:]]
    _need(tags in ([], [0xA0], [0xA1], [0xA0, 0xA1]))
    for tag, content in fields[2:]:
        inner = items(content)
        _need(len(inner) == 1 and inner[0][0] in ((6, 0x30) if tag == 0xA0 else (3,)) and inner[0][1])
        if inner[0][0] == 0x30:
            nested(inner[0][1])


def _pkcs8(fields: list[tuple[int, bytes]]) -> None:
    """Version, an algorithm of private keys with its parameters, and octets that are such a key."""
    version = _number(fields[0])
    _need(version <= 1 and fields[1][0] == 0x30 and fields[2][0] == 4 and [t for t, _ in fields[3:]] in ([], [0xA0], [0x81], [0xA1], [0xA0, 0x81], [0xA0, 0xA1]))
    algorithm, key = items(fields[1][1]), fields[2][1]
    _need(1 <= len(algorithm) <= 2 and algorithm[0][0] == 6)
    name = algorithm[0][1]
    for tag, content in algorithm[1:]:
        if tag & 0x20:
            nested(content)
    if name in RSA:
        _rsa(items(_one(key, 0x30)))
    elif name in EC:
        _need(len(algorithm) == 2 and algorithm[1][0] in (6, 0x30))
        _ec(items(_one(key, 0x30)))
    elif name in NUMBER:
        _need(len(algorithm) == 2 and algorithm[1][0] == 0x30)
        _need(_number((2, _one(key, 2))))
    else:
        _need(name in OCTETS and len(algorithm) == 1 and len(_one(key, 4)) == OCTETS[name])


def _encrypted(fields: list[tuple[int, bytes]]) -> None:
    """A password-based encryption with its parameters, and whole blocks of octets."""
    _need(len(fields) == 2 and fields[1][0] == 4 and len(fields[1][1]) >= 16 and len(fields[1][1]) % 8 == 0)
    algorithm = items(fields[0][1])
    _need(len(algorithm) == 2 and algorithm[0][0] == 6 and algorithm[1][0] == 0x30)
    parameters = items(algorithm[1][1])
    _need(len(parameters) == 2)
    if algorithm[0][1] == PBES2:
        for tag, content in parameters:
            _need(tag == 0x30)
            nested(content)
        _need(items(parameters[0][1])[0] in [(6, k) for k in KDFS] and items(parameters[1][1])[0][0] == 6)
    else:
        _need(algorithm[0][1] in PBES1 and parameters[0][0] == 4 and _number(parameters[1]))


def _der(data: bytes) -> None:
    fields = items(_one(data, 0x30))
    tags = [tag for tag, _ in fields]
    if tags[:3] == [2, 0x30, 4]:
        _pkcs8(fields)
    elif tags[:2] == [2, 4]:
        _ec(fields)
    elif tags[:1] == [0x30]:
        _encrypted(fields)
    elif tags == [2] * 6:  # DSA
        _need(_number(fields[0]) == 0 and all(_number(f) for f in fields[1:]))
    else:
        _need(len(tags) >= 9)
        _rsa(fields)


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A length of four bytes and so many bytes."""
    n = int.from_bytes(data[at : at + 4], "big")
    _need(at + 4 + n <= len(data))
    return data[at + 4 : at + 4 + n], at + 4 + n


def _openssh(data: bytes) -> None:
    """Cipher, kdf and options, number of keys, public keys, and private ones: in clear read as well, else whole blocks."""
    at, head = len(OPENSSH), []
    for _ in range(3):
        value, at = _string(data, at)
        head.append(value)
    cipher, kdf, options = head
    _need(re.fullmatch(rb"[a-z0-9@.-]{3,64}", cipher) and (kdf, options, cipher) == (b"none", b"", b"none") or kdf == b"bcrypt" and cipher != b"none")
    if kdf == b"bcrypt":
        salt, end = _string(options, 0)
        _need(salt and end + 4 == len(options))
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    _need(1 <= n <= 16)
    names = []
    for _ in range(n):
        public, at = _string(data, at)
        name, end = _string(public, 0)
        _need(name in SSH_STRINGS)
        for _ in range(SSH_STRINGS[name][0] - 1):
            value, end = _string(public, end)
            _need(value)
        _need(end == len(public))
        names.append(name)
    secret, at = _string(data, at)
    _need(len(secret) >= 16 and len(secret) % 8 == 0)
    if cipher != b"none":
        _need(len(data) - at in (0, 16))  # a tag of the cipher's may follow
        return
    _need(at == len(data) and secret[:4] == secret[4:8])
    at = 8
    for name in names:
        for i in range(SSH_STRINGS[name][1]):
            value, at = _string(secret, at)
            _need(i or value == name)
    _need(secret[at:] == bytes(range(1, len(secret) - at + 1)))


def is_private_key(data: bytes | None) -> bool:
    """A PKCS#1, PKCS#8, encrypted PKCS#8, SEC1, DSA or OpenSSH private key, whole and with nothing after it."""
    if not data or len(data) > KEY_BYTES:
        return False
    try:
        _openssh(data) if data.startswith(OPENSSH) else _der(data)
    except (Malformed, IndexError):
        return False
    return True


def decoded64(text: str) -> bytes | None:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


_MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}?PRIVATE KEY)-----")
_LINE_END = re.compile(r"\\r|\\n|\r|\n")
_CIPHER = re.compile(r"DEK-Info: *[A-Z0-9-]{5,30},([0-9A-Fa-f]+) *\Z")


def _pem_body(body: str) -> bool:
    """Whether what stands between the marks is a key: lines of base64, after headers if it is encrypted the old way."""
    if len(body) > 2 * KEY_BYTES:
        return False
    lines = [x.strip() for x in _LINE_END.split(body)]
    headers = [x for x in lines if ":" in x]
    data = decoded64("".join(x for x in lines if ":" not in x))
    if "Proc-Type: 4,ENCRYPTED" in headers:
        vector = next((m[1] for x in headers if (m := _CIPHER.match(x))), "")
        return len(vector) in (16, 32) and bool(data) and len(data) >= 16 and len(data) % (len(vector) // 2) == 0
    return is_private_key(data)


def pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """Where PEM private keys stand: each end mark with the last begin mark before it, if of the same label."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and _pem_body(text[begin.end() : m.start()]):
                yield begin.start(), m.end()
            begin = None


#: Bytes of a signature by its algorithm; of RSA at least so many.
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNATURES = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
RSA_LEAST_BYTES = 128
LEAST_BYTES = 16


def _url64(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """A compact token: its header is a JSON object with an algorithm other than none, and a signature that fits it follows.

    Algorithms that aren't known need LEAST_BYTES of signature.
    """
    try:
        header = json.loads(_url64(head))
        payload, signed = _url64(body), len(_url64(signature))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or "enc" in header or not payload:
        return False
    name = header["alg"]
    if name in SIGNATURE_BYTES:
        return signed in SIGNATURE_BYTES[name]
    return name.lower() not in ("", "none") and signed >= (RSA_LEAST_BYTES if name in RSA_SIGNATURES else LEAST_BYTES)
