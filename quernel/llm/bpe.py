"""Byte-level BPE by the tiktoken library over a local rank file.

Long texts are cut at places that no match of the split pattern spans, so the
library sees bounded strings and the ids stay those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import per_row, slim

CHUNK_CHARS = 1 << 16
#: Unicode's White_Space property, which is what \s is to the library.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Between a visible ASCII character and white space a match always ends: white space stands
#: only at the start of a match, or in matches of nothing else.
_SAFE = regex.compile(rf"[!-~](?=[{SPACES}])")
#: A letter is followed by other than a letter: a match ends, as no alternative goes on after letters.
_SAFE_LETTER = regex.compile(r"[A-Za-z](?=[!-&(-@\[-`{-~])")
_LONG_SPACE = regex.compile(rf"[{SPACES}]{{10000,}}")


@cache
def encoder(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces that encode to the ids of the whole when put together.

    A piece is longer than `limit` only where no safe place is found.
    """
    at = 0
    while len(text) - at > limit:
        cut = next((m.end() for pattern in (_SAFE, _SAFE_LETTER) if (m := pattern.search(text, at + limit - 1))), None)
        if cut is None or cut >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoded(enc: tiktoken.Encoding, text: str | None) -> Iterator[list[int]]:
    """The ids of a whole text, chunk by chunk; none for null and empty ones. No special tokens."""
    if not text:
        return
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text
    for chunk in safe_chunks(text):
        ids, at = [], 0
        if len(chunk) >= 10000:
            # the library's matcher gives up on white space this long before a word: its match is all but the last
            for m in _LONG_SPACE.finditer(chunk):
                stop = m.end() if m.end() == len(chunk) else m.end() - 1
                ids += enc.encode_ordinary(chunk[at : m.start()])
                ids += enc._encode_single_piece(chunk[m.start() : stop])
                at = stop
        yield ids + enc.encode_ordinary(chunk[at:] if at else chunk)


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    return [i for ids in encoded(enc, text) for i in ids]


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes; valid UTF-8 only if the ids are of a whole text."""
    return enc.decode_bytes(ids)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(enc: tiktoken.Encoding, text: str | None) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of what they decode to), held a chunk at a time."""
    of_ids, of_bytes, n = sha256(), sha256(), 0
    for ids in encoded(enc, text):
        of_ids.update((" " * bool(n and ids) + " ".join(map(str, ids))).encode())
        of_bytes.update(decode(enc, ids))
        n += len(ids)
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    A null text is empty (no ids). Null doc_ids and repeated rows pass through;
    an empty table gives no rows. Other columns are not looked at.
    """

    def start():
        enc = encoder(ranks_path)
        return lambda doc_id, text: (doc_id, *digests(enc, text))

    return per_row(slim(docs), start, _DIGESTS, DIGEST_SCHEMA)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_ids(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) of every whole text.

    A null or empty text has no ids, not null ones. Null doc_ids and repeated
    rows pass through; an empty table gives no rows.
    """

    def start():
        enc = encoder(ranks_path)
        return lambda doc_id, text: (doc_id, encode(enc, text))

    return per_row(slim(docs), start, _IDS, "doc_id long, ids array<int>")


_TEXTS = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])


def decode_ids(df: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids are none and decode to no bytes."""

    def start():
        enc = encoder(ranks_path)
        return lambda doc_id, ids: (doc_id, decode(enc, ids or []))

    return per_row(df.select("doc_id", "ids"), start, _TEXTS, "doc_id long, bytes binary")


_COPIES = pa.schema([("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])


def encode_copies(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, copy, n_tokens, ids, decoded_sha256): token ids of a mixed corpus, in which documents repeat.

    Rows of equal doc_id and text are copies: they are encoded once and
    numbered from 0. A null text has no ids. Null doc_ids are told apart by
    their texts; an empty table gives no rows.
    """
    key = (F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), F.col("text").isNull().alias("none"))
    once = slim(docs).groupBy(*key).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def start():
        enc = encoder(ranks_path)

        def of(doc_id, copies, text):
            ids = encode(enc, text)
            return doc_id, copies, len(ids), ids, sha256(decode(enc, ids)).hexdigest()

        return of

    made = per_row(once.select("doc_id", "copies", "text"), start, _COPIES, "doc_id long, copies long, n_tokens long, ids array<int>, decoded_sha256 string")
    numbered = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return made.select("doc_id", numbered, "n_tokens", "ids", "decoded_sha256")
