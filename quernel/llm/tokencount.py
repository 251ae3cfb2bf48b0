"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

Tier one is a broadcast table of the lengths, in tokens, of frequent
pre-tokens: hashes and lengths in flat arrays. What it misses is encoded by
the library once per worker and kept in a cache bounded by bytes. A text's
count is the sum over its pre-tokens. Where this module's split pattern and
the library may differ on a character, the library's own pre-tokenizer cuts
the stretch around it, and its pre-tokens go the same way.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernel.llm.common import bounded_batches, per_row, slices, slim

TOKEN_LIMIT = 1024
#: A word enters the count of frequent ones if it is this share of a task's words: of at most 1 / share words a task.
LEAST_SHARE = 5e-5
TABLE_WORDS = 30_000
#: Different words that a task keeps counts of; beyond, the rarer half goes.
COUNTED_WORDS = 200_000
CACHE_BYTES = 24 << 20
#: Bytes of a cache entry besides its characters, about.
ENTRY_BYTES = 120
#: Longer pre-tokens are encoded each time.
CACHED_CHARS = 200
CHUNK_CHARS = 1 << 14
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Where a text may be cut: between a visible ASCII character and a blank.
_SAFE = regex.compile(r"[!-~](?= )")
#: Where this matcher and the library may differ on what is a letter, a number or white space
#: (control separators, code points of the newest Unicode versions), the library cuts the stretch.
_COMMON = regex.compile(r"[\t\n\r -~\u00a0-\u02af\u0370-\u0373\u0376\u0377\u037b-\u037e\u0384-\u038a\u038e-\u03a1\u03a3-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u4e00-\u9fa5]*+")


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def library_count(tok: Tokenizer, text: str) -> int:
    return len(tok.encode(text, add_special_tokens=False).ids)


class Table:
    """Pre-token lengths by 128-bit hash, by open addressing in flat arrays: 18 bytes a slot, half of the slots free."""

    def __init__(self, lengths: dict[str, int]):
        self.mask = (1 << max(4, (2 * len(lengths)).bit_length())) - 1
        self.low, self.high = array("Q", bytes(8 * (self.mask + 1))), array("Q", bytes(8 * (self.mask + 1)))
        self.lengths = array("H", bytes(2 * (self.mask + 1)))
        for pre, n in lengths.items():
            if 0 < n < 1 << 16:
                at, low, high = self._place(pre)
                self.low[at], self.high[at], self.lengths[at] = low, high, n

    def _place(self, pre: str) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(pre.encode("utf-8", "surrogatepass"))
        low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        at = low & self.mask
        while self.lengths[at] and (self.low[at] != low or self.high[at] != high):
            at = at + 1 & self.mask
        return at, low, high

    def get(self, pre: str) -> int:
        """The length, or 0 if the table hasn't got it."""
        return self.lengths[self._place(pre)[0]]

    def __len__(self) -> int:
        return sum(map(bool, self.lengths))


class Lengths(dict):
    """Pre-token to its length in tokens, remembered within CACHE_BYTES: from the table, else by the library."""

    def __init__(self, table: Table, tok: Tokenizer):
        super().__init__()
        self.tok, self.table, self.bytes, self.encoded = tok, table, 0, 0

    def __missing__(self, pre: str) -> int:
        value = self.table.get(pre)
        if not value:
            value = library_count(self.tok, pre)
            self.encoded += 1
        if len(pre) <= CACHED_CHARS:
            self.bytes += ENTRY_BYTES + len(pre.encode("utf-8", "surrogatepass"))
            if self.bytes > CACHE_BYTES:
                self.clear()
                self.bytes = 0
            self[pre] = value
        return value


def _cuts(text: str) -> Iterator[str]:
    """Pieces of about CHUNK_CHARS that no pre-token spans."""
    at = 0
    while len(text) - at > CHUNK_CHARS and (m := _SAFE.search(text, at + CHUNK_CHARS)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def pre_tokens(text: str, tok: Tokenizer) -> Iterator[list[str]]:
    """The pre-tokens of a text as the library cuts it, piece by piece."""
    for piece in _cuts(text):
        if _COMMON.fullmatch(piece):
            yield _SPLIT.findall(piece)
        else:
            yield [piece[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(piece)]


def count(text: str | None, lengths: Lengths, specials: regex.Pattern | None) -> int:
    if not text:
        return 0
    total, parts = 0, [text]
    if specials is not None and specials.search(text):
        parts = specials.split(text)
        total = len(parts) - 1  # a special string is one token wherever it stands
    for part in parts:
        for found in pre_tokens(part, lengths.tok):
            total += sum(map(lengths.__getitem__, found))
    return total


def special_pattern(tok: Tokenizer) -> regex.Pattern | None:
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(names, key=len, reverse=True)))) if names else None


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Lengths of the pre-tokens of the most frequent words of all texts; speeds counts up, never changes them.

    Each task counts the words of its whole texts and hands on those of at
    least LEAST_SHARE, so what is added up is bounded by the number of tasks.
    TABLE_WORDS words come to the driver.
    """
    bounded_batches(docs.sparkSession)

    def summarize(batches):
        seen, total = Counter(), 0
        for part in (p for batch in batches for p in slices(batch)):
            for piece in (x for text in part.column(0).to_pylist() if text for x in _cuts(text)):
                words = piece.split()
                seen.update(words)
                total += len(words)
            if len(seen) > COUNTED_WORDS:
                seen = Counter(dict(seen.most_common(COUNTED_WORDS // 2)))
        kept = [(w, n) for w, n in seen.items() if n >= max(2, LEAST_SHARE * total) and len(w) <= CACHED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    summed = docs.select("text").mapInArrow(summarize, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = summed.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).collect()
    tok = tokenizer(path)
    found = {pre for word, _ in frequent for pres in pre_tokens(f"{word} {word}", tok) for pre in pres}
    return {pre: library_count(tok, pre) for pre in found | {" ", "\n", "\n\n"}}


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Tokens of every whole text as the library counts them.

    A null text is empty: no bytes, no tokens. Null doc_ids and repeated rows
    pass through; an empty table gives no rows. Other columns are not looked
    at.
    """
    table = docs.sparkSession.sparkContext.broadcast(Table(frequent_lengths(docs, path)))

    def start():
        tok = tokenizer(path)
        lengths, specials = Lengths(table.value, tok), special_pattern(tok)

        def of(doc_id, text):
            n = count(text, lengths, specials)
            return doc_id, len((text or "").encode("utf-8", "surrogatepass")), n, n > limit

        return of

    return per_row(slim(docs), start, _COUNTS, COUNT_SCHEMA)
