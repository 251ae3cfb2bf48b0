"""Language ID by n-gram membership in a bit-sliced Bloom filter.

One filter serves all languages: each of its places holds a bitmask with a bit
per language. The AND of an n-gram's places is the set of languages that
contain it. A text's popcounts per language, less what false positives would
add, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import bounded_batches, mix, per_row, rewritten, slices, slim

UNDETERMINED = "und"
N = 3
HASHES = 4
#: Training reads at most about this many documents of each language, drawn by a hash of doc_id.
SAMPLE_PER_LANGUAGE = 3000
#: An n-gram belongs to a language if this share of its sampled documents has it, and no language has it this many times as often.
LEAST_SHARE = 0.004
RATIO = 3.0
NGRAMS_PER_LANGUAGE = 50_000
MOST_LANGUAGES = 1000
FALSE_POSITIVES = 0.01
#: Under this share of n-grams that the best language contains, a text is in none of them. Measured: labelled documents
#: have 0.468 at least (256,410 of check_l, held out 0.473), other languages up to 0.425 (Portuguese; Dutch 0.416). The
#: score doesn't tell them apart: 0.48 for Polish, about as much for garbled labelled documents.
LEAST_COVER = 0.44
CHUNK_CHARS = 1 << 19
_SHIFT = np.uint64(21)
_BLANK = re.compile(r"\s")


def codes(text: str) -> np.ndarray:
    """Every run of N code points of the text, lower case, other than letters as blanks; exact in 63 bits."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64)
    top = int(points.max())
    letters = _letters(min(top, 0x10FFFF))
    points = np.where(letters[points], points, 32).astype(np.uint64)
    # blanks in a row are one
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = np.concatenate([[np.uint64(32)], points[keep], [np.uint64(32)]])
    out = points[:-2] << _SHIFT << _SHIFT | points[1:-1] << _SHIFT | points[2:]
    middle = points[1:-1] != 32  # n-grams around a blank tell of word ends only together with a neighbour
    return out[middle]


_LETTERS = np.zeros(0, bool)


def _letters(top: int) -> np.ndarray:
    """Whether each code point up to `top` at least is a letter or a mark inside words."""
    global _LETTERS
    if len(_LETTERS) <= top:
        size = 0x300 if top < 0x300 else 0x3000 if top < 0x3000 else 0x110000
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    return _LETTERS


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """The codes of a text, in parts of about CHUNK_CHARS that end where a word does: none is lost or made up."""
    text, at = text or "", 0
    while len(text) - at > CHUNK_CHARS:
        blank = _BLANK.search(text, at + CHUNK_CHARS)
        if not blank:
            break
        yield codes(text[at : blank.start()])
        at = blank.end()
    yield codes(text[at:])


@dataclass
class Filter:
    """The sliced filter: places x bytes of language bits, and each language's share of set places."""

    languages: list[str]
    bits: np.ndarray
    rates: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Filter:
        languages = sorted(members)
        most = max((len(m) for m in members.values()), default=0)
        per = -HASHES / np.log(1 - FALSE_POSITIVES ** (1 / HASHES))
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most * per)))))
        bits = np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8)
        for i, name in enumerate(languages):
            for places in _places(members[name].astype(np.uint64), size):
                bits[places, i // 8] |= np.uint8(1 << i % 8)
        filled = np.array([(bits[:, i // 8] >> (i % 8) & 1).mean() for i in range(len(languages))])
        return cls(languages, bits, filled**HASHES)

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of languages that contain it: n x bytes."""
        places = _places(grams, len(self.bits))
        found = self.bits[next(places)]
        for p in places:
            found &= self.bits[p]
        return found

    def popcounts(self, grams: np.ndarray) -> np.ndarray:
        found = self.holders(grams)
        by_mask = np.stack([np.bincount(found[:, k], minlength=256) for k in range(found.shape[1])])
        return (by_mask @ _BITS).reshape(-1)[: len(self.languages)]

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score 0..1, share of n-grams that it contains). `und` without letters."""
        hits, total = np.zeros(len(self.languages)), 0
        for grams in ngrams(text):
            hits += self.popcounts(grams)
            total += len(grams)
        if not total or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        true = np.clip((hits - total * self.rates) / np.maximum(1e-9, 1 - self.rates), 0, total)
        best = int(np.argmax(true))
        score = float(true[best] / true.sum()) if true.sum() > 0 else 0.0
        return self.languages[best], score, float(true[best] / total)


_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def _places(grams: np.ndarray, size: int):
    """HASHES places from two halves of one hash."""
    h = mix(grams + np.uint64(0x9E3779B97F4A7C15))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield (a + np.uint64(i) * b) & np.uint64(size - 1)


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Filter:
    """Learn from (doc_id, text, lang); rows without text or lang are passed over.

    Counts rows per language first, then draws by a hash of doc_id and text, so
    that the sample's size is bounded whatever the input's (rows equal in both
    are drawn together). Of more than MOST_LANGUAGES names the most frequent
    are learned. Document frequencies of n-grams are summed by Spark; only the
    NGRAMS_PER_LANGUAGE most frequent come to the driver. Without a labelled
    row nothing is learned and every text is `und`.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Filter.build({})
    by_language = lambda values: F.create_map(*[x for pair in values.items() for x in map(F.lit, pair)])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(draw < by_language({name: min(1.0, sample_per_language / n) for name, n in sizes.items()}))

    def count(batches):
        seen: dict[str, dict[int, int]] = {}
        docs: dict[str, int] = {}
        parts = (part for batch in batches for part in slices(batch))
        for text, lang in (row for p in parts for row in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)):
            own = seen.setdefault(lang, {})
            docs[lang] = docs.get(lang, 0) + 1
            for gram in np.unique(np.concatenate([np.unique(c) for c in ngrams(text)])).tolist():
                own[gram] = own.get(gram, 0) + 1
        for lang, own in seen.items():
            own[-1] = docs[lang]  # no n-gram has this code: the number of documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    floor = by_language({name: LEAST_SHARE * min(n, sample_per_language) for name, n in sizes.items()})
    frequent = counted.where((F.col("gram") == -1) | (F.col("n") >= floor))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("gram") == -1, F.desc("n"), "gram"))
    top = frequent.withColumn("place", place).where((F.col("place") <= NGRAMS_PER_LANGUAGE) | (F.col("gram") == -1))
    table = top.select("lang", "gram", "n").toPandas()
    docs = dict(table[table.gram == -1][["lang", "n"]].itertuples(index=False))
    table = table[table.gram != -1]
    table["share"] = table.n / table.lang.map(docs)
    table = table[table.share * RATIO >= table.groupby("gram").share.transform("max")]
    return Filter.build({name: table[table.lang == name].gram.to_numpy() for name in docs})


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cover", pa.float64())])
PREDICTED_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cover double"


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """The language of every whole text, `und` for texts without letters (null and empty ones too).

    Only the text is looked at. Null doc_ids (never held out) and repeated rows
    pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        filter_ = shared.value
        return lambda doc_id, held, text: (doc_id, held, *filter_.decide(text))

    rows = slim(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return per_row(rows, start, _PREDICTED, PREDICTED_SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, predict all.

    A text with letters of which no language has an n-gram gets the first
    language by name, with score and cover 0. See train and predict for nulls,
    repeated rows and empty tables; columns other than doc_id, text and lang
    are not looked at.
    """
    return predict(docs, train(docs.where(~held_out(F.col("doc_id")))))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs, same columns, without texts in none of the languages: no letters, or too few n-grams that one of them holds.

    Null and empty texts go, so does all of a table that names no language;
    repeated rows repeat, and other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out(F.col("doc_id")))))

    def known(text: str | None) -> bool:
        name, _, cover = shared.value.decide(text)
        return name != UNDETERMINED and cover >= LEAST_COVER

    return rewritten(docs, lambda part: part.filter(pa.array([known(t) for t in part.column("text").to_pylist()], pa.bool_())))
