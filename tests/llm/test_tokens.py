import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest

from quernel.llm import bpe, tokencount
from quernel.llm.queries import RANKS, VOCABULARY

PARTS = ["a", "bc", "1", " ", "\n", "\t", "'s", "'", ".", "é", "<|endoftext|>", "<|endoftext", "  ", "\xa0", "\r", "　", "\U0001f600", "́", "\x1c", "中"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_safe_chunks_keep_ids():
    enc = bpe.encoder(RANKS)
    for text in texts(400, 1):
        for limit in (1, 3, 8):
            chunks = list(bpe.safe_chunks(text, limit))
            assert "".join(chunks) == text
            assert [i for c in chunks for i in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def test_long_texts():
    enc = bpe.encoder(RANKS)
    text = " some words, 12 of them;\n" * 20_000
    assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    gap = "a" + " " * 20_000 + "b" + "\n" * 15_000 + " c" + " " * 11_000
    assert bpe.encode(enc, gap) == enc.encode_ordinary(gap)
    huge = " " * 1_500_000 + "x"  # the library alone fails on this
    ids = bpe.encode(enc, huge)
    assert bpe.decode(enc, ids) == huge.encode() and ids[-1] == enc.encode_ordinary(" x")[0]
    letters = "é" * 300_000
    assert bpe.decode(enc, bpe.encode(enc, letters)) == letters.encode()


def test_digests(odd, odd_rows, none):
    enc = bpe.encoder(RANKS)
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = enc.encode_ordinary(text or "")
        want[(i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.encode_digests(odd, RANKS).collect())) == want
    assert bpe.encode_digests(none, RANKS).count() == 0


def test_ids_round_trip(odd, odd_rows):
    back = bpe.decode_ids(bpe.encode_ids(odd, RANKS), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t, *_ in odd_rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_counts_are_the_librarys(seed):
    tok = tokencount.tokenizer(VOCABULARY)
    lengths, specials = tokencount.Lengths(tokencount.Table({"a": 1}), tok), tokencount.special_pattern(tok)
    for text in texts(600, seed):
        assert tokencount.count(text, lengths, specials) == tokencount.library_count(tok, text), repr(text)


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 5 * 130)
    lengths = tokencount.Lengths(tokencount.Table({"the": 1}), tokencount.tokenizer(VOCABULARY))
    for i in range(40):
        assert lengths[f"w{i}"] >= 1 and len(lengths) <= 6
    assert lengths["the"] == 1 and lengths.encoded == 40
    lengths["x" * 1000]
    assert "x" * 1000 not in lengths


def test_table():
    words = {f"w{i}": 1 + i % 9 for i in range(5000)}
    table = tokencount.Table(words | {"zero": 0, "long": 1 << 20})
    assert len(table) == 5000 and all(table.get(w) == n for w, n in words.items())
    assert not any(table.get(f"v{i}") for i in range(5000)) and not table.get("zero") and not table.get("long")
    assert tokencount.Table({}).get("x") == 0


MIXED = "Ein Satz \U0001f600 mit Zeichen, 日本語のテキスト、한국어 문장 и русский; हिन्दी पाठ, e\u0301 \u200dx ٣٤ عربى\x1c ok don't 'S  \n\n end."


def test_no_text_goes_to_the_library_whole(monkeypatch):
    """Characters on which this module's pattern and the library may differ change who cuts, not who looks up."""
    tok = tokencount.tokenizer(VOCABULARY)
    text = " ".join([MIXED, *(f"plain words {i} in between" for i in range(3000))] * 4)
    want = len(tok.encode(text, add_special_tokens=False).ids)
    seen = []
    whole = tokencount.library_count
    monkeypatch.setattr(tokencount, "library_count", lambda t, pre: seen.append(pre) or whole(t, pre))
    lengths = tokencount.Lengths(tokencount.Table({" plain": 1, " words": 1}), tok)
    assert tokencount.count(text, lengths, tokencount.special_pattern(tok)) == want
    assert max(map(len, seen)) <= 12 and len(seen) == len(set(seen)) and " plain" not in seen


def test_frequent_pre_tokens_come_from_all_rows(spark):
    docs = spark.createDataFrame([(i, ("seldom " if i % 7 else "often! ") * 50 + f" only{i}") for i in range(60)] + [(None, None), (61, "")], "doc_id long, text string").repartition(6)
    found = tokencount.frequent_lengths(docs, VOCABULARY)
    tok = tokencount.tokenizer(VOCABULARY)
    assert {" seldom", " often", "!", "often"} <= set(found) and not any("only" in p for p in found)
    assert all(n == tokencount.library_count(tok, p) for p, n in found.items())


def test_count_query(odd, odd_rows, none):
    tok = tokencount.tokenizer(VOCABULARY)
    want = Counter()
    for i, text, *_ in odd_rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        want[(i, len((text or "").encode()), n, n > 1024)] += 1
    assert Counter(map(tuple, tokencount.token_counts(odd, VOCABULARY).collect())) == want
    assert tokencount.token_counts(none, VOCABULARY).count() == 0


def test_vocabulary_is_a_parameter(odd):
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode_digests(odd, other).count() == odd.count()
