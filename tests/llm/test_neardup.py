import random
from collections import Counter

import numpy as np
import pytest

from quernel.llm import neardup
from quernel.llm.common import WordHashes


def shingle_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """{row index: (set size, component id)} by trying every pair."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def word(rnd):
    return "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))


def hard_rows(seed):
    """Groups of near copies with all degrees of editing, and one passage in most documents."""
    rnd = random.Random(seed)
    passage = [word(rnd) for _ in range(60)]
    rows, doc = [], 0
    for _ in range(12):
        base = [word(rnd) for _ in range(rnd.choice([3, 5, 8, 30, 120, 400]))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                copy[rnd.randrange(len(copy))] = word(rnd)
            if rnd.random() < 0.5:
                copy += passage
            rows.append((doc := doc + 1, rnd.choice([" ", "\n", " \t"]).join(copy)))
    for _ in range(60):
        rows.append((doc := doc + 1, " ".join([*passage, *(word(rnd) for _ in range(rnd.randint(5, 30)))])))
    rows += [(doc + 1, None), (doc + 2, ""), (None, rows[0][1]), (None, "alone in its words and without a number"), (rows[3][0], rows[3][1]), (doc + 3, " . "), (doc + 4, " . ")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 512), (2, 512), (3, 8)])
def test_against_all_pairs(spark, seed, tile, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = hard_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c in brute(rows))


def test_chains_over_tiles(spark, monkeypatch):
    """Neighbours are linked, others aren't: most of a block is not joined to its least member within a tile."""
    monkeypatch.setattr(neardup, "TILE", 2)
    rnd = random.Random(7)
    chains = [[word(rnd) for _ in range(500)] for _ in range(3)]
    rows = [(100 * i + at, " ".join(words[8 * at : 8 * at + 100])) for i, words in enumerate(chains) for at in range(50)]
    rnd.shuffle(rows)
    seen = []
    materialize = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: seen.append(label) or materialize(df, label))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows))
    assert "across" in seen


def test_odd_rows(odd, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c in brute(rows))
    assert neardup.near_duplicates(none).count() == 0


def test_keep_one(spark, odd, odd_rows, none):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r[0], r[1]) for r in odd_rows]
    groups = Counter(c for _, n, c in brute(rows) if n)
    wordless = sum(1 for _, n, _ in brute(rows) if not n)
    assert kept.count() == len(groups) + wordless
    assert kept.where("doc_id = 2 or doc_id = 3").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert neardup.keep_one(none).count() == 0
    hard = hard_rows(4)
    left = [(r.doc_id, r.text) for r in neardup.keep_one(spark.createDataFrame(hard, "doc_id long, text string")).collect()]
    found = brute(left)
    assert max(Counter(c for _, n, c in found if n and c is not None).values()) == 1


def test_exact_threshold():
    sets = np.arange(1, 301, dtype=np.uint64)
    assert neardup.similar(sets[:4], sets[:3]) and not neardup.similar(sets[:5], sets[1:5] + np.uint64(1))
    assert neardup.similar(sets[:75], sets[:100]) and not neardup.similar(sets[:74], sets[:100])


def test_estimates_are_near():
    rnd = np.random.default_rng(2)
    for true in (0.3, 0.6, 0.75, 0.9):
        errors = []
        for _ in range(60):
            pool = np.sort(rnd.integers(1, 1 << 63, 2000).astype(np.uint64))
            n = int(2000 * (1 - true) / 2)
            a, b = np.sort(pool[rnd.permutation(2000)[n:]]), None
            order = rnd.permutation(2000)
            a, b = np.sort(pool[order[n:]]), np.sort(pool[order[: 2000 - n]])
            errors.append(neardup.union_estimate(a[:64], b[:64]) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_shingles_of_long_words_and_texts():
    hashes = WordHashes()
    assert len(neardup.shingles("x" * 3_000_000, hashes)) == 1
    text = "abc de " * 400_000
    assert len(neardup.shingles(text, hashes)) == 2
    assert neardup.signature(neardup.shingles("A b\nC d E f", hashes)) == neardup.signature(neardup.shingles("a B c D e F", hashes))


def test_low_estimate_of_a_linked_pair_is_verified():
    import numpy as np
    import pandas as pd

    small = np.arange(64, dtype=np.uint64)
    far = np.arange(1000, 1200, dtype=np.uint64)
    a = np.concatenate([small[:28], small[28:46], far])
    b = np.concatenate([small[:28], small[46:], far])
    assert neardup.similar(a, b)
    assert neardup.union_estimate(a[: neardup.SKETCH], b[: neardup.SKETCH]) == 28 / 64
    block = pd.DataFrame({"sig": [b"a", b"b"], "members": [a.tobytes(), b.tobytes()]})
    assert neardup.block_links(block)[0] == [(b"a", b"b")]
