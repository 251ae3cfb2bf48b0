import hashlib
import random
import re
import statistics
import zlib
from collections import Counter, defaultdict
from functools import reduce
from hashlib import sha256

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import fingerprints, mixing, sharding
from quernel.llm.common import documents
from quernel.llm.queries import oracle_sql

PYTHON = ("Python", "Pandas", "Arrow")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ordered(rows, spark):
    ties = {r.text: r.t for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("t")).collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1] or ""]))


def edited(rows, spark):
    line = [(i, t or "") for i, t in ordered(rows, spark)]
    for (i, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        cut = len(text) // 4
        yield i, len(text), sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()


@pytest.mark.parametrize("per_range", [1, 3, 500])
def test_edits(spark, odd, odd_rows, per_range, monkeypatch):
    monkeypatch.setattr(fingerprints, "KEYS_PER_RANGE", per_range)
    monkeypatch.setattr(fingerprints, "RUN", per_range)
    got = fingerprints.fingerprints(odd)
    assert not any(p in plan_of(got) for p in PYTHON)
    rows = got.collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == Counter(edited([(r[0], r[1]) for r in odd_rows], spark))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 128 for r in rows)


def test_no_rows_and_one(spark, none):
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a few words stand here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.near_edited <= 1.0


def plain_fingerprint(text):
    """One-permutation MinHash in plain Python: 128 least values by the top 7 bits of signed hashes, empty bins by their probes."""
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    fold = lambda ws: reduce(lambda seed, w: xxhash.xxh64(w.to_bytes(8, "little"), seed=seed).intdigest(), ws, 42)
    hashes = [fold(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [fold(words)] if words else []
    bins = [None] * 128
    for h in hashes:
        at, value = (h >> 57) ^ 64, h & (1 << 57) - 1
        bins[at] = value if bins[at] is None else min(bins[at], value)
    filled = []
    for i, value in enumerate(bins):
        order = sorted((j for j in range(128) if j != i), key=lambda j: hashlib.blake2b(f"{i}:{j}".encode(), digest_size=8).digest())
        filled.append(value if value is not None else next((bins[j] for j in order if bins[j] is not None), 0))
    return "".join(f"{v & 15:x}" for v in filled)


def plain_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 16) / (15 / 16))


def test_fingerprints_against_plain_python(spark, odd, odd_rows):
    line = [(i, t or "") for i, t in ordered([(r[0], r[1]) for r in odd_rows], spark)]
    want = []
    for (i, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        cut = len(text) // 4
        own, edit = plain_fingerprint(text), plain_fingerprint(text[: len(text) - cut] + after[:cut])
        want.append((i, own, edit, round(plain_likeness(own, edit), 9), round(plain_likeness(own, plain_fingerprint(after)), 9)))
    got = fingerprints.fingerprints(odd).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == Counter(want)


def test_many_equal_rows(spark):
    rows = [(None, "the same words in every row of these")] * 40 + [(3, "other words are in this one row")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(edited(rows, spark))


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_likeness_follows_similarity(spark):
    """Unbiased whatever the set size: full bins, sparse bins, a handful of shingles."""
    rnd = random.Random(8)
    errors = defaultdict(list)
    rows, true = [], {}
    for n in (12, 60, 1000):
        for same in (0.0, 0.5, 0.8, 1.0):
            for _ in range(40):
                a = [str(rnd.random()) for _ in range(n)]
                k = int(n * same)
                b = a[:k] + [str(rnd.random()) for _ in range(n - k)]
                x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
                true[len(rows)] = (n, same, len(x & y) / len(x | y))
                rows.append((len(rows), " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("i", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        n, same, j = true[r.i]
        errors[n, same].append(r.near - j)
    for key, values in errors.items():
        assert abs(statistics.mean(values)) < 0.06, (key, statistics.mean(values))
        if key[1] == 1.0:
            assert max(map(abs, values)) == 0


def test_equal_texts_equal_fingerprints(spark, sf):
    docs = documents(spark, sf)
    got = fingerprints.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert got.groupBy("text").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").count() == 0
    means = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.5 and means[1] < 0.1


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(weight[s] for s in order if s not in fixed)
        if not w:
            return fixed
        trial = {s: rest * weight[s] / w for s in order if s not in fixed}
        over = [s for s, t in trial.items() if t > 2 * sizes[s]]
        if not over:
            return fixed | trial
        fixed |= {s: 2.0 * sizes[s] for s in over}


def drawn(doc_id, text):
    key = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{mixing.SEED}:{'' if doc_id is None else doc_id}:{key}".encode()).hexdigest()[:13], 16) / 2**52


def check_mix(rows, sources):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken <= 2 * r.size and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    return want, taken


def test_mix(spark, sf):
    docs = documents(spark, sf)
    rows = mixing.mixed(docs).collect()
    want, taken = check_mix(rows, None)
    spread = defaultdict(float)
    for r in rows:
        f = r.target / r.source_size % 1
        spread[r.source] += r.size**2 * f * (1 - f)
    for s in want:
        assert abs(taken[s] - want[s]) <= 4.5 * spread[s] ** 0.5 + 1e-6
    assert Counter(map(tuple, mixing.mixed(docs.repartition(7)).collect())) == Counter(map(tuple, rows))


def test_mix_odd(spark, odd, odd_rows, none):
    rows = mixing.mixed(odd).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t, *_ in odd_rows)
    check_mix(rows, None)
    copies = Counter()
    for r in rows:
        copies[(r.doc_id, r.source)] += r.copies
    emitted = mixing.mix(odd)
    assert emitted.columns == odd.columns
    assert Counter((r.doc_id, r.source) for r in emitted.collect()) == +copies
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mixed(wordless).collect()] == [(0, 0.0, 0)] * 2


def test_mix_of_repeated_and_null_ids(spark):
    """Sources whose rows share a doc_id, or are all the same, still come near their targets."""
    rows = [(None, f"{i} words in this text", s) for s in "abc" for i in range(200)]
    rows += [(7, "one text again and again", "d")] * 300 + [(7, f"another text {i}", "e") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want, taken = check_mix(mixing.mixed(docs).collect(), None)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.15 * want[s], s
    assert taken["d"] == pytest.approx(want["d"], abs=5)
    emitted = Counter(r.source for r in mixing.mix(docs).collect())
    assert emitted == Counter({s: n // (5 if s in "abcd" else 3) for s, n in taken.items()})
    assert emitted == Counter(r.source for r in mixing.mix(docs.repartition(3)).collect())


def test_mix_against_sql(spark, sf, odd, none):
    for docs in (documents(spark, sf), odd, none, odd.where("doc_id in (5, 6, 7)"), odd.withColumn("source", odd["text"])):
        got = mixing.mixed(docs)
        with duckdb.connect() as db:
            db.register("documents", docs.select("doc_id", "text", "source").toArrow())
            want = db.sql(oracle_sql()["op8_source_mix"])
            assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def check_shards(rows, docs, shards=24):
    sizes, slots, groups = Counter({s: 0 for s in range(shards)}), defaultdict(list), defaultdict(Counter)
    texts = Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    return sizes


def test_shards(spark, sf):
    docs = documents(spark, sf)
    got = sharding.sharded(docs)
    assert not any(p in plan_of(got) for p in PYTHON)
    rows = got.collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = check_shards(rows, texts)
    even = sum(sizes.values()) / 24
    assert max(sizes.values()) - min(sizes.values()) < 2 * 33_100 and statistics.pstdev(sizes.values()) < 0.15 * even
    assert Counter(map(tuple, sharding.sharded(docs.repartition(5)).collect())) == Counter(map(tuple, rows))


@pytest.mark.parametrize("shards", [2, 24, 100])
def test_splitters_against_sorting(spark, sf, shards):
    """The bytes below each boundary, from the sorted rows, are within tolerance or one row, or one small group, of the even part."""
    docs = documents(spark, sf)
    shard = {r.doc_id: r.shard for r in sharding.sharded(docs, shards).collect()}
    rows = sorted((xxhash.xxh64((r.text or "").encode(), seed=42).intdigest(), r.doc_id, len((r.text or "").encode()) + 8) for r in docs.select("doc_id", "text").collect())
    part, below = sum(r[2] for r in rows) / shards, 0
    group = Counter()
    for h, _, size in rows:
        group[h] += size
    for (h, doc, size), (after_h, after, after_size) in zip(rows, rows[1:], strict=False):
        below += size
        assert shard[doc] <= shard[after]
        for cut in range(shard[doc] + 1, shard[after] + 1):
            near = max(sharding.TOLERANCE * part, size, after_size, *(g for g in (group[h], group[after_h]) if g <= sharding.WHOLE_GROUP * part))
            assert abs(below - cut * part) <= near + 1


def test_hot_group_is_split_and_small_groups_are_not(spark):
    rnd = random.Random(4)
    rows = [(i, "the same text over and over") for i in range(0, 2000, 2)]
    rows += [(i, f"other {rnd.randrange(700)}") for i in range(1, 4000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(docs).collect()
    sizes = check_shards(got, rows)
    even = sum(sizes.values()) / 24
    assert max(sizes.values()) < 1.06 * even and min(sizes.values()) > 0.94 * even
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert len(shards[zlib.crc32(rows[0][1].encode())]) > 5
    assert max(len(v) for k, v in shards.items() if k != zlib.crc32(rows[0][1].encode())) == 1


def test_shards_odd(spark, odd, odd_rows, none, tmp_path):
    check_shards(sharding.sharded(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    assert sharding.sharded(none).count() == 0
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows)
