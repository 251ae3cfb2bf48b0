"""The pipeline against the same stages done one after another in plain Python."""

from collections import Counter, defaultdict
from hashlib import sha256

import corpus_pipeline
from pyspark.sql import functions as F
from test_native import brute_targets, drawn
from test_neardup import brute

from quernel.llm import bpe, langid, secretscan
from quernel.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark, odd, none):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "secrets", "mixing", "token ids"]
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0


def test_run_against_plain_python(spark):
    docs = documents(spark, SF)
    got = Counter((*r[:3], tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = [r for r in docs.collect() if (d := model.decide(r.text))[0] != "und" and d[2] >= langid.LEAST_COVER]
    keep = {doc for doc, _, least in brute([(r.doc_id, r.text) for r in rows]) if doc == least}
    rows = [r for r in rows if r.doc_id in keep]
    texts = {r.doc_id: secretscan.masked(r.text) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(texts[r.doc_id].encode().split())
    targets = brute_targets(sizes)
    draws = {r.doc_id: drawn(r.doc_id, texts[r.doc_id]) for r in rows}
    enc, want = bpe.encoder(corpus_pipeline.RANKS), Counter()
    for r in rows:
        rate = targets[r.source] / sizes[r.source]
        ids = enc.encode_ordinary(texts[r.doc_id])
        for copy in range(int(rate) + int(rate - int(rate) + draws[r.doc_id])):
            want[r.doc_id, copy, len(ids), tuple(ids), sha256(texts[r.doc_id].encode()).hexdigest()] += 1
    assert got == want


def test_copies_are_encoded_once_and_numbered(spark, odd, odd_rows, none):
    got = bpe.encode_copies(odd, corpus_pipeline.RANKS).collect()
    assert len(got) == len(odd_rows) and bpe.encode_copies(none, corpus_pipeline.RANKS).count() == 0
    assert sorted(r.copy for r in got if r.doc_id == 2) == [0, 1]
    assert {r.copy for r in got if r.doc_id != 2} == {0} and all(len(r.ids) == r.n_tokens for r in got)
