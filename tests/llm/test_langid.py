import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quernel.llm import langid
from quernel.llm.common import documents


def test_filter_holds_all_members_and_few_others():
    rnd = np.random.default_rng(1)
    members = {name: rnd.integers(1, 1 << 62, 5000).astype(np.uint64) for name in [f"l{i:02}" for i in range(11)]}
    made = langid.Filter.build(members)
    for i, name in enumerate(made.languages):
        assert made.popcounts(members[name])[i] == 5000
    false = made.popcounts(rnd.integers(1, 1 << 62, 50_000).astype(np.uint64)) / 50_000
    assert np.allclose(false, made.rates, atol=0.005) and false.max() < 0.02


def test_codes_are_exact_and_case_blind():
    assert set(langid.codes("Ab").tolist()) == set(langid.codes("ab!").tolist())
    a, b, blank = ord("a"), ord("b"), 32
    assert langid.codes("ab").tolist() == [blank << 42 | a << 21 | b, a << 42 | b << 21 | blank]
    whole = np.concatenate(list(langid.ngrams("some words " * 100)))
    assert len(whole) == 900


def test_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.98


def test_labels_are_no_input(spark, sf):
    docs = documents(spark, sf)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    plain = langid.predict(docs, model)
    blind = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model)
    assert plain.exceptAll(blind).count() == 0


def test_odd_rows(odd, none, odd_rows):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows)
    texts = {(i, t is None or not any(c.isalpha() for c in t)) for i, t, *_ in odd_rows}
    for r in got:
        assert (r.doc_id, r.lang_pred == "und") in texts and 0 <= r.score <= 1
    assert langid.identify(none).count() == 0
    assert langid.keep_known(none).columns == none.columns
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0


OTHERS = {
    "dutch": "De kinderen liepen gisteren door het oude dorp en kochten op de markt verse groente, brood en kaas voor het avondeten.",
    "polish": "Wczoraj dzieci szły przez starą wieś i kupiły na targu świeże warzywa, chleb i ser na kolację.",
    "italian": "Ieri i bambini hanno camminato nel vecchio villaggio e hanno comprato al mercato verdura fresca, pane e formaggio per la cena.",
    "portuguese": "Ontem as crianças caminharam pela velha aldeia e compraram no mercado legumes frescos, pão e queijo para o jantar.",
    "finnish": "Lapset kävelivät eilen vanhan kylän läpi ja ostivat torilta tuoreita vihanneksia, leipää ja juustoa illalliseksi.",
}


def test_other_languages_and_letter_noise_go(spark, sf):
    docs = documents(spark, sf)
    rnd = np.random.default_rng(4)
    noise = [" ".join("".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), rnd.integers(2, 10))) for _ in range(60)) for _ in range(5)]
    planted = [(-1 - i, text) for i, text in enumerate([*OTHERS.values(), *noise])]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    kept = langid.keep_known(docs.unionByName(rows, allowMissingColumns=True))
    assert [r.doc_id for r in kept.where("doc_id < 0").collect()] == []
    assert kept.count() == docs.count()  # short ones too
    assert docs.where("length(text) < 200").count() > 20


def plain_grams(text):
    """Three characters in a row of each word with a blank on either side, joined over the blanks between words."""
    line = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip() + " "
    return [line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " "]


def test_decisions_against_exact_sets(spark, monkeypatch):
    """Sets of n-grams instead of the filter: the same languages, and shares that differ by the filter's chance only."""
    docs = documents(spark, "/root/testdata/sf0.01")
    kept = {}
    build = langid.Filter.build
    monkeypatch.setattr(langid.Filter, "build", staticmethod(lambda members: kept.update(members) or build(members)))
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    name = lambda code: "".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))
    exact = {lang: {name(int(c)) for c in codes} for lang, codes in kept.items()}
    assert len(exact) == 4
    for r in docs.limit(400).collect():
        grams = plain_grams(r.text)
        got, score, cover = model.decide(r.text)
        if not grams:
            assert got == "und"
            continue
        hits = {lang: sum(g in own for g in grams) for lang, own in sorted(exact.items())}
        best = max(hits, key=hits.get)
        assert got == best and abs(cover - hits[best] / len(grams)) < 0.03 and abs(score - hits[best] / sum(hits.values())) < 0.05


def test_long_texts_have_the_same_n_grams(monkeypatch):
    text = "Einige W\u00f6rter, und noch mehr davon;\n dann 12 und\tEnde" * 30
    whole = Counter(langid.codes(text).tolist())
    for chunk in (5, 64, 999):
        monkeypatch.setattr(langid, "CHUNK_CHARS", chunk)
        assert sum((Counter(c.tolist()) for c in langid.ngrams(text)), Counter()) == whole
