"""Long texts, in time that grows with their length, and counts that don't depend on how a text is cut."""

import time

import numpy as np
from pyspark.sql import functions as F

from pacewise.llm import langid, toxicity

from .test_text_operators import DOCS


def test_toxicity_features_are_linear():
    for text in ("a" * 400_000, "a0" * 200_000, "a." * 200_000, "aB3$" * 100_000, "QUJD" * 250_000 + "=="):
        start = time.time()
        toxicity.features(text, {"aaa": 1.0})
        assert time.time() - start < 8


def plain_counts(text):
    out = np.zeros(langid.DIM)
    raw = b" " + bytes(c if langid._LETTER[c] else 32 for c in (text or "").lower().encode()) + b" "
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            if b"  " in g or n == 3 and g[1] == 32:
                continue
            v = 0
            for c in g:
                v = v * 256 + c
            out[((v * salt) & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_counts_of_cut_texts():
    word = "abcdefghij" * 60_000
    texts = ["Ein Text, der kurz ist.", word, "", "kurz " * 120_000 + "ende", None, "é" * 300_000, word + " x " + word[:70]]
    got = langid.counts(texts)
    for row, text in zip(got, texts, strict=True):
        assert (row == plain_counts(text)).all()
    assert (langid.counts(texts[::-1])[::-1] == got).all()


def test_language_against_brute_force(spark):
    words = {"aa": "abel obo tiru", "bb": "kreuz werk zaun", "cc": "fjord mund pelle"}
    rows = [(i, " ".join(np.random.Generator(np.random.PCG64(i)).permutation(words[k].split() * 3)), k) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows] + [(5, rows[5][1], "cc", "s", 1)] * 3, DOCS).withColumn("score", F.lit(9)).withColumn("rejected", F.lit(True)).withColumn("place", F.lit(1))
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i, text, _ in rows:
        raw = np.log1p(plain_counts(text)) * model.idf
        raw /= np.sqrt((raw**2).sum())
        best = {k: max(float(raw @ c) for c, o in zip(model.centroids, model.owner, strict=True) if model.langs[o] == k) for k in model.langs}
        assert out[i]["lang_pred"] == max(sorted(best), key=best.get)
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == 93
    many = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} and more", f"l{i}", "s", 1) for i in range(400)], DOCS)
    assert len(langid.fit(many).langs) > 200


def test_lm_words_of_any_length():
    import public_tokenizers

    from pacewise.llm import lmscore

    voc = lmscore.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["The " + "thing" * 120_000, "a b " + "X" * 600_000 + "\tc", "", "x" * 600_000]
    got = {}
    for i, h, p in lmscore.words(texts, voc):
        got.setdefault(i, []).append((h, p))
    assert [sum(len(h) for h, _ in got[i]) for i in range(4)] == [2, 4, 0, 1]
    long = [np.concatenate([h for h, _ in got[i]]) for i in range(4)]
    assert long[1][2] == long[3][0] != long[0][1] and np.concatenate([p for _, p in got[0]])[1] > 0
    assert lmscore.hashed(b"x" * 600_000) == long[3][0]


def test_tables_grow_with_the_chunk(monkeypatch):
    from pacewise.llm import common

    word, whole = b"thing" * 1000, common.letters_sum(b"thing" * 1000)
    monkeypatch.setattr(common, "_CHUNK", 64)
    monkeypatch.setattr(common._Tables, "ready", False)
    assert common.letters_sum(word) == whole and len(common._Tables.pow) == 192
    monkeypatch.undo()
    common._Tables.ready = True
    assert common.letters_sum(word) == whole
