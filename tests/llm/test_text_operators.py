"""Text operators against libraries and brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import math
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pacewise.llm import decontam, langid, lmscore, ngramjoin, packing, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "one two three", "Ünïcode 　 naïve\n\ttext!", "x" * 3000, "the quick brown fox jumps over the lazy dog " * 400, "<s> </s> <|endoftext|> ▁▁ é́", "!!!???###"]


def frame(spark, texts, schema=DOCS, extra=False):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    return df.withColumn("score", F.lit(1)).withColumn("h", F.lit("x")).withColumn("pos", F.lit(2)) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ODD + ODD[3:6], extra=True)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, path).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["n_tokens"] == len(sp.encode(r["text"] or "", num_threads=1))
        assert got[r["doc_id"]]["n_bytes"] == len((r["text"] or "").encode())
    assert tokencount.count_tokens(empty(spark), path).count() == 0


def test_packing(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, limit=64, open_bins=4).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = np.array([*lib.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 64))
        for p in parts:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"]
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty(spark), path).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.add(n)[0] for n in (6, 7, 8, 4)] == [0, 1, 2, 0]


def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}
    n = collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                n[a] += 1
                n[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (root(i), n[i]) for i in ids}


def test_ngram_join(spark, monkeypatch):
    base = [f"w{i * 7 % 101}" for i in range(120)]
    texts = ODD + ODD[3:6]
    for k in range(30):
        v = list(base)
        v[(k * 11) % 120] = f"new{k}"
        texts.append(" ".join(v))
    texts += [" ".join(base)] * 5 + [" ".join(base[60:] + [f"q{i}" for i in range(60)])]
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    monkeypatch.setattr(ngramjoin, "SIDE", 2)
    df = frame(spark, texts, extra=True)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.classes(df).collect()}
    assert got == brute_links(dict(enumerate(texts)))
    kept = sorted(r["doc_id"] for r in ngramjoin.keep_first(df).collect())
    assert kept == sorted(i for i, (c, _) in got.items() if c == i)
    assert ngramjoin.classes(empty(spark)).count() == 0
    twice = frame(spark, texts[10:20]).union(frame(spark, texts[10:20])).union(spark.createDataFrame([(None, "a b c", None, None, 0)], DOCS))
    assert sorted(str(r["doc_id"]) for r in ngramjoin.keep_first(twice).collect()) == sorted([*map(str, sorted({c for c, _ in brute_links(dict(enumerate(texts[10:20]))).values()})), "None"])


def test_decontamination(spark):
    item = "what is the total distance that Maria walks in 12 km when each of 3 friends walks the same way home again"
    other = item.replace("Maria", "Peter").replace("12", "45").replace("3", "7")
    mixed = "if 5 apples cost 5 coins then how many coins do 5 bags of apples cost in the market today"
    bench = spark.createDataFrame([(1, item), (2, mixed), (3, "tiny one"), (4, None), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    docs = spark.createDataFrame([(1, "Intro text. " + item + " and more text"), (2, "other " + other), (3, "a clean text about nothing at all that is long enough to have windows"), (4, None), (5, ""), (6, mixed.replace("5 bags", "9 bags").replace("5 apples", "8 apples")), (7, mixed.replace("5", "8")), (1, item), (8, "tiny one")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 2): False, (8, 3): True}
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_all_places(spark):
    mixed = "if 5 apples cost 5 coins then how many coins do 5 bags of apples cost in the market today"
    short = "add 3 pears and 3 figs"
    bench = spark.createDataFrame([(1, mixed), (2, short)], "item_id long, text string")
    variant = mixed.replace("5 apples", "8 apples").replace("5 bags", "9 bags")
    lead = "some words that stand before the item and are in no item at all so that places are shifted by much more. "
    texts = [(1, f"{variant}. {mixed}."), (2, f"{variant}. {variant}."), (3, lead + mixed), (4, lead + variant), (5, lead + short), (6, lead + short.replace("3 figs", "4 figs")), (7, f"{short.replace('3 figs', '4 figs')}. {short}.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.leaks(docs, bench).collect()} == {(1, 1): True, (3, 1): True, (5, 2): True, (7, 2): True}


def test_language(spark):
    en = "the cat and the dog went over the hill with their friends that day"
    de = "der hund und die katze gingen über den berg mit ihren freunden an diesem tag"
    rows = [(i, (en if i % 2 else de) + f" {'and more' if i % 2 else 'und mehr'} {i}", "en" if i % 2 else "de", "s", 0) for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "123 !!", "en", None, 0), (None, en, None, None, 0), (902, "", "de", None, 0)], DOCS)
    out = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= out[i]["score"] <= 1 for i in range(120))
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] for i in (900, 901, 902)) and out[None]["lang_pred"] == "en"
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert langid.identify(empty(spark), langid.fit(empty(spark))).count() == 0
    assert {r["doc_id"] for r in langid.keep(docs, langid.fit(docs)).collect()} == {*range(120), None}


def test_toxicity(spark):
    good = "a calm and friendly text about rivers and mountains number {}"
    bad = "you are a zorgle and a blimfang, such a zorgle text number {}"
    rows = [(i, (bad if i % 5 == 0 else good).format(i), None, None, 0) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "", None, None, 0), (None, "x", None, None, 0)], DOCS)
    labels = spark.createDataFrame([*((i, 1, int(i % 5 == 0)) for i in range(400)), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in range(400)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.keep(docs, model).collect()} == {i for i, r in out.items() if not r["predicted"]}
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


def test_isotonic():
    import numpy as np

    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    knots, values = toxicity.isotonic(x, y)
    assert knots.tolist() == [1, 2, 3, 4] and values.tolist() == [0, 0.5, 0.5, 1]


def test_lm_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAVY", 5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(20)}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {r["doc_id"]: [*re.findall("[^\x20\x09-\x0d]+", (r["text"] or "").translate(lower)), None] for r in docs.collect()}
    c = collections.Counter(w for i, ws in tokens.items() if not fold[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lmscore.score(docs, path).collect():
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == fold[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and r["score"] < 0
    assert lmscore.score(empty(spark), path).count() == 0


def test_attention_windows_and_gradient():
    import numpy as np

    x, y = lmscore.Attention.windows(np.arange(2, 80))
    assert (y[y >= 0] == np.arange(2, 80)).all() and x.shape == (3, 64)
    net = lmscore.Attention()
    g = net._gradient(x, y)
    loss = lambda: -net.score(x, y).sum() / (y >= 0).sum()
    for name, at in (("q", (3, 4)), ("e", (5, 6)), ("w1", (2, 2)), ("pos", (40, 1))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), abs=2e-3)
