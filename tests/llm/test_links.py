"""Links between texts that share passages with others: none may be lost behind a bucket's smallest member."""

import random

from pyspark.sql import functions as F

from pacewise.llm import common, ngramjoin

from .test_text_operators import DOCS, brute_links, frame


def shared(n_short, n_long, sentences=20, seed=5):
    rng = random.Random(seed)
    lines = [" ".join(f"s{k}w{j}" for j in range(14)) for k in range(sentences)]
    short = [" ".join(rng.sample(lines, 15)) for _ in range(n_short)]
    long = [" ".join([*lines, *(f"own{i}x{j}" for j in range(24))]) for i in range(n_long)]
    return short + long


def test_no_link_is_lost_behind_smaller_ids(spark):
    texts = shared(200, 40)
    want = brute_links(dict(enumerate(texts)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.classes(frame(spark, texts)).collect()}
    assert sum(n for _, n in want.values()) // 2 >= 780 and got == want


def test_large_mixed_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LOOK", 4)
    texts = shared(30, 25, seed=9)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.classes(frame(spark, texts)).collect()}
    assert got == brute_links(dict(enumerate(texts)))


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f g"), (1, "quite another text of some words"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, ""), (None, "x y"), (None, "x y")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("_rank", F.lit(1)).withColumn("rep", F.lit(2))
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in ngramjoin.keep_first(df).collect())
    odd = [k for k in kept if k[0] == "3"]
    assert len(odd) == 1 and [k for k in kept if k[0] != "3"] == sorted([("1", "a b c d e f g"), ("1", "quite another text of some words"), ("None", "x y"), ("None", "x y")])


def test_words_of_any_length_are_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "_CHUNK", 64)
    rng = random.Random(2)
    texts = ["x" * 300, "ab " * 50 + "y" * 200 + " end", "," * 200 + "word", "é" * 100 + "," + "z" * 70, "w" * 64 + " v", ""]
    texts += [" ".join("q" * rng.randrange(1, 90) for _ in range(8)) for _ in range(5)]
    import re

    words = [re.findall("[0-9a-z\u0080-\U0010ffff]+", t) for t in texts]
    got = common.word_hashes(texts)
    assert [len(g) for g in got] == [len(w) for w in words]
    seen = {}
    for ws, hs in zip(words, got, strict=True):
        for w, h in zip(ws, hs.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
