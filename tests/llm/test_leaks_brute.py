"""Benchmark decontamination against a plain search over all places."""

import random

import regex
from pyspark.sql import functions as F

from pacewise.llm import decontam

UNIT = regex.compile(rf" {{0,2}}((?i:{decontam.UNITS}))(?![\p{{L}}\p{{N}}_])")
TOKEN = regex.compile(r"(?<![\p{L}\p{N}])(?P<name>\p{Lu}\p{Ll}+)|(?P<number>[+-]?[0-9]+(?:[.,:/][0-9]+)*)|(?P<word>[\p{L}\p{N}--[0-9]]+)", regex.V1)


def tokens(text):
    out, at = [], 0
    while m := TOKEN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        out.append((kind, m.group().lower()))
        if kind == "number" and (u := UNIT.match(text, at)):
            out.append(("unit", u[1].lower()))
            at = u.end()
    return out


def template(ts):
    return [v if k == "word" else k for k, v in ts]


def holds(doc, item):
    d, t = tokens(doc), tokens(item)
    if not t:
        return None
    size = min(len(t), 8)
    if size < 4 and len(d) != len(t):
        return None
    dt, tt = template(d), template(t)
    wins = {tuple(tt[i : i + size]) for i in range(len(tt) - size + 1)}
    good, same = set(), set()
    for start in range(-len(t), len(d)):
        at = [i for i in range(len(t) - size + 1) if 0 <= start + i <= len(d) - size and dt[start + i : start + i + size] == tt[i : i + size]]
        pairs = {(t[i], d[start + i]) for a in at for i in range(a, a + size) if t[i][0] in ("name", "number")}
        if len(pairs) == len({a for a, _ in pairs}):
            own = {tuple(tt[a : a + size]) for a in at}
            good |= own
            if all(a == b for a, b in pairs):
                same |= own
    return None if 2 * len(good) < len(wins) else 2 * len(same) >= len(wins)


def test_against_brute_force(spark):
    rng = random.Random(4)
    lower = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ra", "ten", "su")]
    names = ["Tom", "Ann", "Zoë", "Lars"]

    def sentence():
        out = []
        for _ in range(rng.randrange(1, 14)):
            r = rng.random()
            out.append(rng.choice(names) if r < 0.15 else f"{rng.randrange(1, 9)} {rng.choice(['km', 'apples', 'kg'])}" if r < 0.3 else rng.choice(lower))
        return " ".join(out)

    items = [(i, sentence() + ". " + sentence()) for i in range(12)] + [(12, "Tom has 3 apples. Tom buys 5 more."), (13, "3 km"), (14, "yes"), (15, "!!"), (16, ""), (17, None)]

    def other(text):
        told = {n: rng.choice(names) for n in names} | {str(k): str(rng.randrange(1, 9)) for k in range(1, 9)}
        return " ".join(told.get(w, w) for w in text.split(" "))

    docs = []
    for _ in range(80):
        body = [sentence() for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(1, 3)):
            text = rng.choice(items[:13])[1]
            body.insert(rng.randrange(len(body) + 1), text if rng.random() < 0.4 else other(text))
        docs.append(". ".join(body))
    docs += ["Ann has 4 apples. Ann buys 6 more.", "Ann has 4 apples. Lars buys 6 more.", "3 km", "4 km", "it is 3 km", "Yes!", "yes", "oh yes", None, "", "lo " * 30_000 + items[0][1]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("h", F.lit("x")).withColumn("item_id", F.lit(7))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.leaks(df, bench).collect()}
    want = {(d, i): e for d, doc in enumerate(docs) for i, item in items if len(doc or "") < 10_000 and (e := holds(doc or "", item or "")) is not None}
    long = len(docs) - 1
    assert {k: v for k, v in got.items() if k[0] != long} == want and got[long, 0] is True
    n = len(docs) - 11
    assert {(n, 12), (n + 2, 13), (n + 3, 13), (n + 6, 14)} <= set(want) and not {(n + 1, 12), (n + 4, 13), (n + 7, 14)} & set(want)
    clean = decontam.keep_clean(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in got}
