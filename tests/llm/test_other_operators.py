"""Embeddings, pages, archives and the pipeline against brute force, with odd rows."""

import base64
import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pacewise.llm import common, embeddup, htmltext, warc

PAGES = "page_id long, url string, html string"


def test_components(spark):
    random.seed(3)
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 8)
    g = np.random.Generator(np.random.PCG64(5))
    base = g.standard_normal((6, 16))
    rows = []
    for i in range(150):
        v = base[i % 6] + 0.03 * g.standard_normal(16) * (i % 4)
        rows.append((i, v.astype(np.float32).tolist(), i % 2 if i % 50 else None))
    rows += [(200, rows[1][1], 1), (201, rows[1][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [None, *rows[1][1][1:]], 1), (206, rows[1][1][:8], 1), (207, [], 1), (None, rows[1][1], 1), (208, rows[1][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1)).withColumn("m", F.lit(2))
    ok = {i: np.array(v, np.float64) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    links, up = collections.Counter(), {i: i for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["vec_id"]: r for r in embeddup.duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in up:
        assert got[i]["n_links"] == links[i] and (i is None or (got[i]["component_id"] == root(i) and got[i]["kept"] == (root(i) == i)))
    assert sum(links.values()) > 500 and embeddup.duplicates(df.limit(0)).count() == 0


def test_planes_count():
    bits, n = embeddup.tables(1_000_000)
    assert bits >= 16 and (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** n <= 1e-4


def page(nav, body, foot="© us"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>{nav}</a></ul></nav><div class=top-ad>buy &amp; go</div>{body}<div>Imprint and terms</div><footer>{foot}</footer></body></html>"


def test_html(spark):
    arts = [f"<article><h1>Title {i}</h1><p><b>First &lt;{i}&gt;  line<br>more<p>Second\n para<form><p>x</form><section class='comments'><p>nice</section></article>" for i in range(6)]
    rows = [(i, f"http://A.example/{i}", page(f"n{i}", a)) for i, a in enumerate(arts)]
    plain = [(10 + i, f"http://b.example/{i}", page(f"n{i}", f"<div><p>only this {i}</p></div>")) for i in range(6)]
    odd = [(20, None, page("n", arts[0])), (21, "nonsense", None), (22, "http://c.example", ""), (None, "http://c.example", "just <b>text"), (23, "http://c.example", "<p>" * 3000 + "deep"), (0, "http://A.example/0", rows[0][2])]
    df = spark.createDataFrame([*rows, *plain, *odd], PAGES).withColumn("ref", F.lit("r")).withColumn("host", F.lit("h"))
    got = collections.defaultdict(list)
    for r in htmltext.extract(df).collect():
        got[r["page_id"]].append(r)
        assert r["n_chars"] == len(r["text"])
    for i in range(6):
        assert got[i][0]["text"] == f"Title {i}\nFirst <{i}> line more\nSecond para"
        assert got[10 + i][0]["text"] == f"only this {i}"
    assert len(got[0]) == 2 and got[20][0]["text"].startswith("Title 0") and got[21][0]["text"] == got[22][0]["text"] == "" and got[None][0]["text"] == "just text" and got[23][0]["text"] == "deep"
    assert htmltext.extract(df.limit(0)).count() == 0


def test_html_template_in_articles(spark):
    def article(i):
        paras = "".join(f"<p>part {k} of {i}</p>" for k in range(1 + i % 4))
        return f"<article><div><p>By our staff</p></div><h1>Title {i}</h1>{paras}<p>Write to us every week</p></article><div><article-list>Read more here</article-list></div>"

    rows = [(i, f"http://a.example/{i}", page("n", article(i))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"Title {i}", *(f"part {k} of {i}" for k in range(1 + i % 4))])


def test_html_stub_among_pages(spark):
    rows = [(i, f"http://a.example/{i}", page("n", f"<div><p>only this {i}</p></div>")) for i in range(9)] + [(50, "http://a.example/50", "<p>moved</p>"), (51, "http://a.example/51", "<!doctype html><ht")]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(9)] == [f"only this {i}" for i in range(9)] and got[50] == "moved"


def test_tree_matching():
    a, b = htmltext.parse("<div><p>a</p><ul><li>x<li>y</ul></div>"), htmltext.parse("<div><h1>t</h1><p>b</p><ul><li>x</ul></div>")
    assert [x.tag for x, _ in sorted(htmltext.match(a, b), key=lambda p: p[0].tag)] == ["div", "html", "li", "p", "ul"]


def test_warc(spark):
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "ünlike"), (5, None, None), (4, "http://a/4", ""), (None, "u", "same"), (7, "u", "long " * 50_000), (8, "u", "long " * 50_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("sha256", F.lit("x")).withColumn("n", F.lit(1))
    path = common.scratch(spark, "warc-test")
    warc.write(df, path)
    assert spark.read.parquet(path + "/payloads").count() == 4
    got = {r["page_id"]: r for r in warc.read(spark, path, whole=True).collect()}
    first = {"same": 1, "ünlike": 2, "": 4, "long " * 50_000: 7}
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert bytes(r["payload"]) == raw and r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        one = first[h or ""] == i
        assert r["record_type"] == ("response" if one else "revisit") and r["refers_to"] == (None if one else first[h or ""])
        assert bytes(r["record"]).endswith((raw if one else b"\r\n\r\n") + b"\r\n\r\n") and bytes(r["record"]).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0
    short = common.scratch(spark, "warc-test")
    warc.write(df, short, least_bytes=5)
    assert {r["page_id"] for r in warc.read(spark, short).where("record_type = 'revisit'").collect()} == {8}


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept < docs and len(kept) > len(docs) / 2


def test_embeddings_with_repeated_ids(spark):
    g = np.random.Generator(np.random.PCG64(8))
    rows = []
    for k in range(41):
        a, b = g.standard_normal((2, 16))
        c = b + 0.01 * g.standard_normal(16)
        rows += [(2 * k, a.tolist(), 0), (2 * k, b.tolist(), 1), (2 * k + 1, c.tolist(), 0)]
    rows += [(900, g.standard_normal(8).tolist(), 0), (900, g.standard_normal(16).tolist(), 0)]
    near = g.standard_normal(16)
    rows += [(901, near.tolist(), 5), (902, near.tolist(), 5), (902, (-near).tolist(), 6), (903, (-near).tolist(), 6)]
    got = {r["vec_id"]: r for r in embeddup.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in [*range(82), 900])
    assert [got[i]["component_id"] for i in (901, 902, 903)] == [901] * 3 and [got[i]["n_links"] for i in (901, 902, 903)] == [1] * 3


def test_warc_header_lines(spark):
    rows = [(1, "http://a/ WARC-Payload-Digest: sha1:X", "one"), (2, "http://a/\u0085WARC-Type: x ", "two"), (3, "http://a/\r\nWARC-Type: x", "three")]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, h in rows:
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() and got[i]["record_type"] == "response"
