"""Tree matching against a plain recursion, and pages that are deep, wide or broken."""

import functools
import random
import time

from pacewise.llm import htmltext


def plain_weight(a, b):
    """Simple tree matching as a recursion over prefixes of siblings."""

    @functools.cache
    def weight(x, y):
        if x.tag != y.tag:
            return 0
        p, q = htmltext._kids(x), htmltext._kids(y)
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p, 1):
            for j, d in enumerate(q, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + weight(c, d))
        return 1 + m[-1][-1]

    return weight(a, b)


def some_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "b", "i", "ul", "section"])
        out += f"<{tag}>{rng.choice(['', 'x', 'y z', 'w'])}{some_page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else ''}</{tag}>"
    return out


def test_against_plain_recursion(monkeypatch):
    for cells, seed in ((htmltext._CELLS, 1), (6, 2)):
        monkeypatch.setattr(htmltext, "_CELLS", cells)
        rng = random.Random(seed)
        for k in range(60):
            wide = (lambda: "".join(f"<{rng.choice('abi')}>{rng.choice('xyz')}</p>" for _ in range(12))) if k % 3 == 0 else (lambda: some_page(rng))
            a, b = htmltext.parse(wide()), htmltext.parse(wide())
            pairs = htmltext.match(a, b)
            assert len(pairs) == plain_weight(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.tag == y.tag for x, y in pairs)


def test_odd_pages_take_seconds():
    for text in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 350_000, '<a ">" ' * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<b>" * 100_000 + "<p></p>" * 20_000, "<script>" * 50_000, "<!--" * 50_000, "<p>x" * 3_000):
        start = time.time()
        a, b = htmltext.parse(text), htmltext.parse("<i>hi</i>" + text)
        assert htmltext.match(a, b)
        htmltext.render(htmltext.script(b, {}))
        assert time.time() - start < 25


def test_unfinished_tags():
    say = lambda t: htmltext.render(htmltext.script(htmltext.parse(t), {}))
    assert say('<p>one <b class="x>y">two</b> < 3 <p title=\'a>b\'>four<br') == "one two < 3\nfour"
    assert say('<p class="never closed>five</p><p>six</p>') == "five\nsix"
