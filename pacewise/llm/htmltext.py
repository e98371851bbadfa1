"""Main text of web pages by wrapper induction.

The pages of a host are aligned with a reference page of it by simple tree matching. Nodes whose text is the same on
nearly all of the aligned pages are the host's template; the rest are slots that vary, and hold the content. What is
named as a menu, notice, form and so on is never content; an article or main element bounds it where there is one, and
what is template in it goes as well.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, written

#: Aligned pages (other than copies of the reference) that a template needs, and the part of them with the same text.
LEAST_PAGES, SAME_SHARE = 3, 0.9
#: Aligned pages that a template inside an article or main element needs: on a few pages a constant line may be content.
LEAST_PAGES_INSIDE = 10
#: Reference pages and templates that are broadcast at most, in bytes; more are joined by shuffle.
BROADCAST_BYTES = 32_000_000

# Element names of the HTML standard by their part here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROP = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select option textarea input label object embed dialog menu audio video head title math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
SLOT = frozenset({"article", "main"})
# Parts of class and id names, and roles, that say that an element isn't content.
NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies social share sharing sharebar related recommended recommendations widget widgets login search pagination pager copyright skip toolbar masthead topbar tags".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """Element with its children (nodes and strings)."""

    __slots__ = ("attrs", "children", "kind", "say", "size", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.kind = tag, attrs, [], None

    def named(self) -> bool:
        """Whether attributes say that this isn't content."""
        if not self.attrs or "=" not in self.attrs and "hidden" not in self.attrs:
            return False
        for m in _ATTR.finditer(self.attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                if any(p.lower() in NAMED for p in _PART.split(value)):
                    return True
            elif name == "role":
                if value.lower() in ROLES:
                    return True
            elif name == "hidden" and m.start() and self.attrs[m.start() - 1].isspace() or name == "aria-hidden" and value.lower() == "true":
                return True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False


def _tokens(text: str, at: int, state: dict) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, name, attributes) of the tags from ``at`` on; comments and declarations have no name.

    Linear in the text: a tag whose quotes don't close ends at the next bracket, and after the first such tag all do.
    One that never ends takes the rest of the page.
    """
    while (start := text.find("<", at)) >= 0:
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = len(text) if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        m = _NAME.match(text, start + 1)
        if m is None:
            if text[start + 1 : start + 2] in ("!", "?") and (end := text.find(">", start)) >= 0:
                at = end + 1
                yield start, at, False, None, ""
            else:
                at = start + 1
            continue
        end = -1 if state.get("open") else _tag_end(text, m.end())
        if end < 0:
            state["open"] = True
            end = text.find(">", m.end())
        if end < 0:
            yield start, len(text), False, None, ""
            return
        at = end + 1
        yield start, at, bool(m[1]), m[2].lower(), text[m.end() : end]


def _tag_end(text: str, at: int) -> int:
    """Place of the bracket that ends a tag, outside quotes; -1 if there is none."""
    while (at := _PLAIN.match(text, at).end()) < len(text):
        if text[at] == ">":
            return at
        at = text.find(text[at], at + 1) + 1
        if not at:
            return -1
    return -1


def parse(text: str) -> Node:
    """Tree of a page, with the implied ends of p, li, td and their like; wrong end tags are passed over."""
    root = Node("html")
    stack = [root]
    open_: dict[str, int] = {}

    def close(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    at, state = 0, {}
    tags = _tokens(text, 0, state)
    while (token := next(tags, None)) is not None:
        start, end, closing, name, attrs = token
        if start > at:
            stack[-1].children.append(text[at:start])
        at = end
        if name is None:
            continue
        if closing:
            if open_.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        close(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and name not in ("tr", "tbody", "table", "thead", "tfoot") and name not in BLOCK:
                        break
            continue
        if name in ("html", "body"):
            root.attrs += attrs
            continue
        if name in CLOSES_P and open_.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK or stack[k].tag in ("button", "object"):
                    break
        if name in SIBLINGS:
            ends, stops = SIBLINGS[name]
            if any(map(open_.get, ends)):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close(k)
                        if name not in ("tr", "tbody"):
                            break
                    elif stack[k].tag in stops:
                        break
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at) if name not in state else None
            if m:
                node.children.append(text[at : m.start()])
                at = m.end()
            else:
                state[name] = True  # it ends nowhere behind this place either
                node.children.append(text[at:])
                at = len(text)
            tags = _tokens(text, at, state)
            continue
        open_[name] = open_.get(name, 0) + 1
        stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _kids(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_POWERS = [1]


def _sign(root: Node) -> Node:
    """Give every node its kind (a hash of the tags below it), its size in nodes and a hash of the text below it, 0 for none.

    The text's hash is a polynomial over the texts in page order, white space apart, so that every node's comes from
    sums kept along the page.
    """
    sums = [0]
    todo: list = [(root, -1)]
    while todo:
        n, begin = todo.pop()
        if isinstance(n, str):
            if words := n.split():
                sums.append((sums[-1] * _BASE + (hash(" ".join(words)) & _PRIME)) % _PRIME)
        elif begin < 0:
            todo.append((n, len(sums) - 1))
            todo += [(c, -1) for c in reversed(n.children)]
        else:
            kids = _kids(n)
            n.kind = hash((n.tag, *[c.kind for c in kids]))
            n.size = 1 + sum([c.size for c in kids])
            count = len(sums) - 1 - begin
            while len(_POWERS) <= count:
                _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
            n.say = (sums[-1] - sums[begin] * _POWERS[count]) % _PRIME or 1 if count else 0
    return root


#: Weights of pairs of kinds; only a cache.
_WEIGHTS: dict[tuple[int, int], int] = {}
#: Cells of a table of moves; longer rows of siblings are aligned in halves, so that memory stays bounded.
_CELLS = 4_000_000


def _weight(x: Node, y: Node) -> int:
    """Pairs in a largest mapping between two trees, which may be deep."""
    if x.tag != y.tag:
        return 0
    if x.kind == y.kind:
        return x.size
    if (got := _WEIGHTS.get((x.kind, y.kind))) is not None:
        return got
    if len(_WEIGHTS) > 200_000:
        _WEIGHTS.clear()
    todo = [(x, y)]
    while todo:
        a, b = todo[-1]
        if (a.kind, b.kind) in _WEIGHTS:
            todo.pop()
            continue
        p, q, weight, _ = _trimmed(_kids(a), _kids(b), False)
        need = [(c, d) for c in {c.kind: c for c in p}.values() for d in {d.kind: d for d in q}.values() if c.tag == d.tag and c.kind != d.kind and (c.kind, d.kind) not in _WEIGHTS]
        if need:
            todo += need
            continue
        todo.pop()
        _WEIGHTS[a.kind, b.kind] = 1 + weight + (_best(p, q, False)[0] if p and q else 0)
    return _WEIGHTS[x.kind, y.kind]


def _trimmed(p: list[Node], q: list[Node], told: bool) -> tuple[list[Node], list[Node], int, list]:
    """Siblings without the equal ones at either end, which belong together in some best mapping; their weight and pairs."""
    m, n, head = len(p), len(q), 0
    while head < m and head < n and p[head].kind == q[head].kind and (not told or p[head].say == q[head].say):
        head += 1
    while m > head and n > head and p[m - 1].kind == q[n - 1].kind and (not told or p[m - 1].say == q[n - 1].say):
        m, n = m - 1, n - 1
    pairs = [*zip(p[:head], q[:head], strict=True), *zip(p[m:], q[n:], strict=True)] if told else []
    return p[head:m], q[head:n], sum([x.size for x in p[:head]]) + sum([x.size for x in p[m:]]), pairs


def _rows(p: list[Node], q: list[Node], told: bool) -> Iterator[np.ndarray]:
    """For each of ``p`` the weights of its pairs with ``q``; with ``told`` scaled, and one more where texts are equal."""
    scale = min(len(p), len(q)) + 1 if told else 1
    ys = {y.kind: y for y in q}
    place = {k: i for i, k in enumerate(ys)}
    col = np.array([place[y.kind] for y in q])
    say = np.array([y.say for y in q], np.int64)
    known: dict[int, np.ndarray] = {}
    for x in p:
        if (w := known.get(x.kind)) is None:
            w = known[x.kind] = np.array([_weight(x, y) for y in ys.values()], np.int64)[col] * scale
        yield w + ((w > 0) & (say == x.say)) if told else w


def _next(last: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The next row of the table of best weights of prefixes."""
    row = np.zeros_like(last)
    np.maximum.accumulate(np.maximum(last[1:], np.where(w > 0, last[:-1] + w, 0)), out=row[1:])
    return row


def _best(p: list[Node], q: list[Node], told: bool) -> tuple[int, list]:
    """Weight and, with ``told``, pairs of the best order-keeping mapping between siblings."""
    if len(p) == 1 and len(q) == 1:  # by far the commonest case
        w = _weight(p[0], q[0])
        return w, [(p[0], q[0])] if told and w else []
    if len(p) * len(q) <= 36:
        return _small(p, q, told)
    last = np.zeros(len(q) + 1, np.int64)
    if not told:
        for w in _rows(p, q, False):
            last = _next(last, w)
        return int(last[-1]), []
    out, todo = [], [(list(_rows(p, q, True)) if len(p) * len(q) <= _CELLS else None, p, q)]
    while todo:
        ws, p, q = todo.pop()
        if not p or not q:
            continue
        if ws is None and len(p) * len(q) > _CELLS and len(p) > 1:
            # halves of p meet where the sum of both ways is largest
            mid = len(p) // 2
            ahead, back = np.zeros(len(q) + 1, np.int64), np.zeros(len(q) + 1, np.int64)
            for w in _rows(p[:mid], q, True):
                ahead = _next(ahead, w)
            for w in _rows(p[mid:][::-1], q[::-1], True):
                back = _next(back, w)
            cut = int((ahead + back[::-1]).argmax())
            todo += [(None, p[:mid], q[:cut]), (None, p[mid:], q[cut:])]
            continue
        moves, last = np.zeros((len(p), len(q)), np.uint8), np.zeros(len(q) + 1, np.int64)
        for i, w in enumerate(ws if ws is not None else _rows(p, q, True)):
            row = _next(last, w)
            moves[i] = np.where(row[1:] == last[1:], 0, np.where(row[1:] == row[:-1], 1, 2))
            last = row
        i, j = len(p), len(q)
        while i and j:
            move = moves[i - 1, j - 1]
            i, j = i - (move != 1), j - (move != 0)
            if move == 2:
                out.append((p[i], q[j]))
    return 0, out


def _small(p: list[Node], q: list[Node], told: bool) -> tuple[int, list]:
    """``_best`` for few siblings, without arrays."""
    n = len(q)
    scale = min(len(p), n) + 1 if told else 1
    table = [[0] * (n + 1)]
    for x in p:
        last, row = table[-1], [0]
        for j, y in enumerate(q):
            w = _weight(x, y)
            best = max(last[j + 1], row[j])
            if w:
                best = max(best, last[j] + w * scale + (told and x.say == y.say))
            row.append(best)
        table.append(row)
    out = []
    i, j = len(p), n
    while told and i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((p[i], q[j]))
    return table[-1][-1] // scale, out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of a largest top-down, order-keeping mapping between nodes of equal tags.

    Of mappings between siblings with equal weights the one with most equal texts is taken.
    """
    for root in (a, b):
        if root.kind is None:
            _sign(root)
    out = []
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        p, q, _, pairs = _trimmed(_kids(x), _kids(y), True)
        todo += pairs
        if p and q:
            todo += _best(p, q, True)[1]
    return out


def _numbered(root: Node) -> dict[int, int]:
    """Position of each node in page order, by identity."""
    out, todo = {}, [root]
    while todo:
        n = todo.pop()
        out[id(n)] = len(out)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _inside(root: Node) -> set[int]:
    """Identities of the nodes inside article and main elements."""
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        if inside:
            out.add(id(n))
        todo += [(c, inside or n.tag in SLOT) for c in _kids(n)]
    return out


def _slots(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in SLOT and not n.named():
            found.append(n)
        elif n.tag not in DROP and not n.named():
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return found


#: Marks in a page's script: the end of a block, and that of a node that may be template; its start is its number.
BREAK, CLOSE = -2, -1


def script(root: Node, same: dict[int, int]) -> list:
    """The content of a page in page order: texts, ends of blocks, and the starts and ends of the nodes in ``same``.

    ``same`` has the identities of nodes with the text of a node of the reference, and its number. Which of them are
    template is told later, when all pages of the host are counted.
    """
    out: list = []
    for slot in _slots(root) or [root]:
        todo: list = [(c, slot.tag in SLOT) for c in reversed(slot.children)]
        while todo:
            n, inside = todo.pop()
            if isinstance(n, (str, int)):
                out.append(n)
            elif n.tag == "br":
                out.append(" ")
            elif n.tag in DROP and not (n.tag == "header" and inside) or n.named():
                if n.tag in BLOCK:
                    out.append(BREAK)
            else:
                inside = inside or n.tag in SLOT
                if n.tag in BLOCK:
                    out.append(BREAK)
                    todo.append((BREAK, inside))
                if (number := same.get(id(n))) is not None:
                    out.append(number)
                    todo.append((CLOSE, inside))
                todo += [(c, inside) for c in reversed(n.children)]
        out.append(BREAK)
    return out


def render(parts: list, fixed: set[int] = frozenset()) -> str:
    """Blocks of a page's script, one a line, without the nodes whose numbers are ``fixed``."""
    blocks: list[str] = []
    now: list[str] = []
    depth, hidden = 0, 0  # open marks, and the one from which on nothing is shown
    for part in parts:
        if isinstance(part, str):
            if not hidden:
                now.append(part)
        elif part >= 0:
            depth += 1
            if not hidden and part in fixed:
                hidden = depth
        elif part == CLOSE:
            if hidden == depth:
                hidden = 0
            depth -= 1
        elif now and not hidden:
            line = _SPACE.sub(" ", _html.unescape("".join(now))).strip()
            if line:
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def host(url: Column) -> Column:
    """Lower-case host of a URL, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _reference(pages: DataFrame) -> DataFrame:
    """host, ref: a page of each host's median length (of equal ones the shortest, then the first in text order), found within tasks before any shuffle."""

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[float, int, str]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"host": list(best), "off": [v[0] for v in best.values()], "ref": [v[2] for v in best.values()]})

        for df in frames:
            for h, t, off in zip(df["host"], df["html"], df["off"], strict=True):
                if (old := best.get(h)) is None or (off, len(t), t) < old:
                    best[h] = (off, len(t), t)
            if len(best) > 20_000:
                yield out()
                best.clear()
        if best:  # a task may have no rows, and a frame of none has no types
            yield out()

    # eight steps each time the length doubles, so that a host has few distinct values
    some = pages.where("host is not null and html is not null and html <> ''").select("host", "html", F.floor(8 * F.log2(F.length("html"))).alias("step"))
    mid = written(some.groupBy("host").agg(F.percentile("step", 0.5).alias("mid")), "html-lengths")
    some = some.join(_sized(mid, "host"), "host").select("host", "html", F.abs(F.col("step") - F.col("mid")).alias("off"))
    some = some.mapInPandas(nearest, "host string, off double, ref string")
    return some.groupBy("host").agg(F.min_by("ref", F.struct("off", F.length("ref"), "ref")).alias("ref"))


class _References:
    """Parsed references; only a cache."""

    def __init__(self):
        self.known: dict = {}

    def get(self, ref: str) -> tuple[Node, dict[int, int], set[int]]:
        """Tree, numbers of its nodes by identity, and the numbers inside article and main."""
        got = self.known.get(ref)
        if got is None:
            if len(self.known) > 500:
                self.known.clear()
            tree = parse(ref)
            number, inside = _numbered(tree), _inside(tree)
            got = self.known[ref] = (tree, number, {number[k] for k in inside})
        return got


def aligned(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """One row for each page with its ``script``, and rows (host, node, need) that count aligned pages and those with the same text.

    Every page is parsed and aligned once; both kinds of rows come from that.
    """
    columns = ["page_id", "url", "host", "script", "node", "need", "pages", "same"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _References()
        seen: dict[tuple[str, int, int], list[int]] = {}

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "node": "Int32", "need": "Int32", "pages": "Int64", "same": "Int64"})

        for df in frames:
            rows: list[tuple] = []
            for page, url, h, text, ref in zip(df["page_id"].astype("Int64"), df["url"], df["host"], df["html"], df["ref"], strict=True):
                tree = parse(text)
                equal: dict[int, int] = {}
                if ref is not None:
                    base, number, inside = cache.get(ref)
                    copy = text == ref  # a copy says nothing about what varies
                    for x, y in match(base, tree):
                        if x.tag in SLOT:
                            continue
                        k, alike = number[id(x)], x.say != 0 and x.say == y.say
                        if alike:
                            equal[id(y)] = k
                        if not copy:
                            got = seen.setdefault((h, k, LEAST_PAGES_INSIDE if k in inside else LEAST_PAGES), [0, 0])
                            got[0] += 1
                            got[1] += alike
                rows.append((page, url, h, json.dumps(script(tree, equal), ensure_ascii=False), None, None, None, None))
                if len(rows) >= 500:
                    yield frame(rows)
                    rows = []
            if len(seen) > 50_000:
                rows += [(None, None, h, None, node, need, *v) for (h, node, need), v in seen.items()]
                seen.clear()
            if rows:
                yield frame(rows)
        if seen:
            yield frame([(None, None, h, None, node, need, *v) for (h, node, need), v in seen.items()])

    whole = pages.join(refs, "host", "left").select("page_id", "url", "host", F.coalesce("html", F.lit("")).alias("html"), "ref")
    return whole.mapInPandas(run, "page_id bigint, url string, host string, script string, node int, need int, pages bigint, same bigint")


def templates(counted: DataFrame) -> DataFrame:
    """host, constants: positions in the reference page of the nodes that are the same on the host's pages."""
    sums = counted.where("node is not null").groupBy("host", "node", "need").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    fixed = sums.where((F.col("pages") >= F.col("need")) & (F.col("same") >= SAME_SHARE * F.col("pages")))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("constants"))  # at most the nodes of one page


def _sized(df: DataFrame, col: str) -> DataFrame:
    """``df`` marked for broadcast if it is small."""
    size = df.agg(F.sum(F.octet_length(F.col(col).cast("string")) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Text is the article's blocks, white space within each turned into one blank, joined by line ends; empty if the html
    is null or empty or has no content. Pages without a host have no template. Rows that repeat are extracted each;
    ties and null ids change nothing; other columns are not read; an empty table gives no rows. Pages of any length
    are read whole.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", host(F.col("url")))
    refs = written(_reference(rows), "html-refs")
    both = written(aligned(rows, _sized(refs, "ref")), "html-aligned", "zstd")
    fixed = written(templates(both), "html-templates")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            texts = []
            for parts, constants in zip(df["script"], df["constants"], strict=True):
                parts = json.loads(parts)
                # where all is template, the host's pages differ in nothing that counts
                texts.append(constants is not None and render(parts, set(constants)) or render(parts))
            yield pd.DataFrame({"page_id": df["page_id"].astype("Int64"), "url": df["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    whole = both.where("script is not null").select("page_id", "url", "host", "script").join(_sized(fixed, "constants"), "host", "left").select("page_id", "url", "script", "constants")
    forget(pages.sparkSession, refs)
    return whole.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
