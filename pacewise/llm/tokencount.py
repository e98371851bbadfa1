"""Token counts by byte-pair merging, without making identifiers.

The merges of a unit of text run over a linked list of symbols with a heap of adjacent pairs: the pair of the lowest
rank is popped and merged, again and again. The count is the number of symbols at the start minus the merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, ship

#: What stands for a space in the vocabulary.
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    """Counts the tokens of texts for a sentencepiece BPE vocabulary with byte fallback.

    Ranks come from the vocabulary's scores. No piece has a space sign after another character, so runs of space
    signs with the word behind them merge by themselves: the counts of these units add up. Counts of units are kept
    in a cache of bounded size, whatever the corpus holds.
    """

    def __init__(self, path: str, most: int = 600_000, longest: int = 40):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has a space inside; texts can't be counted word by word")
        if not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the vocabulary has no byte fallback")
        # neighbours that some piece holds; no merge ever crosses two others
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.longest = longest
        self.cache = Memo(self._word, most)

    def merges(self, text: str) -> int:
        """Merges made in ``text``."""
        rank, n = self.rank, len(text)
        if n < 2:
            return 0
        get = rank.get
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        # symbol i spans text[i:end[i]]; prev and end link the list, and end is 0 where a symbol was merged away
        end, prev, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, j, k = pop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j] = k, 0
            done += 1
            if (p := prev[i]) >= 0 and (r := get(text[p:k])) is not None:
                push(heap, (r, p, i, k))
            if k < n:
                prev[k] = i
                if (r := get(text[i : end[k]])) is not None:
                    push(heap, (r, i, k, end[k]))
        return done

    def unit(self, text: str) -> int:
        """Tokens of a unit: a character outside the vocabulary is as many symbols as it has bytes."""
        rank = self.rank
        first = len(text) if text.isascii() and text.isalnum() else sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in text)
        return first - self.merges(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = (SPACE + text).replace(" ", SPACE)
        if SPACE + SPACE not in text and text[-1] != SPACE:  # units keyed without the space sign that all of them have
            units = text[1:].split(SPACE)
            if len(max(units, key=len)) <= self.longest:
                return sum(map(self.cache.__getitem__, units))
        else:
            units = [u[1:] if u[0] == SPACE and u[1:2] not in ("", SPACE) else (u,) for u in _UNIT.findall(text)]
        return sum(self.unit(u[0]) if isinstance(u, tuple) else self.cache[u] if len(u) <= self.longest else self.unit(SPACE + u) for u in units)

    def _word(self, word: str) -> int:
        """Tokens of a word with one space sign before it; a last character that can't merge is counted apart."""
        if len(word) > 1 and word[-2:] not in self.pairs:
            return self.cache[word[:-1]] + self.unit(word[-1])
        return self.unit(SPACE + word)


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    A null text is empty and has no tokens; a null doc_id is kept; repeated rows are counted each; other columns are not
    read; an empty table gives no rows. Text of any length is counted whole, in time n log n for a word of n characters.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _COUNTERS.setdefault(model, PieceCounter(model))
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "n_bytes": df["n_bytes"], "n_tokens": [counter.count(x) for x in df["text"].tolist()]})

    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    out = rows.mapInPandas(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
