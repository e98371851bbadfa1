"""Best-fit packing of token sequences.

``pack`` tokenises each document and packs its pieces into sequences of at most ``limit`` tokens by bounded-space
online best-fit: a fixed number of open bins, found through a bitset keyed by free space; when another bin is needed
and all are open, the fullest closes first.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import compress
from operator import is_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, ship

LIMIT = 4096
OPEN_BINS = 2048
#: Scanned partitions that one packing task takes over; only lengths and checksums move, some 40 bytes a piece.
SCANS_PER_TASK = 16


class BestFit:
    """Bounded-space online best-fit. ``add`` returns (sequence, offset); at most ``open_bins`` sequences are open."""

    def __init__(self, limit: int = LIMIT, open_bins: int = OPEN_BINS):
        self.limit, self.most = limit, open_bins
        self.bits = 0  # bit f is set if an open bin has f free tokens
        self.by_free: dict[int, deque[int]] = {}
        self.opened = self.count = 0

    def _put(self, seq: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, deque()).append(seq)
            self.bits |= 1 << free
            self.opened += 1

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        seq = own.popleft()
        if not own:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.opened -= 1
        return seq

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            if self.opened >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            seq, free = self.count, self.limit
            self.count += 1
        self._put(seq, free - length)
        return seq, self.limit - free


class WordTokens:
    """Token ids of whole texts through the tokenizer library, each distinct white-space word encoded once.

    The vocabulary's normaliser and pattern never look across white space, so a text's ids are those of its words in
    order. Characters that compose with, or are split by, anything but the usual white space send the whole text to
    the library. The memo is only a cache: it is emptied when full.
    """

    #: A special token, which stands between words when many are encoded at once.
    MARK = "<|startoftext|>"

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.mark = self.lib.token_to_id(self.MARK)
        self.memo = Memo(self._whole, most)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words many at a time."""
        memo = self.memo
        self.memo[""] = b""
        words = [w for w in words if w and "<|" not in w]
        groups = [words[at : at + 100] for at in range(0, len(words), 100)]
        for at in range(0, len(groups), 100):
            some = groups[at : at + 100]
            for own, e in zip(some, self.lib.encode_batch_fast([self.MARK.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
                raw = ids.tobytes()
                memo.update((w, raw[i:j]) for w, i, j in zip(own, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        memo, get = self.memo, self.memo.get
        out: list = []
        later: list[tuple[int, list, list[int], list[str]]] = []
        new: set[str] = set()
        for x in texts:
            # file, group, record and unit separators split Python's words but not the tokenizer's
            if not x.isascii() and not unicodedata.is_normalized("NFC", x) or any(c in x for c in _APART):
                out.append(self._whole(x))
                continue
            words = x.split()
            row = list(map(get, words))
            if None in row:
                gaps = list(compress(range(len(row)), map(_none, row)))
                missing = [words[k] for k in gaps]
                new.update(missing)
                later.append((len(out), row, gaps, missing))
                row = ()
            out.append(b"".join(row))
        if later:
            memo.room()
            old = memo.old
            known = {w: old[w] for w in new if w in old} if old else {}
            memo.update(known)
            new.difference_update(known)
            # letters and the marks behind them are tokens of their own, and case makes no difference
            parts = [(w, m[1].lower(), m[2]) for w in new if (m := _PLAIN(w))]
            new.difference_update([w for w, _, _ in parts])
            for _, a, b in parts:
                new.add(a)
                new.add(b)
            self._learn([w for w in new if w not in memo])
            memo.update([(w, memo[a] + memo[b]) for w, a, b in parts])
            for i, row, gaps, missing in later:
                for k, w in zip(gaps, missing, strict=True):
                    row[k] = memo[w]
                out[i] = b"".join(row)
        return out


_none = partial(is_, None)
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s'<]*)").fullmatch
_APART = "\x1c\x1d\x1e\x1f"
_TOKENS: dict[str, WordTokens] = {}

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocab: str, limit: int = LIMIT, end: int = 1) -> DataFrame:
    """The pieces of each document: its ids and then ``end``, cut into runs of ``limit`` (the last may be shorter)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _TOKENS.setdefault(vocab, WordTokens(vocab))
        for df in frames:
            ids, texts = df["doc_id"].tolist(), df["text"].tolist()
            for at in range(0, len(ids), 1024):
                rows = []
                for doc, raw in zip(ids[at : at + 1024], tok.packed(texts[at : at + 1024]), strict=True):
                    raw += tail
                    for k in range(0, len(raw) // 4, limit):
                        part = raw[4 * k : 4 * (k + limit)]
                        rows.append((doc, k // limit, k, len(part) // 4, zlib.crc32(part)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def assign(rows: DataFrame, limit: int = LIMIT, open_bins: int = OPEN_BINS, tasks: int = 1) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to ``limit``; each of ``tasks`` tasks packs a share by itself.

    The order inside a task is fixed by a hash of the row, so that a task that runs again packs in the same way.
    """
    cols = rows.columns

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bins, high = BestFit(limit, open_bins), TaskContext.get().partitionId() << 40
        for df in frames:
            got = [bins.add(n) for n in df["length"].tolist()]
            df["sequence_id"] = np.array([high + s for s, _ in got], dtype=np.int64)
            df["offset"] = np.array([o for _, o in got], dtype=np.int64)
            yield df

    dealt = rows.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(cols).schema) + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocab: str, limit: int = LIMIT, end: int = 1, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack all ``docs`` (doc_id, text): one row per piece with its sequence and place there.

    A null text is empty, and an empty text is the end token alone. A repeated row is packed once for each row, a null
    doc_id is kept. Other columns are not read. An empty table gives no rows. Texts of any length are cut, never
    dropped. Bins do not cross tasks, so that their number is ``scanned partitions / 16`` and each has a few half-full
    sequences at its end.
    """
    tasks = max(1, -(-docs.rdd.getNumPartitions() // SCANS_PER_TASK))
    return assign(pieces(docs, vocab, limit, end), limit, open_bins, tasks)
