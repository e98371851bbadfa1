"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, names and units become typed placeholders, so that a question with other figures or persons has the template
of the original. Windows of template tokens are joined by hash; a document holds an item if it has enough of the
item's windows. Where a template has slots, the fillings are compared: each value of the item must stand for one value
of the document, so that a re-parameterised question is told from text that shares its wording only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Template tokens of a window, and the part of an item's windows that a document must have.
WINDOW, SHARE = 8, 0.5
#: Items with fewer tokens than this have anybody's wording: only a document that is the whole item holds them.
LEAST_TOKENS = 4
#: Benchmark windows that are broadcast at most (24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Found pairs, with their items' tokens, that are broadcast at most to fetch the documents' slots, in bytes.
BROADCAST_BYTES = 32_000_000

# Placeholders (private-use characters, with no meaning in texts) and the units that may follow a number.
NUMBER, NAME, UNIT = "", "", ""
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?|yards?|pounds?|ounces?|tons?|dollars?|cents?|euros?|percent|meters?|metres?|grams?|liters?|litres?|degrees?"


def canonical(text: Column, keep: bool) -> Column:
    """Tokens of the canonical text. With ``keep`` a placeholder token ends in the value it stands for."""
    value = "$0" if keep else ""
    spaced = "$1" if keep else ""
    marked = F.regexp_replace(text, "[-]", " ")
    # a name is a capitalised word; the first word of a sentence may be one too, so it has a slot like the others
    marked = F.regexp_replace(marked, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", f" {NAME}{value} ")
    digits = F.regexp_replace(marked, r"[+-]?\d+(?:[.,:/]\d+)*", f" {NUMBER}{value} ")
    units = F.regexp_replace(digits, rf"(?i)(?<={NUMBER} {{1,3}}|{NUMBER}[\d.,:/+-]{{1,40}} {{1,3}})({UNITS})\b", f" {UNIT}{spaced} ") if keep else F.regexp_replace(digits, rf"(?i)(?<={NUMBER} {{1,3}})({UNITS})\b", f" {UNIT} ")
    marked = F.when(text.rlike(r"\d"), units).otherwise(marked)
    inside = r"[^\p{L}\p{N}-]+" if not keep else r"[^\p{L}\p{N}-.,:/+-]+|[.,:/+-]+(?!\d)|(?<![\d])[.,:/+-]+"
    return F.filter(F.split(F.lower(marked), inside), lambda t: t != "")


def _hashes(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order; none if there are fewer tokens."""
    return F.when(F.size(tokens) >= size, F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.xxhash64(F.slice(tokens, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _whole(tokens: Column, size: int) -> Column:
    """Hash of all tokens of a text of just ``size`` tokens; none for others."""
    return F.when(F.size(tokens) == size, F.array(F.xxhash64(F.slice(tokens, 1, size)))).otherwise(F.array().cast("array<bigint>"))


def _salted(hashes: Column, size: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(size)))


def _bytes(rows: DataFrame) -> int:
    """Bytes of the rows, about: their text as JSON."""
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_matched, exact) of the documents that hold a benchmark item.

    n_windows counts the distinct template windows of the item, n_matched those found in the document; ``exact`` says
    that all slots hold the item's own values (always so without slots). Items of fewer than 8 tokens are one window
    of that length; items of fewer than 4 are held only by documents that consist of the item; items without a token,
    null texts and null ids match nothing. Repeated rows of a document or item count once; of several texts of an item
    all windows count, and the slots of one. All places of an item in a document are judged: those whose slots agree must have enough of its windows
    together. Documents of any length are searched whole. Without documents or items there are no rows. Other
    columns are not read.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), canonical(F.col("text"), False).alias("tokens"))
    items = items.where(F.size("tokens") >= 1).withColumn("len", F.least(F.size("tokens"), F.lit(window)))
    own = _hashes(F.col("tokens"), window)
    for n in range(1, window):
        own = F.when(F.col("len") == n, _hashes(F.col("tokens"), n)).otherwise(own)
    cases = items.select("item_id", "len", F.posexplode(own).alias("at", "h"))
    wins = written(cases.groupBy("item_id", "len", "h").agg(F.collect_set("at").alias("ats"), F.min("at").alias("win")), "leaks-windows")
    n_wins = wins.count()
    lengths = sorted(r["len"] for r in wins.select("len").distinct().collect())  # eight values at most
    totals = wins.groupBy("item_id", "len").agg(F.count("*").alias("n_windows"))

    tokens = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical(F.col("text"), False).alias("tokens"))
    pieces = [_hashes(F.col("tokens"), n) if n == window else _salted((_hashes if n >= LEAST_TOKENS else _whole)(F.col("tokens"), n), n) for n in lengths] or [F.array().cast("array<bigint>")]
    rows = tokens.select("doc_id", F.size("tokens").alias("n"), F.posexplode(pieces[0] if len(pieces) == 1 else F.concat(*pieces)).alias("pos", "h"))
    side = wins.select(F.when(F.col("len") == window, F.col("h")).otherwise(F.xxhash64("h", "len")).alias("h"), "item_id", "len", "ats", "win")
    if n_wins <= BROADCAST_ROWS:
        side = F.broadcast(side)
    # positions run over the windows of all lengths: take off those of the lengths before
    before = F.lit(0)
    for n in lengths[:-1]:
        own = F.greatest(F.col("n") - (n - 1), F.lit(0)) if n >= LEAST_TOKENS else (F.col("n") == n).cast("int")
        before = before + F.when(F.col("len") > n, own).otherwise(0)
    hits = rows.join(side, "h").select("doc_id", "item_id", (F.col("pos") - before).alias("pos"), "win", F.explode("ats").alias("at"))
    # every place where the item may begin, with the item's windows that are found there
    found = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("start")).agg(F.collect_set(F.struct("at", "win")).alias("hit"))
    pairs = found.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("start", "hit")).alias("runs"))
    pairs = pairs.withColumn("n_matched", F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: r["hit"]["win"])))).cast("bigint"))
    small = totals.hint("broadcast") if n_wins <= BROADCAST_ROWS else totals
    pairs = pairs.join(small, "item_id").where(F.col("n_matched") >= share * F.col("n_windows"))
    pairs = written(pairs.select("doc_id", "item_id", "len", "n_windows", "n_matched", "runs"), "leaks-pairs")

    # slots, of those items that have any
    full = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), canonical(F.col("text"), True).alias("slots")).dropDuplicates(["item_id"])
    full = full.where(F.exists("slots", lambda t: t.rlike(f"^[{NUMBER}{NAME}]")))
    slotted = written(pairs.join(full, "item_id"), "leaks-slotted")
    forget(docs.sparkSession, wins)
    plain = pairs.join(full.select("item_id"), "item_id", "left_anti").select("doc_id", "item_id", "n_windows", "n_matched", F.lit(True).alias("exact"))
    if not slotted.head(1):
        return plain
    few = _bytes(slotted) <= BROADCAST_BYTES
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(slotted) if few else slotted.hint("shuffle_hash"), "doc_id")
    texts = texts.select("doc_id", "item_id", "len", "n_windows", "n_matched", "runs", "slots", canonical(F.col("text"), True).alias("own"))

    def fillings(r: Column) -> Column:
        """Distinct values of the item and the document in the slots of the windows found at one place."""
        covered = F.array_distinct(F.flatten(F.transform(r["hit"]["at"], lambda at: F.sequence(at, at + F.col("len") - 1))))
        both = F.transform(covered, lambda i: F.struct(F.get("slots", i).alias("a"), F.get("own", r["start"] + i).alias("b"), F.substring(F.get("own", r["start"] + i), 1, 1).alias("kind")))
        return F.array_distinct(F.filter(both, lambda p: p["a"].rlike(f"^[{NUMBER}{NAME}]") & p["b"].isNotNull() & (F.substring(p["a"], 1, 1) == p["kind"])))

    # written before it is filtered: a filter that is pushed down would make the document's tokens anew for each slot
    places = texts.select("doc_id", "item_id", "n_windows", "n_matched", F.transform("runs", lambda r: F.struct(r["hit"]["win"].alias("wins"), fillings(r).alias("map"))).alias("places"))
    places = written(places, "leaks-places")
    places = places.withColumn("places", F.filter("places", lambda q: F.size(q["map"]) == F.size(F.array_distinct(q["map"]["a"]))))

    def enough(of: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(of, lambda q: q["wins"])))) >= share * F.col("n_windows")

    same = F.filter("places", lambda q: F.forall(q["map"], lambda p: p["a"] == p["b"]))
    judged = places.where(enough(F.col("places"))).select("doc_id", "item_id", "n_windows", "n_matched", enough(same).alias("exact"))
    return plain.union(judged.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.max("exact").alias("exact")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names.

    Rows with a null doc_id or text stay; rows that share a doc_id go together; empty and long texts are searched whole;
    without documents or items nothing goes.
    """
    bad = written(leaks(docs, benchmark).select("doc_id").distinct(), "leaks-docs")
    side = F.broadcast(bad) if 16 * bad.count() <= BROADCAST_BYTES else bad.hint("shuffle_hash")
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)
