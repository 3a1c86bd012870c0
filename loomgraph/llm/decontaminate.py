"""Benchmark decontamination (operator 4): winnowing, in DataFrame functions only.

Of every ten consecutive words the smallest hash of their six five-word grams is kept,
once with its place however many windows it is the smallest of. Ten equal words keep the
same gram, so a join of kept grams meets every shared span of ten words; hits are then
extended to both sides word by word, and spans of ten words or more stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bloom
from loomgraph.llm.common import let, lower_az, maybe_broadcast, read, small, without
from loomgraph.session import written

WINDOW = 10
GRAM = 5
#: Grams on one side of another that share a window with it.
REACH = WINDOW - GRAM
#: Kept grams of items are broadcast up to this many (of at most fifteen words each).
BROADCAST_PRINTS = 100_000
#: What separates words (after lower-casing A-Z): ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_az(text), SEPARATORS), lambda w: w != "")


def _grams(w: Column) -> Column:
    """Hashes of the five-word grams of a list of words, by their first word."""
    places = F.sequence(F.lit(0), F.size(w) - GRAM)
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)])))


def _reach(grams: Column, at: Column, step: int) -> Column:
    """How many grams in a row, up to a window's, are there on one side and not smaller than the one at a place."""
    own, out = F.get(grams, at), F.lit(REACH)
    for k in reversed(range(REACH)):
        near = at + F.lit(step * (k + 1))
        ends = ~F.coalesce((near >= 0) & (F.get(grams, F.greatest(near, F.lit(0))) >= own), F.lit(False))
        out = F.when(ends, F.lit(k)).otherwise(out)
    return out


def _selected(grams: Column, at: Column) -> Column:
    """Whether the gram is a smallest one in some window of ten words: among equal ones all are."""
    return _reach(grams, at, -1) + _reach(grams, at, 1) >= REACH


def _around(w: Column, at: Column, prefix: str = "") -> list[Column]:
    """The words of a gram, those before it from the nearest one, and those after it, as far as one window reaches."""
    before = F.reverse(F.slice(w, F.greatest(at - REACH, F.lit(0)) + 1, F.least(at, F.lit(REACH))))
    parts = {"gram": F.slice(w, at + 1, F.lit(GRAM)), "before": before, "after": F.slice(w, at + GRAM + 1, F.lit(REACH))}
    return [part.alias(prefix + name) for name, part in parts.items()]


def _same(a: Column, b: Column) -> Column:
    """How many first words of two short lists are equal."""

    def run(equal: Column) -> Column:
        first = F.array_position(equal, F.lit(False)).cast("int")
        return F.when(first > 0, first - 1).otherwise(F.size(equal))

    # a lambda, since it keeps the code that is made for the loop over all words small
    return let(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), run)


def _fingerprints(items: DataFrame) -> DataFrame:
    """item_id, print, gram, before, after: the winnowed grams of items of ten words or more."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= WINDOW).withColumn("g", _grams(F.col("w")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("g") - 1))).where(_selected(F.col("g"), F.col("i")))
    return rows.select("item_id", F.get("g", F.col("i")).alias("print"), *_around(F.col("w"), F.col("i")))


def _short(items: DataFrame) -> DataFrame:
    """item_id, print, n, win: items of fewer than ten words, but not none, as one window each."""
    rows = items.select("item_id", words(F.col("text")).alias("win")).where(F.size("win").between(1, WINDOW - 1)).withColumn("n", F.size("win"))
    return rows.select("item_id", "n", "win", F.xxhash64(F.transform("win", lambda x: F.xxhash64(x))).alias("print"))


def _numbered(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct keys with a number, and (number, item_id): what many items share is one row for documents to meet."""
    keys = written(rows.select(*key).distinct().withColumn("number", F.monotonically_increasing_id()), "keys")
    same = reduce(lambda a, b: a & b, [rows[k] == keys[k] for k in key])
    return keys, written(rows.join(keys, same).select(keys["number"], "item_id").distinct(), "items")


def _met(rows: DataFrame, keys: DataFrame, match: Column) -> DataFrame:
    """Rows with a print, joined with keys: by broadcast if these are few, else by shuffle of what a filter lets pass."""
    if small(keys, BROADCAST_PRINTS):
        return rows.join(F.broadcast(keys), match)
    table, blocks = bloom.build(keys, "print")
    return bloom.possible(rows, rows["own_print"], table, blocks).join(keys, match)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_hash, n_words, n_hit, item_ids (sorted as strings), spans.

    A document word inside any occurrence of an item's window is hit; ``spans`` are
    the (start, end) of matches, which may overlap. Null has no words, as has a text of separators
    only, and neither is hit. Null item identifiers are left out of the list, though
    their windows hit. Repeated rows are reported as often. No documents: no rows;
    no items: no hits. Very long texts are read whole. Other columns are not read.
    """
    items = items.select("item_id", "text")
    keys, of_items = _numbered(written(_fingerprints(items), "prints"), "print", "gram", "before", "after")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumns({"g": F.when(F.size("w") >= WINDOW, _grams(F.col("w"))), "len": F.size("w")})
    # a row for each gram that winnowing selects, and one (-1) that stands for the document itself
    places = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.coalesce(F.size("g"), F.lit(0)) - 1)))
    places = places.where((F.col("i") < 0) | _selected(F.col("g"), F.col("i")))
    # its own words and those near it, so that no row after this has the words of the whole text
    print_ = F.when(F.col("i") >= 0, F.get("g", F.greatest(F.col("i"), F.lit(0)))).alias("own_print")
    places = places.select("id", "text_hash", "len", "i", print_, *_around(F.col("w"), F.greatest(F.col("i"), F.lit(0)), "own_"))
    match = F.col("own_print") == F.col("print")
    if small(keys, BROADCAST_PRINTS):
        joined = places.join(F.broadcast(keys), match, "left").where((F.col("i") < 0) | F.col("number").isNotNull())
    else:
        joined = places.where("i < 0").unionByName(_met(places.where("i >= 0"), keys, match), allowMissingColumns=True)
    # a match of grams is extended to both sides; ten words in a row are an occurrence
    same, n = F.col("own_gram") == F.col("gram"), F.lit(GRAM) + F.col("l") + F.col("r")
    extended = joined.withColumns({"l": F.when(same, _same(F.col("own_before"), F.col("before"))), "r": F.when(same, _same(F.col("own_after"), F.col("after")))})
    # not a filter: one with lambdas would be joined with the filter of the places, and stop it from running where they are made
    occurs = (F.col("i") >= 0) & (n >= WINDOW)
    span = F.struct((F.col("i") - F.col("l")).alias("start"), (F.col("i") + GRAM + F.col("r")).alias("end"))
    found = extended.select("id", "text_hash", "len", F.when(occurs, F.col("number")).alias("number"), F.lit(0).alias("kind"), F.when(occurs, span).alias("span"), (F.col("i") < 0).alias("own"))

    short = _short(items)
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # nine at most
    if lengths:
        short_keys, of_short = _numbered(written(short, "short"), "print", "n", "win")
        of_items = of_items.withColumn("kind", F.lit(0)).unionByName(of_short.withColumn("kind", F.lit(1)))
        hashed = rows.where("len > 0").select("id", "text_hash", "len", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        every = hashed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1))).withColumn("own_n", F.explode(F.array(*map(F.lit, lengths))))
        here = lambda c: F.slice(c, F.col("i") + 1, F.col("own_n"))
        every = every.where(F.col("i") + F.col("own_n") <= F.col("len")).select("id", "text_hash", "len", "i", "own_n", F.xxhash64(here("h")).alias("own_print"), here("w").alias("own_win"))
        equal = (F.col("own_print") == F.col("print")) & (F.col("own_n") == F.col("n")) & (F.col("own_win") == F.col("win"))
        hits = _met(every, short_keys, equal)
        found = found.unionByName(hits.select("id", "text_hash", "len", "number", F.lit(1).alias("kind"), F.struct(F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("end")).alias("span"), F.lit(False).alias("own")))
    else:
        of_items = of_items.withColumn("kind", F.lit(0))

    number = F.when(F.col("number").isNotNull(), F.struct("kind", "number"))
    by = found.groupBy("id", "text_hash").agg(F.max("len").alias("n_words"), F.count_if("own").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set(number).alias("numbers"))
    by = written(by, "matches")
    named = by.where("size(numbers) > 0").select("id", "text_hash", F.explode("numbers").alias("k")).select("id", "text_hash", "k.kind", "k.number").join(of_items, ["kind", "number"])
    named = named.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    named = named.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "item_ids")
    both = by.join(maybe_broadcast(named), by["id"].eqNullSafe(F.col("hit_id")) & (by["text_hash"] == F.col("hit_hash")), "left")
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("hit"), F.greatest(a["reach"], s["end"]).alias("reach"))
    none = F.array().cast("array<string>")
    out = both.select("id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.aggregate("spans", start, step, lambda a: a["hit"]).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_words", "n_hit", "item_ids", "spans")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns; rows that share an identifier are judged each by its own text."""
    hit = written(find(docs, items).where("n_hit > 0").select("doc_id", "text_hash").distinct(), "contaminated")
    return without(docs, hit, doc_id=docs["doc_id"], text_hash=F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    rows = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
