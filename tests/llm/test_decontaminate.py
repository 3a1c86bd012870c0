import random
import re

from loomgraph.llm import decontaminate
from loomgraph.llm.decontaminate import clean, find
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d in docs:
        w, hit, ids = words(d[1]), set(), set()
        for item, text in items:
            v = words(text)
            n = min(len(v), 10)
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add(item)
        out.append((d[0], len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(5)
    vocab = ["the", "of", "É", "x1", "and", "é"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(1, say(14)), (2, say(10)), (3, "Solo Words"), (4, ""), (5, None), (6, "..."), (10, "the of and"), (None, "null item words here"), (7, "w" + say(11)), (7, "w" + say(11)), (9, "a,b;c-d e f g h i j k l")]
    docs = [(i, say(rng.randint(0, 60)), "t") for i in range(40)]
    docs += [(100, "x " + items[0][1].upper() + " y " + items[1][1], "t"), (101, None, "t"), (102, "", "t"), (103, "--", "t"), (104, "a b c d e f g h i j k l m", "t"), (104, "a b c d e f g h i j k l m", "t"), (104, "other", "t"), (None, "solo words", "t"), (105, "Null item, words here", "t"), (106, " ".join(["the of and"] * 3000), "t")]
    return docs, items


def frames(spark):
    docs, items = case()
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items, d, b = frames(spark)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in find(d, b).collect()], key=repr)
    assert got == brute(docs, items)


def test_keys_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    docs, items, d, b = frames(spark)
    monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", 0)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in find(d, b).collect()], key=repr)
    assert got == brute(docs, items)


def test_winnowing_keeps_few_grams_and_one_of_each_window(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(20)] + [(20, "a " * 100), (21, "short text"), (22, " ".join(map(str, range(10))))]
    rows = spark.createDataFrame(texts, "id long, text string").select("id", decontaminate.words(F.col("text")).alias("w")).where(F.size("w") >= 10)
    rows = rows.withColumn("g", decontaminate._grams(F.col("w"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("g") - 1)))
    kept = {}
    for r in rows.where(decontaminate._selected(F.col("g"), F.col("i"))).select("id", "i").collect():
        kept.setdefault(r.id, set()).add(r.i)
    assert sum(len(kept[i]) for i in range(20)) < 0.35 * 20 * 391
    for i, text in texts:
        for start in range(len(text.split()) - 9):
            assert kept[i] & set(range(start, start + 6))


def test_clean_and_empty(spark):
    docs, items, d, b = frames(spark)
    d = d.withColumns({"_gone_id": F.lit(1), "text_hash": F.lit("x")})
    kept = clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in brute(docs, items) if not x[2]), key=repr)
    assert find(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 for r in find(d, b.limit(0)).collect())


def test_a_long_text_is_not_copied_for_each_of_its_grams(spark):
    rng = random.Random(3)
    own = [f"word{rng.randrange(10**6):06d}" for _ in range(60_000)]
    own[30_000:30_002] = ["solo", "words"]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, "solo"), (3, " ".join(own[100:112]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(own[100:115])), (2, " ".join(own[-10:])), (3, "Solo words")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in find(docs, items).collect()}
    assert got == {1: (60_000, 27, ["1", "2", "3"]), 2: (1, 0, []), 3: (12, 12, ["1"])}
