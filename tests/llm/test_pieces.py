import itertools
import random
import re

import pytest
from loomgraph.llm import pieces as P
from loomgraph.session import written


@pytest.fixture(scope="module")
def model():
    return P.load()


TEXTS = ["Hello world", "  a  b\n\nc ", "", None, " ", "É tä\tñ 漢字 😀\r\n", "a" * 300, "b" + "ab" * 1500, "aé" * 500 + " end", "word" * 40, "x▁y ▁", "The quick-brown fox, 3.14 times; <s> </s> <0x0A>", "\n", "\x00\x01", "ouauxan éêlean tionquetion " * 300, " " * 100 + "z"]


def rows(spark):
    return [(i if i != 4 else None, t, [9]) for i, t in enumerate(TEXTS + TEXTS[:2])]


def test_like_the_library(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, ids array<int>")
    got = P.decode(P.encode(docs, model), model, out_col="again").collect()
    assert len(got) == len(TEXTS) + 2
    want = sorted((i if i is not None else -1, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t, _ in rows(spark))
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), r.decoded) for r in got) == want
    assert all(r.again == r.decoded for r in got)
    assert [r.exact for r in got if r.doc_id == 10] == [False]  # a mark for a space in the text itself


def test_documents_like_the_library(spark, model, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in P.encode(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    assert all(list(got[i].ids) == sp.encode(t) and got[i].decoded == t and got[i].exact for i, t in texts.items())


def test_blocks_give_the_same(spark, model):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, ids array<int>")
    one = sorted((r.decoded, list(r.ids)) for r in P.encode(docs, model).collect())
    many = sorted((r.decoded, list(r.ids)) for r in P.encode(docs, model, block_words=20).collect())
    assert one == many
    assert P.encode(docs.limit(0), model).count() == 0


def test_best_path_against_all_paths(spark):
    rng = random.Random(6)
    table = {p: -rng.random() * 5 for p in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abab"]}
    toy = P.Pieces("unigram", {p: i for i, p in enumerate(table)}, table, (), 99, tuple(table))
    words = ["▁" + "".join(w) for w in itertools.product("abz", repeat=4)]

    def paths(w):
        if not w:
            yield 0.0, []
        for n in range(1, len(w) + 1):
            own = table.get(w[:n], toy.least - P.UNKNOWN_PENALTY if n == 1 else None)
            if own is not None:
                for s, rest in paths(w[n:]):
                    yield own + s, [toy.ids.get(w[:n], 99), *rest]

    got = {r.word: list(r.ids) for r in P.lattice(spark.createDataFrame([(w,) for w in words], "word string"), toy).collect()}
    assert len(got) == len(words)
    for w in words:
        assert got[w] == P.best_long(w, toy)
        assert abs(max(paths(w))[0] - next(s for s, p in paths(w) if p == got[w])) < 1e-9


def test_merges_that_make_a_better_piece_possible(spark):
    """Tables in no order of training: pieces become possible after worse ones were made."""
    rng = random.Random(8)
    words = ["▁" + "".join(w) for w in itertools.product("abc", repeat=5)]
    for _ in range(8):
        names = ["▁", "a", "b", "c", *rng.sample(["".join(w) for n in (2, 3, 4) for w in itertools.product("abc", repeat=n)], 40)]
        table = {p: -float(i) for i, p in enumerate(rng.sample(names, len(names)))}
        toy = P.Pieces("bpe", {p: i for i, p in enumerate(table)}, table, (), 99, tuple(table))

        def plain(w):
            parts = list(w)
            while True:
                able = [(-table[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in table]
                if not able:
                    return [toy.ids.get(p, 99) for p in parts]
                i = min(able)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        got = {r.word: list(r.ids) for r in P.lattice(spark.createDataFrame([(w,) for w in words], "word string"), toy).collect()}
        assert got == {w: plain(w) for w in words} == {w: P.merge_long(w, toy) for w in words}


def test_texts_reach_the_workers_in_small_batches(spark, model, monkeypatch):
    """F: at 10,000 whole texts a batch an executor with two workers took more than its memory."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(P, "written", lambda df, tag: seen.append(int(spark.conf.get(name))) or written(df, tag))
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, ids array<int>")
    assert P.encode(docs, model).count() == len(TEXTS) + 2
    assert seen and max(seen) <= 256
    assert spark.conf.get(name) == before


def test_cut_like_the_pattern(model):
    find, cut = re.compile(model.words()).findall, model.cutter()
    rng = random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rng.choices("ab \n\t▁.é\r\x0b", k=rng.randint(1, 12))) for _ in range(20_000)]
    assert all(cut(t) == find(P.SPACE + t.replace(" ", P.SPACE)) for t in texts)


def test_pieces_have_no_symbols_that_nothing_joins(spark):
    """abc is made as a+bc, so only where a ends does it keep its neighbours together; no merges make abd."""
    table = {"a": -9.0, "b": -9.0, "c": -9.0, "d": -9.0, "bc": -1.0, "abc": -2.0, "abd": -3.0}
    toy = P.Pieces("bpe", {p: i for i, p in enumerate(table)}, table, (), 99, tuple(table))
    got = {r.piece: r for r in toy.frame(spark).collect()}
    assert "abd" not in got
    assert {p: r.split for p, r in got.items()} == {"a": 0, "b": 0, "c": 0, "d": 0, "bc": 1, "abc": 1}
    assert [s.n for s in got["abc"].left] == [] and [s.n for s in got["abc"].right] == []
    assert [r.ids for r in P.lattice(spark.createDataFrame([("abcabd",)], "word string"), toy).collect()] == [[5, 0, 1, 3]]
