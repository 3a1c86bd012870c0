"""Ranked retrieval: BM25 over a table of postings, vectors, and their fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.session import written

from loomgraph.functions.text import expanded, tokens
from loomgraph.operators import blocks, positions

#: Fixed values of the ranking formulas.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60


def symbol_text(s: DataFrame) -> DataFrame:
    """id and the four searched fields of symbols as one text."""
    return s.select("id", F.concat_ws(" ", "name", "qualified_name", F.nullif("docstring", F.lit("")), F.nullif("signature", F.lit(""))).alias("text"))


def _part(n_docs: int, mean_length: float) -> Column:
    """What a term adds to a document's score, from tf, df and dl."""
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_length)))


class TextIndex:
    """Postings (term, id, tf) with their places and document lengths, both written once to the shared folder, and the corpus' size and mean length."""

    def __init__(self, texts: DataFrame) -> None:
        self.places = positions.PositionalIndex(texts)
        self.postings = self.places.postings.select("term", "id", "tf")
        self.lengths = written(self.postings.groupBy("id").agg(F.sum("tf").alias("dl")), "lengths")
        self.n_docs = texts.count()
        self.mean_length = (self.lengths.agg(F.sum("dl")).first()[0] or 0) / max(self.n_docs, 1)

    def _part(self) -> Column:
        return _part(self.n_docs, self.mean_length)

    def score(self, terms: DataFrame) -> DataFrame:
        """(query_id, id, score) of documents that hold all terms (query_id, term) of a query.

        Postings are first cut down to the queries' terms, and to the documents that
        hold all terms of some query, so lengths meet only those.
        """
        asked = terms.distinct()
        wanted = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        own = self.postings.join(asked.select("term").distinct(), "term", "left_semi")
        df = own.groupBy("term").agg(F.count("*").alias("df"))
        rows = own.join(df, "term").join(asked, "term")
        held = rows.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.collect_list(F.struct("tf", "df")).alias("terms"))  # a query has few terms
        held = held.join(wanted, "query_id").where(F.col("n") == F.col("n_terms")).join(self.lengths, "id")
        parts = held.select("query_id", "id", "dl", F.explode("terms").alias("t")).select("query_id", "id", "dl", "t.*")
        return parts.groupBy("query_id", "id").agg(F.round(F.sum(self._part()), 6).alias("score"))

    def prefix_terms(self, prefixes: DataFrame) -> DataFrame:
        """(query_id, term) of the index's terms that begin with a query's prefix; the first letter is the join key."""
        words = self.postings.select("term").distinct().withColumn("first", F.substring("term", 1, 1))
        asked = prefixes.withColumn("first", F.substring("prefix", 1, 1))
        return words.join(asked, "first").where(F.col("term").startswith(F.col("prefix"))).select("query_id", "term")

    def score_any(self, terms: DataFrame) -> DataFrame:
        """The same for documents that hold any one of the terms, counted as a single term."""
        own = self.postings.join(terms.distinct(), "term").groupBy("query_id", "id").agg(F.sum("tf").alias("tf"))
        df = own.groupBy("query_id").agg(F.count("*").alias("df"))
        return own.join(df, "query_id").join(self.lengths, "id").select("query_id", "id", F.round(self._part(), 6).alias("score"))


class _Terms:
    """A block of queries as sets of terms, held against the tokens of some rows; it counts the rows that have a term."""

    def __init__(self, words: pa.Table) -> None:
        names, terms, self.queries = {}, {}, {}
        for query, term in zip(words.column("query_id").to_pylist(), words.column("term").to_pylist(), strict=True):
            self.queries.setdefault(names.setdefault(query, len(names)), []).append(terms.setdefault(term, len(terms)))
        self.names, self.terms = pa.array(list(names), words.schema.field("query_id").type), pa.array(list(terms), pa.string())
        self.sizes = np.array([len(ts) for ts in self.queries.values()], np.int64)
        self.own = np.array([t for ts in self.queries.values() for t in ts], np.int64)
        asked = np.bincount(self.own, minlength=len(terms))
        anchors = np.array([min(ts, key=lambda t: asked[t]) for ts in self.queries.values()], np.int64)  # a term that few queries have
        self.order, self.shares = np.argsort(anchors, kind="stable"), np.bincount(anchors, minlength=len(terms))
        self.df = np.zeros(len(terms), np.int64)

    def hold(self, ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch | None:
        """A row for each term of a query in each row that has all of them."""
        code, row = blocks.codes(tokens, self.terms)
        keys, tf = np.unique((row * len(self.terms) + code)[code >= 0], return_counts=True)
        held = keys % max(1, len(self.terms))
        self.df += np.bincount(held, minlength=len(self.terms))
        group, nth = blocks.spread(self.shares[held])
        query = self.order[(np.cumsum(self.shares) - self.shares)[held[group]] + nth]
        rows = keys[group] // max(1, len(self.terms))
        some = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)[rows])
        rows, query = rows[some], query[some]
        pair, nth = blocks.spread(self.sizes[query])
        if not len(pair):
            return None
        term = self.own[(np.cumsum(self.sizes) - self.sizes)[query[pair]] + nth]
        sought = rows[pair] * len(self.terms) + term
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        whole = (np.bincount(pair[keys[at] == sought], minlength=len(rows)) == self.sizes[query])[pair]
        pair, term, n = pair[whole], term[whole], tf[at[whole]]
        lengths = np.bincount(row, minlength=len(ids))[rows[pair]]
        return _held(self.names.take(pa.array(query[pair])), ids.take(pa.array(rows[pair])), self.terms.take(pa.array(term)), n, lengths)


def _held(query: pa.Array, ids: pa.Array, term: pa.Array, n: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([query, ids, term, pa.array(n.astype(np.int64)), pa.array(dl.astype(np.int64))], names=["query_id", "id", "term", "n", "dl"])


def score_texts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """What ``TextIndex(texts).score(terms)`` gives, without an index, in one pass over the texts.

    Tasks find the documents that hold all terms of a query and count the documents that hold
    a term, so only those and one row a term and task are written, and no posting is shuffled.
    """
    asked = terms.select("query_id", "term").where("query_id is not null and term is not null").distinct()
    n_docs = texts.count()
    if texts.groupBy("id").count().where("count > 1").head(1):  # rows of one id are one document
        texts = texts.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    path = blocks.dealt(asked)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, dfs, total = blocks.built(path, _Terms), {}, 0
        none = lambda n, kind: pa.nulls(n, kind)
        kinds = None
        for batch in batches:
            for i in range(0, batch.num_rows, blocks.TEXTS_AT_ONCE):
                ids, tokens_ = (batch.slice(i, blocks.TEXTS_AT_ONCE).column(c) for c in ("id", "tokens"))
                total += len(tokens_.flatten())
                for k, block in enumerate(queries()):
                    if not len(block.terms):
                        continue
                    kinds = block.names.type, ids.type
                    before = block.df.copy()
                    if (found := block.hold(ids, tokens_)) is not None and found.num_rows:
                        yield found
                    dfs[k] = (block.terms, dfs[k][1] + block.df - before if k in dfs else block.df - before)
        for k, (names, df) in dfs.items():
            yield _held(none(len(df), kinds[0]), none(len(df), kinds[1]), names, df, np.full(len(df), k))
        if kinds:
            yield _held(none(1, kinds[0]), none(1, kinds[1]), none(1, pa.string()), np.array([total]), np.zeros(1))

    kinds = dict(terms.dtypes)["query_id"], dict(texts.dtypes)["id"]
    rows = blocks.scanned(texts, {"tokens": tokens(F.col("text"))}, find, f"query_id {kinds[0]}, id {kinds[1]}, term string, n long, dl long", "held")
    mean_length = (rows.where("term is null").agg(F.sum("n")).first()[0] or 0) / max(n_docs, 1)
    counts = rows.where("query_id is null and term is not null").groupBy("term", F.col("dl").alias("block")).agg(F.sum("n").alias("df"))
    df = counts.groupBy("term").agg(F.max("df").alias("df"))  # each block that asks for a term counts it
    parts = rows.where("query_id is not null").select("query_id", "id", "term", F.col("n").alias("tf"), "dl").join(df, "term")
    return parts.groupBy("query_id", "id").agg(F.round(F.sum(_part(n_docs, mean_length)), 6).alias("score"))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """Numbered by score, then id; the first ``limit`` of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def terms_of(queries: DataFrame, text: Column) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(text)).alias("term"))


def _all_words(index: TextIndex, queries: DataFrame, text: Column) -> DataFrame:
    """Scores of documents that hold all words of a query; what is written without a space between, such as ``get_user``, must follow each other there."""
    scores = index.score(terms_of(queries, text))
    pieces = queries.select("query_id", F.posexplode(F.split(F.trim(text), r"\s+")).alias("part", "piece")).where(F.size(tokens(F.col("piece"))) > 1)
    found = index.places.phrases(positions.asked(pieces, F.col("piece"))).groupBy("query_id", "id").agg(F.countDistinct("part").alias("held"))
    wanted = pieces.groupBy("query_id").agg(F.count("*").alias("pieces"))
    rows = scores.join(wanted, "query_id", "left").join(found, ["query_id", "id"], "left")
    return rows.where("pieces is null or pieces = held").select(*scores.columns)


def search(index: TextIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, stage, id, score, rank) for queries (query_id, query).

    Of three stages the first with hits counts: all words as written (1), the words
    of the expanded identifier (2), the first word as a prefix (3).
    """
    raw = _all_words(index, queries, F.col("query")).withColumn("stage", F.lit(1))
    wide = queries.where(expanded(F.col("query")) != F.lower("query"))
    apart = _all_words(index, wide, expanded(F.col("query"))).withColumn("stage", F.lit(2))
    first = queries.select("query_id", F.get(tokens(expanded(F.col("query"))), F.lit(0)).alias("prefix")).where("prefix is not null")
    begins = index.score_any(index.prefix_terms(first)).withColumn("stage", F.lit(3))
    found = raw.unionByName(apart).unionByName(begins)
    best = found.groupBy("query_id").agg(F.min("stage").alias("stage"))
    return ranked(found.join(best, ["query_id", "stage"]), limit).select("query_id", "stage", "id", "score", "rank")


#: Bytes of vectors that a task holds at once, and scores that it makes at once.
HELD_BYTES, SCORES_AT_ONCE = 32 << 20, 1 << 22


def best_rows(asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``limit`` largest dot products of each query, ties by id.

    Products of matrices leave out what cannot be among them, by a bound on their rounding; the
    others are added up in the order of the elements, so equal vectors have equal scores in any place.
    """
    scores = asked @ rows.T
    slack = 4 * rows.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(asked, axis=1) * np.linalg.norm(rows, axis=1).max()
    if len(rows) <= limit or not np.isfinite(scores).all() or not np.isfinite(slack).all():
        query, row = (x.ravel() for x in np.indices(scores.shape))
    else:
        some = max(limit, len(rows) // 8)  # the best of some rows are a lower bound for all
        low = np.partition(scores[:, :some], some - limit, axis=1)[:, some - limit] - 2 * slack
        query, row = np.nonzero(scores >= low[:, None])
        order = np.lexsort((-scores[query, row], query))
        query, row = query[order], row[order]
        least = scores[query, row][np.searchsorted(query, np.arange(len(asked))) + limit - 1] - 2 * slack
        keep = scores[query, row] >= least[query]
        query, row = query[keep], row[keep]
    exact = np.zeros(len(query))
    for d in range(rows.shape[1]):
        exact += asked[query, d] * rows[row, d]
    order = np.lexsort((ids[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < limit
    return query[first], row[first], exact[first]


def vector_topk(vectors: DataFrame, queries: DataFrame, limit: int = 20, block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the largest dot products of stated queries with all rows, exactly.

    ``vectors`` (id, embedding), ``queries`` (query_id, embedding). Queries are
    written as blocks of at most a fixed number into the shared folder, where tasks
    read them block by block, once for all rows that a task holds; it keeps the best of
    these, and only those are shuffled. Neither the driver nor a task holds more than one block.
    """
    asked = queries.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null")

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), block):
                some = batch.iloc[i : i + block]
                yield pd.DataFrame({"names": [some["query_id"].to_numpy()], "matrix": [np.stack(some["embedding"].to_numpy()).astype(np.float64).tobytes()]})

    n = max(1, -(-asked.count() // block))
    path = written(asked.repartition(n).mapInPandas(pack, "names array<long>, matrix binary"), "queries").shared_path

    def stored() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for read in blocks.stored(path):
            for rows in read().to_batches(max_chunksize=1):
                for names, matrix in zip(rows["names"], rows["matrix"], strict=True):
                    ids = names.values.to_numpy()
                    yield ids, np.frombuffer(matrix.as_py(), np.float64).reshape(len(ids), -1)

    def best(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        step = max(1, SCORES_AT_ONCE // len(rows))
        for names, matrix in stored():
            for i in range(0, len(names), step):
                query, row, score = best_rows(matrix[i : i + step], rows, ids, limit)
                yield pd.DataFrame({"query_id": names[i : i + step][query], "id": ids[row], "score": score})

    def top(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append((batch["id"].to_numpy(), np.stack(batch["embedding"].to_numpy()).astype(np.float64)))
                size += held[-1][1].nbytes
            if size > HELD_BYTES:
                yield from best(held)
                held, size = [], 0
        if held:
            yield from best(held)

    found = vectors.select("id", "embedding").where("embedding is not null").mapInPandas(top, "query_id long, id long, score double")
    return ranked(found, limit)


def fuse(*lists: DataFrame, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    rows = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "id", "rank"))
    return ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")), limit)


def trace(final: DataFrame, **stages: DataFrame) -> DataFrame:
    """The final list with the rank that each stage gave, null where it gave none."""
    out = final.select("query_id", "id", F.col("rank").alias("final_rank"))
    for name, stage in stages.items():
        out = out.join(stage.select("query_id", "id", F.col("rank").alias(f"{name}_rank")), ["query_id", "id"], "left")
    return out


def rerank(candidates: DataFrame, scorer, limit: int) -> DataFrame:  # noqa: ANN001
    """Order candidates (query_id, id, query, text) by a scorer of (query, text) pairs: a function of two Series."""
    own = F.pandas_udf(scorer, "double")
    return ranked(candidates.withColumn("score", own("query", "text")), limit)
