"""Vectors of texts, and a stored index of cells over them, with an approximate and an exact search."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import MARKED, PLAIN
from loomgraph.operators.search import ranked
from loomgraph.session import written
from loomgraph.sources.snapshots import SnapshotTable

#: A function from texts to a matrix with a row for each.
Encoder = Callable[[Sequence[str]], np.ndarray]

#: Rows that centroids are fitted on, at most: those with the smallest hashes of their identifiers.
SAMPLE_ROWS = 20_000
#: Texts that an encoder gets at once, and queries that meet a batch of rows at once.
TEXTS_AT_ONCE = 256
QUERIES_AT_ONCE = 1_024
_FOLD = str.maketrans(MARKED, PLAIN)


def hashing_encoder(dims: int) -> Encoder:
    """An encoder without a model: counts of words, each added to or taken from a dimension that its MD5 names."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(re.findall(r"[^\W_]+", text.lower().translate(_FOLD))).items():
                digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                row[int(digest[:4], 16) % dims] += -n if int(digest[4], 16) % 2 else n
        return out

    return encode


def encode(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(id, text_hash, embedding) of texts (id, text): vectors of length 1, or 0 where the encoder finds nothing. A null text is empty."""
    rows = texts.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.sha2("text", 256))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                found = np.asarray(encoder(some.column("text").to_pylist()), np.float64)
                size = np.linalg.norm(found, axis=1, keepdims=True)
                found = np.divide(found, size, out=np.zeros_like(found), where=size > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel(), pa.float32()))
                yield pa.record_batch({"id": some.column("id"), "text_hash": some.column("text_hash"), "embedding": lists})

    return rows.mapInArrow(run, "id long, text_hash string, embedding array<float>")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Embeddings of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def centroids_of(rows: np.ndarray, cells: int, rounds: int = 20) -> np.ndarray:
    """Centres of at most so many cells of directions, the same in every run."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    rng = np.random.default_rng(0)
    found = rows[rng.permutation(len(rows))[:cells]]
    for _ in range(rounds):
        own = (rows @ found.T).argmax(axis=1)
        for cell in range(len(found)):
            mine = rows[own == cell]
            centre = mine.sum(axis=0)
            length = np.linalg.norm(centre)
            found[cell] = centre / length if length > 0 else rows[rng.integers(len(rows))]  # an empty cell begins anew
    return found


def probes_for(rows: np.ndarray, centroids: np.ndarray, share: float, best: int = 20, queries: int = 200) -> int:
    """How many cells next to a query hold this share of its best rows, as some of the rows find among all of them."""
    asked = rows[:: max(1, len(rows) // queries)]
    own = _angles(rows, centroids).argmin(axis=1)
    places = np.argsort(np.argsort(_angles(asked, centroids), axis=1, kind="stable"), axis=1, kind="stable")
    top = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :best]
    return int(np.quantile(np.take_along_axis(places, own[top], axis=1), share, method="higher")) + 1


def _angles(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.arccos(np.clip(np.divide(rows, size, out=np.zeros_like(rows), where=size > 0) @ centroids.T, -1, 1))


class VectorIndex:
    """Vectors by cell in a ``SnapshotTable``: what changes rewrites the cells that it touches only.

    Every row has the cell of the centroid next to it; centroids are fitted on a bounded
    sample and stay. Rows are (id, cell, text_hash, angle to the centroid, length, embedding).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        """The index stored at a path."""
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r["centre"] for r in rows], np.float64)
        self.probe = max((r["probe"] for r in rows), default=1)
        self.table = SnapshotTable(spark, f"{self.path}/rows", "id", ("generation",), by="cell")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = 64, sample_rows: int = SAMPLE_ROWS, share: float = 0.95) -> VectorIndex:
        """Store vectors (id, embedding, and text_hash if there is one); null embeddings are left out.

        There are at most ``cells`` cells, and no more than rows of the sample. How many
        cells a query looks into is measured on the sample, so that it finds ``share`` of its best rows.
        """
        rows = vectors.where("embedding is not null")
        sample = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(min(sample_rows, SAMPLE_ROWS)).collect()
        known = np.array([r["embedding"] for r in sample], np.float64)
        centres = centroids_of(known, cells) if sample else np.zeros((0, 0))
        probe = probes_for(known, centres, share) if sample else 1
        spark = vectors.sparkSession
        spark.createDataFrame([(i, c.tolist(), probe) for i, c in enumerate(centres)], "cell int, centre array<double>, probe int").write.mode("overwrite").parquet(f"{path.rstrip('/')}/centroids")
        index = cls(spark, path)
        if sample:
            index._put(rows, 0)
        return index

    def _with_cells(self, vectors: DataFrame) -> DataFrame:
        centroids = self.centroids

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = matrix_of(batch.column("embedding"))
                    angles = _angles(rows, centroids)
                    cell = angles.argmin(axis=1)
                    extra = {"cell": pa.array(cell, pa.int32()), "angle": pa.array(angles[np.arange(len(rows)), cell]), "length": pa.array(np.linalg.norm(rows, axis=1))}
                    yield pa.record_batch({c: batch.column(c) for c in batch.schema.names} | extra)

        own = vectors.select(F.col("id").cast("long").alias("id"), F.col("text_hash") if "text_hash" in vectors.columns else F.lit(None).cast("string").alias("text_hash"), F.col("embedding").cast("array<float>").alias("embedding"))
        return own.mapInArrow(assign, "id long, text_hash string, embedding array<float>, cell int, angle double, length double")

    def _put(self, vectors: DataFrame, generation: int, gone: DataFrame | None = None) -> list[int]:
        changes = self._with_cells(vectors).withColumn("op", F.lit("put"))
        if gone is not None:
            changes = changes.unionByName(gone.select("id", "cell").withColumn("op", F.lit("delete")), allowMissingColumns=True)
        return self.table.apply(changes.withColumn("generation", F.lit(generation).cast("long")))

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        return self.table.read(buckets=cells)

    def refresh(self, texts: DataFrame, encoder: Encoder) -> list[int]:
        """Bring the index to texts (id, text): only new and changed texts are encoded, vanished ones go. The cells that were written."""
        have = self.rows().select("id", "cell", F.col("text_hash").alias("_hash"))
        now = texts.select(F.col("id").cast("long").alias("id"), "text")
        fresh = now.join(have, "id", "left").where(~F.sha2(F.coalesce("text", F.lit("")), 256).eqNullSafe(F.col("_hash"))).select("id", "text")
        fresh = written(encode(fresh, encoder), "encoded")
        moved = self._with_cells(fresh).select("id", F.col("cell").alias("to"))
        left = have.join(moved, "id").where("cell <> to").select("id", "cell")
        gone = have.join(now.select("id"), "id", "left_anti").select("id", "cell")
        return self._put(fresh, self.table.versions()[-1] + 1, written(left.unionByName(gone), "gone"))

    def _scores(self, probes: DataFrame, limit: int) -> DataFrame:
        """(query_id, id, score) of the best rows of the cells that queries look into; probes are (query_id, cell, embedding)."""

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for cell in np.unique(cells):
                    mine = batch.filter(pa.array(cells == cell))
                    for at in range(0, mine.num_rows, QUERIES_AT_ONCE):
                        some = mine.slice(at, QUERIES_AT_ONCE)
                        yield pa.record_batch({"cell": pa.array([cell], pa.int32()), "names": pa.array([some.column("query_id").to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([matrix_of(some.column("embedding")).tobytes()], pa.binary())})

        blocks = probes.repartitionByRange("cell").sortWithinPartitions("cell").mapInArrow(pack, "cell int, names array<long>, matrix binary")
        blocks = written(blocks.sortWithinPartitions("cell"), "probes")
        where = blocks.shared_path
        asked = [r["cell"] for r in blocks.select("cell").distinct().collect()]  # at most the number of cells

        def stored(cells: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            from pyarrow import dataset, fs

            store, folder = fs.FileSystem.from_uri(where)
            found = dataset.dataset(folder, filesystem=store, format="parquet").to_batches(filter=dataset.field("cell").isin(cells), batch_size=1)
            for rows in found:
                for cell, names, matrix in zip(rows["cell"].to_pylist(), rows["names"], rows["matrix"], strict=True):
                    ids = names.values.to_numpy()
                    yield cell, ids, np.frombuffer(matrix.as_py(), np.float64).reshape(len(ids), -1)

        def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells, all_ids, rows = batch.column("cell").to_numpy(), batch.column("id").to_numpy(), matrix_of(batch.column("embedding"))
                for cell, names, matrix in stored(np.unique(cells).tolist()):
                    ids = all_ids[cells == cell]
                    scores = rows[cells == cell] @ matrix.T
                    order = np.lexsort((np.broadcast_to(ids[:, None], scores.shape), -scores), axis=0)[:limit]
                    yield pa.record_batch({"query_id": pa.array(np.tile(names, len(order))), "id": pa.array(ids[order].ravel()), "score": pa.array(np.take_along_axis(scores, order, 0).ravel())})

        return self.rows(asked).select("id", "cell", "embedding").mapInArrow(top, "query_id long, id long, score double")

    def search(self, queries: DataFrame, limit: int = 20, probe: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the largest dot products with queries (query_id, embedding).

        A query looks into the ``probe`` cells next to it (by default as many as were measured when the index was built). With ``exact`` it then looks into all
        other cells that can hold something as good as the last of its best: the dot product with
        a row is at most the lengths' product times the cosine of the angle to the
        centroid less the largest angle in the cell.
        """
        centroids, probe = self.centroids, probe or self.probe
        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        if not len(centroids):
            return ranked(asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0), limit)
        n = len(centroids)
        spans = np.zeros((n, 2))
        if exact:
            for r in self.rows().groupBy("cell").agg(F.max("angle").alias("angle"), F.max("length").alias("length")).collect():  # a row a cell
                spans[r["cell"]] = r["angle"], r["length"]

        def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    some = batch.slice(at, TEXTS_AT_ONCE)
                    rows = matrix_of(some.column("embedding"))
                    angles = _angles(rows, centroids)
                    order = np.argsort(angles, axis=1, kind="stable")
                    near = np.argsort(order, axis=1, kind="stable") < probe
                    most = np.linalg.norm(rows, axis=1)[:, None] * spans[:, 1] * np.cos(np.maximum(0, angles - spans[:, 0]))
                    most = np.maximum(most, 0) + 1e-6  # shorter rows than the longest only matter where it is below 0
                    yield pa.record_batch(
                        {"query_id": pa.array(np.repeat(some.column("query_id").to_numpy(), n)), "cell": pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), "near": pa.array(near.ravel()), "most": pa.array(most.ravel())}
                    )

        looks = asked.select("query_id", "embedding").mapInArrow(cells, "query_id long, cell int, near boolean, most double")
        looks = written(looks if exact else looks.where("near"), "looks")
        first = ranked(self._scores(looks.where("near").select("query_id", "cell").join(asked, "query_id"), limit), limit)
        if not exact:
            return first
        first = written(first, "first")
        last = first.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
        more = looks.where("not near").join(last, "query_id", "left").where(F.coalesce(F.col("n") < limit, F.lit(True)) | (F.col("most") >= F.col("last")))
        second = self._scores(more.select("query_id", "cell").join(asked, "query_id"), limit)
        return ranked(first.select("query_id", "id", "score").unionByName(second), limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs (query_id, id) of the exact lists, how many of them were found, and the share."""
    pairs = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    return pairs.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"), (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
