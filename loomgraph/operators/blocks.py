"""Many queries against many rows in one pass: blocks of queries lie in the shared folder, and tasks read them there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from loomgraph.session import settings, written

T = TypeVar("T")

#: Words of queries in a block, about, and texts that a task works on at once: they bound its memory.
WORDS_A_BLOCK, TEXTS_AT_ONCE = 50_000, 256


def dealt(words: DataFrame) -> str:
    """Words (query_id, ...) as files of the shared folder, each with whole queries."""
    n = max(1, -(-words.count() // WORDS_A_BLOCK))
    return written(words.repartition(n, "query_id"), "queries").shared_path


def stored(uri: str) -> list[Callable[[], pa.Table]]:
    """What reads each file of a table in the shared folder, in the order of their names."""
    from pyarrow import fs, parquet

    store, where = fs.FileSystem.from_uri(uri)
    paths = sorted(i.path for i in store.get_file_info(fs.FileSelector(where)) if i.path.endswith(".parquet"))
    return [lambda p=p: parquet.read_table(p, filesystem=store) for p in paths]


def built(uri: str, build: Callable[[pa.Table], T]) -> Callable[[], Iterator[T]]:
    """The blocks of a task: one is kept, several are read again each time."""
    files, kept = stored(uri), []

    def blocks() -> Iterator[T]:
        if len(files) > 1:
            return (build(f()) for f in files)
        if not kept:
            kept.extend(build(f()) for f in files)
        return iter(kept)

    return blocks


def scanned(texts: DataFrame, columns: dict[str, Column], find: Callable, schema: str, tag: str) -> DataFrame:
    """What ``find`` makes of id and columns of texts, which reach it in small batches; written to the shared folder."""
    with settings(texts.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXTS_AT_ONCE)}):
        return written(texts.select("id", *[c.alias(name) for name, c in columns.items()]).mapInArrow(find, schema), tag)


def codes(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all tokens of some rows: the place of each in ``terms``, or -1, and its row."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(tokens)), lengths)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: the group of each member, and its number within the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
