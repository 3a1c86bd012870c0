"""SentencePiece encoding and decoding (operator 10) through a relational lattice.

1. Texts are cut into words at every place that no piece spans. A task does so for a
   block of documents at a time: each document becomes codes of the block's words.
2. The words of all blocks meet by shuffle, so that each is folded once for thousands of
   blocks. Its substrings of bounded length are exploded and equi-joined with the piece
   table; the hits, grouped by word and sorted by their ends, are the edges of its lattice.
3. One higher-order aggregate runs Viterbi over the edges: it keeps, for each place of the
   word, the best way to get there. For ``unigram`` models a
   way is better if its sum of scores is larger. For ``bpe`` models, whose scores are merge
   ranks and do not add up, a step from one piece to the next is either possible or not:
   it is not if merging would have joined symbols across the place where they meet. Of all
   ways just one is possible, and it is what merging gives.
4. Identifiers go back to their blocks by shuffle, and documents look up their codes.
"""

from __future__ import annotations

import heapq
import math
import re
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import let, read, row_slices
from loomgraph.session import new_path, settings, written

SPACE = "▁"
#: Words over so many characters do not fit one row with all their edges; ``merge_long`` and ``best_long`` fold them by the same rule.
LONG = 2_000
#: A block of documents ends after the document with which it has so many distinct words.
BLOCK_WORDS = 400_000
#: Words in one row on their way to the lattice.
WORDS_A_ROW = 1_024
#: Words of blocks that one task folds: their edges take some hundred times the space of the words.
WORDS_A_TASK = 60_000
#: A word is folded once for so many blocks, which bounds the list of places that it came from.
BLOCKS_TOGETHER = 4_096
#: Documents that a task works on at once, which bounds its memory.
DOCS_AT_ONCE = 64
#: Documents in a batch on its way to a task's Python worker; JVM and worker each hold two batches of whole texts beside a block's words.
DOCS_A_BATCH = 256
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Symbol:
    """A symbol at one end of a piece while merging makes the piece, by the ranks of the piece's merges.

    n: its characters; made, used: the worst rank so far when it is made and when it is
    used up; peak: the worst rank after it is made, up to the merge that uses it up.
    """

    n: int
    peak: float
    made: float
    used: float


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: pieces that text can become, their scores, and how to spell the rest."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]  # of the 256 byte pieces, or empty
    unknown: int
    names: tuple[str, ...]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def least(self) -> float:
        return min(self.scores.values(), default=0.0)

    def made(self, piece: str) -> tuple[int, list[Symbol], list[Symbol]]:
        """Where the last of the merges that make the piece joins it (0 if none make it), and the symbols at its left and at its right end on the way."""
        ends = list(range(1, len(piece) + 1))  # of the symbols so far; they start where the one before ends
        born, died, ranks, split = {(i, i + 1): 0 for i in range(len(piece))}, {}, [], 0
        while len(ends) > 1:
            starts = [0, *ends[:-1]]
            able = [(-self.scores[piece[starts[k] : ends[k + 1]]], k) for k in range(len(ends) - 1) if piece[starts[k] : ends[k + 1]] in self.scores]
            if not able:
                break
            rank, k = min(able)
            ranks.append(rank)
            split = ends[k]
            died[starts[k], ends[k]] = died[ends[k], ends[k + 1]] = born[starts[k], ends[k + 1]] = len(ranks)
            del ends[k]

        def symbol(a: int, b: int) -> Symbol:
            start, end = born[a, b], died.get((a, b))
            used, peak = (max(ranks[:end]), max(ranks[start:end])) if end else (math.inf, math.inf)
            return Symbol(b - a, peak, max(ranks[:start], default=-math.inf), used)

        return split if len(ends) == 1 else 0, [symbol(a, b) for a, b in born if a == 0], [symbol(a, b) for a, b in born if b == len(piece)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, split, left and right of the pieces that an encoding can have.

        For bpe: the last merge of a piece joins it at split, and left and right are the
        symbols at its ends while it is made, but only those that a last merge of some
        piece joins to a symbol beside them.
        """
        if self.kind == "bpe":
            made = {p: self.made(p) for p in self.ids}
            made = {p: m for p, m in made.items() if m[0] or len(p) == 1}
            firsts, seconds = {p[: m[0]] for p, m in made.items() if m[0]}, {p[m[0] :] for p, m in made.items() if m[0]}
            ends = {p: (split, [s for s in left if p[: s.n] in seconds], [s for s in right if p[len(p) - s.n :] in firsts]) for p, (split, left, right) in made.items()}
        else:
            ends = dict.fromkeys(self.ids, (0, [], []))
        rows = [(p, self.ids[p], float(self.scores[p]), split, *([(s.n, s.peak, s.made, s.used) for s in side] for side in sides)) for p, (split, *sides) in ends.items()]
        return spark.createDataFrame(rows, f"piece string, id int, score double, split int, left {_SYMBOLS}, right {_SYMBOLS}")

    def apart(self) -> str:
        """ASCII white space and punctuation that no piece has beside another character, but for a space before it."""
        beside = {c for p in self.ids if len(p.lstrip(SPACE)) > 1 for c in p}
        return "".join(c for c in "\n\r\t\x0b\x0c" + string.punctuation if c not in beside)

    def words(self) -> str:
        """A pattern that cuts prepared texts into words which no piece spans."""
        apart = re.escape(self.apart())
        own = f"[{apart}]" if apart else "(?!)"
        return f"{SPACE}+(?:{own}|[^{SPACE}{apart}]*)|[^{SPACE}{apart}]+|{own}"

    def cutter(self) -> Callable[[str], list[str]]:
        """Cuts a text as the pattern does. Few texts need the pattern itself, which takes longer than splitting at spaces."""
        find, own = re.compile(self.words()).findall, self.apart()
        runs = ["  ", SPACE, *(" " + c for c in own)]

        def cut(text: str) -> list[str]:
            spaced = " " + text
            if any(map(spaced.__contains__, runs)):
                return find(spaced.replace(" ", SPACE))
            spaced = spaced.replace(" ", " " + SPACE)
            for c in own:
                spaced = spaced.replace(c, f" {c} ")
            return list(filter(None, spaced.split(" ")))

        return cut

    @cached_property
    def spanned(self) -> frozenset[str]:
        """Neighbouring characters that are in some piece."""
        return frozenset(a + b for p in self.ids for a, b in zip(p, p[1:], strict=False))

    def parts(self, word: str) -> list[str]:
        """A word cut between all neighbours that no piece spans."""
        spanned = self.spanned
        if spanned.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in spanned]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]


_SYMBOLS = "array<struct<n:int,peak:double,made:double,used:double>>"


def load(path: str | None = None, kind: str = "bpe") -> Pieces:
    """Read a model file on the driver; a model's size is fixed."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = {names[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)) if any(map(sp.is_byte, range(n))) else ()
    if any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("a piece spans words")
    return Pieces(kind, plain, {p: sp.get_score(i) for p, i in plain.items()}, byte_ids, sp.unk_id(), tuple(names))


def _spelled(char: Column, pieces: Pieces) -> Column:
    """Identifiers of a character that is no piece: its bytes, or the unknown piece."""
    if not pieces.byte_ids:
        return F.array(F.lit(pieces.unknown))
    table = F.array(*[F.lit(i) for i in pieces.byte_ids])
    code = F.hex(F.encode(char, "UTF-8"))
    at = F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int"))
    return F.transform(at, lambda k: F.get(table, F.conv(F.substr(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _still() -> Column:
    """The ends of a single character: it is there from the start, and nothing uses it up."""
    return F.array(F.struct(F.lit(1).alias("n"), F.lit(math.inf).alias("peak"), F.lit(-math.inf).alias("made"), F.lit(math.inf).alias("used"))).cast(_SYMBOLS)


def _parted(last: Column, edge: Column, crossing: Column) -> Column:
    """Whether merging keeps the last piece and the next one apart.

    It does unless a piece whose last merge is at the place between them is made of two
    symbols that stand there. They must be there at once, and its rank must come up before
    one of them is used up: the worst rank of the merges in between says whether it does.
    Of equal ranks the leftmost merge goes first. Other pieces that cross the place do not
    count: merging makes a piece in the same way wherever it makes it, and the first merge
    across a place is the last one of the piece that it makes.
    """
    here = edge["start"]

    def joins(c: Column) -> Column:
        def left(x: Column) -> Column:
            def right(y: Column) -> Column:
                meet = (x["used"] > y["made"]) & (y["used"] >= x["made"])
                first = c["rank"] < F.when(y["made"] < x["made"], x["peak"]).otherwise(x["used"])
                second = c["rank"] <= F.when(y["made"] < x["made"], y["used"]).otherwise(y["peak"])
                return (y["n"] == c["end"] - here) & meet & F.when(x["used"] <= y["used"], first).otherwise(second)

            return (x["n"] == here - c["start"]) & F.exists(F.coalesce(edge["left"], _still()), right)

        return (c["end"] <= edge["end"]) & F.exists(F.coalesce(last["right"], _still()), left)

    return ~F.exists(F.get(crossing, here), joins)


def _merged(edges: Column, crossing: Column) -> Column:
    """For each place of a word what merging makes of all before it (identifiers), and the right end of its last piece."""
    start = F.array(F.struct(F.array().alias("ids"), F.array().alias("right"))).cast(f"array<struct<ids:array<int>,right:{_SYMBOLS}>>")

    def step(best: Column, e: Column) -> Column:
        before = F.get(best, e["start"])
        way = F.struct(F.concat(before["ids"], e["ids"]).alias("ids"), e["right"].alias("right"))
        return F.when((F.size(best) > e["end"]) | ~_parted(before, e, crossing), best).otherwise(F.array_append(best, way))

    return F.element_at(F.aggregate(edges, start, step), -1)["ids"]


def _best(edges: Column) -> Column:
    """Identifiers on the path with the largest sum of scores; of equal sums the one with the shorter last piece."""
    start = F.array(F.struct(F.array().alias("ids"), F.lit(0.0).alias("score"))).cast("array<struct<ids:array<int>,score:double>>")

    def step(best: Column, e: Column) -> Column:
        before = F.get(best, e["start"])
        way = F.struct(F.concat(before["ids"], e["ids"]).alias("ids"), (before["score"] - e["rank"]).alias("score"))
        new = F.size(best) == e["end"]
        return F.when(new, F.array_append(best, way)).when(way["score"] >= F.get(best, e["end"])["score"], F.array_append(F.slice(best, F.lit(1), e["end"]), way)).otherwise(best)

    return F.element_at(F.aggregate(edges, start, step), -1)["ids"]


def merge_long(word: str, pieces: Pieces) -> list[int]:
    """The merges of a word of any length, with a heap."""
    n = len(word)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else n
        if 0 <= i and j < n and (s := pieces.scores.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (-s, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j], end[i], right[i] = False, e, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out: list[int] = []
    i = 0
    while i < n:
        out += spell(word[i : end[i]], pieces)
        i = end[i]
    return out


def best_long(word: str, pieces: Pieces) -> list[int]:
    """The best path of a word of any length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        ways = [(best[i][0] + pieces.scores[word[i:e]], i) for i in range(max(0, e - pieces.longest), e) if word[i:e] in pieces.scores]
        if word[e - 1] not in pieces.scores:
            ways.append((best[e - 1][0] + pieces.least - UNKNOWN_PENALTY, e - 1))
        best.append(max(ways))
    out: list[list[int]] = []
    e = len(word)
    while e:
        out.append(spell(word[best[e][1] : e], pieces))
        e = best[e][1]
    return [x for p in reversed(out) for x in p]


def spell(piece: str, pieces: Pieces) -> list[int]:
    if piece in pieces.ids:
        return [pieces.ids[piece]]
    return [pieces.byte_ids[b] for b in piece.encode()] if pieces.byte_ids else [pieces.unknown]


def lattice(words: DataFrame, pieces: Pieces, keys: tuple[str, ...] = ("word",), carried: str | None = None) -> DataFrame:
    """keys, ids (and a carried column) of distinct non-empty words: substrings joined with the piece table, edges grouped and folded.

    Where words are dealt out by their keys, exploding and joining with the broadcast
    table leave them where they are, and grouping the edges moves nothing.
    """
    table = F.broadcast(pieces.frame(words.sparkSession))  # as large as the model
    n = F.length("word")
    others = [carried] if carried else []
    at = words.where(n <= LONG).select(*keys, *others, F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    cut = at.select(*keys, *others, "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + pieces.longest, n))).alias("end"))
    cut = cut.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("end") - F.col("start")))
    # a single character is an edge even if it is no piece
    single = F.col("end") - F.col("start") == 1
    edges = cut.join(table, "piece", "left").where(F.col("id").isNotNull() | single)
    # ends come first, so that edges sort by them, and of one end the longest first
    edge = F.struct(
        "end", "start",
        (-F.coalesce("score", F.lit(pieces.least - UNKNOWN_PENALTY))).alias("rank"),
        F.when(F.col("id").isNull(), _spelled(F.col("piece"), pieces)).otherwise(F.array("id")).alias("ids"),
        (F.col("start") + F.col("split")).alias("middle"),
        F.when(~single, F.col("left")).alias("left"),
        F.when(~single, F.col("right")).alias("right"),
    )
    lists = [F.collect_list(edge).alias("edges")]
    if carried:  # one of the edges carries it, and only that one is grouped with it
        edges = edges.withColumn(carried, F.when(F.col("end") == 1, F.col(carried)))
        lists.append(F.first(carried, ignorenulls=True).alias(carried))
    grouped = edges.groupBy(*keys).agg(*lists)
    longer = lambda es: F.transform(F.filter(es, lambda e: e["end"] - e["start"] > 1), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["rank"].alias("rank"), e["middle"].alias("middle")))
    crossing = lambda es: let(longer(es), lambda c: F.transform(F.sequence(F.lit(0), n), lambda p: F.filter(c, lambda e: e["middle"] == p)))
    ways = (lambda es: let(crossing(es), lambda c: _merged(es, c))) if pieces.kind == "bpe" else _best
    ids = let(F.sort_array("edges"), ways)
    done = grouped.select(*keys, *others, ids.alias("ids"))

    def long(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = merge_long if pieces.kind == "bpe" else best_long
        for batch in batches:
            yield batch.assign(ids=[fold(w, pieces) for w in batch["word"]])

    rest = words.where(n > LONG).select(*keys, *others)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema), "ids array<int>"])
    return done.unionByName(rest.mapInPandas(long, schema))


class _Codes(dict):
    """Codes of words, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """The words of a block of documents, and the codes of their parts."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.words, self.codes = pieces, _Codes(), _Codes()
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def texts(self, found: list[list[str]]) -> list[np.ndarray]:
        """Codes of whole texts, given as words."""
        old = len(self.words)
        numbers = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in found]
        parts = list(map(self.pieces.parts, islice(self.words, old, None)))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = np.concatenate([self.first, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(map(self.codes.__getitem__, chain.from_iterable(parts)), np.uint32, int(size.sum()))])
        return [_gather(self.first[k], self.size[k], self.flat) for k in numbers]


_CODED = "block long, id long, n int, digest binary, codes binary, first int, words array<string>"


def _coded(docs: DataFrame, pieces: Pieces, block_words: int) -> DataFrame:
    """For each block of documents: rows of documents (id, n codes, digest of the text), and rows of words (first code, words)."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        pack, cut = zstandard.ZstdCompressor(level=1).compress, pieces.cutter()
        at = TaskContext.get().partitionId() << 32
        block = _Block(pieces)
        schema = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("codes", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.record_batch([x if isinstance(x := columns.get(f.name, [None] * n), pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

        def words() -> Iterator[pa.RecordBatch]:
            known = list(block.codes)
            for i in range(0, len(known), WORDS_A_ROW):
                yield rows(block=[at], first=[i], words=[known[i : i + WORDS_A_ROW]])

        for batch in row_slices(batches, DOCS_AT_ONCE):
            texts = batch.column("text").to_pylist()
            found = [cut(t) if t else [] for t in texts]
            codes = block.texts(found)
            digest = [hashlib.sha256((t or "").encode()).digest() for t in texts]
            yield rows(block=[at] * len(codes), id=batch.column("id"), n=[len(c) for c in codes], digest=digest, codes=[pack(_planes(c)) for c in codes])
            if len(block.codes) >= block_words:
                yield from words()
                block, at = _Block(pieces), at + 1
        yield from words()

    return docs.mapInArrow(code, _CODED)


def _planes(codes: np.ndarray) -> bytes:
    """The first bytes of all codes, then the second ones, and so on: these pack better."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of several runs, one after another."""
    if not len(sizes) or not sizes.sum():
        return values[:0]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes - starts, sizes)
    return values[at]


def _table(path: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, sizes and identifiers of a block's words, by their codes."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(f"{path}/block={block}")
    table = pq.read_table(where, filesystem=store, columns=["code", "ids"], partitioning=None).combine_chunks()
    code, ids = table["code"].to_numpy(), table["ids"].combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    if not np.array_equal(np.sort(code), np.arange(len(code))):
        raise RuntimeError("a word was not encoded")
    offsets = ids.offsets.to_numpy()
    starts, sizes = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
    starts[code], sizes[code] = offsets[:-1], np.diff(offsets)
    return starts, sizes, ids.values.to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, ids, decoded (the text that the identifiers stand for), exact (whether it is the document's).

    The identifiers are those of the whole text, as the model's own library gives
    them. A null or empty text has none. Repeated rows are encoded alike, null
    identifiers are kept, no documents give no rows. A text of any length is encoded
    whole. Other columns are not read.
    """
    spark = docs.sparkSession
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(DOCS_A_BATCH)}):
        coded = written(_coded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), pieces, block_words), "coded")
    words = coded.where("words is not null").select("block", "first", F.posexplode("words").alias("at", "word"))
    many = coded.where("words is not null").agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = words.withColumn("share", F.floor(F.shiftright("block", 32) / BLOCKS_TOGETHER)).repartition(many // WORDS_A_TASK + 1, "word", "share")
    places = dealt.groupBy("word", "share").agg(F.collect_list(F.struct("block", (F.col("first") + F.col("at")).alias("code"))).alias("places"))
    folded = lattice(places, pieces, ("word", "share"), "places")
    everywhere = let(F.col("ids"), lambda ids: F.transform("places", lambda p: F.struct(p["block"].alias("block"), p["code"].alias("code"), ids.alias("ids"))))
    back = folded.select(F.explode(everywhere).alias("p")).select("p.*")
    path = new_path(spark, "encoded")
    back.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
    spelled = _spelling(pieces)

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        block, starts, sizes, values, parts = None, None, None, None, []
        for batch in row_slices(batches, DOCS_AT_ONCE):
            ids, decoded, exact = [], [], []
            for b, n, codes, digest in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "codes", "digest")), strict=True):
                if n and b != block:
                    block, (starts, sizes, values) = b, _table(path, b)
                    pieces_of = list(map(spelled.__getitem__, values.tolist()))
                    parts = [b"".join(pieces_of[i : i + k]) for i, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
                if n:
                    c = _from_planes(unpack(codes, max_output_size=4 * n), n)
                    ids.append(_gather(starts[c], sizes[c], values))
                    text = b"".join(map(parts.__getitem__, c.tolist())).decode("utf-8", "replace").removeprefix(" ")
                else:
                    ids.append(np.zeros(0, np.int32))
                    text = ""
                decoded.append(text)
                exact.append(hashlib.sha256(text.encode()).digest() == digest)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.record_batch({"id": batch.column("id"), "ids": lists, "decoded": pa.array(decoded, pa.string()), "exact": pa.array(exact, pa.bool_())})

    rows = coded.where("words is null").select("block", "id", "n", "digest", "codes")
    return rows.mapInArrow(look_up, "id long, ids array<int>, decoded string, exact boolean").withColumnRenamed("id", id_col)


def _spelling(pieces: Pieces) -> list[bytes]:
    """What each identifier adds to a decoded text."""
    spelled = [n.replace(SPACE, " ").encode() for n in pieces.names]
    for b, i in enumerate(pieces.byte_ids):
        spelled[i] = bytes([b])
    plain = set(pieces.ids.values()) | set(pieces.byte_ids)
    return [s if i in plain else " ⁇ ".encode() if i == pieces.unknown else b"" for i, s in enumerate(spelled)]


def _text_of(ids: np.ndarray, spelled: list[bytes]) -> str:
    return b"".join(map(spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of identifiers: pieces joined, byte pieces as UTF-8 (broken bytes become U+FFFD), the first space taken off.

    Null or empty identifiers give an empty text; unknown pieces give `` ⁇ ``.
    """
    spelled = _spelling(pieces)

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        return pd.Series(["" if x is None else _text_of(x, spelled) for x in col])

    return rows.withColumn(out_col, text(F.col(ids_col)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, exact."""
    pieces = load()
    rows = encode(read(spark, sf_dir, "documents"), pieces)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "exact")
