"""Chat formatting (operator 8): conversations rebuilt from event logs, then rendered.

Logs are partitioned by conversation and sorted; a fold over the sorted rows, which
holds one message at a time, applies streamed deltas, edits and regenerations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.llm.common import read
from loomgraph.session import written

#: The template: ``### role: text </turn>`` and a line end. A backslash escapes.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLES = frozenset({"assistant"})

EVENT_KINDS = ("message", "delta", "edit", "regenerate")
PIECES = "conv_id long, turn long, part long, role string, text string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    """Backslashes before every character that could begin a control string."""
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the span of its (escaped) text in it."""
    head = OPEN + escape_role(role) + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


TURN = re.compile(r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*) </turn>\n", re.DOTALL)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text and the span of the escaped text."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def _value(x: object) -> object:
    return None if x is None or x is pd.NaT or x != x else x


def _texts(*names: str) -> list[Column]:
    """Whole numbers that may be null, as texts: in pandas they would be floats, which have 53 bits."""
    return [F.col(c).cast("string").alias(c) for c in names]


class _Fold:
    """State of the turn that is being folded, and of its conversation."""

    def __init__(self) -> None:
        self.conv: object = self
        self.turn: object = self
        self.cut: int | None = None  # a regeneration of an earlier turn dropped what was logged before it
        self.regenerated: int | None = None
        self.role, self.parts, self.live, self.part = "", [], False, 0

    def end(self) -> tuple | None:
        if self.regenerated is not None:
            self.cut = self.regenerated if self.cut is None else max(self.cut, self.regenerated)
        out = (self.conv, self.turn, self.part, self.role, "".join(self.parts)) if self.live else None
        self.role, self.parts, self.live, self.regenerated = "", [], False, None
        return out

    def take(self, conv: object, turn: object, seq: int, kind: str, role: str, text: str) -> Iterator[tuple]:
        new = conv != self.conv or turn != self.turn
        if new or (kind == "message" and self.live):
            if out := self.end():
                yield out
            self.part = 0 if new else self.part + 1
        if conv != self.conv:
            self.cut = None
        self.conv, self.turn = conv, turn
        if self.cut is not None and seq < self.cut:
            return
        if kind == "delta":
            self.parts.append(text)
        else:
            self.parts = [text]
        if kind == "regenerate":
            self.regenerated = seq
        self.role = role or self.role
        self.live = True


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of event logs, rendered: a piece for each turn, in the columns of ``PIECES``.

    Events have conv_id, turn, seq, kind, role and text. In each turn, in order of
    seq: ``message`` adds a message (a second one in a turn is a further part of
    it), ``delta`` appends, ``edit`` replaces the text of the last part, and
    ``regenerate`` replaces it and drops all that was logged before for later
    turns. A null kind is a message; null texts and roles are empty; a null
    conversation is one of its own, null turns come first and a null seq counts as
    0. Ties in seq are taken in order of kind, role and text; repeated rows are
    repeated events. The formatted conversation is its pieces in order of turn and
    part, joined; the loss span (of assistant texts, else null) counts code points
    within the piece. Other columns are not read. No events: no rows.
    """
    rows = events.select("conv_id", "turn", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.array_position(F.array(*[F.lit(x) for x in EVENT_KINDS]), F.col("kind"))
    rows = rows.withColumn("rank", order).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "seq", "rank", "role", "text")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Fold()

        def piece(x: tuple) -> tuple:
            text, start, end = render(x[3], x[4])
            loss = x[3] in LOSS_ROLES
            return (*x, text, start if loss else None, end if loss else None)

        def frame(found: list[tuple]) -> pd.DataFrame:
            columns = zip((c.split() for c in PIECES.split(", ")), zip(*found, strict=True), strict=True)
            return pd.DataFrame({name: pd.array([None if x is None else int(x) for x in values], "Int64") if kind == "long" else list(values) for (name, kind), values in columns})

        for batch in batches:
            found = []
            for conv, turn, seq, kind, role, text in zip(batch["conv_id"], batch["turn"], batch["seq"], batch["kind"], batch["role"], batch["text"], strict=True):
                found += map(piece, state.take(_value(conv), _value(turn), int(seq), kind, role, text))
            if found:
                yield frame(found)
        if last := state.end():
            yield frame([piece(last)])

    return rows.select(*_texts("conv_id", "turn"), "seq", "kind", "role", "text").mapInPandas(fold, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces alone: the columns of ``DIGESTS``.

    Rows are sorted within a conversation and hashed as they come.
    """
    rows = pieces.select("conv_id", "turn", "part", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "part")

    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nobody = object()
        conv: object = nobody
        turns = loss = None
        n = chars = total = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"conv_id": pd.array([None if conv is None else int(conv)], "Int64"), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [total]})

        for batch in batches:
            for c, formatted, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                c = _value(c)
                if c != conv or conv is nobody:
                    if conv is not nobody:
                        yield row()
                    conv, turns, loss, n, chars, total = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text, _, _ in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if _value(start) is not None:
                    text = unescape(formatted[int(start) : int(end)])
                    loss.update(text.encode())
                    chars += len(text)
                total += len(formatted)
        if conv is not nobody:
            yield row()

    return rows.select(*_texts("conv_id"), "formatted", "loss_start", "loss_end").mapInPandas(digest, DIGESTS)


#: A conversation whose texts hold the template's own control strings.
EXTRA = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def logged(rows: DataFrame) -> DataFrame:
    """An event log that ends in the given messages (conv_id, turn, role, text), as a chat server would have written it.

    The first half of a text is a draft, which is edited and then regenerated, and the
    second half is streamed after it. Before the regeneration a draft of the next
    turn is logged, which the regeneration drops. Only the first message of a turn is
    regenerated, since a regeneration counts for a turn; others are edited drafts.
    """
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    head, tail = text.substr(F.lit(1), half), text.substr(half + 1, F.length(text))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    turns = F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())).cast("long")
    same = rows.repartition("conv_id").withColumns({"place": place, "at": turns})
    first = F.col("place") == 1

    def event(k: int, kind: str, text: Column, role: Column | str = "role", turn: Column | str = "turn", when: Column = F.lit(True)) -> Column:  # noqa: B008
        seq = (F.col("at") * (1 << 32) + F.col("place") * 8 + k).alias("seq")
        turn = F.col(turn) if isinstance(turn, str) else turn
        role = F.col(role) if isinstance(role, str) else role
        return F.when(when, F.struct(turn.cast("long").alias("turn"), seq, F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")))

    # a message of a turn that has none yet; what is said of the next turn goes with the regeneration
    log = [
        event(0, "message", head),
        event(1, "edit", F.lit("an edit that does not last")),
        event(2, "message", F.lit("an answer to the draft"), F.lit("assistant"), F.try_add("turn", F.lit(1)), first & F.try_add("turn", F.lit(1)).isNotNull()),
        event(3, "regenerate", head, when=first),
        event(3, "edit", head, when=~first),
        event(4, "delta", tail, F.lit(None).cast("string")),
    ]
    return same.select("conv_id", F.explode(F.array_compact(F.array(*log))).alias("e")).select("conv_id", "e.*")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings in its texts, as event logs; folded, rendered and read back."""
    logs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    logs = logs.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    return read_back(written(reconstruct(logged(logs)), "formatted"))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(regexp_replace(text, '[\\#<]', '\\\0', 'g')) + length(regexp_replace(role, '[\\#<:]', '\\\0', 'g')) + 15 AS formatted FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
