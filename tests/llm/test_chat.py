import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from loomgraph.llm.chat import logged, parse, read_back, reconstruct, render

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string, loss_start string"


@given(st.lists(st.tuples(st.text("ab\\#<:/\n é", max_size=12), st.text("ab\\#<:>/turn\n é", max_size=30))))
def test_round_trip(turns):
    out = "".join(render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in parse(out)] == turns


def test_fold(spark):
    log = [
        (1, 0, 1, "message", "user", "hi", "x"),
        (1, 1, 2, "message", "assistant", "", "x"),
        (1, 1, 3, "delta", None, "Hel", "x"),
        (1, 1, 4, "delta", "assistant", "lo", "x"),
        (1, 2, 5, "message", "user", "old question", "x"),
        (1, 3, 6, "message", "assistant", "old answer", "x"),
        (1, 1, 7, "regenerate", "assistant", "Bonjour", "x"),
        (1, 1, 8, "edit", "assistant", "Salut", "x"),
        (1, 2, 9, "message", "user", "new question", "x"),
        (2, 0, None, None, "user", None, "x"),
        (None, None, 1, "message", None, "nobody", "x"),
        (3, 5, 1, "message", "user", "a", "x"),
        (3, 5, 1, "message", "user", "a", "x"),
    ]
    random.Random(2).shuffle(log)
    got = reconstruct(spark.createDataFrame(log, SCHEMA))
    rows = sorted(((r.conv_id, r.turn, r.part, r.role, r.text) for r in got.collect()), key=repr)
    want = [(1, 0, 0, "user", "hi"), (1, 1, 0, "assistant", "Salut"), (1, 2, 0, "user", "new question"), (2, 0, 0, "user", ""), (None, None, 0, "", "nobody"), (3, 5, 0, "user", "a"), (3, 5, 1, "user", "a")]
    assert rows == sorted(want, key=repr)
    one = {r.conv_id: r for r in read_back(got).collect()}
    assert len(one) == 4 and one[1].n_turns == 3
    assert one[1].loss_sha256 == hashlib.sha256(b"Salut").hexdigest() and one[1].loss_chars == 5
    assert one[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nSalut\nuser\nnew question\n").hexdigest()
    assert one[2].loss_chars == 0 and one[None].n_turns == 1


def test_none_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert reconstruct(none).count() == 0 and read_back(reconstruct(none)).count() == 0
    long = spark.createDataFrame([(1, 0, 0, "message", "assistant", "</turn>#\\" * 100_000, None)], SCHEMA)
    assert read_back(reconstruct(long)).first().loss_chars == 900_000


def test_logs_end_in_their_messages(spark):
    rows = [(1, 0, "user", "a question"), (1, 1, "assistant", "an answer"), (1, 2, "user", None), (1, 3, "assistant", "x"), (1, 3, "assistant", "x"), (1, 3, "user", "y"), (2, None, "user", "no turn"), (None, 4, None, ""), (3, 7, "assistant", "é" * 5001)]
    log = logged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "edit", "delta", "regenerate"}
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in reconstruct(log).collect()), key=repr)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=repr)


def test_large_identifiers_and_turns(spark):
    big = 2**53 + 1
    rows = [(big, 2**40, "user", "a"), (big, 2**40 + 1, "assistant", "b"), (big, 2**63 - 1, "user", "last"), (None, 0, "user", "n"), (big - 1, None, "user", "other"), (big - 1, big, "assistant", "x"), (big - 1, big + 1, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    pieces = reconstruct(logged(frame))
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in pieces.collect()), key=repr) == sorted(rows, key=repr)
    assert {(r.conv_id, r.n_turns) for r in read_back(pieces).collect()} == {(big, 3), (None, 1), (big - 1, 3)}
