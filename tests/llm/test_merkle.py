import hashlib
import zlib

import numpy as np
import pytest

from loomgraph.llm import merkle
from loomgraph.llm.merkle import op11_manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Rows of the query, from plain hashing of whole runs."""

    def leaf(row):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])

    def grown(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
        return levels

    def up(levels, at, digest, proof):
        for nodes in levels[:-1]:
            run = list(nodes[at - at % 3 : at - at % 3 + 3])
            proof += [x for i, x in enumerate(run) if i != at % 3]
            run[at % 3] = digest
            at, digest = at // 3, h(*run)
        return digest

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown_trees = {s: grown([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = grown([grown_trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, digest, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            even = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0
            now = leaf((*row[:4], None if row[4] is None else row[4].replace("\n", ""))) if even else digest
            proof = []
            folded = up(top, at, up(grown_trees[s], i, now, proof), proof)
            root = top[-1][0]
            out.append((row[0], digest, grown_trees[s][-1][0], root, h(*proof), folded, folded == root))
    return out


def ran(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in op11_manifest(spark, str(tmp_path)).collect()]


def test_states_against_the_standard_library():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(7)), np.uint8).reshape(7, 32)
    up, records, counts = merkle.parents(digests, np.array([1, 4, 2]))
    hexed = [d.tobytes().hex() for d in digests]
    assert [d.tobytes().hex() for d in up] == [h(hexed[0]), h(*hexed[1:4]), h(hexed[4]), h(*hexed[5:7])] and list(counts) == [1, 2, 1]
    other = np.frombuffer(hashlib.sha256(b"other").digest(), np.uint8).reshape(1, 32)
    for slot in range(3):  # only the state before the slot and what is to the right of it is read
        record = records[1].copy()
        record[[i for i in range(merkle.RECORD) if i // 32 != slot and not 3 + slot < i // 32]] = 7
        changed, _, _ = merkle.climbed(other, record[None], np.array([slot]), np.array([3]), merkle.start(1), np.zeros(1, np.int64))
        want = [*hexed[1:4]]
        want[slot] = other[0].tobytes().hex()
        assert changed[0].tobytes().hex() == h(*want)


def test_query_against_brute_force(spark, tmp_path):
    """One large tree of three layers beside small ones, nulls anywhere, repeated rows, a long text, names that are not ASCII."""
    rows = [(i, "hot", "en", 3, f"a\n{i}") for i in range(700)]
    rows += [(i, s, None, None, t) for i, s, t in [(1, "é", "x"), (2, "é", None), (3, None, "y\n"), (4, "", ""), (5, "z", "\n\n"), (5, "z", "\n\n"), (5, "z", "q"), (None, "z", "w\n"), (None, None, None), (9, "\U0001f600", "a" * 3_000_000)]]
    want = brute(rows)
    assert sorted(ran(spark, tmp_path, rows), key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_small_tables_and_other_columns(spark, tmp_path, n):
    rows = [(i, "s", "en", 2, "b\n") for i in range(n)]
    got = ran(spark, tmp_path, [(*r, 1, b"x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at int, tree binary")
    assert sorted(got) == sorted(brute(rows))


def test_no_documents(spark, tmp_path):
    assert ran(spark, tmp_path, []) == []
