import hashlib
import random
import zlib

import pytest

from loomgraph.llm import prefix_trie
from loomgraph.llm.prefix_trie import Node, Tree, op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, prefix_trie_id(role, text), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    total = {s: [0, 0] for s in nodes}
    kids = {s: 0 for s in nodes}
    for s in nodes:
        if s:
            kids[s[:-1]] += 1
    for s, members in nodes.items():
        saved = (len(members) - 1) * len(s[-1][1]) if s else 0
        for d in range(len(s) + 1):
            total[s[:d]][0] += not kids[s]
            total[s[:d]][1] += saved
    return [
        (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids[s], *total[s], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == s).encode()).hexdigest())
        for s, m in nodes.items()
    ]


def prefix_trie_id(role, text):
    enc = "".join(f"{len(x.encode())}:{x}" for x in (role, text))
    return hashlib.sha256(enc.encode()).hexdigest()[:32] + f"{len(text):08x}"


def ran(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted([tuple(r) for r in op13_prefix_trie(spark, str(tmp_path)).collect()], key=repr)


def test_layouts_grow():
    node = Node(b"")
    kids = {b: Node(bytes([b])) for b in random.Random(1).sample(range(256), 256)}
    seen = set()
    for i, (b, kid) in enumerate(kids.items(), 1):
        node.put(b, kid)
        seen.add((i, node.layout))
        assert node.child(b) is kid
    assert {(4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)} <= seen
    assert node.children() == sorted(kids.items())
    assert Node(b"").child(3) is None


def test_tree_against_prefixes():
    """Turn ids that share bytes within a turn, so that inner nodes lie between whole turns, and keys that end at inner nodes."""
    rng = random.Random(3)
    ids = [bytes([rng.choice(b"ab"), rng.randrange(256)]) * 8 + rng.randrange(9).to_bytes(4, "big") for _ in range(90)]
    keys = {b"".join(rng.choices(ids, k=rng.randrange(5))) for _ in range(400)} | {b"", ids[0] * 50}
    keys = list(keys)
    rng.shuffle(keys)
    tree = Tree()
    for i, key in enumerate(keys):
        tree.insert(key, 1 + i % 3, i, key)
    want = {}
    for i, key in enumerate(keys):
        for d in range(len(key) // prefix_trie.WIDTH + 1):
            n, low = want.get(key[: d * prefix_trie.WIDTH], (0, i))
            want[key[: d * prefix_trie.WIDTH]] = (n + 1 + i % 3, min(low, i))
    got, paths = {}, []
    for up, depth, n, low, length, end in tree.turns():
        assert (up == -1) == (depth == 0)
        # the end tells the key, and parents come first
        paths.append((up, depth, n, low, length, end))
        if end is not None:
            got[end] = (n, low)
            assert len(end) == depth * prefix_trie.WIDTH and (not depth or int.from_bytes(end[-4:], "big") == length)
            assert not depth or paths[up][1] == depth - 1
    assert len(paths) == len(want)
    assert got == {k: want[k] for k in keys}
    assert sorted(p[2:4] for p in paths) == sorted(want.values())


ROWS = [
    (c, t, r, x)
    for c in range(60)
    for t, r, x in [(None if c % 7 == 0 else 0, "user", "hi"), (1, "assistant", f"é{c % 3}"), (2, None, None if c % 2 else "z"), (2, "user", f"{c % 5}"), (3, "", "end")][: c % 6]
]
OTHER = [(100, 0, "user", "hi"), (105, 0, "user", "hi"), (105, 1, "u", "\U0001f600"), (207, None, "a", "x"), (-7, 0, "user", "hi"), (-7, 5, "user", "hi"), (None, 1, "a", "b"), (2**53 + 1, 1, "user", "hi"), (2**53 + 3, 2**40, "user", "hi"), (300, 0, "user", "w" * 2_000_000), (301, 0, "q", "long"), (59, 2, "user", "4"), (59, 2, "user", "4")]


@pytest.mark.parametrize("limit", [2, 250])
def test_query_against_brute_force(spark, tmp_path, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (limit,))
    rows = ROWS + OTHER
    assert ran(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_copies_and_a_long_conversation(spark, tmp_path, monkeypatch):
    """A third of the conversations are the same, and one has many turns; identifiers are hashed in several texts."""
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(7)]
    rows += [(5, t, "user", f"{t % 4}") for t in range(300)] + [(c, 0, "user", f"own {c}") for c in range(2000, 2090)]
    assert ran(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_none_and_other_columns(spark, tmp_path):
    assert ran(spark, tmp_path / "a", []) == []
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x")]
    assert ran(spark, tmp_path / "b", [(*r, 4, b"k") for r in rows], SCHEMA + ", at int, key binary") == sorted(brute(rows), key=repr)


def test_query_against_its_sql(spark, tmp_path):
    """Ties of one turn are taken in one order by both."""
    import duckdb

    rows = ROWS + OTHER + [(31, 1, r, t) for r in ("user", "assistant", "é") for t in ("x", "y", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = ran(spark, tmp_path, rows)
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    found = con.execute(prefix_trie.OP13_SQL)
    names = [d[0] for d in found.description]
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=repr) == got == sorted(brute(rows), key=repr)
