"""The prefix trie against a dictionary of every prefix."""

import hashlib
import random
import zlib

import pytest

from nabd.llm import trie

TURNS = "conv_id long, turn long, role string, text string, key int, part string, n_convs long"


def sequences(rows):
    """Turns (role, text) of each conversation; turn numbers are told apart in these tests."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def rebuilt_by_hand(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def nodes_by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    parents = {q[:-1] for q in members if q}
    out = []
    for p, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        out.append(
            (
                min(own),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(own),
                sum(len(q) == len(p) + 1 for q in below[p]),
                sum(q not in parents for q in below[p]),
                sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 7) for r in rows], TURNS)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Small tables stay in several partitions, so that ranges and shards do meet."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["", "a", "ab", "é€😀", "long " * 30]
    out = []
    for c in [*range(0, 130), 205, 299, 300, 301, 350, 1000]:
        # Conversation 200 is missing, so 205 and 299 lose their first turns and may have none left.
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role, text = rng.choice(["user", "assistant", None]), rng.choice([*texts, None])
            out.append((c, t if t else None, role, text))
    out += [(c, t, "user", "hot") for c in range(400, 460) for t in range(6)]  # a group of copies
    out += [(None, 0, "user", "nobody"), (None, 1, "user", "nobody")]
    out += [(500, t, "user", f"turn {t}") for t in range(400)]  # one conversation of many turns
    out += [(7, 3, "user", "same"), (7, 3, "user", "same")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard_turns", [5, 1 << 18])
def test_nodes(spark, rows, shard_turns):
    own = sequences(rows)
    got = result(trie.prefix_trie(table(spark, rows), shard_turns))
    assert got == nodes_by_hand(own)


def test_digest(spark, rows):
    convs = rebuilt_by_hand(sequences(rows))
    assert any(not turns for turns in convs.values())
    got = result(trie.digest(table(spark, rows).repartition(5), 12))
    assert got == nodes_by_hand(convs)


def test_ids_are_hashed_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = [(c, 0, "user", "hi") for c in range(5, 25)]
    got = result(trie.prefix_trie(table(spark, rows)))
    assert got == nodes_by_hand(sequences(rows))


def test_small_tables(spark):
    assert trie.digest(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    got = result(trie.prefix_trie(table(spark, [(3, None, None, None)])))
    assert got == nodes_by_hand({3: [("", "")]})
    # One conversation whose base is missing and whose first h turns are all it has.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    got = result(trie.digest(table(spark, [(c, 0, "user", "x"), (c, 1, "user", "y")])))
    assert got == nodes_by_hand({c: []})


def test_roles_and_texts_do_not_run_into_each_other(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc"), (4, 0, "abc", "")]
    got = result(trie.prefix_trie(table(spark, rows)))
    assert got == nodes_by_hand(sequences(rows)) and len(got) == 5


def test_one_long_conversation_is_numbered_over_ranges(spark):
    rows = [(1, t, "user", f"{t}") for t in range(3000)]
    turns = trie.numbered(table(spark, rows).repartition(4))
    assert turns.select("part").distinct().count() > 1
    assert [r["pos"] for r in turns.orderBy("pos").collect()] == list(range(1, 3001))
