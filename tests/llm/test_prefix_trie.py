"""The trie against one built by dictionaries, and the defined results of odd rows."""

import hashlib
import random
import zlib

from littoral.llm import queries
from littoral.llm.prefix_trie import build, number_turns, ranked

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    by = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role, key, (role, text)))
    return {c: [x[-1] for x in sorted(turns)] for c, turns in by.items()}


def rebuilt(by):
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = by.get(root, [])[:h] + turns[h:]
    return out


def brute(by):
    members = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(by[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rng):
    rows = []
    for c in rng.sample(range(-150, 320), 150):
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "é€", "", None, "a longer text"])) for t in range(rng.choice([1, 1, 2, 3, 5, 8]))]
    deep = [(900, t, "user", str(t % 3)) for t in range(70)]
    rows += deep + [(901, *r[1:]) for r in deep[:40]] + [(902, *r[1:]) for r in deep] + [(903, None, "user", "0"), (903, 5, "b", "z"), (903, 5, "a", "y"), (903, 5, "a", "y")]
    rows += [(None, 1, "user", "nobody's")] + [(1_000 + k, t, "user", "same") for k in range(60) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_against_dictionaries(spark):
    rows = conversations(random.Random(4))
    turns, convs = number_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(build(turns, convs)) == brute(ordered(rows))
    assert rows_of(build(queries._rebuilt(turns, convs), convs)) == brute(rebuilt(ordered(rows)))


def test_odd_tables(spark):
    turns, convs = number_turns(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))
    assert rows_of(build(turns, convs)) == []
    long = "long " * 200_000
    rows = [(7, None, None, None), (9, 0, "user", long), (11, 0, "user", long)]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place long, name string")
    turns, convs = number_turns(wide)
    assert rows_of(build(turns, convs)) == brute(ordered(rows))
    none = turns.filter("false")
    assert rows_of(build(none, convs)) == brute({7: [], 9: [], 11: []})


def test_names_are_dense_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaaab"), rng.randint(0, 5), k) for k in range(500)]
    got = ranked(spark.createDataFrame(rows, "x string, y long, k long").repartition(7), ["x", "y"], ["k"]).collect()
    order = {key: n for n, key in enumerate(sorted({r[:2] for r in rows}))}
    assert all(r["name"] == order[r["x"], r["y"]] for r in got)
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == [k for *_, k in sorted(rows)] and {r["place"] for r in got} == set(range(500))
