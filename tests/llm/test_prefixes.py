"""The prefix trie against a plain trie of dictionaries."""

import hashlib
import re
import zlib
from collections import defaultdict

from pathwatch.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, p1 long, digest string, depth string, conv string"


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children(key)), sum(not children(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    return sorted(map(tuple, prefixes.trie(spark.createDataFrame([(*r, 1, "d", "e", "c") for r in rows], SCHEMA)).collect()), key=str)


ROWS = [(c, t, "user" if t % 2 == 0 else "bot", f"text {(c * t) % 3} of turn {t}") for c in range(0, 64) for t in range(1 + c % 6)]
ODD = [
    (100, None, None, None), (100, 1, "", "a"), (100, 1, "a", ""), (100, 1, "a", ""), (100, 0, "x", " \t\x0b words \x0c here too"),
    (119, 5, "user", "own"), (121, 1, "user", "base is absent"), (122, 1, "u", "x"), (122, 2, "u", "x"), (123, 1, None, "y"), (None, 1, "user", "nobody's"), (2**60, 0, "user", "far"), (2**60 + 7, 0, "user", "far"), (0, 0, "user", "text 0 of turn 0"),
]


def test_against_a_plain_trie(spark):
    got = found(spark, ROWS + ODD)
    assert got == sorted(plain(ROWS + ODD), key=str)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)  # a turnless conversation ends at the root


def test_pieces_chunks_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    # one conversation of very many turns, all alike, and many that are the same
    rows = [(5, 1, "u", "same words")] * 90 + [(c, t, "u", f"t{t}") for c in range(200, 240) for t in range(3)]
    want = sorted(plain(rows), key=str)
    assert found(spark, rows) == want
    cut = prefixes.with_prefixes
    monkeypatch.setattr(prefixes, "with_prefixes", lambda turns: cut(turns, 7))
    assert found(spark, rows) == want


def test_empty_tables_and_very_long_texts(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "t")]) == []
    rows = [(20, 0, "u", "word " * 200000), (40, 0, "u", "word " * 200000 + "x")]
    assert found(spark, rows) == sorted(plain(rows), key=str)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    written, names = prefixes.written, []
    monkeypatch.setattr(prefixes, "written", lambda df, name: names.append(name) or written(df, name))
    found(spark, [(0, t, "u", f"t{t}") for t in range(40)])
    assert names.count("jump") == 1 + 6  # the depth is 40
