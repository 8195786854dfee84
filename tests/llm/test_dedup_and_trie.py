"""Exact duplicates and the prefix trie beside plain versions, on small tables with nulls, ties, repeats, long texts and clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import exact_dedup, prefix_trie

DOCS = "doc_id long, text string, h0 string, n long, forms string"
TURNS = "conv_id long, turn long, role string, text string, key string, depth string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], DOCS).repartition(3)


def lower(t):
    return (t or "").encode().lower()


def plain_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = max(known) if known else None, False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(text).hexdigest()))
            seen = seen or i == keep
    return sorted(out, key=repr)


LONG = "Ab c" * 30_000
TEXTS = ["", None, "x", "X", "É", "é", "Word word", "word WORD", LONG, LONG.lower(), LONG[:-1] + "d", "\0", "\0\0", "\0X", "ẞ", "ß", "K", "k", "z" * 256, "z" * 257, "Z" * 256]


@pytest.mark.parametrize("prime", [exact_dedup.PRIME, 5])
def test_classes_meet_the_plain_version(spark, prime):
    rows = [*enumerate(TEXTS), (3, "X"), (3, "X"), (None, "x"), (None, "alone"), (None, "alone"), (40, "q"), (41, "r"), (42, "s"), (43, "Q")]
    got = exact_dedup.exact_classes(docs(spark, rows), prime=prime, chunk=64 if prime == 5 else exact_dedup.CHUNK)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_classes(rows)


def test_collided_fingerprints_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abAB") for _ in range(rng.randint(0, 9)))) for i in range(300)]
    got = exact_dedup.exact_classes(docs(spark, rows), prime=3, chunk=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_classes(rows)


def test_no_documents_no_classes(spark):
    assert exact_dedup.exact_classes(docs(spark, [(1, "a")]).limit(0)).collect() == []


def test_hashes_of_parts_combine_to_the_whole(spark):
    data = bytes(range(256)) * 41 + b"tail"
    for prime in (exact_dedup.PRIME, 251):
        hashes = exact_dedup.Fingerprints(prime)
        of = lambda b: tuple(int(x) for x in hashes.of(b, np.array([0, len(b)]))[0])  # noqa: E731, B023
        plain = tuple(sum(c * pow(x, len(data) - 1 - i, prime) for i, c in enumerate(data)) % prime for x in exact_dedup.BASES)
        assert of(data) == plain
        for cut in (0, 1, 255, 256, 257, 5000, len(data)):
            assert exact_dedup.combine(of(data[:cut]), of(data[cut:]), len(data) - cut, prime=prime) == plain
    many = [b"", b"a", data, b"", data[:256], b"b" * 300]
    offsets = np.cumsum([0, *map(len, many)])
    hashes = exact_dedup.Fingerprints()
    assert hashes.of(b"".join(many), offsets).tolist() == [hashes.of(b, np.array([0, len(b)]))[0].tolist() for b in many]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children, leaves, saved = Counter(n[:-1] for n in nodes if n), Counter(), Counter()
    for n, cs in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(nodes[n]) if len(rebuilt[c]) == len(n)).encode()).hexdigest()
    return sorted(((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], ends(n)) for n, cs in nodes.items()), key=repr)


def trie(spark, rows, run_bytes=prefix_trie.RUN_BYTES):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, run_bytes).collect()), key=repr)


@pytest.mark.parametrize("run_bytes", [1, 2000, prefix_trie.RUN_BYTES])
def test_trie_meets_the_plain_version(spark, run_bytes):
    rng = random.Random(run_bytes)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "", None, "c  d e"])) for c in range(230) for t in range(rng.choice([1, 2, 3, 4, 6, 40 if c % 50 == 0 else 5]))]
    rows += [(500 + c, t, "user", "same words here") for c in range(90) for t in range(7)]  # a hot conversation
    rows += [(700 + c, t, "user", "same words here" if t < 6 else f"{t}") for c in range(60) for t in range(6 + c % 9)]  # snapshots
    rows += [(7, None, None, "first"), (8, 1, "user", "tie"), (8, 1, "bot", "tie"), (8, 1, "bot", "tie"), (None, 1, "user", "nobody's"), (-3, 0, "user", "x"), (-3, 1, "user", "y" * 100_000)]
    assert trie(spark, rows, run_bytes) == plain_trie(rows)


def test_long_conversations_and_none(spark):
    rows = [(c, t, "user", "w " * (t % 5)) for c in (0, 1, 20, 21) for t in range(200 + c)]
    assert trie(spark, rows) == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)).collect() == []


def test_merged_runs_carry_what_neighbours_share():
    rng = random.Random(4)
    path = lambda: b"".join(bytes([rng.randint(0, 1)]) * prefix_trie.TURN for _ in range(rng.randint(0, 12)))
    for n in (0, 1, 2, 5, 9):
        rows = list({path() for _ in range(400)})
        runs = prefix_trie.Runs(rng.choice([1, 20_000, 10**9]))
        for k in range(n):
            runs.add([(p, p[::-1]) for p in rows[k::n]])
        got = list(runs.merged())
        want = sorted(rows) if n else []
        assert [g[0] for g in got] == want and all(g[2] == g[0][::-1] for g in got)
        assert [g[1] for g in got] == [prefix_trie.common_turns(a, b) for a, b in zip([b"", *want], want)]
