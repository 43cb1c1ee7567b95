"""Digests, line edits and sharding against plain versions that share nothing with the operators."""

from __future__ import annotations

import collections
import itertools
import math
import random
import zlib

import numpy as np
from llm_rows import edited, frame, odd_rows, words
from test_pairs import edit_distance, mutated

from goalweave.llm import op4_fingerprints, op6_sharding, op7_lines

# ---- fingerprints: triplets counted one by one

U32 = 2**32


def plain_bucket(kind: int, a: int, b: int, c: int) -> int:
    h = (a * 2654435761 + b * 2246822519 + c * 3266489917 + 668265263 * kind) % U32
    h ^= h >> 15
    return (h * 2246822519 % U32) >> 24


def plain_digest(text: str | None) -> str:
    raw = (text or "").encode()
    counts = collections.Counter()
    for kind, (i, j, k) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
        counts.update(plain_bucket(kind, raw[at + i], raw[at + j], raw[at + k]) for at in range(len(raw) - k))
    ranked = sorted(counts[b] for b in range(256))
    cuts = [ranked[63], ranked[127], ranked[191]]
    quartiles = [sum(counts[b] > cut for cut in cuts) for b in range(256)]
    step = min(255, math.floor(8 * math.log2(len(raw))) + 1) if raw else 0
    packed = [sum(q << s for q, s in zip(quartiles[k : k + 4], (6, 4, 2, 0))) for k in range(0, 256, 4)]
    return bytes([step, *packed]).hex()


def plain_likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if not x[0] or not y[0]:
        return float(x[0] == y[0])
    quarters = lambda raw: [byte >> s & 3 for byte in raw[1:] for s in (6, 4, 2, 0)]
    apart = sum(abs(p - q) for p, q in zip(quarters(x), quarters(y))) + 2 * abs(x[0] - y[0])
    return max(0.0, 1 - apart / 320)


def test_digests_count_triplets(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    rows += [(100 + i, words(i, n, 3000), "a") for i, n in enumerate([1, 2, 3, 30, 300])] + [(200, "ab"), (201, "abc"), (202, "abcd"), (203, "\n" * 300)]
    found = op4_fingerprints.fingerprints(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in found) == collections.Counter((d, plain_digest(t)) for d, t, *_ in rows)


def test_likeness_counts_quartiles():
    texts = [None, "abc", words(1, 200, 3000), edited(words(1, 200, 3000), 5, 20), words(2, 200, 3000), words(3, 900, 3000)]
    for a, b in itertools.product(map(plain_digest, texts), repeat=2):
        assert abs(op4_fingerprints.compared(a, b) - plain_likeness(a, b)) < 1e-12


# ---- lines, as the query has them: up to four edits, equal ones from one character on


def plain_lines(rows, edits=4):
    """Each line against each earlier different one, by tables."""
    named = sorted(((d, i, x) for d, t, *_ in rows if d is not None for i, x in enumerate((t or "").split("\n")) if x), key=lambda p: p[:2])
    first: dict = {}
    for d, i, x in named:
        first[x] = min(first.get(x, (d, i)), (d, i))
    order, late = sorted(first, key=first.get), set()
    for k, y in enumerate(order):
        for x in order[:k]:
            short = min(len(x), len(y))
            most = max(1, min(edits, short // 20))
            if short >= 20 and abs(len(x) - len(y)) <= most and edit_distance(x, y) <= most:
                late.add(y)
                break
    found = []
    for d, t, *_ in rows:
        lines, seen, gone = (t or "").split("\n"), set(), []
        for i, x in enumerate(lines):
            again = x in seen
            seen.add(x)
            if x and (again or x in late or (d is not None and first[x][0] != d)):
                gone.append(i)
        found.append((d, 0 if t is None else len(lines), tuple(gone)))
    return collections.Counter(found)


def test_edits_up_to_four_are_those_of_the_table():
    draw = random.Random(12)
    for _ in range(1500):
        a = "".join(draw.choice("abcd") for _ in range(draw.choice([0, 3, 30, 70])))
        b = list(a)
        for _ in range(draw.randrange(7)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(3)] = draw.choice(["", "a", "é", "cd"])
        b = "".join(b)
        distance = edit_distance(a, b)
        assert [op7_lines.edits_within(a, b, most) for most in range(5)] == [distance <= most for most in range(5)]


def flipped(a, b):
    """Bits in which the parities of two lines differ."""
    even, odd = op7_lines.parities([a, b])
    return sum(((int(x[0]) ^ int(x[1])) & (1 << 64) - 1).bit_count() for x in (even, odd))


def test_an_edit_flips_four_parities_at_most():
    draw = random.Random(21)
    for _ in range(2000):
        a = b = "".join(draw.choice("abcdé ") for _ in range(draw.randrange(1, 90)))
        edits = draw.randrange(5)
        for _ in range(edits):
            at = draw.randrange(len(b) + 1)
            b = b[:at] + draw.choice(["", "z", "é"]) + b[at + draw.randrange(2) :]
        assert flipped(a, b) <= 4 * edits
    assert flipped("", "") == flipped("x", "") == 0 and flipped("xy", "") == 1


def test_parities_tell_lines_about_one_template_apart():
    """Lines four substitutions each from a template are eight apart: few of their pairs are left to compare."""
    draw, template = random.Random(22), (words(3, 60, 10**6))[:172]
    lines = []
    for _ in range(800):
        line = list(template)
        for at in draw.sample(range(len(line)), 4):
            line[at] = draw.choice("BCDFGHJKLM")
        lines.append("".join(line))
    even, odd = (x.view("u8") for x in op7_lines.parities(lines))
    close = sum(int((np.bitwise_count(even[i] ^ even[:i]) + np.bitwise_count(odd[i] ^ odd[:i]) <= 16).sum()) for i in range(800))
    assert close < 20 * 800


def test_distances_of_many_pairs_at_once():
    draw, a, b, most = random.Random(23), [], [], []
    for _ in range(600):
        x = y = "".join(draw.choice("abc") for _ in range(draw.choice([0, 1, 5, 40, 80])))
        for _ in range(draw.randrange(7)):
            at = draw.randrange(len(y) + 1)
            y = y[:at] + draw.choice(["", "a", "zz"]) + y[at + draw.randrange(2) :]
        a.append(x), b.append(y), most.append(draw.randrange(5))
    assert op7_lines.within(a, b, np.array(most)).tolist() == [edit_distance(x, y) <= m for x, y, m in zip(a, b, most)]
    assert op7_lines.within([], [], np.array([], int)).tolist() == []


def test_lines_as_registered(spark):
    """Nulls, repeated rows and ids, empty texts, ties, short, long and equal lines, with the query's own parameters."""
    draw, base = random.Random(2), "the quick brown fox jumps over the lazy dog and then it sleeps for a day or two"
    rows = [(d, "\n".join([mutated(draw, base[: draw.choice([19, 25, 45, 79])]), draw.choice(["Les.", "x", ""]), words(d % 9, 9, 10**6)])) for d in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, None), (None, base + "\n" + base + "\nLes.\nLes."), (53, base), (53, base), (53, "another\nLes.\n" + base)]
    rows += [(54, base * 40 + "\n" + base), (55, base * 40 + "!!\nx\nx"), (56, base[:-1] + "\n" + base[1:])]
    found = op7_lines.repeated_lines(frame(spark, rows), equal=1, edits=4).collect()
    got = collections.Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in found)
    assert got == plain_lines(rows) and all(r.n_removed == len(r.removed) for r in found)
    assert op7_lines.repeated_lines(frame(spark, rows).limit(0), equal=1, edits=4).count() == 0


# ---- sharding: links cut, against the least that any even assignment cuts


def cut_links(groups, shards):
    """Of each group's links to its first member, those that lead to another shard."""
    return sum(shards[member] != shards[group[0]] for group in groups for member in group[1:])


def test_links_cut_are_the_fewest_possible(spark):
    groups = [[0, 1, 2], [3, 4], [5, 6], [7], [8]]
    rows = [(i, f"text of group {g}") for g, group in enumerate(groups) for i in group]
    sizes = [3, 3, 3]
    least = min(
        cut_links(groups, assignment)
        for assignment in itertools.product(range(3), repeat=9)
        if collections.Counter(assignment) == dict(enumerate(sizes))
    )
    found = {r.doc_id: r.shard for r in op6_sharding.balanced(frame(spark, rows), 3).collect()}
    assert sorted(collections.Counter(found.values()).values()) == sizes
    assert least == 0 and cut_links(groups, found) <= 1


def test_links_cut_are_far_fewer_than_by_hash(spark):
    draw = random.Random(4)
    groups, at = [], 0
    for size in [draw.choice([1, 1, 2, 3, 5, 12]) for _ in range(150)]:
        groups.append(list(range(at, at + size)))
        at += size
    rows = [(i, f"text of group {g}") for g, group in enumerate(groups) for i in group]
    found = {r.doc_id: r.shard for r in op6_sharding.balanced(frame(spark, rows), 6).collect()}
    by_hash = {i: zlib.crc32(str(i).encode()) % 6 for i in range(at)}
    # Groups of a tenth of a shard and more do not always find one with room for all of them.
    assert cut_links(groups, found) < 0.15 * cut_links(groups, by_hash)
