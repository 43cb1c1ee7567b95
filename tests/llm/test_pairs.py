"""Substrings, lines, near-duplicates and embeddings against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from goalweave.llm import op2_substrings, op7_lines, op8_minhash, op9_covertree
from llm_rows import edited, frame, odd_rows as make_odd_rows, words



@pytest.fixture
def odd_rows():
    return make_odd_rows()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- substrings


def brute_substrings(rows, window):
    starts = collections.defaultdict(lambda: math.inf)
    split = [WORD.findall(t or "") for _, t, *_ in rows]
    for (doc, *_), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[i : i + window])
                starts[k] = min(starts[k], doc)
    found = []
    for (doc, *_), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and starts[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        found.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=repr)


def substrings(spark, rows, window):
    found = op2_substrings.without_repeats(frame(spark, rows), window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr)


def test_substrings_odd_rows(spark, odd_rows):
    assert substrings(spark, odd_rows, 50) == brute_substrings(odd_rows, 50)


def test_substrings_many_overlaps(spark):
    draw, pool = random.Random(5), [words(100 + i, 45, 30) for i in range(6)]
    rows = [(i * 3 % 101, edited(" ".join(draw.choice(pool) for _ in range(5)), i, draw.randrange(4))) for i in range(90)]
    assert substrings(spark, rows, 22) == brute_substrings(rows, 22)


def test_substrings_empty_table(spark, odd_rows):
    assert op2_substrings.without_repeats(frame(spark, odd_rows).limit(0)).count() == 0


def test_window_below_an_anchor_is_refused(spark, odd_rows):
    with pytest.raises(ValueError):
        op2_substrings.repeats(frame(spark, odd_rows), 5)


# ---- lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_edit_distance():
    draw = random.Random(3)
    for _ in range(4000):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(10)))
        b = list(a)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = draw.choice(["", "a", "c"])
        for most in range(4):
            assert op7_lines.edits_within(a, "".join(b), most) == (edit_distance(a, "".join(b)) <= most)


def brute_lines(rows, least=op7_lines.LEAST):
    places = sorted((d, i, x) for d, t, *_ in rows if d is not None for i, x in enumerate((t or "").split("\n")) if len(x) >= least)
    first = {}
    for d, i, x in places:
        first.setdefault(x, (d, i))
    order = sorted(first, key=first.get)
    late = {
        y for k, y in enumerate(order)
        if any(abs(len(x) - len(y)) <= 1 and (x[: len(x) // 3] == y[: len(x) // 3] or x[-(len(x) // 3) :] == y[-(len(x) // 3) :])
               and edit_distance(x, y) <= 1 for x in order[:k])
    }
    found = collections.defaultdict(set)
    for d, i, x in places:
        if x in late or first[x] != (d, i):
            found[d].add(i)
    return found


def mutated(draw, line):
    at = draw.randrange(len(line))
    return line[:at] + draw.choice(["", "z", "é", line[at] + "q"]) + line[at + draw.randrange(2) :]


def test_lines_with_crowds(spark):
    draw, base = random.Random(7), "the quick brown fox jumps"
    rows = []
    for d in range(150):
        some = [base, mutated(draw, base), mutated(draw, mutated(draw, base)), f"item number {draw.randrange(900):05d} here", "short"]
        rows.append((d * 2, "\n".join(draw.sample(some, 4))))
    rows += [(None, base + "\n" + base), (1, None), (3, ""), (5, base * 400), (7, base * 400 + "!"), (9, "\n\n" + base)]
    docs, wanted = frame(spark, rows), brute_lines(rows)
    found = op7_lines.repeated_lines(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: set(r.removed) for r in found if r.doc_id is not None and r.removed} == dict(wanted)
    assert [r.removed for r in found if r.doc_id is None] == [[1]]
    texts = {r.doc_id: (r.text, r.n_chars) for r in op7_lines.without_repeated_lines(docs).collect()}
    for d, t in rows:
        if t is not None and d is not None:
            kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in wanted[d])
            assert texts[d] == (kept, len(kept))


def test_segments_meet_within_the_edits():
    draw = random.Random(5)
    for _ in range(3000):
        x = "".join(draw.choice("ab") for _ in range(draw.randrange(40, 110)))
        y = list(x)
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(y))
            y[at : at + draw.randrange(2)] = draw.choice(["", "a", "c"])
        x, y = sorted([x, "".join(y)], key=len)
        if op7_lines.allowed(len(x), 4) > 1 and edit_distance(x, y) <= op7_lines.allowed(len(x), 4):
            own = set(op7_lines.segments([x], 4, True)[1].tolist())
            assert own & {k for mine in (True, False) for k in op7_lines.segments(["some other line", y], 4, mine)[1].tolist()}


def test_segments_of_unlike_lines_differ():
    lines = [words(s, 30, 10**6)[:200] for s in range(50)]
    own = op7_lines.segments(lines, 4, True)[1]
    assert len(set(own.tolist())) == len(own) == 250
    assert not set(own.tolist()) & set(op7_lines.segments(lines, 4, False)[1].tolist())


def test_known_segments_let_few_others_pass(spark):
    """All keys the table was made from pass, of a million others with two million keys in it hardly any."""
    keys = spark.range(2_000_000).selectExpr("xxhash64(id) as key")
    known = op7_lines._marks(keys)
    own = keys.toArrow().column("key").to_numpy()
    assert op7_lines._marked(own, known).all()
    others = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 1_000_000)
    assert op7_lines._marked(others, known).sum() < 500


def test_lines_within_more_edits(spark):
    draw, base = random.Random(9), "the quick brown fox jumps over the lazy dog and then it sleeps for a day in 2024 or so"
    lines, rows = [words(s, 12, 10**6) for s in range(40)], []
    for d in range(120):
        some = [base[: draw.choice([34, 45, 63, 86])]]
        for _ in range(draw.randrange(8)):
            some.append(mutated(draw, some[-1]))
        some += [mutated(draw, mutated(draw, mutated(draw, draw.choice(lines)))), f"{base} {draw.randrange(10**9)}"]
        rows.append((d, "\n".join([some[0], some[-3], *some[-2:]])))
    order, late = list(dict.fromkeys(x for _, t in rows for x in t.split("\n"))), set()
    for k, y in enumerate(order):
        if any(abs(len(x) - len(y)) <= 4 and op7_lines.edits_within(x, y, max(1, min(4, min(len(x), len(y)) // 20))) for x in order[:k]):
            late.add(y)
    seen, wanted = set(), {}
    for d, t in rows:
        wanted[d] = []
        for i, x in enumerate(t.split("\n")):
            if x in late or x in seen:
                wanted[d].append(i)
            seen.add(x)
    found = {r.doc_id: r.removed for r in op7_lines.repeated_lines(frame(spark, rows), edits=4).collect()}
    assert found == wanted
    one = {r.doc_id: r.removed for r in op7_lines.repeated_lines(frame(spark, rows)).collect()}
    assert sum(map(len, one.values())) < sum(map(len, found.values()))


def near_earlier(lines, edits=4):
    """Of distinct lines those within their edits of an earlier one."""
    pairs = [(x, y) for k, y in enumerate(lines) for x in lines[:k] if abs(len(x) - len(y)) <= edits]
    most = np.array([op7_lines.allowed(min(len(x), len(y)), edits) for x, y in pairs])
    return {y for (_, y), near in zip(pairs, op7_lines.within(*map(list, zip(*pairs)), most)) if near}


@pytest.mark.parametrize("block", [1 << 14, 50])
def test_crowds_of_lines_truly_apart_make_no_pairs(spark, monkeypatch, block):
    """One word of seven letters is another one in each line: parities are close, distances mostly above four."""
    draw, base = random.Random(11), words(3, 40, 10**6).split(" ")
    made = {}
    while len(made) < 240:
        new = "".join(draw.choice("abcdefghijklmnopqrstuvxy") for _ in range(7))
        made[" ".join([*base[:20], new, *base[20:]])] = None
        if len(made) % 5 == 0:
            made[" ".join([*base[:20], new[:2] + "z" + new[3:], *base[20:]])] = None
    lines = list(made)[:240]
    draw.shuffle(lines)
    wanted, pairs, verified = near_earlier(lines), [], op7_lines._verified
    assert 40 < len(wanted) < 200

    def counted(rows, texts, edits=1):
        pairs.append(rows.count())
        return verified(rows, texts, edits)

    monkeypatch.setattr(op7_lines, "_verified", counted)
    monkeypatch.setattr(op7_lines, "BLOCK", block, raising=False)
    docs = frame(spark, [(d, "\n".join(lines[3 * d : 3 * d + 3])) for d in range(80)])
    found = {r.doc_id: r.removed for r in op7_lines.repeated_lines(docs, equal=1, edits=4).collect()}
    assert found == {d: [i for i in range(3) if lines[3 * d + i] in wanted] for d in range(80)}
    assert sum(pairs) < 8 * len(lines)


def test_near_earlier_lines_of_a_cell():
    """Numbers with the sign bit set, repeated places, lines that only look early or late, tiles."""
    draw, lines = random.Random(13), []
    base = words(4, 30, 10**6)
    for _ in range(1300):
        at = draw.randrange(len(base) - 9)
        lines.append(base[:at] + "".join(draw.choice("abc") for _ in range(draw.randrange(9))) + base[at + 6 :])
    lines = list(dict.fromkeys(lines))
    even, odd = op7_lines.parities(lines)
    assert (even < 0).any()
    n = len(lines)
    table = pa.table({
        "doc_id": np.arange(n) // 3, "at": (np.arange(n) % 3).astype("i4"), "own": np.ones(n, bool), "most": np.full(n, 4, "i4"),
        "even": even, "odd": odd, "line": lines, "early": np.arange(n) % 7 > 0, "later": np.arange(n) % 5 > 0,
    })
    wanted = {
        k for k in range(n) if k % 5 and (before := [i for i in range(k) if i % 7])
        and op7_lines.within([lines[i] for i in before], [lines[k]] * len(before), np.full(len(before), 4)).any()
    }
    found = op7_lines._near_earlier(table.take(pa.array(draw.sample(range(n), n)))).to_pydict()
    assert sorted(3 * d + a for d, a in zip(found["doc_id"], found["at"])) == sorted(wanted)
    assert 0 < len(wanted) < n * 4 // 5
    twice = pa.concat_tables([table.slice(0, 1)] * 2).set_column(8, "later", pa.array([True, True])).set_column(7, "early", pa.array([True, True]))
    assert op7_lines._near_earlier(twice).num_rows == 0


def test_lines_that_meet_no_other_are_not_shuffled(spark, monkeypatch):
    """Of 8 MB of text two lines are wanted; what goes over disk is far less than the text."""
    draw = np.random.default_rng(17)
    rows = [(d, "\n".join(draw.bytes(10_000).hex() for _ in range(2))) for d in range(200)]
    rows.append((200, rows[7][1][:20_000].replace("00", "01", 1)))
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes, write = {}, op7_lines.common.Scratch.write

    def written(self, *what):
        table = write(self, *what)
        sizes.update({f: f.stat().st_size for folder in folders for f in pathlib.Path(folder).rglob("shuffle_*.data")})
        return table

    written(op7_lines.common.Scratch(spark, "test"), spark.range(1), "before")
    before = set(sizes)
    monkeypatch.setattr(op7_lines.common.Scratch, "write", written)
    found = op7_lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), equal=1, edits=4)
    assert [(r.doc_id, r.removed) for r in found.where("n_removed > 0").collect()] == [(200, [0])]
    assert 0 < sum(size for f, size in sizes.items() if f not in before) < 2_000_000


def test_short_lines_repeat(spark):
    rows = [(1, "Les.\nDes.\n\nx"), (2, "Les.\n\nDe."), (3, "x\nLes.\nLes.\nanother line that is long enough"), (None, "Les.\nLes.")]
    found = {r.doc_id: r.removed for r in op7_lines.repeated_lines(frame(spark, rows), equal=1).collect()}
    assert found == {1: [], 2: [0], 3: [0, 1, 2], None: [1]}
    texts = {r.doc_id: r.text for r in op7_lines.without_repeated_lines(frame(spark, rows), equal=1).collect()}
    assert texts == {1: rows[0][1], 2: "\nDe.", 3: "another line that is long enough", None: "Les."}


def test_lines_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    kept = op7_lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert op7_lines.repeated_lines(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == odd_rows[0][1] and texts[2] == texts[3] == "" and texts[6] is None


# ---- near-duplicates


def brute_near(rows, width, percent):
    sets = {}
    for doc, text, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        if doc is not None:
            sets.setdefault(doc, []).append(s)
    flat = [(d, s) for d, some in sets.items() for s in some if s]
    links = [
        (a, b) for i, (a, s) in enumerate(flat) for b, t in flat[:i]
        if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t)
    ]
    return components(sets, links)


def test_near_duplicates_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    found = op8_minhash.near_duplicates(docs, 4).collect()
    assert len(found) == len(odd_rows)
    wanted = brute_near(odd_rows, 4, 80)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    kept = op8_minhash.kept_documents(docs, 4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d, c in wanted.items() if d == c}
    assert op8_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_chain_of_copies(spark):
    draw, texts = random.Random(9), [words(50, 140)]
    for i in range(160):
        texts.append(edited(draw.choice(texts), i, draw.randrange(1, 5)))
    rows = list(enumerate(texts)) + [(1000 + i, words(500 + i, 80)) for i in range(40)]
    found = op8_minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_near(rows, 5, 80)


# ---- embeddings


def brute_vectors(rows, cosine):
    usable = [(i, lab, np.array(x, float)) for i, lab, x in rows if i is not None and lab is not None and x is not None
              and None not in x and np.all(np.isfinite(np.array(x, float))) and np.any(np.array(x, float))]
    links = [
        (i, j) for k, (i, p, x) in enumerate(usable) for j, q, y in usable[:k]
        if p == q and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine
    ]
    counts = collections.Counter(n for pair in links for n in pair)
    return counts, components({i for i, *_ in rows if i is not None}, links)


VECTORS = "vec_id long, label int, embedding array<float>"


def test_vectors_with_hot_groups(spark):
    draw = np.random.default_rng(1)
    rows = [(i, i % 3, draw.normal(size=8).astype("float32").tolist()) for i in range(300)]
    hot = draw.normal(size=8)
    rows += [(300 + i, 1, (hot + 0.15 * draw.normal(size=8)).astype("float32").tolist()) for i in range(150)]
    rows += [(500 + i, 1, hot.astype("float32").tolist()) for i in range(60)]
    rows += [(600, 1, None), (601, 1, [0.0] * 8), (602, 1, [math.nan] * 8), (603, 1, [None] + [1.0] * 7), (604, None, rows[0][2])]
    rows += [(605, 1, [math.inf] * 8), (606, 1, [1.0, 2.0]), (None, 1, hot.tolist()), (607, 0, [])]
    vectors = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS cell", "2 AS point", "3 AS n").repartition(3)
    counts, roots = brute_vectors(rows, 0.93)
    found = op9_covertree.near_vectors(vectors).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == {i: (counts[i], c) for i, c in roots.items()}
    assert op9_covertree.near_vectors(vectors.limit(0)).count() == 0


def test_blocks_and_trees_lose_nothing(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(12, 16))
    points = centers[draw.integers(0, 12, 700)] + 0.22 * draw.normal(size=(700, 16))
    rows = [(i, 7, x.astype("float32").tolist()) for i, x in enumerate(points)]
    for name, value in (("CELL", 90), ("BLOCK", 60), ("LEAF", 4)):
        monkeypatch.setattr(op9_covertree, name, value)
    counts, roots = brute_vectors(rows, 0.93)
    found = op9_covertree.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (counts[i], c) for i, c in roots.items()}
    assert sum(counts.values()) > 1000


def test_vectors_that_repeat(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.001]), (3, 0, [0.0, 1.0])]
    found = op9_covertree.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
