"""Mixing, pieces, fingerprints, token files, sharding and the quality classifier against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from llm_rows import edited, frame, odd_rows as make_odd_rows, words
from pyspark.sql import functions as F

from goalweave.llm import op1_mixing, op3_pieces, op4_fingerprints, op5_token_files, op6_sharding, op10_quality

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def odd_rows():
    return make_odd_rows()


# ---- mixing


def plain_targets(sizes, weights, share, cap):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        left, open_ = budget - sum(full.values()), [s for s in order if s not in full]
        over = [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full |= {s: cap * sizes[s] for s in over}


def plain_rates(sizes, target, cap):
    """Rates of one source by bisection on its multiplier."""
    total, mean = sum(sizes), sum(sizes) / max(1, sum(s > 0 for s in sizes))
    if target >= cap * total:
        return [float(cap)] * len(sizes)
    low, high = -500.0, 500.0
    for _ in range(200):
        m = (low + high) / 2
        rates = [min(cap, math.exp(min(m * s / mean, 700))) for s in sizes]
        low, high = (m, high) if sum(r * s for r, s in zip(rates, sizes)) < target else (low, m)
    return rates


def test_mixing_meets_targets(spark, odd_rows):
    draw = random.Random(1)
    rows = [(1000 + i, words(i, draw.choice([3, 20, 20, 50, 200])), draw.choice(["a", "a", "a", "b", "c", "é", "Z"])) for i in range(400)]
    rows += [r for r in odd_rows if len((r[1] or "").split()) < 5000]
    docs = frame(spark, rows)
    found = op1_mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in some) for s, some in by_source.items()}
    wanted = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    for source, some in by_source.items():
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(wanted[source], rel=1e-9) for r in some)
        rates = plain_rates([r.size for r in some], wanted[source], 2)
        assert all(abs(r.rate - q) < 1e-5 for r, q in zip(some, rates) if r.size)
        assert all(r.taken == r.copies * r.size and abs(r.copies - r.rate) < 2 and r.copies in (0, 1, 2) for r in some)
        smallest = min((r.size for r in some if r.size), default=0)
        assert abs(sum(r.taken for r in some) - wanted[source]) <= max(smallest, 0.02 * wanted[source])
    assert [r.size for r in found if r.doc_id == 10] == [2 + 1]
    again = op1_mixing.mixed(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in found)
    repeated = op1_mixing.mixture(docs)
    assert repeated.columns == docs.columns
    # Rows without doc_id are not mixed; 12 and 13 repeat.
    named = op1_mixing.mixed(docs.where("doc_id is not null")).where("doc_id not in (12, 13)").collect()
    copies = collections.Counter(r.doc_id for r in repeated.where("doc_id not in (12, 13)").collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in named if r.copies})


def test_mixing_one_size_is_counted_out(spark):
    rows = [(i, "a b c", "s") for i in range(500)] + [(1000 + i, "d e", "t") for i in range(20)]
    found = op1_mixing.mixed(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in found)


def test_mixing_empty_tables(spark, odd_rows):
    docs = frame(spark, odd_rows)
    assert op1_mixing.mixed(docs.limit(0)).count() == 0
    blank = op1_mixing.mixed(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0), (0, 0, 0.0)]


# ---- pieces


def test_pieces_are_the_model_s_own(spark, odd_rows):
    import sentencepiece

    rows = odd_rows + [(30, "  a  b ", "a"), (31, "\n\n a\n", "a"), (32, "<s> <0x0A> </s>\x00\x01", "a"), (33, "ab" * 300 + " " * 50 + "c", "a"), (34, "ﬁ é 日本 🎉", "b")]
    docs, model = frame(spark, rows), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = collections.Counter((d, tuple(model.encode(t or ""))) for d, t, *_ in rows)
    coded = op3_pieces.encoded(docs, PIECES, ["doc_id"])
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == wanted
    back = op3_pieces.decoded(coded, PIECES, ["doc_id"]).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((d, (t or "").replace("▁", " ")) for d, t, *_ in rows)
    for r in op3_pieces.checksums(docs, PIECES).collect():
        assert r.exact or r.doc_id == 16
    both = op3_pieces.round_trips(docs, PIECES, ["doc_id", "source"])
    assert both.columns == ["doc_id", "source", "ids", "decoded"] and both.count() == len(rows)
    assert op3_pieces.checksums(docs.limit(0), PIECES).count() == 0


def test_relaxation_on_random_strings():
    import sentencepiece

    draw, model = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["".join(draw.choice("etaoinshrdlu  E.\n") for _ in range(draw.randrange(300))) for _ in range(300)]
    coder = op3_pieces.PieceCoder(PIECES)
    for _ in range(2):  # the second time from what is remembered
        assert [ids.tolist() for ids in coder.encode(texts)] == [model.encode(t) for t in texts]


def test_suffix_ranges_find_every_occurrence():
    pieces = op3_pieces.Pieces(PIECES)
    text = "the then there\0another thee"
    ranks = pieces.rank[np.array([ord(c) for c in text])]
    edges = op3_pieces.Edges(pieces, ranks)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = {model.id_to_piece(int(i)) for i in pieces.ids}
    for p in range(len(text)):
        for n in range(2, 17):
            inside = p + n <= len(text) and text[p : p + n] in known
            assert (edges.find(np.array([p]), np.array([n]))[0] >= 0) == inside


# ---- fingerprints


def test_fingerprints_of_edited_texts(spark, odd_rows):
    rows = odd_rows + [(100 + i, words(i, 300, 3000), "a") for i in range(60)]
    docs = frame(spark, rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    wanted = collections.Counter()
    for (d, t, *_), (_, u, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        changed = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        a, b, c = op4_fingerprints.written(op4_fingerprints.digests([x.encode() for x in (t, changed, u)]))
        wanted[d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, op4_fingerprints.compared(a, b), op4_fingerprints.compared(a, c)] += 1
    found = op4_fingerprints.edited_fingerprints(docs).collect()
    assert collections.Counter(map(tuple, found)) == wanted
    unlike = [r for r in found if r.doc_id is not None and r.doc_id >= 100]
    assert all(r.near_edited > r.near_next and r.near_edited > 0.5 for r in unlike)
    assert all(0 <= r.near_next <= 1 for r in found)
    plain = op4_fingerprints.fingerprints(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in plain) == collections.Counter((r.doc_id, r.fingerprint) for r in found)


def test_fingerprints_of_one_row_and_none(spark):
    (one,) = op4_fingerprints.edited_fingerprints(frame(spark, [(5, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert op4_fingerprints.edited_fingerprints(frame(spark, [(5, "a")]).limit(0)).count() == 0
    (blank,) = op4_fingerprints.edited_fingerprints(frame(spark, [(5, None)])).collect()
    assert (blank.n_chars, blank.near_edited, blank.fingerprint) == (0, 1.0, "00" * 65)


# ---- token files


def test_token_files_hold_the_tokenizer_s_ids(spark, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    rows = odd_rows + [(40, "it's. <|endoftext|> A<|startoftext|>b", "a"), (41, "ABC, abc. Été 'll can't!! H̱  x", "a")]
    docs, model = frame(spark, rows), Tokenizer.from_file(WORDS)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    wanted, start = [], 0
    for d, t, *_ in ordered:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        wanted.append((d, start, len(ids), ids))
        start += len(ids)
    files = op5_token_files.written_files(docs, WORDS, 2)
    found = op5_token_files.read_checksums(files).collect()
    key = lambda r: (r[1], repr(r[0]))
    assert sorted(map(tuple, found), key=key) == sorted(((d, s, n, zlib.crc32(i.tobytes())) for d, s, n, i in wanted), key=key)
    ids = {r.start: r.value for r in op5_token_files.read_ids(files).collect()}
    assert all(ids[s] == i.tolist() for _, s, _, i in wanted)
    by_file = {r.file: op5_token_files.TokenFile(r.file) for r in files.collect()}
    assert sum(len(f.index) for f in by_file.values()) == len(rows)
    (holder,) = [f for f in by_file.values() if 40 in f.index["doc_id"].tolist()]
    assert holder.find(40).tolist() == [i for d, _, _, i in wanted if d == 40][0].tolist()
    with pytest.raises(KeyError):
        holder.find(999)


def test_the_dictionary_s_sample_is_from_all_over_a_document():
    short, long = np.arange(4095), np.arange(100_000)
    assert op5_token_files.spread(short) is short
    some = op5_token_files.spread(long)
    assert some[0] == 0 and some[-1] == 99_999 and (np.diff(some) > 0).all() and 4000 < len(some) < 4096
    assert np.flatnonzero(np.diff(some) > 1).tolist() == [511 * k - 1 for k in range(1, 8)]
    edge = op5_token_files.spread(np.arange(4096))
    assert edge[0] == 0 and edge[-1] == 4095 and len(edge) == 4088


def test_token_files_of_nothing_and_with_a_trained_dictionary(spark):
    docs = frame(spark, [(i, words(i, 60)) for i in range(200)])
    assert len(op5_token_files.train_dictionary(docs, WORDS, 2)) > 1000
    empty = op5_token_files.written_files(docs.limit(0), WORDS, 2)
    assert op5_token_files.read_checksums(empty).count() == 0


# ---- sharding


def checked_shards(spark, rows, shards):
    found = op6_sharding.balanced(frame(spark, rows), shards).collect()
    assert len(found) == len(rows)
    wanted = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == wanted
    slots = collections.defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    return found


def test_shards_are_even_and_keep_groups(spark, odd_rows):
    rows = [(i, f"single {i}") for i in range(600)] + [(1000 + i, f"group {i % 40}") for i in range(160)]
    found = checked_shards(spark, rows, 10)
    groups = collections.defaultdict(set)
    for r in found:
        if r.doc_id >= 1000:
            groups[(r.doc_id - 1000) % 40].add(r.shard)
    assert sum(len(s) == 1 for s in groups.values()) >= 36
    checked_shards(spark, odd_rows, 4)


def test_no_linked_group_stays_split(spark):
    rows = [(i, f"single {i}") for i in range(400)] + [(1000 + i, f"group {i % 150}") for i in range(600)]
    shards = collections.defaultdict(set)
    for r in checked_shards(spark, rows, 10):
        if r.doc_id >= 1000:
            shards[(r.doc_id - 1000) % 150].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_large_groups_take_as_few_shards_as_hold_them(spark):
    sizes = [250, 60, 60, 39, 99, 26]
    rows = [(i, f"single {i}") for i in range(1000 - sum(sizes))] + [(1000 * (g + 1) + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
    shards = collections.defaultdict(set)
    for r in checked_shards(spark, rows, 10):
        shards[r.doc_id // 1000 - 1].add(r.shard)
    assert [len(shards[g]) for g in range(len(sizes))] == [3, 1, 1, 1, 1, 1]


def test_a_hot_group_is_split(spark):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(100)]
    checked_shards(spark, rows, 8)


def test_shards_of_few_rows_and_none(spark):
    checked_shards(spark, [(1, "a"), (2, None)], 5)
    assert op6_sharding.balanced(frame(spark, [(1, "a")]).limit(0), 4).count() == 0


# ---- quality


def good_text(seed):
    draw = random.Random(seed)
    return ". ".join(" ".join(f"{draw.choice('abcdefgh')}{draw.randrange(3000)}x" for _ in range(9)).capitalize() for _ in range(draw.randrange(2, 20)))


def bad_text(seed):
    text = good_text(seed)
    return [text.upper() + "!!", " ".join(w + "***" for w in text.split()), "word " * 80, text.replace(" ", " | ")][seed % 4]


def plain_scores(rows, weights):
    """The hierarchy with plain loops."""
    logit = [float(np.clip(np.dot(op10_quality.figures(t), weights), -30, 30)) for _, t, *_ in rows]
    chance = [1 / (1 + math.exp(-z)) for z in logit]
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for p, (_, _, s) in zip(chance, rows):
        hosts[s].append(p)
        paths[s, "en"].append(p)
    overall = sum(chance) / len(chance)

    def weight(groups, center):
        spread = sum(len(g) * (sum(g) / len(g) - center(k)) ** 2 for k, g in groups.items())
        expected = sum(center(k) * (1 - center(k)) for k in groups)
        most = sum(len(g) * center(k) * (1 - center(k)) for k, g in groups.items())
        between = max(spread - expected, 0) / most
        return min(max(1 / between - 1 if between > 0 else 1e6, 5.0), 1e6)

    wh = weight(hosts, lambda k: overall)
    center = {h: (sum(g) + wh * overall) / (len(g) + wh) for h, g in hosts.items()}
    wp = weight(paths, lambda k: center[k[0]])
    found = []
    for z, p, (d, _, s) in zip(logit, chance, rows):
        host = (sum(hosts[s]) - p + wh * overall) / (len(hosts[s]) - 1 + wh)
        path = (sum(paths[s, "en"]) - p + wp * host) / (len(paths[s, "en"]) - 1 + wp)
        found.append((d, 1 / (1 + math.exp(-(z + math.log(path / (1 - path)) - math.log(overall / (1 - overall)))))))
    return found


def test_quality_on_held_out_documents(spark, odd_rows):
    rows = [(i, bad_text(i) if i % 5 == 0 else good_text(i), f"site{i % 7}" if i % 11 else None) for i in range(700)]
    rows += [(900, None, "site1"), (901, "", None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 350)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in op10_quality.scores(docs, labels, "source", "lang").collect()}
    assert len(found) == len(rows)
    held_out = [found[i].kept == (i % 5 != 0) for i in range(350, 700)]
    assert np.mean(held_out) > 0.98
    weights = op10_quality.trained(docs, labels)
    for d, posterior in plain_scores(rows, weights):
        assert found[d].posterior == pytest.approx(posterior, abs=1e-9)
    kept = op10_quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.kept}


def test_sparse_sites_shrink_toward_the_whole(spark):
    rows = [(i, bad_text(i), "bad") for i in range(200)] + [(1000 + i, good_text(i), "good") for i in range(200)] + [(5000, bad_text(3), "tiny"), (5001, good_text(3), "tiny")]
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, *_ in rows[:400]], "doc_id long, quality int")
    rate = {r.doc_id: r.host_rate for r in op10_quality.scores(frame(spark, rows), labels).collect()}
    assert rate[0] < 0.1 < 0.2 < rate[5000] < 0.9 < rate[1000]


def test_quality_without_labels_keeps_all(spark, odd_rows):
    docs = frame(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op10_quality.kept_documents(docs, none).count() == len(odd_rows)
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert op10_quality.scores(docs, one_kind).where("kept").count() == len(odd_rows)
    both = spark.createDataFrame([(1, 1), (15, 0)], "doc_id long, quality int")
    assert op10_quality.scores(docs, both).count() == len(odd_rows)
    assert op10_quality.scores(docs.limit(0), both).count() == 0
