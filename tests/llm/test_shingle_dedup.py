"""The pipeline's near-dedup against all pairs' exact shingle similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from looseleaf.llm import shingle_dedup, simhash_dedup

from .test_corpus import plain_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def changed(base, seed, n):
    rng, out = random.Random(seed), list(base)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"other{seed}x{k}"
    return out


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def plain_groups(rows, similarity=0.8):
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(sets)
    near = lambda a, b: not (a or b) or len(a & b) >= similarity * len(a | b)
    root = plain_components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(sets[a], sets[b])])
    return {i: root.get(i, i) for i in ids}


def corpus():
    rows, base = [], words(1, 300)
    for k in range(40):  # a family of near copies at 0.8 to 0.97 of the first, so farther from each other
        rows.append((100 + k, " ".join(changed(base, k, 1 + k % 6))))
    chain = words(2, 300)
    for k in range(12):  # each near the next, the ends far apart
        rows.append((300 + k, " ".join(chain)))
        chain = changed(chain, 50 + k, 4)
    far = words(3, 300)
    rows += [(400 + k, " ".join(changed(far, 90 + k, 12))) for k in range(15)]  # alike, but below 0.8
    rows += [(500 + k, " ".join(words(200 + k, 100))) for k in range(30)] + [(600, "one two"), (601, "One  TWO"), (602, ""), (603, None), (604, " ".join(words(1, 300)).upper())]
    return rows


def test_groups_match_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r.component_id for r in shingle_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_a_key_cut_by_batches_stays_one(spark):
    rows = [(k, s) for k in range(40) for s in range(1 + k % 7 * 11)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = shingle_dedup._proposed(spark.createDataFrame(rows, "key long, set long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.key, r.a, r.b) for r in got) == [(k, 0, s) for k, s in rows if k % 7]


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 10, "x"), (2, "A b c d e f", 20, "y"), (None, "q", 30, "z"), (1, "a b c d e f", 10, "x")], "id long, t string, k1 long, text_hash string")
    got = simhash_dedup.one_of_each(df, "id", "t", group=shingle_dedup.similar_groups)
    assert got.columns == df.columns and sorted(got.collect(), key=str) == [(1, "a b c d e f", 10, "x"), (None, "q", 30, "z")]
    assert simhash_dedup.one_of_each(df.limit(0), "id", "t", group=shingle_dedup.similar_groups).count() == 0


def test_stage_drops_edited_copies(spark):
    rows = [r for r in corpus() if r[1]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    want = plain_groups(rows)
    assert {r.doc_id for r in stage(spark, df, "").collect()} == {i for i in want if want[i] == i}
    fps = {i: simhash_dedup.fingerprint(t.encode()) for i, t in rows}
    # pairs that must be linked lie beyond two bits
    assert any((fps[100] ^ fps[i]).bit_count() > 2 and want[i] == 100 for i in fps)


def test_other_similarities(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        shingle_dedup.similar_groups(df, similarity=0.7)


def plain_codeword(word):
    """Index of the nearest Golay codeword, by comparing all."""
    return min(range(4096), key=lambda i: ((i << 11 | simhash_dedup._remainder(i << 11)) ^ word).bit_count())


def test_keys_are_golay_codewords_of_the_simhash():
    hashes = shingle_dedup.shingle_set(" ".join(words(9, 200)).encode())
    ballots = shingle_dedup.votes(hashes)
    plain = [sum(1 if int(h) >> k & 1 else -1 for h in hashes) for k in range(64)]
    assert ballots[:64].tolist() == plain  # the first 64 bits are those of the plain SimHash
    tables = simhash_dedup._tables()
    near = shingle_dedup.near_codewords(ballots[: 23 * 20].reshape(20, 23), tables)
    for row, got in zip(ballots[: 23 * 20].reshape(20, 23).tolist(), near.tolist()):
        word, loose = sum(1 << k for k, v in enumerate(row) if v > 0), sorted(range(23), key=lambda k: (abs(row[k]), k))[:6]
        flipped = {word ^ sum(1 << loose[j] for j in range(6) if m >> j & 1) for m in range(64)}
        found = {plain_codeword(w) for w in flipped}
        cost = {i: sum(abs(v) for k, v in enumerate(row) if ((i << 11 | simhash_dedup._remainder(i << 11)) ^ word) >> k & 1) for i in found}
        assert [(x >> 12, x & 4095) for x in got] == sorted((c, i) for i, c in cost.items())[:6]
    keys = shingle_dedup.golay_keys(ballots[None], tables)[0]
    assert len(set(keys.tolist())) == len(keys) == shingle_dedup.BANDS * shingle_dedup.KEYS
    best = keys[keys >> 24 == 0] & 0xFFFFFF
    assert int(near[0, 0] & 4095) << 12 | int(near[1, 0] & 4095) in best


def test_golay_keys_propose_all_pairs_at_the_threshold():
    rng, tables = np.random.default_rng(4), simhash_dedup._tables()
    for both, a, b in [(4, 1, 0), (8, 1, 1), (28, 2, 5), (40, 10, 0), (400, 50, 50)]:  # each at exactly 0.8
        ballots = []
        for _ in range(200):
            h = rng.integers(0, 1 << 64, both + a + b, np.uint64)
            ballots += [shingle_dedup.votes(h[: both + a]), shingle_dedup.votes(np.concatenate([h[:both], h[both + a :]]))]
        ballots = np.stack(ballots)
        keys, tags = shingle_dedup.golay_keys(ballots, tables), shingle_dedup.tags_of(ballots).view(np.uint32)
        apart = np.bitwise_count(tags[::2] ^ tags[1::2])
        bands = [len({k >> 24 for k in set(x.tolist()) & set(y.tolist()) if d[k >> 24] <= shingle_dedup.RADIUS}) for x, y, d in zip(keys[::2], keys[1::2], apart)]
        assert min(bands) >= 1 and sum(bands) / len(bands) > 0.46 * shingle_dedup.BANDS
        assert apart.sum(axis=1).max() <= shingle_dedup.SCREEN * shingle_dedup.BANDS * shingle_dedup.TAG


def test_small_keys_give_pairs_and_large_ones_their_first(spark):
    rng, rows = random.Random(8), []
    for k in range(30):
        rows += [(rng.getrandbits(32) << 29 | k, s) if s % 3 else (k, s) for s in range(1 + k)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = shingle_dedup._proposed(spark.createDataFrame(rows, "key long, set long"), 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tag = {(x & (1 << 29) - 1, s): x >> 29 for x, s in rows}
    near = lambda k, a, b: (tag[k, a] ^ tag[k, b]).bit_count() <= shingle_dedup.RADIUS
    want = [(k, a, b, None, True) for k in range(16) for b in range(k + 1) for a in range(b) if near(k, a, b)]
    want += [(k, 0, s, tag[k, s], near(k, 0, s)) for k in range(16, 30) for s in range(k + 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_overfull_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "BUCKET", 1)  # every key goes by its first member, then by components
    rows = corpus()
    got = {r.doc_id: r.component_id for r in shingle_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)
