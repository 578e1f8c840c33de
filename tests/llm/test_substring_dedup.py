"""Passages against all common runs of words of a small corpus."""

import random
import re

import numpy as np

from looseleaf.llm import substring_dedup

from .test_corpus import prose


def corpus():
    rng = random.Random(7)
    shared = [prose(900 + k, 55 + 7 * k) for k in range(6)] + ["ok " * 70, "na na boo " * 30, "é-ü " * 60]
    rows = []
    for i in range(32):
        parts = [prose(1000 + i, rng.randrange(5, 90))]
        for p in rng.sample(shared, rng.randrange(3)):
            parts += [p.upper() if rng.random() < 0.2 else p, prose(2000 + 10 * i + len(parts), rng.randrange(3, 40))]
        rows.append((i, rng.choice(["", "x", "yy "]) + " ".join(parts)))
    # Fifteen words each of many documents, side by side: no other document holds more than fifteen of them.
    words = [prose(1000 + i, 90).split()[:15] for i in range(32)]
    rows.append((60, " ".join(w for k in (5, 9, 13, 17, 21, 25) for w in words[k])))
    return rows


def places(text):
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def common_runs(rows, least):
    """(id, start, end) of every longest run of `least` words or more that one other document holds too."""
    tokens = {i: places(t) for i, t in rows}
    out = []
    for i, a in tokens.items():
        best = np.zeros(len(a) + 1, int)  # the longest common run that begins at each word
        for j, b in tokens.items():
            if i == j:
                continue
            before = np.zeros(len(b) + 1, int)
            for x in range(len(a) - 1, -1, -1):
                now = np.zeros(len(b) + 1, int)
                same = np.array([w[0] == a[x][0] for w in b])
                now[:-1] = np.where(same, before[1:] + 1, 0)
                best[x] = max(best[x], now.max())
                before = now
        out += [(i, a[x][1], a[x + n - 1][2], n) for x in range(len(a)) if (n := int(best[x])) >= least and (x == 0 or best[x - 1] <= n)]
    return out


def test_against_all_common_runs(spark):
    rows = corpus()
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in substring_dedup.duplicate_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    slack = 3 * substring_dedup.REACH + 80  # cuts inside the ends; monotonous text is cut at up to LONGEST / 2 more
    for i, a, b, n in common_runs(rows, 51):
        assert any(x <= a + slack and y >= b - slack for x, y, _ in got.get(i, [])), (i, a, b, n, got.get(i))
    short = {}
    for i, a, b, _ in common_runs(rows, 20):
        short.setdefault(i, []).append((a, b))
    for i, found in got.items():
        for x, y, n in found:
            assert n >= 25 and any(a - 10 <= x and y <= b + 10 for a, b in short[i]) or len(set(texts[i][x:y].lower().split())) < 8, (i, x, y)
    assert 60 not in got
    clean = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    for i, a, b, n in common_runs(sorted(clean.items()), 51):
        assert len(set(clean[i][a:b].lower().split())) < 8, (i, clean[i][a:b])


def test_same_id_and_clashing_names(spark):
    p = prose(77, 70)
    rows = [(1, p, 5), (1, p, 5), (1, prose(1, 40) + " " + p, 6), (2, prose(2, 40) + " " + p + " " + prose(3, 40), 7), (2, prose(4, 200), 8)]
    df = spark.createDataFrame(rows, "id long, text string, hash long")
    out = substring_dedup.without_repeats(df, "id")
    assert out.columns == df.columns
    left = {(r.id, r.hash): r.text for r in out.collect()}
    assert left[2, 8] == rows[4][1] and left[1, 5] == p and left[1, 6] == rows[2][1] and len(left[2, 7]) < len(rows[3][1]) - 0.5 * len(p)
    assert substring_dedup.without_repeats(df.limit(0), "id").count() == 0
