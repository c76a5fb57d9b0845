"""The n-gram join against a comparison of all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from innsight.llm import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text, width):
    words = [w for w in re.split("[ \t\n\v\f\r]+", (text or "").translate(LOWER)) if w]
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _brute(rows, percent=85, width=4):
    sets = [_grams(t, width) for _, t in rows]
    name = list(range(len(rows)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                name[root(i)] = root(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return Counter((key, len(sets[i]), least.get(root(i), key)) for i, (key, _) in enumerate(rows))


def _crowd(seed):
    """Near copies of one text, texts that share a long passage only, and a chain of shifted ones."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:50] + [f"q{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))])) for i in range(120)]
    rows += [(2000 + i, " ".join(base[i : i + 60])) for i in range(60)]
    # short texts in which each shingle is common but few pairs are similar
    rows += [(3000 + i, " ".join(rng.sample(base[:9], 7))) for i in range(150)]
    return rows


@pytest.mark.parametrize(("seed", "fragments"), [(2, 4), (3, 1), (4, 7)])
def test_crowds(spark, seed, fragments):
    rows = _crowd(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.join_documents(frame, fragments=fragments)
    assert Counter(map(tuple, got.collect())) == _brute(rows)


def test_other_thresholds(spark):
    rows = _crowd(5)[:400]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.join_documents(frame, percent=60, width=2)
    assert Counter(map(tuple, got.collect())) == _brute(rows, 60, 2)


def test_awkward(awkward, nothing, documents):
    for frame in (awkward, documents):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = jaccard_join.join_documents(frame)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert Counter(map(tuple, got.collect())) == _brute(rows)
    assert jaccard_join.join_documents(nothing).count() == 0
