"""Each stage of the pipeline against a brute-force version, on awkward rows and on the smallest table."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from innsight.llm import decontaminate, language
from tests.llm.conftest import SMALL, WORDS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = " ".join(WORDS)


def _rows(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    """Rows without ids, of one id with different texts, repeated ones, near copies, and a clashing column."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    other = " ".join(reversed(WORDS))
    rows = [
        (1, PROSE, "en", "a", 1),
        (None, PROSE, "en", "a", 1),
        (None, other, "en", None, None),
        (None, f"A text of its own without an id, {item}", "en", "b", 1),
        (None, "Another text of its own that has no id either but stays where it is.", None, "b", 1),
        (2, f"{PROSE} {other}", "en", "b", 1),
        (2, "The same id and quite another text, which nothing else resembles at all.", "en", "b", 1),
        (3, f"{PROSE} {other} end", "en", "b", 1),
        (4, item, "en", "b", 1),
        (4, "This text shares its id with a contaminated one and has nothing to do with it.", "en", "b", 1),
        (5, "Repeated rows are one document, whatever their number may be in the end.", "en", "b", 1),
        (5, "Repeated rows are one document, whatever their number may be in the end.", "en", "b", 1),
        (6, None, "en", "b", 1),
        (7, "", "en", "b", 1),
        (8, " ".join(f"w{i}x" for i in range(20_000)), "en", "b", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS _gone", "2 AS _txt", "3 AS joint", "4 AS _key"
    )


def _grams(text, width=5):
    words = [w for w in re.split("[ \t\n\v\f\r]+", (text or "").translate(LOWER)) if w]
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _one_of_each(rows):
    rows = sorted({r[:2]: r for r in sorted(rows, key=str, reverse=True)}.values(), key=lambda r: (r[0] is None, r[0] or 0))
    sets, name = [_grams(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    holders = defaultdict(list)
    for i, grams in enumerate(sets):
        for gram in grams:
            holders[gram].append(i)
    for i, j in {(i, j) for held in holders.values() for i in held for j in held if j < i}:
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            low, high = sorted((root(i), root(j)))
            name[high] = low
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[root(i)].append(row)
    return list(groups.values())


def test_near_stage(spark, mixed, awkward, documents, nothing):
    for frame in (mixed, awkward, documents):
        before = _rows(frame)
        after = pipeline.keep_one_of_near_duplicates(spark, frame, SMALL)
        assert after.columns == pipeline.COLUMNS
        kept, groups = _rows(after), _one_of_each(before)
        assert len(kept) == len(groups) and set(kept) <= set(before)
        for group in groups:
            first = group[0][0]
            assert [r[0] for r in kept if r[:2] in {g[:2] for g in group}] == [first]
    assert pipeline.keep_one_of_near_duplicates(spark, nothing, SMALL).count() == 0


def _covered(text, item):
    """Words of ``item`` that greedy string tiling finds in ``text``, one match after the other."""
    d, i = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (4,)
        for a in range(len(i)):
            for b in range(len(d)):
                n = 0
                while a + n < len(i) and b + n < len(d) and i[a + n] == d[b + n] and a + n not in used_i and b + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if len(best) == 1:
            return total, len(i)
        n, a, b = best
        used_i.update(range(a, a + n))
        used_d.update(range(b, b + n))
        total += n


def test_decontamination_stage(spark, mixed, awkward, nothing):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    sets = [_grams(t) for t in items]
    for frame in (mixed, awkward):
        after = pipeline.drop_contaminated(spark, frame, SMALL)
        assert after.columns == pipeline.COLUMNS
        wanted = Counter()
        for row in _rows(frame):
            words = set(re.findall(r"\w+", (row[1] or "").lower()))
            near = [t for t, s in zip(items, sets, strict=True) if s and len(words & set(re.findall(r"\w+", t.lower()))) >= 5]
            found = [_covered(row[1], t) for t in near] if len(row[1] or "") < 2000 else []
            if not any(2 * n >= of for n, of in found):
                wanted[row] += 1
        assert Counter(_rows(after)) == wanted
        assert sum(wanted.values()) < len(_rows(frame)) or frame is awkward
    assert pipeline.drop_contaminated(spark, nothing, SMALL).count() == 0


def test_line_stage(spark, mixed, awkward, documents, nothing):
    for frame in (mixed, awkward, documents):
        rows = _rows(frame)
        first: dict = {}
        for key, text, *_ in rows:
            for line in (text or "").split("\n"):
                bare = line.strip(" \t\n\v\f\r").translate(LOWER)
                if len(bare) >= 10:
                    first.setdefault(bare, set()).add((key is None, key or 0))
        wanted = Counter()
        for key, text, lang, source, chars in rows:
            mine = (key is None, key or 0)
            lines = (text or "").split("\n")
            kept = [x for x in lines if mine == min(first.get(x.strip(" \t\n\v\f\r").translate(LOWER), {mine}))]
            cut = "\n".join(kept)
            if len(kept) == len(lines) or cut.strip(" \t\n\v\f\r"):
                wanted[key, cut, lang, source, len(cut)] += 1
        after = pipeline.drop_repeated_lines(spark, frame, SMALL)
        assert after.columns == pipeline.COLUMNS
        assert Counter(_rows(after)) == wanted
    assert pipeline.drop_repeated_lines(spark, nothing, SMALL).count() == 0


def test_language_stage(spark, documents, mixed, nothing):
    both = documents.select(*pipeline.COLUMNS).unionByName(mixed.select(*pipeline.COLUMNS))
    after = pipeline.identify_language(spark, both.selectExpr("*", "1 AS score", "2 AS rejected"), SMALL)
    assert after.columns == pipeline.COLUMNS
    before, kept = Counter(_rows(both)), Counter(_rows(after))
    assert kept <= before
    gone = before - kept
    assert all(n == before[r] for r, n in gone.items())  # equal rows fare alike
    assert {r for r in before if not re.search(r"[^\W\d_]", r[1] or "")} <= set(gone)
    assert sum(gone.values()) < 0.1 * sum(before.values())
    assert pipeline.identify_language(spark, nothing, SMALL).count() == 0


def test_chain(spark):
    pieces = pipeline.run(spark, SMALL)
    rows = pieces.collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(whole)
    assert docs.count() == len(whole)


def test_long_texts_of_one_word_are_tiled_quickly():
    places = np.array([(d, i) for i in range(36) for d in range(50_000)])
    tiles = decontaminate.tiling(places[:, 0], places[:, 1], 5)
    assert sum(t[2] for t in tiles) == 40


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Who knows?"), (2, "the old mill by the river"), (3, "")], "item_id long, text string")
    docs = [(1, "who KNOWS"), (2, "Who knows what"), (3, "the old mill by the river"), (4, ""), (5, "the old mill by")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, 2, 1, 2), (3, 2, 6, 6, 1, 6)}


def test_language_without_labelled_rows(spark, nothing, mixed):
    model = language.train(nothing.select("doc_id", "text", "lang"))
    assert language.predict_languages(mixed, model).count() == mixed.count()


def test_kept_text_is_computed_once(spark, documents):
    """Twice, for a filter and for its result, took two Python workers for each task."""
    plan = pipeline.drop_repeated_lines(spark, documents, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_carried_text_goes_to_the_workers_once(spark, documents, mixed):
    model = language.train(documents)
    found = language.predict_languages(mixed, model, carried=("text", "lang", "source"))
    assert found.columns == ["doc_id", "lang_pred", "score", "rejected", "text", "lang", "source"]
    wanted = Counter(tuple(r) for r in mixed.select("doc_id", "text", "lang", "source").collect())
    assert Counter(tuple(r) for r in found.select("doc_id", "text", "lang", "source").collect()) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sent = re.search(r"MapInArrow \w+\(([^)]*)\)", plan)[1]
    assert len(sent.split(",")) == 4
