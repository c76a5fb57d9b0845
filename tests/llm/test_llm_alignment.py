"""Token alignment against the libraries and a walk over all common ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from innsight.llm import alignment
from innsight.llm.queries import tokenizer_path

A_PATH, B_PATH = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def _bytes(a, b):
    letters = alignment._byte_letters()
    return (
        lambda i: bytes(letters[c] for c in a.id_to_token(i)),
        lambda i: alignment._piece_bytes(b.id_to_piece(i)),
    )


def _walked(text, libraries):
    """Groups of one text by comparing the sets of all ends; None without tokens."""
    a, b = libraries
    a_bytes, b_bytes = _bytes(a, b)
    if not text:
        return None
    ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ab, bb = [a_bytes(i) for i in ai], [b_bytes(i) for i in bi]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return None
    ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
    groups, x, y = [], 0, 0
    for cut in sorted(set(ae) & set(be)):
        x2, y2 = ae.index(cut, x) + 1, be.index(cut, y) + 1
        groups.append((ai[x:x2], bi[y:y2]))
        x, y = x2, y2
    return ai, bi, groups


def _brute(rows, libraries):
    walked = [_walked(text, libraries) for _, text in rows]
    links = [Counter((i, j) for p, q in w[2] for i in p for j in q) if w else Counter() for w in walked]
    held = Counter(pair for x in links for pair in x)
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = Counter()
    for (key, _), w, x in zip(rows, walked, links, strict=True):
        if w is None:
            out[key, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in w[2])
        best = sum(m for pair, m in x.items() if held[pair] == most[pair[0]])
        total = sum(m * held[pair] for pair, m in x.items())
        sha = hashlib.sha256(written.encode()).hexdigest()
        out[key, len(w[0]), len(w[1]), len(w[2]), sum(x.values()), best, total, sha] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), unique=True), st.lists(st.integers(1, 60), unique=True))
def test_divide_and_conquer_cuts_at_every_common_end(a, b):
    a, b = sorted({*a, 61}), sorted({*b, 61})
    groups = alignment.align(a, b)
    assert [a[g[1] - 1] for g in groups] == sorted(set(a) & set(b)) == [b[g[3] - 1] for g in groups]
    assert [g[0] for g in groups] == [0, *[g[1] for g in groups[:-1]]]
    assert [g[2] for g in groups] == [0, *[g[3] for g in groups[:-1]]]


def test_long_intervals_without_a_common_end():
    odd, even = [*range(1, 100_000, 2), 100_001], [*range(2, 100_000, 2), 100_001]
    assert alignment.align(odd, even) == [(0, len(odd), 0, len(even))]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sé.,!;:#ʼ² \n\t  \x1c\x85.!1٣漢😀<|▁")) | st.text())
def test_words_are_the_libraries(text):
    known = test_words_are_the_libraries.__dict__
    if "aligner" not in known:
        known["aligner"] = alignment.Aligner(A_PATH, B_PATH)
    aligner = known["aligner"]
    got = aligner.texts([text])[1][0]
    wanted = _walked(text, (aligner.a, aligner.b))
    written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in wanted[2]) if wanted else ""
    assert got == written


@pytest.mark.parametrize("slice_links", [1 << 20, 500])
def test_alignment(awkward, nothing, documents, libraries, slice_links):
    texts = ["<|endoftext|> and <s> are plain", "a▁b", "漢字かな交じり文", "x" * 3000, " leading", "trailing ", "a\0b", "''s 's"]
    more = awkward.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (awkward, documents.select("doc_id", "text"), more):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = alignment.align_tokenizers(frame, A_PATH, B_PATH, slice_links=slice_links)
        assert got.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, got.collect())) == _brute(rows, libraries)
    assert alignment.align_tokenizers(nothing, A_PATH, B_PATH).count() == 0


def test_a_pair_of_ids_that_all_documents_hold(spark, libraries):
    rng = random.Random(4)
    rows = [(i, " ".join(["the same words", *rng.choices(["tokenizer", "Éention", "qu'il", "8/9"], k=i % 5)])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = alignment.align_tokenizers(frame, A_PATH, B_PATH, slice_links=300).collect()
    assert Counter(map(tuple, got)) == _brute(rows, libraries)
