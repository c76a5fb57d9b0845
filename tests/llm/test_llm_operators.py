"""Each operator against a brute-force version, on awkward rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.llm import _tokens, chat, decontaminate, language, licences, line_dedup, near_dup, packing, quality
from innsight.llm import sharding, token_counts
from innsight.llm._components import components
from innsight.llm.queries import tokenizer_path
from tests.llm.conftest import SMALL, WORDS


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# tokens -------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sé.,!#ʼ \n\t  \x1c\x85.!1٣漢😀<|")) | st.text())
def test_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    known = test_encoder_is_the_library.__dict__.setdefault("known", Tokenizer.from_file(tokenizer_path()))
    ids = np.frombuffer(_tokens.encoder(tokenizer_path()).encode([text])[0], "<u4")
    assert ids.tolist() == known.encode(text, add_special_tokens=False).ids


def test_other_tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Two  words, and\nmore", None, ""]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert _tokens.Encoder(path).count(texts) == [len(model.encode(t or "")) for t in texts]
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    assert _tokens.Encoder(path).count(texts) == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark, awkward, nothing, documents, library, tmp_path):
    cache = str(tmp_path / "cache")
    for frame in (awkward, documents):
        rows = frame.select("doc_id", "text").collect()
        got = token_counts.count_tokens(frame, tokenizer_path(), cache).collect()
        size = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
        wanted = Counter((d, len((t or "").encode()), size[t], size[t] > 1024) for d, t in rows)
        assert Counter(map(tuple, got)) == wanted
    before = spark.read.parquet(cache).count()
    assert token_counts.count_tokens(awkward, tokenizer_path(), cache).filter("n_tokens is null").isEmpty()
    assert spark.read.parquet(cache).count() == before == len({t or "" for f in (awkward, documents) for (t,) in f.select("text").collect()})
    assert token_counts.count_tokens(nothing, tokenizer_path(), cache).count() == 0


# packing ------------------------------------------------------------------

def test_first_fit_decreasing():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 1023) for _ in range(700)), reverse=True)
    room, wanted = [], []
    for i, size in enumerate(sizes):
        at = next((k for k, r in enumerate(room) if r >= size), len(room))
        if at == len(room):
            room.append(1024)
            wanted.append([])
        room[at] -= size
        wanted[at].append(i)
    assert packing.first_fit_decreasing(sizes, 1024) == wanted


@pytest.mark.parametrize("group_rows", [4096, 5])
def test_packing_round_trip(awkward, nothing, documents, library, group_rows):
    for frame in (awkward, documents):
        rows = frame.select("doc_id", "text").collect()
        pieces = packing.pack_documents(frame, tokenizer_path(), group_rows=group_rows).collect()
        filled: dict = {}
        for p in pieces:
            filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in (sum(x for _, x in v) for v in filled.values()))
        assert padding <= 16 * len(filled)
        wanted, got = Counter(), Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
        cuts = {}
        for p in pieces:
            cuts.setdefault((p.doc_id, p.doc_tokens), set()).add((p.start, p.length))
        for key, text in rows:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            mine = sorted(cuts[key, len(ids)])
            if key != 3:  # the repeated rows may be cut each in its own way
                assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]]
                assert sum(n for _, n in mine) == len(ids)
            for start, length in mine:
                wanted[key, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
        assert set(got) == set(wanted)
        assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


# sharding -----------------------------------------------------------------

def test_sharding(awkward, nothing, documents):
    for frame in (awkward, documents):
        rows = frame.select("doc_id", "text").collect()
        got = sharding.shard_documents(frame).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
            (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
        )
        slots: dict = {s: [] for s in range(16)}
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(v) for v in slots.values()]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(nothing).count() == 0


def test_allotment_equals_a_walk_key_by_key():
    rng = random.Random(5)
    ring = sharding.Ring.of(5, 8, 8)
    keys = {p: rng.randint(1, 9) for p in rng.sample(range(256), 90)}
    total = sum(keys.values())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    wanted = []
    for place in sorted(keys):
        for rank in range(keys[place]):
            start = next((i for i, p in enumerate(ring.places) if p >= place), 0)
            around = [ring.owners[(start + k) % len(ring.owners)] for k in range(len(ring.owners))]
            shard = next(s for s in around if room[s])
            room[shard] -= 1
            wanted.append((place, rank, shard))
    got = [(p, r, s) for p, low, high, s, _ in sharding.allot(ring, keys) for r in range(low, high)]
    assert got == wanted


def test_few_keys_move_when_a_shard_is_added():
    rng = random.Random(6)
    keys = Counter(rng.randrange(1 << 16) for _ in range(200_000))
    owner = []
    for shards in (16, 17):
        rows = sharding.allot(sharding.Ring.of(shards, 1024), keys)
        owner.append({(p, r): s for p, low, high, s, _ in rows for r in range(low, high)})
    moved = sum(owner[0][k] != owner[1][k] for k in owner[0]) / len(owner[0])
    assert moved < 0.12  # a hash modulo the number of shards moves 0.94; 1/17 must move


# quality ------------------------------------------------------------------

def test_quality_counts(awkward, nothing):
    blanks = " \t\n\v\f\r"
    for row in quality.clean_documents(awkward).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect():
        text, words = row.text or "", (row.text or "").translate(str.maketrans(blanks, " " * 6)).split(" ")
        words = [w for w in words if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip(blanks)]
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert (row.n_symbols, row.n_repeat_words) == (sum(c in "#*$%&|<>" for c in text), len(inside))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        assert not (row.base_failed and row.kept)
    assert quality.clean_documents(nothing).count() == 0


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("Home | News | Sport | About", "navigation"),
        ("Please enable JavaScript to go on.", "boilerplate"),
        ("buy### this$$$ now%%% here***", "symbols"),
        ("WIN!! NOW!! HERE!!", "shouting"),
        ("Next page", "punctuation"),
        ("Home About Contact Products Support Careers Imprint", "navigation"),
        ("Read more", "boilerplate"),
        ("Jetzt anmelden", "boilerplate"),
        ("Tous droits réservés.", "boilerplate"),
        ("The blog in question has moved on.", None),
        ("Several design upgrades were made last year.", None),
        ("Then spread more butter on the bread.", None),
        ("Bake each cookie for ten minutes.", None),
        ("You have to log in before the meeting can begin.", None),
        ("He said: “Come in.”", None),
        ("A long line that ends without a mark", None),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line.encode(), line.encode().split(), quality.Rules()) == fault


def test_quality_removes_lines_and_judges_loss():
    good = "This sentence is a plain one and it has ten words."
    menu = "Home | News | Sport | About"
    other = "Here is another line, which says something else."
    *_, kept, _, _, cleaned = quality.judge(f"{menu}\n{good}\n\n{other}", quality.Rules())
    assert kept and cleaned == f"{good}\n\n{other}"
    assert not quality.judge("\n".join([good, *[f"{menu} {i} | {i} | {i} | {i} | {i}" for i in range(5)]]), quality.Rules())[-4]


def _plain_verdict(text, rules):
    """``kept`` and the cleaned text by rules written out once more."""
    blanks = " \t\n\v\f\r"
    words_of = lambda t: [w for w in re.split(f"[{blanks}]+", t) if w]
    words, left, lost = words_of(text), [], 0
    for line in text.split("\n"):
        mine, low = words_of(line), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        has = lambda p: re.search(rf"(?<!\w){re.escape(p)}(?!\w)", low)  # noqa: E731, B023
        bad = bool(mine) and (
            any(map(has, quality.NOTICES))
            or (len(mine) <= rules.label_words and any(map(has, quality.LABELS)))
            or sum(line.count(f" {x} ") for x in "|>/»›·•") >= rules.separators
            or (len(mine) >= rules.menu_words and all(re.fullmatch("[A-Z][A-Za-z]*", w) for w in mine))
            or 100 * sum(c in "#*$%&|<>" for c in line) > rules.symbol_percent * len(mine)
            or 100 * len(re.findall("[!?]{2,}", line)) > rules.shout_percent * len(mine)
            or (len(mine) < rules.unended_words and not re.search("[.!?:;…。！？؟।][\"')\\]}*_”’»]*$", line.rstrip(blanks)))
        )
        if bad:
            lost += sum(map(len, mine))
        else:
            left.append(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
    failed = len(words) < rules.least_words or 100 * len(inside) > rules.repeated_percent * len(words)
    return not failed and 100 * lost <= rules.lost_percent * sum(map(len, words)), "\n".join(left)


def test_quality_verdict_on_all_documents(documents):
    for text in [r.text or "" for r in documents.select("text").collect()]:
        got = quality.judge(text, quality.Rules())
        assert (got[6], got[9]) == _plain_verdict(text, quality.Rules())


# language -----------------------------------------------------------------

def test_language_on_held_out_documents(documents):
    got = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert out and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(awkward, nothing, documents):
    model = language.train(documents)
    got = language.predict_languages(awkward, model, carried=("source",)).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 7)) and (r.lang_pred != "und" or r.rejected)
    assert language.predict_languages(nothing, model).count() == 0
    assert {r.lang_pred for r in language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_reads_whole_texts(monkeypatch):
    text = "Grüße aus dem Süden, und noch mehr davon. " * 50
    whole = Counter(np.concatenate(list(language.subwords(text, language.Settings()))).tolist())
    monkeypatch.setattr(language, "_PART", 97)
    assert whole == Counter(np.concatenate(list(language.subwords(text, language.Settings()))).tolist())


# lines --------------------------------------------------------------------

def brute_lines(rows):
    blanks = " \t\n\v\f\r"
    key = lambda line: line.strip(blanks).translate({c: c + 32 for c in range(65, 91)})
    first: dict = {}
    for d, t in rows:
        for k in map(key, (t or "").split("\n")):
            first[k] = min(first.get(k, 1 << 63), (1 << 63) - 1 if d is None else d)
    for d, t in rows:
        lines = (t or "").split("\n")
        own = (1 << 63) - 1 if d is None else d
        left = [x for x in lines if len(key(x)) < 10 or first[key(x)] == own]
        yield d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_line_dedup(spark, awkward, nothing, documents):
    for frame in (awkward, documents):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert Counter(map(tuple, line_dedup.line_report(frame).collect())) == Counter(brute_lines(rows))
    assert line_dedup.line_report(nothing).count() == 0


def test_line_shared_by_more_ranges_than_one(spark):
    rows = [(i, f"Own line number {i} of it\nthe very same line") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, line_dedup.line_report(frame).collect())) == Counter(brute_lines(rows))


# near duplicates ----------------------------------------------------------

def brute_near(rows, percent=85):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", " " * 5)).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def check_near(frame):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    sets, group = brute_near(rows)
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    wanted = Counter((d, len(s), least.get(g), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True))
    assert Counter(map(tuple, near_dup.near_duplicates(frame).collect())) == wanted


def test_near_duplicates(awkward, nothing, documents):
    check_near(awkward)
    check_near(documents)
    assert near_dup.near_duplicates(nothing).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """More copies than a small block holds, edited enough that some are linked and some are not."""
    monkeypatch.setattr(near_dup, "CHUNK_SHINGLES", 700)
    rng = random.Random(8)
    base = [f"word{rng.randrange(400)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 2, 3, 5))):
            copy[rng.randrange(120)] = f"new{rng.randrange(60)}"
        rows.append((i, " ".join(copy)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    b = np.concatenate([a[:3000], np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))])
    agree = (near_dup.signature(a, 2048) == near_dup.signature(b, 2048)).mean()
    assert abs(agree - 3000 / 4500) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# decontamination ----------------------------------------------------------

def brute_tiles(doc, item, width):
    """Greedy string tiling as first described: all maximal matches over unmarked words, longest first."""
    md, mi, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in mi and d + n not in md:
                    n += 1
                if (n, -i, -d) > (best[0], -best[1], -best[2]):
                    best = (n, i, d)
        n, i, d = best
        if n < width:
            return covered
        mi |= set(range(i, i + n))
        md |= set(range(d, d + n))
        covered += n


def test_decontamination(spark, awkward, nothing):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(24))) for i in range(6)]
    items += [(50, None), (51, ""), (52, "too short here"), (53, "go " * 12)]
    docs = []
    for n in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        source = items[rng.randrange(6)][1].split()
        cut = rng.randrange(24)
        moved = source[cut:] + ["between"] + source[:cut]  # reordered
        docs.append((n, " ".join(parts + (moved if n % 2 else source[cut:]) + parts[:3])))
    docs += [(60, "Go go, GO go go go go! " * 3), (61, None), (62, ""), (None, items[0][1]), (63, items[1][1]), (63, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("_key", F.lit("clash"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    got = {(r.doc_id, r.item_id, r.n_covered) for r in decontaminate.contaminated(frame, benchmark).collect()}
    wanted = set()
    for d, text in docs:
        for i, item in items:
            words = decontaminate._WORD.findall((item or "").lower())
            covered = brute_tiles(decontaminate._WORD.findall((text or "").lower()), words, 5)
            if covered and 2 * covered >= len(words):
                wanted.add((d, i, covered))
    assert {x[:2] for x in got} == {x[:2] for x in wanted} and got == wanted
    assert (63, 1, 24) in got and (None, 0, 24) in got
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.contaminated(awkward, benchmark.filter("false")).count() == 0


# chat ---------------------------------------------------------------------

def brute_chats(rows):
    said: dict = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn is not None, turn, role, text))
    said = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in said.items()}
    whole: dict = {}
    for conv, turns in said.items():
        whole.setdefault(tuple(turns), []).append(conv)
    for turns, convs in whole.items():
        if not any(len(t) > len(turns) and t[: len(turns)] == turns for t in whole):
            text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
            yield min(convs, key=lambda c: (c is not None, c or 0)), len(turns), len(convs), text


def test_chats(spark):
    talk = [("user", "Hi"), ("assistant", "Hello"), ("user", None), ("assistant", "Bye"), (None, "")]
    rows = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 3), (5, 1)):
        rows += [(conv, t, *talk[t]) for t in range(n)]
    rows += [(6, 0, "user", "Hi"), (6, 1, "assistant", "hello")]
    rows += [(7, t, "user", f"turn {t}") for t in range(700)]
    rows += [(8, t, "user", f"turn {t}") for t in range(300)]
    rows += [(None, 0, "user", "no id"), (9, None, "system", "first"), (9, 0, "user", "second")]
    rows += [(100 + i, 0, "user", "Good morning") for i in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x"))
    got = chat.format_chats(frame, segment_turns=1000).collect()
    assert Counter((r.conv_id, r.n_turns, r.n_snapshots, r.text) for r in got) == Counter(brute_chats(rows))
    cut = chat.format_chats(frame).filter("conv_id = 7").orderBy("segment").collect()
    assert [r.segment_turns for r in cut] == [128] * 5 + [60]
    assert "".join(r.text for r in cut) == next(r.text for r in got if r.conv_id == 7)
    assert chat.format_chats(frame.filter("false")).count() == 0


def test_repeated_turns_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    (got,) = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got.n_turns == 3 and got.text.count("a<|im_end|>") == 2


# licences -----------------------------------------------------------------

def test_licences(spark, awkward, nothing):
    mit = licences.TEMPLATES[3][1]
    rows = [
        (1, "Some code.\nReleased under the MIT License.\nMore code."),
        (2, f"Copyright (c) 2020 Somebody\n\n{mit}\n\nTHE REST"),
        (3, mit.replace(" ", "\n").upper()),
        (4, "Nothing to see here, only plain prose about licences."),
        (5, None),
        (6, "released UNDER   the mit license"),
    ]
    got = {(r.doc_id, r.licence, r.unit, r.at) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", "line", 1), (2, "MIT", "paragraph", 1), (3, "MIT", "text", 0), (6, "MIT", "text", 0)}
    assert licences.scan_licences(awkward).count() == 0
    assert licences.scan_licences(nothing).count() == 0


def test_pruned_licences_equal_all_pairs(documents):
    known = licences.Templates(licences.TEMPLATES, 0.5)
    rng = random.Random(4)
    texts = [t for (t,) in documents.select("text").limit(40).collect()]
    for _, text in licences.TEMPLATES:
        words = text.split()
        for _ in range(20):
            at = sorted(rng.sample(range(len(words) + 1), 2))
            texts.append(" ".join(words[: at[0]] + rng.sample(WORDS, 2) + words[at[1] :]))
    for text in texts:
        scored = [(licences.dice(licences.bigrams(text), licences.bigrams(t)), -n) for n, (_, t) in enumerate(licences.TEMPLATES)]
        score, at = max(scored)
        found = known.best(text)
        assert (found is None) == (score < 0.5)
        assert found is None or found[1:] == (-at, score)


def test_queries_read_whole_tables(spark):
    from innsight.llm.queries import queries

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op3_language_id", "op7_quality_rules", "op6_sharding"):
        assert queries()[name](spark, SMALL).count() == n
