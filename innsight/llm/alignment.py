"""Alignment of two tokenizers: groups of tokens between byte offsets where tokens of both end."""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._tokens import _BLANKS
from innsight.llm._work import column_type, kept, slices, stored

#: Characters of written groups, of the words that a task remembers.
REMEMBERED = 10_000_000
#: Texts, and bytes of them, that are aligned at once.
TEXTS, TEXT_BYTES = 256, 1 << 21
#: Distinct links that the documents of one slice hold together, about.
SLICE_LINKS = 1 << 20
#: A link's code is its A id times this plus its B id.
B_IDS, CODE_BITS = 1 << 31, 47
_SEEN = f"[^ {_BLANKS}]"
#: A word that may be joined with others: one blank or line feed, then visible characters at both ends.
_PLAIN = re.compile(f"[ \n]{_SEEN}(?:.*{_SEEN})?", re.DOTALL)
#: Letters and the marks after them that the byte-level pre-tokenizer parts from them.
_LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,!?;:"


def middle_cut(a: list[int], b: list[int], al: int, ah: int, bl: int, bh: int) -> tuple[int, int] | None:
    """The end that A tokens ``al..ah`` and B tokens ``bl..bh`` share inside, nearest to the middle A token.

    A tokens are asked from the middle outwards; each is looked up among the B
    ends by bisection.
    """
    middle = (al + ah - 1) // 2
    for away in range(max(middle - al, ah - 1 - middle) + 1):
        for k in (middle - away, middle + away) if away else (middle,):
            if al <= k < ah - 1:
                j = bisect_left(b, a[k], bl, bh - 1)
                if j < bh - 1 and b[j] == a[k]:
                    return k + 1, j + 1
    return None


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``a_from, a_to, b_from, b_to`` of tokens, given the byte offsets where they end.

    Divide and conquer: an interval is cut at a common end near its middle and
    both halves follow; an interval without one is a group.
    """
    groups, todo = [], [(0, len(a), 0, len(b))] if a else []
    while todo:
        al, ah, bl, bh = todo.pop()
        cut = middle_cut(a, b, al, ah, bl, bh)
        if cut is None:
            groups.append((al, ah, bl, bh))
        else:
            todo.append((cut[0], ah, cut[1], bh))
            todo.append((al, cut[0], bl, cut[1]))
    return groups


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 for itself, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + n): x for n, x in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _spread(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """All places ``start, start + 1, ...`` of each stretch."""
    return np.repeat(starts - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())


class Aligner:
    """Aligned words of texts by a byte-level tokenizer (A) and a SentencePiece model (B).

    A cut before a single blank or line feed between two visible characters is an
    end in both, and so is one between a letter and a mark, as far as no piece of
    B joins the two. So texts are aligned word by word, each distinct word once;
    the few texts with a word whose tokens don't spell it are tried as a whole.
    What is known of a word: its numbers of A tokens, B tokens, groups and links, its groups in
    writing, and its distinct links with their numbers.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        special = set(self.a.get_added_tokens_decoder())
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [
            n.encode() if i in special else bytes(letters[c] for c in n if c in letters) for i, n in enumerate(names)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p) for p in pieces]
        if any(re.search("[^▁][▁\n]", p) for p in pieces):
            raise ValueError("pieces of B go on after a blank")
        joined = {m for p in pieces for m in re.findall(f"[{_LETTERS}]([{re.escape(MARKS)}])", p)}
        marks = "".join(m for m in MARKS if m not in joined)
        part = f"|(?<=[{_LETTERS}])(?=[{re.escape(marks)}])" if marks else ""
        self._cut = re.compile(f"(?<={_SEEN})(?=[ \n]{_SEEN}){part}")
        self.known: dict[str, int] = {}
        self.size, self.words, self.written = 0, [], []
        self.counts: list[tuple[int, int, int, int]] = []
        self.codes: list[int] = []
        self.times: list[int] = []
        self.ends = [0]
        self.uses = np.empty(0, np.int64)
        self._arrays = (np.empty((0, 4), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def _forget(self) -> None:
        """Keep the words that were used more often than most, half of them at the most."""
        counts, codes, times = self._tables()
        keep = np.flatnonzero(self.uses > np.median(self.uses))
        starts = np.asarray(self.ends, np.int64)[keep]
        widths = np.diff(self.ends)[keep]
        at = _spread(starts, widths)
        self._arrays, self.uses = (counts[keep], codes[at], times[at]), self.uses[keep] // 2
        self.ends = [0, *np.cumsum(widths).tolist()]
        self.words, self.written = [self.words[i] for i in keep], [self.written[i] for i in keep]
        self.known = {w: i for i, w in enumerate(self.words)}
        self.size = sum(map(len, self.written))

    def _ids(self, words: list[str]) -> tuple[list[int], list[int], list[int]]:
        """Ids of ``words``, the first of which begins with a blank, and where each ends; empty if they don't spell them."""
        joined = "".join(words)
        raw = joined.encode()
        a_ids, b_ids = self.a.encode(joined, add_special_tokens=False).ids, self.b.encode(joined[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return [], [], []
        return a_ids, b_ids, np.cumsum([len(w.encode()) for w in words]).tolist()

    def _learn(self, words: list[str], lead: str = "") -> None:
        """Align ``words`` as one text and remember each; words that don't spell are found by halving.

        ``lead`` stands before words that don't begin with a blank.
        """
        a_ids, b_ids, word_ends = self._ids([lead, *words])
        if not word_ends:
            if len(words) == 1:
                self.known[words[0]] = -1
            else:
                self._learn(words[: len(words) // 2], lead)
                self._learn(words[len(words) // 2 :], lead)
            return
        a_ends = np.cumsum([len(self.a_bytes[i]) for i in a_ids]).tolist()
        b_ends = np.cumsum([len(self.b_bytes[i]) for i in b_ids]).tolist()
        groups, at = align(a_ends, b_ends), 0
        while lead and a_ends[groups[at][1] - 1] <= word_ends[0]:
            at += 1
        for word, end in zip(words, word_ends[1:], strict=True):
            n_a = n_b = n_links = 0
            first, written, links = at, [], {}
            while at < len(groups) and a_ends[groups[at][1] - 1] <= end:
                al, ah, bl, bh = groups[at]
                at += 1
                n_a, n_b, n_links = n_a + ah - al, n_b + bh - bl, n_links + (ah - al) * (bh - bl)
                if ah - al == bh - bl == 1:
                    x, y = a_ids[al], b_ids[bl]
                    written.append(f"{x}|{y}")
                    code = x * B_IDS + y
                    links[code] = links.get(code, 0) + 1
                    continue
                mine, other = a_ids[al:ah], b_ids[bl:bh]
                written.append(f"{','.join(map(str, mine))}|{','.join(map(str, other))}")
                mine, other = Counter(mine), Counter(other)
                for x, n in mine.items():
                    for y, m in other.items():
                        code = x * B_IDS + y
                        links[code] = links.get(code, 0) + n * m
            self.known[word] = len(self.written)
            self.words.append(word)
            self.written.append(";".join(written))
            self.size += len(self.written[-1])
            self.counts.append((n_a, n_b, at - first, n_links))
            self.codes += links
            self.times += links.values()
            self.ends.append(self.ends[-1] + len(links))

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Counts, links and their numbers of all known words; what is new moves from lists to the arrays."""
        fresh = (np.array(x, np.int64) for x in (self.counts, self.codes, self.times))
        self._arrays = tuple(
            np.concatenate([old, x.reshape(-1, *old.shape[1:])]) for old, x in zip(self._arrays, fresh, strict=True)
        )
        self.counts, self.codes, self.times = [], [], []
        return self._arrays

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Counts ``n_a, n_b, n_groups, n_links`` of each text, its groups in writing, its distinct links and their numbers.

        Texts without tokens have zeros and nothing.
        """
        if self.size > REMEMBERED:
            self._forget()
        cut = [self._cut.split(" " + text) if text else [] for text in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        plain = {w for w in new if _PLAIN.fullmatch(w)}
        for head, lead in ((" ", ""), ("\n", " a")):
            some = [w for w in plain if w[0] == head]
            for at in range(0, len(some), 500):
                self._learn(some[at : at + 500], lead)
        for word in new - plain:
            self._learn([word], "" if word[0] == " " else " a")
        look, rows = self.known.__getitem__, []
        for text, words in zip(texts, cut, strict=True):
            found = list(map(look, words))
            if -1 in found:
                whole = " " + text
                if whole not in self.known:
                    self._learn([whole])
                found = [self.known[whole]] if self.known[whole] >= 0 else []
            rows.append(found)
        counts, codes, times = self._tables()
        lengths = [len(r) for r in rows]
        place = np.fromiter((i for r in rows for i in r), np.int64, sum(lengths))
        owner = np.repeat(np.arange(len(rows)), lengths)
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[place], axis=0)])
        ends = np.cumsum([0, *lengths])
        written = [";".join(map(self.written.__getitem__, r)) for r in rows]

        self.uses = np.bincount(place, minlength=len(self.words)) + np.pad(self.uses, (0, len(self.words) - len(self.uses)))

        # distinct words of each text, then the distinct links of these
        both, often = np.unique(owner << 40 | place, return_counts=True)
        owner, place = both >> 40, both & ((1 << 40) - 1)
        starts = np.asarray(self.ends, np.int64)
        widths = starts[place + 1] - starts[place]
        at = _spread(starts[place], widths)
        keys, back = np.unique(np.repeat(owner << CODE_BITS, widths) | codes[at], return_inverse=True)
        sums = np.bincount(back, times[at] * np.repeat(often, widths), len(keys)).astype(np.int64)
        borders = np.searchsorted(keys, np.arange(1, len(rows)) << CODE_BITS)
        links = np.split(keys & ((1 << CODE_BITS) - 1), borders)
        return running[ends[1:]] - running[ends[:-1]], written, links, np.split(sums, borders)


#: Name under which a worker keeps its aligners.
ALIGNERS = "aligners"


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """The worker process's aligner; the frequent words that it remembers serve later tasks of the same kind."""
    aligners = kept(ALIGNERS, dict)
    if (a_path, b_path) not in aligners:
        aligners[a_path, b_path] = Aligner(a_path, b_path)
    return aligners[a_path, b_path]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``TEXTS`` rows that hold ``TEXT_BYTES`` of text or one row."""
    for part in slices(batches, TEXTS, ALIGNERS):
        sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > TEXT_BYTES:
                yield part.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield part.slice(begin)


def _aligning(a_path: str, b_path: str, slice_links: int, schema: pa.Schema):
    """Rows of documents (``of_slice`` false) and, after each slice, one of the slice with its distinct links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        number, gathered, held = TaskContext.get().partitionId() << 32, [], 0

        def closing() -> pa.RecordBatch:
            codes, docs = np.unique(np.concatenate(gathered), return_counts=True)
            row = {"of_slice": True, "slice": number, "codes": codes, "times": docs}
            return pa.RecordBatch.from_arrays(
                [pa.array([row.get(f.name)], f.type) for f in schema], schema=schema
            )

        for part in _portions(batches):
            n = part.num_rows
            counts, written, codes, times = aligner.texts(part.column(1).to_pylist())
            shas = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            columns = [[False] * n, [number] * n, part.column(0), *counts.T, shas, codes, times]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )
            gathered += codes
            held += sum(map(len, codes))
            if held >= slice_links:
                yield closing()
                number, gathered, held = number + 1, [], 0
        if gathered:
            yield closing()

    return run


def _scored(out: pa.Schema):
    def score(documents: pa.Table, links: pa.Table) -> pa.Table:
        """Counts of the documents' links, looked up in the sorted links of their slice."""
        code = links.column("code").to_numpy()
        order = np.argsort(code)
        code, count = code[order], links.column("n").to_numpy()[order]
        best = links.column("best").to_numpy()[order]
        lists = documents.column("codes").combine_chunks()
        ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
        times = documents.column("times").combine_chunks().flatten().to_numpy()
        at = np.searchsorted(code, lists.flatten().to_numpy())
        sums = {"n_best": times * best[at], "count_sum": times * count[at]} if len(at) else {}
        columns = []
        for f in out:
            if f.name in ("n_best", "count_sum"):
                running = np.concatenate([[0], np.cumsum(sums.get(f.name, np.empty(0)))]).astype(np.int64)
                columns.append(pa.array(running[ends[1:]] - running[ends[:-1]], f.type))
            else:
                columns.append(documents.column(f.name))
        return pa.Table.from_arrays(columns, schema=out)

    return score


def align_tokenizers(
    documents: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    slice_links: int = SLICE_LINKS,
) -> DataFrame:
    """How the tokens of a byte-level tokenizer A and a SentencePiece model B cover each text.

    A encodes a blank and the text, B the text, special strings being plain text.
    Byte offsets where tokens of both end cut the tokens into groups (see
    ``align``); an A and a B token of one group are linked. Per row: ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` over the ids of all
    groups, ``n_best`` (links whose pair of ids is held by more documents than any
    other pair of the same A id, ties included) and ``count_sum`` (over the links,
    how many documents hold their pair).

    Pairs are counted over slices of documents: a slice sends each distinct pair
    once, with its number of documents, and gets the counts over the corpus back,
    so a pair that all documents hold is one row per slice. A slice is closed once
    its documents hold ``slice_links`` links, which bounds what meets in one task
    by that and one document more.

    Null and empty texts, and texts whose tokens do not spell them, have no
    tokens: zeros and an empty hash column. Every row comes back, repeated rows
    and null ids included, and counts as a document. An empty table gives an
    empty one; further columns are ignored.
    """
    kind = column_type(documents, id_column)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"))
    ddl = (
        f"of_slice boolean, slice long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, codes array<long>, times array<long>"
    )
    schema = _arrow_schema(ddl)
    aligned = stored(rows.mapInArrow(_aligning(a_path, b_path, slice_links, schema), ddl), "aligned")
    held = (
        aligned.filter("of_slice")
        .select(F.col("slice").alias("of"), F.explode(F.arrays_zip("codes", "times")).alias("x"))
        .select("of", F.col("x.codes").alias("code"), F.col("x.times").alias("docs"))
    )
    counts = held.groupBy("code").agg(F.sum("docs").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"code div {B_IDS}")), "link-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(highest, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    links = held.select("of", "code").join(judged, "code").groupBy("of")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    scored = (
        aligned.filter(~F.col("of_slice"))
        .groupBy("slice")
        .cogroup(links)
        .applyInArrow(_scored(_arrow_schema(out)), out)
    )
    return scored.withColumnRenamed("doc_id", id_column)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
