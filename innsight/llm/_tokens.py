"""Token ids by the ``tokenizers`` and ``sentencepiece`` libraries, each distinct word encoded once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from innsight.llm._work import kept

#: Unicode's White_Space without the plain blank.
_BLANKS = "".join(
    map(chr, [*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_UNEVEN = re.compile(f"[ \n][ {_BLANKS}]|[{_BLANKS}][ \n]")
_SINGLE = re.compile(f"(?<=[^ {_BLANKS}]) (?=[^ {_BLANKS}])")
_PLAIN = re.compile(f"\n?[^ {_BLANKS}]+")
#: Marks that end a word without being part of its last token.
_MARKS = ".,!?;:$%&*#"
_ENDINGS = frozenset(_MARKS)
#: Words longer than this are encoded each time; so many others are remembered.
LONGEST_REMEMBERED, REMEMBERED = 40, 700_000


def words_of(text: str) -> list[str]:
    """``text`` cut before its single blanks and line feeds; the blanks are left out, the line feeds kept.

    A blank between two visible characters belongs to the word after it in the
    byte-level pre-tokenizer, and a line feed there stands alone, so no token
    spans such a cut.
    """
    return _SINGLE.split(text) if _UNEVEN.search(text) else text.replace("\n", " \n").split(" ")


def _bare(word: str) -> str:
    """``word`` without the marks at its end, if a letter comes before them: there a token ends."""
    core = word.rstrip(_MARKS)
    return core if core and core[-1] < "\u0250" and core[-1].isalpha() else word


def version_of(path: str) -> str:
    """Digest of what decides the ids: the file and the release of its library."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + file.read()).hexdigest()


class Encoder:
    """Ids of whole texts, without begin, end or other added special tokens.

    ``encode`` gives, for each text, its ids as little-endian unsigned 32-bit
    bytes; ``count`` gives their number.
    """

    def __init__(self, path: str):
        self.by_word = False
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._batch: Callable[[list[str]], Iterable] = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._batch = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        cut = plan.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in plan.get("added_tokens") or []]
        self.by_word = (
            plan.get("normalizer") is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
            and not (plan["model"].get("ignore_merges") or plan["model"].get("dropout"))
        )
        self._known: dict[str, bytes] = {}
        # tokens that begin with the blank or the line feed, as byte-level vocabularies write them
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self._begins = np.array([n[:1] in ("\u0120", "\u010a") for n in names])
        self._bytes = [i.to_bytes(4, "little") for i in range(len(names))]
        self._model = tokenizer.model

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, dtype="<u4").tobytes() for ids in self._batch(texts)]

    def _heads(self, heads: list[str]) -> dict[str, bytes]:
        """Ids of words after a blank, or with their line feed.

        A-Z after a blank are one piece for the pre-tokenizer and written as they
        are, so such a word goes to the model at once. Of the others many are
        encoded as one text and told apart by their first token.
        """
        found, plain, rest = {}, [], []
        pieces, raw = self._model.tokenize, self._bytes
        for h in heads:
            if h.isascii() and h.isalpha():
                found[h] = b"".join([raw[x.id] for x in pieces("\u0120" + h)])
            else:
                (plain if _PLAIN.fullmatch(h) else rest).append(h)
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.asarray(self._batch(["".join(h if h[0] == "\n" else " " + h for h in some)])[0], dtype="<u4")
            begins = np.flatnonzero(self._begins[ids])
            if len(begins) != len(some):
                rest += some
                continue
            joined, cuts = ids.tobytes(), [*(begins * 4).tolist(), 4 * len(ids)]
            found.update((h, joined[a:b]) for h, a, b in zip(some, cuts, cuts[1:], strict=False))
        found.update(zip(rest, self._whole([h if h[:1] == "\n" else " " + h for h in rest]), strict=True))
        return found

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``, as they are after a blank or with their line feed."""
        known = self._known
        marked = {w: _bare(w) for w in words if w[-1:] in _ENDINGS}
        heads = {marked.get(w, w) for w in words}.difference(known)
        marks = list({w[len(b) :] for w, b in marked.items()})
        known.update(self._heads(list(heads)))
        ends = dict(zip(marks, self._whole(marks), strict=True))
        known.update([(w, known[b] + ends[w[len(b) :]]) for w, b in marked.items() if w != b])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        texts = [text or "" for text in texts]
        if not self.by_word:
            return self._whole(texts)
        found: list[bytes] = [b""] * len(texts)
        special = [i for i, text in enumerate(texts) if any(s in text for s in self.special)]
        for i, ids in zip(special, self._whole([texts[i] for i in special]), strict=True):
            found[i] = ids
        left = np.array(sorted(set(range(len(texts))).difference(special)), np.int64)
        rows = pa.array([texts[i] for i in left.tolist()], pa.large_string())
        odd = pc.match_substring_regex(rows, _UNEVEN.pattern)
        uneven, even = (left[mask.to_numpy(zero_copy_only=False)].tolist() for mask in (odd, pc.invert(odd)))
        blank = pc.replace_substring(rows.filter(pc.invert(odd)), "\n", " \n")
        for order, lists in (
            (even, pc.split_pattern(blank, " ")),
            (uneven, pa.array([words_of(texts[i]) for i in uneven], pa.list_(pa.large_string()))),
        ):
            for i, ids in zip(order, self._joined(lists), strict=True):
                found[i] = ids
        return found

    def _joined(self, lists: pa.ListArray) -> list[bytes]:
        """Ids of texts that are given as their words; each distinct word is looked up once."""
        if not len(lists):
            return []
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        cuts, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        opening = np.zeros(len(codes), bool)
        opening[cuts[:-1]] = True
        inner = np.zeros(len(names), bool)
        inner[codes[~opening]] = True
        inner = [names[i] for i in np.flatnonzero(inner).tolist()]
        new = [w for w in inner if w not in known]
        self._learn(new)
        # a text's first word has no blank before it
        first, place = np.unique(codes[opening], return_inverse=True)
        codes[opening] = len(names) + place
        ids = [*map(known.get, names), *self._whole([names[i] for i in first.tolist()])]
        pieces = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        ends, raw = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1], memoryview(pieces.buffers()[2] or b"")
        at = ends[cuts].tolist()
        for word in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            del known[word]
            if len(bare := _bare(word)) > LONGEST_REMEMBERED:
                known.pop(bare, None)
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.encode(texts)]


#: Name under which a worker keeps its encoders.
ENCODERS = "encoders"


def encoder(path: str) -> Encoder:
    """The worker process's encoder for ``path``; what it remembers serves later tasks of the same kind."""
    encoders = kept(ENCODERS, dict)
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]
