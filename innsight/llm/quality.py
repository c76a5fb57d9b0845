"""Quality rules that judge lines first and documents by what is left of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import column_type, slices

SYMBOLS = b"#*$%&|<>"
#: A line that closes with none of these, with or without closing quotes and brackets, isn't a sentence.
END_MARKS = (b".", b"!", b"?", b":", b";", "…".encode(), "。".encode(), "！".encode(), "？".encode(), "؟".encode(), "।".encode())
CLOSERS = b"\"')]}*_" + "”’»".encode()
#: Notices of a page, wherever they stand in a line, in the languages of the tables.
NOTICES = (
    "javascript", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "we use cookies", "accept cookies", "accept all cookies", "cookie policy", "cookie settings",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "cookies akzeptieren",
    "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "accepter les cookies",
    "política de privacidad", "condiciones de uso", "todos los derechos reservados", "aceptar cookies",
)
#: Labels of links and buttons: only a line of few words is one.
LABELS = (
    "click here", "sign up", "sign in", "log in", "read more", "skip to content", "share this", "subscribe",
    "weiterlesen", "anmelden", "mehr erfahren", "zum inhalt",
    "lire la suite", "se connecter", "s'inscrire", "cliquez ici",
    "leer más", "iniciar sesión", "registrarse", "haga clic",
)


def _as_words(phrases: tuple[str, ...]) -> re.Pattern[bytes]:
    """Any of ``phrases`` between word ends; letters beyond ASCII count as letters."""
    return re.compile(rb"(?<![\w\x80-\xff])(?:" + "|".join(map(re.escape, phrases)).encode() + rb")(?![\w\x80-\xff])")


NOTICE, LABEL = _as_words(NOTICES), _as_words(LABELS)
NAVIGATION = re.compile(rb" (?:\||>|/|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2) ")
SHOUTS = re.compile(rb"[!?]{2,}")


@dataclass(frozen=True)
class Rules:
    """Limits of the base and of the line rules.

    ``least_words``, ``repeated_percent``: the base. ``separators``: so many
    navigation separators, or more, make a line navigation, and so do so many
    words, ``menu_words``, that are all capitalised without a mark between them.
    ``label_words``: a line of so many words at most may be a link's label. ``symbol_percent``,
    ``shout_percent``: so many symbols, or doubled exclamation or question
    marks, for each hundred words spoil a line. ``unended_words``: a line of so
    many words or more may go without an end mark, as prose is sometimes cut
    off. ``lost_percent``: a document whose failing lines hold more of its word
    characters is rejected.
    """

    least_words: int = 10
    repeated_percent: int = 20
    separators: int = 2
    menu_words: int = 5
    label_words: int = 5
    symbol_percent: int = 50
    shout_percent: int = 30
    unended_words: int = 4
    lost_percent: int = 50


def line_fault(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The first rule that ``line`` breaks: boilerplate, navigation, symbols, shouting or punctuation."""
    low = line.lower()
    if NOTICE.search(low) or (len(words) <= rules.label_words and LABEL.search(low)):
        return "boilerplate"
    if len(NAVIGATION.findall(line)) >= rules.separators:
        return "navigation"
    if len(words) >= rules.menu_words and all(w[:1].isupper() and w.isalpha() for w in words):
        return "navigation"
    if 100 * sum(map(line.count, _SYMBOL_BYTES)) > rules.symbol_percent * len(words):
        return "symbols"
    if 100 * len(SHOUTS.findall(line)) > rules.shout_percent * len(words):
        return "shouting"
    if len(words) < rules.unended_words and not line.rstrip(CLOSERS + b" \t\v\f\r").endswith(END_MARKS):
        return "punctuation"
    return None


_SYMBOL_BYTES = [bytes([c]) for c in SYMBOLS]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first ones included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + width - max(at, upto)
            upto = at + width
    return covered


def judge(text: str | None, rules: Rules) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_failed, lost_chars, cleaned``."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(b"".join(words).decode())
    n_symbols = sum(map(raw.count, _SYMBOL_BYTES))
    seen: set[bytes] = set()
    repeats = failed = lost = 0
    left = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        repeats += line in seen
        seen.add(line)
        if line_fault(line, own, rules):
            failed += 1
            lost += len(b"".join(own).decode())
        else:
            left.append(line)
    again = repeated_words(words)
    base_failed = len(words) < rules.least_words or 100 * again > rules.repeated_percent * len(words)
    kept = not base_failed and 100 * lost <= rules.lost_percent * chars
    cleaned = b"\n".join(left).decode()
    return len(words), chars, n_symbols, repeats, again, base_failed, kept, failed, lost, cleaned


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VERDICT = ("base_failed", "kept")
_LINES = ("n_lines_failed", "lost_chars")


def clean_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: Rules = Rules(),  # noqa: B008  frozen
    with_text: bool = True,
) -> DataFrame:
    """Counts, verdict and, ``with_text``, the text without its failing lines, one row per input row.

    Each line with a word is judged by ``line_fault``; failing lines are taken
    out, and a document is kept if it passes the base (enough words, little
    repetition) and its failing lines held no more than ``lost_percent`` of its
    word characters. Words are runs of anything but blank, tab, line feed,
    vertical tab, form feed and carriage return. Null texts are empty: no words,
    base failed. Ids, null or repeated, are passed through; an empty table gives
    none. Nothing is shuffled. Further columns of the input are ignored.
    """
    kind = column_type(documents, id_column)
    names = [*_COUNTS, *_VERDICT, *_LINES, *(["cleaned"] if with_text else [])]
    types = [pa.bool_() if n in _VERDICT else pa.string() if n == "cleaned" else pa.int64() for n in (*names, "cleaned")]
    kinds = {n: "boolean" if n in _VERDICT else "string" if n == "cleaned" else "long" for n in names}
    ddl = f"_id {kind}, {', '.join(f'{n} {k}' for n, k in kinds.items())}"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = list(zip(*(judge(t, rules) for t in part.column(1).to_pylist()), strict=True))
            columns = columns or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["_id", *names])

    return (
        documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        .mapInArrow(judged, ddl)
        .withColumnRenamed("_id", id_column)
    )
