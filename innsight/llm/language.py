"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import column_type, slices

UNKNOWN = "und"
_NO_WORD = re.compile(r"[\W\d_]+")
#: Code points hashed at once; long texts go through in overlapping parts.
_PART = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``buckets`` of hashed subwords of ``sizes`` code points; ``width`` of an embedding.

    ``train_rows`` is the documented bound of the sample that the model is fitted
    on. ``snippets`` short word runs of each sampled text are learned from too,
    so that short texts are known. ``held_back`` of the sample calibrates the
    scores; below the ``reject_share`` quantile of the calibrated probability of
    the true language there, a text is rejected, but never at a score of
    ``sure`` or more.
    """

    buckets: int = 1 << 15
    sizes: tuple[int, ...] = (1, 2, 3)
    width: int = 16
    train_rows: int = 2000
    snippets: int = 2
    epochs: int = 5
    rate: float = 0.5
    held_back: float = 0.2
    reject_share: float = 0.002
    sure: float = 0.6
    seed: int = 11


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Buckets of all subwords of the whole text, part by part; none spans two words."""
    clean = " " + _NO_WORD.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    shift = np.uint64(64 - (settings.buckets.bit_length() - 1))
    factor = np.uint64(0x9E3779B97F4A7C15)
    last = max(settings.sizes)
    for at in range(0, len(codes), _PART):
        part = codes[at : at + _PART + last - 1]
        blank = part == 32
        key = np.zeros(len(part), np.uint64)
        for size in range(1, last + 1):
            n = len(part) - size + 1
            if n <= 0:
                break
            key = (key[:n] + part[size - 1 :]) * factor
            key ^= key >> np.uint64(29)
            if size not in settings.sizes:
                continue
            # those that begin in this part; inner blanks would join two words
            good = np.ones(n, bool) if size > 1 else ~blank
            for inner in range(1, size - 1):
                good &= ~blank[inner : inner + n]
            if size == 2:
                good &= ~(blank[:n] & blank[1 : 1 + n])
            good[_PART:] = False
            yield ((key * np.uint64(2 * size + 1))[good] >> shift).astype(np.int64)


@dataclass
class Model:
    """Bucket scores (embedding times weights), bias, temperature and rejection threshold."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is rejected."""
        if not text or not has_letters(text) or not self.labels:
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.labels)), 0
        for ids in subwords(text, self.settings):
            total += np.bincount(ids, minlength=len(self.scores)) @ self.scores if len(ids) > 50_000 else self.scores[ids].sum(0)
            n += len(ids)
        p = _softmax((total / max(n, 1) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], settings: Settings) -> Model:
    """Stochastic gradient descent over ``(label, [(buckets, weights), …])``, the first entry being the whole text."""
    labels = sorted({label for label, _ in samples})
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(samples))
    back = max(1, int(settings.held_back * len(samples))) if len(samples) > 4 else 0
    learn = [(labels.index(samples[i][0]), u, w) for i in order[back:] for u, w in samples[i][1]]
    check = [(labels.index(samples[i][0]), u, w) for i in order[:back] for u, w in samples[i][1]]
    k = len(labels)
    table = rng.normal(0, 0.1, (settings.buckets, settings.width))
    weights = rng.normal(0, 0.1, (settings.width, k))
    bias = np.zeros(k)
    share = np.bincount([y for y, _, _ in learn], minlength=k) if learn else np.ones(k)
    cost = share.sum() / (k * np.maximum(share, 1)) if k else share  # rare languages weigh as much as frequent ones
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        for i in rng.permutation(len(learn)):
            y, ids, w = learn[i]
            mean = w @ table[ids]
            wrong = _softmax(mean @ weights + bias)
            wrong[y] -= 1
            wrong *= cost[y] * rate
            step = weights @ wrong
            weights -= np.outer(mean, wrong)
            bias -= 0.1 * wrong
            table[ids] -= np.outer(w * 20, step)
    scores = (table @ weights).astype(np.float32)
    model = Model(labels, scores, bias, 1.0, 0.0, settings)
    if check and k:
        raw = np.array([w @ scores[ids] + bias for _, ids, w in check])
        true = np.array([y for y, _, _ in check])
        row = np.arange(len(true))
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(_softmax(raw / t)[row, true], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(raw / model.temperature)[row, true]
        model.threshold = float(min(np.quantile(p, settings.reject_share), settings.sure))
    return model


def _counted(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(settings.buckets)
    for ids in subwords(text, settings):
        counts += np.bincount(ids, minlength=settings.buckets)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / max(counts.sum(), 1)


def _featuriser(settings: Settings):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for label, text, draw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rng = np.random.default_rng(abs(draw))
                words, texts = text.split(), [text]
                for _ in range(settings.snippets):
                    size = int(rng.integers(1, 15))
                    at = int(rng.integers(0, max(1, len(words) - size)))
                    snippet = " ".join(words[at : at + size])
                    if has_letters(snippet):
                        texts.append(snippet)
                for n, t in enumerate(texts):
                    ids, w = _counted(t, settings)
                    values = [label, draw, n, ids.astype("<u4").tobytes(), w.astype("<f4").tobytes()]
                    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["label", "draw", "n", "ids", "w"]
                    )

    return features


def train(labelled: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:  # noqa: B008
    """Fit on at most ``settings.train_rows`` labelled rows, drawn evenly over the languages.

    The draw is a hash of id and text, the same on each run. The sample is
    hashed to subword counts by Spark; the driver receives at most ``buckets``
    counts for each of its texts. Rows without label or letters take no part;
    without any the model answers ``und`` to all.
    """
    rows = labelled.select(
        F.col(label_column).cast("string").alias("label"),
        F.col(text_column).alias("text"),
        F.xxhash64(F.col(id_column), F.col(text_column), F.lit(settings.seed)).alias("draw"),
    ).filter("label is not null and text is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], settings)
    each = settings.train_rows / len(sizes)
    part = F.lit(0.0)
    for label, n in sizes.items():
        part = F.when(F.col("label") == label, F.lit(min(1.0, each / n))).otherwise(part)
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 30)) < part * (1 << 30)).filter(F.col("text").rlike(r"\p{L}"))
    found = drawn.mapInArrow(_featuriser(settings), "label string, draw long, n int, ids binary, w binary")
    found = found.limit(2 * settings.train_rows * (1 + settings.snippets))  # a draw is about train_rows
    by_text: dict[tuple, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["label"], r["draw"], r["n"])):
        entry = (np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["w"], "<f4").astype(float))
        by_text.setdefault((r["label"], r["draw"]), []).append(entry)
    return fit([(label, entries) for (label, _), entries in by_text.items()], settings)


def predict_languages(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score, rejected`` of every row, from the whole text alone; ``carried`` columns go along.

    Null texts and texts without letters are ``und`` with score 0, rejected. One
    row comes back per input row, whatever its id; an empty table gives none.
    The model travels with the task: its size is set by ``buckets``, not by the
    data. Nothing is shuffled.
    """
    # the text, if carried, crosses to the workers and back once
    kept = {c: "_text" if c == text_column else f"_c{i}" for i, c in enumerate(carried)}
    others = [c for c in carried if c != text_column]
    ddl = ", ".join(
        [f"_id {column_type(documents, id_column)}", "lang_pred string", "score double", "rejected boolean"]
        + [f"{n} {column_type(documents, c)}" for c, n in kept.items()]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = list(zip(*map(model.predict, part.column(1).to_pylist()), strict=True)) or [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *arrays, *(part.column(n) for n in kept.values())],
                ["_id", "lang_pred", "score", "rejected", *kept.values()],
            )

    rows = documents.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *(F.col(c).alias(kept[c]) for c in others)
    ).mapInArrow(predict, ddl)
    return rows.select(F.col("_id").alias(id_column), "lang_pred", "score", "rejected", *(F.col(n).alias(c) for c, n in kept.items()))


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether CRC-32 of the id, as text, leaves ``fold`` modulo ``folds``; a null id is never held out."""
    crc = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def identify(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:  # noqa: B008
    """Train on the labelled documents that aren't held out, then predict all: ``id, held_out, lang_pred, score, rejected``."""
    model = train(documents.filter(~held_out(id_column)), settings, id_column, text_column, label_column)
    found = predict_languages(documents, model, id_column, text_column)
    return found.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score", "rejected")
