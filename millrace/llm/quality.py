"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed counts and shares. Each class has a
mean and a covariance, shrunk towards the covariance of both classes and then
towards a multiple of the identity, from sums of all training rows. A text's
evidence is the difference of the two log-densities; each is half a Mahalanobis
distance, solved with a Cholesky factor that is computed once, and the log of
its determinant. A logistic link fitted on training rows outside the sums
makes a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.labels import CALIBRATION_ROWS, about, fit_link, new_column, sigmoid
from millrace.llm.shingles import LOWER, NOT_SPACE, byte_class, text_slices, word_hashes, words

_UPPER = byte_class(bytes(range(65, 91)))
_LOWER = byte_class(bytes(range(97, 123)))
_DIGIT = byte_class(b"0123456789")
_STOP = byte_class(b".!?")
_COMMA = byte_class(b",;:")
_SIGN = byte_class(b"#$%&*@^~=+<>|\\/_{}[]")
_BAR = byte_class(b"|")
_BANG = byte_class(b"!")
_LINE = byte_class(b"\n")
_OUTSIDE = byte_class(bytes(range(128, 256)))

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "stop", "comma", "sign", "bar", "bang", "outside",
    "log_line_words", "repeated_words", "repeated_pairs", "repeated_runs", "adjacent_repeats", "signed_words", "capital_words",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a smoothed share."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct(text: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """Distinct keys of each text."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=texts)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x statistics), finite for every text, empty ones too."""
    texts, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return np.diff(total[offsets]).astype(np.float64)

    start, end, before = words(raw, offsets, NOT_SPACE)
    n = np.diff(before).astype(np.float64)
    text = np.repeat(np.arange(texts), np.diff(before))
    hashes = word_hashes(LOWER[raw], start, end)
    pair_ok = text[1:] == text[:-1]
    pairs = (hashes[:-1] * np.uint64(3) ^ hashes[1:])[pair_ok]
    run_ok = text[4:] == text[:-4]
    runs = (hashes[:-4] * np.uint64(3) + hashes[1:-3] * np.uint64(5) + hashes[2:-2] * np.uint64(7) + hashes[3:-1] * np.uint64(11) + hashes[4:])[run_ok]
    n_pairs, n_runs = np.maximum(n - 1, 0), np.maximum(n - 4, 0)
    adjacent = np.bincount(text[1:][pair_ok & (hashes[1:] == hashes[:-1])], minlength=texts)
    signs = np.concatenate([[0], np.cumsum((_SIGN | _BANG)[raw])])
    signed = np.bincount(text[signs[end] > signs[start]], minlength=texts)
    upper_total = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    lower_total = np.concatenate([[0], np.cumsum(_LOWER[raw])])
    capital = np.bincount(text[(upper_total[end] > upper_total[start]) & (lower_total[end] == lower_total[start])], minlength=texts)
    letters = count(_UPPER | _LOWER)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n), np.log1p((size - n) / np.maximum(n, 1)), _share(count(_UPPER), letters), _share(count(_DIGIT), size), _share(count(_STOP), size),
            _share(count(_COMMA), size), _share(count(_SIGN), size), _share(count(_BAR), size), _share(count(_BANG), size), _share(count(_OUTSIDE), size),
            np.log1p(n / (count(_LINE) + 1)), _share(n - _distinct(text, hashes, texts), n), _share(n_pairs - _distinct(text[1:][pair_ok], pairs, texts), n_pairs),
            _share(n_runs - _distinct(text[4:][run_ok], runs, texts), n_runs), _share(adjacent, n_pairs), _share(signed, n), _share(capital, n),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # (2, d)
    factors: tuple[np.ndarray, np.ndarray]  # inverse Cholesky factors of the two covariances
    offset: float  # difference of the log-determinants, halved, and log prior odds
    link: np.ndarray | None = None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-density of the better class minus that of the worse, with prior odds."""
        far = [np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)]
        return (far[0] - far[1]) / 2 + self.offset

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(_link_inputs(self.evidence(statistics(raw, offsets))) @ self.link[:-1] + self.link[-1])


def _link_inputs(evidence: np.ndarray) -> np.ndarray:
    """Evidence on a scale that far-off texts don't rule."""
    return np.arcsinh(evidence)[:, None]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: rows, sums and sums of products, as (label, place, value)."""
    d = len(STATISTICS) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        label = batch.column("label").to_numpy() > 0
        for first, end, raw, offsets in text_slices(batch.column("text")):
            x = np.column_stack([np.ones(end - first), statistics(raw, offsets)])
            for c in (0, 1):
                own = x[label[first:end] == bool(c)]
                total[c] += own.T @ own
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], d * d).astype(np.int32)), pa.array(np.tile(np.arange(d * d), 2).astype(np.int32)), pa.array(total.ravel())], names=["label", "place", "value"]
    )


def _evidence_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(model.value.evidence(statistics(raw, offsets))), batch.column("label").slice(first, end - first)], names=["evidence", "label"])


def fit(rows: DataFrame, calibration: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.01, calibration_rows: int = CALIBRATION_ROWS) -> Discriminant:
    """Moments of all ``rows``, a link on about ``calibration_rows`` rows of ``calibration`` at most; both have doc_id, text, label.

    ``to_pooled`` and ``to_identity`` are the two shares of shrinkage. A class without rows takes the
    other's moments, so that it adds no evidence; null texts count as empty.
    """
    spark, d = rows.sparkSession, len(STATISTICS) + 1
    found = rows.select("text", "label").mapInArrow(_sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, d * d))
    for r in found:
        total[r.label, r.place] = r.value
    total = total.reshape(2, d, d)
    n = np.maximum(total[:, 0, 0], 1e-9)
    both = total.sum(axis=0)
    means = np.array([(total[c] if total[c, 0, 0] else both)[0, 1:] / max((total[c] if total[c, 0, 0] else both)[0, 0], 1) for c in (0, 1)])
    scatter = [total[c][1:, 1:] - total[c, 0, 0] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(both[0, 0], 1)
    factors, halves = [], []
    for c in (0, 1):
        own = scatter[c] / n[c] if total[c, 0, 0] > d else pooled
        shrunk = (1 - to_pooled) * own + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + to_identity * (np.trace(shrunk) / (d - 1) + 1e-6) * np.eye(d - 1)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        halves.append(np.log(np.diag(lower)).sum())
    offset = halves[0] - halves[1] + np.log((total[1, 0, 0] + 1) / (total[0, 0, 0] + 1))
    model = Discriminant(means, tuple(factors), float(offset))
    sent = spark.sparkContext.broadcast(model)
    got = about(calibration, calibration_rows).select("text", "label").mapInArrow(lambda it: _evidence_rows(it, sent), "evidence double, label int").toArrow()
    link = fit_link(_link_inputs(got.column("evidence").to_numpy()), (got.column("label").to_numpy() > 0).astype(np.float64))
    return Discriminant(means, tuple(factors), float(offset), link)


def score(docs: DataFrame, model: Discriminant, column: str = "score") -> DataFrame:
    """``docs`` with a double ``column`` from 0 to 1, higher for better texts; a column of that name is refused.

    Reads ``text`` alone: null counts as empty, and empty texts have statistics like any other. All
    rows and other columns stay as they are.
    """
    new_column(docs, column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sent.value.scores(raw, offsets) for _, _, raw, offsets in text_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(own) if own else np.zeros(0))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
