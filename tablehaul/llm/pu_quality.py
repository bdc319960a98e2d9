"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled good; unlabelled web text is a mixture in which a share ``prior``
is good. The risk of calling text bad is what it is on the unlabelled minus ``prior`` times what
it is on the positives, never below zero, so no negative example is needed to fit. The
prior is estimated from the labels that may be learned from, as is the final scale (Platt), which makes
a score the estimated chance of label 1.

The risk is minimised over a bounded sample, about ``SAMPLE`` documents each of positives, of
unlabelled and of labelled bad, drawn by hash; the features' mean and deviation are those of all unlabelled
documents. Scores read whole texts, a text of any length in bounded pieces as far as its words go. Defined results: null and
empty texts get features of zero and a score; without positives every score is the prior; several
labels of one id count as bad unless all are good; labels without a document and null labels
are ignored; repeated rows get equal scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import SLICE_BYTES, id_and_text, id_remainder, map_slices, slices, stored, table
from tablehaul.llm.words import Words

SAMPLE = 4000
CUTOFF = 0.3
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "beyond_ascii", "words_a_line",
    "distinct_words", "same_as_before", "repeated_pairs", "repeated_lines", "one_letter_words", "long_words", "pipes",
)

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>", "marks": b"!?", "stops": b".,;:", "pipes": b"|"}


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between the given places."""
    out = np.zeros(len(at) - 1, np.int64)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some], dtype=np.int64)
    return out


def _repeats(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """Of each row's codes, how many were there before."""
    order = np.lexsort((code, row))
    again = np.append(False, (row[order][1:] == row[order][:-1]) & (code[order][1:] == code[order][:-1]))[: len(row)]
    return np.bincount(row[order][again], minlength=rows)


def describe(texts: pa.Array) -> np.ndarray:
    """A row of features for each text, all within about -1 to 1."""
    w = Words(texts)
    size = np.maximum(np.diff(w.row_at), 1)
    count = np.maximum(w.count, 1)
    shares = {}
    for name, chars in _CLASSES.items():
        member = np.zeros(256, np.uint8)
        member[list(chars)] = 1
        shares[name] = _per_row(member[w.data], w.row_at) / size
    beyond = _per_row(w.data >= 192, w.row_at) / size
    letters = _per_row((w.data > 32) & ((w.data & 192) != 128), w.row_at)
    length = w.end - w.start
    same = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(w.hashes)]
    pair = w.hashes[:-1] * np.uint64(3) + w.hashes[1:] if len(w.hashes) else w.hashes
    inner = w.doc[:-1] == w.doc[1:] if len(w.hashes) else np.zeros(0, bool)
    # A line is known by the hash of its words; a word begins a line if a line feed stands since the word before.
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
    begins = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1]))[: len(line)])
    ends = np.append(begins[1:], len(line))[: len(begins)]
    lines = w.prefix().run(begins, ends)
    of_line = w.doc[begins]
    n_lines = np.maximum(np.bincount(of_line, minlength=w.rows), 1)
    out = {
        "log_words": np.log1p(w.count) / 8,
        "word_length": np.minimum(letters / count, 30) / 10,
        "upper": shares["upper"], "digits": 5 * shares["digits"], "symbols": 5 * shares["symbols"],
        "marks": 5 * shares["marks"], "stops": 5 * shares["stops"], "pipes": 10 * shares["pipes"],
        "beyond_ascii": 5 * beyond,
        "words_a_line": np.log1p(w.count / n_lines) / 6,
        "distinct_words": 1 - _repeats(w.doc, w.hashes, w.rows) / count,
        "same_as_before": np.bincount(w.doc[same], minlength=w.rows) / count,
        "repeated_pairs": _repeats(w.doc[:-1][inner], pair[inner], w.rows) / count,
        "repeated_lines": _repeats(of_line, lines, w.rows) / n_lines,
        "one_letter_words": np.bincount(w.doc[length == 1], minlength=w.rows) / count,
        "long_words": np.bincount(w.doc[length > 20], minlength=w.rows) / count,
    }
    empty = w.count == 0
    return np.where(empty[:, None], 0.0, np.minimum(np.column_stack([out[f] for f in FEATURES]), 4.0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f (array of doubles) for every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = describe(batch.column(1))
        at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "f"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, f array<double>")


@dataclass
class Model:
    prior: float = 0.5
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # features, their squares, offset
    slope: float = 1.0
    offset: float = 0.0

    def score(self, f: Column) -> Column:
        if not self.weights:
            return F.lit(float(self.prior))
        n = len(FEATURES)
        z = F.lit(self.weights[-1])
        for i in range(n):
            v = F.least(F.greatest((F.get(f, i) - self.centre[i]) / self.scale[i], F.lit(-5.0)), F.lit(5.0))
            z = z + v * (F.lit(self.weights[i]) + v * self.weights[n + i])
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z * self.slope + self.offset, F.lit(30.0)), F.lit(-30.0))))


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    v = np.clip((x - centre) / scale, -5, 5)
    return np.hstack([v, v * v, np.ones((len(v), 1))])


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative risk, logistic loss, by Adam over all rows."""
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        # Losses: log(1 + e^-z) for calling good, log(1 + e^z) for calling bad.
        bad = -np.log(np.maximum(1 - u, 1e-12)).mean() + prior * np.log(np.maximum(1 - p, 1e-12)).mean()
        good_step = -prior * positive.T @ (1 - p) / len(p)
        bad_step = unlabelled.T @ u / len(u) - prior * positive.T @ p / len(p)
        g = (good_step + bad_step if bad >= 0 else -bad_step) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * z).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, float(np.abs(step).max()))  # short steps: the halves may be apart
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if math.isfinite(a + b) and a > 0 else (1.0, 0.0)


def fit(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """described: doc_id, f of all documents. labels: doc_id, quality of the rows that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = described.join(known, "doc_id", "left").select("doc_id", "f", F.coalesce("quality", F.lit(-1)).alias("y"))
    rows = stored(rows, "pu-rows")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(1):
        return Model(prior=0.5 if not n.get(0) else 0.0)
    drawn = F.pmod(F.xxhash64("doc_id", "f"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for y in n for x in (y, int(min(1.0, sample / n[y]) * (1 << 30)))))
    got = sorted((r["y"], r["f"]) for r in rows.where(drawn < share[F.col("y")]).select("y", "f").limit(2 * sample * len(n)).collect())
    of = lambda y: np.array([f for k, f in got if k == y]).reshape(-1, len(FEATURES))
    positive, bad = of(1), of(0)
    # All text without a label is the mixture; labelled text stands in where there is none.
    unlabelled = of(-1) if len(of(-1)) >= 50 else np.vstack([of(-1), positive, bad])
    total = n[1] + n.get(0, 0)
    prior = min(max(n[1] / total, 0.05), 0.95) if n.get(0) else 0.9
    centre, scale = unlabelled.mean(0), unlabelled.std(0)
    if n.get(-1, 0) >= 50:
        of_all = [g(F.get("f", i)) for g in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]
        found = np.array(rows.where("y = -1").agg(*(c.alias(f"c{i}") for i, c in enumerate(of_all))).first())
        centre, scale = found[: len(FEATURES)], found[len(FEATURES) :]
    scale = np.maximum(scale, 0.01)
    w = minimise(_expand(positive, centre, scale), _expand(unlabelled, centre, scale), prior)
    model = Model(prior, centre.tolist(), scale.tolist(), w.tolist())
    if len(bad):
        z = np.concatenate([_expand(positive, centre, scale) @ w, _expand(bad, centre, scale) @ w])
        # The sample's shares are not the labels' shares; the offset is moved back to those.
        model.slope, model.offset = _platt(z, np.append(np.ones(len(positive)), np.zeros(len(bad))))
        model.offset += math.log(n[1] / n[0]) - math.log(len(positive) / len(bad))
    return model


def held_out(id_column: Column) -> Column:
    return id_remainder(id_column, 5) == 0


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; learns from labels whose id is not held out."""
    described = stored(features(docs, id_col, text_col), "pu-features")
    model = fit(described, labels.where(~held_out(F.col("doc_id"))))
    return described.select("doc_id", model.score(F.col("f")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rows whose score is below the cutoff; all columns stay. Every text is described once."""

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        parts = [describe(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES)]
        x = np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))

    f = "f"
    while f.lower() in {c.lower() for c in docs.columns}:
        f = "_" + f
    rows = stored(docs.withColumn(f, described(F.coalesce(docs[text_col].cast("string"), F.lit("")))), "pu-described")
    model = fit(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[f].alias("f")), labels.where(~held_out(F.col("doc_id"))))
    return rows.where(model.score(rows[f]) >= cutoff).drop(f)


def op6_positive_unlabelled_quality(spark, sf_dir):
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
