"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased whole text, ASCII characters that are not
letters counting as blanks; square roots of counts, unit length. Families are found, not
given: the languages' mean profiles are merged by average similarity until about the
square root of their number is left. A linear SVM against the rest scores each family; within
the winning family each pair of languages has a linear SVM of its own, and the language with the
most votes wins, summed margins deciding ties.

Learning reads a bounded sample: about ``SAMPLE`` documents of each language, drawn by hash.
Prediction reads whole texts. Defined results: a null text or one without a letter is
``und`` with score 0; where nothing could be learned all are ``und``; with one language
all others are that language; null languages are not learned from; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import id_remainder, slices, table

#: Documents of a language to learn from, about; languages learned, the most frequent first.
SAMPLE, LANGUAGES = 1000, 200
DIMENSIONS = 1 << 11

_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)


def profile(text: str | None) -> np.ndarray | None:
    """The features of a text, or None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    data = data[(data != 32) | (np.append(np.uint32(0), data[:-1]) != 32)]  # runs of blanks count once
    if len(data) < 3:
        data = np.append(data, np.full(3, 32, np.uint32))
    grams = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bins = (grams * np.uint32(2654435761)) >> np.uint32(32 - 11)
    out = np.sqrt(np.bincount(bins, minlength=DIMENSIONS).astype(np.float32))
    return out / np.sqrt((out * out).sum())


def separate(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights of a linear SVM (squared hinge); y is +1 or -1, both sides weigh the same. The last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 0.5
    for k in range(steps):  # accelerated gradient descent
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (strength * v - 2 * x.T @ (weight * gap * y))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray  # a column for each family
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray  # a column for each pair; positive for the first

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        by_family = x @ self.family_weights
        family = by_family.argmax(1)
        ordered = np.sort(by_family, 1)
        margin = np.full(len(x), 4.0) if len(self.families) == 1 else ordered[:, -1] - ordered[:, -2]
        votes = np.zeros((len(x), len(self.languages)))
        closest = margin.copy()
        margins = x @ self.pair_weights if self.pairs else np.zeros((len(x), 0))
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            # A vote counts 1; the margin, squeezed to less than a vote, decides ties.
            votes[:, a] += (m > 0) + 0.001 * np.tanh(m)
            votes[:, b] += (m <= 0) - 0.001 * np.tanh(m)
        for f, members in enumerate(self.families):
            rest = [i for i in range(len(self.languages)) if i not in members]
            votes[np.ix_(family == f, rest)] = -np.inf
        best = votes.argmax(1)
        for k, (a, b) in enumerate(self.pairs):
            own = (best == a) | (best == b)
            closest[own] = np.minimum(closest[own], 2 * np.abs(margins[own, k]))
        return [self.languages[i] for i in best], 1 / (1 + np.exp(-2 * np.clip(closest, 0, 20)))


def find_families(means: np.ndarray) -> list[list[int]]:
    """Profiles merged by average similarity until about sqrt(n) groups are left."""
    groups = [[i] for i in range(len(means))]
    if not groups:
        return []
    centred = means - means.mean(0)
    unit = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    like = unit @ unit.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        scored = [(like[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(scored, key=lambda s: (s[0], -s[1], -s[2]))
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """labelled: rows to learn from. Reads counts of all languages and texts of the sample only."""
    rows = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull())
    counts = rows.groupBy(rows[lang_col].alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([], [], np.zeros((DIMENSIONS + 1, 0), np.float32), [], np.zeros((DIMENSIONS + 1, 0), np.float32))
    drawn = F.pmod(F.xxhash64(rows[id_col], rows[text_col]), F.lit(1 << 30))
    wanted = None
    for row in counts:
        here = (rows[lang_col] == row["lang"]) & (drawn < int(min(1.0, sample / row["count"]) * (1 << 30)))
        wanted = here if wanted is None else wanted | here
    chosen = rows.where(wanted).select(rows[lang_col].alias("lang"), rows[text_col].alias("text")).limit(2 * sample * len(counts))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                kept = [(lang, p.astype(np.float16).tobytes()) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if (p := profile(text)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], names=["lang", "profile"])

    got = sorted((r["lang"], bytes(r["profile"])) for r in chosen.mapInArrow(features, "lang string, profile binary").toLocalIterator())
    return learn([g[0] for g in got], np.array([np.frombuffer(g[1], np.float16) for g in got], np.float32).reshape(len(got), DIMENSIONS))


def learn(langs: list[str], x: np.ndarray) -> Model:
    languages = sorted(set(langs))
    at = np.array([languages.index(v) for v in langs], dtype=int)
    means = np.array([x[at == i].mean(0) for i in range(len(languages))]).reshape(len(languages), DIMENSIONS)
    families = find_families(means)
    in_family = np.array([next(f for f, g in enumerate(families) if i in g) for i in at], dtype=int)
    family_weights = [separate(x, np.where(in_family == f, 1.0, -1.0).astype(np.float32)) for f in range(len(families))]
    pairs = [(a, b) for g in families for a in g for b in g if a < b]
    pair_weights = []
    for a, b in pairs:
        own = (at == a) | (at == b)
        pair_weights.append(separate(x[own], np.where(at[own] == a, 1.0, -1.0).astype(np.float32)))
    columns = lambda ws: np.array(ws, np.float32).reshape(len(ws), DIMENSIONS + 1).T
    return Model(languages, families, columns(family_weights), pairs, columns(pair_weights))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [profile(t) for t in part.column(1).to_pylist()]
                some = [p for p in found if p is not None]
                names, scores = model.predict(np.array(some, np.float32).reshape(len(some), DIMENSIONS))
                it = iter(zip(names, scores))
                out = [next(it) if p is not None else ("und", 0.0) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([float(o[1]) for o in out], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_column: Column) -> Column:
    return id_remainder(id_column, 4) == 2


def op4_hierarchical_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
