"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between the grades.

P(grade >= k) = sigmoid(w.x - t_k) with t_1 <= t_2 <= ...; the weights are shared by all grades. The model is fitted
on a bounded sample of rated rows; scoring takes one pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bytesets import LOWER, SPACE, Rolling, groups, mix, spans, text_bytes

#: Hashed features, and the rated rows that the fit takes at most (by hash of the id).
DIMENSIONS, FIT_ROWS = 1 << 18, 8_000
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SYMBOL = ~WORD & ~SPACE
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B], _DIGIT[0x30:0x3A] = True, True
#: Borders of the shares that describe a text's style; each share gives one feature, the number of borders below it.
_SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
_STYLES = 6


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, end to end, and the rows' offsets.

    They are its words (lower-cased), their beginnings of 4 and 5 bytes, its runs of symbols, all hashed, and its style.
    """
    n, low = len(offs) - 1, LOWER[data]
    starts, ends, row = spans(low, offs, WORD)
    roll = Rolling(low)
    words = roll.of(starts, ends)
    of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(row))
    length = np.maximum(np.diff(offs), 1)

    def total(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[at])

    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    count = np.maximum(np.diff(row), 1)
    key = np.unique((of << np.uint64(40)) | (mix(words) & np.uint64((1 << 40) - 1)))
    distinct = np.diff(np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(40)))
    shares = [
        total(_UPPER[data], offs) / length,
        total(SYMBOL[data], offs) / length,
        total(_DIGIT[data], offs) / length,
        total(again, row) / count,
        1 - distinct / count,
        np.minimum(np.diff(row), 4096) / 8192,
    ]
    style = np.stack([DIMENSIONS - 1 - (k * len(_SHARES) + np.searchsorted(_SHARES, s, "left")) for k, s in enumerate(shares)], 1)
    words_at = (key & np.uint64(0xFFFFFFFF)) % np.uint64(DIMENSIONS - 64)
    hashed = [((key >> np.uint64(40)) << np.uint64(32)) | words_at]
    for size in (4, 5):
        longer = np.flatnonzero(ends - starts > size)
        hashed.append((of[longer] << np.uint64(32)) | mix(roll.of(starts[longer], starts[longer] + size) + np.uint64(size)) % np.uint64(DIMENSIONS - 64))
    begin, stop, at = spans(low, offs, SYMBOL)
    hashed.append((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(32)) | mix(roll.of(begin, stop) + np.uint64(1)) % np.uint64(DIMENSIONS - 64))
    pairs = np.unique(np.concatenate([*hashed, (np.repeat(np.arange(n, dtype=np.uint64), _STYLES) << np.uint64(32)) | style.ravel().astype(np.uint64)]))
    return (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(pairs, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


@dataclass
class Model:
    """weights, and the thresholds below grade 1, 2, ..."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row per text."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feats])])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - np.diff(sums[at])[:, None], -30, 30)))


def fit(rows: list[tuple[np.ndarray, int]], grades: int, passes: int = 6, rate: float = 1.0, l1: float = 6.0) -> Model:
    """Cumulative-link fit by adaptive gradient steps, row by row; l1 keeps words of no evidence at zero.

    Rows are taken in the order given in each pass, so equal rows give an equal model. Without rows every text is
    equally likely to have each grade.
    """
    cuts = -np.log(np.arange(grades - 1, 0, -1) / np.arange(1, grades)).astype(float)
    w, z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    cut_n = np.ones(grades - 1)
    for _ in range(passes):
        for feats, grade in rows:
            # follow-the-regularised-leader: weights come from summed gradients, shrunk by l1
            zf, nf = z[feats], n[feats]
            wf = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((1 + np.sqrt(nf)) / rate))
            s = wf.sum()
            tail = 1 / (1 + np.exp(np.clip(cuts - s, -30, 30)))
            above = np.concatenate([[1.0], tail, [0.0]])
            p = max(above[grade] - above[grade + 1], 1e-9)
            slope = above * (1 - above)
            g = -(slope[grade] - slope[grade + 1]) / p
            step = (np.sqrt(nf + g * g) - np.sqrt(nf)) / rate
            z[feats] = zf + g - step * wf
            n[feats] = nf + g * g
            g_cut = np.zeros(grades - 1)
            if grade > 0:
                g_cut[grade - 1] += slope[grade] / p
            if grade < grades - 1:
                g_cut[grade] -= slope[grade + 1] / p
            cut_n += g_cut**2
            cuts = np.maximum.accumulate(cuts - rate * g_cut / np.sqrt(cut_n))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate))
    return Model(w, cuts)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ratings from the two flags of a labels table: 2 good and civil, 1 one fault, 0 both; the lowest of repeated ones; no row where a flag or the id is null."""
    return labels.dropna(subset=[id_col, "quality", "toxic"]).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the texts of at most fit_rows rated documents, chosen by hash of the id; only their features reach the driver.

    Of documents that share an id the text of the smallest hash is taken, so that fit_rows bounds texts. Null texts
    count as empty; ids without a document, and documents without an id, teach nothing. Other columns are not read.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b.column(2))
            for i, j in groups(offs):
                feats, at = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                small = feats.astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([small[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["doc_id", "grade", "feats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    found = rows.select("doc_id", "grade", "x.text").mapInArrow(run, "doc_id long, grade int, feats binary").withColumn("order", F.xxhash64("doc_id", F.lit(7))).toArrow()
    ranked = sorted(zip(found["order"].to_pylist(), found["doc_id"].to_pylist(), found["grade"].to_pylist(), found["feats"].to_pylist(), strict=True))
    return fit([(np.frombuffer(x, "<i4").astype(np.int64), g) for _, _, g, x in ranked], grades)


def score(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, expected_grade, p_top (probability of the top grade), keep (p_top >= least).

    A null text counts as empty; null ids and repeated rows stay; other columns are not read.
    """
    used = np.flatnonzero(model.weights)
    small = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.cuts))

    def run(batches):
        at_used, values, cuts = small.value
        weights = np.zeros(DIMENSIONS)
        weights[at_used] = values
        own = Model(weights, cuts)
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j in groups(offs):
                tails = own.tails(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], names=["doc_id", "expected_grade", "p_top", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_top double, keep boolean")


def select(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose top grade has probability least or more; nothing is shuffled."""
    used = np.flatnonzero(model.weights)
    small = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.cuts))

    def run(batches):
        at_used, values, cuts = small.value
        weights = np.zeros(DIMENSIONS)
        weights[at_used] = values
        own = Model(weights, cuts)
        for b in batches:
            data, offs = text_bytes(b.column(b.schema.get_field_index(text_col)))
            keep = [own.tails(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))[:, -1] >= least for i, j in groups(offs)]
            yield b.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
