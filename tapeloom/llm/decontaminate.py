"""Benchmark decontamination: rare pairs of words of the test items seed local alignments in the documents.

The items are a stated query set, taken in blocks of bounded size. Alignments (Smith-Waterman: match 2, mismatch -1,
gap -1) of a share of the best possible score are kept, and the seeds miss none of them. An alignment that scores T or
more with k matches has 2k - T errors at most, so `need` = ceil(T/2) - 1 of the steps from one match to the next have at
most one error: the two words are neighbours, or have one word between them, in the item and in the document. So `need`
of the item's n steps are found as pairs of words within 3m - T words, the most that the alignment can take (m: words
of the item). Of any n - need + SEEDS of the steps, SEEDS are found. Those are the item's seeds: the steps whose pairs
are rarest in the corpus, counted over all documents. A passage is aligned where it holds SEEDS of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bytesets import MIX, groups, mix, text_bytes, word_hashes

#: Items of fewer words are found only whole (one word of two is half of the score).
SEEDED_WORDS = 3
#: The least share of an item's best score (its words, all matched).
LEAST = 0.5
#: Seeds of an item that must lie in one passage before it is aligned.
SEEDS = 4
#: Words of items broadcast at a time.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Items:
    """A block of items: word hashes, and their pairs of words as (hash, item, place), ordered by hash.

    An item is looked at where `need` places of its pairs lie within `reach` words. keys are the pairs' hashes, once each.
    """

    def __init__(self, ids: list[int], texts: list[str], least: float = LEAST, seeds: int = SEEDS):
        data, offs = text_bytes(pa.array(texts, pa.string()))
        words, at = word_hashes(data, offs, WORD)
        self.ids = ids
        self.words = [words[at[k] : at[k + 1]] for k in range(len(ids))]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        m = np.diff(at)
        self.score = np.maximum(1, np.ceil(2 * least * m - 1e-9)).astype(np.int64)
        self.need = np.where(m < SEEDED_WORDS, 1, np.maximum(1, (self.score + 1) // 2 - 1))
        self.reach = np.maximum(3 * m - self.score, m)
        found = []
        for step in (0, 1, 2):
            h, first = _steps(words, at, step)
            item = np.searchsorted(at, first, "right") - 1
            on = m[item] == 1 if step == 0 else (m[item] >= SEEDED_WORDS) | (m[item] == 2) & (step == 1)
            found.append((h[on], item[on], first[on] - at[item[on]]))
        h, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, item, h))
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.n = np.maximum(m - 1, 1)
        self.some = np.minimum(self.need, seeds)
        self.keys, self.back = np.unique(self.hash, return_inverse=True)
        self._index()

    def _index(self) -> None:
        self.maybe = np.zeros(1 << max(16, int(len(self.hash)).bit_length() + 3), bool)
        self.maybe[self.hash & np.uint64(len(self.maybe) - 1)] = True

    def rarest(self, counts: np.ndarray) -> Items:
        """Only the seeds: of each item's n places the n - need + some whose pairs are rarest by counts of keys (ties: by place)."""
        start = np.cumsum(self.n) - self.n
        worth = np.zeros(self.n.sum(), np.int64)
        np.add.at(worth, start[self.item] + self.place, counts[self.back])
        owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((worth, owner))
        kept = np.zeros(len(worth), bool)
        kept[order] = np.arange(len(worth)) - np.repeat(start, self.n) < (self.n - self.need + self.some)[owner]
        on = kept[start[self.item] + self.place]
        self.hash, self.item, self.place = self.hash[on], self.item[on], self.place[on]
        self.need = self.some
        self._index()
        return self

    def count(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each of keys stands in rows of words."""
        out = np.zeros(len(self.keys), np.int64)
        for step in (0, 1, 2):
            h, _ = _steps(words, at, step)
            h = h[self.maybe[h & np.uint64(len(self.maybe) - 1)]]
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out += np.bincount(k[self.keys[k] == h], minlength=len(out))
        return out


def _steps(words: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each two words of a row that stand step apart (step 0: of each word), and the first one's index."""
    n = len(words) - step
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not step:
        return mix(words ^ MIX[2]), np.arange(n)
    on = np.ones(n, bool)
    for k in range(step):
        cut = at[1:-1] - 1 - k
        on[cut[(cut >= 0) & (cut < n)]] = False
    first = np.flatnonzero(on)
    return mix(words[first] * MIX[0] + words[first + step] * MIX[1]), first


def blocks(items: DataFrame, id_col: str, text_col: str, least: float) -> Iterator[Items]:
    """The items in blocks; those with a null id or no words are none."""
    ids, texts, n = [], [], 0
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).dropna().distinct().sort(id_col, text_col).toLocalIterator():
        ids.append(r[0]), texts.append(r[1])
        n += len(r[1]) // 4 + 1
        if n > BLOCK_WORDS:
            yield Items(ids, texts, least)
            ids, texts, n = [], [], 0
    if ids:
        yield Items(ids, texts, least)


def _seeded(block: Items, texts: DataFrame) -> Items:
    """The block with its rarest pairs only, by their counts in all texts; a count for each of its pairs comes back, whatever the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        total = np.zeros(len(b.keys), np.int64)
        for x in batches:
            data, offs = text_bytes(x.column(0))
            for i, j in groups(offs):
                total += b.count(*word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], WORD))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["k", "n"])

    got = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(block.keys), np.int64)
    counts[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return block.rarest(counts)


def _hits(block: Items, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item and word index of each place of a pair of an item in rows of words, ordered, each once."""
    wide = np.int64(len(words) + 1)
    found = [np.zeros(0, np.int64)]
    for step in (0, 1, 2):
        h, first = _steps(words, at, step)
        maybe = np.flatnonzero(block.maybe[h & np.uint64(len(block.maybe) - 1)])
        h, first = h[maybe], first[maybe]
        low, high = np.searchsorted(block.hash, h), np.searchsorted(block.hash, h, "right")
        reps = high - low
        gram = np.arange(reps.sum()) + np.repeat(low - np.cumsum(reps) + reps, reps)
        found.append(np.unique(block.item[gram] * wide + np.repeat(first, reps)))
    x = np.unique(np.concatenate(found))
    return x // wide, x % wide


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment of an item with words: score, and the last word it takes."""
    j = np.arange(len(words))
    row = np.zeros(len(words), np.int64)
    best, end = 0, 0
    for w in item.tolist():
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(words == np.uint64(w), MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(row - GAP * j) + GAP * j
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _matches(b: Items, words: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int, float, int]]:
    """Row, item, share of the best score and last word of each item's best alignment in each row."""
    item, where = _hits(b, words, at)
    if not len(where):
        return []
    row = np.searchsorted(at, where, "right") - 1
    begin = np.arange(len(where))
    end = begin + b.need[item] - 1
    on = end < len(where)
    begin, end = begin[on], end[on]
    begin, end = (x[(item[begin] == item[end]) & (row[begin] == row[end]) & (where[end] - where[begin] < b.reach[item[begin]])] for x in (begin, end))
    if not len(begin):
        return []
    item, row, reach = item[begin], row[begin], b.reach[item[begin]]
    lo, hi = np.maximum(at[row], where[begin] - reach), np.minimum(at[row + 1], where[end] + reach + 1)
    fresh = np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1]))
    ends = np.append(fresh[1:], True)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for r, i, p, q in zip(row[fresh].tolist(), item[fresh].tolist(), lo[fresh].tolist(), hi[ends].tolist(), strict=True):
        window, (own, count), m = words[p:q], b.bags[i], len(b.words[i])
        k = np.minimum(np.searchsorted(own, window), len(own) - 1)
        if 2 * np.minimum(np.bincount(k[own[k] == window], minlength=len(own)), count).sum() < b.score[i]:
            continue
        if m < SEEDED_WORDS:
            whole = np.flatnonzero(np.logical_and.reduce([window[x : len(window) - m + 1 + x] == b.words[i][x] for x in range(m)]))
            score, last = (MATCH * m, int(whole[0]) + m - 1) if len(whole) else (0, 0)
        else:
            score, last = align(b.words[i], window)
        share = score / (MATCH * m)
        if share >= least and share > best.get((r, i), (0.0, 0))[0]:
            best[r, i] = (share, p + last - int(at[r]))
    return [(r, i, *x) for (r, i), x in sorted(best.items())]


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score (share of the item's best), last_word of each item found in each document.

    All pairs with score of least or more have a row, and only they: one for each row of a document and item; items of
    one or two words are found only whole. Null texts and texts
    without words match nothing, nor do items with a null id or no words; a null doc_id stays. Other columns are not
    read. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, last_word long")
    for block in blocks(items, item_col, item_text, least):
        shared = spark.sparkContext.broadcast(_seeded(block, rows.select("text")))

        def run(batches, shared=shared):
            b = shared.value
            for x in batches:
                data, offs = text_bytes(x.column(1))
                for i, j in groups(offs):
                    words, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], WORD)
                    found = _matches(b, words, at, least)
                    ids = x.column(0).slice(i, j - i)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([b.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                        names=["doc_id", "item_id", "score", "last_word"],
                    )

        out = out.unionByName(rows.mapInArrow(run, "doc_id long, item_id long, score double, last_word long"))
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found; nothing is shuffled."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for block in blocks(items, item_col, item_text, least):
        shared = docs.sparkSession.sparkContext.broadcast(_seeded(block, texts))

        def run(batches, shared=shared):
            for x in batches:
                data, offs = text_bytes(x.column(x.schema.get_field_index(text_col)))
                keep = np.ones(x.num_rows, bool)
                for i, j in groups(offs):
                    words, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], WORD)
                    keep[[i + f[0] for f in _matches(shared.value, words, at, least)]] = False
                yield x.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
