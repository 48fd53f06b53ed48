"""Ranked lexical search of query texts over all documents, by sort-based accumulation.

Documents are never shuffled: a task holds whole texts of its part of them. A
slice of about a megabyte of text gives its matches (document, term, how often);
each match is repeated for the items that hold the term, so the arrays of item,
document and impact of all terms lie one behind the other. The pair of item and
document is packed into one number, the numbers are radix sorted (16 bits a
pass), and the impacts of equal numbers are summed with one `reduceat`. Of the
sums, those that are no worse than an item's k-th best so far go to its heap.
What the tasks' heaps hold (k rows a task and item at most) is written, dealt by
ranges of items, and selected by heaps once more.

The items' terms are on every worker, in parts of at most `part_words` words;
each part is a pass over the documents. Counts of documents and lengths come from
a pass before, as one number a term.

Terms are runs of a-z, 0-9 and all beyond ASCII, A-Z being lower-cased; they are
compared by 64 bits of their hash. Null and empty texts have no terms: such
documents count in nothing and are found by nothing, such items find nothing.
Very long texts are searched whole. Repeated rows of documents are documents of
their own; rows of items that repeat id and text are one item, different texts
with one id are items of their own. Of equal scores the smaller doc_id comes
first, a null id last. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.common import ALNUM, Words, hashed_counts, saved, slices
from sunlattice.llm.suffix_automaton import parts_of

#: A score's parts, in 64-bit integers: tf in SCALE of a share, lengths in percent of the mean, of which FLAT hold for all.
SCALE, FLAT, SLOPE, STEP, SATURATION = 1_000_000_000, 10, 90, 1000, 8
NULL_ID = 2**63


class Terms:
    """The different terms of items, sorted by hash, with the items that hold each (one behind the other)."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        held = [np.unique(words) for _, words in items]
        flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.hashes, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
        order = np.argsort(code, kind="stable")
        self.items = owner[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.hashes) + 1))

    def matches(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row in all, and row, term and number of each different match, by row."""
        words = Words(data, off, ALNUM, lower=True)
        n, size = np.diff(words.first), len(self.hashes)
        if not size:
            return n, *(np.zeros(0, np.int64) for _ in range(3))
        h = words.hashes()
        code = np.minimum(np.searchsorted(self.hashes, h), size - 1)
        known = np.flatnonzero(self.hashes[code] == h)
        pairs, tf = np.unique(words.row_of_word()[known] * size + code[known], return_counts=True)
        return n, pairs // size, pairs % size, tf

    def impacts(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, row and impact of every item of every match."""
        m = FLAT + _product_over(SLOPE * n, docs, length)
        impact = weight[term] * (SCALE * tf // (STEP * tf + SATURATION * m[row]))
        times = np.diff(self.first)[term]
        ends = np.cumsum(times)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
        return self.items[np.repeat(self.first[:-1][term], times) + place], np.repeat(row, times), np.repeat(impact, times)


def _product_over(n: np.ndarray, by: int, over: int) -> np.ndarray:
    """n * by // over, in wider numbers where 64 bits don't hold the product."""
    if len(n) and int(n.max()) * by >= 2**63:
        return np.array([int(x) * by // over for x in n.tolist()], np.int64)
    return n * by // max(over, 1)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts non-negative numbers, by 16 bits at a time from the lowest (numpy sorts 16 bits by radix)."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    top, shift = int(keys.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(item: np.ndarray, row: np.ndarray, impact: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, row and sum of the impacts of each pair that occurs, in order."""
    keys = item * rows + row
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[first] // rows, keys[first] % rows, sums


class Best:
    """The k best (score, doc_id) of each item, in heaps with the worst on top."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list) -> None:
        """ids: doc_id of each row, or None."""
        for i, s, d in zip(item.tolist(), score.tolist(), ids):
            heap, entry = self.heaps[i], (s, -(NULL_ID if d is None else d))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        found = [(i, s, None if d == -NULL_ID else -d, r) for i, heap in enumerate(self.heaps) for r, (s, d) in enumerate(sorted(heap, reverse=True), 1)]
        columns = [pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["item", "score", "doc_id", "rank"])


_FOUND = "item int, score long, doc_id long, rank int"


def statistics(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents with a term at all, and how many terms these have with repeats."""
    size = len(terms.hashes)

    def fill(batch, cells):
        for _, _, data, off in slices(batch.column(0)):
            n, _, term, _ = terms.matches(data, off)
            cells[:size] += np.bincount(term, minlength=size)[:size]
            cells[size] += (n > 0).sum()
            cells[size + 1] += n.sum()

    cells = hashed_counts(docs.select("text"), fill, (size + 1).bit_length(), np.int64)
    return cells[:size], int(cells[size]), int(cells[size + 1])


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _searched(docs: DataFrame, terms: Terms, k: int) -> DataFrame:
    """item (number of it), score, doc_id, rank: the best of each task."""
    df, n_docs, length = statistics(docs, terms)
    weight = weights(df, n_docs)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight))

    def run(batches):
        t, w = shared.value
        best = Best(len(t.ids), k)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in slices(batch.column(1)):
                n, *match = t.matches(data, off)
                item, row, score = accumulate(*t.impacts(n, *match, w, n_docs, length), hi - lo)
                some = np.flatnonzero((score > 0) & (score >= best.least[item]))
                best.add(item[some], score[some], ids.take(pa.array(row[some] + lo)).to_pylist())
        yield best.batch()

    def select(batches):
        best = Best(len(shared.value[0].ids), k)
        for batch in batches:
            best.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist())
        yield best.batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = saved(rows.mapInArrow(run, _FOUND), "search-candidates")
    return found.repartitionByRange("item").mapInArrow(select, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, part_words: int = 1 << 19, max_words: int = 1 << 24) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), those with a score above 0.

    Over `max_words` words of items raise an error, as the items pass through the driver.
    """
    spark = docs.sparkSession
    out = []
    for part in parts_of(items.select("item_id", "text").dropDuplicates(), part_words, max_words):
        terms = Terms(part)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(terms.ids)], "item int, item_id long")
        # A row an item of one part.
        out.append(_searched(docs, terms, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole
