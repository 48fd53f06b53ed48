"""Benchmark decontamination with a generalised suffix automaton.

The items of a benchmark, as words, go into one suffix automaton. The words of
each document are streamed through it; the state and the length of the longest
match say at each word which runs of item words end there. A match of `window`
words, or a whole item that is shorter, marks its words as hit.

The automaton is broadcast, as arrays. The size of the benchmark is checked
first: its items are dealt into parts of at most `part_words` words (bytes / 2
bounds them), each part is an automaton, and the documents pass by one after the
other. Between two of them they are written with the words hit so far, so a
worker holds one part at a time, and hits and items of all parts add up exactly.
A benchmark of more than `max_words` words raises an error; none is ever cut.

A word of a document that occurs in no item can't be part of a match, and neither
can a run of words without any hash of an item's window (or of a whole shorter
item): the automaton is only walked over runs of known words around such hashes,
which numpy finds. That skips no match.

Null and empty texts have no words: nothing is hit. Items without words, or
null, are left out; items repeated with one id count once in n_items, and a null
item_id is not listed or counted though its windows count as hits. Repeated
document rows each get a row, very long texts are read whole. An empty benchmark
leaves all documents as they are. A column that has the name asked for is
replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunlattice.llm.common import ALNUM, Words, free_name, mix, saved, slices

SCHEMA = "n_words long, n_hit long, items array<long>, longest_span long, cleaned string"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _runs(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of n words that begin at the given places (all)."""
    at = np.arange(len(h) - n + 1) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out * _STEP + h[at + k])
    return out


class Automaton:
    """Generalised suffix automaton over integer words, with the items of each window and short item.

    Built with an edge table a state; kept as one sorted array of edges.
    """

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int):
        """items: id and word hashes."""
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        coded = [(i, np.searchsorted(self.vocabulary, w).tolist()) for i, w in items if len(w)]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        size = len(self.vocabulary) + 1
        edges = sorted((s * size + w, t) for s, out in enumerate(self.next) for w, t in out.items())
        self.size, self.edges, self.ends = size, array("q", (e for e, _ in edges)), array("q", (t for _, t in edges))
        self.next = []
        self.link, self.length = array("q", self.link), array("q", self.length)
        self.windows: dict[int, set] = {}
        whole: dict[int, set] = {}
        for i, words in coded:
            state = matched = 0
            for w in words:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    self.windows.setdefault(self._holding(state), set()).add(i)
            if len(words) < window:
                whole.setdefault(state, set()).add(i)
        # For each state, the nearest state at or above it that ends a short item.
        self.whole = whole
        self.short = array("q", bytes(8 * len(self.link)))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in whole else self.short[self.link[s]]
        #: Hashes of what can be hit, by number of words.
        self.keys: dict[int, np.ndarray] = {}
        for n in {min(window, len(w)) for _, w in items if len(w)}:
            of = [w for _, w in items if (len(w) == n if n < window else len(w) >= n)]
            self.keys[n] = np.unique(np.concatenate([_runs(w, n) for w in of]))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _edge(self, state: int, w: int) -> int:
        key = state * self.size + w
        at = bisect_left(self.edges, key)
        return self.ends[at] if at < len(self.edges) and self.edges[at] == key else -1

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        to = self._edge(state, w)
        while to < 0 and state:
            state = self.link[state]
            matched = self.length[state]
            to = self._edge(state, w)
        return (to, matched + 1) if to >= 0 else (0, 0)

    def near(self, h: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Words of a run of n words, all known, with the hash of an item's window or of a whole shorter item: all others can't be hit."""
        cover = np.zeros(len(h) + 1, np.int64)
        seen = np.concatenate([[0], np.cumsum(known)])
        for n, keys in self.keys.items():
            if len(h) >= n:
                at = np.flatnonzero(seen[n:] - seen[:-n] == n)
                found = at[np.isin(_runs(h, n, at), keys)]
                np.add.at(cover, found, 1)
                np.add.at(cover, found + n, -1)
        return np.cumsum(cover[:-1]) > 0

    def _holding(self, state: int) -> int:
        """The state of the last `window` words of a match of that many at least."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[int], hit: np.ndarray, at: int, found: set) -> None:
        """Mark the hit words of a run that begins at word `at`; add the items found."""
        state = matched = 0
        window, step, short = self.window, self.step, self.short
        for k, w in enumerate(words):
            state, matched = step(state, matched, w)
            if matched >= window:
                items = self.windows.get(self._holding(state))
                if items:
                    found |= items
                    hit[at + k - window + 1 : at + k + 1] = True
            # The state itself only stands for its longest word run; those above it are all matched.
            s = short[state] if matched == self.length[state] else short[self.link[state]] if state else 0
            while s:
                found |= self.whole[s]
                hit[at + k - self.length[s] + 1 : at + k + 1] = True
                s = short[self.link[s]]


def item_words(items: DataFrame) -> list[tuple[int | None, np.ndarray]]:
    out = []
    for r in items.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        out.append((r.item_id, Words(data, np.array([0, len(data)]), ALNUM, lower=True).hashes()))
    return [x for x in out if len(x[1])]


def parts_of(benchmark: DataFrame, part_words: int, max_words: int) -> list[list[tuple[int | None, np.ndarray]]]:
    """Items (id and word hashes) in parts of at most `part_words` words, an item at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    if size > max_words:
        raise ValueError(f"the benchmark may hold {size:.0f} words, over max_words = {max_words}")
    out, held = [[]], 0
    for i, words in item_words(items):
        if out[-1] and held + len(words) > part_words:
            out.append([])
            held = 0
        out[-1].append((i, words))
        held += len(words)
    return out


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 1 << 24, name: str = "contamination", part_words: int = 1 << 19) -> DataFrame:
    """Each row of docs with a struct `name`: n_words, n_hit, items, longest_span, cleaned.

    `cleaned` is the text without its hit words, what stands between two
    neighbouring hit words included.
    """
    if name in docs.columns:
        docs = docs.drop(name)
    parts = parts_of(benchmark, part_words, max_words)
    state = free_name([*docs.columns, name], "hits_so_far")
    for items in parts[:-1]:
        docs = saved(_pass(docs, Automaton(items, window), state, state, False), "benchmark-hits")
    return _pass(docs, Automaton(parts[-1], window), state, name, True)


def _pass(docs: DataFrame, automaton: Automaton, state: str, name: str, last: bool) -> DataFrame:
    """docs with the hits of one automaton added to those in `state`; the last pass sums them up in `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = T._parse_datatype_string(SCHEMA if last else "hits binary, items array<long>")
    kept = [f for f in docs.schema.fields if f.name != state]
    columns = [*(f.name for f in kept), name]
    text, before = docs.columns.index("text"), docs.columns.index(state) if state in docs.columns else None
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("longest_span", pa.int64()), ("cleaned", pa.string())]) if last else pa.struct([("hits", pa.binary()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows, had = [], None if before is None else batch.column(before).to_pylist()
            for lo, hi, data, off in slices(batch.column(text)):
                rows += _marked(data, off, shared.value, None if had is None else had[lo:hi], last)
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != before), pa.array(rows, arrow)], columns)

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, kind)]))


def _marked(data: np.ndarray, off: np.ndarray, a: Automaton, had: list[dict] | None, last: bool) -> list[dict]:
    words = Words(data, off, ALNUM, lower=True)
    h, first = words.hashes(), words.first
    row = words.row_of_word()
    hit = np.zeros(len(h), bool)
    found: dict[int, set] = {}
    code = np.minimum(np.searchsorted(a.vocabulary, h), max(len(a.vocabulary) - 1, 0))
    known = a.vocabulary[code] == h if len(a.vocabulary) else hit
    if known.any():
        known = a.near(h, known)
        edge = np.ones(len(h) + 1, bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        cuts = np.flatnonzero(edge)
        runs = np.flatnonzero(known[cuts[:-1]])
        for s, e in zip(cuts[runs].tolist(), cuts[runs + 1].tolist()):
            a.scan(code[s:e].tolist(), hit, s, found.setdefault(int(row[s]), set()))
    for d, x in enumerate(had or ()):
        s, e = int(first[d]), int(first[d + 1])
        hit[s:e] |= np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=e - s).astype(bool) if x["hits"] else False
        found.setdefault(d, set()).update(x["items"])
    if not last:
        return [{"hits": np.packbits(hit[first[d] : first[d + 1]]).tobytes(), "items": sorted(i for i in found.get(d, ()) if i is not None)} for d in range(len(off) - 1)]
    total = np.concatenate([[0], np.cumsum(hit)])
    out = []
    for d in range(len(off) - 1):
        s, e = int(first[d]), int(first[d + 1])
        n = int(total[e] - total[s])
        span, cleaned = 0, None
        if n:
            h_d = np.concatenate([[False], hit[s:e], [False]])
            begin, end = np.flatnonzero(h_d[1:] & ~h_d[:-1]), np.flatnonzero(h_d[:-1] & ~h_d[1:])
            span = int((end - begin).max())
            parts, at = [], int(off[d])
            for b, f in zip(begin, end):
                parts.append(data[at : words.starts[s + b]].tobytes())
                at = int(words.ends[s + f - 1])
            parts.append(data[at : off[d + 1]].tobytes())
            cleaned = b"".join(parts).decode()
        out.append({"n_words": e - s, "n_hit": n, "items": sorted(i for i in found.get(d, ()) if i is not None), "longest_span": span, "cleaned": cleaned})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = 1 << 24) -> DataFrame:
    """docs without the spans of item words: `text` and `n_chars` are those of what is left.

    A document of which more than `max_coverage` of the words were hit, or that
    has no word left, goes. Documents without a hit stay as they are.
    """
    name = free_name(docs.columns, "contamination")
    seen = mark(docs, benchmark, window, max_words, name)
    c = F.col(name)
    kept = seen.filter((c.n_hit == 0) | ((c.n_hit <= max_coverage * c.n_words) & (c.n_hit < c.n_words)))
    text = F.when(c.n_hit > 0, c.cleaned).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(c.n_hit > 0, F.length(c.cleaned).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return kept.select(*[new[k].alias(k) if k in new else F.col(f"`{k}`") for k in docs.columns])


def digest(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of marked documents."""
    c = F.col("contamination")
    listed = F.array_join(F.array_sort(F.transform(c.items, lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c.items).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (c.n_hit > 0).alias("contaminated"), c.longest_span.alias("longest_span"))
