"""Language identification by interpolated Kneser-Ney character models.

One model of order `order` per language over letters: text is lower-cased
letter by letter and every run of other characters is one space. Counts of
counts, discounts and continuation counts come from all n-grams of the training
rows, and none is left out of the model. A language with more than `max_rows`
labelled rows trains on those of the least hashes of their texts, as many whole
buckets of 1,024 as `max_rows` holds: that bound on the labelled sample is all
that limits the table of n-grams, which is made in Spark and sent to the driver.

Languages are taken in blocks of `Models.BLOCK`. The models of a block share one
sorted array of n-gram hashes per order, with a column of log probabilities per
language, interpolation already done: a position costs one binary search a
block, and only n-grams that no language of the block has seen fall back to the
shorter context. An n-gram takes a cell for each language of its blocks, however
many languages there are.

A document's language is that of the lowest cross-entropy per character; a tie
goes to the language that comes first. `score` is the softmax of the negative
cross-entropies, by characters of a document of `evidence` at most. Rejection is
calibrated on labelled rows that no count has seen, an eighth of each language's
(by hash of the text, so copies are on one side): `accepted` is false when the
cross-entropy lies further above the median of those rows than `margin` times as
far as their quantile `tail` does. A language with fewer than `least` labelled
rows keeps none out and is calibrated on those it was trained on.

Null texts and texts without a letter are `und`, score 0, not accepted. Rows
with a null lang or text train nothing. Without training rows all are `und`.
Very long texts are scored whole, in one task each. Repeated rows each count and
each get a row; other columns play no part.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunlattice.llm.common import SLICE_BYTES, discard, free_name, mix, saved, slices, tidy

_STEP = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 17, dtype=np.uint64)
_FLUSH = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Code point of the lower-case letter by code point; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(0x323B0):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of the rows of a slice, and where each row begins; rows end with a space."""
    ends = np.full(len(off) - 1, 0x20, np.uint8)
    spaced = np.insert(data, off[1:], ends)
    off = off + np.arange(len(off))
    text = str(memoryview(spaced), "utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((spaced & 0xC0) != 0x80)])[off]
    s = _letters()[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    keep[at[:-1]] = s[at[:-1]] > 0
    first = np.concatenate([[0], np.cumsum(keep)])[at]
    return s[keep], first


def _grams(s: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each symbol, n from 1 to order; rows are preceded by spaces."""
    n = len(s)
    depth = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out, h = [], np.zeros(n, np.uint64)
    for k in range(order):
        back = np.zeros(n, np.uint64)
        if k < n:
            back[k:] = s[: n - k]
        back[depth < k] = 0
        h = mix(h + back + _STEP[k])
        out.append(h)
    return out


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """lang, gram (symbols of the longest n-grams, as code points), n: summed over all rows (lang, text)."""

    def run(batches):
        held: dict[str, list] = {}

        def packed(lang):
            parts = held.pop(lang)
            h = np.concatenate([p[0] for p in parts])
            _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
            return h[at], np.concatenate([p[1] for p in parts])[at], n

        def out(langs):
            for lang in langs:
                _, grams, n = packed(lang)
                rows = pa.ListArray.from_arrays(np.arange(0, grams.size + 1, order, dtype=np.int32), grams.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), rows, pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column(1).filter(pc.equal(langs, lang))
                for _, _, data, off in slices(texts):
                    s, first = _symbols(data, off)
                    if len(s):
                        h = _grams(s, first, order)[-1]
                        _, at, n = np.unique(h, return_index=True, return_counts=True)
                        depth = at - first[np.searchsorted(first, at, side="right") - 1]
                        back = np.arange(order - 1, -1, -1)
                        grams = np.where(back[None, :] <= depth[:, None], s[np.maximum(at[:, None] - back, 0)], 0).astype(np.int32)
                        held.setdefault(lang, []).append((h[at], grams, n))
                        if sum(len(p[0]) for p in held[lang]) > _FLUSH:
                            held[lang] = [packed(lang)]
                            if len(held[lang][0][0]) > _FLUSH:
                                yield from out([lang])
            while len(held) > 64:
                yield from out(list(held)[:1])
        yield from out(list(held))

    counted = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, gram array<int>, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(grams: np.ndarray) -> np.ndarray:
    """Hashes as in _grams, of rows of symbols."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = mix(h + grams[:, -1 - k].astype(np.uint64) + _STEP[k])
    return h


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, (keys[at] == h) if len(keys) else np.zeros(len(h), bool)


def _tables(grams: np.ndarray, n: np.ndarray, order: int) -> list[dict]:
    """From order 1 up: hash of each n-gram, of its context and its ending, its discounted share; weight of the rest by context.

    The highest order has counts, the lower ones the number of different symbols before.
    """
    out = []
    for k in range(order, 0, -1):
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        context, of = np.unique(_hash(grams[:, :-1]), return_inverse=True)
        total = np.bincount(of, weights=n)
        out.append({"key": _hash(grams), "context": context[of], "ending": _hash(grams[:, 1:]), "share": (n - discount) / total[of], "contexts": context, "rest": discount * np.bincount(of) / total})
        if k > 1:
            grams, of = np.unique(grams[:, 1:], axis=0, return_inverse=True)
            n = np.bincount(of.ravel())
    return out[::-1]


class Models:
    """Interpolated Kneser-Ney models of all languages, in blocks of languages that share sorted hash arrays."""

    BLOCK = 8

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        """counts: by language, n-grams (rows of `order` symbols) and how often each occurs."""
        self.order, self.langs = order, sorted(counts)
        #: By block of languages: by order, keys and log probabilities of n-grams, keys and log weights of contexts; log floors.
        self.blocks: list[tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]] = []
        for lo in range(0, len(self.langs), self.BLOCK):
            self.blocks.append(self._block([_tables(*counts[x], order) for x in self.langs[lo : lo + self.BLOCK]]))

    def _block(self, each: list[list[dict]]):
        size, levels = len(each), []
        floor = np.log(np.array([t[0]["rest"][0] / (len(t[0]["key"]) + 1) for t in each]))
        below, low_keys = np.zeros((0, size)), np.zeros(0, np.uint64)
        for k in range(self.order):
            t = [e[k] for e in each]
            keys, at = np.unique(np.concatenate([x["key"] for x in t]), return_index=True)
            context, ending = (np.concatenate([x[c] for x in t])[at] for c in ("context", "ending"))
            contexts = np.unique(np.concatenate([x["contexts"] for x in t]))
            rest = np.ones((len(contexts), size), np.float32)
            for c, x in enumerate(t):
                rest[_find(contexts, x["contexts"])[0], c] = x["rest"]
            if k:
                p = below[_find(low_keys, ending)[0]] * rest[_find(contexts, context)[0]]
            else:
                p = np.broadcast_to(np.exp(floor), (len(keys), size)).copy()
            for c, x in enumerate(t):
                p[_find(keys, x["key"])[0], c] += x["share"]
            levels.append((keys, np.log(p).astype(np.float32), contexts, np.log(rest)))
            below, low_keys = p, keys
        return levels, floor.astype(np.float32)

    def logs(self, grams: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Log probability of each symbol, a column per language. grams: by order; before: the same of the symbol before."""
        return np.concatenate([self._logs(levels, floor, grams, before) for levels, floor in self.blocks], axis=1)

    def _logs(self, levels, floor, grams, before) -> np.ndarray:
        out = np.zeros((len(grams[0]), len(floor)), np.float32)
        left = np.arange(len(out))
        for k in range(self.order - 1, -1, -1):
            keys, p, contexts, rest = levels[k]
            at, there = _find(keys, grams[k][left])
            out[left[there]] += p[at[there]]
            left = left[~there]
            if not len(left):
                return out
            if k:
                at, known = _find(contexts, before[k - 1][left])
                out[left[known]] += rest[at[known]]
        out[left] += floor
        return out

    def cross_entropy(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row of a slice: nats a symbol per language, number of symbols."""
        s, first = _symbols(data, off)
        n = np.diff(first)
        out = np.full((len(n), len(self.langs)), np.inf)
        if len(s) and self.langs:
            grams = _grams(s, first, self.order)
            before = []
            for k, g in enumerate(grams):
                start = _hash(np.zeros((1, k + 1), np.uint32))
                b = np.concatenate([start, g[:-1]])
                b[first[:-1][n > 0]] = start
                before.append(b)
            logs = self.logs(grams, before)
            some = np.flatnonzero(n > 0)
            out[some] = -np.add.reduceat(logs, first[some], axis=0, dtype=np.float64) / n[some, None]
        return out, n


def roles(rows: DataFrame, max_rows: int = 4_000_000, least: int = 32, buckets: int = 1024) -> DataFrame:
    """rows (lang, text, ...) with `role`: 0 trains, 1 calibrates, 2 does both; null: neither, for want of a lang or text or beyond max_rows."""
    bucket = F.pmod(F.xxhash64("text"), F.lit(buckets))
    known = rows.filter("lang is not null and text is not null")
    # As many rows a language as there are buckets, then one.
    steps = known.groupBy(F.col("lang").alias("of_lang"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of_lang").orderBy("bucket"))
    used = steps.withColumn("upto", upto).groupBy("of_lang").agg(F.max(F.when(F.col("upto") <= max_rows, F.col("bucket"))).alias("last"), F.sum("n").alias("total"))
    role = F.when(F.col("text").isNull() | ~F.coalesce(bucket <= F.col("last"), F.lit(False)), F.lit(None)).when(F.col("total") < least, F.lit(2)).otherwise((bucket % 8 == 3).cast("int"))
    return rows.join(F.broadcast(used), F.col("lang") == F.col("of_lang"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], role.alias("role"))


def train(rows: DataFrame, order: int = 4) -> Models:
    """Models of rows (lang, text); a null lang or text trains nothing."""
    known = rows.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = saved(count_grams(known, order), "language-grams")
    table = counts.select("lang", "gram", "n").toArrow().combine_chunks()
    discard(counts)
    out = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
        flat = own["gram"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        out[lang] = (flat.flatten().to_numpy().reshape(-1, order).astype(np.uint32), own["n"].to_numpy())
    return Models(out, order)


def classify(docs: DataFrame, models: Models, evidence: int = 20, name: str = "language", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Each row of docs (a column `text`) with a struct `name`: lang_pred, score, cross_entropy, n_symbols.

    A task holds some 150 bytes a byte of text for a slice of `slice_bytes`, or of one text where that is longer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    columns = [*docs.columns, name]
    place = columns.index("text")
    added = T._parse_datatype_string("lang_pred string, score double, cross_entropy double, n_symbols long")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, added)])

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            best, score, entropy, size = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, off in slices(batch.column(place), slice_bytes):
                ce, n = m.cross_entropy(data, off)
                low = ce.min(1) if m.langs else np.full(len(n), np.inf)
                some = np.isfinite(low)
                gap = np.where(some[:, None], ce - np.where(some, low, 0)[:, None], 0)
                best.append(np.where(some, ce.argmin(1) if m.langs else 0, len(m.langs)))
                score.append(np.where(some, 1 / np.maximum(1, np.exp(-gap * np.minimum(n, evidence)[:, None]).sum(1)), 0))
                entropy.append(np.where(some, low, np.nan))
                size.append(n)
            best, score, entropy, size = (np.concatenate(x) for x in (best, score, entropy, size))
            parts = [pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(parts, added.names)], columns)

    return docs.mapInArrow(tidy(run), schema)


def limits(scored: DataFrame, margin: float = 4.0, tail: float = 0.99, steady: int = 400) -> DataFrame:
    """lang_pred, centre and most: how far above the centre of its language a cross-entropy may lie.

    scored: calibration rows with lang, lang_pred, cross_entropy, n_symbols; those
    count whose language was found. The centre is the median; distances from it
    are scaled by the root of the length (as far as `steady` symbols), as short
    texts vary more, and `most` is `margin` times their quantile `tail`. Both come
    from counts in steps of a thousandth, so no group is gathered.
    """
    right = scored.filter("lang = lang_pred and cross_entropy is not null")
    centre = _quantile(right, F.col("cross_entropy"), 0.5, "centre")
    # A row a language.
    near = right.join(F.broadcast(centre), "lang_pred").withColumn("away", _scaled(steady))
    spread = _quantile(near, F.col("away"), tail, "spread")
    return centre.join(spread, "lang_pred").select("lang_pred", "centre", (margin * F.greatest(F.col("spread"), F.lit(0.01))).alias("most"))


def _quantile(rows: DataFrame, x, q: float, name: str) -> DataFrame:
    steps = rows.groupBy("lang_pred", F.floor(x * 1000).alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang_pred")
    run = steps.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("total", F.sum("n").over(group))
    return run.filter(F.col("upto") >= q * F.col("total")).groupBy("lang_pred").agg(((F.min("step") + 0.5) / 1000).alias(name))


def _scaled(steady: int):
    return (F.col("cross_entropy") - F.col("centre")) * F.sqrt(F.least(F.col("n_symbols"), F.lit(steady)) / steady)


def fits(steady: int = 400):
    """Whether a row's cross-entropy is within the limits joined to it; a language without calibration rows takes all."""
    return (F.col("lang_pred") != "und") & F.coalesce(_scaled(steady) <= F.col("most"), F.lit(True))


def identify(docs: DataFrame, training, order: int = 4, max_rows: int = 4_000_000, evidence: int = 20, margin: float = 4.0, tail: float = 0.99, steady: int = 400, least: int = 32) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted, in_training of each row of docs (doc_id, text, lang).

    training: a boolean column over docs, the rows that may train and calibrate.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.coalesce(training, F.lit(False)).alias("in_training"))
    rows = roles(rows.withColumn("lang", F.when(F.col("in_training"), F.col("lang"))), max_rows, least)
    models = train(rows.filter("role in (0, 2)"), order)
    scored = saved(classify(rows, models, evidence).select("doc_id", "lang", "in_training", "role", "language.*"), "language")
    known = limits(scored.filter("role in (1, 2)"), margin, tail, steady)
    # One row a language that was learned.
    out = scored.join(F.broadcast(known), "lang_pred", "left")
    return out.select("doc_id", "lang_pred", "score", "cross_entropy", fits(steady).alias("accepted"), "in_training")


def keep_known(docs: DataFrame, order: int = 4, max_rows: int = 4_000_000, evidence: int = 20, margin: float = 4.0, tail: float = 0.99, steady: int = 400, least: int = 32, slice_bytes: int = 1 << 18) -> DataFrame:
    """The rows of docs whose language is accepted, `lang` being the identified one; all labelled rows train or calibrate.

    Each text is scored once, on its way through; those that calibrate are scored before.
    """
    rows = roles(docs.select(F.col("lang").cast("string").alias("lang"), "text"), max_rows, least)
    models = train(rows.filter("role in (0, 2)"), order)
    scored = saved(classify(rows.filter("role in (1, 2)"), models, evidence, slice_bytes=slice_bytes).select("lang", "language.*"), "language")
    known = limits(scored, margin, tail, steady).collect()
    discard(scored)
    name = free_name(docs.columns, "language")
    got = F.col(name)
    fine = F.lit(True)
    # A term a learned language.
    for r in known:
        scaled = (got.cross_entropy - r.centre) * F.sqrt(F.least(got.n_symbols, F.lit(steady)) / steady)
        fine = F.when(got.lang_pred == r.lang_pred, scaled <= r.most).otherwise(fine)
    kept = classify(docs, models, evidence, name, slice_bytes).filter((got.lang_pred != "und") & F.coalesce(fine, F.lit(False)))
    return kept.select(*[got.lang_pred.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
