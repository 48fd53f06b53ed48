"""N-gram Jaccard join with a signature tree a bucket.

Documents are compared by their sets of shingles of `width` words and joined
when the Jaccard similarity reaches `percent` / 100. The result is one row a document
with its component, not the pairs.

How it runs:

1. Each text becomes its shingle set; equal sets are one class, so groups of
   copies cost one row each from here on.
2. Two sets that similar must share a shingle within the first
   n - ceil(t n) + 1 of both, in any common order. The order is by how often a
   shingle's counter cell was hit over the whole corpus, rare first, so passages
   that many documents share come last. The table of counters grows with the
   input up to `COUNT_BITS`; beyond that the order is coarser, the result the
   same. Classes that share such a shingle meet in its bucket.
3. Every class of a bucket is first checked against the class in which the
   shingle stands earliest: for a group of near copies that is the one with the
   least text of its own. These links already join most groups, and what has one
   label then is not searched again.
4. A bucket that still has several labels is searched by a
   signature tree: leaves hold a bitmap of the set and its size, nodes the OR of
   their bitmaps and the range of their sizes. Two of them (or one with itself)
   are walked in pairs of nodes; a pair is left when all below has one label
   already, when the size ranges can't fit, or when the largest overlap that
   the bitmaps allow is below what the smallest sizes need. Large buckets are
   cut into blocks, and pairs of blocks are dealt over tasks.
5. Pairs of either kind whose own bitmaps allow enough overlap are counted exactly
   on the whole sets. That gives all components.
6. Where all links are wanted, the sets of each component of three classes or
   more meet once more, in blocks by size: a tree over each prunes as before, but
   not by label, the pairs left are counted exactly within the task by a matrix
   product, and what leaves it is a number of links for each set, no pair. Sets
   that are linked are in one component, so no link is missed.

No bucket, pair or partner is capped. Nulls and texts without words have an
empty set and link with nothing; they are their own component. A null doc_id
takes part but names a component only if no other id is in it (the component is
then null). Rows repeated with one doc_id each get a row. Columns besides
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.llm import common
from sunlattice.llm.common import SPACED, Words, discard, hashed_counts, saved, shingles, signed, slices, sorted_join
from sunlattice.llm.components import components

#: At most 2**COUNT_BITS counters, a byte each in every worker.
COUNT_BITS = 22
FAN = 8
#: Sets of a block, and shingles of a block of whole sets.
BLOCK = 512
BLOCK_ITEMS = 1 << 20
#: Members of a bucket from which signatures of WIDE bits an item are used: nearly exact, so that few pairs are left of many.
LARGE = 32
WIDE = 16


def _sets(column: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each row of a batch."""
    none = np.zeros(0, np.uint64)
    for lo, hi, data, off in slices(column):
        words = Words(data, off, SPACED, lower=True)
        h, valid = shingles(words.hashes(), words.first, width)
        for d in range(hi - lo):
            s, e = words.first[d], words.first[d + 1]
            yield lo + d, np.unique(h[s:e][valid[s:e]]) if e > s else none


def _bits(n: int, each: int = 2) -> int:
    """Bits of a signature for a set of n shingles: a power of two, `each` times n at least."""
    return 1 << max(6, (each * n - 1).bit_length())


def _signature(hashes: np.ndarray, each: int = 2) -> bytes:
    bits = np.zeros(_bits(len(hashes), each), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _print(hashes: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8")
    return int(both[0]), int(both[1])


def shingle_sets(docs: DataFrame, percent: int, width: int = 3) -> DataFrame:
    """doc_id, n, fingerprint (f1, f2), prefix and signature of each document's shingle set; written to the shared folder."""

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A counter for about 2,000 bytes of text: a task's counters stay a small part of what it reads.
    bits = min(COUNT_BITS, max(12, (size >> 11).bit_length()))

    def fill(batch, cells):
        for _, _, data, off in slices(batch.column(0)):
            words = Words(data, off, SPACED, lower=True)
            h, valid = shingles(words.hashes(), words.first, width)
            np.add.at(cells, (h[valid] >> np.uint64(64 - bits)).astype(np.int64), 1)

    # How often, in steps of a twelfth: one byte a counter.
    often = (4 * np.log2(hashed_counts(docs.select("text"), fill, bits) + 1)).astype(np.uint8)
    counts = docs.sparkSession.sparkContext.broadcast(often)

    def make(batches):
        hits = counts.value
        for batch in batches:
            ns, f1, f2, prefixes, signatures = [], [], [], [], []
            for _, s in _sets(batch.column(1), width):
                n = len(s)
                a, b = _print(s)
                ns.append(n), f1.append(a), f2.append(b)
                if n:
                    order = np.argsort(hits[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                    prefixes.append(signed(s[order[: n - (percent * n + 99) // 100 + 1]]))
                    signatures.append(_signature(s))
                else:
                    prefixes.append(np.zeros(0, np.int64)), signatures.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["doc_id", "n", "f1", "f2", "prefix", "sig"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(make), "doc_id long, n int, f1 long, f2 long, prefix array<long>, sig binary"), "jaccard-sets")


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, wide: bool = False) -> DataFrame:
    """cid and `items`, the whole shingle set, of each class in `wanted` (cid), made anew from the texts; `wide`: a `sig` of WIDE bits an item instead.

    A Bloom filter, of sixteen bits a class or more, keeps most other texts out
    of the shuffle; the join that follows is exact.
    """
    name = "sig" if wide else "items"
    chosen = classes.join(wanted, "cid", "left_semi").select("cid", "f1", "f2", common.doc_key("rep").alias("rep"))
    chosen = saved(chosen, "jaccard-wanted")
    bits = min(26, max(12, (16 * chosen.count()).bit_length()))

    def fill(batch, cells):
        for h in _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits):
            cells[h] = 1

    bloom = hashed_counts(chosen.select("f1", "rep"), fill, bits, np.uint8, np.maximum)
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom))

    def make(batches):
        there = packed.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows, f1, f2, sets = [], [], [], []
            for row, s in _sets(batch.column(1), width):
                if len(s):
                    a, b = _print(s)
                    if all((there[h >> 3] >> (7 - (h & 7))) & 1 for (h,) in _places(np.array([a]), ids[row : row + 1], bits)):
                        rows.append(ids[row]), f1.append(a), f2.append(b), sets.append(_signature(s, WIDE) if wide else signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sets, pa.binary() if wide else pa.list_(pa.int64()))], ["rep", "f1", "f2", name])

    found = docs.select(common.doc_key().alias("rep"), "text").mapInArrow(common.tidy(make), f"rep long, f1 long, f2 long, {name} {'binary' if wide else 'array<long>'}")
    # A document repeated with its id would come twice. Grouped by the keys of the join, so that sets aren't moved again.
    key = ["rep", "f1", "f2"]
    found = saved(sorted_join(found, chosen, key).groupBy(*key).agg(F.first("cid").alias("cid"), F.first(name).alias(name)).select("cid", name), "jaccard-items")
    discard(chosen)
    return found


def _places(f1: np.ndarray, rep: np.ndarray, bits: int) -> list[np.ndarray]:
    h = common.mix(f1.astype(np.int64).view(np.uint64) ^ common.mix(rep.astype(np.int64).view(np.uint64)))
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)]


def _bloom(ids: DataFrame, name: str):
    """A test for arrays of ids that is true for all in the column `name` of ids and for few others; 16 bits an id, 8 MB at most."""
    bits = min(26, max(12, (16 * ids.count()).bit_length()))

    def fill(batch, cells):
        for h in _places(batch.column(0).to_numpy(), batch.column(0).to_numpy(), bits):
            cells[h] = 1

    packed = ids.sparkSession.sparkContext.broadcast(np.packbits(hashed_counts(ids.select(name), fill, bits, np.uint8, np.maximum)))

    def has(these: np.ndarray) -> np.ndarray:
        found = np.ones(len(these), bool)
        for h in _places(these, these, bits):
            found &= ((packed.value[h >> 3] >> (7 - (h & 7))) & 1).astype(bool)
        return found

    return has


def _those_in(pairs: DataFrame, side: str, items: DataFrame) -> DataFrame:
    """items without most of the classes that are not on one side of the pairs; the join that follows is exact."""
    has = _bloom(pairs.select(side).distinct(), side)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(batch.column(0).to_numpy())))

    return items.mapInArrow(common.tidy(keep), items.schema)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows whose doc_id is in gone (doc_id); a null id is one of its own.

    Only rows that a Bloom filter of the ids in gone finds are shuffled, for an
    exact join; all others, which are surely kept, stay in the task that reads them.
    So kept texts do not move, however many there are. Rows repeated with an id
    all go or all stay; an empty table on either side changes nothing.
    """
    name = common.free_name(docs.columns, "gone_id")
    gone = gone.select(common.doc_key().alias(name))
    has = _bloom(gone, name)
    maybe = F.pandas_udf(lambda ids: pd.Series(has(ids.to_numpy())), "boolean")(common.doc_key())
    unsure = docs.filter(maybe).join(gone.hint("merge"), common.doc_key() == F.col(name), "left_anti")
    return docs.filter(~maybe).unionByName(unsure.select(*docs.columns))


def _linked(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    left, right = (_those_in(pairs, k, items).select(F.col("cid").alias(k), F.col("items").alias(f"{k}_items")) for k in ("a", "b"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    return sorted_join(sorted_join(pairs, left, "a"), right, "b").filter(100 * both >= percent * (F.size("a_items") + F.size("b_items") - both)).select("a", "b")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures allow enough overlap: a bit of one set alone is an item of it alone."""
    left, right = (classes.select(F.col("cid").alias(k), F.col("n").alias(f"{k}_n"), F.col("sig").alias(f"{k}_sig")) for k in ("a", "b"))

    def keep(batches):
        for batch in batches:
            a_n, b_n = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
            only = np.zeros((2, len(batch)), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                words = min(len(x), len(y)) // 8
                x, y = (_fold(np.frombuffer(v, "<u8")[None, :], words) for v in (x, y))
                only[:, k] = np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()
            most = np.minimum(a_n - only[0], b_n - only[1])
            fine = pa.array(most * (100 + percent) >= percent * (a_n + b_n))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine)], ["a", "b"])

    joined = sorted_join(sorted_join(pairs, left, "a"), right, "b").select("a", "b", "a_n", "a_sig", "b_n", "b_sig")
    return joined.mapInArrow(common.tidy(keep), "a long, b long")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded by OR to `words` words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """A signature tree over sets in order of label and size: level 0 has the sets, each level above OR-combines FAN nodes."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, bits: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, spare, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare, first, last = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def pairs(self, other: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of this tree and of the other one that could be similar enough and have different labels.

        Both are walked from the root, level by level, in pairs of nodes.
        """
        top = max(len(self.levels), len(other.levels)) - 1
        a = b = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            one, two = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            out = []
            for s in range(0, len(a), 4096):
                x, y = a[s : s + 4096], b[s : s + 4096]
                keep = (one[2][x] * 100 >= percent * two[1][y]) & (two[2][y] * 100 >= percent * one[1][x])
                keep &= ~((one[4][x] == one[5][x]) & (two[4][y] == two[5][y]) & (one[4][x] == two[4][y]))
                if self is other:
                    keep &= (x < y) if level == 0 else (x <= y)
                x, y = x[keep], y[keep]
                most = np.bitwise_count(one[0][x] & two[0][y]).sum(1) + np.minimum(one[3][x], two[3][y])
                most = np.minimum(most, np.minimum(one[2][x], two[2][y]))
                keep = most * (100 + percent) >= percent * (one[1][x] + two[1][y])
                out.append((x[keep], y[keep]))
            a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            if level == 0 or not len(a):
                return a, b
            below = (len(self.levels[min(level - 1, len(self.levels) - 1)][0]), len(other.levels[min(level - 1, len(other.levels) - 1)][0]))
            down = (level < len(self.levels), level < len(other.levels))
            a, b = _children(a, b, *below, *down)
        return a, b


def _children(a, b, n_a, n_b, down_a, down_b):
    """All pairs of children of each pair of nodes; a tree that is lower stays at its root."""
    for side, n, down in ((0, n_a, down_a), (1, n_b, down_b)):
        if down:
            x, y = (a, b) if side == 0 else (b, a)
            kids = x[:, None] * FAN + np.arange(FAN)
            keep = kids < n
            y = np.broadcast_to(y[:, None], kids.shape)[keep]
            a, b = (kids[keep], y) if side == 0 else (y, kids[keep])
    return a, b


def _search(percent: int):
    """Over rows sorted by (token, band, i, j): walk each group's tree or two, yield the pairs that are left."""

    def group(rows):
        cid, n, label, side = (np.concatenate([r[k] for r in rows]) for k in range(4))
        raw = [s for r in rows for s in r[4]]
        words = min(len(s) for s in raw) // 8
        order = np.lexsort((n, label))
        bits = np.concatenate([_fold(np.frombuffer(raw[k], "<u8")[None, :], words) for k in order])
        cid, n, label, side = cid[order], n[order].astype(np.int64), label[order], side[order]
        if (side == 0).all():
            one = two = Tree(n, label, bits)
            ca = cb = cid
        else:
            one, two = (Tree(n[side == k], label[side == k], bits[side == k]) for k in (0, 1)) if (side == 1).any() else (None, None)
            ca, cb = cid[side == 0], cid[side == 1]
            if not len(ca):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = one.pairs(two, percent)
        return ca[a], cb[b]

    def search(batches):
        rows, key = [], None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            cid, n, label, side = (batch.column(k).to_numpy() for k in range(4, 8))
            sig = batch.column(8)
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                if e == s:
                    continue
                if rows and tuple(keys[s]) != key:
                    found.append(group(rows))
                    rows = []
                key = tuple(keys[s])
                rows.append((cid[s:e], n[s:e], label[s:e], side[s:e], sig.slice(s, e - s).to_pylist()))
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if rows:
            a, b = group(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return search


def _bands(rows: DataFrame, percent: int) -> DataFrame:
    """rows with `band`: sizes that can be linked are in the same band or in the next one."""
    return rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent) - 1e-9).cast("int"))


def _in_blocks(rows: DataFrame, cuts: DataFrame, values: DataFrame) -> DataFrame:
    """rows (token, band, cid, n, label) with their values (cid, value), dealt by (token, band, i, j): each two rows whose sizes fit meet once.

    cuts: blocks of each (token, band). Block i of a band meets each block j >= i
    of it (as side 1 it is the later one) and each block of the band below. The
    values, which are wide, are joined last and move once.
    """
    kept = ["cid", "n", "label"]
    rows = rows.join(cuts, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("cut")).cast("int"))
    own = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    own = own.select("token", (F.col("band") * 2).alias("band"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *kept, (F.col("block") > F.col("other")).cast("int").alias("side"))
    below, above = (cuts.select("token", (F.col("band") + k).alias("band"), F.col("cut").alias("cuts")) for k in (1, -1))
    many = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    up = rows.join(above, ["token", "band"]).withColumn("j", many).select("token", (F.col("band") * 2 + 1).alias("band"), F.col("block").alias("i"), "j", *kept, F.lit(0).alias("side"))
    down = rows.join(below, ["token", "band"]).withColumn("i", many).select("token", (F.col("band") * 2 - 1).alias("band"), "i", F.col("block").alias("j"), *kept, F.lit(1).alias("side"))
    key = ["token", "band", "i", "j"]
    dealt = sorted_join(own.union(up).union(down), values, "cid").select(*key, *kept, "side", *(c for c in values.columns if c != "cid"))
    return dealt.repartition(*key).sortWithinPartitions(*key)


def _tree_pairs(docs: DataFrame, shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a < b) in buckets whose members have different labels, as far as the search leaves them."""
    # The head of a bucket has met all others already.
    rows = shared.filter("cid <> head").select("token", "cid", "n").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    kept = rows = saved(_bands(rows, percent), "jaccard-rows")
    open_ = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members")).filter("x <> y").select("token", "members")
    kept_open = rows = saved(rows.join(open_, "token"), "jaccard-open")
    cuts = rows.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cut"))
    found, wide = [], None
    for large in (False, True):
        part = rows.filter(F.col("members") >= LARGE if large else F.col("members") < LARGE).drop("members")
        if large:
            signatures = wide = _whole_sets(docs, classes, part.select("cid").distinct(), width, wide=True)
        else:
            signatures = classes.select("cid", "sig")
        found.append(_in_blocks(part, cuts, signatures).mapInArrow(common.tidy(_search(percent)), "a long, b long"))
    pairs = found[0].union(found[1])
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-tree")
    discard(kept, kept_open, wide)
    return pairs


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Common items of each set of one with each of two, by matrix products over runs of items that both have."""
    items = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    keys, place = np.unique(items, return_inverse=True)
    left = row < len(one)
    n = len(keys)
    both = (np.bincount(place[left], minlength=n) > 0) & (np.bincount(place[~left], minlength=n) > 0)
    column = np.cumsum(both) - 1
    fine = both[place]
    row, place, left = row[fine], column[place[fine]], left[fine]
    order = np.argsort(place, kind="stable")
    row, place, left = row[order], place[order], left[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(both.sum()), 1024):
        s, e = np.searchsorted(place, (lo, lo + 1024))
        flags = np.zeros((len(one) + len(two), 1024), np.float32)
        flags[row[s:e], place[s:e] - lo] = 1
        out += flags[: len(one)] @ flags[len(one) :].T
    return out


def _degrees_in(percent: int):
    """Over rows sorted by (token, band, i, j) with whole sets: how many links each set has in each group."""

    def group(rows):
        cid, n, side = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 3))
        sets = [x for r in rows for x in r[4]]
        same = not side.any()
        if not same and side.all():
            return cid[:0], n[:0]
        words = _bits(int(n.min())) // 64
        order = np.argsort(n, kind="stable")
        bits = np.concatenate([_fold(np.frombuffer(_signature(sets[k]), "<u8")[None, :], words) for k in order])
        cid, n, side, sets = cid[order], n[order].astype(np.int64), side[order], [sets[k] for k in order]
        # No two labels are alike: only sizes and bitmaps prune.
        parts = [np.flatnonzero(side == k) for k in ((0, 0) if same else (0, 1))]
        both_ = [Tree(n[x], k * len(n) + np.arange(len(x)), bits[x]) for k, x in enumerate(parts)]
        a, b = both_[0].pairs(both_[0] if same else both_[1], percent)
        if not len(a):
            return cid[:0], n[:0]
        a, b = parts[0][a], parts[1][b]
        (ka, ia), (kb, ib) = (np.unique(x, return_inverse=True) for x in (a, b))
        both = _overlaps([sets[k] for k in ka], [sets[k] for k in kb])[ia, ib].astype(np.int64)
        linked = 100 * both >= percent * (n[a] + n[b] - both)
        degree = np.bincount(np.concatenate([a[linked], b[linked]]), minlength=len(cid))
        return cid[degree > 0], degree[degree > 0]

    def count(batches):
        rows, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            cid, n, label, side = (batch.column(k).to_numpy() for k in range(4, 8))
            flat, off = batch.column(8).values.to_numpy().view(np.uint64), batch.column(8).offsets.to_numpy()
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                if e > s:
                    if rows and tuple(keys[s]) != key:
                        found = group(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["cid", "n_links"])
                        rows = []
                    key = tuple(keys[s])
                    rows.append((cid[s:e], n[s:e], label[s:e], side[s:e], [flat[off[k] : off[k + 1]].copy() for k in range(s, e)]))
        if rows:
            found = group(rows)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["cid", "n_links"])

    return count


def _degrees(docs: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, width: int) -> DataFrame:
    """cid, n_links: how many other classes each one is linked with; those of two in a component with each other."""
    members = labels.groupBy("label").agg(F.count("*").alias("members"))
    named = saved(labels.join(members, "label"), "jaccard-members")
    pairs = named.filter("members = 2").select(F.col("node").alias("cid"), F.lit(1).cast("long").alias("n_links"))
    more = named.filter("members > 2").select(F.col("node").alias("cid"), F.col("label").alias("token"), "label")
    items = _whole_sets(docs, classes, more.select("cid"), width)
    rows = _bands(more.join(items.select("cid", F.size("items").alias("n")), "cid"), percent)
    cuts = rows.groupBy("token", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("cut"))
    counted = _in_blocks(rows, cuts, items).mapInArrow(common.tidy(_degrees_in(percent)), "cid long, n_links long")
    out = saved(counted.groupBy("cid").agg(F.sum("n_links").alias("n_links")).union(pairs), "jaccard-degrees")
    discard(items, named)
    return out


def _few_links(docs: DataFrame, shared: DataFrame, classes: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) enough for the components, and their labels: first with the heads of buckets, then by a tree a bucket where labels differ."""
    # What can still be shared from this place on bounds the overlap.
    rest = F.least(F.col("n") - F.col("pos"), F.col("head_n") - F.col("head_pos")) + F.least("pos", "head_pos")
    star = shared.filter(F.col("cid") != F.col("head")).filter(rest * (100 + percent) >= percent * (F.col("n") + F.col("head_n")))
    star = saved(star.select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct(), "jaccard-star")
    close = saved(_possible(star, classes, percent), "jaccard-close")
    items = _whole_sets(docs, classes, close.select(F.col("a").alias("cid")).union(close.select("b")).distinct(), width)
    links = saved(_linked(close, items, percent), "jaccard-links")
    discard(items, close)
    labels = components(links, "jaccard-labels")

    tree = _tree_pairs(docs, shared, labels, classes, percent, width)
    more = saved(_possible(tree.join(star, ["a", "b"], "left_anti"), classes, percent), "jaccard-more")
    items = _whole_sets(docs, classes, more.select(F.col("a").alias("cid")).union(more.select("b")).distinct(), width)
    links = saved(links.union(_linked(more, items, percent)), "jaccard-links")
    discard(items, more, tree, star)
    return links, components(links, "jaccard-labels")


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, all_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), n_links (other sets that the document's own is linked with).

    Without `all_links` n_links counts only the links that were needed to find the components.
    """
    sets = shingle_sets(docs, percent, width)
    first = sets.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"))
    classes = saved(first.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    of_doc = saved(sets.select("doc_id", "n", "f1", "f2"), "jaccard-docs")
    discard(sets)

    # Within a bucket, sets in order of size fall into runs: across a gap no two sizes fit.
    tokens = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    by_size = Window.partitionBy("token").orderBy("n", "cid")
    apart = F.coalesce(100 * F.lag("n").over(by_size) < percent * F.col("n"), F.lit(True))
    last = F.coalesce(100 * F.col("n") < percent * F.lead("n").over(by_size), F.lit(True))
    runs = tokens.withColumns({"apart": apart, "last": last, "run": F.sum(apart.cast("int")).over(by_size)}).filter("not (apart and last)")
    by_place = Window.partitionBy("token", "run").orderBy("pos", "cid")
    seen = runs.withColumn("head", F.first(F.struct("cid", "n", "pos")).over(by_place))
    bucket = F.xxhash64("token", "run").alias("token")
    shared = saved(seen.select(bucket, "cid", "n", "pos", F.col("head.cid").alias("head"), F.col("head.n").alias("head_n"), F.col("head.pos").alias("head_pos")), "jaccard-shared")

    links, labels = _few_links(docs, shared, classes, percent, width)
    discard(shared)

    if all_links:
        degree = _degrees(docs, classes, labels, percent, width)
    else:
        degree = saved(links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links")), "jaccard-degrees")
    named = classes.select("cid", "f1", "f2", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "label").join(degree, "cid", "left").select("f1", "f2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = F.col("n") == 0
    out = (
        of_doc.join(of_class, ["f1", "f2"])
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))
    )
    out = saved(out, "jaccard")
    discard(of_doc, classes, links, labels, degree)
    return out
