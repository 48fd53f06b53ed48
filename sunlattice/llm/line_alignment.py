"""Line deduplication by pairwise alignment.

Runs of consecutive lines are hashed: from each line on, and up to each line, the
shortest run of `min_words` words or more (a line that long is a run by itself).
A rare run, one that at most `rare` different texts share, links every two of
them. A more common one links each text with the first that has it (the one with
the smallest doc_id), so it costs one link a text however many share it. Nothing
is lost by that: each line of a block that two texts share is in such a run of
it, and the first text with the run has the run too, so with `moved` a line stays
only if no earlier text has it in such a block. Blocks of short lines link as
well. The two documents of a link are aligned by patience
diff over their lines: lines that occur once in both anchor a longest common
order, blocks grow from the anchors over equal neighbours, and gaps are aligned
again. In a gap without such lines the k-th occurrences of a line in both are
the anchors, so a gap is left only when it has no common line. Aligned blocks
with `min_words` words or more are deleted from the later document. The first
holder of a line keeps it, so one copy of each remains.

Hot runs: a run that one in `HOT` of all rows or more has is sent to all
executors with its first text (there are at most `HOT` such), all others are
joined by run. A text that is the first of very many is repeated as often as it
takes to spread those over tasks.

An alignment keeps one order and uses each line once. With `moved`, what it
leaves is aligned with the whole first holder again, as often as it takes (see
`again`): every block of `min_words` words or more that stands anywhere in it is
deleted, moved or repeated as often as it may be.

Texts equal as a whole are one text in this: the smallest id keeps it, the
others lose all their lines.

Null and empty texts have no lines and stay as they are. Ties of ids: rows that
repeat both id and text count as one document and all keep the text; of
different texts with one id the one with the smaller hash is the earlier. A null
id comes last. Very long texts are aligned whole, in a time that grows with their
lines. Other columns are ignored, whatever their names. Empty tables give empty
results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.common import SPACED, Words, buffers, discard, mix, saved, signed, slices

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_RUN = np.uint64(0xC2B2AE3D27D4EB4F)
#: Runs that so large a part of all rows has are broadcast.
HOT = 4096
#: Partners of one text that meet it in one task.
PARTNERS = 512


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lines (hashes of the lines with a word, edge blanks aside), words (of each), at (number of each line)."""

    def run(batches):
        for batch in batches:
            hashes, words, at, counts = [], [], [], []
            for _, _, data, off in slices(batch.column(1)):
                w = Words(data, off, SPACED)
                lines = Words(data, off, _LINE)
                s, e = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
                some = e > s
                row = lines.row_of_word()[some]
                breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
                number = breaks[lines.starts[some]] - breaks[off[row]]
                # From the first word to the last: blanks at the edges don't count.
                lines.starts, lines.ends = w.starts[s[some]], w.ends[e[some] - 1]
                hashes.append(lines.hashes())
                words.append((e - s)[some])
                at.append(number)
                counts.append(np.bincount(row, minlength=len(off) - 1))
            hashes, words, at, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, words, at, counts))
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (signed(hashes), words.astype(np.int32), at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["doc_id", "text_key", "lines", "words", "at"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("text_key")).filter("text is not null")
    return rows.mapInArrow(run, "doc_id long, text_key string, lines array<long>, words array<int>, at array<int>")


def runs_of(texts: DataFrame, min_words: int) -> DataFrame:
    """tid, rep, key and line: a row for each different run of lines (tid, rep, key, lines, words) of `min_words` words that is no longer than it must be."""

    def run(batches):
        for batch in batches:
            lines, words = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            counts = batch.column(3).value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
            at = np.arange(len(lines))
            # The shortest run from each line on and up to each line, as far as its text has one.
            end = np.searchsorted(total, total[:-1] + min_words)
            start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            on, up = end <= (first + counts)[row], start >= first[row]
            start, end, row = np.concatenate([at[on], start[up]]), np.concatenate([end[on], at[up] + 1]), np.concatenate([row[on], row[up]])
            bits = lines.view(np.uint64)
            h = bits[start]
            k, more = 1, np.flatnonzero(end - start > 1)
            while len(more):
                h[more] = mix(h[more] * _RUN + bits[start[more] + k])
                k += 1
                more = more[(end - start)[more] > k]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            where = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in range(3)), pa.array(signed(h[new]))], ["tid", "rep", "key", "line"])

    return texts.select("tid", "rep", F.xxhash64("text_key").alias("key"), "lines", "words").mapInArrow(run, "tid long, rep long, key long, line long")


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of a patience diff, in order; no gap between them has a common line."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        anchors = _anchors(a, a0, a1, b, b0, b1)
        if not anchors:
            continue
        pa_, pb = a0, b0
        for i, j in anchors:
            if i < pa_ or j < pb:
                continue
            s = 0
            while i - s > pa_ and j - s > pb and a[i - s - 1] == b[j - s - 1]:
                s += 1
            e = 1
            while i + e < a1 and j + e < b1 and a[i + e] == b[j + e]:
                e += 1
            if i - s > pa_ and j - s > pb:
                todo.append((pa_, i - s, pb, j - s))
            out.append((i - s, j - s, s + e))
            pa_, pb = i + e, j + e
        if pa_ < a1 and pb < b1:
            todo.append((pa_, a1, pb, b1))
    return sorted(out)


def _anchors(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Lines that occur once in both parts, or else the k-th occurrences in both, in the longest order that both have."""
    once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
    pairs = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
    if not pairs:
        kth_a, kth_b = _kth(a, a0, a1), _kth(b, b0, b1)
        pairs = sorted((i, kth_b[x]) for x, i in kth_a.items() if x in kth_b)
    # Longest increasing run of places in b.
    ends: list[int] = []
    chain: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        ends[at : at + 1] = [j]
        chain[at : at + 1] = [k]
        back.append(chain[at - 1] if at else -1)
    out, k = [], chain[-1] if chain else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(x, lo, hi) -> dict[int, int]:
    out: dict[int, int] = {}
    for i in range(lo, hi):
        out[x[i]] = -1 if x[i] in out else i
    return {k: i for k, i in out.items() if i >= 0}


def _kth(x, lo, hi) -> dict[tuple[int, int], int]:
    seen: dict[int, int] = {}
    out = {}
    for i in range(lo, hi):
        k = seen[x[i]] = seen.get(x[i], -1) + 1
        out[x[i], k] = i
    return out


def again(head: list[int], lines: list[int], words: list[int], min_words: int, done: set[int]) -> list[int]:
    """Places of lines in blocks that an alignment has left (all but `done`): the rest is aligned with the whole head again.

    What is matched are the shortest blocks of `min_words` words or more, from each
    line on and up to each line: every longer block is made of those. The k-th
    time that one occurs here goes with the k-th in the head (from the first again
    after the last), and the pairs are dealt into chains that rise in both, each the
    order of one more alignment; a pair joins the chain whose end is nearest below.
    """
    total = [0, *accumulate(words)]
    left = {}
    for k in range(len(lines)):
        if k not in done:
            end = bisect_left(total, total[k] + min_words)
            start = bisect_right(total, total[k + 1] - min_words) - 1
            for s, e in ((k, end), (start, k + 1)):
                if s >= 0 and e < len(total):
                    left[s, e] = tuple(lines[s:e])
    places: dict[tuple, list[int]] = {x: [] for x in left.values()}
    for n in {len(x) for x in places}:
        for i in range(len(head) - n + 1):
            x = tuple(head[i : i + n])
            if x in places:
                places[x].append(i)
    ends: list[int] = []
    chains: list[list[tuple[int, int]]] = []
    times: Counter = Counter()
    for s, e in sorted(left):
        own = places[left[s, e]]
        if own:
            i = own[times[left[s, e]] % len(own)]
            times[left[s, e]] += 1
            at = bisect_left(ends, i) - 1
            if at < 0:
                ends.insert(0, i)
                chains.insert(0, [(s, e)])
            else:
                ends[at] = i
                chains[at].append((s, e))
    return sorted({k for chain in chains for s, e in chain for k in range(s, e)})


def _links(each: DataFrame, rare: int) -> DataFrame:
    """tid, head: texts to align, of rows (line, text: rep, key, tid)."""
    counts = saved(each.groupBy("line").agg(F.min("text").alias("first"), F.count("*").alias("n")).filter("n > 1"), "line-runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = counts.filter(F.col("n") <= rare).select("line")
    # At most `rare` texts a run: each with all before it.
    holders = each.join(few, "line").groupBy("line").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    later = holders.select("texts", F.posexplode("texts").alias("place", "text")).select(F.col("text.tid").alias("tid"), F.explode(F.slice("texts", F.lit(1), F.col("place"))).alias("before"))
    pairs = later.select("tid", F.col("before.tid").alias("head"))
    many = counts.filter(F.col("n") > rare).select("line", F.col("first.tid").alias("head"), "n")
    hot = F.broadcast(many.filter(F.col("n") * HOT >= total).drop("n"))
    marked = each.select("line", F.col("text.tid").alias("tid")).join(hot, "line", "left")
    rest = marked.filter("head is null").drop("head").join(many.filter(F.col("n") * HOT < total).drop("n"), "line")
    common = marked.filter("head is not null").unionByName(rest).filter("tid <> head").select("tid", "head")
    out = saved(pairs.union(common).distinct(), "line-links")
    discard(counts)
    return out


def overlaps(docs: DataFrame, min_words: int = 8, moved: bool = False, rare: int = 4) -> tuple[DataFrame, DataFrame]:
    """Lines of each different text, and for later texts the places of their lines to delete with the partners."""
    rows = saved(lines_of(docs), "lines")
    last = F.lit(2**63 - 1)
    texts = rows.groupBy("text_key").agg(F.min(F.coalesce("doc_id", last)).alias("rep"), F.first("lines").alias("lines"), F.first("words").alias("words"), F.first("at").alias("at"))
    texts = saved(texts.withColumn("tid", F.monotonically_increasing_id()), "line-texts")
    each = saved(runs_of(texts, min_words).select(F.struct("rep", "key", "tid").alias("text"), "line"), "line-each")
    pairs = _links(each, rare)
    # One text for each so many of its partners.
    spread = pairs.groupBy("head").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    other = texts.select(F.col("tid").alias("head"), F.col("rep").alias("head_id"), F.col("lines").alias("head_lines")).join(spread, "head")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    one = pairs.join(spread, "head").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int")).drop("parts")
    one = one.join(texts.select("tid", "lines", "words", "at"), "tid")
    both = one.join(other, ["head", "part"]).select("tid", "head_id", "lines", "words", "at", "head_lines")

    def cut(batches):
        for batch in batches:
            gone = []
            for lines, words, at, head in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                places = [k for _, s, n in align(head, lines) if sum(words[s : s + n]) >= min_words for k in range(s, s + n)]
                if moved and len(places) < len(lines):
                    places = sorted({*places, *again(head, lines, words, min_words, set(places))})
                gone.append([at[k] for k in places])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["tid", "head_id", "gone"])

    found = both.mapInArrow(cut, "tid long, head_id long, gone array<int>").filter(F.size("gone") > 0)
    per_text = found.groupBy("tid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.sort_array(F.collect_set("head_id")).alias("partners"))
    gone = saved(texts.select("text_key", "rep", "tid").join(per_text, "tid", "left").drop("tid"), "line-gone")
    discard(texts, each, pairs)
    return rows, gone


def dedupe(docs: DataFrame, min_words: int = 8, moved: bool = False, rare: int = 4) -> DataFrame:
    """doc_id, text without its deleted lines (null if nothing is left), n_lines, n_removed, partners of each row of docs (doc_id, text)."""
    lines, gone = overlaps(docs, min_words, moved, rare)
    discard(lines)
    last = F.lit(2**63 - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("text_key"))
    # Texts whose lines stay, and copies of a text, need no list of lines: only the rest goes by its key.
    joined = rows.join(gone, "text_key", "left")
    copy = F.col("rep").isNotNull() & (F.coalesce("doc_id", last) != F.col("rep"))
    full = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")) > 0))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(full).cast("long")
    wide = joined.select("doc_id", "text", n_lines.alias("n_lines"), copy.alias("copy"), "rep", "gone", "partners")
    cleaned = wide.mapInArrow(_cleaned, "doc_id long, text string, n_lines long, copy boolean, rep long, n_gone long, partners array<long>")
    copied = F.col("copy") & (F.col("n_lines") > 0)
    return cleaned.select(
        "doc_id",
        F.when(~copied, F.col("text")).alias("text"),
        "n_lines",
        F.when(copied, F.col("n_lines")).otherwise(F.col("n_gone")).alias("n_removed"),
        F.when(copied, F.array("rep")).otherwise(F.coalesce("partners", F.array().cast("array<long>"))).alias("partners"),
    )


def _cleaned(batches):
    """Rows with their text without the lines listed in `gone`, which are in order."""
    for batch in batches:
        n_gone = batch.column(5).value_lengths().fill_null(0).cast(pa.int64()) if len(batch) else pa.array([], pa.int64())
        changed = np.flatnonzero(n_gone.to_numpy(zero_copy_only=False) > 0)
        text = batch.column(1)
        if len(changed):
            data, off = buffers(text)
            parts, at = [], 0
            for d in changed.tolist():
                own = data[off[d] : off[d + 1]]
                ends = np.concatenate([[-1], np.flatnonzero(own == 0x0A), [len(own)]])
                keep = np.ones(len(ends) - 1, bool)
                keep[batch.column(5)[d].values.to_numpy()] = False
                kept = b"\n".join(own[s + 1 : e].tobytes() for s, e in zip(ends[:-1][keep], ends[1:][keep]))
                parts += [text.slice(at, d - at), pa.array([kept.decode()], text.type)]
                at = d + 1
            text = pa.concat_arrays([*parts, text.slice(at)])
        yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(2), batch.column(3), batch.column(4), n_gone, batch.column(6)], ["doc_id", "text", "n_lines", "copy", "rep", "n_gone", "partners"])


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, partners, kept_crc32 (of the text that is left; null: nothing is)."""
    return deduped.select("doc_id", "n_lines", "n_removed", "partners", F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))
