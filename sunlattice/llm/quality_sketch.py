"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets base counts (words, their code points, symbols, repeated lines,
words in repeated three-word windows). Documents that pass the base rules feed
quantile sketches of four ratios per language and source. A sketch is a
histogram over logarithmic buckets (each `gamma` times the last), so a quantile
is off by (gamma - 1) / 2 at most, merging is adding counts, and the result
depends neither on the order of rows nor on which executor made which part. The
sketches of a source merge into those of the language, and these into one of all,
in one aggregate over grouping sets.

The cutoffs of a language and source come from tail quantiles of its own sketch:
those of `tail` and 1 - `tail`, the median and the mean, each drawn towards that of
its language, and this towards that of all, as if the parent stood for `prior`
documents. A cutoff lies beyond the tail quantile by `reach` times the distance
from the median to it, or the mean where that is more, as it is for ratios that
most documents have none of. A document is dropped when a ratio of its own is surely
beyond a cutoff: shares of events are compared after taking `slack` standard
errors (roots of the number of events) off, so few events in a short text decide
nothing. No cutoff is fixed beforehand.

Null and empty texts have zero counts and fail the base rules. A null lang or
source is a group of its own. Repeated rows each count and each get a row; very
long texts are counted whole. Ids and all other columns are passed by. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.llm.common import SPACED, Words, mix, saved, shingles, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Ratio: its parts, whether low values are odd too, and whether the first part counts events.
RATIOS = {
    "word_length": ("word_chars", "n_words", True, False),
    "symbol_share": ("n_symbols", "n_words", False, True),
    "dup_line_share": ("n_dup_lines", "greatest(n_lines, 1)", False, True),
    "repeat_share": ("n_repeat_words", "n_words", False, True),
}


def _row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def _counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    rows = len(off) - 1
    words = Words(data, off, SPACED)
    chars = _row_sums(SPACED[data] & ((data & 0xC0) != 0x80), off)
    symbols = _row_sums(_SYMBOL[data], off)

    lines = Words(data, off, _LINE)
    row = lines.row_of_word()
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    n_lines = np.bincount(row[full], minlength=rows)
    salted = mix(lines.hashes()[full] ^ mix(row[full].astype(np.uint64)))
    once = np.unique(salted, return_index=True)[1]
    repeated = n_lines - np.bincount(row[full][once], minlength=rows)

    h, _ = shingles(words.hashes(), words.first)
    of = words.row_of_word()
    at = np.flatnonzero(np.arange(len(h)) + 2 < np.repeat(words.first[1:], np.diff(words.first)))
    salted = mix(h[at] ^ mix(of[at].astype(np.uint64)))
    order = np.argsort(salted)
    same = np.zeros(len(at), bool)
    twin = salted[order][1:] == salted[order][:-1]
    same[order[1:][twin]] = True
    same[order[:-1][twin]] = True
    in_twin = np.zeros(len(h), bool)
    for k in range(3):
        in_twin[at[same] + k] = True
    return [np.diff(words.first), chars, symbols, n_lines, repeated, _row_sums(in_twin, words.first)]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row of docs (doc_id, text, lang, source)."""
    kept = [F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    rows = docs.select(*kept, "text")

    def run(batches):
        for batch in batches:
            parts = [_counts(data, off) for _, _, data, off in slices(batch.column(3))]
            counts = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in counts)], ["doc_id", "lang", "source", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(measured: DataFrame, gamma: float = 1.02) -> DataFrame:
    """lang, source, ratio, bucket, n: quantile sketches of the rows; bucket null stands for zero."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.expr(f"{x} / {of}").cast("double").alias("x")) for k, (x, of, _, _) in RATIOS.items()]))
    long = measured.filter("n_words > 0").select("lang", "source", each.alias("r")).select("lang", "source", "r.ratio", "r.x")
    bucket = F.when(F.col("x") > 1e-9, F.ceil(F.log("x") / float(np.log(gamma))).cast("int"))
    return long.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float], gamma: float = 1.02) -> DataFrame:
    """keys, ratio, n, mean, and a column for each wanted quantile."""
    group = Window.partitionBy(*keys, "ratio")
    run = sketches.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * (2 / (1 + gamma)))
    # The least bucket that the quantile's rank falls in; values grow with the bucket.
    return run.groupBy(*keys, "ratio").agg(F.max("total").alias("n"), (F.sum(value * F.col("n")) / F.max("total")).alias("mean"), *[F.min(F.when(F.col("upto") >= q * F.col("total"), value)).alias(k) for k, q in wanted.items()])


def thresholds(sketches: DataFrame, tail: float = 0.05, reach: float = 2.0, prior: int = 400, gamma: float = 1.02) -> DataFrame:
    """lang, source and the cutoffs low_<ratio>, high_<ratio> that hold for the group."""
    names = ["lang", "source", "ratio", "bucket"]
    sets = sketches.groupingSets([names, ["lang", "ratio", "bucket"], ["ratio", "bucket"]], *names)
    merged = sets.agg(F.sum("n").alias("n"), (F.grouping("lang") + F.grouping("source")).cast("int").alias("level"))
    wanted = {"low": tail, "mid": 0.5, "high": 1 - tail}
    q = quantiles(merged, ["level", "lang", "source"], wanted, gamma)
    own, mid, all_ = (q.filter(F.col("level") == k).select("lang", "source", "ratio", F.struct("n", "mean", *wanted).alias(f"q{k}")) for k in range(3))
    # A row a ratio; a row a language and ratio.
    of_lang = mid.join(F.broadcast(all_.select("ratio", "q2")), "ratio").select(F.col("lang").alias("l"), F.col("ratio").alias("r"), "q1", "q2")
    found = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r")))

    def drawn(k: str):
        parent = (F.col(f"q1.{k}") * F.col("q1.n") + F.col(f"q2.{k}") * prior) / (F.col("q1.n") + prior)
        return (F.col(f"q0.{k}") * F.col("q0.n") + parent * prior) / (F.col("q0.n") + prior)

    found = found.select("lang", "source", "ratio", *[drawn(k).alias(k) for k in ("mean", *wanted)])
    low, high = F.col("low") - reach * (F.col("mid") - F.col("low")), F.col("high") + reach * F.greatest(F.col("high") - F.col("mid"), F.when(F.col("ratio").isin(*(k for k, x in RATIOS.items() if x[3])), F.col("mean")))
    each = [F.max(F.when(F.col("ratio") == name, x)).alias(f"{side}_{name}") for name in RATIOS for side, x in (("low", low), ("high", high))]
    return found.groupBy("lang", "source").agg(*each)


def judge(docs: DataFrame, tail: float = 0.05, reach: float = 2.0, prior: int = 400, slack: float = 3.0, gamma: float = 1.02) -> DataFrame:
    """doc_id, lang, source, base counts, base_failed, kept of each row of docs."""
    measured = saved(measure(docs), "quality").withColumn("base_failed", base_failed())
    bounds = saved(thresholds(sketch(measured.filter("not base_failed"), gamma), tail, reach, prior, gamma), "quality-cutoffs")
    bounds = bounds.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    fine = ~F.col("base_failed")
    for name, (x, of, both, events) in RATIOS.items():
        count = F.expr(x).cast("double")
        least = count - slack * F.sqrt(count) if events else count
        fine = fine & F.coalesce(least <= F.col(f"high_{name}") * F.expr(of), F.lit(True))
        if both:
            fine = fine & F.coalesce(count >= F.col(f"low_{name}") * F.expr(of), F.lit(True))
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", fine.alias("kept"))
