"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

A rule is a metric of the text and a direction. Labelled documents are dealt into a tuning part and a holdout, equal
texts into the same. In each stratum (language) the tuning part gives every rule a grid of cutoffs and orders all
steps along all grids into one path: each step moves one rule's cutoff on and so rejects more, those that reject most
bad documents for a good one come first, and steps that do not reject clearly more bad than good ones (three standard
deviations) are left out. The path
depends on nothing in the holdout. Along it the holdout tests the documents rejected by all rules together: a state of
the path is certified if the exact (Clopper-Pearson) upper bound on its rate of rejected good documents is at most
ALPHA. The tests of a path are a fixed sequence that stops at the first failure, so only strata need a correction
(Bonferroni).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .store import written

#: Most good documents that all rules may reject of a stratum together, and the chance of a wrong guarantee.
ALPHA, DELTA = 0.02, 0.05
#: One labelled document in so many is for tuning; the others certify.
TUNING = 4
#: Cutoffs of each rule: quantiles of the stratum's tuning documents, counted from the rejected end.
GRID = (0.001, 0.002, 0.005, *(i / 100 for i in range(1, 31)))
#: Metric and the side that is rejected.
RULES = (("symbol_rate", "high"), ("repeat_rate", "high"), ("dup_line_rate", "high"), ("upper_rate", "high"), ("digit_rate", "high"), ("mean_word", "high"), ("mean_word", "low"))

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ALPHA = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RATES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "digit_rate", "mean_word")


def _line_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: lines with a word, and those equal to an earlier one."""
    is_break = np.zeros(256, bool)
    is_break[10] = True
    h, s, e, first = K.words(data, offs, is_break, K.SAME)  # the non-empty lines as "words"
    ink = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
    real = ink[e] > ink[s]
    row = K.rows_of(first)[real]
    h = h[real]
    n = len(offs) - 1
    total = np.bincount(row, minlength=n)
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    again = np.concatenate([[False], (r[1:] == r[:-1]) & (v[1:] == v[:-1])]) if len(v) else np.zeros(0, bool)
    return total, np.bincount(r[again], minlength=n)


def _repeat_words(h: np.ndarray, first: np.ndarray, k: int = 5) -> np.ndarray:
    """Of each row: words in k-word windows that the row has twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    sh, begin = K.shingles(h, first, k)
    for i in np.flatnonzero(np.diff(first) > k):
        w = sh[begin[i] : begin[i + 1]]
        order = np.argsort(w, kind="stable")
        v = w[order]
        same = v[1:] == v[:-1]
        if same.any():
            hit = np.zeros(len(w), bool)
            hit[order[:-1][same]] = True
            hit[order[1:][same]] = True
            cover = np.zeros(len(w) + k, np.int64)
            at = np.flatnonzero(hit)
            cover[at] += 1
            cover[at + k] -= 1
            out[i] = np.count_nonzero(np.cumsum(cover) > 0)
    return out


def _metrics(batches):
    for batch in batches:
        for a, b, data, offs in K.strings(batch.column(0)):
            h, _, _, first = K.words(data, offs, K.SPACE, K.SAME)
            n = np.diff(first)

            def count(mask, data=data, offs=offs):
                c = np.concatenate([[0], np.cumsum(mask[data])])
                return c[offs[1:]] - c[offs[:-1]]

            chars, symbols, letters = count(_LEAD & ~K.SPACE), count(_SYMBOL), count(_ALPHA)
            lines, dups = _line_counts(data, offs)
            repeats = _repeat_words(h, first)
            some, ink, lines1 = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
            rates = [symbols / ink, repeats / some, dups / lines1, count(_UPPER) / np.maximum(letters, 1), count(_DIGIT) / ink, chars / some]
            cols = [pa.array(x.astype(np.int64)) for x in (n, chars, symbols, dups, repeats)] + [pa.array(x.astype(float)) for x in rates]
            yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]] + cols, [*batch.schema.names[1:], *_NAMES, *_RATES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    return src.mapInArrow(_metrics, ", ".join(["doc_id long, stratum string, text_hash long", *(f"{x} long" for x in _NAMES), *(f"{x} double" for x in _RATES)]))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper bound: the rate at which k or fewer of n have probability delta."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or tail(mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def least_good(alpha: float = ALPHA, delta: float = DELTA, strata: int = 1) -> int:
    """Good holdout documents that a stratum needs before any cutoff can be certified."""
    return math.ceil(math.log(delta / max(1, strata)) / math.log1p(-alpha))


def path_of(steps: dict[tuple[str, str], list[tuple[float, int, int]]]) -> list[tuple[str, str, float]]:
    """(metric, side, cutoff) in the order of testing, from (cutoff, good rejected, bad rejected) of each rule, mildest first."""
    path, at = [], dict.fromkeys(steps, (-1, 0, 0))
    while True:
        best = None
        for rule, grid in sorted(steps.items()):
            i, good, bad = at[rule]
            for j in range(i + 1, len(grid)):
                lost, won = grid[j][1] - good, grid[j][2] - bad
                if won - lost >= 3 * math.sqrt(won + lost) > 0 and (best is None or won / (lost + 1) > best[0]):
                    best = (won / (lost + 1), rule, j)
        if best is None:
            return path
        _, rule, j = best
        at[rule] = (j, *steps[rule][j][1:])
        path.append((*rule, float(steps[rule][j][0])))


def _last_certified(first: dict[int, int], n_good: int, length: int, alpha: float, delta: float) -> int:
    """Certified steps of a path of so many, `first` counting good holdout documents by the step that rejects them first."""
    gone = 0
    for k in range(length):
        gone += first.get(k, 0)
        if gone > alpha * n_good or binomial_upper(gone, n_good, delta) > alpha:
            return k
    return length


def _final(path: list[tuple[str, str, float]], steps: int) -> list[tuple[str, str, float]]:
    """The last cutoff of each rule among the first steps of a path."""
    return [(*rule, cut) for rule, cut in sorted({(m, side): cut for m, side, cut in path[:steps]}.items())]


def certified_cutoffs(labelled: list[tuple], alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[str, str, str, float]]:
    """(stratum, metric, side, cutoff) from rows (stratum, tuning, good, *rates). A stratum with too few good documents gets none."""
    found, least = [], least_good(alpha, delta)
    n_good = {}
    for r in labelled:
        if r[0] is not None and not r[1] and r[2]:
            n_good[r[0]] = n_good.get(r[0], 0) + 1
    strata = sorted(st for st, n in n_good.items() if n >= least)
    for st in strata:
        tune = [r for r in labelled if r[0] == st and r[1]]
        if not tune:
            continue
        good, steps = np.array([bool(r[2]) for r in tune]), {}
        for metric, side in RULES:
            v = np.array([r[3 + _RATES.index(metric)] for r in tune])
            sign = 1 if side == "high" else -1
            steps[metric, side] = []
            for q in GRID:
                cut = sign * np.quantile(sign * v, 1 - q, method="higher")
                gone = sign * v > sign * cut
                steps[metric, side].append((cut, int((gone & good).sum()), int((gone & ~good).sum())))
        path, first = path_of(steps), {}
        for r in labelled:
            if r[0] == st and not r[1] and r[2]:
                hit = [k for k, (m, side, cut) in enumerate(path) if (r[3 + _RATES.index(m)] > cut if side == "high" else r[3 + _RATES.index(m)] < cut)]
                if hit:
                    first[hit[0]] = first.get(hit[0], 0) + 1
        found += [(st, *c) for c in _final(path, _last_certified(first, n_good[st], len(path), alpha, delta / len(strata)))]
    return found


def _grid_steps(rows: DataFrame) -> dict[str, dict[tuple[str, str], list[tuple[float, int, int]]]]:
    """For each stratum the steps of each rule, from a table (stratum, good, rates) of any size.

    Values are counted and dealt out in order; sums of the parts before give every value its rank, and only the
    values at the grid's ranks, with the good and all documents below them, come to the driver.
    """
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in _RATES])).alias("x")
    counts = rows.select("stratum", "good", long).groupBy("stratum", "x.metric", "x.v").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    counts = written(counts.repartitionByRange("stratum", "metric", "v").withColumn("part", F.spark_partition_id()), "values")
    parts = counts.groupBy("stratum", "metric", "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    total, before = {}, []
    for st, metric, part, n, good in sorted(parts):
        have = total.setdefault((st, metric), (0, 0))
        before.append((st, metric, part, *have))
        total[st, metric] = (have[0] + n, have[1] + good)
    if not total:
        return {}
    wanted = {}
    for (st, metric), (n, _) in total.items():
        for m, side in RULES:
            if m == metric:
                ranks = [math.ceil((n - 1) * (1 - q)) for q in GRID]
                wanted[st, metric, side] = ranks if side == "high" else [n - 1 - i for i in ranks]
    spark = rows.sparkSession
    offsets = spark.createDataFrame(before, "stratum string, metric string, part int, n0 long, good0 long")
    ranks = spark.createDataFrame(sorted({(st, m, i) for (st, m, _), r in wanted.items() for i in r}), "stratum string, metric string, i long")
    upto = Window.partitionBy("stratum", "metric", "part").orderBy("v")
    at = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("good_upto", F.sum("good").over(upto)).join(_small(offsets, len(before)), ["stratum", "metric", "part"])
    at = at.select("stratum", "metric", "v", "n", "good", (F.col("n0") + F.col("upto")).alias("upto"), (F.col("good0") + F.col("good_upto")).alias("good_upto"))
    at = at.join(_small(ranks, len(total) * 2 * len(GRID)), ["stratum", "metric"]).where("i < upto AND i >= upto - n")
    value = {(r.stratum, r.metric, r.i): r for r in at.collect()}
    out: dict = {}
    for (st, metric, side), places in wanted.items():
        n, n_good = total[st, metric]
        steps = out.setdefault(st, {}).setdefault((metric, side), [])
        for i in places:
            r = value[st, metric, i]
            gone, good = (n - r.upto, n_good - r.good_upto) if side == "high" else (r.upto - r.n, r.good_upto - r.good)
            steps.append((r.v, good, gone - good))
    return out


def _tabled(spark, lists: dict[str, list[tuple[str, str, float]]]) -> DataFrame:
    """(stratum, cuts): the cutoffs of each stratum as an array of (metric's place, sign, cutoff)."""
    rows = [(st, [(_RATES.index(m) + 1, 1.0 if side == "high" else -1.0, float(cut)) for m, side, cut in cuts]) for st, cuts in sorted(lists.items())]
    return spark.createDataFrame(rows, "stratum string, cuts array<struct<m: int, sign: double, cut: double>>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if its rows, which the driver has counted, are few."""
    return F.broadcast(df) if rows <= 20_000 else df


_OVER = f"c -> c.sign * element_at(array({', '.join(_RATES)}), c.m) > c.sign * c.cut"


def cutoffs_of(sample: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[str, str, str, float]]:
    """`certified_cutoffs` of a table (stratum, tuning, q, rates), whatever its size.

    The driver holds, for each stratum that has enough good documents, the steps of the grids, the path and one count
    for each step of it.
    """
    rows = sample.where("stratum IS NOT NULL").select("stratum", "tuning", F.when(F.col("q") != 0, 1).otherwise(0).alias("good"), *_RATES)
    sized = rows.where("NOT tuning AND good = 1").groupBy("stratum").count().where(F.col("count") >= least_good(alpha, delta))
    n_good = {r.stratum: r["count"] for r in sized.collect()}
    if not n_good:
        return []
    spark = sample.sparkSession
    known = spark.createDataFrame([(st,) for st in sorted(n_good)], "stratum string")
    paths = {st: path_of(steps) for st, steps in _grid_steps(rows.where("tuning").join(_small(known, len(n_good)), "stratum", "left_semi")).items()}
    if not paths:
        return []
    hits = rows.where("NOT tuning AND good = 1").join(_small(_tabled(spark, paths), len(paths)), "stratum")
    hits = hits.select("stratum", F.expr(f"array_position(transform(cuts, {_OVER}), true)").alias("first")).where("first > 0").groupBy("stratum", "first").count().collect()
    first: dict = {}
    for r in hits:
        first.setdefault(r.stratum, {})[int(r.first) - 1] = r["count"]
    return [(st, *c) for st, path in sorted(paths.items()) for c in _final(path, _last_certified(first.get(st, {}), n_good[st], len(path), alpha, delta / len(n_good)))]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """One row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, the rates, n_cutoffs.

    base_failed: fewer than 10 words, or over 20% of words in repeated 5-word windows. kept: neither that nor
    rejected by a certified cutoff of its stratum; n_cutoffs: the cutoffs certified for it. A null text has no
    words. A null or unknown stratum has no cutoffs. Without labels nothing is certified and base_failed alone
    decides. Labels that repeat for an id count once, as good if any says so. Repeated rows stay repeated; other
    columns are not read; an empty table gives no rows.
    """
    all_docs = written(measured(docs, id_col, text_col, stratum_col), "measured")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("q")).where("q IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("q").alias("q"))
    part = (F.pmod("text_hash", F.lit(TUNING)) == 0).alias("tuning")
    cuts = cutoffs_of(all_docs.where("n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words").join(known, "doc_id").select("stratum", part, "q", *_RATES))
    lists: dict = {}
    for st, *cut in cuts:
        lists.setdefault(st, []).append(tuple(cut))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = all_docs.withColumn("base_failed", failed).join(_small(_tabled(docs.sparkSession, lists), len(lists)), "stratum", "left")
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.expr(f"exists(cuts, {_OVER})"), F.lit(False)))
    return out.select("doc_id", *_NAMES, "base_failed", "kept", "stratum", *_RATES, F.coalesce(F.array_size("cuts"), F.lit(0)).cast("long").alias("n_cutoffs"))
