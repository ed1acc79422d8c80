"""Statistics of pixel and value columns, whole and by group.

Whole-table order statistics are exact and distributed: a quantile summary brackets the rank within a guaranteed
error, the values below the bracket are counted, and the bracket is summarised again until it is small enough to
be read. Each round shrinks it about 2,500 times. Grouped ones use `percentile`, whose groups (tiles, sources) are
bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .graph import written

MAD_TO_RMS = 1.4826
#: Of the quantile summaries, and how many values may be read at the end.
ACCURACY, COLLECT = 10_000, 50_000


def moments(w="w") -> list[Column]:
    """n, mean, least, greatest and the sums of powers of deviations m2, m3, m4."""
    c = F.col(w) if isinstance(w, str) else w
    n = F.count(c)
    return [
        n.alias("n"), F.avg(c).alias("mean"), F.min(c).alias("w_min"), F.max(c).alias("w_max"), (F.var_pop(c) * n).alias("m2"),
        (F.skewness(c) * F.pow(F.var_pop(c), 1.5) * n).alias("m3"), ((F.kurtosis(c) + 3) * F.pow(F.var_pop(c), 2) * n).alias("m4"),
    ]


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row of moments from stored partial ones (n, mean, w_min, w_max, m2, m3, m4): sums about the common mean, so any number of parts merges in one aggregate."""
    total = parts.agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"))
    d = F.col("mean") - F.col("mu")
    p = parts.crossJoin(F.broadcast(total))
    return p.agg(
        F.first("n_all").alias("n"), F.first("mu").alias("mean"), F.min("w_min").alias("w_min"), F.max("w_max").alias("w_max"),
        F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + F.col("n") * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + F.col("n") * d * d * d * d).alias("m4"),
    )


def image_stats(w="w") -> list[Column]:
    """n, min, max, mean, its error, rms (n - 1), its error, skewness and kurtosis with errors."""
    c = F.col(w) if isinstance(w, str) else w
    n = F.count(c)
    m = n.cast("double")  # products of counts don't fit a long
    return [
        n.alias("n"), F.min(c).alias("w_min"), F.max(c).alias("w_max"), F.avg(c).alias("mean"), (F.stddev_samp(c) / F.sqrt(n)).alias("mean_err"), F.stddev_samp(c).alias("rms"),
        (F.stddev_samp(c) / F.sqrt(2 * (n - 1))).alias("rms_err"), F.skewness(c).alias("skewness"), F.sqrt(6 * m * (m - 1) / ((m - 2) * (m + 1) * (m + 3))).alias("skewness_err"), F.kurtosis(c).alias("kurtosis"),
    ]


def order_statistics(df: DataFrame, w: str, ranks: list[int], n: int) -> list[float]:
    """The values of these 0-based ranks of n values, exactly."""
    v = df.where(F.col(w).isNotNull() & ~F.isnan(w)).select(F.col(w).cast("double").alias("v"))
    out = []
    # (bounds, rank within them, number of values within them); None: no bounds yet.
    todo = {r: (None, r, n) for r in ranks}
    while todo:
        at = list(todo.items())
        within = lambda b: F.lit(True) if b is None else F.col("v").between(*b)
        picks = []
        for _, (b, r, m) in at:
            ps = [max(0.0, (r - 1) / m - 2 / ACCURACY), min(1.0, (r + 2) / m + 2 / ACCURACY)]
            picks.append(F.percentile_approx(F.when(within(b), F.col("v")), ps, ACCURACY))
        got = v.agg(F.struct(*[p.alias(f"q{i}") for i, p in enumerate(picks)]).alias("q")).collect()[0].q
        new = [(b, tuple(got[i])) for i, (_, (b, _, _)) in enumerate(at)]
        below = [F.count(F.when(within(b) & (F.col("v") < lo), 1)) for b, (lo, _) in new]
        inside = [F.count(F.when(F.col("v").between(lo, hi), 1)) for _, (lo, hi) in new]
        counts = v.agg(*[c.alias(f"c{i}") for i, c in enumerate(below + inside)]).collect()[0]
        small, after = [], {}
        for i, (key, (_, r, _)) in enumerate(at):
            (lo, hi), less, m = new[i][1], counts[i], counts[len(at) + i]
            if not less <= r < less + m:
                raise RuntimeError("a quantile summary missed its guarantee")
            if lo == hi:
                todo[key] = lo
            elif m <= COLLECT:
                small.append((key, lo, hi, r - less))
            else:
                after[key] = ((lo, hi), r - less, m)
        if small:
            near = F.lit(False)
            for _, lo, hi, _ in small:
                near = near | F.col("v").between(lo, hi)
            rows = sorted(x.v for x in v.where(near).collect())
            for key, lo, hi, r in small:
                todo[key] = [x for x in rows if lo <= x <= hi][r]
        out += [(k, x) for k, x in todo.items() if isinstance(x, float)]
        todo = after
    found = dict(out)
    return [found[r] for r in ranks]


def quantile(df: DataFrame, w: str, ps: list[float]) -> list[float]:
    """Exact quantiles, linear between ranks at p * (n - 1)."""
    n = df.where(F.col(w).isNotNull() & ~F.isnan(w)).count()
    if not n:
        return [float("nan")] * len(ps)
    need = sorted({r for p in ps for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))})
    at = dict(zip(need, order_statistics(df, w, need, n)))
    out = []
    for p in ps:
        f = p * (n - 1)
        lo, hi = at[int(f)], at[min(n - 1, int(f) + 1)]
        out.append(lo + (f - int(f)) * (hi - lo))
    return out


def median_mad(df: DataFrame, w: str = "w") -> tuple[float, float]:
    """Median and 1.4826 times the median absolute deviation of the whole table."""
    m = quantile(df, w, [0.5])[0]
    return m, MAD_TO_RMS * quantile(df.select(F.abs(F.col(w) - m).alias("d")), "d", [0.5])[0]


def grouped_median_mad(df: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """(keys, n, median, rms) by group, rms = 1.4826 MAD."""
    med = df.groupBy(*keys).agg(F.count(w).alias("n"), F.percentile(w, 0.5).alias("median"))
    dev = df.join(med, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("median").alias("median"), F.percentile(F.abs(F.col(w) - F.col("median")), 0.5).alias("mad"))
    return dev.select(*keys, "n", "median", (F.col("mad") * MAD_TO_RMS).alias("rms"))


def clipped(df: DataFrame, keys: list[str], w: str = "w", k: float = 3.0, rounds: int = 5, tol: float = 0.1) -> DataFrame:
    """(keys, n, mean, median, rms) after clipping |x - median| < k rms again and again.

    A group stops when its rms changes by at most `tol` of itself, or after `rounds`. The state is a small table
    of groups; the values are read once a round, and only the groups that still move take part. Groups are tiles or
    sources of bounded size; without keys the medians are those of `quantile`, so no task holds the table.
    """
    if not keys:
        return _clipped_whole(df, w, k, rounds, tol)
    stat = lambda d: d.groupBy(*keys).agg(F.count(w).alias("n"), F.avg(w).alias("mean"), F.percentile(w, 0.5).alias("median"), F.stddev_samp(w).alias("rms"))
    state = stat(df).withColumn("done", F.lit(False))
    for _ in range(rounds):
        s = state.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "median", "rms", "done")])
        inside = df.join(s.where("NOT _done"), keys).where(F.abs(F.col(w) - F.col("_median")) < k * F.col("_rms"))
        new = stat(inside)
        j = s.join(new, keys, "left")
        keep = F.col("n").isNull() | F.col("_done")
        still = ~keep & (F.abs(F.col("rms") - F.col("_rms")) / F.col("_rms") > tol)
        state = j.select(*keys, *[F.when(keep, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("n", "mean", "median", "rms")], (~F.coalesce(still, F.lit(False))).alias("done"))
        state = written(state, "clipped")
    return state.drop("done")


def _clipped_whole(df: DataFrame, w: str, k: float, rounds: int, tol: float) -> DataFrame:
    def stat(d):
        r = d.agg(F.count(w).alias("n"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("rms")).collect()[0]
        return (r.n, r["mean"], quantile(d, w, [0.5])[0] if r.n else None, r.rms)

    now = stat(df)
    for _ in range(rounds if now[0] else 0):
        new = stat(df.where(F.abs(F.col(w) - now[2]) < k * now[3])) if now[3] is not None else (0,)
        if not new[0]:
            break
        before, now = now, new
        if now[3] is None or not abs(now[3] - before[3]) / before[3] > tol:
            break
    return df.sparkSession.createDataFrame([now], "n long, mean double, median double, rms double")


def clipped_tiles(df: DataFrame, keys: list[str], w: str = "w", k: float = 3.0, rounds: int = 100, tol: float = 0.1) -> DataFrame:
    """What `clipped` gives, for groups of bounded size (tiles, sources): one shuffle, all rounds in memory."""
    schema = StructType([*[df.schema[c] for c in keys], StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("mean", "median", "rms")]])

    def one(pdf):
        import numpy as np
        import pandas as pd

        x = pdf[w].dropna().to_numpy(float)
        stat = lambda v: (len(v), v.mean(), float(np.median(v)), v.std(ddof=1) if len(v) > 1 else float("nan"))
        now = stat(x) if len(x) else (0, float("nan"), float("nan"), float("nan"))
        for _ in range(rounds):
            v = x[np.abs(x - now[2]) < k * now[3]]
            if not len(v):
                break
            before, now = now, stat(v)
            if not abs(now[3] - before[3]) / before[3] > tol:
                break
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in keys], *now]], columns=[*keys, "n", "mean", "median", "rms"])

    return df.select(*keys, w).groupBy(*keys).applyInPandas(one, schema)


def biweight(df: DataFrame, keys: list[str], w: str = "w", c: float = 6.0, rounds: int = 10, tol: float = 1e-4) -> DataFrame:
    """(keys, n, location, scale): Tukey's biweight from the median and MAD on, at most `rounds` steps.

    Groups are tiles or sources of bounded size. Without keys every step is one aggregate of the table.
    """
    if not keys:
        return _biweight_whole(df, w, c, rounds, tol)
    names = keys
    schema = StructType([*[df.schema[k] for k in names], StructField("n", LongType()), StructField("location", DoubleType()), StructField("scale", DoubleType())])

    def one(pdf):
        import numpy as np
        import pandas as pd

        x = pdf[w].to_numpy(float)
        loc = float(np.median(x))
        scale = MAD_TO_RMS * float(np.median(np.abs(x - loc)))
        for _ in range(rounds):
            if scale == 0:
                break
            u = (x - loc) / (c * scale)
            keep = u * u <= 1
            d, u2, g = x[keep] - loc, (u * u)[keep], (1 - u * u)[keep]
            new = loc + (d * g * g).sum() / (g * g).sum()
            den = abs((g * (1 - 5 * u2)).sum())
            after = float(np.sqrt(len(x) * (d * d * g**4).sum()) / den) if den > 1 else scale
            moved = abs(new - loc), abs(after - scale) / scale
            loc, scale = float(new), after
            if moved[1] <= tol and moved[0] <= tol * scale:
                break
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in names], len(x), loc, scale]], columns=[*names, "n", "location", "scale"])

    return df.groupBy(*names).applyInPandas(one, schema)


def _biweight_whole(df: DataFrame, w: str, c: float, rounds: int, tol: float) -> DataFrame:
    n = df.where(F.col(w).isNotNull()).count()
    loc, scale = median_mad(df, w)
    for _ in range(rounds if n else 0):
        if scale == 0:
            break
        d = F.col(w) - loc
        u2 = (d / (c * scale)) * (d / (c * scale))
        g = 1 - u2
        r = df.where(u2 <= 1).agg(F.sum(d * g * g).alias("a"), F.sum(g * g).alias("b"), F.sum(d * d * F.pow(g, 4)).alias("s"), F.sum(g * (1 - 5 * u2)).alias("den")).collect()[0]
        new, den = loc + r.a / r.b, abs(r.den)
        after = (n * r.s) ** 0.5 / den if den > 1 else scale
        moved = abs(new - loc), abs(after - scale) / scale
        loc, scale = new, after
        if moved[1] <= tol and moved[0] <= tol * scale:
            break
    return df.sparkSession.createDataFrame([(n, loc, scale)], "n long, location double, scale double")


def histogram(df: DataFrame, n: int, w: str = "w") -> DataFrame:
    """(b, centre, count) of n bins over [min, max], zeros left out; the greatest value overflows and isn't counted."""
    v = df.where((F.col(w) != 0) & ~F.isnan(w))
    r = v.agg(F.min(w).alias("lo"), F.max(w).alias("hi"))
    h = v.crossJoin(F.broadcast(r)).where(F.col(w) < F.col("hi")).groupBy(F.floor((F.col(w) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)).alias("b")).count()
    bins = df.sparkSession.range(n).select(F.col("id").alias("b")).crossJoin(F.broadcast(r))
    return bins.join(h, "b", "left").select("b", (F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / n).alias("centre"), F.coalesce("count", F.lit(0)).alias("count"))


def otsu(hist: DataFrame) -> DataFrame:
    """(threshold): centre of the first bin that separates the two classes best."""
    up, whole = Window.orderBy("b"), Window.partitionBy()
    h = hist.withColumn("wb", F.sum("count").over(up)).withColumn("sb", F.sum(F.col("count") * F.col("centre")).over(up)).withColumn("n", F.sum("count").over(whole)).withColumn("s", F.sum(F.col("count") * F.col("centre")).over(whole))
    wf = F.col("n") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    h = h.where((F.col("wb") > 0) & (wf > 0)).select("b", "centre", (F.col("wb") / F.col("n") * (wf / F.col("n")) * gap * gap).alias("between"))
    return h.orderBy(F.desc(F.round("between", 12)), "b").limit(1).select(F.col("centre").alias("threshold"))


def valley(hist: DataFrame, kernels=(3, 5, 7), smooth: bool = True) -> DataFrame:
    """(threshold): the first bin that is a valley of the histogram under every kernel.

    The histogram is smoothed by a running mean of 3 and turned over; a bin is a peak under kernel k if it equals
    the greatest value of bins -(k // 2) .. k // 2 - 1 around it.
    """
    h = hist.select("b", "centre", F.col("count").cast("double").alias("c"))
    if smooth:
        h = h.withColumn("c", F.avg("c").over(Window.orderBy("b").rowsBetween(-1, 1)))
    h = h.withColumn("v", -F.col("c"))
    n = h.count()
    for k in kernels:
        h = h.withColumn(f"d{k}", F.max("v").over(Window.orderBy("b").rowsBetween(-(k // 2), k // 2 - 1)))
    cond = " AND ".join(f"v = d{k}" for k in kernels)
    edge = max(kernels) // 2
    return h.where(cond).where((F.col("b") >= edge) & (F.col("b") < n - edge)).orderBy("b").limit(1).select(F.col("centre").alias("threshold"))


def optimal_threshold(df: DataFrame, factor: float, n: int, w: str = "w") -> DataFrame:
    """(threshold): the lesser of Otsu's and the valley threshold, but at least factor * median; a missing one counts as infinite."""
    h = histogram(df, n, w)
    both = otsu(h).agg(F.first("threshold").alias("o")).crossJoin(valley(h).agg(F.first("threshold").alias("v")))
    inf = F.lit(float("inf"))
    return both.select(F.greatest(F.least(F.coalesce("o", inf), F.coalesce("v", inf)), F.lit(factor * quantile(df, w, [0.5])[0])).alias("threshold"))


def cumulative_threshold(df: DataFrame, fraction: float, w: str = "w") -> DataFrame:
    """(threshold): the least value at which the running sum of the sorted positive values reaches a fraction of their sum; null without positive values.

    The running sum is taken over 4,096 equal ranges of values, then inside the one that crosses, and so on until
    that holds few distinct values; so a heavy tail costs rounds, not memory.
    """
    v = df.where((F.col(w) > 0) & ~F.isnan(w)).select(F.col(w).cast("double").alias("v"))
    lo, hi, total = v.agg(F.min("v"), F.max("v"), F.sum("v")).collect()[0]
    out = lambda x: df.sparkSession.createDataFrame([(x,)], "threshold double")
    if total is None:
        return out(None)
    goal, before = fraction * total * (1 - 1e-12), 0.0
    while True:
        b = F.least(F.lit(4095), F.floor((F.col("v") - lo) / (hi - lo) * 4096)) if hi > lo else F.lit(0)
        inside = v.where(F.col("v").between(lo, hi))
        parts = sorted(inside.groupBy(b.alias("b")).agg(F.sum("v"), F.min("v"), F.max("v"), F.approx_count_distinct("v")).collect())
        for _, s, least, most, values in parts:
            if before + s >= goal:
                break
            before += s
        if least == most:
            return out(least)
        if values <= COLLECT // 2 or (least, most) == (lo, hi):
            for x, s in sorted(v.where(F.col("v").between(least, most)).groupBy("v").agg(F.sum("v")).collect()):
                before += s
                if before >= goal:
                    break
            return out(x)
        lo, hi = least, most


def pagerank(edges: DataFrame, d: float = 0.85, tol: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(id, rank) by power iteration on weighted edges (src, dst, weight), column-stochastic weights expected.

    Ranks have unit length. Raises if it doesn't converge within `rounds`.
    """
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(n**-0.5))
    for _ in range(rounds):
        base = rank.crossJoin(F.broadcast(rank.agg(((1 - d) / n * F.sum("rank")).alias("tele"))))
        flow = edges.join(rank, edges.src == rank.id).groupBy("dst").agg(F.sum(F.col("weight") * F.col("rank")).alias("f"))
        new = base.join(flow, base.id == flow.dst, "left").select("id", F.col("rank").alias("old"), (F.coalesce(F.col("f"), F.lit(0.0)) * d + F.col("tele")).alias("r"))
        norm = new.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
        new = written(new.crossJoin(F.broadcast(norm)).select("id", "old", (F.col("r") / F.col("norm")).alias("rank")), "rank")
        moved = new.agg(F.sqrt(F.sum(F.pow(F.col("rank") - F.col("old"), 2)))).collect()[0][0]
        rank = new.select("id", "rank")
        if moved < tol:
            return rank
    raise RuntimeError("PageRank did not converge")


def nearest_mean(queries: DataFrame, rows: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(id, d): mean distance of each query (id, e) to its k nearest rows (id, e) of another id; e are arrays of doubles of one length.

    Exact. Queries go through all rows in blocks of about `block`; a partition keeps k rows for each query.
    """
    n = queries.count()
    found = None
    for i in range(-(-n // block)):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == i).select("id", "e").collect()
        if not part:
            continue
        near = rows.select("id", "e").mapInArrow(_nearest_rows([r.id for r in part], [list(r.e) for r in part], k), "id long, d double, o long")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return queries.select("id", F.lit(None).cast("double").alias("d"))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "o"))), 1, k).alias("near"))
    return best.select("id", (F.aggregate("near", F.lit(0.0), lambda a, x: a + x["d"]) / F.size("near")).alias("d"))


def _nearest_rows(ids: list[int], points: list[list[float]], k: int):
    def f(batches):
        import numpy as np
        import pyarrow as pa

        q, mine = np.array(points, float), np.array(ids, np.int64)
        best_d, best_o = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += 256
                other = part.column(0).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(other), -1)
                d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
                d[mine[:, None] == other[None, :]] = np.inf
                all_d = np.concatenate([best_d, d], axis=1)
                all_o = np.concatenate([best_o, np.broadcast_to(other, d.shape)], axis=1)
                order = np.lexsort((all_o, all_d), axis=1)[:, :k]
                best_d, best_o = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_o, order, 1)
        ok = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, k)[ok.ravel()]), pa.array(best_d[ok]), pa.array(best_o[ok])], ["id", "d", "o"])

    return f
