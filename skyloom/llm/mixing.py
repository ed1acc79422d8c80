"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

The dual. Document i of source k gets the rate exp(l_k) for each of its words, the tilt that is closest to rate
1 in relative entropy under "the words taken from source k are its target". The dual is
sum_k S_k exp(l_k) - l_k t_k with S_k the source's words: S_k is the one statistic of the documents that gradient
and Hessian need, so it is summed once, distributed, and every Newton step then works on the table of sources.

Rounding. A document gets floor(rate) copies, and some get one more. Which: those whose hash is under the source's
threshold, found on 3 levels of 256 hash ranges, and then a small pool of documents of every size class, dealt by
falling size, closes the rest of the gap. The threshold and the pool are small tables, so applying the plan
needs no shuffle of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
LEVELS = 3
NEWTON_STEPS = 60


@dataclass
class MixPlan:
    """sources: source, source_size, target, rate, base, threshold. pool: source, h, picked."""

    sources: DataFrame
    pool: DataFrame


def n_words(text):
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text column; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `_size` (words) and `_h` (60 bits that depend on the row's id and text only)."""
    text = F.col(text_col)
    h = F.expr(f"xxhash64({id_col}, coalesce({text_col}, '')) & 1152921504606846975")
    return docs.withColumn("_size", n_words(text)).withColumn("_h", h)


def _targets(sums: DataFrame) -> DataFrame:
    """Adds target, rate, base and extra to (source, source_size). Sources are few enough for one task."""
    n = len(WEIGHTS)
    by_rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (by_rank % n + 1).cast("int"))
    s = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    # Sources by ratio: once those of least ratio are full, the others share what is left by weight.
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    over = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / over)
    level = F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "level"))).over(whole)["level"]
    s = s.withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
    newton = f"""aggregate(sequence(1, {NEWTON_STEPS}), 0.0D,
      (l, i) -> l - greatest(-1.0D, least(1.0D, (source_size * exp(l) - target) / (source_size * exp(l)))))"""
    s = s.withColumn("rate", F.when((F.col("target") <= 0) | (F.col("source_size") == 0), 0.0).otherwise(F.least(F.lit(float(MOST)), F.exp(F.expr(newton)))))
    s = s.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long"))
    extra = F.round("target").cast("long") - F.col("base") * F.col("source_size")
    return s.withColumn("extra", F.when(F.col("base") >= MOST, F.lit(0)).otherwise(F.greatest(F.lit(0), extra))).select("source", "source_size", "target", "rate", "base", "extra")


def _same(a: DataFrame, b: DataFrame, how: str = "inner", *also: str) -> DataFrame:
    """Join on `source`, null equal to null, and on further columns."""
    b = b.withColumnRenamed("source", "_s").withColumnsRenamed({c: f"_{c}_" for c in also})
    on = F.col("source").eqNullSafe(F.col("_s"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_{c}_"))
    return a.join(b, on, how).drop("_s", *[f"_{c}_" for c in also])


def plan(rows: DataFrame) -> MixPlan:
    """The plan for rows (source, size, h)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(_targets(sums), "targets")
    # The pool: of each size class and source up to 4 documents, those of least hash. A copy of a row has its hash and counts with it.
    kinds = rows.where("size > 0").groupBy("source", F.floor(F.log2("size")).alias("kind"), (F.col("h") % 4).alias("part")).agg(F.min("h").alias("h"))
    chosen = kinds.select("source", "h").distinct().withColumn("pool", F.lit(True))
    chosen = written(chosen, "chosen")
    marked = _same(rows, chosen, "left", "h")
    pool = written(marked.where("pool").groupBy("source", "h").agg(F.sum("size").alias("cap")), "pool")
    held = pool.groupBy("source").agg(F.sum("cap").alias("pooled"))
    need = F.greatest(F.lit(0), F.least(F.col("extra") - F.floor(F.coalesce("pooled", F.lit(0)) / 2), F.col("source_size") - F.coalesce("pooled", F.lit(0))))
    state = written(_same(sources, held, "left").select("source", need.cast("long").alias("need"), F.lit(0).cast("long").alias("threshold")), "state")
    for level in range(1, LEVELS + 1):
        bits = 60 - 8 * level
        inside = _same(marked.where("pool IS NULL"), state).where(f"shiftright(h, {bits + 8}) = threshold" if level > 1 else "true")
        ranges = inside.groupBy("source", F.expr(f"shiftright(h, {bits}) & 255").alias("b")).agg(F.sum("size").alias("w"))
        lists = ranges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("ranges"))
        cut = F.expr(
            """aggregate(coalesce(ranges, array()), named_struct('need', need, 'cut', 256L),
            (a, x) -> CASE WHEN a.cut < 256L THEN a WHEN x.w <= a.need THEN named_struct('need', a.need - x.w, 'cut', 256L) ELSE named_struct('need', a.need, 'cut', x.b) END)"""
        )
        step = _same(state, lists, "left").withColumn("x", F.when(F.col("ranges").isNull(), F.struct("need", F.lit(0).cast("long").alias("cut"))).otherwise(cut))
        state = written(step.select("source", "x.need", (F.col("threshold") * 256 + F.col("x.cut")).alias("threshold")), "state")
    sure = _same(marked.where("pool IS NULL"), state).where(f"shiftright(h, {60 - 8 * LEVELS}) < threshold").groupBy("source").agg(F.sum("size").alias("sure"))
    gap = _same(_same(sources.select("source", "extra"), sure, "left"), pool.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("cap")).alias("less"), "h"))).alias("docs")))
    picks = F.expr(
        """aggregate(docs, named_struct('gap', extra - coalesce(sure, 0L), 'h', cast(array() AS array<bigint>)),
        (a, x) -> IF(-x.less <= a.gap, named_struct('gap', a.gap + x.less, 'h', array_append(a.h, x.h)), a)).h"""
    )
    picked = gap.select("source", F.explode(picks).alias("h")).withColumn("picked", F.lit(True))
    pool = written(_same(pool.select("source", "h"), picked, "left", "h").select("source", "h", F.coalesce("picked", F.lit(False)).alias("picked")), "pool")
    return MixPlan(written(_same(sources, state.select("source", "threshold")), "sources"), pool)


def apply_plan(rows: DataFrame, p: MixPlan, source: str = "source", h: str = "h") -> DataFrame:
    """`rows` with source_size, target, rate and copies. Both tables of the plan are small: some rows a source."""
    s = p.sources.select(F.col("source").alias("_ps"), "source_size", "target", "rate", "base", "threshold")
    q = p.pool.select(F.col("source").alias("_qs"), F.col("h").alias("_qh"), "picked")
    out = rows.join(s, F.col(source).eqNullSafe(F.col("_ps"))).join(q, F.col(source).eqNullSafe(F.col("_qs")) & (F.col(h) == F.col("_qh")), "left")
    more = F.coalesce(F.col("picked"), F.shiftright(F.col(h), 60 - 8 * LEVELS) < F.col("threshold"))
    return out.withColumn("copies", F.least(F.lit(MOST), F.col("base") + more.cast("long")).cast("int")).drop("_ps", "_qs", "_qh", "picked", "base", "threshold")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, rate) for each row.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, the last. Rows with
    equal id and text get equal copies, so reruns agree. With no words at all, all targets are 0. An empty
    table gives no rows; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = written(keyed(src).select("doc_id", "source", F.col("_size").alias("size"), F.col("_h").alias("h")), "sizes")
    out = apply_plan(rows, plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies", "rate")
