"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification, union of links.

Recall of banding at the threshold: 32 bands of 8 rows miss a pair of similarity 0.85 with probability 4e-5, 36 bands
of 7 one of 0.8 with 2e-4; closer pairs are missed far more rarely. Whatever shares a band is decided on full shingle
sets, so no false link is returned. Candidates are unlimited. Within a band's bucket every member is first compared
with the bucket's smallest id. Members whose components then still differ are compared with one another where the
prefixes of their sets meet: with the shingles of all of them in one order, the rarest first, two sets A and B with
|A n B| >= t |A u B| have at least t |A| shingles in common, so the first |A| - ceil(t |A|) + 1 of A and the like of B
share one. The smaller set of a pair needs only its first |A| - ceil(2 t / (1 + t) |A|) + 1, and where the first
common shingle stands in both bounds what can follow. These bounds are exact, whatever the bucket's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .graph import components
from .store import written

SLOTS = 256
#: Similarity in hundredths, bands and rows of a band, if nothing else is asked for.
SIMILARITY, BANDS, ROWS = 80, 36, 7
#: Documents of one prefix shingle in one group of the search among members whose components differ.
SALTED = 256


def super_minhash(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures (rows x 256, uint64) of rows of distinct element hashes.

    At level j element d puts the value j + r(d, j) into slot p(d, j), p(d, .) being a permutation of the
    slots that belongs to d; a slot keeps its least value. Values of level j are below those of level j + 1,
    so a row stops at the first level after which no slot is empty. Rows without elements stay empty.
    """
    n = len(begin) - 1
    empty = np.uint64(2**64 - 1)
    sig = np.full(n * SLOTS, empty, np.uint64)
    row = K.rows_of(begin)
    with np.errstate(over="ignore"):
        key = K.mix(h + np.uint64(0x51ED270B))
        for j in range(SLOTS):
            if not len(row):
                break
            v = np.full(len(row), j, np.uint8)
            for s in (0, 16, 32):  # a bijection of 0..255 keyed by the element
                v = v * ((key >> np.uint64(s)).astype(np.uint8) | np.uint8(1)) + (key >> np.uint64(s + 8)).astype(np.uint8)
                v ^= v >> np.uint8(4)
            r = K.mix(h + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)
            np.minimum.at(sig, row * SLOTS + v, (np.uint64(j) << np.uint64(52)) | r)
            live = (sig.reshape(n, SLOTS) == empty).any(axis=1)
            if not live.all():
                keep = live[row]
                row, key, h = row[keep], key[keep], h[keep]
    return sig.reshape(n, SLOTS)


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        x = sig[:, : bands * rows].reshape(len(sig), bands, rows)
        key = np.zeros((len(sig), bands), np.uint64)
        for i in range(rows):
            key = K.mix(key + x[:, :, i] * K._STEPS[i])
        return K.mix(key + np.arange(bands, dtype=np.uint64) * K._STEPS[50])


def _sets(column: pa.Array):
    for a, b, data, offs in K.strings(column):
        h, _, _, first = K.words(data, offs)
        yield a, b, *K.distinct(*K.shingles(h, first))


def _digest(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, whatever the order."""
    with np.errstate(over="ignore"):
        c1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(s ^ K._STEPS[51]), dtype=np.uint64)])
        c2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(s ^ K._STEPS[52]), dtype=np.uint64)])
        return c1[begin[1:]] - c1[begin[:-1]], c2[begin[1:]] - c2[begin[:-1]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(x: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), _long(x))


def _signatures(bands: int, rows: int):
    def f(batches):
        for batch in batches:
            for a, b, s, begin in _sets(batch.column(1)):
                d1, d2 = _digest(s, begin)
                keys = bands_of(super_minhash(s, begin), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), _long(d1), _long(d2), _lists(keys.ravel(), np.arange(b - a + 1) * bands)],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return f


def _full_sets(batches):
    for batch in batches:
        for a, b, s, begin in _sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), _lists(s, begin)], ["id", "n", "s"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets and of the intersection."""
    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))


def _meeting_prefixes(sets: DataFrame, comps: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of different components in comps (id, comp) whose prefixes share a shingle and for which sizes and its places allow the similarity.

    Of a pair, x is the smaller set (then the smaller id). At the first shingle that both have, in the common order,
    the intersection is at most 1 + the lesser number of shingles that follow; so every pair that is similar enough
    passes there, if not at a later shingle. Shingles that one set alone has come first in its prefix and meet nothing. A shingle of many sets is dealt over
    salted groups, so no task holds all sets of one shingle.
    """
    crowd = written(sets.join(comps, "id").select("id", "comp", "n", F.explode("s").alias("h")), "crowd")
    common = written(crowd.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "common")
    ranked = crowd.join(common, "h", "left").groupBy("id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "h"))).alias("x"))
    prefix = F.expr(f"slice(x, 1, cast(n - ceil({similarity} * n / 100) + 1 AS int))")
    first = ranked.select("id", "comp", "n", F.posexplode(prefix).alias("place", "x")).where("x.k > 1").select("id", "comp", "n", (F.col("n") - F.col("place")).alias("left"), "x.h")
    first = written(first, "prefixes")  # left: this shingle and those that follow
    short = first.where(f"left >= ceil({2 * similarity} * n / {100 + similarity})")
    groups = written(first.groupBy("h").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("groups"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h", "groups"), "groups")
    kept = ("id", "comp", "n", "left")
    x = short.join(groups, "h").select("h", F.pmod("id", "groups").cast("int").alias("salt"), *[F.col(c).alias(f"{c}_x") for c in kept])
    y = first.join(groups, "h").select("h", F.explode(F.expr("sequence(0, groups - 1)")).alias("salt"), *[F.col(c).alias(f"{c}_y") for c in kept])
    met = x.join(y, ["h", "salt"]).where(
        f"(n_x < n_y OR (n_x = n_y AND id_x < id_y)) AND comp_x <> comp_y AND 100 * n_x >= {similarity} * n_y AND {100 + similarity} * least(left_x, left_y) >= {similarity} * (n_x + n_y)"
    )
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: documents linked when 100 * |A n B| >= similarity * |A u B|.

    Null and empty texts and texts without words have n_shingles 0 and are linked with nothing. Equal sets
    share a class and are linked once. A row with a null id has a null component and is kept. Rows that
    share an id are one document; if their texts differ, the larger set (then the larger hashes) stands for
    it in comparisons. Other columns of `docs` are not read. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = written(src.mapInArrow(_signatures(bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sig")
    classes = written(
        sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    # Written, so that the join below has a plain exchange on each side and a hot key's part can be split.
    shared = written(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1"), "shared")
    members = written(keyed.join(shared, "key").select("key", "pivot", "rep"), "members")
    wanted = members.select("rep").distinct()
    sets = written(
        src.join(wanted.withColumnRenamed("rep", "doc_id").hint("shuffle_merge"), "doc_id", "left_semi")
        .mapInArrow(_full_sets, "id long, n long, s array<long>")
        .groupBy("id").agg(F.max(F.struct("n", "s")).alias("x")).select("id", "x.n", "x.s"),
        "sets",
    )
    linked = f"{100 + similarity} * both >= {similarity} * (na + nb)"  # 100 * both >= similarity * union
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    near = written(_verified(stars, sets).where(linked).select("a", "b"), "near")
    first = components(near)
    whole = members.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    whole = written(whole.select("key", "pivot", "rep", "comp"), "placed")
    mixed = written(whole.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi AND c > 2").select("key"), "mixed")
    rest = whole.join(mixed, "key", "left_semi").where("rep <> pivot").select(F.col("rep").alias("id"), "comp").distinct()
    late = written(_verified(_meeting_prefixes(sets, rest, similarity), sets).where(linked).select("a", "b"), "late")
    if late.isEmpty():
        whole_map = first
    else:
        tag = first.withColumnRenamed("component", "t")
        up = late.join(tag.withColumnRenamed("id", "a"), "a", "left").select("b", F.coalesce("t", "a").alias("a"))
        up = up.join(tag.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("t", "b").alias("b"))
        second = components(up)
        nodes = first.unionByName(late.select(F.col("a").alias("id"), F.col("a").alias("component"))).unionByName(late.select(F.col("b").alias("id"), F.col("b").alias("component")))
        nodes = nodes.groupBy("id").agg(F.min("component").alias("component"))
        whole_map = nodes.join(second.select(F.col("id").alias("component"), F.col("component").alias("c2")), "component", "left").select("id", F.coalesce("c2", "component").alias("component"))
    named = classes.select("d1", "d2", "n_shingles", "rep").join(whole_map.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("group_id"))
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", own_id).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
