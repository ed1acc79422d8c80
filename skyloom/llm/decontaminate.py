"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits, lower-cased. A window has as many words as some benchmark item (or the
whole text, if that is shorter). Fingerprints have 128 bits in 8 blocks of 16; two fingerprints within RADIUS
differ in at most RADIUS // 8 bits in some block, so looking up all block values that near finds every item within
the radius. What it finds is decided by the exact weighted Jaccard similarity of the 5-word shingles; a shingle
weighs its letters times its count.

Only windows are fingerprinted that can pass the exact check. First those aligned with an item: they have one of
its shingles at its place in the item. Then, for an item that is not found so although the text has shingles of it that
weigh enough, the windows at every other place that covers one of these shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .store import written

#: Windows at weighted similarity 0.8 differ in 19.4 bits on average (sd 4.1): one in 30,000 is beyond the radius.
SIMILARITY, RADIUS, BLOCKS = 0.8, 36, 8
#: Items whose index is sent to the executors at once; a larger benchmark takes several passes.
ITEM_BLOCK = 20_000
_NEAR = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), r)], np.int64)
_HITS = "array<struct<item_id:bigint,start:int,end:int,similarity:double>>"
_LEAD = (K._B & 0xC0) != 0x80


def _weighted(data: np.ndarray, offs: np.ndarray):
    """Words' byte ranges, each row's first word, shingles, each row's first one, and shingles' weights."""
    h, s, e, first = K.words(data, offs, K.NOT_ALNUM)
    sh, begin = K.shingles(h, first)
    size = np.concatenate([[0], np.cumsum(e - s)])
    n = np.diff(first)
    at = np.arange(len(sh)) - np.repeat(begin[:-1], np.diff(begin)) + np.repeat(first[:-1], np.diff(begin))
    weight = size[np.minimum(at + 5, np.repeat(first[1:], np.diff(begin)))] - size[at] if len(sh) else np.zeros(0, np.int64)
    return s, e, first, n, sh, begin, weight


def fingerprint(sh: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """16 bytes: signs of the weighted sums of the shingles' 128 pseudo-random bits."""
    with np.errstate(over="ignore"):
        bits = np.stack([K.mix(sh ^ K._STEPS[60]), K.mix(sh ^ K._STEPS[61])], axis=1).view(np.uint8)
    signs = np.unpackbits(bits.reshape(len(sh), 16), axis=1).astype(np.int64) * 2 - 1
    return np.packbits((weight[:, None] * signs).sum(axis=0) > 0)


def weighted_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags: sum of least over sum of greatest weights."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(at[: len(a)], wa, len(keys))
    y = np.bincount(at[len(a) :], wb, len(keys))
    total = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / total) if total else 0.0


class Index:
    """Items by shingle and by fingerprint block."""

    def __init__(self, items: list[tuple[int, str]]):
        data, offs = K.buffers(pa.array([t for _, t in items], pa.string()))
        _, _, _, self.n_words, self.sh, self.begin, self.weight = _weighted(data, offs)
        self.ids = np.array([i for i, _ in items], np.int64)
        order = np.argsort(self.sh, kind="stable")
        self.keys, self.item = self.sh[order], K.rows_of(self.begin)[order]
        self.place = (np.arange(len(self.sh)) - np.repeat(self.begin[:-1], np.diff(self.begin)))[order]
        self.length = np.diff(self.begin)
        self.total = np.bincount(K.rows_of(self.begin), self.weight, len(self.ids))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        real = np.flatnonzero(np.diff(self.begin))
        prints = [fingerprint(self.sh[self.begin[i] : self.begin[i + 1]], self.weight[self.begin[i] : self.begin[i + 1]]) for i in real]
        self.real, self.prints = real, np.array(prints, np.uint8).reshape(-1, 16)
        values = self.prints.view(">u2").astype(np.int64)
        self.by_block = []
        for b in range(BLOCKS):
            rank = np.argsort(values[:, b], kind="stable")
            self.by_block.append((rank, np.searchsorted(values[rank, b], np.arange((1 << 16) + 1))))

    def near(self, print_: np.ndarray) -> np.ndarray:
        """All items whose fingerprints are within the radius."""
        found = []
        for (rank, start), v in zip(self.by_block, print_.view(">u2").astype(np.int64)):
            value = _NEAR ^ v
            a, z = start[value], start[value + 1]
            for i, j in zip(a[z > a], z[z > a]):
                found.append(rank[i:j])
        if not found:
            return np.zeros(0, np.int64)
        found = np.unique(np.concatenate(found))
        return self.real[found[np.bitwise_count(self.prints[found] ^ print_).sum(axis=1) <= RADIUS]]

    def windows(self, sh, begin, weight):
        """Distinct (row, first shingle, end shingle) of the aligned windows, and (row, item, first and last shingle found) of the items that may be in a row."""
        none = np.zeros((0, 3), np.int64), np.zeros((0, 4), np.int64)
        at = np.flatnonzero(self.maybe[(sh >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, sh[at]), np.searchsorted(self.keys, sh[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return none
        c = hi - lo
        post = np.repeat(lo, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at = np.repeat(at, c)
        row, item = np.searchsorted(begin, at, "right") - 1, self.item[post]
        # The shingles that a row has of an item weigh at least what any of its windows shares with the item.
        pair, inv = np.unique(row * len(self.ids) + item, return_inverse=True)
        enough = np.bincount(inv, weight[at]) >= SIMILARITY * self.total[pair % len(self.ids)] - 1e-9
        if not enough.any():
            return none
        low, high = np.full(len(pair), len(sh)), np.zeros(len(pair), np.int64)
        np.minimum.at(low, inv, at)
        np.maximum.at(high, inv, at)
        keep = enough[inv]
        at, row, item, place = at[keep], row[keep], item[keep], self.place[post[keep]]
        size = np.minimum(self.length[item], np.diff(begin)[row])
        start = np.clip(at - place, begin[row], begin[row + 1] - size)
        may = np.stack([pair // len(self.ids), pair % len(self.ids), low, high], axis=1)[enough]
        return np.unique(np.stack([row, start, start + size], axis=1), axis=0), may

    def hits(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, item id, start, end, similarity): the best window of each item in each row; code points."""
        s, e, first, n, sh, begin, weight = _weighted(data, offs)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}

        def test(row: int, a: int, z: int) -> None:
            for i in self.near(fingerprint(sh[a:z], weight[a:z])):
                b0, b1 = self.begin[i], self.begin[i + 1]
                sim = weighted_similarity(sh[a:z], weight[a:z], self.sh[b0:b1], self.weight[b0:b1])
                if sim >= SIMILARITY:
                    word = first[row] + a - begin[row]
                    last = min(word + (z - a) + 4, first[row + 1]) - 1
                    key = (int(row), int(i))
                    best[key] = max(best.get(key, (-1.0, 0, 0)), (sim, -int(s[word]), int(e[last])))

        aligned, may = self.windows(sh, begin, weight)
        for row, a, z in aligned:
            test(row, a, z)
        for row, i, low, high in may:
            if (int(row), int(i)) not in best:
                size = min(self.length[i], begin[row + 1] - begin[row])
                for a in range(max(begin[row], low - size + 1), min(begin[row + 1] - size, high) + 1):
                    test(row, a, a + size)
        out = []
        for (row, i), (sim, a, z) in sorted(best.items()):
            lead = _LEAD[data[offs[row] : z]]
            out.append((row, int(self.ids[i]), int(lead[: -a - offs[row]].sum()), int(lead.sum()), sim))
        return out


def _search(index: Index, more: bool, name: str):
    def f(batches):
        for batch in batches:
            extra = batch.num_columns - 1 if more else batch.num_columns
            for a, b, data, offs in K.strings(batch.column(0)):
                lists = [list(x) for x in batch.column(extra).slice(a, b - a).to_pylist()] if more else [[] for _ in range(b - a)]
                for row, item, start, end, sim in index.hits(data, offs):
                    lists[row].append({"item_id": item, "start": start, "end": end, "similarity": sim})
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())]))
                cols = [c.slice(a, b - a) for c in batch.columns[:extra]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lists, kind)], [*batch.schema.names[:extra], name])

    return f


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", hits_col: str = "hits") -> DataFrame:
    """`docs` with a column `hits_col`: (item_id, start, end, similarity) of each item found, the place of its best window in code points.

    An item of fewer than 5 words is too common to be evidence inside a longer text: it is found only in texts that
    consist of its words. Null and empty texts and items hold nothing and are found nowhere. Items that repeat are reported once an
    id. An empty benchmark gives empty hits, an empty table no rows. Repeated documents are judged alike. A column of
    `docs` that has the name in `hits_col` is replaced.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
    passes = -(-items.count() // ITEM_BLOCK)
    kept = [c for c in docs.columns if c not in (text_col, hits_col)]
    out = docs.select(F.col(text_col).cast("string").alias(text_col), *kept)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).distinct().collect()
        out = out.mapInArrow(_search(Index(sorted((r.i, r.t) for r in part if r.i is not None)), k > 0, hits_col), f"{types}, `{hits_col}` {_HITS}")
        if k + 1 < passes:
            out = written(out, "leaks")
    if not passes:
        out = out.withColumn(hits_col, F.array().cast(_HITS))
    return out.select(*[c for c in docs.columns if c != hits_col], hits_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, max_similarity) for each row; see find_leaks for odd rows."""
    found = find_leaks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    ids = F.array_sort(F.transform("hits", lambda x: x["item_id"]))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0)).alias("max_similarity"))
