"""Toxicity by a classifier chain.

Categories are predicted in order. Each one's linear model (ridge logistic regression) sees which telling words
and beginnings of words a text has, a few rates, and the probabilities of all earlier categories. Later models are trained on
out-of-fold probabilities of the earlier ones, so they meet the same kind of numbers as in use. CHAIN holds what the
given labels have: low quality, which is no toxicity category but the only other label, and then toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

#: Labelled rows learned from, at most about.
SAMPLE = 6000
FOLDS, WORDS_EACH, LEAST_GAIN, RIDGE, LEAST_DF = 5, 300, 5.0, 1.0, 5
#: Bytes of the beginnings that count as words besides the words themselves.
BEGINNINGS = (6, 8)
#: Categories in chain order: label column and the value that counts as positive.
CHAIN = (("quality", 0), ("toxic", 1))
_HIGH = K._B >= 128
_SYMBOL = np.isin(K._B, np.frombuffer(b"#*$%&|<>!", np.uint8))
_UPPER = (K._B >= 65) & (K._B <= 90)


def _tokens(data: np.ndarray, offs: np.ndarray):
    """Plain lower-cased words and their beginnings (hashes and rows), the number of words of each row, and some rates."""
    h, start, end, first = K.words(data, offs, K.NOT_ALNUM)
    row, n = K.rows_of(first), np.diff(first)
    hs, rows = [h], [row]
    for limit in BEGINNINGS:
        longer = end - start > limit
        hs.append(K.mix(K.words(data, offs, K.NOT_ALNUM, limit=limit)[0][longer] + np.uint64(limit)))
        rows.append(row[longer])

    def rate(mask):
        c = np.concatenate([[0], np.cumsum(mask[data])])
        return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(1, np.diff(offs))

    return np.concatenate(hs), np.concatenate(rows), n, np.stack([np.log1p(n) / 5, rate(_SYMBOL) * 5, rate(_UPPER) * 2, rate(_HIGH) * 5], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with halved steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pen = np.full(z.shape[1], RIDGE)
    pen[-1] = 1e-6
    b = np.zeros(z.shape[1]) if start is None else start.copy()

    def cost(b):
        f = z @ b
        return (w * (np.logaddexp(0, f) - y * f)).sum() + 0.5 * (pen * b * b).sum()

    now = cost(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (p - y)) + pen * b
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(hess, g)
        t = 1.0
        while t > 1e-4 and cost(b - t * step) > now:
            t /= 2
        b, before = b - t * step, now
        now = cost(b)
        if before - now < 1e-6 * max(1, abs(now)):
            break
    return b


def _prob(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))


@dataclass
class Chain:
    names: list[str]
    vocab: np.ndarray
    models: list[np.ndarray]
    cutoffs: list[float]

    def design(self, h: np.ndarray, row: np.ndarray, rates: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rates), len(self.vocab)))
        if len(self.vocab) and len(h):
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.vocab >> np.uint64(48)).astype(int)] = True
            at = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
            hit = self.vocab[place] == h[at]
            x[row[at[hit]], place[hit]] = 1
        return np.concatenate([x, rates], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, each fed to the next."""
        for b in self.models:
            x = np.concatenate([x, _prob(b, x)[:, None]], axis=1)
        return x[:, x.shape[1] - len(self.models) :]


def _telling(h: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The words whose presence tells most about y (likelihood ratio)."""
    words, at = np.unique(h, return_inverse=True)
    df = np.bincount(at, minlength=len(words))
    a, b = np.bincount(at, w[row] * y[row], len(words)), np.bincount(at, w[row] * (1 - y[row]), len(words))
    na, nb = (w * y).sum() + 1, (w * (1 - y)).sum() + 1
    e = (a + b) / (na + nb)

    def kl(k, n):
        r = np.clip(k / n, 1e-9, 1 - 1e-9)
        return n * (r * np.log(r / e) + (1 - r) * np.log((1 - r) / np.clip(1 - e, 1e-9, 1)))

    gain = np.where((df >= LEAST_DF) & (e < 1), kl(a, na) + kl(b, nb), -1)
    top = np.argsort(-gain, kind="stable")[:WORDS_EACH]
    return words[top[gain[top] > LEAST_GAIN]]


def _cutoff(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Between the two neighbouring scores where F0.5 is best: a false alarm costs a clean document. Without positive labels 1, which no score exceeds."""
    if not (w * y).any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    tp, fp = np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    f = 1.25 * tp / (1.25 * tp + 0.25 * ((w * y).sum() - tp) + fp + 1e-9)
    f[:-1][p[order][:-1] == p[order][1:]] = -1
    i = int(f.argmax())
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + below) / 2)


def fit(rows: list[tuple[bytes, list[float], int, tuple[int, ...]]], names: list[str]) -> Chain:
    """rows: distinct word hashes (8 bytes each), rates, a key that near copies share, labels of all categories."""
    first = np.concatenate([[0], np.cumsum([len(r[0]) // 8 for r in rows])])
    h = np.frombuffer(b"".join(r[0] for r in rows), np.uint64)
    row, rates, ys = K.rows_of(first), np.array([r[1] for r in rows]), np.array([r[3] for r in rows], float)
    _, group, size = np.unique([r[2] for r in rows], return_inverse=True, return_counts=True)
    w = 1.0 / size[group]
    fold = group % FOLDS  # copies stay in one fold
    vocab = np.unique(np.concatenate([_telling(h, row, ys[:, c], w) for c in range(len(names))]))
    chain = Chain(names, vocab, [], [])
    x = chain.design(h, row, rates)
    for c in range(len(names)):
        y, oof = ys[:, c], np.zeros(len(rows))
        chain.models.append(_logistic(x, y, w))
        for k in range(FOLDS):  # each fold's optimum is unique; starting near it only saves steps
            inside = fold != k
            oof[~inside] = _prob(_logistic(x[inside], y[inside], w[inside], chain.models[-1]), x[~inside]) if inside.any() else 0
        chain.cutoffs.append(_cutoff(oof, y, w))
        x = np.concatenate([x, oof[:, None]], axis=1)
    return chain


def _sampled(batches):
    for batch in batches:
        for a, b, data, offs in K.strings(batch.column(0)):
            h, row, n, rates = _tokens(data, offs)
            u, begin = K.distinct(h[np.argsort(row, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]))
            sh, at = K.shingles(h[: n.sum()], np.concatenate([[0], np.cumsum(n)]))
            least = [int(sh[i:j].min().view(np.int64)) if j > i else 0 for i, j in zip(at[:-1], at[1:])]
            words = pa.array([u[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary())
            cols = [words, pa.array(rates.tolist(), pa.list_(pa.float64())), pa.array(least, pa.int64()), batch.column(1).slice(a, b - a)]
            yield pa.RecordBatch.from_arrays(cols, ["words", "rates", "near", "ys"])


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> Chain | None:
    """Fit on labelled rows of `docs` (doc_id, text); None where no label is known."""
    full = " AND ".join(f"{c} IS NOT NULL" for c, _ in chain)
    known = labels.where("doc_id IS NOT NULL").where(full).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array(*[F.max((F.col(c) == v).cast("int")) for c, v in chain]).alias("ys"))
    n = known.count()
    if not n:
        return None
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n)))
    rows = docs.join(known, "doc_id").select("text", "ys").mapInArrow(_sampled, "words binary, rates array<double>, near long, ys array<int>").collect()
    rows = sorted((bytes(r.words), list(r.rates), r.near, tuple(r.ys)) for r in rows)
    return fit(rows, [c for c, _ in chain]) if rows else None


def score_toxicity(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(doc_id, one probability p_<label> for each category, toxic) for each row; keep_row adds the whole row as struct `row`.

    toxic: the last category's probability is over its cutoff. A null text is empty; a text without words is
    never toxic. Labels that repeat for an id count as positive if any is. Without labels all probabilities
    are 0; without a positive label of the last category no document is toxic. Repeated rows stay repeated; an empty table gives no rows.
    """
    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    model = train(src.where("doc_id IS NOT NULL"), labels, chain)
    names = [f"p_{c}" for c, _ in chain]

    def predict(batches):
        for batch in batches:
            for a, b, data, offs in K.strings(batch.column(0)):
                h, row, n, rates = _tokens(data, offs)
                p = model.predict(model.design(h, row, rates)) if model else np.zeros((b - a, len(names)))
                toxic = (p[:, -1] > model.cutoffs[-1]) & (n > 0) if model else np.zeros(b - a, bool)
                cols = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(p[:, i]) for i in range(len(names))], pa.array(toxic)], [*batch.schema.names[1:], *names, "toxic"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *[F.struct("*").alias("row")] * keep_row)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(predict, f"{schema}, {', '.join(f'{c} double' for c in names)}, toxic boolean")
