"""Language identification by error-correcting output codes.

Every language has a codeword; one linear classifier on hashed byte n-grams predicts each bit. Decoding picks the
codeword with the least loss, every bit's loss weighted by how reliable its classifier was out of fold, and flags
texts whose two best codewords are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

#: Documents learned from: about so many of each language at most, those of least hashed id; all of rarer ones.
PER_LANGUAGE = 700
#: Bounds of the whole sample, which the driver holds (16 KB a row), and of the languages learned, the most frequent ones.
MAX_ROWS, MAX_LANGUAGES = 4000, 200
DIM, RIDGE, FOLDS, SHARPNESS, AMBIGUOUS = 4096, 1e-3, 3, 4.0, 0.6
_LETTER = K.LOWER != K.SAME
_LETTER = _LETTER | ((K._B >= 97) & (K._B <= 122))


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: the exhaustive code up to 7 languages, beyond that the best of some random dense codes."""
    if n <= 7:
        cols = [[1 if c == 0 else 1 - 2 * ((m >> (c - 1)) & 1) for c in range(n)] for m in range(1, 2 ** (n - 1))]
        return np.array(cols, float).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > far and (abs(code.sum(axis=0)) < n).all():
            best, far = code, gap
    return best


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of square roots of the shares of hashed 1-, 2- and 3-byte grams of the lower-cased text, white space and digits as one separator."""
    fold = K.LOWER.copy()
    fold[K.NOT_ALNUM | ((K._B >= 48) & (K._B <= 57))] = 32
    b = fold[data].astype(np.uint32)
    n = len(b)
    two, three = b.copy(), b.copy()
    two[: n - 1] += b[1:] << np.uint32(8)
    three[: max(0, n - 2)] += (b[1 : n - 1] << np.uint32(8)) + (b[2:] << np.uint32(16)) if n > 2 else 0

    def slot(x, salt):
        return ((x * np.uint32(2654435761) + np.uint32(salt)) * np.uint32(2246822519) >> np.uint32(20)).astype(np.int64)

    dull = b == 32
    dull3 = np.zeros(n, bool)
    dull3[: max(0, n - 2)] = dull[1 : n - 1] if n > 2 else False  # a separator in the middle says nothing
    s2, s3 = slot(two, 77), slot(three, 999)
    out = np.zeros((len(offs) - 1, DIM), np.float32)
    for i in range(len(offs) - 1):
        a, z = offs[i], offs[i + 1]
        if z > a:
            x = np.bincount(s3[a : max(a, z - 2)][~dull3[a : max(a, z - 2)]], minlength=DIM) + np.bincount(s2[a : z - 1], minlength=DIM)
            out[i] = np.sqrt(x / max(1, x.sum()))
    return out


def has_letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(_LETTER[data])])
    h = np.concatenate([[0], np.cumsum(data >= 128)])
    out = c[offs[1:]] > c[offs[:-1]]
    for i in np.flatnonzero(~out & (h[offs[1:]] > h[offs[:-1]])):
        out[i] = any(ch.isalpha() for ch in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its score, and whether the text is ambiguous."""
        f = (x @ self.weights + self.bias) * SHARPNESS
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1), p.max(axis=1) < AMBIGUOUS


def _ridge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    z = x - mean
    gram = z @ z.T
    gram[np.diag_indices_from(gram)] += RIDGE * len(x)
    w = z.T @ np.linalg.solve(gram.astype(np.float64), y - y.mean(axis=0))
    return w.astype(np.float32), y.mean(axis=0) - mean @ w


def fit(x: np.ndarray, lang: list[str]) -> Model:
    names = sorted(set(lang))
    code = codewords(len(names))
    y = code[[names.index(v) for v in lang]]
    w, bias = _ridge(x, y) if code.shape[1] else (np.zeros((DIM, 0), np.float32), np.zeros(0))
    good = np.full(code.shape[1], 0.5)
    if len(x) >= 4 * FOLDS:
        fold, right = np.arange(len(x)) % FOLDS, np.zeros(code.shape[1])
        for k in range(FOLDS):
            wk, bk = _ridge(x[fold != k], y[fold != k])
            right += ((x[fold == k] @ wk + bk) * y[fold == k] > 0).sum(axis=0)
        good = right / len(x)
    trust = np.clip(np.log((good + 0.01) / (1.01 - good)), 0.1, None)
    return Model(names, code, w, bias.astype(np.float32), trust / max(1e-9, trust.sum()) * max(1, code.shape[1]))


def _featured(batches):
    for batch in batches:
        for a, b, data, offs in K.strings(batch.column(1), K.BLOCK):
            x, ok = features(data, offs), has_letters(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(ok)], ["lang", "x", "ok"])


def train(docs: DataFrame) -> Model | None:
    """Fit on rows (doc_id, text, lang) that may be learned from; None where there are none."""
    counts = {r.lang: r.c for r in docs.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return None
    each = min(PER_LANGUAGE, MAX_ROWS // len(counts))
    share = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, min(1.0, each / c))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * float(1 << 20))
    rows = chosen.select("lang", "text").mapInArrow(_featured, "lang string, x binary, ok boolean").where("ok").collect()
    rows = sorted((r.lang, bytes(r.x)) for r in rows)
    rows = [rows[i] for i in np.random.default_rng(11).permutation(len(rows))]
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in rows]), [v for v, _ in rows]) if rows else None


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each row.

    Learned from rows with a language whose crc32(id as text) mod 5 isn't 0; rows with a null id count as held
    out. `und` with score 0 if the text is null or has no letter, or if there was nothing to learn from. If only one
    language was learned, it is every other text's. Of more than MAX_LANGUAGES the most frequent ones are learned.
    Repeated rows stay repeated; other columns are not read; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = train(src.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()))

    def predict(batches):
        for batch in batches:
            for a, b, data, offs in K.strings(batch.column(0), K.BLOCK):
                ok = has_letters(data, offs) if model else np.zeros(b - a, bool)
                best, score, vague = model.decode(features(data, offs)) if model else (np.zeros(b - a, int), np.zeros(b - a), ok)
                names = np.array([*model.languages, "und"] if model else ["und"], object)
                cols = [names[np.where(ok, best, -1)], np.where(ok, score, 0.0).astype(float), vague | ~ok]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]] + [pa.array(c) for c in cols], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = src.select("text", "doc_id", held.alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
