"""Toxicity by a linear-chain conditional random field.

Tokens are runs of letters, A-Z lower-cased. Labelled documents give token labels: in a toxic document a token is
toxic if its word is far more frequent in toxic documents than in others. Two states (clean, toxic) with word
emissions and transitions are trained by gradient ascent of the conditional likelihood on windows around toxic
tokens and on windows of clean documents. Words without weight all emit the same, so a stretch of them is a power of one 2 x 2
matrix, and the forward-backward pass over a whole text visits only the words with weight; it is exact.
The marginals of these words give spans, and their maximum and sum give the document's score by a logistic curve.

Defined results: null and empty texts have no token and get the curve's lowest score. Without labelled rows of
both classes every score is the share of label 1 (0 without any row). Of several label rows of one id each counts. Rows are judged one by one, repeated rows
too; input columns named like result columns are replaced. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import kernels as K
from graphtide.llm.columns import guarded
from graphtide.runtime import table

#: Labelled rows of each class that are sampled for training (in the mean; chosen by a hash of the id).
SAMPLE_ROWS = 1500
#: The sample ends, in the order of the hash, before its texts are larger than so many bytes: a bound of the driver's memory.
SAMPLE_BYTES = 64 << 20
#: A word with weight needs so many documents and so large a log odds ratio.
MIN_DOCS, MIN_ODDS = 5, 2.5
#: The chain is trained on windows of so many words on either side, around so many weighted words and so many of any words of the
#: sample, drawn at random: a bound of the training time.
WINDOW, HIT_WINDOWS, ANY_WINDOWS = 12, 20_000, 4_000
STEPS, RATE, RIDGE = 150, 0.5, 1e-3
SPAN_MARGINAL = 0.5


@dataclass
class Model:
    codes: np.ndarray  # sorted word codes
    weight: np.ndarray  # log potential of state toxic against clean for each
    other: float  # the same for all other words
    start: np.ndarray  # log potentials of the first state
    move: np.ndarray  # log potentials of moves, 2 x 2
    curve: np.ndarray  # intercept, maximum, log1p(sum)


def tokens(b: np.ndarray, offsets: np.ndarray):
    low = K.ascii_lower(b)
    letter = ((low - np.uint8(97)) <= 25) | (b >= 128)
    start, end, row = K.spans(letter, offsets)
    return start, end, row, K.span_codes(low, start, end)


def _scores(model: Model, code: np.ndarray) -> np.ndarray:
    """The emission of each token; NaN where the word has no weight of its own."""
    if not len(model.codes):
        return np.full(len(code), np.nan)
    at = np.minimum(np.searchsorted(model.codes, code), len(model.codes) - 1)
    return np.where(model.codes[at] == code, model.weight[at], np.nan)


class _Stretch:
    """Powers of the matrix of one other word: T[i, j] = exp(move[i, j] + emission of j)."""

    def __init__(self, model: Model):
        self.t = np.exp(model.move + np.array([0.0, model.other])[None, :])
        values, vectors = np.linalg.eig(self.t)
        self.values, self.left, self.right = values.real / values.real.max(), vectors.real, np.linalg.inv(vectors.real)

    def power(self, n: np.ndarray) -> np.ndarray:
        """One matrix for each n, each up to a positive factor."""
        p = self.values[None, :] ** n[:, None]
        return np.einsum("ij,nj,jk->nik", self.left, p, self.right).clip(0)


def marginals(model: Model, emission: np.ndarray, pos: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """P(toxic) of each weighted token. pos: the token's index in its row; counts: tokens of each row."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    rows, first, size = np.unique(row, return_index=True, return_counts=True)
    stretch, t = _Stretch(model), np.exp(model.move)
    e = np.stack([np.ones(n), np.exp(emission)], axis=1)
    gap = np.empty(n, np.int64)
    gap[1:] = pos[1:] - pos[:-1] - 1
    gap[first] = pos[first]
    # forward to the token: the start, or the token before, through the gap of other words
    lead = stretch.power(np.maximum(gap - 1, 0)) if n else None
    ahead = np.empty((n, 2))
    begin = np.exp(model.start)
    order = np.argsort(-size, kind="stable")
    first, size, rows = first[order], size[order], rows[order]
    for k in range(size[0]):
        live = int(np.searchsorted(-size, -k, side="left"))
        i = first[:live] + k
        if k == 0:
            inside = begin * np.array([1.0, np.exp(model.other)])
            through = np.einsum("j,njk,kl->nl", inside, lead[i], t)
            v = np.where((gap[i] > 0)[:, None], through, begin[None, :])
        else:
            v = ahead[i - 1]
            g = gap[i]
            passed = np.einsum("nj,jl,nlk,km->nm", v, stretch.t, lead[i], t)
            v = np.where((g > 0)[:, None], passed, v @ t)
        v = v * e[i]
        ahead[i] = v / v.sum(axis=1, keepdims=True)
    behind = np.empty((n, 2))
    last = first + size - 1
    rest = counts[rows] - pos[last] - 1
    tail = stretch.power(rest)
    for k in range(size[0]):
        live = int(np.searchsorted(-size, -k, side="left"))
        i = last[:live] - k
        if k == 0:
            w = tail.sum(axis=2)
        else:
            w = behind[i + 1] * e[i + 1]
            g = gap[i + 1]
            passed = np.einsum("jl,nlk,km,nm->nj", stretch.t, lead[i + 1], t, w)
            w = np.where((g > 0)[:, None], passed, w @ t.T)
        behind[i] = w / w.sum(axis=1, keepdims=True)
    p = ahead * behind
    return p[:, 1] / p.sum(axis=1)


def _train_chain(x: np.ndarray, y: np.ndarray, mask: np.ndarray, features: int):
    """Gradient ascent. x: feature of each token of padded windows (0: other), y: its label."""
    w, start, move = np.zeros(features), np.zeros(2), np.zeros((2, 2))
    b, n = x.shape
    total = mask.sum()
    onehot = np.stack([1 - y, y], axis=2)
    speed = {}
    for step in range(STEPS):
        e = np.stack([np.zeros((b, n)), w[x]], axis=2)
        pot, t = np.exp(e), np.exp(move)
        f, g = np.empty((b, n, 2)), np.empty((b, n, 2))
        v = np.exp(start)[None, :] * pot[:, 0]
        f[:, 0] = v / v.sum(1, keepdims=True)
        for k in range(1, n):
            v = (f[:, k - 1] @ t) * pot[:, k]
            v = np.where(mask[:, k : k + 1], v, f[:, k - 1])
            f[:, k] = v / v.sum(1, keepdims=True)
        g[:, n - 1] = 1
        for k in range(n - 2, -1, -1):
            v = (g[:, k + 1] * pot[:, k + 1]) @ t.T
            v = np.where(mask[:, k + 1 : k + 2], v, 1.0)
            g[:, k] = v / v.sum(1, keepdims=True)
        p = f * g
        p /= p.sum(2, keepdims=True)
        pair = f[:, :-1, :, None] * t[None, None] * (pot * g)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        live = (mask[:, 1:])[:, :, None, None]
        gw = np.bincount(x.ravel(), weights=((y - p[:, :, 1]) * mask).ravel(), minlength=features)
        gs = (onehot[:, 0] - p[:, 0]).sum(0)
        gm = ((onehot[:, :-1, :, None] * onehot[:, 1:, None, :] - pair) * live).sum((0, 1))
        for name, value, grad in (("w", w, gw), ("s", start, gs), ("m", move, gm)):
            grad = grad / total * 100 - RIDGE * value
            speed[name] = speed.get(name, 0) + grad**2
            value += RATE * grad / (np.sqrt(speed[name]) + 1e-8)
    return w, start, move


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from labelled texts, on the driver; their number is bounded by the caller."""
    toxic = toxic.astype(np.float64)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    level = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    blank = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros(2), np.zeros((2, 2)), np.array([level, 0.0, 0.0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return blank
    parts = []
    base = 0
    for lo, hi, b, off in K.chunks(pa.array(texts, pa.string())):
        _, _, row, code = tokens(b, off)
        parts.append((row + lo, code))
        base += hi - lo
    row, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    vocab, word = np.unique(code, return_inverse=True)
    seen = np.unique(np.stack([word, row]), axis=1)
    in_toxic = np.bincount(seen[0], weights=toxic[seen[1]], minlength=len(vocab))
    in_clean = np.bincount(seen[0], weights=1 - toxic[seen[1]], minlength=len(vocab))
    odds = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - toxic).sum() + 1))
    # the bound that a word of no meaning exceeds by chance shrinks with its documents
    good = (in_toxic >= MIN_DOCS) & (odds - 2.5 / np.sqrt(in_toxic + 0.5) >= MIN_ODDS - 1)
    good &= odds >= MIN_ODDS
    chosen = np.flatnonzero(good)
    if not len(chosen):
        return blank
    feature = np.zeros(len(vocab), np.int64)
    feature[chosen] = np.arange(1, len(chosen) + 1)
    x = feature[word]
    y = ((x > 0) & (toxic[row] == 1)).astype(np.float64)
    hits = np.flatnonzero(x > 0)
    rng = np.random.default_rng(7)
    drawn = hits if len(hits) <= HIT_WINDOWS else np.sort(rng.choice(hits, HIT_WINDOWS, replace=False))
    centres = np.concatenate([drawn, rng.integers(0, len(x), min(ANY_WINDOWS, len(x)))])
    at = centres[:, None] + np.arange(-WINDOW, WINDOW + 1)[None, :]
    ok = (at >= 0) & (at < len(x))
    at = at.clip(0, len(x) - 1)
    ok &= row[at] == row[centres][:, None]
    shift = ok.argmax(1)  # each window begins with its first real token
    at = (at + shift[:, None]).clip(0, len(x) - 1)
    mask = (row[at] == row[centres][:, None]) & (np.arange(2 * WINDOW + 1)[None, :] < ok.sum(1)[:, None])
    w, start, move = _train_chain(x[at] * mask, y[at] * mask, mask, len(chosen) + 1)
    order = np.argsort(vocab[chosen])
    model = Model(vocab[chosen][order], w[1:][order], float(w[0]), start, move, np.zeros(3))
    top, total = np.zeros(len(texts)), np.zeros(len(texts))
    bounds = K.row_bounds(row, len(texts))
    hit = x > 0
    p = marginals(model, _scores(model, code[hit]), (np.arange(len(x)) - bounds[row])[hit], row[hit], np.diff(bounds))
    np.maximum.at(top, row[hit], p)
    np.add.at(total, row[hit], p)
    z = np.stack([np.ones(len(texts)), top, np.log1p(total)], axis=1)
    curve = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridged logistic regression
        q = 1 / (1 + np.exp(-(z @ curve)))
        hess = (z * (q * (1 - q))[:, None]).T @ z + np.diag([1e-3, 1.0, 1.0])
        curve += np.linalg.solve(hess, z.T @ (toxic - q) - np.array([1e-3, 1.0, 1.0]) * curve)
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """About sample_rows labels of each class, chosen by a hash of the id, are joined with their texts, fetched and
    fitted, up to SAMPLE_BYTES of text. The sample of labels is bounded, so it is broadcast and the texts stay where they are."""
    labels = labels.select(F.col(doc_id).alias("__id"), F.col(toxic).cast("int").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL")
    counts = {r["__y"]: r["count"] for r in labels.groupBy("__y").count().collect()}
    if not counts:
        return fit([], np.zeros(0))
    u = F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, sample_rows / counts.get(1, 1)))).otherwise(min(1.0, sample_rows / counts.get(0, 1)))
    drawn = labels.withColumn("__u", u).filter(F.col("__u") < share).orderBy("__u", "__id", "__y").limit(4 * sample_rows)
    texts = docs.select(F.col(doc_id).alias("__i"), F.col(text).alias("__t")).filter("__t IS NOT NULL").join(F.broadcast(drawn), F.col("__i") == F.col("__id"))
    # lengths first, then the texts that fit
    sizes = texts.select("__u", F.octet_length("__t").alias("n")).orderBy("__u", "n").limit(4 * sample_rows).collect()
    total = np.cumsum([r["n"] for r in sizes])
    fit_in = int(np.searchsorted(total, SAMPLE_BYTES, side="right"))
    if fit_in < len(sizes):
        texts = texts.filter(F.col("__u") < sizes[fit_in]["__u"])
    rows = texts.select(F.col("__t").alias("t"), F.col("__y").alias("y"), F.col("__u").alias("u")).orderBy("u", "t", "y").limit(4 * sample_rows).collect()
    model = fit([r["t"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64))
    ones = sum(r["y"] for r in rows)
    if len(counts) == 2 and 0 < ones < len(rows):  # classes were sampled at different rates
        model.curve[0] += np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones))
    return model


@guarded
def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """The kept columns (by default all) with score, predicted, n_spans and spans (start:end, comma-joined)."""
    new = ("score", "predicted", "n_spans", "spans")
    cols = keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in new]
    base = docs.select(*cols, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            top, total, count, said = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), [""] * n
            for lo, hi, b, off in K.chunks(batch.column(batch.num_columns - 1)):
                start, end, row, code = tokens(b, off)
                emission = _scores(m, code)
                hit = np.flatnonzero(~np.isnan(emission))
                if not len(hit):
                    continue
                bounds = K.row_bounds(row, hi - lo)
                r = row[hit]
                p = marginals(m, emission[hit], hit - bounds[r], r, np.diff(bounds))
                np.maximum.at(top, r + lo, p)
                np.add.at(total, r + lo, p)
                bad = hit[p >= SPAN_MARGINAL]
                np.add.at(count, row[bad] + lo, 1)
                for k in bad:
                    at = off[row[k]]
                    head = int(((b[at : start[k]] & 0xC0) != 0x80).sum())
                    size = int(((b[start[k] : end[k]] & 0xC0) != 0x80).sum())
                    said[row[k] + lo] += ("," if said[row[k] + lo] else "") + f"{head}:{head + size}"
            q = 1 / (1 + np.exp(-(m.curve[0] + m.curve[1] * top + m.curve[2] * np.log1p(total))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(q), pa.array((q >= 0.5).astype(np.int32)), pa.array(count), pa.array(said, pa.string())],
                names=[*batch.schema.names[:-1], *new],
            )

    return base.mapInArrow(judge, ", ".join(filter(None, [schema, "score double, predicted int, n_spans long, spans string"])))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model = train(docs.filter(~held_out()), labels)
    return score(docs, model, keep=[F.col("doc_id"), held_out().alias("held_out")])


ORACLE_SQL = None
