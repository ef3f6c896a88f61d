"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so words are labelled first: a word, or its first 4 to 6
bytes, marks toxicity if it is in at least SUPPORT toxic training documents (copies
counted once) and nearly all documents with it are toxic.  In toxic documents the words
that have a mark are labelled toxic, all other words clean.  A two-state CRF with
the hashes of the word and its beginnings as features is trained on those labels.
Forward-backward gives each word's marginal; a document's score is a logistic function of
its expected toxic words and its surest word, and runs of words of marginal 0.5 or more are
its spans, in bytes of the UTF-8 text.

Plan.  The classifier is fitted on the driver on at most ``sample`` labelled documents and
``sample_bytes`` of text (parameters of :func:`train`), drawn by a hash of the id; a text that no
longer fits is passed over and the draw goes on; weights (2**BITS floats) go to the
workers; scoring is one scan.  The chain is solved exactly in blocks: 2x2 products
of all blocks advance together, a carry goes from block to block, then all words follow.

Defined cases: null and empty texts have no words and get the score of no toxic word;
with no labelled row, or labels of one kind only, every score is the share of
toxic labels (0 without labels); a document labelled twice counts as toxic if one label
is; null labels are left out; of rows with a labelled id and different texts one is
drawn, always the same; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import blocks, lowered, pieces, tidy, words

BITS, BLOCK = 18, 256
SAMPLE, SAMPLE_BYTES = 6000, 24 << 20
SUPPORT, PURITY, STEPS = 6, 0.97, 40
BEGINNINGS = (4, 5, 6)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(4 x words) feature hashes, first word of each text, and the words' byte places within their text."""
    cols, counts, a, b = [], np.zeros(len(texts), np.int64), [], []
    for i, j, part in blocks(texts):
        at = 0
        for piece in [part] if j - i > 1 or len(part[0]) <= 1 << 19 else [[p] for p in pieces(part[0])]:
            w = words(piece)
            cols.append(np.stack([w.hashes, *(w.prefix(n) for n in BEGINNINGS)]))
            n = np.diff(w.first)
            counts[i : i + len(n)] += n
            base = np.repeat(np.concatenate(([0], np.cumsum([len(t) + 1 for t in piece])))[: len(n)], n) - at
            a.append(w.starts - base)
            b.append(w.ends - base)
            if len(piece) == 1:
                at += len(piece[0])
    none = np.empty(0, np.int64)
    return np.concatenate(cols, axis=1) if cols else np.empty((4, 0), np.uint64), np.concatenate(([0], np.cumsum(counts))), np.concatenate([none, *a]), np.concatenate([none, *b])


def slots(hashes: np.ndarray) -> np.ndarray:
    """Each feature's weight: its kind and hash folded into 2**BITS places."""
    kind = np.arange(len(hashes), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return ((hashes ^ kind) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


def marginals(score: np.ndarray, opens: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(word is toxic) and the expected number of each transition.

    ``score``: log-odds of toxic from the word itself; ``opens``: it is a text's first;
    ``step``: 2x2 log weights from state to state; ``start``: log-odds of a text's first word.
    """
    n = len(score)
    if not n:
        return score, np.zeros((2, 2))
    size = min(BLOCK, n)
    count = -(-n // size)
    x = np.zeros(count * size)
    x[:n] = np.clip(score, -30, 30)
    x = np.exp(x).reshape(count, size).T
    new = np.ones(count * size, bool)
    new[:n] = opens
    new = new.reshape(count, size).T
    e = np.exp(step)
    t = np.empty((2, 2, size, count))  # from, to: a text's first word forgets what was before
    t[0, 0], t[1, 0] = np.where(new, 1.0, e[0, 0]), np.where(new, 1.0, e[1, 0])
    t[0, 1], t[1, 1] = np.where(new, np.exp(start), e[0, 1]) * x, np.where(new, np.exp(start), e[1, 1]) * x
    p00, p01, p10, p11 = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for k in range(size):
        a, b, c, d = t[0, 0, k], t[0, 1, k], t[1, 0, k], t[1, 1, k]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        s = 1.0 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * s, p01 * s, p10 * s, p11 * s
    r, q = np.empty(count), np.empty(count)
    total = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    f = 0.0
    for k, (a, b, c, d) in enumerate(total):  # ratio toxic : clean, before and after each block
        r[k] = f
        f = (b + d * f) / max(a + c * f, 1e-300)
    f = 1.0
    for k in range(count - 1, -1, -1):
        q[k] = f
        a, b, c, d = total[k]
        f = (c + d * f) / max(a + b * f, 1e-300)
    ahead, back = np.empty((size, count)), np.empty((size, count))
    for k in range(size):
        r = (t[0, 1, k] + t[1, 1, k] * r) / (t[0, 0, k] + t[1, 0, k] * r)
        ahead[k] = r
    for k in range(size - 1, -1, -1):
        back[k] = q
        q = (t[1, 0, k] + t[1, 1, k] * q) / (t[0, 0, k] + t[0, 1, k] * q)
    both = (ahead * back).T.reshape(-1)[:n]
    p = both / (1 + both)
    # transitions inside texts
    flat = [t[i, j].T.reshape(-1)[:n] for i in (0, 1) for j in (0, 1)]
    inside = np.flatnonzero(~opens)
    before, after = ahead.T.reshape(-1)[inside - 1], back.T.reshape(-1)[inside]
    w = [flat[0][inside], flat[1][inside] * after, flat[2][inside] * before, flat[3][inside] * before * after]
    z = w[0] + w[1] + w[2] + w[3]
    return p, np.array([float((v / z).sum()) for v in w]).reshape(2, 2)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: log of the expected toxic words, and the surest word's log-odds (both bounded)."""
    n = len(first) - 1
    total = np.concatenate(([0.0], np.cumsum(p)))
    expected = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    top = np.zeros(n)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(expected + 0.05), np.log(top / (1 - top)) / 4], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    start: float
    bias: float
    document: np.ndarray  # of the logistic function: two features and a constant
    constant: float | None = None

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, first, a, b = features(texts)
        p, _ = marginals(self.bias + self.weights[slots(h)].sum(axis=0), opening(first, h.shape[1]), self.step, self.start)
        return p, first, a, b

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        z = document_features(p, first) @ self.document[:2] + self.document[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def marks(texts: list[bytes], toxic: np.ndarray) -> list[np.ndarray]:
    """For each kind of feature the hashes that mark toxicity."""
    seen: set[tuple] = set()
    stats: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(1 + len(BEGINNINGS))]
    for i, _, part in blocks(texts):
        h, first, _, _ = features(part)
        for k in range(len(part)):
            # copies and near copies share their two smallest word hashes: the first of them counts
            own = h[:, first[k] : first[k + 1]]
            bad = bool(toxic[i + k])
            key = (bad, *np.unique(own[0])[:2].tolist())
            if key in seen:
                continue
            seen.add(key)
            for kind, row in zip(stats, own, strict=True):
                kind.append((np.unique(row), bad))
    out = []
    for kind in stats:
        found = []
        for bad in (True, False):
            rows = [x for x, is_bad in kind if is_bad == bad]
            found.append(np.unique(np.concatenate(rows) if rows else np.empty(0, np.uint64), return_counts=True))
        kind.clear()
        (of_toxic, bad_count), (of_clean, clean_count) = found
        at = np.minimum(np.searchsorted(of_clean, of_toxic), max(len(of_clean) - 1, 0))
        clean = np.where(of_clean[at] == of_toxic, clean_count[at], 0) if len(of_clean) else np.zeros(len(of_toxic), np.int64)
        out.append(of_toxic[(bad_count >= SUPPORT) & (bad_count >= PURITY * (bad_count + clean))])
    return out


def opening(first: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words are the first of a text."""
    out = np.zeros(n, bool)
    out[first[:-1][first[1:] > first[:-1]]] = True
    return out


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Train on whole texts and their 0/1 labels."""
    nothing = Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), 0.0, 0.0, np.zeros(3))
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        nothing.constant = float(toxic.mean()) if len(toxic) else 0.0
        return nothing
    marked = marks(texts, toxic)
    parts, total, hits, seen = [], 0, 0, np.zeros((2, 2))
    for i, j, part in blocks(texts):
        h, first, _, _ = features(part)
        y = np.logical_or.reduce([np.isin(row, found) for row, found in zip(h, marked, strict=True)]) & np.repeat(toxic[i:j], np.diff(first))
        opens = opening(first, len(y))
        inside = np.flatnonzero(~opens)
        seen += np.bincount(2 * y[inside - 1] + y[inside], minlength=4).reshape(2, 2)
        total, hits = total + len(y), hits + int(y.sum())
        parts.append((slots(h).astype(np.int32), y, opens, first))
    share = float(np.clip(hits / max(total, 1), 1e-6, 0.5))
    w, step, bias = np.zeros(1 << BITS), np.zeros((2, 2)), float(np.log(share / (1 - share)))
    start, heat, heat_step, heat_bias = 0.0, np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    scale = 1.0 / max(1, hits)
    for _ in range(STEPS):  # AdaGrad on the log-likelihood for each toxic word, L2 on the weights
        g, expected, gb = np.zeros(1 << BITS), np.zeros((2, 2)), 0.0
        for at, y, opens, _ in parts:
            p, moved = marginals(bias + w[at].sum(axis=0), opens, step, start)
            gap = y - p
            for row in at:
                g += np.bincount(row, gap, 1 << BITS)
            expected += moved
            gb += float(gap.sum())
        g = g * scale - 1e-4 * w
        heat += g * g
        w += 0.8 * g / np.sqrt(heat)
        gs = (seen - expected) * scale - 1e-3 * step
        heat_step += gs * gs
        step += 0.1 * gs / np.sqrt(heat_step)
        gb *= scale
        heat_bias += gb * gb
        bias += 0.1 * gb / np.sqrt(heat_bias)
    model = Model(w.astype(np.float32), step, start, bias, np.zeros(3))
    z = [document_features(marginals(bias + model.weights[at].sum(axis=0), opens, step, start)[0], first) for at, _, opens, first in parts]
    x = np.column_stack([np.concatenate(z), np.ones(len(texts))])
    beta = np.zeros(3)
    for _ in range(25):  # Newton's method, lightly regularised as the classes may be apart
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        pull = np.array([0.01, 0.01, 0.0]) * len(texts) * 0.05
        hess = (x * (mu * (1 - mu))[:, None]).T @ x + np.diag(pull + 1e-6)
        beta = beta + np.linalg.solve(hess, x.T @ (toxic - mu) - pull * beta)
    model.document = beta
    return model


def _score(model: Model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, found = lowered(batch.column(1)), [], []
            for _, _, part in blocks(texts, 1 << 20):
                p, first, a, b = model.words(part)
                scores += model.score(p, first).tolist()
                if spans:
                    hot = p >= 0.5
                    for k in range(len(part)):
                        own = np.flatnonzero(hot[first[k] : first[k + 1]]) + first[k]
                        cut = np.flatnonzero(np.diff(own) > 1)
                        lo, hi = own[np.concatenate(([0], cut + 1))] if len(own) else own, own[np.concatenate((cut, [len(own) - 1]))] if len(own) else own
                        found.append([{"begin": int(a[i]), "end": int(b[j])} for i, j in zip(lo, hi, strict=True)])
            columns = [batch.column(0), pa.array(scores, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "spans"][: len(columns)])

    return run


def train(docs: DataFrame, labels: DataFrame, *, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled ``rows`` (a condition on ``id``; default: all)."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    if rows is not None:
        marked = marked.filter(rows)
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    if not total:
        return fit([], np.zeros(0, bool))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)) + 1
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked.filter(draw)), "id")
    texts, toxic, held = [], [], 0
    one = drawn.groupBy("id").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("id", "r.*")
    for r in one.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes).orderBy(F.xxhash64("id"), "id").toLocalIterator():
        text = (r["text"] or "").encode().lower()
        if held + len(text) > sample_bytes:
            continue
        held += len(text)
        texts.append(text)
        toxic.append(r["toxic"] > 0)
    return fit(texts, np.array(toxic, bool))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, spans) for every row; spans hold begin and end, in bytes of the UTF-8 text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, score double" + ", spans array<struct<begin: long, end: long>>" * spans
    return rows.mapInArrow(tidy(_score(model, spans)), schema)
