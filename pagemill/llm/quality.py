"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage of the whole text is encoded
as a vector of FEATURES surface statistics: counts over its bytes, repeated words and word shapes,
none of which names a word. A hidden layer represents it; gated
attention weighs the passages of a bag; the weighted sum gives the score. All weights are learned
together from labels of documents, by Adam on all passages of at most TRAIN_DOCS labelled documents
(a bound of the fit only), in minibatches of about BATCH_PASSAGES passages.

A null or empty text is a bag with one passage without words, and is scored like any other. If the
labels have one value or none, every score is their smoothed mean. Repeated rows get equal scores and
count once in the fit; an empty table has no scores; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mix, ship, slices, span_hashes, text_arrays, word_spans
from pagemill.llm.labelled import Adam, sample, sigmoid

PASSAGE_WORDS = 64
TRAIN_DOCS = 3000
#: STEPS of Adam, or EPOCHS rounds over all minibatches if that is more.
BATCH_PASSAGES, STEPS, EPOCHS = 1 << 16, 250, 8
HIDDEN, ATTENTION = 16, 8
_SHAPES = 32

#: Byte classes: lower, upper, digit, symbol, exclaiming, stop, bar, other ASCII, beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+{}[]\\/", b"!?", b".,;:'\"()-", b"|")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8
_N_CLASS = 9
FEATURES = _N_CLASS + 9 + _SHAPES


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage of each text, and the text of each passage, in order."""
    n = len(offsets) - 1
    starts, lens, text = word_spans(buf, offsets)
    words = np.bincount(text, minlength=n)
    bags = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_bag = np.cumsum(bags) - bags
    index = np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words)
    bag = first_bag[text] + index // PASSAGE_WORDS
    m = int(bags.sum())
    out = np.zeros((m, FEATURES), np.float32)
    of = np.repeat(np.arange(n), bags)
    if not len(starts):
        return out, of
    size = np.maximum(np.bincount(bag, minlength=m), 1)[:, None]
    firsts = np.flatnonzero(np.diff(bag, prepend=-1))
    ends = (starts + lens)[np.append(firsts[1:], len(bag)) - 1]
    full = bag[firsts]
    kinds = _CLASS[buf]
    chars = np.zeros((m, _N_CLASS))
    for k in range(_N_CLASS):
        seen = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        chars[full, k] = seen[ends] - seen[starts[firsts]]
    chars[:, 7] = np.maximum(chars[:, 7] - size[:, 0], 0)  # without the spaces between words
    out[:, :_N_CLASS] = chars / np.maximum(chars.sum(1, keepdims=True), 1)
    h = span_hashes(buf, starts, lens)
    total = lambda v: np.bincount(bag, v, minlength=m)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (bag[1:] == bag[:-1])
    order = np.argsort(own := mix(h ^ mix(text.astype(np.uint64) + np.uint64(7))), kind="stable")
    later = np.zeros(len(h))
    later[order[1:]] = own[order][1:] == own[order][:-1]
    two = np.zeros(len(h), np.uint64)
    two[1:] = mix(h[:-1] + np.uint64(3) * h[1:]) ^ mix(text[1:].astype(np.uint64) + np.uint64(9))
    order = np.argsort(two, kind="stable")
    pair = np.zeros(len(h))
    pair[order[1:]] = two[order][1:] == two[order][:-1]
    in_bag = np.zeros(len(h))
    order = np.argsort(own := mix(h ^ mix(bag.astype(np.uint64))), kind="stable")
    in_bag[order[1:]] = own[order][1:] == own[order][:-1]
    head, tail = kinds[starts].astype(np.int64), kinds[starts + lens - 1].astype(np.int64)
    mean = total(lens) / size[:, 0]
    stats = [total(same), total(in_bag), total(later), total(pair), total(tail == 5), total((head == 1) & (kinds[np.minimum(starts + 1, len(buf) - 1)] == 1) & (lens > 1)), total(lens == 1)]
    for k, v in enumerate(stats):
        out[:, _N_CLASS + k] = v / size[:, 0]
    out[:, _N_CLASS + 7] = mean / 10
    out[:, _N_CLASS + 8] = np.log1p(np.bincount(bag, minlength=m)) / 5
    shape = (head * 31 + tail * 7 + np.minimum(lens, 12) // 4) % _SHAPES
    shapes = np.bincount(bag * _SHAPES + shape, minlength=m * _SHAPES).reshape(m, _SHAPES)
    out[:, _N_CLASS + 9 :] = shapes / size
    return out, of


class GatedAttention:
    """Weights of the network; of[i] is the bag of passage i, and bags are numbered from 0 in order."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.p = {"w": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": init(HIDDEN, ATTENTION), "u": init(HIDDEN, ATTENTION), "a": np.zeros(ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.mean, self.std, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def _forward(self, x: np.ndarray, of: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        firsts = np.searchsorted(of, np.arange(n))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), np.diff(np.append(firsts, len(of)))))
        a = e / np.add.reduceat(e, firsts)[of]
        z = np.add.reduceat(a[:, None] * h, firsts)
        return h, t, g, a, z, firsts

    def score(self, x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the attention on each passage."""
        if self.constant is not None:
            return np.full(n, self.constant), 1 / np.bincount(of, minlength=n)[of]
        _, _, _, a, z, _ = self._forward(np.clip((x - self.mean) / self.std, -8, 8), of, n)
        return sigmoid(z @ self.p["c"] + self.p["d"]), a

    def gradient(self, x: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags, by each weight; x is standardised."""
        n, p = len(y), self.p
        h, t, g, a, z, firsts = self._forward(x, of, n)
        dl = (sigmoid(z @ p["c"] + p["d"]) - y) / n
        dz = dl[:, None] * p["c"]
        da = (h * dz[of]).sum(1)
        de = a * (da - np.add.reduceat(a * da, firsts)[of])
        dh = a[:, None] * dz[of]
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> GatedAttention:
        """bags: of each document its passages' vectors."""
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 0.5) / (len(y) + 1))
            return self
        n = sum(map(len, bags))
        self.mean = sum(x.sum(0, dtype=np.float64) for x in bags) / n
        self.std = np.sqrt(sum(((x - self.mean) ** 2).sum(0) for x in bags) / n) + 1e-3
        p = self.p
        p["d"][0] = np.log(y.mean() / (1 - y.mean()))
        adam = Adam(p, 0.02)
        order = np.random.default_rng(1).permutation(len(bags))
        group = np.cumsum([len(bags[i]) for i in order]) // BATCH_PASSAGES
        batches = np.split(order, np.flatnonzero(np.diff(group)) + 1)
        for step in range(max(STEPS, EPOCHS * len(batches))):
            if step == 0 or len(batches) > 1:
                own = batches[step % len(batches)]
                x = np.clip((np.concatenate([bags[i] for i in own]) - self.mean) / self.std, -8, 8)
                of = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            grads = self.gradient(x, of, y[own])
            adam.step({k: v + 1e-4 * p[k] * (k not in "bd") for k, v in grads.items()})
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, held_out: int = 2, train_docs: int = TRAIN_DOCS) -> GatedAttention:
    """Learns from labelled documents outside the held-out fold."""
    ship(docs.sparkSession)

    def run(batches):
        for part in slices(batches):
            x, of = encode(*text_arrays(part.column("text")))
            at = np.searchsorted(of, np.arange(part.num_rows + 1)).tolist()
            rows = [x[i:j].tobytes() for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    rows = sample(docs, labels, label, mod, held_out, train_docs).mapInArrow(run, "doc_id long, y int, x binary").collect()  # train_docs rows at most
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return GatedAttention().fit(bags, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """doc_id, score, attention: the weight of each passage."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches):
        for part in slices(batches):
            x, of = encode(*text_arrays(part.column("text")))
            s, a = shared.value.score(x, of, part.num_rows)
            at = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
            weights = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(a, pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), weights], ["doc_id", "score", "attention"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, attention array<double>")
