"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters. Features of a token are its word and its beginnings of 4, 5 and 6 bytes,
in lower case. From at most TRAIN_DOCS labelled documents outside the held-out fold (a bound of the
fit only; each doc_id and each text counts once) all features are kept that stand in MIN_DOCS toxic
documents or more, and there far more often than in others: by the log-likelihood ratio of their
document counts, MIN_RATIO or more. Where no feature reaches both, the least number of toxic documents
is lowered one by one to 1; where none reaches MIN_RATIO, there is nothing to tag. Tokens with such a feature are labelled toxic in toxic documents,
all other tokens as clean, and the field with the states clean and toxic is fitted to the windows of
WINDOW tokens around each token with a feature, equal ones counted together, and to clean windows.

Scoring runs forward and backward over every token of the whole text. Tokens without a kept feature
all share one emission, so a run of them is a power of one 2 x 2 matrix, which is taken in closed
form: the marginals are exact, and time goes by the tokens with features. The marginals of a
document are aggregated to two numbers whose logistic regression is the score; offsets of tokens
with a marginal of SPAN_AT or more are reported, neighbours joined.

A null or empty text has no tokens and is scored as a text without toxic tokens. If the labels have
one value or none, or no feature tells them apart, every score is their smoothed mean and no span is reported. Repeated rows get equal
scores; an empty table has none; columns are carried under names of their own, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, discard, quoted, ship, slices, span_hashes, text_arrays, tidy, word_spans
from pagemill.llm.labelled import Adam, sample, sigmoid

TRAIN_DOCS = 8000
MIN_DOCS, MIN_RATIO = 3, 9.0
BEGINNINGS = (4, 5, 6)
SPAN_AT = 0.5
#: STEPS of Adam on minibatches of BATCH_WINDOWS distinct windows, or EPOCHS rounds over all of them if
#: that is more.
WINDOW, BATCH_WINDOWS, STEPS, EPOCHS = 5, 1 << 14, 150, 3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for U+00C0 to U+00DE, whose UTF-8 forms differ in one bit."""
    out = _LOWER[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    out[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 0x20
    return out


def token_features(buf: np.ndarray, offsets: np.ndarray):
    """Starts, lengths and texts of tokens; hashes of their features, a column for each kind (0: none)."""
    starts, lens, text = word_spans(buf, offsets, _LETTER[buf])
    low = lower(buf)
    columns = [span_hashes(low, starts, lens) | np.uint64(1)]
    for k in BEGINNINGS:
        long = np.flatnonzero(lens > k)
        h = np.zeros(len(starts), np.uint64)
        h[long] = (span_hashes(low, starts[long], np.full(len(long), k)) + np.uint64(k)) & ~np.uint64(1) | np.uint64(2)
        columns.append(h)
    return starts, lens, text, np.stack(columns, 1)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class ToxicSpans:
    """keys: sorted feature hashes; weight: of each for the state toxic; bias: of that state;
    edges: transition weights; rule: logistic regression on the aggregates."""

    def __init__(self):
        self.keys, self.weight = np.zeros(0, np.uint64), np.zeros(0)
        self.bias, self.edges = -4.0, np.zeros((2, 2))
        self.rule, self.constant = np.array([-3.0, 0.5, 0.5]), None

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known features, -1 for others."""
        if not len(self.keys):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def emission(self, found: np.ndarray) -> np.ndarray:
        return self.bias + np.where(found >= 0, self.weight[found], 0).sum(-1)

    def gradient(self, p: dict[str, np.ndarray], found: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the windows' mean negative log likelihood. found: features (window, token, kind); y: the
        tokens' labels; weight: of each window."""
        n, length = y.shape
        known = found >= 0
        em = np.zeros((n, length, 2))
        em[:, :, 1] = p["b"] + np.where(known, p["w"][found], 0).sum(-1)
        f = [em[:, 0]]
        for t in range(1, length):
            f.append(_logsum(f[-1][:, :, None] + p["e"], 1) + em[:, t])
        z = _logsum(f[-1], 1)
        b = np.zeros((n, 2))
        d1, de = np.zeros((n, length)), np.zeros((2, 2))
        for t in range(length - 1, -1, -1):
            d1[:, t] = (np.exp(f[t][:, 1] + b[:, 1] - z) - y[:, t]) * weight
            if t:
                on = em[:, t] + b
                both = np.exp(f[t - 1][:, :, None] + p["e"] + on[:, None, :] - z[:, None, None])
                de += (both * weight[:, None, None]).sum(0)
                np.subtract.at(de, (y[:, t - 1], y[:, t]), weight)
                b = _logsum(p["e"][None] + on[:, None, :], 2)
        dw = np.bincount(found[known], np.broadcast_to(d1[:, :, None], found.shape)[known], minlength=len(p["w"]))
        total = weight.sum()
        return {"w": dw / total, "b": np.array([d1.sum() / total]), "e": de / total}

    def fit_field(self, found: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Windows as in gradient(), and as many clean ones."""
        p = {"w": np.zeros(len(self.keys)), "b": np.array([-2.0]), "e": np.zeros((2, 2))}
        adam = Adam(p, 0.1)
        order = np.random.default_rng(0).permutation(len(y))
        batches = np.array_split(order, max(1, -(-len(y) // BATCH_WINDOWS)))
        plain = np.full((1, WINDOW, found.shape[2]), -1)
        for step in range(max(STEPS, EPOCHS * len(batches))):
            own = batches[step % len(batches)]
            w = weight[own].astype(float)
            some = np.concatenate([found[own], plain]), np.concatenate([y[own], np.zeros((1, WINDOW), int)]), np.append(w, max(w.sum(), 1))
            grads = self.gradient(p, *some)
            adam.step({k: v + 1e-4 * p[k] * (k != "b") for k, v in grads.items()})
        self.weight, self.bias, self.edges = p["w"], float(p["b"][0]), p["e"]

    def marginals(self, at: np.ndarray, scores: np.ndarray, text: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """P(toxic) of tokens at positions `at` of their texts with emissions `scores`; all other
        tokens have the emission `bias`. Rows in order of text and position; tokens: of each text.
        A text starts after a clean token."""
        e = np.exp(self.edges)
        step = e * np.array([1.0, np.exp(self.bias)])  # one token without features
        half, det = (step[0, 0] + step[1, 1]) / 2, step[0, 0] * step[1, 1] - step[0, 1] * step[1, 0]
        root = np.sqrt(half * half - det)
        l1, l2 = half + root, half - root
        big = (step - l2 * np.eye(2)) / (l1 - l2)

        def power(g: np.ndarray) -> np.ndarray:
            """The g-th power of step, divided by that of its larger eigenvalue."""
            return big + ((l2 / l1) ** g)[:, None, None] * (np.eye(2) - big)

        n = len(at)
        out = np.zeros(n)
        if not n:
            return out
        first = np.flatnonzero(np.diff(text, prepend=-1))
        count = np.diff(np.append(first, n))
        own = np.exp(np.clip(scores, -40, 40))
        before = np.where(np.diff(text, prepend=-1) != 0, -1, np.concatenate([[0], at[:-1]]))
        move = power((at - before - 1).astype(float)) @ e  # over the gap, then into the token
        move[:, :, 1] *= own[:, None]
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        for r in range(int(count.max())):
            i = first[count > r] + r
            v = (ahead[i - 1] if r else np.tile([1.0, 0.0], (len(i), 1)))[:, None, :] @ move[i]
            ahead[i] = v[:, 0] / v.sum((1, 2))[:, None]
        rest = power((tokens[text[first]] - 1 - at[first + count - 1]).astype(float)).sum(2)
        for r in range(int(count.max())):
            i = first[count > r] + count[count > r] - 1 - r
            v = rest[count > r] if r == 0 else (move[i + 1] @ back[i + 1][:, :, None])[:, :, 0]
            back[i] = v / v.sum(1, keepdims=True)
        both = ahead * back
        return both[:, 1] / both.sum(1)

    @staticmethod
    def aggregate(marginal: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Of each text: 1, its log odds of a toxic token anywhere, those of its likeliest token."""
        m = np.clip(marginal, 1e-6, 1 - 1e-6)
        some = np.bincount(text, -np.log1p(-m), minlength=n)
        top = np.full(n, 1e-4)
        np.maximum.at(top, text, m)
        odds = np.log(np.expm1(np.minimum(some, 30)) + 1e-4)
        return np.stack([np.ones(n), odds, np.log(top / (1 - top))], 1)

    def fit_rule(self, x: np.ndarray, y: np.ndarray) -> None:
        w = np.array([0.0, 0.3, 0.3])
        adam = Adam({"w": w}, 0.03)
        for _ in range(800):
            adam.step({"w": x.T @ (sigmoid(x @ w) - y) / max(len(y), 1) + 1e-3 * w * [0, 1, 1]})
        w[1:] = np.maximum(w[1:], 0)
        self.rule = w

    def run(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of texts, and their toxic spans as character offsets."""
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant), [[] for _ in range(n)]
        starts, lens, text, hashes = token_features(buf, offsets)
        found = self.lookup(hashes)
        hit = np.flatnonzero((found >= 0).any(1))
        tokens = np.bincount(text, minlength=n)
        at = hit - (np.cumsum(tokens) - tokens)[text[hit]]
        m = self.marginals(at, self.emission(found[hit]), text[hit], tokens)
        scores = sigmoid(self.aggregate(m, text[hit], n) @ self.rule)
        spans: list[list[dict]] = [[] for _ in range(n)]
        bad = hit[m >= SPAN_AT]
        if len(bad):
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            last = -2
            for i, t in zip(bad.tolist(), text[bad].tolist()):
                begin, end = (int(chars[x] - chars[offsets[t]]) for x in (starts[i], starts[i] + lens[i]))
                if i == last + 1 and spans[t]:
                    spans[t][-1]["end"] = end
                else:
                    spans[t].append({"start": begin, "end": end})
                last = i
        return scores, spans


def _likelihood_ratio(na: int, nb: int) -> Column:
    """Half of G for pos of na documents against n - pos of nb; 0 where the first share isn't larger."""
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    e = (a + b) / (na + nb)
    part = lambda o, m: F.when(o > 0, o * F.log(o / m)).otherwise(0.0)
    g = part(a, na * e) + part(b, nb * e) + part(na - a, na * (1 - e)) + part(nb - b, nb * (1 - e))
    return F.when(a * nb > b * na, g).otherwise(0.0)


def windows(at: np.ndarray, found: np.ndarray, y: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of WINDOW tokens around tokens with features, their labels, and how often each
    occurs. at: places of these tokens in their texts, in order; found: features; y: labels."""
    near = WINDOW // 2
    place = at + text * (int(at.max(initial=0)) + WINDOW)  # windows of two texts never meet
    rows = np.full((len(at), WINDOW, found.shape[1] + 1), -1, np.int32)
    rows[:, :, -1] = 0
    for k in range(WINDOW):
        j = np.minimum(np.searchsorted(place, place + k - near), len(place) - 1)
        there = place[j] == place + k - near
        rows[there, k, :-1], rows[there, k, -1] = found[j[there]], y[j[there]]
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    _, first, count = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_index=True, return_counts=True)
    return rows[first, :, :-1].astype(int), rows[first, :, -1].astype(int), count


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held_out: int = 0, train_docs: int = TRAIN_DOCS) -> ToxicSpans:
    """Learns from labelled documents outside the held-out fold: one pass over the sample counts
    features on the executors, one brings its tokens that have one."""
    ship(docs.sparkSession)
    model = ToxicSpans()
    own = checkpoint(sample(docs, labels, label, mod, held_out, train_docs))

    def count(batches):
        for part in slices(batches):
            _, _, text, hashes = token_features(*text_arrays(part.column("text")))
            y = part.column("y").to_numpy(zero_copy_only=False)
            key, doc = hashes.ravel(), np.repeat(text, hashes.shape[1])
            doc, key = doc[key != 0], key[key != 0]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, toxic = np.append(key[new], np.zeros(2, np.uint64)), np.append(y[doc[new]], [0, 0])
            names, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            pos = np.bincount(inverse, toxic).astype(np.int64)
            n[0], pos[0] = part.num_rows, y.sum()  # feature 0 counts documents
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(n)], ["feature", "pos", "n"])

    counts = own.mapInArrow(count, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    counts = checkpoint(counts)
    total = counts.filter("feature = 0").first()
    if total is None or total["pos"] in (0, total["n"]):
        model.constant = 0.5 if total is None else (total["pos"] + 0.5) / (total["n"] + 1)
        discard(own, counts)
        return model
    rated = counts.filter("feature <> 0").withColumn("ratio", _likelihood_ratio(total["pos"], total["n"] - total["pos"]))
    rated = rated.filter(F.col("ratio") >= MIN_RATIO)
    most = rated.agg(F.max("pos")).first()[0]
    if most is None:
        model.constant = (total["pos"] + 0.5) / (total["n"] + 1)
        discard(own, counts)
        return model
    keys = rated.filter(F.col("pos") >= min(MIN_DOCS, most)).select("feature").collect()  # features of the bounded sample
    model.keys = np.sort(np.array([r["feature"] for r in keys], np.int64).view(np.uint64))
    model.weight = np.zeros(len(model.keys))

    def bring(batches):
        for part in slices(batches):
            _, _, text, hashes = token_features(*text_arrays(part.column("text")))
            found = model.lookup(hashes)
            tokens = np.bincount(text, minlength=part.num_rows)
            base = np.cumsum(tokens) - tokens
            hit = np.flatnonzero((found >= 0).any(1))
            rows = []
            for i in range(part.num_rows):
                own = hit[slice(*np.searchsorted(text[hit], [i, i + 1]))]
                rows.append(((own - base[i]).astype(np.int64).tobytes(), found[own].astype(np.int32).tobytes(), int(tokens[i])))
            at, f, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(at, pa.binary()), pa.array(f, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "y", "at", "found", "tokens"])

    rows = own.mapInArrow(bring, "doc_id long, y int, at binary, found binary, tokens long").collect()  # train_docs rows at most
    discard(own, counts)
    rows.sort(key=lambda r: r["doc_id"])
    kinds = 1 + len(BEGINNINGS)
    each = [np.frombuffer(r["at"], np.int64) for r in rows]
    at = np.concatenate([np.zeros(0, np.int64), *each])
    found = np.concatenate([np.zeros((0, kinds), np.int32), *(np.frombuffer(r["found"], np.int32).reshape(-1, kinds) for r in rows)])
    y = np.array([r["y"] for r in rows])
    text = np.repeat(np.arange(len(rows)), [len(p) for p in each])
    if len(at):
        model.fit_field(*windows(at, found, y[text], text))
    m = model.marginals(at, model.emission(found), text, np.array([r["tokens"] for r in rows]))
    model.fit_rule(model.aggregate(m, text, len(rows)), y)
    del rows, each, at, found, text, m
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: ToxicSpans, keep: list[str], keep_spans: bool = True) -> DataFrame:
    """The columns in keep, each as `doc.<name>`, with score and spans (character offsets)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # features of the bounded sample
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.select(*map(quoted, keep)).schema)), "score double"]) + ", spans array<struct<start:int,end:int>>" * keep_spans
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for part in slices(batches):
            s, spans = shared.value.run(*text_arrays(part.column("text")))
            out = [*(part.column(c) for c in names), pa.array(s, pa.float64())] + [pa.array(spans, span_type)] * keep_spans
            yield pa.RecordBatch.from_arrays(out, [*names, "score"] + ["spans"] * keep_spans)

    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(f"doc.{c}") for c, n in zip(keep, names)), "score", *["spans"] * keep_spans)
