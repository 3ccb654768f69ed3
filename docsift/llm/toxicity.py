"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A word's input is an embedding of its own, if the sample knows it (word input), next to
the mean embedding of the hashes of its three-byte pieces (character input). Windows of
WINDOW words, each overlapping the next, run through the network in both directions; attention
weighs their states; a text's score is that of its worst window. A task computes inputs
once for each distinct word of a stretch of texts and runs all its windows side by side.

The network is fitted in one task on a bounded sample of labelled texts. A toxic text
need not be toxic throughout: after the first rounds, only the windows of a toxic text
that look worst count as such, while every window of a clean text is clean.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructType

from . import segments

WINDOW, STRIDE = 64, 48  # words
PIECES = 1 << 13  # buckets of the character embedding
COMMON = 3  # texts of the sample in which a word with an embedding of its own occurs
WIDTH, HIDDEN = 8, 8  # of each embedding; of each direction's state
TOGETHER = 4096  # windows that run side by side

# The sample to fit on: labelled texts of each class, in order of a hash of the id.
SAMPLE, SAMPLE_BYTES = 1000, 20_000
LEAST_APART = 50  # toxic texts set apart from which on the border between the classes is set on these alone
ROUNDS, STEPS, BATCH, RATE, SEED = 6, 200, 384, 0.015, 7  # more rounds for small samples, to STEPS batches
APART = 5  # every so manieth text of the sample only sets the border between the classes

Model = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Texts:
    """Texts as numbers of distinct words, with the pieces of those."""

    def __init__(self, texts: pa.Array):
        words = segments.Words(texts, segments.NO_ALNUM)
        known, where, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.first = words.first
        self.known = known
        size = words.end[where] - words.start[where]
        self.begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(words.start[where] - self.begin, size)
        table = segments.byte_values(True)
        middle = table[words.data[at]]
        before, after = np.zeros_like(middle), np.zeros_like(middle)
        before[1:], after[:-1] = middle[:-1], middle[1:]
        before[self.begin] = 0
        after[self.begin + size - 1] = 0
        piece = segments.mixed(before * np.uint64(3) + middle * np.uint64(5) + after * np.uint64(7))
        self.piece, self.size = (piece % np.uint64(PIECES)).astype(np.int64), size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of every window; a text without words has none."""
        n = np.diff(self.first)
        more = np.maximum(0, -(-(n - WINDOW) // STRIDE))  # beside the first one
        count = np.where(n > 0, more + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # The last window ends with the text.
        start = np.minimum(step * STRIDE, np.maximum(n[row] - WINDOW, 0))
        return row, self.first[row] + start, np.minimum(n[row], WINDOW)

    def laid_out(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (place, window) and which places are filled."""
        place = np.arange(int(length.max()))[:, None]
        filled = place < length[None, :]
        return self.word[np.where(filled, start[None, :] + place, start[None, :])], filled


def new_model(rng: np.random.Generator, common: np.ndarray) -> Model:
    """``common``: sorted hashes of the words with an embedding; the last is that of all others."""
    def r(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    model = {"word": np.zeros((len(common) + 1, WIDTH), np.float32), "piece": r(PIECES, WIDTH, scale=0.1), "v": r(2 * HIDDEN, scale=0.3), "w": r(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
    for d in "fb":
        model |= {"x" + d: r(2 * WIDTH, 3 * HIDDEN, scale=0.3), "u" + d: r(HIDDEN, 3 * HIDDEN, scale=0.3), "c" + d: np.zeros(3 * HIDDEN, np.float32)}
    return model


def places_of(common: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(common, known)
    return np.where((at < len(common)) & (np.append(common, 0)[at] == known), at, len(common)).astype(np.int64)


def inputs(model: Model, place: np.ndarray, piece: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word and character input of distinct words."""
    if not len(place):
        return np.zeros((0, 2 * WIDTH), np.float32)
    spelled = np.add.reduceat(model["piece"][piece], begin, axis=0) / size[:, None].astype(np.float32)
    return np.concatenate([model["word"][place], spelled], axis=1)


def run(model: Model, gates: dict[str, np.ndarray], word: np.ndarray, filled: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, dict]:
    """States (place, window, 2 * HIDDEN), logits, and with ``keep`` what gradients need."""
    places, n = word.shape
    states, kept, whole = np.empty((places, n, 2 * HIDDEN), np.float32), {"f": {}, "b": {}}, bool(filled.all())
    for d, order in (("f", range(places)), ("b", range(places - 1, -1, -1))):
        h, u, side = np.zeros((n, HIDDEN), np.float32), model["u" + d], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        for t in order:
            g, a = gates[d][word[t]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep:
                kept[d][t] = (h, z, r, new, a[:, 2 * HIDDEN :])
            after = new + z * (h - new)
            h = after if whole else np.where(filled[t][:, None], after, h)
            states[t][:, side] = h
    weight = states @ model["v"]
    if not whole:
        weight = np.where(filled, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnk->nk", weight, states)
    return states, pooled @ model["w"] + model["b"], {"kept": kept, "weight": weight, "pooled": pooled} if keep else {}


def gates_of(model: Model, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ model["x" + d] + model["c" + d] for d in "fb"}


def gradients(model: Model, gates: dict, word: np.ndarray, filled: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted log loss, and those of the distinct words' gates."""
    states, logit, s = run(model, gates, word, filled, True)
    away = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    alpha = s["weight"]
    out = {"w": s["pooled"].T @ away, "b": away.sum(keepdims=True)}
    d_pooled = away[:, None] * model["w"]
    d_alpha = np.einsum("nk,tnk->tn", d_pooled, states)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    d_states = alpha[:, :, None] * d_pooled + d_score[:, :, None] * model["v"]
    out["v"] = np.einsum("tn,tnk->k", d_score, states)
    order = np.argsort(word, axis=None, kind="stable")
    edges = np.flatnonzero(np.diff(word.ravel()[order], prepend=-1))
    present = word.ravel()[order][edges]
    places = word.shape[0]
    d_gates = {}
    for d, back in (("f", range(places - 1, -1, -1)), ("b", range(places))):
        u, dh = model["u" + d], np.zeros((word.shape[1], HIDDEN), np.float32)
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        du, each = np.zeros_like(u), np.empty((*word.shape, 3 * HIDDEN), np.float32)
        for t in back:
            h, z, r, new, a = s["kept"][d][t]
            dh = dh + d_states[t][:, side]
            on = filled[t][:, None]
            through = dh * on
            dn = through * (1 - z) * (1 - new * new)
            dz, dr = through * (h - new) * z * (1 - z), dn * a * r * (1 - r)
            each[t] = np.concatenate([dz, dr, dn], axis=1)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ da
            dh = np.where(on, through * z + da @ u.T, dh)
        out["u" + d] = du
        d_gates[d] = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order], edges, axis=0)
    return out | {"gates": d_gates}, present


class Adam:
    def __init__(self, model: Model):
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2))
        self.n = 0

    def step(self, model: Model, grad: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            model[k] -= rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """The network for whole texts and their labels; None unless both labels occur."""
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(SEED)
    data = Texts(pa.array(texts, pa.string()))
    row, start, length = data.windows()
    doc = np.repeat(np.arange(len(label)), np.diff(data.first))
    often = np.bincount(np.unique(doc * len(data.known) + data.word) % max(1, len(data.known)), minlength=len(data.known))
    common = data.known[often >= COMMON]
    model, place = new_model(rng, common), places_of(common, data.known)
    adam, fitted = Adam(model), np.arange(len(label)) % APART != 0
    if len(np.unique(label[fitted])) < 2 or len(np.unique(label[~fitted])) < 2:
        fitted = np.ones(len(label), bool)
    toxic = label[row] > 0
    rounds = max(ROUNDS, -(-STEPS * BATCH // max(1, int(fitted[row].sum()))))
    for turn in range(rounds):
        use = fitted[row]
        if turn >= rounds // 3:  # of a toxic text, its two worst windows
            score = logits(model, place, data, start, length)
            order = np.lexsort((-score, row))
            nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            use[order[(nth >= 2) & toxic[order]]] = False
        order = rng.permutation(np.flatnonzero(use))
        share = toxic[order].mean()
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            word, filled = data.laid_out(start[i], length[i])
            present, word = np.unique(word, return_inverse=True)
            size = data.size[present]
            begin = np.cumsum(size) - size
            piece = data.piece[np.arange(int(size.sum())) + np.repeat(data.begin[present] - begin, size)]
            x = inputs(model, place[present], piece, begin, size)
            hidden = rng.random(len(present)) < 0.5  # words known by their spelling only
            x[hidden, :WIDTH] = 0
            weight = np.where(toxic[i], 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(i))
            grad, _ = gradients(model, gates_of(model, x), word.reshape(filled.shape), filled, toxic[i].astype(np.float32), weight)
            d_gates, dx = grad.pop("gates"), np.zeros_like(x)
            for d in "fb":
                grad |= {"x" + d: x.T @ d_gates[d], "c" + d: d_gates[d].sum(0)}
                dx += d_gates[d] @ model["x" + d].T
            dx[hidden | (place[present] == len(common)), :WIDTH] = 0
            words, pieces = np.zeros_like(model["word"]), np.zeros_like(model["piece"])
            per_piece = np.repeat(dx[:, WIDTH:] / size[:, None], size, axis=0)
            for k in range(WIDTH):
                words[:, k] = np.bincount(place[present], dx[:, k], len(words))
                pieces[:, k] = np.bincount(piece, per_piece[:, k], PIECES)
            adam.step(model, grad | {"word": words, "piece": pieces}, RATE * (1 - turn / rounds))
    # The border between the classes' worst windows, where the mean of both classes' rates among
    # the texts that were set apart is best, however rare one class is.
    worst = np.full(len(label), -np.inf)
    np.maximum.at(worst, row, logits(model, place, data, start, length))
    # Too few toxic texts set apart say nothing; then all of the sample counts.
    apart = ~fitted if (label[~fitted] == 1).sum() >= LEAST_APART else np.ones_like(fitted)
    seen = np.isfinite(worst) & apart
    order = np.argsort(worst[seen], kind="stable")
    value, positive = worst[seen][order], label[seen][order]
    caught, passed = positive / max(1, positive.sum()), (1 - positive) / max(1, (1 - positive).sum())
    right = np.round(np.concatenate([[0.0], np.cumsum(passed - caught)]), 12)
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    model["b"] -= np.float32(0 if not len(value) else value[0] - 1 if k == 0 else value[-1] + 1 if k == len(value) else (value[k - 1] + value[k]) / 2)
    return model | {"common": common}


def logits(model: Model, place: np.ndarray, data: Texts, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The logit of every window."""
    gates = gates_of(model, inputs(model, place, data.piece, data.begin, data.size))
    out = np.empty(len(start), np.float32)
    order = np.argsort(length, kind="stable")  # short windows together
    for lo in range(0, len(order), TOGETHER):
        i = order[lo : lo + TOGETHER]
        out[i] = run(model, gates, *data.laid_out(start[i], length[i]), False)[1]
    return out


def scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    """The worst window's probability for every text; 0 for texts without words or without a model."""
    out = np.zeros(len(texts))
    if model is None or not len(texts):
        return out
    for lo, hi in segments.stretches(texts):
        data = Texts(texts[lo:hi])
        row, start, length = data.windows()
        if len(row):
            worst = np.full(hi - lo, -np.inf)
            np.maximum.at(worst, row, logits(model, places_of(model["common"], data.known), data, start, length))
            out[lo:hi] = sigmoid(worst)
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on at most SAMPLE labelled texts of each class with at most SAMPLE_BYTES bytes.

    The sample is the same in every run. Held-out rows, null ids and null labels are left
    out; of an id with several such texts, the smallest counts. None if the labels have one
    class only. One task holds the sample, which is bounded, and returns the model.
    """
    marks = labels.select(labels[doc_id].alias("doc_id"), labels[target].cast("int").alias("label"))
    marks = marks.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out()).distinct()
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = texts.select("doc_id").join(marks, "doc_id").distinct().withColumn("nth", F.row_number().over(order))
    chosen = F.broadcast(known.filter(F.col("nth") <= SAMPLE).drop("nth"))  # 2 * SAMPLE rows at most
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = rows.repartition(1).mapInArrow(learned, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, label, text) -> one row with their model, whatever their order."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        model = fit(rows.column("text").to_pylist(), rows.column("label").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with its ``out`` column (0 to 1, higher: likelier toxic), without a shuffle.

    The whole text counts, however long. Null texts and texts without letters or digits
    score 0, as everything does without a model. Repeated rows score alike; an empty
    table gives no rows; a column that bears the name ``out`` is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    at = docs.columns.index(text)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(shared.value, batch.column(at)), pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(put, StructType([*docs.schema.fields]).add(out, DoubleType()))
