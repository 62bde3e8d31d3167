"""Quality of documents by attention over their passages.

A document is a bag of passages of 64 words. Every passage is encoded by its shape, x, and by the mean of
the learned vectors of its words and word pairs, e; a gate learned from document labels alone tells how
much each passage counts; the weighted mean of the codes gives the score:

    h = tanh(W x + e + b)     a = u . (tanh(V h) * sigmoid(G h))     score = sigmoid(c . sum softmax(a) h)

Fitting takes a bounded sample of labelled documents, all passages of each, encoded on the executors;
its codes are some ten megabytes at most and fitting runs where the session lives. Scoring is one pass over all texts in
Arrow batches, whole texts, without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import words
from foliomill.sources import workspace

PASSAGE_WORDS = 64
SAMPLE_EACH = 2500       # labelled documents of either class that the fit takes at most
SAMPLE_PASSAGES = 40_000  # of either class: documents are taken until they have as many, each one whole
SCORED_TOGETHER = 256    # documents whose passages are held in memory at once
PASSAGES_TOGETHER = 1024  # passages whose word vectors are held in memory at once
BUCKETS = 24           # hashed words
HIDDEN, GATE = 24, 12
WORD_BUCKETS = 8192      # vectors of hashed words and word pairs
EPOCHS, BATCH, RATE, DECAY = 24, 128, 0.01, 1e-4

# Byte classes: lower case, upper case, digit, blank, line end, sentence marks, ! and ?, quotes and
# brackets, other ASCII marks one by one in groups, and bytes of other letters.
_GROUPS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n",
    ".,;:", "!?", "\"'()[]{}", "#", "*", "$%&", "|", "<>", "-_=+~/\\^@`",
)
CLASSES = len(_GROUPS) + 1
_CLASS = np.full(256, CLASSES - 1, np.int64)
for _at, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _at
FEATURES = CLASSES + 8 + BUCKETS


class Bag(NamedTuple):
    """A document: shape of every passage, and the buckets of the words and pairs of each."""

    x: np.ndarray
    buckets: np.ndarray
    first: np.ndarray  # where a passage's buckets begin

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.x.tobytes(), self.buckets.tobytes(), self.first.astype(np.int64).tobytes()


def unpacked(x: bytes, buckets: bytes, first: bytes) -> Bag:
    return Bag(np.frombuffer(x, np.float32).reshape(-1, FEATURES), np.frombuffer(buckets, np.uint16), np.frombuffer(first, np.int64))


def joined(bags: list[Bag]) -> Bag:
    sizes = [len(bag.buckets) for bag in bags]
    starts = np.cumsum([0] + sizes[:-1])
    return Bag(np.vstack([bag.x for bag in bags]), np.concatenate([bag.buckets for bag in bags]),
               np.concatenate([bag.first + start for bag, start in zip(bags, starts)]))


def encode(text: str | None) -> Bag:
    """Every passage of a text; a text without words is one passage of zeros."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = words.spans(data)
    n = len(starts)
    if not n:
        return Bag(np.zeros((1, FEATURES), np.float32), np.zeros(1, np.uint16), np.zeros(1, np.int64))
    hashed = words.hashes(data, starts, ends)
    first = np.arange(0, n, PASSAGE_WORDS)
    passages = len(first)
    counts = np.diff(np.append(first, n)).astype(np.float64)
    edges = np.append(starts[first], len(data))
    edges[0] = 0
    sizes = np.diff(edges)
    classes = np.bincount(
        np.repeat(np.arange(passages) * CLASSES, sizes) + _CLASS[data], minlength=passages * CLASSES
    ).reshape(passages, CLASSES) / np.maximum(sizes, 1)[:, None]

    def mean(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), first) / counts

    lengths = (ends - starts).astype(np.float64)
    average = mean(lengths)
    same = np.zeros(n, bool)
    same[1:] = hashed[1:] == hashed[:-1]
    _, at, back, times = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    seen = np.ones(n, bool)
    seen[at] = False
    if n >= 3:
        runs = words.mixed(words.mixed(hashed[:-2] * words.BASE + hashed[1:-1]) * words.BASE + hashed[2:])
        _, run_at = np.unique(runs, return_index=True)
        again = np.ones(n, bool)
        again[-2:] = False
        again[run_at] = False
    else:
        again = np.zeros(n, bool)
    passage = np.repeat(np.arange(passages), counts.astype(np.int64))
    bag = np.bincount(
        passage * BUCKETS + (hashed % np.uint64(BUCKETS)).astype(np.int64), minlength=passages * BUCKETS
    ).reshape(passages, BUCKETS) / counts[:, None]
    shape = np.stack([
        average / 10, np.sqrt(np.maximum(0, mean(lengths * lengths) - average * average)) / 10, mean(same),
        mean(seen), mean(again), mean(times[back] / n), np.log1p(counts) / 5, np.full(passages, np.log1p(n) / 10),
    ], axis=1)
    pairs = words.mixed(hashed * words.BASE + np.append(hashed[1:], np.uint64(0)))
    # Bucket 0 is that of a text without words.
    buckets = (np.stack([words.mixed(hashed), pairs], axis=1).reshape(-1) % np.uint64(WORD_BUCKETS - 1) + np.uint64(1))
    return Bag(np.hstack([classes * 3, shape, bag * 3]).astype(np.float32), buckets.astype(np.uint16), 2 * first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    """Weights of the encoder, the gate and the scorer."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights = {
            "W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "E": rng.normal(0, 0.1, (WORD_BUCKETS, HIDDEN)),
            "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "G": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
            "u": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, docs: Bag, first: np.ndarray) -> dict[str, np.ndarray]:
        """Documents lie one after another in ``docs``; ``first`` are the passages where they begin."""
        w, x = self.weights, docs.x
        sizes = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        ends = np.append(docs.first[1:], len(docs.buckets))
        said = ends - docs.first
        e = np.empty((len(x), HIDDEN))
        for at in range(0, len(x), PASSAGES_TOGETHER):
            some = docs.first[at:at + PASSAGES_TOGETHER]
            vectors = w["E"].take(docs.buckets[some[0]:ends[at + len(some) - 1]], axis=0)
            e[at:at + len(some)] = np.add.reduceat(vectors, some - some[0])
        h = np.tanh(x @ w["W"] + e / np.sqrt(said)[:, None] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["G"])
        a = (t * g) @ w["u"]
        exp = np.exp(a - np.maximum.reduceat(a, first)[bag])
        share = exp / np.add.reduceat(exp, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first)
        return {"bag": bag, "said": said, "h": h, "t": t, "g": g, "share": share, "z": z, "score": _sigmoid(z @ w["c"] + w["d"])}

    def gradients(self, docs: Bag, first, y, weight) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy."""
        w, f, x = self.weights, self.forward(docs, first), docs.x
        out = (f["score"] - y) * weight / weight.sum()
        dz = out[:, None] * w["c"]
        dh = f["share"][:, None] * dz[f["bag"]]
        pull = (f["h"] * dz[f["bag"]]).sum(axis=1)
        da = f["share"] * (pull - np.add.reduceat(f["share"] * pull, first)[f["bag"]])
        dt = da[:, None] * w["u"] * f["g"] * (1 - f["t"] ** 2)
        dg = da[:, None] * w["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ w["V"].T + dg @ w["G"].T) * (1 - f["h"] ** 2)
        each = np.repeat(dh / np.sqrt(f["said"])[:, None], f["said"], axis=0)
        de = np.stack([np.bincount(docs.buckets, each[:, at], WORD_BUCKETS) for at in range(HIDDEN)], axis=1)
        return {
            "E": de, "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "G": f["h"].T @ dg,
            "u": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ out, "d": np.array([out.sum()]),
        }

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, bags: list[Bag]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        first = np.cumsum([0] + [len(bag.x) for bag in bags[:-1]])
        docs = joined(bags)
        return self.forward(docs._replace(x=self.normal(docs.x)), first)["score"]


def train(bags: list[Bag], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adam over shuffled batches of bags; the same input gives the same model."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not len(bags):
        return model
    every = np.vstack([bag.x for bag in bags]).astype(np.float64)
    model.mean, model.scale = every.mean(axis=0), every.std(axis=0) + 0.02
    bags = [bag._replace(x=model.normal(bag.x)) for bag in bags]
    first_moment = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second_moment = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            first = np.cumsum([0] + [len(bags[i].x) for i in some[:-1]])
            grads = model.gradients(joined([bags[i] for i in some]), first, y[some], weight[some])
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * model.weights[k]
                first_moment[k] += 0.1 * (grad - first_moment[k])
                second_moment[k] += 0.001 * (grad * grad - second_moment[k])
                model.weights[k] -= rate * (first_moment[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second_moment[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def remainder(id_column: str) -> Column:
    """crc32 of the id as text, modulo 3; a null id has none."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def held_out(id_column: str) -> Column:
    """Documents whose labels are kept for testing; those without an id are not."""
    return F.coalesce(remainder(id_column) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           label_column: str = "quality", each: int = SAMPLE_EACH) -> DataFrame:
    """(label_id, y, weight, x, buckets, first): up to ``each`` labelled documents of either class, encoded.

    Chosen in the order of a hash of the id among all labelled documents that are not held out, until they
    have SAMPLE_PASSAGES passages; every document taken is taken whole. ``weight`` is how many labelled
    documents of its class each stands for. Labels other than 0 and 1, and ids with contradicting labels,
    are not used; of an id with several texts the one with the least hash is.
    """
    known = labels.filter(F.col(label_column).isin(0, 1) & ~held_out(id_column) & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("label_id")).agg(
        F.min(label_column).alias("y"), F.max(label_column).alias("most")).filter("y = most")
    size = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(each)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * each ids of eight bytes: small enough to send to every task, so that the texts of
    # the corpus stay where they are.
    texts = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text"))
    taken = texts.join(F.broadcast(chosen.select("label_id", "y")), "label_id").groupBy("label_id", "y").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("label_id", "y", "t.text")

    def encoded(batches):
        for batch in batches:
            bags = [encode(text) for text in batch["text"]]
            x, buckets, first = zip(*[bag.packed() for bag in bags]) if bags else ((), (), ())
            yield pd.DataFrame({
                "label_id": batch["label_id"], "y": batch["y"], "passages": [len(bag.x) for bag in bags],
                "x": x, "buckets": buckets, "first": first})

    read = workspace.written(taken.mapInPandas(
        encoded, "label_id long, y int, passages long, x binary, buckets binary, first binary"), "labelled-sample")
    # A window over at most 2 * each rows of two numbers.
    before = Window.partitionBy("y").orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(Window.unboundedPreceding, -1)
    used = read.select("label_id", "y", F.coalesce(F.sum("passages").over(before), F.lit(0)).alias("before")).filter(
        F.col("before") < SAMPLE_PASSAGES)
    shares = used.groupBy("y").agg(F.count(F.lit(1)).alias("used")).join(size, "y").select(
        "y", (F.col("n") / F.col("used")).alias("weight"))
    return read.drop("passages").join(F.broadcast(used.select("label_id")), "label_id").join(F.broadcast(shares), "y")


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """A model from the sample of ``sample``; without any labelled document, an untrained one."""
    rows = sample(docs, labels, **columns).orderBy("label_id").toPandas()
    bags = [unpacked(*row) for row in zip(rows["x"], rows["buckets"], rows["first"])]
    return train(bags, rows["y"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64))


def score(model: Model, text: Column) -> Column:
    """Score of a text, 0 to 1: higher, the likelier label 1. Null, empty and blank texts get the
    score of one passage of zeros; of long texts every passage is read."""
    def scored(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), SCORED_TOGETHER):
            out[at:at + SCORED_TOGETHER] = model.scores([encode(text) for text in texts.iloc[at:at + SCORED_TOGETHER]])
        return pd.Series(out)

    return F.pandas_udf(scored, "double")(text)
