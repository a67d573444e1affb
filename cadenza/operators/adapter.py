"""A small learned re-ranker: features of candidates, a multi-layer perceptron trained on pairs, its ranking.

Pairs are made and sampled in Spark; the optimiser runs in NumPy, over batches from files that hold all training rows,
in a task for each network (train_sets) or on the driver (train); scores are computed on the executors."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of features, and the sets of the ablation.
BASE = ("cf", "artist", "popularity", "lemon", "kar")
PRODUCTS = ("cf_artist", "cf_popularity", "cf_lemon", "cf_kar", "artist_kar", "popularity_kar", "lemon_kar")
SCALARS = (*BASE, *PRODUCTS)
#: The products of the two knowledge vectors, coordinate by coordinate.
KAR_DIM = 32
KAR_PRODUCTS = tuple(f"kar_product_{i}" for i in range(KAR_DIM))
FEATURES = (*SCALARS, *KAR_PRODUCTS)
SETS = {
    "Adapter CF only": ("cf",),
    "Adapter CF + metadata": ("cf", "artist", "popularity", "cf_artist", "cf_popularity"),
    "Adapter CF + metadata + LEMON": ("cf", "artist", "popularity", "cf_artist", "cf_popularity", "lemon", "cf_lemon"),
    "Adapter CF + metadata + KAR score": ("cf", "artist", "popularity", "cf_artist", "cf_popularity", "kar", "cf_kar", "artist_kar", "popularity_kar"),
    "Adapter CF + metadata + KAR vector": ("cf", "artist", "popularity", "cf_artist", "cf_popularity", *KAR_PRODUCTS),
    "Adapter semantic only": ("lemon", "kar", "lemon_kar", *KAR_PRODUCTS),
    "Adapter all": FEATURES,
}


#: Others that are drawn for each held-out candidate.
PER_POSITIVE = 20


def features(prepared: DataFrame, split: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """case_idx, song_id, the scalars, the products of the knowledge vectors (0 where one is missing), label
    (held out or not). `prepared` has cf_norm, artist_norm, pop_norm, lemon_norm and kar_norm; `users` has
    case_idx and vec, `items` song_id and vec."""
    truth = split.where("not observed").select("case_idx", "song_id", F.lit(1).alias("label"))
    rows = prepared.select("case_idx", "song_id", *(F.col(f"{'pop' if b == 'popularity' else b}_norm").alias(b) for b in BASE))
    products = [(F.col(p.split("_")[0]) * F.col(p.split("_")[1])).alias(p) for p in PRODUCTS]
    rows = rows.select("*", *products)
    vector = F.lit(None).cast("array<double>")
    rows = rows.withColumn("_u", vector) if users is None else rows.join(users.select("case_idx", F.col("vec").alias("_u")), "case_idx", "left")
    rows = rows.withColumn("_i", vector) if items is None else rows.join(items.select("song_id", F.col("vec").alias("_i")), "song_id", "left")
    kar = [F.coalesce(F.get("_u", F.lit(i)) * F.get("_i", F.lit(i)), F.lit(0.0)).alias(p) for i, p in enumerate(KAR_PRODUCTS)]
    rows = rows.select("case_idx", "song_id", *SCALARS, *kar)
    return rows.join(truth, ["case_idx", "song_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def split_cases(rows: DataFrame, seed: int, test: float = 0.2) -> DataFrame:
    """case_idx, is_train: an exact share of the cases, by a seeded order."""
    cases = rows.select("case_idx").distinct().withColumn("o", F.md5(F.concat_ws(":", F.lit(str(seed)), "case_idx")))
    n = cases.count()
    n_test = min(max(1, round(n * test)), max(1, n - 1))
    chosen = cases.orderBy("o").limit(n_test).select("case_idx", F.lit(False).alias("t"))
    return cases.select("case_idx").join(chosen, "case_idx", "left").select("case_idx", F.coalesce("t", F.lit(True)).alias("is_train"))


def stats(rows: DataFrame, names: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; one that doesn't vary has deviation 1."""
    one = rows.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    return {n: (one[f"m_{n}"] or 0.0, one[f"s_{n}"] if (one[f"s_{n}"] or 0.0) >= 1e-6 else 1.0) for n in names}


def pairs(rows: DataFrame, seed: int, per_positive: int = PER_POSITIVE) -> DataFrame:
    """Features of each held-out candidate (pos) with those of drawn others of its case (neg)."""
    x = F.array(*(F.col(n).cast("float") for n in FEATURES))
    neg = rows.where("label = 0").select("case_idx", "song_id", x.alias("neg"))
    neg = neg.withColumn("k", F.row_number().over(Window.partitionBy("case_idx").orderBy("song_id"))).withColumn("n", F.count("*").over(Window.partitionBy("case_idx")))
    sizes = neg.groupBy("case_idx").agg(F.max("n").alias("n"))
    pos = rows.where("label = 1").select("case_idx", "song_id", x.alias("pos")).join(sizes, "case_idx")
    drawn = pos.select("case_idx", "pos", "n", F.col("song_id").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(per_positive))).alias("j"))
    drawn = drawn.withColumn("k", (F.pmod(F.xxhash64(F.lit(seed), "case_idx", "p", "j"), F.col("n")) + 1).cast("int"))
    return drawn.join(neg.drop("n", "song_id"), ["case_idx", "k"]).select("case_idx", "p", "j", "pos", "neg")


@dataclass
class Network:
    names: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The activations of each layer; `masks` scale those of the hidden ones (dropout)."""
        return self.through(((x - self.mean) / self.std).astype(self.layers[0][0].dtype), masks)

    def through(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The same from features less their means, over their deviations."""
        acts = [x]
        for i, (w, b) in enumerate(self.layers):
            z = acts[-1] @ w
            z += b
            if i < len(self.layers) - 1:
                np.maximum(z, 0, out=z)
                if masks is not None:
                    z *= masks[i]
            acts.append(z)
        return acts

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0].astype(float)

    def slopes(self, acts: list[np.ndarray], g: np.ndarray, masks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Gradients of the layers for the gradient `g` of the scores."""
        grads = []
        for i in range(len(self.layers) - 1, -1, -1):
            grads.append((acts[i].T @ g, g.sum(axis=0)))
            if i:
                g = g @ self.layers[i][0].T
                g *= acts[i] > 0
                g *= masks[i - 1]
        return grads[::-1]


class Spill:
    """All training rows in files, as float32 and in order: `arrays`, one for each column (the features `names`, or a
    number), mapped into memory."""

    def __init__(self, lists: tuple[bool, ...] = (), names: tuple[str, ...] = FEATURES):
        self.lists, self.names, self.n = lists or (True, True), names, 0
        self.files = [tempfile.TemporaryFile() for _ in self.lists]

    def add(self, columns: list[pa.Array]) -> None:
        self.n += len(columns[0])
        for f, c in zip(self.files, columns, strict=True):
            f.write((c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False).astype(np.float32).tobytes())

    def mapped(self) -> Spill:
        self.arrays = []
        for f, wide in zip(self.files, self.lists, strict=True):
            f.flush()
            shape = (self.n, len(self.names)) if wide else (self.n,)
            self.arrays.append(np.memmap(f, np.float32, "r", shape=shape) if self.n else np.zeros(shape, np.float32))
        return self

    @classmethod
    def of(cls, rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...]) -> Spill:
        out = cls(tuple(f.dataType.typeName() == "array" for f in rows.select(*columns).schema))
        for batch in _batches(rows.orderBy(*order).select(*columns)):
            out.add(batch.columns)
        return out.mapped()


def _batches(rows: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches, one partition after the other, so that the driver holds one at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

    for r in rows.mapInArrow(packed, "b binary").toLocalIterator():
        yield from pa.ipc.open_stream(bytes(r.b))


def spilled(sample: DataFrame, loss: str = "pairwise") -> Spill:
    """What train() reads: of pairs() for the pairwise loss, of rows of features() for the other."""
    if loss == "pairwise":
        return Spill.of(sample, ("pos", "neg"), ("case_idx", "p", "j"))
    rows = sample.select("case_idx", "song_id", F.array(*(F.col(n).cast("float") for n in FEATURES)).alias("x"), "label")
    return Spill.of(rows, ("x", "label"), ("case_idx", "song_id"))


def scaled(x: np.ndarray, at: list[int], net: Network, step: int = 1 << 16) -> np.ndarray:
    """The network's features as it reads them, in a file of their own: made once, not in every epoch."""
    if not len(x):
        return np.zeros((0, len(at)), np.float32)
    file = tempfile.TemporaryFile()
    for lo in range(0, len(x), step):
        file.write(((x[lo : lo + step][:, at] - net.mean) / net.std).astype(np.float32).tobytes())
    file.flush()
    return np.memmap(file, np.float32, "r", shape=(len(x), len(at)))


def train(
    sample: DataFrame | Spill,
    moments: dict[str, tuple[float, float]],
    names: tuple[str, ...],
    seed: int,
    hidden: int = 64,
    epochs: int = 30,
    rate: float = 1e-3,
    decay: float = 1e-4,
    batch: int = 4096,
    dropout: float = 0.1,
    loss: str = "pairwise",
) -> Network:
    """Minimise by Adam with decoupled weight decay: softplus(-(s_pos - s_neg)) over pairs ("pairwise"), or
    the cross entropy of the labels, positives weighted by negatives over positives ("bce")."""
    if loss not in ("pairwise", "bce"):
        raise ValueError(f"no such loss: {loss}")
    if not names or not set(names) <= set(FEATURES):
        raise ValueError(f"no features, or unknown ones: {names}")
    data = sample if isinstance(sample, Spill) else spilled(sample, loss)
    at = [data.names.index(n) for n in names]
    one, other = data.arrays
    rng = np.random.default_rng(seed)
    sizes = [len(names), hidden, max(1, hidden // 2), 1]
    layers = [(rng.normal(0, (2 / a) ** 0.5, (a, b)).astype(np.float32), np.zeros(b, np.float32)) for a, b in zip(sizes, sizes[1:], strict=False)]
    net = Network(names, np.array([moments[n][0] for n in names]), np.array([moments[n][1] for n in names]), layers)
    positives = float(other.sum()) if loss == "bce" else 0.0
    one, *more = (scaled(x, at, net) for x in (one, *([other] if loss == "pairwise" else [])))
    other = more[0] if more else other
    weight = (data.n - positives) / max(1.0, positives)
    first, second, t = [(0.0, 0.0)] * 3, [(0.0, 0.0)] * 3, 0

    def masks(n: int) -> list[np.ndarray]:
        return [(rng.random((n, size), np.float32) >= dropout) * (np.float32(1) / np.float32(1 - dropout)) for size in sizes[1:-1]]

    for _ in range(epochs):
        order = rng.permutation(data.n)
        for lo in range(0, data.n, batch):
            rows_at = np.sort(order[lo : lo + batch])
            n = len(rows_at)
            ma = masks(n)
            a = net.through(one[rows_at], ma)
            if loss == "pairwise":
                mb = masks(n)
                b = net.through(other[rows_at], mb)
                slope = -1 / (1 + np.exp(np.clip(a[-1] - b[-1], -30, 30))) / n
                grads = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(net.slopes(a, slope, ma), net.slopes(b, -slope, mb), strict=True)]
            else:
                y, p = other[rows_at][:, None], 1 / (1 + np.exp(-np.clip(a[-1], -30, 30)))
                grads = net.slopes(a, ((1 - y) * p - weight * y * (1 - p)) / n, ma)
            t += 1
            for i, layer in enumerate(net.layers):
                m = tuple(0.9 * x + 0.1 * g for x, g in zip(first[i], grads[i], strict=True))
                s = tuple(0.999 * x + 0.001 * g * g for x, g in zip(second[i], grads[i], strict=True))
                first[i], second[i] = m, s
                step = [rate * (x / (1 - 0.9**t)) / (np.sqrt(y / (1 - 0.999**t)) + 1e-8) for x, y in zip(m, s, strict=True)]
                net.layers[i] = tuple((x * (1 - rate * decay) - d).astype(np.float32) for x, d in zip(layer, step, strict=True))
    return net


def train_sets(drawn: DataFrame, moments: dict[str, tuple[float, float]], sets: dict[str, tuple[str, ...]], seed: int) -> dict[str, Network]:
    """A network for each set of features, out of pairs(): each is trained by a task of its own, which holds the pairs'
    features of its set in a file."""
    spark = drawn.sparkSession
    columns = lambda x, names: F.array(*(F.get(x, F.lit(FEATURES.index(n))) for n in names))
    own = F.array(*(F.struct(F.lit(i).alias("no"), columns(F.col("pos"), n).alias("pos"), columns(F.col("neg"), n).alias("neg")) for i, n in enumerate(sets.values())))
    rows = drawn.select("case_idx", "p", "j", F.explode(own).alias("x")).select("x.no", "case_idx", "p", "j", "x.pos", "x.neg")
    # as many partitions as keep the sets apart
    hashes = [r.h for r in spark.createDataFrame([(i,) for i in range(len(sets))], "no int").select(F.hash("no").alias("h")).collect()]
    n = next(n for n in range(len(sets), 10_000) if len({h % n for h in hashes}) == len(hashes))
    names = list(sets.values())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = no = None
        for b in batches:
            if b.num_rows:
                no = b.column("no")[0].as_py()
                data = data or Spill((), names[no])
                data.add([b.column("pos"), b.column("neg")])
        if data is not None:
            net = train(data.mapped(), moments, names[no], seed)
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([pickle.dumps(net.layers)], pa.binary())], names=["no", "layers"])

    learned = rows.repartition(n, "no").sortWithinPartitions("no", "case_idx", "p", "j").mapInArrow(learn, "no int, layers binary").collect()
    layers = {r.no: pickle.loads(bytes(r.layers)) for r in learned}
    empty = Spill((), FEATURES)
    mean = lambda names, i: np.array([moments[n][i] for n in names])
    return {k: Network(v, mean(v, 0), mean(v, 1), layers[i]) if i in layers else train(empty.mapped(), moments, v, seed) for i, (k, v) in enumerate(sets.items())}


def rank(rows: DataFrame, net: Network, variant: str, top: int = 10) -> DataFrame:
    """variant, case_idx, song_id, score, rank of the best candidates of each case."""
    names = net.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))]) if b.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(net.score(x))], names=["case_idx", "song_id", "score"])

    scored = rows.select("case_idx", "song_id", *names).mapInArrow(score, f"case_idx {rows.schema['case_idx'].dataType.simpleString()}, song_id string, score double")
    order = F.row_number().over(Window.partitionBy("case_idx").orderBy(F.desc("score"), "song_id"))
    return scored.withColumn("rank", order).where(F.col("rank") <= top).withColumn("variant", F.lit(variant))
