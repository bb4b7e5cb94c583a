"""The likelihood kernel over packed choice sets: numpy on Arrow batches, one small row of sums per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

#: Beyond this many tasks, sums of tasks are added up on the executors first.
MANY_TASKS = 256


class Columns:
    """Which design columns a fit reads, and what it divides them by."""

    def __init__(self, index: np.ndarray, by: np.ndarray | None = None):
        self.index, self.by = index, by

    def of(self, x: np.ndarray) -> np.ndarray:
        if len(self.index) != x.shape[1]:
            x = x[:, self.index]
        return x if self.by is None else x / self.by


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


class Sets:
    """The choice sets of one batch: X, offsets and where each set starts."""

    def __init__(self, batch: pa.RecordBatch, p: int, keep: Columns | None, skip_unchosen: bool = True):
        k = _flat(batch, "k").astype(np.int64)
        chosen = _flat(batch, "chosen").astype(np.int64)
        x, off = _flat(batch, "x").reshape(-1, p), _flat(batch, "off")
        self.good = chosen >= 0 if skip_unchosen else np.ones(len(k), bool)
        if not self.good.all():
            rows = np.repeat(self.good, k)
            x, off, k, chosen = x[rows], off[rows], k[self.good], chosen[self.good]
        self.x = x if keep is None else keep.of(x)
        self.off, self.k = off, k
        self.start = np.cumsum(k) - k
        self.has = chosen >= 0
        self.chosen = (self.start + chosen)[self.has]

    def softmax(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and log sums of exp by set."""
        top = np.maximum.reduceat(eta, self.start)
        e = np.exp(eta - np.repeat(top, self.k))
        total = np.add.reduceat(e, self.start)
        return e / np.repeat(total, self.k), top + np.log(total)

    def loglik(self, eta: np.ndarray, log_sum: np.ndarray) -> float:
        return float(eta[self.chosen].sum() - log_sum[self.has].sum())

    def means(self, prob: np.ndarray) -> np.ndarray:
        return np.add.reduceat(prob[:, None] * self.x, self.start, axis=0)


def task_sums(packed: DataFrame, columns: list[str], width: int, add: Callable[[pa.RecordBatch], np.ndarray], merge: Callable | None = None) -> np.ndarray:
    """The sum over all batches of add(batch), vectors of `width`. Tasks are summed in the order of their ids, so repeated calls agree to the last bit.

    merge(a, b) replaces the sum where the vectors combine otherwise.
    """
    ship(packed.sparkSession)
    join = merge or (lambda a, b: a + b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(batch)
                total = part if total is None else join(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["task", "v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, 0
        for batch in batches:
            for task, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.asarray(v.values)
                total, first = (v, task) if total is None else (join(total, v), first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["task", "v"])

    sums = packed.select(*columns).mapInArrow(run, "task int, v array<double>")
    n = packed.rdd.getNumPartitions()
    if n > MANY_TASKS:
        some = int(n**0.5)  # neighbouring tasks go together by their ids: ranges would be sampled, and that runs the tasks twice
        near = F.least((F.col("task") / F.lit(-(-n // some))).cast("int"), F.lit(some - 1))
        sums = sums.repartitionById(some, near).sortWithinPartitions("task").mapInArrow(again, "task int, v array<double>")
    total = None
    for row in sorted(sums.collect(), key=lambda r: r.task):
        v = np.array(row.v)
        total = v if total is None else join(total, v)
    return np.zeros(width) if total is None else total


_COLUMNS = ["k", "chosen", "off", "x"]


def evaluate(packed: DataFrame, p: int, beta: np.ndarray, keep: Columns | None = None, skip_unchosen: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and the information matrix (minus the Hessian) at beta."""
    q = len(beta)
    upper = np.triu_indices(q)

    def add(batch: pa.RecordBatch) -> np.ndarray:
        s = Sets(batch, p, keep, skip_unchosen)
        if not len(s.k):
            return np.zeros(1 + q + len(upper[0]))
        eta = s.x @ beta + s.off
        prob, log_sum = s.softmax(eta)
        mean = s.means(prob)
        info = s.x.T @ (prob[:, None] * s.x) - mean.T @ mean
        return np.concatenate([[s.loglik(eta, log_sum)], s.x[s.chosen].sum(axis=0) - mean[s.has].sum(axis=0), info[upper]])

    v = task_sums(packed, _COLUMNS, 1 + q + len(upper[0]), add)
    info = np.zeros((q, q))
    info[upper] = v[1 + q :]
    return float(v[0]), v[1 : 1 + q], info + np.triu(info, 1).T


def logliks(packed: DataFrame, p: int, beta: np.ndarray, step: np.ndarray, sizes: np.ndarray, keep: Columns | None = None) -> np.ndarray:
    """Log likelihoods at beta + s * step for every s of sizes, in one job."""

    def add(batch: pa.RecordBatch) -> np.ndarray:
        s = Sets(batch, p, keep)
        if not len(s.k):
            return np.zeros(len(sizes))
        u, v = s.x @ beta + s.off, s.x @ step
        return np.array([s.loglik(eta, s.softmax(eta)[1]) for eta in (u + z * v for z in sizes)])

    return task_sums(packed, _COLUMNS, len(sizes), add)


def describe(packed: DataFrame, p: int) -> dict:
    """Counts of rows and sets, and for the columns: variance, range within sets, and the triangular factors of X and of X less its set means (exact ranks, no sample)."""

    def factor(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.linalg.qr(np.vstack([r, x]), mode="r")
        return np.vstack([out, np.zeros((p - len(out), p))]) if len(out) < p else out

    def add(batch: pa.RecordBatch) -> np.ndarray:
        s = Sets(batch, p, None, skip_unchosen=False)
        n_chosen, n_clusters = _flat(batch, "n_chosen"), _flat(batch, "n_clusters")
        counts = [len(s.x), len(s.k), (n_chosen == 0).sum(), (n_chosen > 1).sum(), (n_clusters > 1).sum()]
        mean = np.add.reduceat(s.x, s.start, axis=0) / s.k[:, None]
        inside = np.abs(s.x - np.repeat(mean, s.k, axis=0))
        spread = (np.maximum.reduceat(s.x, s.start, axis=0) - np.minimum.reduceat(s.x, s.start, axis=0)).max(axis=0)
        center = s.x.mean(axis=0)
        none = np.zeros((p, p))
        r, d = factor(none, s.x), factor(none, s.x - np.repeat(mean, s.k, axis=0))
        plain = np.where(((s.x == 0) | (s.x == 1)).all(axis=0), 1.0, 0.0)
        return np.concatenate([counts, center, ((s.x - center) ** 2).sum(axis=0), spread, plain, r.ravel(), d.ravel(), inside.max(axis=0)])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a[0], b[0]
        out = a + b
        ca, cb = a[5 : 5 + p], b[5 : 5 + p]
        out[5 : 5 + p] = (n * ca + m * cb) / (n + m)
        out[5 + p : 5 + 2 * p] = a[5 + p : 5 + 2 * p] + b[5 + p : 5 + 2 * p] + (ca - cb) ** 2 * n * m / (n + m)
        out[5 + 2 * p : 5 + 3 * p] = np.maximum(a[5 + 2 * p : 5 + 3 * p], b[5 + 2 * p : 5 + 3 * p])
        out[5 + 3 * p : 5 + 4 * p] = np.minimum(a[5 + 3 * p : 5 + 4 * p], b[5 + 3 * p : 5 + 4 * p])
        at = 5 + 4 * p
        for _ in range(2):
            out[at : at + p * p] = factor(a[at : at + p * p].reshape(p, p), b[at : at + p * p].reshape(p, p)).ravel()
            at += p * p
        out[at:] = np.maximum(a[at:], b[at:])
        return out

    v = task_sums(packed, [*_COLUMNS, "n_chosen", "n_clusters"], 5 + 5 * p + 2 * p * p, add, merge)
    n = v[0]
    return {
        "n_obs": int(v[0]), "n_groups": int(v[1]), "n_zero": int(v[2]), "n_multi": int(v[3]), "n_mixed_clusters": int(v[4]), "mean": v[5 : 5 + p],
        "variance": v[5 + p : 5 + 2 * p] / max(n - 1, 1), "spread": v[5 + 2 * p : 5 + 3 * p], "binary": v[5 + 3 * p : 5 + 4 * p] > 0,
        "r": v[5 + 4 * p : 5 + 4 * p + p * p].reshape(p, p), "r_within": v[5 + 4 * p + p * p : 5 + 4 * p + 2 * p * p].reshape(p, p),
    }


def cluster_scores(packed: DataFrame, p: int, beta: np.ndarray, keep: Columns | None = None) -> DataFrame:
    """cluster, u array: sums over the cluster's sets of x_chosen - mean x; summed per batch before the shuffle."""
    ship(packed.sparkSession)
    q = len(beta)
    cluster = dict(packed.dtypes)["cluster"].removeprefix("array<")[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sets(batch, p, keep)
            if not len(s.k):
                continue
            prob, _ = s.softmax(s.x @ beta + s.off)
            score = s.x[s.chosen] - s.means(prob)
            own = batch.column("cluster").flatten().filter(pa.array(s.good)).dictionary_encode()
            code = own.indices.to_numpy(zero_copy_only=False)
            total = np.zeros((len(own.dictionary), q))
            np.add.at(total, code, score)
            yield pa.RecordBatch.from_arrays([own.dictionary, *(pa.array(total[:, i]) for i in range(q))], ["cluster", *(f"u{i}" for i in range(q))])

    parts = packed.select("cluster", *_COLUMNS).mapInArrow(run, f"cluster {cluster}, " + ", ".join(f"u{i} double" for i in range(q)))
    return parts.groupBy("cluster").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(q)))


def gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """X'X of double columns, over all rows."""
    q = len(names)

    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        return (x.T @ x).ravel()

    return task_sums(table, names, q * q, add).reshape(q, q)
