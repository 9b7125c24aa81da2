"""Toxicity: a cumulative-link ordinal regression over sparse word features, with expected severity. All thresholds share
the weights; a penalty leaves most of them at 0."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, mixed, prefix_hashes

#: Labelled rows of the fit at most, those of least hash, and the folds in which they are graded.
SAMPLE, FOLDS, SEED = 8_000, 3, 11
#: Severity grades 0 (none) to GRADES. Documents of this expected severity or more are rejected; of held-out
#: clean ones, 999 in 1000 stay below 0.18.
GRADES, REJECT = 3, 0.25
#: A feature is a word or a word's beginning that so many labelled documents hold; steps of the sparse fit, and how many
#: times the least penalty that keeps chance out is put on them; features that a round of the fit takes in.
LEAST_DOCS, STEPS, HARDER, TAKEN = 4, 400, 0.9, 200

#: Bytes of a word's beginnings.
BEGIN = (4, 5, 6, 7)

_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))

def every_word(raw: bytes) -> np.ndarray:
    """Hashes of the words of a whole text and of the beginnings of longer ones; all ASCII but letters parts words, A-Z as
    a-z. A beginning counts as the word that it spells, so a stem counts in words that no labelled text has."""
    whole, *begun = prefix_hashes(raw.translate(_TABLE), (0, *BEGIN))
    return np.concatenate([whole, *(h[h != whole] for h in begun)]).view(np.int64)


def text_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones, and how often each occurs."""
    return np.unique(every_word(raw), return_counts=True)


class Sparse:
    """Rows of features with their values, in rows of one array, worked on some rows at a time."""

    STEP = 1 << 20

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.at = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
        self.columns = np.concatenate(columns).astype(np.int32, copy=False) if columns else np.zeros(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32, copy=False) if values else np.zeros(0, np.float32)
        self.rows, self.width = len(columns), width

    def present(self) -> Sparse:
        """The same features with the value 1."""
        out = Sparse([], [], self.width)
        out.at, out.columns, out.rows = self.at, self.columns, self.rows
        out.values = np.broadcast_to(np.float32(1), self.columns.shape)
        return out

    def _blocks(self):
        """(first row, last row, first value, last value) of blocks of whole rows."""
        i = 0
        while i < self.rows:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + self.STEP, "right")) - 1)
            yield i, j, self.at[i], self.at[j]
            i = j

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for i, j, a, b in self._blocks():
            sums = np.concatenate(([0.0], np.cumsum(self.values[a:b] * w[self.columns[a:b]], dtype=float)))
            out[i:j] = np.diff(sums[self.at[i : j + 1] - a])
        return out

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for i, j, a, b in self._blocks():
            out += np.bincount(self.columns[a:b], self.values[a:b] * np.repeat(e[i:j], np.diff(self.at[i : j + 1])), self.width)
        return out

    def dense(self, some: np.ndarray) -> np.ndarray:
        """The columns ``some`` (sorted) as a matrix."""
        out = np.zeros((self.rows, some.size))
        for i, j, a, b in self._blocks() if some.size else ():
            place = np.minimum(np.searchsorted(some, self.columns[a:b]), some.size - 1)
            held = some[place] == self.columns[a:b]
            out[np.repeat(np.arange(i, j), np.diff(self.at[i : j + 1]))[held], place[held]] = self.values[a:b][held]
        return out


def _proximal(z: np.ndarray, use: np.ndarray, reached: np.ndarray, cut: np.ndarray, penalty: float, w: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal steps on the mean log-loss of the cumulative indicators, with the penalty on sums of |w|."""
    n, v, top = use.sum(), np.ones(z.shape[1]), 1e-6
    for _ in range(15):  # the largest curvature
        v = z.T @ (use * (z @ (v / (np.linalg.norm(v) or 1.0))))
        top = max(top, np.linalg.norm(v) / n)
    rate = 1 / (0.25 * reached.shape[1] * top + 0.25)
    ahead, ahead_cut = w, cut
    for step in range(steps):
        e = use[:, None] * (1 / (1 + np.exp(np.clip(ahead_cut - (z @ ahead)[:, None], -30, 30))) - reached) / n
        move = ahead - rate * (z.T @ e.sum(1))
        new = np.sign(move) * np.maximum(np.abs(move) - rate * penalty, 0)
        new_cut = ahead_cut + rate * e.sum(0)
        far, speed = np.abs(new - w).max(initial=0) + np.abs(new_cut - cut).max(), step / (step + 3)
        ahead, ahead_cut, w, cut = new + speed * (new - w), new_cut + speed * (new_cut - cut), new, new_cut
        if far < 1e-6:
            break
    return w, cut


def fit_sparse(x: Sparse, y: np.ndarray, grades: int, some: np.ndarray | None = None, steps: int = STEPS, harder: float = HARDER) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds as fit_cumulative has them, over all features, most weights 0.

    The mean log-loss with a penalty on the weights of scaled features, ``harder`` times the least that keeps features
    without any tie to the grades out. The features that pull hardest are fitted first; as long as one that was left out
    pulls harder than the penalty holds, it is taken in and the fit goes on, so the end is that of a fit of all. some: the
    rows to fit on."""
    use = np.ones(x.rows) if some is None else some.astype(float)
    n = use.sum()
    share = np.maximum(x.transposed_times(use) / n, 1e-12)  # about the rows that hold a feature
    scale = 1 / np.sqrt(share)
    mean = share * scale
    reached = np.stack([y >= k for k in range(1, grades + 1)], 1).astype(float)
    rate = np.clip(use @ reached / n, 1e-4, 1 - 1e-4)
    cut, w = np.log(1 / rate - 1), np.zeros(x.width)
    spread = np.sqrt(max(use @ (y * y) / n - (use @ y / n) ** 2, 1e-12))
    penalty = harder * spread * np.sqrt(2 * np.log(max(x.width, 2)) / n)
    active = np.zeros(x.width, bool)
    while True:
        down = (use[:, None] * (1 / (1 + np.exp(np.clip(cut - (x.times(scale * w) - mean @ w)[:, None], -30, 30))) - reached) / n).sum(1)
        pull = np.abs(scale * x.transposed_times(down) - mean * down.sum())
        more = ~active & (pull > penalty * 1.001)
        if not more.any():
            return w * scale, cut + mean @ w
        hardest = np.flatnonzero(more)
        hardest = hardest[np.argsort(-pull[hardest], kind="stable")[:TAKEN]]
        active[w != 0] = True
        active[hardest] = True
        cols = np.flatnonzero(active)
        z = x.dense(cols)
        z *= scale[cols]
        z -= mean[cols]
        w[cols], cut = _proximal(z, use, reached, cut, penalty, w[cols], steps)


def fit_cumulative(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, grades: int = GRADES, l2: float = 0.1, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of P(y >= k) = 1 / (1 + exp(cut[k] - x w)), k = 1..grades; all cuts share w.

    Newton steps, halved while they don't help, on the log-loss of the cumulative indicators with a ridge on w.
    """
    weight = np.ones(len(y)) if weight is None else weight
    w, cut = np.zeros(x.shape[1]), np.linspace(1.0, 3.0, grades)
    reached = np.stack([y >= k for k in range(1, grades + 1)], 1).astype(float)

    def loss(w, cut):
        z = (x @ w)[:, None] - cut
        return (weight[:, None] * (np.logaddexp(0, z) - reached * z)).sum() + 0.5 * l2 * w @ w + 5e-4 * cut @ cut

    now = loss(w, cut)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(cut - (x @ w)[:, None], -30, 30)))
        e, d = weight[:, None] * (p - reached), weight[:, None] * p * (1 - p)
        gradient = np.concatenate((x.T @ e.sum(1) + l2 * w, 1e-3 * cut - e.sum(0)))
        cross = -x.T @ d
        hessian = np.block([[x.T @ (x * d.sum(1)[:, None]) + l2 * np.eye(len(w)), cross], [cross.T, np.diag(d.sum(0) + 1e-3)]])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and (then := loss(w - size * step[: len(w)], cut - size * step[len(w) :])) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9 * abs(now):
            break
        w, cut, now = w - size * step[: len(w)], cut - size * step[len(w) :], then
    return w, np.maximum.accumulate(cut)


def expected_severity(margin: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum over k of P(y >= k), the mean grade."""
    return (1 / (1 + np.exp(np.clip(cut - margin[:, None], -30, 30)))).sum(1)


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, cut: np.ndarray):
        order = np.argsort(words)
        self.words, self.weights, self.cut = words[order], weights[order], cut

    def margin(self, raw: bytes) -> float:
        if not self.words.size or not raw:
            return 0.0
        h = every_word(raw)
        at = np.minimum(np.searchsorted(self.words, h), self.words.size - 1)
        hit = at[self.words[at] == h]
        if not hit.size:
            return 0.0
        k, n = np.unique(hit, return_counts=True)
        return float((1 + np.log(n)) @ self.weights[k])


def graded(x: Sparse, toxic: np.ndarray, fold: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades of rows that are labelled toxic or not. A clean row is 0. How grave a toxic one is, the other folds say: a
    model that saw neither the row nor its fold gives it a margin, and its grade is its third of those margins."""
    margin = np.zeros(x.rows)
    for f in np.unique(fold):
        away = fold != f
        if len(set(toxic[away].tolist())) == 2:
            w, _ = fit_sparse(x, toxic, 1, away)
            margin[~away] = x.times(w)[~away]
    thirds = np.quantile(margin[toxic > 0], np.arange(1, grades) / grades)
    return np.where(toxic > 0, 1 + np.searchsorted(thirds, margin), 0)


def fitted(batches, width: int):
    """The fit (see train) on all labelled rows (id, y, features and their counts packed), as one row: the features that matter,
    their weights and the thresholds, packed."""
    ids, y, columns, counts = [], [], [], []
    for batch in batches:
        ids += batch.column("id").to_pylist()
        y += [int(v > 0) for v in batch.column("y").to_pylist()]
        columns += [np.frombuffer(v, np.int32) for v in batch.column("k").to_pylist()]
        counts += [np.frombuffer(v, np.int32) for v in batch.column("n").to_pylist()]
    # the sums come out alike in every run
    order = sorted(range(len(ids)), key=lambda i: (ids[i], y[i], columns[i].size, int(columns[i].sum()), int(counts[i].sum())))
    x = Sparse([columns[i] for i in order], [(1 + np.log(counts[i])).astype(np.float32) for i in order], width)
    del columns, counts
    ids, y = np.array(ids, np.int64)[order], np.array(y)[order]
    fold = mixed(ids.view(np.uint64) + np.uint64(SEED)) % np.uint64(FOLDS)
    # which features matter is told by their presence alone, lest one long document speaks for its words
    held = x.present()
    grade = graded(held, y, fold)
    w, _ = fit_sparse(held, grade, GRADES)
    some = np.flatnonzero(w)
    # equal rows, as all those without a word that matters, count as one with a weight
    rows, weight = np.unique(np.column_stack((grade, x.dense(some))), axis=0, return_counts=True)
    w, cut = fit_cumulative(rows[:, 1:], rows[:, 0].astype(int), weight.astype(float))
    yield pa.RecordBatch.from_pydict({"some": [some.astype(np.int64).tobytes()], "w": [w.astype(float).tobytes()], "cut": [cut.astype(float).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of labelled documents, ``sample`` of them at most. Labels are 0 or 1; the grades 1 to GRADES of toxic ones
    come from models of the other folds (see graded). The sparse fit over all features, those that LEAST_DOCS labelled
    documents hold, tells which matter; the weights of these and the thresholds are then fitted without its penalty.
    Labels of one document count as their highest; null labels and ids take no part. Without both labels the model knows
    no word, and its severity is the same everywhere."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y"))
    known = scratch.write(known.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("h", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])

    def words(batches):
        for batch in batches:
            for id_, y, text in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), batch.column("text")):
                h, n = text_words(text.as_buffer().to_pybytes() if text.is_valid else b"")
                yield pa.RecordBatch.from_pydict({"id": [id_], "y": [y], "h": [h], "n": [n.astype(np.int32)]}, schema=schema)

    seen = scratch.write(texts.selectExpr("id", "cast(y as int) y", "text").mapInArrow(lean(words), "id bigint, y int, h array<bigint>, n array<int>"))
    clean, toxic = (seen.where(c).count() for c in ("y = 0", "y > 0"))
    if not clean or not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([2.0, 3.0, 4.0]))
    per = seen.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(f"c >= {LEAST_DOCS}")
    h = np.sort(per.select("h").toArrow()["h"].to_numpy())
    if not h.size:
        return Model(h, np.zeros(0), np.array([2.0, 3.0, 4.0]))
    features = spark.sparkContext.broadcast(h)

    def coded(batches):
        for batch in batches:
            k, n = [], []
            for hs, ns in zip(batch.column("h"), batch.column("n")):
                hs, ns = hs.values.to_numpy(), ns.values.to_numpy()
                at = np.minimum(np.searchsorted(features.value, hs), features.value.size - 1)
                hit = features.value[at] == hs
                k.append(at[hit].astype(np.int32).tobytes())
                n.append(ns[hit].tobytes())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "y": batch.column("y"), "k": pa.array(k, pa.binary()), "n": pa.array(n, pa.binary())})

    # the fit is one task's, on its bounded rows, so neither they nor its matrices are held by the driver
    fit = seen.mapInArrow(lean(coded), "id bigint, y int, k binary, n binary").repartition(1).mapInArrow(lean(partial(fitted, width=h.size)), "some binary, w binary, cut binary")
    got = scratch.write(fit, small=True).first()
    return Model(h[np.frombuffer(got["some"], np.int64)], np.frombuffer(got["w"]), np.frombuffer(got["cut"]))


def score(docs: DataFrame, model: Model, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row over its whole text; with ``keep`` the rows' own columns instead,
    of those that aren't toxic. Toxic is a severity of ``reject`` or more that words of the text speak for. A null or empty
    text has no words, and the severity of none. Rows of one id are
    scored each for itself."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def severity(batches):
        for batch in batches:
            texts = batch.column(text_col if keep else "text")
            m = np.array([known.value.margin(t.as_buffer().to_pybytes()) if t.is_valid else 0.0 for t in texts])
            s = expected_severity(m, known.value.cut) if m.size else m
            bad = (s >= reject) & (m > 0)
            if keep:
                yield batch.filter(pa.array(~bad, pa.bool_()))
            else:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "severity": np.round(s, 6), "grade": np.rint(s).astype(np.int32), "toxic": bad})

    if keep:
        return docs.mapInArrow(lean(severity), docs.schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(severity), "doc_id bigint, severity double, grade int, toxic boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones doesn't call toxic, each row for itself. Null and empty texts stay, as
    do rows without an id; an empty table gives an empty one, and columns of any names stay."""
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=True)
