"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other, and their calibrated
views together score every document. The views share nothing: one sees the text and no size, the other size, source and
language as the page's record has them, and no text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, mixed, word_hashes

#: Labelled rows of the fit at most, those of least hash. All unlabelled rows take part in the exchange.
LABELLED, SEED = 12_000, 5
#: Rounds of the exchange; the share of the pool's rest that a view labels in a round, on each side, how sure of it, and
#: what such a label weighs.
ROUNDS, SHARE, SURE, TAUGHT = 5, 0.05, 0.9, 0.3
#: Margins of sure rows are counted in so many bins of this width, from the least sure margin on.
BINS, WIDTH, LEAST = 6000, 0.01, float(np.log(SURE / (1 - SURE)))
#: Sums that are put together at a time.
FAN = 64
#: Every so many labelled rows, one is held out to calibrate and one to combine.
HELD = 5
#: Labelled rows that a source's or language's rate of good ones is drawn towards the rate of all by.
PRIOR = 10.0

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 white space, 5 other ASCII, 6 beyond ASCII
for _c in range(256):
    _KIND[_c] = 6 if _c >= 128 else 2 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if _c in (32, 9, 10, 11, 12, 13) else 5
TEXT_FEATURES, META_FEATURES = 12, 9


def text_view(raw: bytes) -> np.ndarray:
    """What the whole text looks like, whatever its size: kinds of characters, repeats of words and lines, lengths of words."""
    out = np.zeros(TEXT_FEATURES)
    if not raw:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    w = word_hashes(raw)
    out[:6] = np.sqrt(kinds[1:7])
    if w.size:
        _, n = np.unique(w, return_counts=True)
        marks = kinds[5] * len(raw) / w.size
        out[6:11] = n.size / w.size, np.log1p(n.max() / w.size * 10), (w[1:] == w[:-1]).mean() if w.size > 1 else 0.0, np.log1p(len(raw) / w.size), np.log1p(marks)
    lines = raw.split(b"\n")
    out[11] = 1 - len(set(lines)) / len(lines)
    return out


class Rates:
    """How good the labelled rows of each source, or language, are: the log-odds of a good one, drawn towards those of all.
    Every value has a rate of its own; one that no labelled row has, or a null one, has none."""

    def __init__(self, codes: np.ndarray, y: np.ndarray):
        self.codes, at = np.unique(codes, return_inverse=True)
        self.good, self.n, self.mean = np.bincount(at, y, self.codes.size), np.bincount(at, minlength=self.codes.size), np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)

    def features(self, codes: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """(rate, known) of rows; own: their labels where they are among the labelled rows, which are then left out of
        their rates."""
        if not self.codes.size:
            return np.zeros((len(codes), 2))
        at = np.minimum(np.searchsorted(self.codes, codes), self.codes.size - 1)
        known = (self.codes[at] == codes) & (codes >= 0)
        good, n = self.good[at], self.n[at].astype(float)
        if own is not None:
            good, n = good - own, n - 1
        share = np.where(known, (good + PRIOR * self.mean) / (n + PRIOR), self.mean)
        return np.column_stack((np.log(share / (1 - share)) - np.log(self.mean / (1 - self.mean)), known & (n > 0)))


def meta_view(meta: np.ndarray, rates: list | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """What is known of the page without its text: rows (size in characters, source, language), -1 where it is null."""
    chars, known = np.maximum(meta[:, 0], 0), meta[:, 0] >= 0
    size = np.log1p(chars) / 10
    parts = [r.features(meta[:, 1 + k], own) for k, r in enumerate(rates)] if rates else [np.zeros((len(meta), 2))] * 2
    return np.column_stack((size, size * size, known & (chars < 200), known & (chars > 5000), known, *parts)).astype(float)


class Logistic:
    """Ridge logistic regression on standardized features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0):
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = self._z(x)
        weight = np.ones(len(y)) if weight is None else weight
        w, ridge = np.zeros(z.shape[1]), l2 * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    @classmethod
    def at(cls, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Logistic:
        out = cls.__new__(cls)
        out.mean, out.scale, out.w = mean, scale, w
        return out

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the rows, without the ridge."""
        z = self._z(x)
        p = _p(z @ self.w)
        return z.T @ (weight * (p - y)), z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None])

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w


def _wide(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, x * x))


def _p(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _replayed(rounds: list, inputs: list[np.ndarray], draw: np.ndarray) -> list[np.ndarray]:
    """What each view has been taught of the rows after the rounds: 1, 0 or -1 for nothing. A round holds both views and,
    for each and each side, the lowest bin that it labels and the share of that bin, which ``draw`` parts."""
    taught = [np.full(len(draw), -1, np.int8) for _ in inputs]
    code = (draw * (1 << 30)).astype(np.uint64)
    for n, (views, cuts) in enumerate(rounds):
        free = (taught[0] < 0) & (taught[1] < 0)
        for k, side, bin_, part in cuts:
            at = _bins(views[k].margin(inputs[k]), side)
            lot = mixed(code + np.uint64((2 * n + k + 1) << 32)) / 2.0**64  # drawn anew, as earlier rounds took the low ones
            taught[1 - k][free & ((at > bin_) | ((at == bin_) & (lot < part)))] = side
    return taught


def _bins(margin: np.ndarray, side: int) -> np.ndarray:
    """Bin of each margin for the side, -1 where the view isn't sure."""
    m = margin if side else -margin
    return np.where(m >= LEAST, np.minimum((m - LEAST) / WIDTH, BINS - 1), -1).astype(int)


class Pool:
    """All unlabelled rows, as packed features in a written table. Each question is one pass over it, which replays the
    rounds so far. A task gives sums of fixed size; these are put together on the executors until FAN of them at most are
    left, so what reaches the driver is bounded, whatever the input."""

    def __init__(self, packed: DataFrame, rates: list | None = None):
        self.packed, self.rates, self.rounds = packed, rates, []
        self.tasks = packed.rdd.getNumPartitions()

    def _sum(self, f) -> np.ndarray:
        rounds = self.packed.sparkSession.sparkContext.broadcast((self.rounds, self.rates))

        def run(batches):
            total, part = None, 0
            for batch in batches:
                part = batch.column("part")[0].as_py() if batch.num_rows else part
                for raw in batch.column("v"):
                    x = np.frombuffer(raw.as_buffer()).reshape(-1, PACKED)
                    inputs = [_wide(x[:, :TEXT_FEATURES]), _unpacked_meta(x, rounds.value[1])]
                    got = f(inputs, _replayed(rounds.value[0], inputs, x[:, -1]))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "s": pa.array([total.tobytes()], pa.binary())})

        def add(key, table):
            # in the order of the parts, so that reruns agree to the last bit
            rows = sorted(zip(table["part"].to_pylist(), table["s"].to_pylist()))
            return pa.table({"part": [key[0].as_py()], "s": pa.array([sum(np.frombuffer(s) for _, s in rows).tobytes()], pa.binary())})

        sums, left = self.packed.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, "part bigint, s binary"), self.tasks
        while left > FAN:
            sums, left = sums.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInArrow(add, "part bigint, s binary"), -(-left // FAN)
        rows = sorted(sums.collect())
        rounds.unpersist()
        return sum((np.frombuffer(r["s"]) for r in rows), np.zeros(1))

    def label(self, views: list) -> bool:
        """A round: what each view is surest of, on each side, the other is taught."""

        def count(inputs, taught):
            free = (taught[0] < 0) & (taught[1] < 0)
            bins = [_bins(views[k].margin(inputs[k]), side)[free] for k in (0, 1) for side in (1, 0)]
            return np.concatenate([[free.sum()], *[np.bincount(b[b >= 0], minlength=BINS) for b in bins]]).astype(float)

        got = self._sum(count)
        if got.size == 1:
            return False
        most, cuts = int(SHARE * got[0]), []
        for n, (k, side) in zip(got[1:].reshape(4, BINS), ((k, side) for k in (0, 1) for side in (1, 0))):
            above = np.cumsum(n[::-1])[::-1]
            over = np.flatnonzero(above > most)
            cut = int(over[-1]) if over.size else -1
            cuts.append((k, side, cut, (most - (above[cut] - n[cut])) / n[cut] if cut >= 0 else 0.0))
        if not most or not got[1:].any():
            return False
        self.rounds.append((views, cuts))
        return True

    def moments(self, dims: list[int]) -> list[np.ndarray]:
        """For each view the number of taught rows, their sums and sums of squares."""
        f = lambda inputs, taught: np.concatenate([np.concatenate([[len(t)], t.sum(0), (t * t).sum(0)]) for t in (x[y >= 0] for x, y in zip(inputs, taught))])
        got = self._sum(f)
        return np.split(got, [1 + 2 * dims[0]]) if got.size > 1 else [np.zeros(1 + 2 * d) for d in dims]

    def sums(self, views: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the gradient and the Hessian over the taught rows."""

        def f(inputs, taught):
            return np.concatenate([np.concatenate([a.ravel() for a in v.sums(x[y >= 0], y[y >= 0], np.full((y >= 0).sum(), TAUGHT))]) for v, x, y in zip(views, inputs, taught)])

        got, out, at = self._sum(f), [], 0
        for d in (len(v.w) for v in views):
            part = got[at : at + d + d * d] if got.size > 1 else np.zeros(d + d * d)
            out.append((part[:d], part[d:].reshape(d, d)))
            at += d + d * d
        return out


def _fitted(train: list, pool: Pool, before: list) -> list:
    """Both views fitted to the labelled rows and to what the pool's rows teach: Newton steps from the views before."""
    views = []
    for (x, _), m, v in zip(train, pool.moments([x.shape[1] for x, _ in train]), before):
        d = x.shape[1]
        n = len(x) + m[0]
        mean = (x.sum(0) + m[1 : d + 1]) / n
        scale = np.sqrt(np.maximum(((x * x).sum(0) + m[d + 1 :]) / n - mean * mean, 0))
        scale = np.where(scale > 1e-6, scale, 1.0)
        views.append(Logistic.at(mean, scale, np.append(v.w[:-1] / v.scale * scale, v.w[-1] + (v.w[:-1] * (mean - v.mean) / v.scale).sum())))
    for _ in range(12):
        far = 0.0
        for v, (x, y), (g, h) in zip(views, train, pool.sums(views)):
            own = v.sums(x, y, np.ones(len(y)))
            ridge = np.eye(len(v.w))
            ridge[-1, -1] = 1e-6
            step = np.linalg.solve(own[1] + h + ridge, own[0] + g + ridge @ v.w)
            v.w = v.w - step
            far = max(far, np.abs(step).max())
        if far < 1e-6:
            break
    return views


class Model:
    """Two views, the calibration of each, and how their margins combine. None of it without both labels."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool=None, rounds: int = ROUNDS):
        """text: text views; meta: rows as meta_view takes them; pool: makes the Pool of some rates, if the labels have use
        for it. Of the labelled rows one in HELD calibrates the views and another one fits how they combine; neither
        teaches the views."""
        self.views = None
        if len(set(y.tolist())) < 2:
            self.rate = float(y.mean()) if len(y) else 0.5
            return
        parts = [np.arange(len(y)) % HELD == k for k in (0, 1)]
        if any(len(set(y[p].tolist())) < 2 for p in (*parts, ~(parts[0] | parts[1]))):
            parts = [np.ones(len(y), bool)] * 2  # too few labels to part
            fit = parts[0]
        else:
            fit = ~(parts[0] | parts[1])
        own = y.astype(float)
        self.rates = [Rates(meta[fit, 1 + k], own[fit]) for k in (0, 1)]
        train = [(_wide(text[fit]), own[fit]), (meta_view(meta[fit], self.rates, own[fit]), own[fit])]
        self.taught = [0, 0]
        views = [Logistic(*t) for t in train]
        free = pool(self.rates) if pool else None
        for _ in range(rounds if free else 0):
            # what one view is sure of, the other learns, at less than a label's weight
            if not free.label(views):
                break
            views = _fitted(train, free, views)
        if free and free.rounds:
            self.taught = [int(m[0]) for m in free.moments([x.shape[1] for x, _ in train])]
        self.views = views
        of = lambda rows: [v.margin(x) for v, x in zip(views, (_wide(text[rows]), meta_view(meta[rows], self.rates)))]
        self.calibration = [Logistic(m[:, None], own[parts[0]]) for m in of(parts[0])]
        self.joint = Logistic(np.column_stack([c.margin(m[:, None]) for c, m in zip(self.calibration, of(parts[1]))]), own[parts[1]])

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: by the text, by the metadata, by both."""
        if self.views is None:
            p = np.full(len(text), self.rate)
            return p, p, p
        m = [c.margin(v.margin(x)[:, None]) for c, v, x in zip(self.calibration, self.views, (_wide(text), meta_view(meta, self.rates)))]
        return _p(m[0]), _p(m[1]), _p(self.joint.margin(np.column_stack(m)))


def _viewed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str, *more: str) -> DataFrame:
    code = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 52))).cast("double")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(chars_col).cast("double"), F.lit(-1.0)).alias("chars"), code(source_col).alias("source"), code(lang_col).alias("lang"), *more)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [text_view(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
    return np.array(text).reshape(-1, TEXT_FEATURES), np.column_stack([batch.column(c).to_numpy() for c in ("chars", "source", "lang")])


#: A packed row: the text view, size, source and language (-1 none), and a draw in [0, 1).
PACKED = TEXT_FEATURES + 3 + 1


def _unpacked_meta(x: np.ndarray, rates: list | None = None) -> np.ndarray:
    return meta_view(x[:, TEXT_FEATURES : TEXT_FEATURES + 3], rates)


def _packed(batches):
    for batch in batches:
        rows = np.column_stack((*_features(batch), batch.column("draw").to_numpy()))
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "v": pa.array([r.tobytes() for r in rows], pa.binary())})


def _joined(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"v": pa.array([b"".join(batch.column("v").to_pylist())], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", label_col: str = "quality", columns: tuple = ("text", "source", "lang", "n_chars")) -> Model:
    """Labels of one document count as their least; null labels and ids take no part. The features of the bounded
    labelled sample come to the driver, never texts; of all unlabelled rows, only sums."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = scratch.write(known.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(labelled))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30)
    rows = scratch.write(_viewed(docs, id_col, *columns, draw.alias("draw")).mapInArrow(lean(_packed), "id bigint, v binary"))
    got = rows.join(F.broadcast(chosen), "id").select("id", "y", "v").toArrow().combine_chunks()
    pick = np.lexsort((got["id"].to_numpy(),)) if got.num_rows else np.zeros(0, int)
    x = np.frombuffer(b"".join(got["v"].to_pylist())).reshape(-1, PACKED)[pick]
    free = lambda rates: Pool(scratch.write(rows.join(known, "id", "left_anti").select("v").mapInArrow(_joined, "v binary")), rates)
    return Model(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES : TEXT_FEATURES + 3], got["y"].to_numpy()[pick], free)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", columns: tuple = ("text", "source", "lang", "n_chars")) -> DataFrame:
    """(doc_id, p_text, p_meta, quality, good) of every row over its whole text, however long. A null text is an empty one; null
    metadata, a null size among them, are no feature. Rows of one or of no id are scored each for itself; other columns are
    ignored, whatever their names; an empty table gives no row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            a, b, q = known.value.score(*_features(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "p_text": np.round(a, 6), "p_meta": np.round(b, 6), "quality": np.round(q, 6), "good": q >= 0.5})

    return _viewed(docs, id_col, *columns).mapInArrow(run, "doc_id bigint, p_text double, p_meta double, quality double, good boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
