"""Clustering under constraints, assignment, and packing of lanes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import Scratch, partitions
from .graph import components
from .nearest import BLOCK, SLACK, near_stars, top_cosine
from .relational import DECISIVE  # noqa: F401
from .running import running

THRESHOLD, BONUS, STRONG, HINT = 0.62, 0.25, 0.85, 0.55
#: Records that are clustered together without a look at what can part them, at most.
CELL = 2000


def agglomerate(sim: np.ndarray, can_link: np.ndarray, threshold: float) -> list[list[int]]:
    """Average linkage down to the threshold, over clusters that may link; of equally similar pairs, the first.

    Similarities are kept as sums over the pairs of two clusters, so a merge adds two rows. A heap holds the linkable
    pairs of clusters that reach the threshold; an entry of a cluster that has changed since is passed over, as its
    pairs were entered anew. Two clusters may link if any two of their members may."""
    upper = np.triu(sim, 1).astype(float)
    total = upper + upper.T
    may = can_link | can_link.T
    near = {i: set(np.flatnonzero(row).tolist()) - {i} for i, row in enumerate(may)}
    members = {i: [i] for i in near}
    age = dict.fromkeys(near, 0)
    heap: list[tuple] = []

    def enter(i: int, j: int) -> None:
        i, j = min(i, j), max(i, j)
        mean = total[i, j] / (len(members[i]) * len(members[j]))
        if mean >= threshold:
            heapq.heappush(heap, (-mean, i, j, age[i], age[j]))

    for i in near:
        for j in near[i]:
            if i < j:
                enter(i, j)
    while heap:
        _, i, j, at_i, at_j = heapq.heappop(heap)
        if age.get(i) != at_i or age.get(j) != at_j:
            continue
        members[i] += members.pop(j)
        total[i] += total[j]
        total[:, i] += total[:, j]
        for k in near.pop(j):
            near[k].discard(j)
            if k != i:
                near[k].add(i)
                near[i].add(k)
        del age[j]
        age[i] += 1
        for k in near[i]:
            enter(i, k)
    return sorted(sorted(m) for m in members.values())


def _units(vectors) -> np.ndarray:
    """Rows of length one; a null vector or one of zeros is near nothing."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    m = np.array([np.zeros(dim) if v is None else np.asarray(v, float) for v in vectors]).reshape(len(vectors), dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _shared(sets) -> np.ndarray:
    """Which rows have an item in common."""
    rows: dict = {}
    for i, items in enumerate(sets):
        for x in set(() if items is None else items) - {None}:
            rows.setdefault(x, []).append(i)
    out = np.zeros((len(sets), len(sets)), bool)
    for r in rows.values():
        out[np.ix_(r, r)] = True
    return out


def similarities(vectors, people, entities, bonus: float = BONUS, strong: float = STRONG) -> tuple[np.ndarray, np.ndarray]:
    """(sim, link) of every pair of records: the cosine with the bonus of a shared entity; a person in common or a strong
    cosine."""
    u = _units(vectors)
    cos = u @ u.T
    return cos + bonus * _shared(entities), _shared(people) | (cos >= strong)


def _tags(sets) -> tuple[list[frozenset], list[list[int]]]:
    """The items of each row, numbered, and the rows of each item."""
    number: dict = {}
    rows: list[list[int]] = []
    of = []
    for i, items in enumerate(sets):
        mine = {number.setdefault(x, len(number)) for x in (() if items is None else items) if x is not None}
        rows += [[] for _ in range(len(number) - len(rows))]
        for k in mine:
            rows[k].append(i)
        of.append(frozenset(mine))
    return of, rows


def _near_pairs(u: np.ndarray, rows: np.ndarray, least: float, tile: int = 4096) -> np.ndarray:
    """(2, pairs): pairs a < b of the rows with a cosine of least or hardly less, tile by tile."""
    small, found = u[rows].astype(np.float32), [np.zeros((2, 0), np.int32)]
    for at in range(0, len(rows), tile):
        for to in range(at, len(rows), tile):
            near = small[at : at + tile] @ small[to : to + tile].T >= least - 1e-5
            a, b = np.divmod(np.flatnonzero(np.triu(near, 1) if at == to else near), near.shape[1])
            found.append(np.stack((rows[at + a], rows[to + b])).astype(np.int32))
    return np.sort(np.concatenate(found, axis=1), axis=0)


def agglomerate_near(vectors, people, entities, threshold: float, bonus: float = BONUS, strong: float = STRONG) -> list[list[int]]:
    """The clusters of ``agglomerate`` over ``similarities``, without a table of all pairs.

    A cluster keeps the sum of its vectors, how many members have which entities, and the clusters near it, that is of a mean
    similarity that reaches the threshold. The mean of two merged clusters to a third lies between their own, so what is near the
    merged one was near one of the two; only there are sums taken anew. Memory follows the vectors and the pairs that are near."""
    u = _units(vectors)
    n = len(u)
    (people, _), (tags, rows_of) = _tags(people), _tags(entities)
    kind_of: dict = {}
    kind = np.array([kind_of.setdefault(t, len(kind_of)) for t in tags], np.int64)  # rows of the same entities
    kinds_of: list[list[int]] = [[] for _ in rows_of]
    for t, k in kind_of.items():
        for e in t:
            kinds_of[e].append(k)
    tags = list(kind_of)
    meets = [np.array(sorted({k for e in t for k in kinds_of[e]}), np.int64) for t in tags] if sum(len(k) ** 2 for k in kinds_of) < 1 << 24 else None

    slack = 1e-9
    strongest = min(threshold, strong)
    some = [_near_pairs(u, np.arange(n), strongest)] + [_near_pairs(u, np.array(r), threshold - bonus) for r in rows_of if len(r) > 1]
    code = np.unique(np.concatenate([p[0].astype(np.int64) * n + p[1] for p in some]))
    del some
    a, b = np.divmod(code, max(n, 1))
    cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", u[a[k : k + 65536]], u[b[k : k + 65536]]) for k in range(0, a.size, 65536))])
    sim = cos + bonus * np.array([not tags[x].isdisjoint(tags[y]) for x, y in zip(kind[a].tolist(), kind[b].tolist())], float)
    tied = cos >= strong

    def lists(keep: np.ndarray) -> list[np.ndarray]:
        x, y = np.concatenate((a[keep], b[keep])), np.concatenate((b[keep], a[keep])).astype(np.int32)
        return np.split(y[np.argsort(x, kind="stable")], np.cumsum(np.bincount(x, minlength=n))[:-1])

    near, bound = (lists(k) if n else [] for k in (sim >= threshold - slack, tied))
    may = tied | np.array([not people[x].isdisjoint(people[y]) for x, y in zip(a.tolist(), b.tolist())], bool)
    may &= sim >= threshold
    first = np.flatnonzero(may)
    first = first[np.lexsort((b[first], a[first], -sim[first]))]
    first = zip((-sim[first]).tolist(), a[first].tolist(), b[first].tolist())
    del code, cos, sim, tied, may, a, b

    def shared(weight: np.ndarray, others: list) -> np.ndarray:
        """Of each cluster (kinds, members of each) the sum of its members' weights."""
        if not others:
            return np.zeros(0)
        sizes = np.fromiter((len(k) for k, _ in others), np.int64, len(others))
        each = weight[np.concatenate([k for k, _ in others])] * np.concatenate([c for _, c in others])
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)

    total, size, root, age = u.copy(), np.ones(n, np.int64), np.arange(n), [0] * n
    members, held = [[i] for i in range(n)], [(kind[i : i + 1], np.ones(1, np.int64)) for i in range(n)]
    people, weight, heap = list(people), np.zeros(len(tags)), []
    head = next(first, None)
    while head or heap:
        if head and (not heap or head < heap[0][:3]):
            (_, i, j), at_i, at_j = head, 0, 0
            head = next(first, None)
        else:
            _, i, j, at_i, at_j = heapq.heappop(heap)
        if age[i] != at_i or age[j] != at_j:
            continue
        root[members[j]] = i
        members[i] += members[j]
        total[i] += total[j]
        size[i] += size[j]
        people[i] |= people[j]
        kinds, of = np.unique(np.concatenate((held[i][0], held[j][0])), return_inverse=True)
        held[i] = kinds, np.bincount(of, np.concatenate((held[i][1], held[j][1]))).astype(np.int64)
        bound[i] = np.unique(root[np.concatenate((bound[i], bound[j]))])
        other = np.unique(root[np.concatenate((near[i], near[j]))])
        other = other[other != i]
        members[j], people[j], near[j], bound[j], held[j] = [], frozenset(), None, None, None
        age[i], age[j] = age[i] + 1, -1
        met = [meets[k] if meets is not None else np.unique([x for e in tags[k] for x in kinds_of[e]]).astype(np.int64) for k in held[i][0].tolist()]
        np.add.at(weight, np.concatenate(met), np.repeat(held[i][1], [len(x) for x in met]))
        mean = (total[other] @ total[i] + bonus * shared(weight, [held[k] for k in other.tolist()])) / (size[i] * size[other])
        weight[:] = 0
        keep = mean >= threshold - slack
        near[i] = other[keep]
        tied = np.isin(other, bound[i])
        for k, m, t in zip(other[keep].tolist(), mean[keep].tolist(), tied[keep].tolist()):
            if m >= threshold and (t or not people[i].isdisjoint(people[k])):
                x, y = min(i, k), max(i, k)
                heapq.heappush(heap, (-m, x, y, age[x], age[y]))
    return sorted(sorted(members[i]) for i in range(n) if age[i] >= 0)


def strong_edges(scratch: Scratch, records: DataFrame, strong: float = STRONG, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect whatever pairs of cosine >= strong connect."""
    return near_stars(scratch, records, strong, "record_id", "vec", block=block)


def may_merge(scratch: Scratch, records: DataFrame, threshold: float, bonus: float = BONUS, strong: float = STRONG, block: int = BLOCK, most: int = CELL) -> DataFrame:
    """(record_id, cell): records of different cells are never merged, whatever the order of merges.

    A merge needs two members that may link, a person in common or a strong cosine; and, as a mean reaches the threshold,
    two whose similarity does, that is a cosine of the threshold, or of the threshold less the bonus with an entity in common. So what
    is merged is connected by links and connected by such pairs, and the parts that both give are the cells. Within a cell the
    same holds again, so cells of more than ``most`` records are parted anew while that parts any further."""
    cells = records.select("record_id", F.lit(0).cast("long").alias("cell"))
    while True:
        told = scratch.write(records.select("record_id", "vec", "people", "entities").join(cells, "record_id"))
        large = told.join(told.groupBy("cell").count().where(F.col("count") > most), "cell", "left_semi").drop("count")
        if large.isEmpty():
            return cells
        large = scratch.write(large)

        def parts(*edges: DataFrame) -> DataFrame:
            every = edges[0]
            for e in edges[1:]:
                every = every.unionByName(e)
            return components(scratch, scratch.write(every.where("a <> b").distinct()))

        person = large.select("cell", "record_id", F.explode("people").alias("p")).where("p is not null")
        least = person.groupBy("cell", "p").agg(F.min("record_id").alias("b"))
        same = person.join(least, ["cell", "p"]).selectExpr("record_id a", "b")
        by_link = parts(same, near_stars(scratch, large, strong - SLACK, "record_id", "vec", block=block, group_col="cell"))
        entity = large.select("record_id", "vec", "cell", F.explode("entities").alias("e")).where("e is not null").withColumn("e", F.struct("cell", "e"))
        close = near_stars(scratch, large, threshold - SLACK, "record_id", "vec", block=block, group_col="cell")
        by_near = parts(close, near_stars(scratch, entity, threshold - bonus - SLACK, "record_id", "vec", block=block, group_col="e"))
        of = large.select("record_id", "cell").join(by_link.toDF("n1", "c1"), F.col("record_id") == F.col("n1"), "left").join(by_near.toDF("n2", "c2"), F.col("record_id") == F.col("n2"), "left")
        of = of.select("record_id", F.xxhash64("cell", F.coalesce("c1", "record_id"), F.coalesce("c2", "record_id")).alias("cell"))
        before, now = (x.select("cell").distinct().count() for x in (large, of))
        cells = scratch.write(told.join(of.select("record_id"), "record_id", "left_anti").select("record_id", "cell").unionByName(of))
        if before == now:
            return cells


def cluster_records(scratch: Scratch, records: DataFrame, threshold: float = THRESHOLD, hints: DataFrame | None = None, most: int = CELL, dense: int = CELL) -> DataFrame:
    """(record_id, root). Each cell of ``may_merge`` is clustered alone, over the similarities of all its pairs; no larger set of
    records meets. A cell of more than ``dense`` records is clustered over its near pairs alone, to the same end. hints (a, b) join the clusters of their records afterwards. A threshold must be above the bonus."""
    inside = records.select("record_id", "vec", "people", "entities").join(may_merge(scratch, records, threshold, most=most), "record_id").withColumnRenamed("cell", "c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record_id")
        ids = pdf["record_id"].tolist()
        told = pdf["vec"].tolist(), pdf["people"].tolist(), pdf["entities"].tolist()
        groups = agglomerate(*similarities(*told), threshold) if len(ids) <= dense else agglomerate_near(*told, threshold)
        return pd.DataFrame([(ids[i], ids[g[0]]) for g in groups for i in g], columns=["record_id", "root"])

    out = scratch.write(inside.groupBy("c").applyInPandas(run, "record_id string, root string"))
    if hints is None:
        return out
    of = out.withColumnsRenamed({"record_id": "r", "root": "c"})
    edges = hints.join(of.withColumnsRenamed({"r": "a", "c": "ra"}), "a").join(of.withColumnsRenamed({"r": "b", "c": "rb"}), "b").selectExpr("ra a", "rb b")
    merged = components(scratch, edges)
    return out.join(merged, F.col("root") == F.col("node"), "left").select("record_id", F.coalesce("component", "root").alias("root"))


def override_hints(scratch: Scratch, hints: DataFrame, records: DataFrame, most: int = 3, least: float = HINT) -> DataFrame:
    """(a, b): a record that hints at what it overrides, with other, not later records near the hint that share an entity. The
    nearest ``most`` of all records are chosen before these tests, the record itself among them. hints: (record_id, hint_vec,
    decision_date, entities); records: (record_id, vec, decision_date, entities)."""
    near = top_cosine(scratch, hints.selectExpr("record_id id", "hint_vec vec"), records.selectExpr("record_id id", "vec"), most).selectExpr("query_id a", "id b", "cos")
    told = near.where((F.col("cos") >= least) & (F.col("a") != F.col("b")))
    told = told.join(hints.selectExpr("record_id a", "decision_date da", "entities ea"), "a").join(records.selectExpr("record_id b", "decision_date db", "entities eb"), "b")
    return told.where((F.col("db") <= F.col("da")) & F.arrays_overlap("ea", "eb")).select("a", "b")


def first_groups(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, grp) of groups that a model gave (pos, topic, record_ids): a record's first group counts; records
    without one are alone."""
    told = groups.select("pos", F.posexplode("record_ids").alias("k", "record_id")).join(records.select("record_id"), "record_id", "left_semi")
    one = told.groupBy("record_id").agg(F.min(F.struct("pos", "k")).alias("m")).select("record_id", F.concat(F.lit("g"), F.col("m.pos").cast("string")).alias("grp"))
    return records.select("record_id").join(one, "record_id", "left").select("record_id", F.coalesce("grp", F.concat(F.lit("s:"), F.col("record_id"))).alias("grp"))


def name_clusters(assigned: DataFrame, records: DataFrame, by: str = "root") -> tuple[DataFrame, DataFrame]:
    """Records with cluster_id, and table clusters: ids from the sorted members, the topic that most records give, of
    equals the earliest record's."""
    ids = assigned.groupBy(by).agg(F.collect_list("record_id").alias("m")).select(by, T.cluster_id(F.col("m")).alias("cluster_id"))
    told = records.drop("cluster_id").join(assigned, "record_id").join(ids, by).drop(by)
    votes = told.groupBy("cluster_id", "topic_label").agg(F.count("*").alias("n"), F.min(F.struct("decision_date", "record_id")).alias("first"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "first")
    topic = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster_id", F.col("topic_label").alias("topic"))
    clusters = told.groupBy("cluster_id").agg(F.count("*").alias("n_records")).join(topic, "cluster_id")
    return told, clusters.select("cluster_id", "topic", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("current_state"), "n_records")


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight, each row and column once, none of weight 0: shortest augmenting
    paths with potentials, over a small dense table."""
    w = np.asarray(weight, float)
    if not w.size:
        return []
    flip = w.shape[0] > w.shape[1]
    cost = w.max() - (w.T if flip else w)
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for r in range(n):
        row_of[m], j = r, m
        least, via, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j] != n:
            done[j] = True
            i = row_of[j]
            slack = np.where(done[:m], np.inf, cost[i] - u[i] - v[:m])
            better = slack < least[:m]
            least[:m][better], via[:m][better] = slack[better], j
            free = np.where(done[:m], np.inf, least[:m])
            k = int(free.argmin())
            step = free[k]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
        while j != m:
            row_of[j], j = row_of[via[j]], via[j]
    pairs = [(int(row_of[j]), j) for j in range(m) if row_of[j] < n]
    pairs = [(b, a) if flip else (a, b) for a, b in pairs]
    return sorted(p for p in pairs if w[p] > 0)


def auction(row: np.ndarray, col: np.ndarray, weight: np.ndarray, unit: float = 1e-4) -> np.ndarray:
    """Numbers of the candidates (row, col, weight) that match rows and columns one to one with greatest total weight, if weights
    are multiples of ``unit``; else within ``unit`` of it. Rows and columns are numbered from 0.

    All free rows bid at once for the column that is worth most to them at the present prices, by what it is worth more
    than their second best and a margin; the highest bid has it, and who had it is free again. Margins shrink by steps to
    less than unit over the rows there are, where no better match is left. Memory follows the candidates, not rows times
    columns. So that any row may stay alone, rows and columns each have a copy: the copies are matched as the first ones
    are, and a row may take its own copy at no weight."""
    keep = np.flatnonzero(weight > 0)
    if not keep.size:
        return keep
    # rows and copies of columns bid for columns and copies of rows
    n, m = int(row.max()) + 1, int(col.max()) + 1
    who = np.concatenate((row[keep], n + col[keep], np.arange(n), n + np.arange(m)))
    what = np.concatenate((col[keep], m + row[keep], m + np.arange(n), np.arange(m)))
    worth = np.concatenate((weight[keep], weight[keep], np.zeros(n + m)))
    of = np.concatenate((keep, np.full(keep.size + n + m, -1)))
    order = np.lexsort((what, who))
    who, what, worth, of = who[order], what[order], worth[order], of[order]
    total, start = n + m, np.searchsorted(who, np.arange(n + m + 1))
    price, last = np.zeros(total), unit / (2 * total + 2)
    margin = max(last, float(worth.max()) / 4)
    while True:
        owner, held = np.full(total, -1), np.full(total, -1)  # of what, and the candidate by which
        free = np.arange(total)
        while free.size:
            size = start[free + 1] - start[free]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.repeat(start[free] - first, size) + np.arange(size.sum())
            gain = worth[at] - price[what[at]]
            best = np.maximum.reduceat(gain, first)
            group = np.repeat(np.arange(free.size), size)
            top = np.flatnonzero(gain == best[group])
            chosen = top[np.unique(group[top], return_index=True)[1]]
            gain[chosen] = -np.inf
            second = np.maximum.reduceat(gain, first)  # a lone candidate, one's own copy, has no rival
            bid = price[what[at[chosen]]] + np.where(np.isfinite(second), best - second, 0.0) + margin
            thing = what[at[chosen]]
            by = np.lexsort((-free, bid, thing))
            won = by[np.flatnonzero(np.concatenate((thing[by][1:] != thing[by][:-1], [True])))]
            lost = owner[thing[won]]
            price[thing[won]], owner[thing[won]], held[thing[won]] = bid[won], free[won], at[chosen[won]]
            free = np.concatenate((np.delete(free, won), lost[lost >= 0]))
        if margin <= last:
            return np.sort(of[held][of[held] >= 0])
        margin = max(last, margin / 6)


def transport(weight: np.ndarray, supply: np.ndarray, demand: np.ndarray, unit: float = 1e-4) -> np.ndarray:
    """How many of each row's ``supply`` go to each column, of greatest total weight, no column having more than its ``demand``:
    shortest augmenting paths as in ``assign``, from one row at a time, all columns of one distance at once. Weights that are
    multiples of unit are taken as whole numbers."""
    if supply.sum() > demand.sum():
        return transport(weight.T, demand, supply, unit).T
    cost = (weight.max() - weight) / unit
    if np.allclose(cost, np.rint(cost), rtol=0, atol=1e-6):
        cost = np.rint(cost)
    left, free = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    n, m = cost.shape
    u, v, flow = cost.min(1), np.zeros(m), np.zeros((n, m), np.int64)
    for r in range(n):
        for j in np.flatnonzero(cost[r] == u[r]):
            some = min(left[r], free[j])
            flow[r, j], left[r], free[j] = some, left[r] - some, free[j] - some
    for r in range(n):
        while left[r]:
            far, via = cost[r] - u[r] - v, np.full(m, r)
            row_far, row_via = np.full(n, np.inf), np.full(n, -1)
            row_far[r], open_ = 0, np.ones(m, bool)
            while True:
                least = far[open_].min()
                at = np.flatnonzero(open_ & (far == least))
                if (end := at[free[at] > 0]).size:
                    break
                open_[at] = False
                fresh = np.flatnonzero((flow[:, at] > 0).any(1) & np.isinf(row_far))
                if fresh.size:
                    row_far[fresh], row_via[fresh] = least, at[(flow[np.ix_(fresh, at)] > 0).argmax(1)]
                    step = least + (cost[fresh] - u[fresh][:, None]) - v
                    best = step.argmin(0)
                    step = step[best, np.arange(m)]
                    better = open_ & (step < far)
                    far[better], via[better] = step[better], fresh[best[better]]
            done = np.isfinite(row_far)
            u[done] += least - row_far[done]
            v[~open_] -= least - far[~open_]
            for j in end.tolist():  # all are as near
                path, k, i = [], j, via[j]
                while i != r:
                    path.append((i, k))
                    k = row_via[i]
                    path.append((i, k))
                    i = via[k]
                some = min([left[r], free[j], *(flow[p] for p in path[1::2])])
                for x, (i, c) in enumerate(path):
                    flow[i, c] += -some if x % 2 else some
                flow[r, k] += some
                left[r] -= some
                free[j] -= some
    return np.where(weight > 0, flow, 0)


#: A block of so many cells at most is matched as a dense table.
DENSE = 1 << 14


def match(candidates: DataFrame, left: str, right: str, weight: str, block: str, unit: float = 1e-4) -> DataFrame:
    """One-to-one matches of greatest weight within each block of candidate pairs; blocks share no row. Of a pair that is
    given twice, the greater weight counts. Within a block, what no candidates connect is matched apart, so a task holds the
    candidates of one connected part; a large part is matched by ``auction``, exactly for weights that are multiples of
    ``unit``."""
    types = dict(candidates.dtypes)
    scratch = Scratch(candidates.sparkSession, "match")
    some = scratch.write(candidates.where(F.col(weight) > 0).groupBy(block, left, right).agg(F.max(weight).cast("double").alias(weight)))
    node = lambda c, side: F.xxhash64(F.lit(side), block, c)
    part = components(scratch, some.select(node(left, 0).alias("a"), node(right, 1).alias("b")))
    told = some.join(part, node(left, 0) == F.col("node")).drop("node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([left, right], ignore_index=True)
        (row, rows), (col, cols) = (pd.factorize(pdf[c], sort=True) for c in (left, right))
        if len(rows) * len(cols) <= DENSE:
            w = np.zeros((len(rows), len(cols)))
            w[row, col] = pdf[weight]
            found = [(rows[i], cols[j], float(w[i, j])) for i, j in assign(w)]
            return pd.DataFrame(found, columns=[left, right, weight])
        return pdf.loc[auction(row, col, pdf[weight].to_numpy(), unit), [left, right, weight]]

    return told.groupBy(block, "component").applyInPandas(lambda pdf: run(pdf), f"{left} {types[left]}, {right} {types[right]}, {weight} double")


#: Classes of equal rows are matched as a dense table up to so many cells.
CLASSES = 1 << 24


def match_classes(candidates: DataFrame, left: str, right: str, weight: str, block: str, n_left: str, n_right: str, unit: float = 1e-4, most: int = CLASSES) -> DataFrame:
    """(block, left, right, weight, n): as ``match`` over classes of equal rows, n pairs of rows of the two classes. Candidates have the
    numbers of rows of either class; a pair of classes is given once. So candidates follow the classes, not the rows."""
    types = dict(candidates.dtypes)
    scratch = Scratch(candidates.sparkSession, "classes")
    some = scratch.write(candidates.where(F.col(weight) > 0).select(block, left, right, F.col(weight).cast("double").alias(weight), n_left, n_right))
    node = lambda c, side: F.xxhash64(F.lit(side), block, c)
    part = components(scratch, some.select(node(left, 0).alias("a"), node(right, 1).alias("b")))
    told = some.join(part, node(left, 0) == F.col("node")).drop("node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([left, right], ignore_index=True)
        (row, rows), (col, cols) = (pd.factorize(pdf[c], sort=True) for c in (left, right))
        supply, demand = np.zeros(len(rows), np.int64), np.zeros(len(cols), np.int64)
        supply[row], demand[col] = pdf[n_left], pdf[n_right]
        if len(rows) * len(cols) <= most:
            w = np.zeros((len(rows), len(cols)))
            w[row, col] = pdf[weight]
            pdf["n"] = transport(w, supply, demand, unit)[row, col]
        else:  # each row for itself
            first, other = np.cumsum(supply) - supply, np.cumsum(demand) - demand
            times = supply[row] * demand[col]
            of = np.repeat(np.arange(len(pdf)), times)
            i, j = np.divmod(np.arange(of.size) - np.repeat(np.cumsum(times) - times, times), demand[col][of])
            kept = auction(first[row][of] + i, other[col][of] + j, pdf[weight].to_numpy()[of], unit)
            pdf["n"] = np.bincount(of[kept], minlength=len(pdf))
        return pdf.loc[pdf["n"] > 0, [block, left, right, weight, "n"]]

    return told.groupBy(block, "component").applyInPandas(lambda pdf: run(pdf), f"{block} {types[block]}, {left} {types[left]}, {right} {types[right]}, {weight} double, n long")


def pairs_of_classes(matched: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str, block: str, left_key: str, right_key: str) -> DataFrame:
    """matched (block, left, right, ..., n) with the rows of the classes dealt out, each once: lefts (left_key, block, left) and rights in
    the order of their keys."""
    w = lambda c, by: Window.partitionBy(block, c).orderBy(by)
    so_far = lambda c, by: F.coalesce(F.sum("n").over(w(c, by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = matched.withColumns({"_l": so_far(left, right), "_r": so_far(right, left)}).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    told = told.withColumns({"_l": F.col("_l") + F.col("_i"), "_r": F.col("_r") + F.col("_i")}).drop("_i", "n")
    numbered = lambda df, key, c, at: df.select(key, block, c, F.row_number().over(w(c, key)).cast("long").alias(at))
    return told.join(numbered(lefts, left_key, left, "_l"), [block, left, "_l"]).join(numbered(rights, right_key, right, "_r"), [block, right, "_r"]).drop("_l", "_r")


def match_candidates(truth: DataFrame, found: DataFrame, pairs: DataFrame, days: int = 5, least: float = 0.55) -> DataFrame:
    """Pairs at most ``days`` apart that are near in meaning (pairs: truth_id, decision_id, cos) or share evidence."""
    from .relational import near_dates

    near = near_dates(truth.selectExpr("truth_id", "date td", "evidence te"), found.selectExpr("decision_id", "decided_at dd", "evidence de"), "td", "dd", days)
    shared = F.coalesce(F.arrays_overlap("te", "de"), F.lit(False))
    return near.join(pairs, ["truth_id", "decision_id"], "left").withColumn("shared", shared).where((F.coalesce("cos", F.lit(0.0)) >= least) | F.col("shared")).select("truth_id", "decision_id", "cos", "shared")


def pack_lanes(items: DataFrame, lane: str, start: str, stop: str, key: str) -> DataFrame:
    """Adds row: within a lane, each item takes the first row that is free at its start.

    A lane is cut wherever all that began before has ended, for there the rows begin anew: cuts are where a start isn't
    before the latest stop so far. So a long lane is many tasks, and rows of one run are taken from a heap of free ones.
    Items without either end have no row."""
    scratch, kinds = Scratch(items.sparkSession, "lanes"), dict(items.dtypes)
    ticks = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith(("timestamp", "date")) else F.col(c).cast("long")
    rows = items.withColumns({"_lane": F.xxhash64(lane), "_from": ticks(start), "_to": ticks(stop)})
    whole = rows.where("_from is not null and _to is not null")
    order = [lane, "_from", key]
    cut = running(scratch, whole, "_lane", order, _latest=("_to", "max before")).withColumn("_cut", (F.col("_from") >= F.col("_latest")).cast("long"))
    runs = running(scratch, cut.drop("_latest"), "_lane", order, _run=("_cut", "sum")).drop("_cut")
    columns = items.columns

    def fill(batches):
        run, busy, free, n = None, [], [], 0
        for batch in batches:
            placed = []
            for *now, a, b in zip(*(batch.column(c).to_pylist() for c in ("_lane", lane, "_run", "_from", "_to"))):
                if now != run:
                    run, busy, free, n = now, [], [], 0
                while busy and busy[0][0] <= a:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                row = heapq.heappop(free) if free else n
                n += row == n
                heapq.heappush(busy, (b, row))
                placed.append(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(placed, pa.int64())], [*columns, "row"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", row bigint"
    dealt = runs.repartition(partitions(items.sparkSession), "_lane", "_run").sortWithinPartitions("_lane", lane, "_run", "_from", key)
    return dealt.mapInArrow(fill, ddl).unionByName(rows.where("_from is null or _to is null").select(*columns, F.lit(None).cast("long").alias("row")))


def threshold_grid(pairs_scored: DataFrame, thresholds: list[float], bonuses: list[float], top: int = 12) -> DataFrame:
    """Leaderboard of (threshold, bonus) by pairwise F1 over scored pairs (cos, shared, same)."""
    spark = pairs_scored.sparkSession
    grid = spark.createDataFrame([(t, b) for t in thresholds for b in bonuses], "threshold double, bonus double")
    put = pairs_scored.join(F.broadcast(grid)).withColumn("hit", F.col("cos") + F.when(F.col("shared"), F.col("bonus")).otherwise(0.0) >= F.col("threshold"))
    n = put.groupBy("threshold", "bonus").agg(F.count_if(F.col("hit") & F.col("same")).alias("tp"), F.count_if("hit").alias("found"), F.count_if("same").alias("true"))
    p, r = F.col("tp") / F.greatest(F.col("found"), F.lit(1e-9)), F.col("tp") / F.greatest(F.col("true"), F.lit(1e-9))
    return n.withColumn("f1", F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6)).orderBy(F.col("f1").desc(), "threshold", "bonus").limit(top)
