"""Near-duplicate vectors by product quantisation.

Vectors go to coarse inverted lists; what is left of them after their list's centre is
coded in subspaces.  A vector probes every list that may hold a neighbour, reads the
distances to that list's vectors from tables made for it (asymmetric: it is not coded
itself), and the vectors that the tables can't rule out are compared by exact cosine in
double precision.

The table distance is off by at most the coding error of the vector in the list, which
is stored, so the tables rule out no pair at the threshold.  Which lists are probed
follows from the same distance: a neighbour of q at distance r that lies in list j
instead of q's own list i needs d(q,cj)^2 - d(q,ci)^2 <= 2 r |cj - ci| cos(a), a being the
angle between two directions; cos(a) is taken up to ``sure`` standard deviations of the
directions of such a space.  Nothing bounds the number of probes.

Equal vectors are one member with a count, so copies cost nothing and make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.cells import each_cell
from cellfold.llm.common import components, uniform
from cellfold.runtime import written

#: Vectors the index is fitted on, vectors of a list the lists aim at, most lists.
SAMPLE, PER_LIST, MOST_LISTS = 8192, 500, 4096
#: Members and probing vectors of one cell.
SIDE = 1024
SUBSPACES, CODES = 8, 256
SURE = 3.0


@dataclass
class Index:
    centres: np.ndarray    # lists x d
    books: np.ndarray      # subspaces x codes x d / subspaces
    radius: float          # distance of unit vectors at the threshold
    sure: float

    def coded(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what is left of unit vectors after their centre, and the coding error."""
        rest = vectors - self.centres[lists]
        m, _, width = self.books.shape
        codes = np.stack([nearest(rest[:, k * width:(k + 1) * width], self.books[k])[0] for k in range(m)], axis=1)
        shown = np.concatenate([self.books[k][codes[:, k]] for k in range(m)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - shown, axis=1)

    def probes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and which lists it probes (vectors x lists)."""
        squares = (self.centres**2).sum(axis=1)
        d2 = (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ self.centres.T + squares[None]
        own = d2.argmin(axis=1)
        # By products as well: vectors x lists, not vectors x lists x components.
        between = np.sqrt(np.maximum(squares[own][:, None] - 2 * self.centres[own] @ self.centres.T + squares[None], 0))
        share = min(1.0, self.sure / np.sqrt(vectors.shape[1]))
        return own, d2 - d2[np.arange(len(own)), own][:, None] <= 2 * self.radius * between * share + 1e-9


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (centres**2).sum(axis=1)[None] - 2 * points @ centres.T
    found = d2.argmin(axis=1)
    return found, d2[np.arange(len(points)), found]


def means(points: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), count, replace=len(points) < count)].copy()
    for _ in range(rounds):
        at, _ = nearest(points, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(at, minlength=count)
        np.add.at(sums, at, points)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def unit(lists: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; dividing by the largest part first keeps squares finite."""
    x = np.stack(lists.to_numpy()).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def fit(members: DataFrame, size: int, threshold: float, sample: int = SAMPLE, sure: float = SURE) -> Index | None:
    """Centres and codebooks from about ``sample`` of the ``members`` (``vec_id, vector``),
    drawn by a hash of the id, so that what reaches the driver is bounded."""
    total = members.count()
    if not total:
        return None
    drawn = members.where(uniform("vec_id", F.lit("index")) < sample / total).limit(2 * sample)
    rows = drawn.toPandas().sort_values("vec_id")
    if not len(rows):
        rows = members.orderBy("vec_id").limit(1).toPandas()
    points = unit(rows["vector"])
    lists = int(min(MOST_LISTS, max(1, round(total / PER_LIST)), len(points)))
    centres = means(points, lists, 1)
    parts = max(k for k in range(1, SUBSPACES + 1) if size % k == 0)
    rest, width = points - centres[nearest(points, centres)[0]], size // parts
    books = np.stack([means(rest[:, k * width:(k + 1) * width], CODES, 2 + k) for k in range(parts)])
    return Index(centres, books, float(np.sqrt(2 - 2 * threshold)), sure)


def compare(cell: pd.DataFrame, index: Index, threshold: float) -> pd.DataFrame | None:
    """Links of one cell: per member how many vectors it links with here, and a link to the
    first of its component in the cell."""
    asks = cell["asks"].to_numpy(bool)
    q, x = cell[asks], cell[~asks]
    if not len(q) or not len(x):
        return None
    at = int(cell["list"].iloc[0])
    qv, xv = unit(q["vector"]), unit(x["vector"])
    codes, error = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), -1), x["error"].to_numpy()
    q_id, x_id = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
    q_n, x_n, own = q["copies"].to_numpy(), x["copies"].to_numpy(), q["own"].to_numpy() == at
    parts, _, width = index.books.shape
    books = index.books.astype(np.float32)
    rest = (qv - index.centres[at]).astype(np.float32).reshape(len(q), parts, width).transpose(1, 0, 2)
    bound = (index.radius + error[None]) ** 2 + 1e-4  # wider than what single precision can be off
    met = np.zeros((len(q), len(x)), bool)
    for k in range(0, len(q), 64):
        part = rest[:, k:k + 64]
        tables = (part**2).sum(axis=2)[:, :, None] - 2 * part @ books.transpose(0, 2, 1) + (books**2).sum(axis=2)[:, None]
        d2 = np.zeros((part.shape[1], len(x)), np.float32)
        for s in range(parts):
            d2 += np.take(tables[s], codes[:, s], axis=1)
        maybe = d2 <= bound
        maybe &= ~own[k:k + 64, None] | (q_id[k:k + 64, None] < x_id[None])
        columns = np.nonzero(maybe.any(axis=0))[0]
        if len(columns):
            met[k:k + 64, columns] = maybe[:, columns] & (qv[k:k + 64] @ xv[columns].T >= threshold)
    if not met.any():
        return None
    # Links among this cell's vectors, a vector that both asks and is asked being one.
    ids, where = np.unique(np.concatenate([q_id, x_id]), return_inverse=True)
    left, right = where[:len(q_id)], where[len(q_id):]
    root = np.full(len(ids), -1)
    rows_of, columns_of = [[] for _ in ids], [[] for _ in ids]
    for k, n in enumerate(left):
        rows_of[n].append(k)
    for k, n in enumerate(right):
        columns_of[n].append(k)
    for first in np.unique(np.concatenate([left[met.any(axis=1)], right[met.any(axis=0)]])):
        front = np.array([first]) if root[first] < 0 else np.zeros(0, int)
        while len(front):
            root[front] = first
            r = [k for n in front for k in rows_of[n]]
            c = [k for n in front for k in columns_of[n]]
            seen = np.unique(np.concatenate([right[met[r].any(axis=0)], left[met[:, c].any(axis=1)]]))
            front = seen[root[seen] < 0]
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, left, met @ x_n)
    np.add.at(counts, right, q_n @ met)
    hit = counts > 0
    return pd.DataFrame({"vec_id": ids[hit], "links": counts[hit], "first": ids[root[hit]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, index: Index | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id, vector``).

    Vectors link at a cosine of ``threshold`` or more.  Null and zero vectors, such with
    null or non-finite parts, rows without a vec_id and vectors of another length than
    most link with nothing.  Rows that repeat a vec_id are one vector each.
    """
    # Singles stay singles on the way: half the bytes, and exact as doubles later.
    kind = "array<float>" if dict(vectors.dtypes)["vector"] == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("vector").cast(kind).alias("vector"))
    able = rows.where(usable("vector") & F.col("vec_id").isNotNull())
    common = able.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 0
    able = able.where(F.size("vector") == size)
    members = written(able.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "members")
    index = index or fit(members.select("vec_id", "vector"), size, threshold)
    alone = rows.withColumn("_able", usable("vector") & F.col("vec_id").isNotNull() & (F.size("vector") == size))
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 512):
                part = frame.iloc[k:k + 512]
                points = unit(part["vector"])
                own, probes = sent.value.probes(points)
                codes, error = sent.value.coded(points, own)
                # The lower of two lists asks the other.
                lists = [[int(j) for j in np.nonzero(p)[0] if j >= o] for p, o in zip(probes, own)]
                yield part.assign(own=own, codes=[bytes(c) for c in codes], error=error, probes=lists)

    entries = written(members.mapInPandas(
        listed, f"vector {kind}, vec_id long, copies long, own long, codes binary, error double, probes array<long>"), "entries")
    held = entries.groupBy(F.col("own").alias("list")).agg(F.count("*").alias("held"))
    asked = entries.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asked"))
    # One row per list: at most MOST_LISTS.
    sizes = F.broadcast(held.join(asked, "list", "full").select("list", *[
        F.ceil(F.coalesce(c, F.lit(1)) / SIDE).alias(c) for c in ("held", "asked")]))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["list", "member_part", "asking_part", "asks", "vec_id", "copies", "own", "vector", "codes", "error"]
    member = entries.withColumn("list", F.col("own")).join(sizes, "list").withColumn("member_part", deal("held", 0)).withColumn(
        "asking_part", every("asked")).withColumn("asks", F.lit(False)).select(columns)
    asking = entries.withColumn("list", F.explode("probes")).join(sizes, "list").withColumn("asking_part", deal("asked", 1)).withColumn(
        "member_part", every("held")).withColumn("asks", F.lit(True)).withColumn("codes", F.lit(None).cast("binary")).select(columns)
    keys = ["list", "member_part", "asking_part"]
    cells = member.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys)
    found = written(cells.mapInPandas(
        lambda frames: each_cell(frames, keys, lambda cell: compare(cell, sent.value, threshold)),
        "vec_id long, links long, first long"), "found")
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    totals = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = written(members.join(totals, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id")), "named")
    linked = alone.where("_able").join(named, "vector").select("vec_id", "n_links", "component_id")
    rest = alone.where(~F.col("_able")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
