"""Exact top-k by inner product: best-first search of an M-tree.

The inner product becomes a distance by one more coordinate: with R2 the largest squared
length of all vectors, x gets sqrt(R2 - |x|^2) and a query 0, so that
|q - x|^2 = |q|^2 + R2 - 2 <q, x>, and the nearest vectors have the largest products.

The tree has three levels.  Routing objects, drawn from the vectors, each hold the
vectors nearest to them; those are dealt into parts of bounded size; a part is cut into
pages.  Each node stores its routing object, its covering radius and its distance to its
parent, and each entry of a page its distance to the page's routing object.  The search
keeps nodes by the least distance they can hold, goes on with the best, and with the
stored distances skips, by the triangle inequality, pages and entries that cannot be
among the k best before computing any distance to them.

A query first searches the part of its nearest routing object.  With the k-th score
found there it goes only to the parts whose covering radius leaves something to find.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.cells import each_cell
from cellfold.llm.common import uniform
from cellfold.runtime import written

#: Vectors of a part, entries of a page, queries that search a part in one task.
PART, PAGE, ASKING = 8192, 512, 256
#: Routing objects at most, drawn from at most twice so many vectors.
MOST_ROUTES = 2048
#: Distances are computed in doubles from whole numbers; bounds are taken this much wider.
SLACK = 1e-6


@dataclass
class Space:
    square: int            # the largest squared length
    routes: np.ndarray     # routing objects with their extra coordinate

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.square - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, extra[:, None]], axis=1)


def asked(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    d2 = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None] - 2 * left @ right.T
    return np.sqrt(np.maximum(d2, 0))


def pages_of(points: np.ndarray, ids: np.ndarray, page: int = PAGE, seed: int = 3) -> dict[str, list]:
    """A part as pages: every vector goes to the nearest of the part's routing objects, and
    what a routing object has is cut, by distance, into pages of bounded size."""
    rng = np.random.default_rng(seed)
    routes = points[rng.choice(len(points), max(1, -(-len(points) // page)), replace=False)]
    away = distances(points, routes)
    near, away = away.argmin(axis=1), away.min(axis=1)
    found: dict[str, list] = {"route": [], "radius": [], "ids": [], "entries": [], "away": []}
    for k in range(len(routes)):
        rows = np.nonzero(near == k)[0]
        rows = rows[np.lexsort((ids[rows], away[rows]))]
        for start in range(0, len(rows), page):
            part = rows[start:start + page]
            found["route"].append(routes[k])
            found["radius"].append(away[part].max())
            found["ids"].append(ids[part])
            found["entries"].append(points[part])
            found["away"].append(away[part])
    return found


class Best:
    """The k largest scores with their ids, ties to the smaller id."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        reached = scores >= self.least()
        if not reached.any():
            return
        scores, ids = scores[reached], ids[reached]
        self.scores, self.ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((self.ids, -self.scores))[:self.k]
        self.scores, self.ids = self.scores[order], self.ids[order]

    def least(self) -> float:
        """A score that has to be reached to matter."""
        return max(self.floor, self.scores[-1]) if len(self.scores) == self.k else self.floor


def search(query: np.ndarray, own: int, floor: float, k: int, square: int, tree: dict, above: float, counted: list) -> Best:
    """Best-first over the pages of one part.  ``above``: distance to the part's routing object."""
    best, length2 = Best(k, floor), float(query @ query)

    def reach() -> float:
        """The distance within which a vector still matters."""
        least = best.least()
        return np.sqrt(max(0.0, length2 + square - 2 * least)) + SLACK if least > -np.inf else np.inf

    # Without any distance to a page: |d(q, parent) - d(page, parent)| - radius.
    bounds = np.maximum(0, np.abs(above - tree["parent"]) - tree["radius"])
    queue = [(bound, -1.0, n) for n, bound in enumerate(bounds.tolist())]
    heapq.heapify(queue)
    while queue and queue[0][0] <= reach():
        bound, to, n = heapq.heappop(queue)
        if to < 0:  # now with the page's own distance
            route = tree["route"][n]
            to = float(np.sqrt(max(0.0, length2 + tree["route2"][n] - 2 * (route @ query))))
            counted[0] += 1
            heapq.heappush(queue, (max(bound, to - tree["radius"][n] - SLACK), to, n))
            continue
        may = np.abs(to - tree["away"][n]) <= reach() + SLACK
        some = int(np.count_nonzero(may))
        if some:
            counted[0] += some
            entries, ids = tree["entries"][n], tree["ids"][n]
            if 2 * some < len(ids):
                entries, ids = entries[may], ids[may]
            scores = np.rint(entries @ query)
            scores[ids == own] = -np.inf
            best.add(scores, ids)
    keep = (best.scores >= floor) & (best.scores > -np.inf)
    best.scores, best.ids = best.scores[keep], best.ids[keep]
    return best


def tree_of(nodes: pd.DataFrame, width: int) -> dict:
    """The pages of one part, ready to be searched."""
    routes = [np.frombuffer(x) for x in nodes["object"]]
    return {"route": routes, "route2": [float(r @ r) for r in routes], "radius": nodes["radius"].to_numpy(), "parent": nodes["parent"].to_numpy(),
            "ids": [np.frombuffer(x, np.int64) for x in nodes["ids"]], "away": [np.frombuffer(x) for x in nodes["away"]],
            "entries": [np.frombuffer(x).reshape(-1, width) for x in nodes["entries"]]}


def fit(rows: DataFrame, most: int = MOST_ROUTES, part: int = PART) -> Space | None:
    """Largest length over all rows, and routing objects from a sample by hash of the id."""
    known = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    if not known["n"]:
        return None
    count = int(min(most, max(1, known["n"] // part)))
    drawn = rows.where(uniform("vec_id", F.lit("routes")) < 1.5 * count / known["n"]).limit(2 * count).toPandas()
    if len(drawn) < count:
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toPandas()
    drawn = drawn.sort_values("vec_id").head(count)
    made = Space(int(known["square"]), np.zeros((0, 0)))
    made.routes = made.lifted(np.stack(drawn["v"]))
    return made


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    ``vectors`` has ``vec_id, vector``; each component x counts as floor(scale * x).
    Queries are the rows whose id is divisible by ``every``, candidates all others' rows.
    Vectors that are null, hold null or non-finite components or have no id take no part,
    nor do those of another length than most.  Of several rows with one id the smallest
    vector counts.  Ties go to the smaller vec_id.
    """
    whole = F.transform(F.col("vector").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(usable("vector"))
    rows = rows.select("vec_id", whole.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = written(rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    space = fit(rows)
    empty = "query_id long, rank int, vec_id long, score long"
    if space is None:
        return rows.sparkSession.createDataFrame([], empty)
    sent = rows.sparkSession.sparkContext.broadcast(space)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = sent.value.lifted(np.stack(frame["v"]))
            away = distances(points, sent.value.routes)
            yield frame.assign(route=away.argmin(axis=1), away=away.min(axis=1))

    at = written(rows.mapInPandas(placed, "vec_id long, v array<double>, route long, away double"), "placed")
    held = written(at.groupBy("route").agg(F.ceil(F.count("*") / PART).alias("parts"), F.max("away").alias("radius")), "routes")
    radius = {r["route"]: (r["parts"], r["radius"]) for r in held.collect()}  # one row per routing object
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = at.join(F.broadcast(held.select("route", "parts")), "route").withColumn("part", part)

    def build(cell: pd.DataFrame) -> pd.DataFrame:
        route = int(cell["route"].iloc[0])
        points, ids = sent.value.lifted(np.stack(cell["v"])), cell["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids)
        made = pages_of(points[order], ids[order])
        up = np.linalg.norm(np.stack(made["route"]) - sent.value.routes[route], axis=1)
        return pd.DataFrame({"route": route, "part": int(cell["part"].iloc[0]), "radius": made["radius"], "parent": up,
                             "object": [x.tobytes() for x in made["route"]], "ids": [x.tobytes() for x in made["ids"]],
                             "entries": [x.tobytes() for x in made["entries"]], "away": [x.tobytes() for x in made["away"]]})

    keys = ["route", "part"]
    page = "route long, part long, radius double, parent double, object binary, ids binary, entries binary, away binary"
    index = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda f: each_cell(f, keys, build), page), "pages")

    names = ["route", "part", "above", "query_id", "floor", "v"]

    def asks(home: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            space = sent.value
            for frame in frames:
                points = np.stack(frame["v"])
                away = distances(asked(points), space.routes)
                floor = frame["floor"].to_numpy(float)
                found = []
                for n, (d, query) in enumerate(zip(away, frame["vec_id"])):
                    order = sorted(radius, key=lambda r: (d[r], r))
                    first = order[0], int(query) % radius[order[0]][0]
                    if home:
                        chosen = [first]
                    else:
                        far = points[n] @ points[n] + space.square - 2 * floor[n]
                        reach = np.sqrt(max(0.0, far)) + SLACK if floor[n] > -np.inf else np.inf
                        chosen = [(r, p) for r in order if d[r] - radius[r][1] <= reach for p in range(radius[r][0]) if (r, p) != first]
                    found += [(r, p, d[r], query, floor[n], points[n]) for r, p in chosen]
                    if len(found) > 5000:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names)
        return run

    def answer(cell: pd.DataFrame) -> pd.DataFrame | None:
        nodes, queries = cell[cell["query_id"].isna()], cell[cell["query_id"].notna()]
        if not len(nodes) or not len(queries):
            return None
        tree, found = tree_of(nodes, len(queries["v"].iloc[0]) + 1), []
        for query, floor, above, v in zip(queries["query_id"], queries["floor"], queries["above"], queries["v"]):
            best = search(np.append(v, 0.0), int(query), float(floor), k, sent.value.square, tree, float(above), [0])
            found.append((np.full(len(best.ids), int(query)), best.ids, best.scores.astype(np.int64)))
        query, vec, score = map(np.concatenate, zip(*found))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    queries = rows.where(F.col("vec_id") % every == 0)
    schema = "route long, part long, above double, query_id long, floor double, v array<double>"

    def searched(frame: DataFrame, home: bool) -> DataFrame:
        """Queries with their parts, in blocks, each block next to the part's pages."""
        wanted = frame.repartition(frame.sparkSession.sparkContext.defaultParallelism * 2, "vec_id").mapInPandas(asks(home), schema)
        wanted = written(wanted, "wanted")
        blocks = written(wanted.groupBy("route", "part").agg(F.ceil(F.count("*") / ASKING).alias("blocks")), "blocks")
        nodes = index.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        asking = wanted.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
        cells = nodes.unionByName(asking, allowMissingColumns=True).repartition(*keys, "block").sortWithinPartitions(*keys, "block")
        return cells.mapInPandas(lambda f: each_cell(f, [*keys, "block"], answer), "query_id long, vec_id long, score long")

    first = written(searched(queries.withColumn("floor", F.lit(float("-inf"))), True), "home")
    best = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = queries.join(best.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn(
        "floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
    both = first.unionByName(searched(again, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
