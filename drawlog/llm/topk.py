"""Exact top-k by inner product as a Voronoi kNN join.

The largest inner products of a query are its nearest neighbours once every
vector is lifted onto the unit sphere: ``x`` becomes ``(x / m, sqrt(1 - |x/m|^2))``
with ``m`` the largest norm, a query ``q`` becomes ``(q / |q|, 0)``, and the
squared distance is ``2 - 2 q.x / (m |q|)``.  Pivots cut the sphere into cells.
Per cell only a summary reaches the driver: how many vectors it holds, how far
they are from the pivot, and its few smallest distances.  From these follow, by
the triangle inequality, a distance within which every query of a cell finds
enough neighbours, and which vectors of which other cell can lie within it:
only those are sent to the query's cell, where the scores are worked out in
whole numbers.  Pivots change how much is sent, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch

_EXACT = float(1 << 53)  # whole numbers up to here are exact in a double
_SLACK = 1e-6  # far above what rounding can add to a distance on the unit sphere
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """``pivots`` bounds the cells (and so the summaries), ``sample`` the vectors from which pivots are taken.

    ``queries`` and ``vectors`` bound what one task compares at once: a query
    cell, and what is sent to it, are a grid of blocks of these sizes, scored
    ``strip`` queries at a time.
    ``tasks`` is how many blocks of vectors a small table is cut into at least.
    """

    pivots: int = 256
    sample: int = 4096
    queries: int = 4096
    vectors: int = 8192
    strip: int = 512
    tasks: int = 48
    scale: int = 256
    seed: int = 5


def whole(vectors: DataFrame, is_query, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``vec_id, vec, asked``: vectors of whole numbers, each row once; those that hold a null or non-finite component are left out."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("raw"))
    # Scaled as doubles: a whole number in a double, exact at any size that a double holds.
    scaled = F.transform("raw", lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = rows.select("vec_id", scaled.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite)
    return rows.groupBy("vec_id", "vec").agg(F.lit(1)).select("vec_id", "vec", is_query.alias("asked"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    size = np.diff(ends)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


@dataclass(frozen=True)
class Plan:
    """The lifted space: ``dim`` components, largest norm ``top`` (as a multiple of ``unit``, the largest component), pivots."""

    dim: int
    unit: float
    top: float
    pivots: np.ndarray

    def data(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit / self.top
        return np.concatenate((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]), axis=1)

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit
        large = np.abs(x).max(axis=1, initial=0.0)
        x = x / np.where(large > 0, large, 1.0)[:, None]
        norm = np.sqrt((x * x).sum(axis=1))
        return np.concatenate((x / np.where(norm > 0, norm, 1.0)[:, None], np.zeros((len(x), 1))), axis=1)

    def cells(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it."""
        squared = (lifted * lifted).sum(axis=1)[:, None] - 2 * lifted @ self.pivots.T + (self.pivots * self.pivots).sum(axis=1)
        cell = squared.argmin(axis=1)
        return cell, np.sqrt(((lifted - self.pivots[cell]) ** 2).sum(axis=1))


def _pivots(lifted: np.ndarray, many: int, seed: int) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    centres = np.unique(lifted[rng.permutation(len(lifted))[:many]], axis=0)
    for _ in range(5):
        near = (-2 * lifted @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, lifted)
        n = np.bincount(near, minlength=len(centres))
        centres = total[n > 0] / n[n > 0, None]
    return centres


def _reach(pivots: np.ndarray, radius: np.ndarray, nearest: list[list[float]], need: int) -> np.ndarray:
    """Per query cell a distance within which each of its queries has ``need`` vectors, by the triangle inequality over all summaries."""
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)))
    cell = np.array([j for j, some in enumerate(nearest) for _ in some], dtype=np.int64)
    own = np.array([d for some in nearest for d in some])
    if len(own) < need:
        return np.full(len(pivots), np.inf)
    return radius + np.partition(apart[:, cell] + own[None], need - 1, axis=1)[:, need - 1] + _SLACK


def top_inner(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` highest scores of every row for which ``is_query`` (a condition on ``vec_id``) holds.

    ``query_id, rank, vec_id, score``: components are turned into
    ``floor(scale * x)``, the score is the inner product in whole numbers,
    highest first, ties to the smaller vec_id; all candidates if there are
    fewer.  Null ids, null vectors and vectors with a null or non-finite
    component (also after scaling) take no part.  Of vectors of different
    length the shorter one counts as filled up with zeros, an empty one as
    zero; a score beyond 64 bits counts as the largest or smallest ``long``.  A row repeated with the same id and vector
    counts once; no row with the query's id is its candidate; rows that share
    an id but not a vector are one query or candidate with their highest
    score.  An empty table gives no row; further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = scratch.put(whole(vectors, is_query, id_column, vector_column, settings.scale))
    size = F.coalesce(F.array_max(F.transform("vec", F.abs)), F.lit(0.0))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(size).alias("unit")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not about["n"]:
        return spark.createDataFrame([], schema)
    dim, unit = max(1, about["dim"]), about["unit"] or 1.0
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit)))
    top = rows.agg(F.max(norm)).first()[0] or 1.0
    some = [r["vec"] for r in rows.orderBy(F.xxhash64("vec_id", "vec")).limit(settings.sample).select("vec").collect()]
    sample = np.array([v + [0.0] * (dim - len(v)) for v in some])
    plan = Plan(dim, unit, top * (1 + 1e-12), np.zeros((0, dim + 1)))
    many = int(min(settings.pivots, max(1, about["n"] ** 0.5)))
    plan = Plan(dim, unit, plan.top, _pivots(plan.data(sample), many, settings.seed))

    placed = scratch.put(_place(rows, plan))
    data, asked = placed.where("not asked"), placed.where("asked")
    need = k + 1  # the query's own row may be among them
    # One row per id for the summaries: rows that share an id are one candidate.
    nth = Window.partitionBy("cell").orderBy("far")
    few = data.groupBy("cell", "vec_id").agg(F.min("far").alias("far")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= need)
    near = {r["cell"]: sorted(r["d"]) for r in few.groupBy("cell").agg(F.collect_list("far").alias("d")).collect()}
    held = {r["cell"]: (r["n"], r["least"], r["most"]) for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()}
    wanted = {r["cell"]: (r["n"], r["most"]) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("most")).collect()}
    if not wanted:
        return spark.createDataFrame([], schema)
    sent, blocks = _send(plan.pivots, near, held, wanted, need, about["n"], settings)
    sent = spark.createDataFrame(sent, "cell int, place int, least double, most double")
    blocks = spark.createDataFrame(blocks, "place int, cells array<int>, ps int, ns int")

    # At most pivots^2 rows and pivots rows: bounded by the settings, whatever the tables hold.
    grid = blocks.select("place", "ps", "ns")
    ask = asked.join(F.broadcast(blocks.select("place", F.explode("cells").alias("cell"), "ps", "ns")), "cell")
    ask = ask.select("place", F.pmod(F.xxhash64("vec_id"), "ps").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j"), F.lit(True).alias("asked"), "vec_id", "vec")
    give = data.join(F.broadcast(sent.join(grid, "place")), "cell").where("far >= least and far <= most")
    give = give.select("place", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("i"), F.pmod(F.xxhash64("vec_id"), "ns").cast("int").alias("j"), F.lit(False).alias("asked"), "vec_id", "vec")
    tasks = int(min(1 << 15, max(1, blocks.agg(F.sum(F.col("ps") * F.col("ns"))).first()[0])))
    met = ask.unionByName(give).repartition(tasks, "place", "i", "j").sortWithinPartitions("place", "i", "j", F.desc("asked"))
    best = met.mapInArrow(_solver(dim, k, settings), "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _place(rows: DataFrame, plan: Plan) -> DataFrame:
    """``cell, far, vec_id, vec, asked``: every vector in the cell of its lifted form and, if asked, once more in that of its query form."""
    names = ["cell", "far", "vec_id", "vec", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("asked").to_numpy(zero_copy_only=False).astype(bool)
            for mark, part, lift in ((False, b, plan.data), (True, b.filter(pa.array(asked)), plan.query)):
                if part.num_rows:
                    cell, far = plan.cells(lift(_matrix(part.column("vec"), plan.dim)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), part.column("vec_id"), part.column("vec"), pa.array(np.full(part.num_rows, mark))], names)

    return rows.select("vec_id", "vec", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(run, "cell int, far double, vec_id long, vec array<double>, asked boolean")


def _send(pivots: np.ndarray, near: dict, held: dict, wanted: dict, need: int, rows: int, settings: Settings) -> tuple[list, list]:
    """Which vectors go where: ``(cell, place, least, most)`` by distance from the cell's pivot, and ``(place, query cells, blocks of queries, blocks of vectors)``.

    Neighbouring query cells share a place as long as their queries fit one block, so that what they both need is sent once.
    """
    cells = len(pivots)
    radius = np.zeros(cells)
    for c, (_, most) in wanted.items():
        radius[c] = most
    reach = _reach(pivots, radius, [near.get(c, []) for c in range(cells)], need)
    apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
    places: list[list[int]] = []
    left = sorted(wanted, key=lambda c: (-wanted[c][0], c))
    while left:
        place, n = [left[0]], wanted[left[0]][0]
        for c in sorted(left[1:], key=lambda c: (apart[place[0], c], c)):
            if n + wanted[c][0] <= settings.queries:
                place.append(c)
                n += wanted[c][0]
        places.append(place)
        left = [c for c in left if c not in set(place)]
    sent, blocks = [], []
    for p, place in enumerate(places):
        goes = 0
        for j, (n, least, most) in held.items():
            # A vector within ``reach`` of a query that is within ``radius`` of its pivot i is within both of i;
            # its own pivot j is then at least ``apart - radius - reach`` away from it and at most the sum.
            low = min(apart[i, j] - radius[i] - reach[i] for i in place) - _SLACK
            high = max(apart[i, j] + radius[i] + reach[i] for i in place) + _SLACK
            if low <= most and high >= least:
                sent.append((int(j), p, float(max(low, -1.0)), float(min(high, 1e9))))
                goes += n
        unit = max(1, min(settings.vectors, -(-rows // settings.tasks)))
        blocks.append((p, [int(c) for c in place], max(1, -(-sum(wanted[c][0] for c in place) // settings.queries)), max(1, -(-goes // unit))))
    return sent, blocks


def _solver(dim: int, k: int, settings: Settings):
    """Per block the ``k`` best of its vectors for each of its queries, in whole numbers."""

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        most = np.sqrt((q * q).sum(axis=1).max()) * np.sqrt((x * x).sum(axis=1).max())
        if most < _EXACT:  # no partial sum can be larger, so that doubles are exact
            return (q @ x.T).astype(np.int64)
        exact = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in x], dtype=object).T
        return np.array([[max(_LEAST, min(_MOST, v)) for v in r] for r in exact], dtype=np.int64)

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asked = t.column("asked").to_numpy().astype(bool)
        if asked.all() or not asked.any():
            return
        ids, vec = t.column("vec_id").to_numpy(), _matrix(t.column("vec"), dim)
        q_id, q = ids[asked], vec[asked]
        order = np.argsort(ids[~asked], kind="stable")
        x_id, first = np.unique(ids[~asked][order], return_index=True)
        x = vec[~asked][order]
        n = min(k + 1, len(x_id))  # the query's own id may be among them
        for begin in range(0, len(q), settings.strip):
            strip = slice(begin, begin + settings.strip)
            score = scores(q[strip], x)
            if len(x_id) < len(x):
                score = np.maximum.reduceat(score, first, axis=1)
            own = q_id[strip][:, None] == x_id[None]
            score[own] = _LEAST
            edge = np.partition(score, len(x_id) - n, axis=1)[:, len(x_id) - n]
            row, col = np.nonzero((score >= edge[:, None]) & ~own)
            value = score[row, col]
            order = np.lexsort((x_id[col], ~value, row))
            row, col, value = row[order], col[order], value[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([pa.array(q_id[strip][row[best]]), pa.array(x_id[col[best]]), pa.array(value[best])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            key = np.stack([b.column(n).to_numpy() for n in ("place", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and tuple(key[begin]) != now:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                now = tuple(key[begin])
                held.append(b.slice(begin, end - begin))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run
