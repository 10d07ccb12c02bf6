"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into slots; a table's
bucket is the tuple of its slots.  A query visits buckets in the order of the
chance that they hold a near neighbour, until that chance reaches a target, in
each of a few tables; what it meets is ranked by the exact cosine.  A query that meets
too few vectors, or only such as are farther than a neighbour was taken to be,
visits further buckets for the distance it has found, in the end all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch

_HELD = 1 << 20  # probes that a task gives out at once


@dataclass(frozen=True)
class Settings:
    """``tables`` and ``success`` (chance per table that the probed buckets hold a neighbour) set the recall; ``further`` is that chance for queries that search on.

    ``width`` and ``slots`` cut each projection (outer slots are open);
    ``bucket`` is the mean size of a bucket the number of hashes aims at;
    ``sample`` bounds the vectors from which the likely cosine of a neighbour
    is taken; ``most_probes`` is how many buckets are ranked at first, four
    times as many each time that they do not hold the target; ``unit`` bounds
    the vectors and the queries that one step compares at once.
    """

    tables: int = 2
    success: float = 0.72
    further: float = 0.85
    width: float = 1.1
    slots: int = 4
    bucket: int = 512
    sample: int = 2048
    most_probes: int = 1 << 14
    unit: int = 4096
    seed: int = 17


@dataclass(frozen=True)
class Index:
    """Directions, offsets and the likely cosine of a near neighbour."""

    directions: np.ndarray  # table, hash, component
    offsets: np.ndarray  # table, hash
    likely: float
    settings: Settings

    def slots(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Slot numbers from 0, one row per vector."""
        s = self.settings
        raw = np.floor((unit @ self.directions[table].T + self.offsets[table]) / s.width)
        return (np.clip(raw, -(s.slots // 2), s.slots - s.slots // 2 - 1) + s.slots // 2).astype(np.int64)

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), dtype=np.int64)
        for column in self.slots(unit, table).T:
            code = code * self.settings.slots + column
        return code

    def probes(self, unit: np.ndarray, table: int, near: float | None = None, success: float | None = None) -> np.ndarray:
        """Buckets to visit for one vector, likeliest first.

        A neighbour's projection is normal around ``near`` (``likely`` if not given) times the
        query's, so each hash gives its slots' chances, and the best products
        are built hash by hash (the best ``n`` tuples extend the best ``n``
        shorter ones).
        """
        s = self.settings
        near = self.likely if near is None else near
        success = s.success if success is None else success
        at = self.directions[table] @ unit
        inner = (np.arange(1, s.slots) - s.slots // 2) * s.width - self.offsets[table][:, None]
        spread = math.sqrt(max(1.0 - near**2, 1e-4)) * np.linalg.norm(self.directions[table], axis=1)[:, None] / math.sqrt(len(unit))
        z = (inner - near * at[:, None]) / (spread * math.sqrt(2))
        below = np.array([[0.0, *(0.5 + 0.5 * math.erf(x) for x in row), 1.0] for row in z])
        most = s.most_probes
        while True:
            chance, code = np.ones(1), np.zeros(1, dtype=np.int64)
            for p in np.maximum(np.diff(below, axis=1), 1e-300):
                chance = (chance[:, None] * p).ravel()
                code = (code[:, None] * s.slots + np.arange(s.slots)).ravel()
                if len(chance) > most:
                    best = np.argpartition(-chance, most)[:most]
                    chance, code = chance[best], code[best]
            if chance.sum() >= success or most >= s.slots ** len(below):
                break
            most *= 4
        order = np.lexsort((code, -chance))
        return code[order[: int(np.searchsorted(np.cumsum(chance[order]), success)) + 1]]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by a power of two, so that its largest component is about 1: cosines stay as they are, and no square leaves the range of a double."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def build_index(sample: np.ndarray, rows: int, settings: Settings, near: int = 5) -> Index:
    """``sample``: at most ``settings.sample`` vectors; ``rows``: how many the index will hold."""
    rng = np.random.default_rng(settings.seed)
    dim = sample.shape[1]
    hashes = max(1, math.ceil(math.log(max(rows / settings.bucket, 1.0)) / math.log(settings.slots)))
    directions = rng.standard_normal((settings.tables, hashes, dim))
    offsets = rng.uniform(0, settings.width, (settings.tables, hashes))
    u = _unit(sample)
    cosines = u @ u.T
    np.fill_diagonal(cosines, -1.0)
    k = min(near, len(u) - 1)
    likely = float(np.quantile(np.sort(cosines, axis=1)[:, -k], 0.25)) if k > 0 else 0.5
    return Index(directions, offsets, min(max(likely, 0.0), 0.999), settings)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, vec)`` with double components: rows with an id and a finite vector that is not zero, each once."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest other vectors of every row for which ``is_query`` (a condition on ``vec_id``) holds.

    ``query_id, rank, vec_id, score``: largest cosine first, in double
    precision on the original vectors, ties to the smaller vec_id; all
    candidates if there are fewer.  Null ids, null, empty or zero vectors and
    vectors with a null or non-finite component take no part, nor do vectors of
    another length than the most common one; a row repeated with the same id
    and vector counts once; an empty table gives no row; other columns are not
    read.  A query that at first finds fewer than ``k``, or a ``k``-th one
    farther than the likely cosine, searches on for its own distance; with
    fewer than ``k`` it sees all vectors.  Equal vectors are one entry with its ``k + 1`` smallest ids, so
    copies cost nothing and lose nothing.  Buckets with more vectors or
    queries than ``settings.unit`` are compared in blocks.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    names = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], names)
    dim = sizes["dim"]
    rows = rows.where(F.size("vec") == dim)
    at = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.groupBy("vec", "vec_id").agg(F.lit(1)).select("vec", "vec_id").withColumn("nth", F.row_number().over(at)).where(F.col("nth") <= k + 1)
    ids = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("vec").agg(F.max(is_query).alias("asked"))
    classes = scratch.put(ids.join(asked, "vec").select(F.col("ids")[0].alias("cid"), "ids", "vec", "asked"))
    some = classes.orderBy(F.xxhash64("cid"), "cid").limit(settings.sample).select("vec").collect()
    index = build_index(np.array([r["vec"] for r in some]), sizes["n"], settings, k)
    keys = _keys(classes, index, dim, scratch)
    best = scratch.put(_best(_meet(keys, classes, index, dim, k, scratch), k))
    far = scratch.put(_far(best, classes, index, k))
    if not far.isEmpty():
        best = _best(best.union(_meet(_further(far, keys, index, dim, scratch), classes, index, dim, k, scratch)), k)
    found = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    queries = queries.join(classes.where("asked").select("vec", F.col("cid").alias("qid")), "vec").select("query_id", "qid")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(found, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _best(met: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` nearest of what every query met, itself included."""
    best = met.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")


def _far(best: DataFrame, classes: DataFrame, index: Index, k: int) -> DataFrame:
    """``cid, vec, near``: queries whose ``k``-th neighbour so far has a cosine ``near`` below the likely one; null if they have met fewer."""
    upto = Window.partitionBy("qid").orderBy(F.desc("score"), "cid").rowsBetween(Window.unboundedPreceding, 0)
    sized = best.join(classes.select("cid", F.size("ids").alias("n")), "cid").withColumn("upto", F.sum("n").over(upto))
    kth = sized.where(F.col("upto") > k).groupBy(F.col("qid").alias("cid")).agg(F.max("score").alias("near"))
    asked = classes.where("asked").select("cid", "vec").join(kth, "cid", "left")
    return asked.where(F.col("near").isNull() | (F.col("near") < index.likely))


def _further(far: DataFrame, keys: DataFrame, index: Index, dim: int, scratch: Scratch) -> DataFrame:
    """``_keys`` of a second visit: buckets for each query's own ``near``, all of one table where that is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = index.settings.slots ** index.directions.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            cids, nears = b.column(0).to_numpy(), b.column(2).to_pylist()
            for cid, u, near in zip(cids, _unit(_matrix(b.column(1), dim)), nears):
                for t in range(1 if near is None else len(index.directions)):
                    visit = np.arange(width) if near is None else index.probes(u, t, near, max(index.settings.further, index.settings.success)) + t * width
                    for at in range(0, len(visit), _HELD):
                        some = visit[at : at + _HELD]
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.ones(len(some), dtype=bool)), pa.array(np.full(len(some), cid))], ["bucket", "probe", "cid"])

    held = keys.where("not probe")
    visits = far.mapInArrow(run, "bucket long, probe boolean, cid long").join(held.select("bucket").distinct(), "bucket", "left_semi")
    visits = scratch.put(visits)
    return scratch.put(visits.union(held.join(visits.select("bucket").distinct(), "bucket", "left_semi")))


def _keys(classes: DataFrame, index: Index, dim: int, scratch: Scratch) -> DataFrame:
    """``bucket, probe, cid``: every vector under its bucket of each table, every query under each bucket it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = index.settings.slots ** index.directions.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            cids, asked = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            unit = _unit(_matrix(b.column(1), dim))
            bucket, probe, row, held = [], [], [], 0

            def part() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), pa.array(np.concatenate(probe)), pa.array(cids[np.concatenate(row)])], ["bucket", "probe", "cid"])

            for t in range(len(index.directions)):
                bucket.append(index.buckets(unit, t) + t * width)
                row.append(np.arange(len(unit)))
                probe.append(np.zeros(len(unit), dtype=bool))
                for i in np.flatnonzero(asked):
                    visit = index.probes(unit[i], t) + t * width
                    bucket.append(visit)
                    row.append(np.full(len(visit), i))
                    probe.append(np.ones(len(visit), dtype=bool))
                    held += len(visit)
                    if held > _HELD:
                        yield part()
                        bucket, probe, row, held = [], [], [], 0
            if row:
                yield part()

    return scratch.put(classes.select("cid", "vec", "asked").mapInArrow(run, "bucket long, probe boolean, cid long"))


def _meet(keys: DataFrame, classes: DataFrame, index: Index, dim: int, k: int, scratch: Scratch) -> DataFrame:
    """``qid, cid, score``: per bucket and query the best ``k + 1`` vectors, itself included."""
    unit = index.settings.unit
    sizes = keys.groupBy("bucket").agg(F.count_if("probe").alias("p"), F.count_if(~F.col("probe")).alias("n"))
    large = sizes.where((F.col("p") > unit) | (F.col("n") > unit)).select("bucket", F.ceil(F.col("p") / unit).cast("int").alias("ps"), F.ceil(F.col("n") / unit).cast("int").alias("ns"))
    # Written first, so that its size is known and the many rows of a large bucket need not meet in one task.
    dealt = keys.join(scratch.put(large), "bucket", "left").withColumns({"ps": F.coalesce("ps", F.lit(1)), "ns": F.coalesce("ns", F.lit(1))})
    # A large bucket is a grid of blocks of queries and blocks of vectors; a row goes to all blocks of its line.
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("probe"), F.col("ps")).otherwise(F.col("ns"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.col("probe"), F.col("ns")).otherwise(F.col("ps")), F.lit(1)) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("bucket", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("j"), "probe", "cid")
    dealt = dealt.join(classes.select("cid", "vec"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            probe = t.column("probe").to_numpy().astype(bool)
            if probe.all() or not probe.any():
                return
            cid = t.column("cid").to_numpy()
            vec = _matrix(t.column("vec").combine_chunks() if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec"), dim)
            vec = _scaled(vec)
            norm = np.sqrt((vec * vec).sum(axis=1))
            q, c = np.flatnonzero(probe), np.flatnonzero(~probe)
            for part in np.array_split(q, -(-len(q) // 512)):
                near = (vec[part] / norm[part, None]) @ (vec[c] / norm[c, None]).T
                n = min(k + 1, len(c))
                edge = np.partition(near, len(c) - n, axis=1)[:, len(c) - n] - 1e-9
                x, y = np.nonzero(near >= edge[:, None])
                a, b = part[x], c[y]
                score = (vec[a] * vec[b]).sum(axis=1) / (norm[a] * norm[b])
                yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b]), pa.array(score)], ["qid", "cid", "score"])

        for b in batches:
            key = np.stack([b.column(n).to_numpy() for n in ("bucket", "i", "j")], axis=1)
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            begin = 0
            for end in ends:
                if end == begin:
                    continue
                mark = tuple(key[begin])
                if held and mark != now:
                    yield from flush()
                    held = []
                now = mark
                held.append(b.slice(begin, end - begin))
                begin = end
        if held:
            yield from flush()

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "qid long, cid long, score double")
