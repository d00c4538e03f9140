"""An updatable nearest-neighbour index kept as Parquet folders of records (level, bucket, vec_id, embedding).

Levels grow by ``arity``; each has a router that names likely buckets. The buffer is level -1. A level is a list of parts, folders that
are written once: a verb writes parts for the rows it moves, and the levels it doesn't touch keep theirs. How many rows a bucket holds
is known without a scan. Levels from ``cold_threshold_level`` on lie in ``cold_storage_dir``, a folder a bucket, from the start.

Parts that a verb replaces are removed when the next one has been done, so what was asked of the index before can still be read then.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .config import IndexConfig, TrainParams
from .functions import distance
from .operators import exact, leveling
from .operators.exact import matrix
from .operators.router import CELLS, Router, packed, train_mlp, unpacked
from .sources.storage import numbered, read_text, removed, shared_folder, write_text

BUFFER = -1
RECORDS = "level int, bucket int, vec_id long, embedding array<float>"
DEFAULT_K, DEFAULT_CANDIDATES = 10, 30_000
#: Ways to choose the buckets of a search: by the routers' predictions.
STRATEGIES = ("model",)
#: Buckets of a level listed as a filter of its scan; beyond that the level is read.
MOST_LISTED = 200
#: Rows that a search compares in one task, at most (buckets share a task, larger ones are split), and at least if there are so many.
PIECE, FEW = 1 << 17, 1 << 13

Factory = Callable[[DataFrame, int, int, IndexConfig], Router]


def prepared(vectors: DataFrame, config: IndexConfig) -> DataFrame:
    """vec_id and embedding; rows that lack either are left out, another number of elements raises when rows are read."""
    wrong = F.raise_error(F.lit(f"vectors must have {config.input_shape} elements"))
    checked = F.when(F.size("embedding") == config.input_shape, F.col("embedding").cast("array<float>")).otherwise(wrong)
    out = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("embedding"))
    return out.withColumn("embedding", half_column(F.col("embedding"))) if config.half else out


def half_column(a):
    @F.pandas_udf("array<float>")
    def rounded(s):
        return s.map(lambda x: None if x is None else distance.half(np.asarray(x, np.float32)))

    return rounded(a)


@dataclass(frozen=True)
class Part:
    """A folder of records of one level; cold ones have a folder a bucket."""

    path: str
    cold: bool = False


@dataclass(frozen=True)
class Parts:
    """Which part of a search has the rows of a place (a bucket): first[place], or pieces[place] from there on. In it places have numbers of their own."""

    first: np.ndarray
    pieces: np.ndarray
    local: np.ndarray
    #: Places of each part.
    sizes: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, partitions: int) -> Parts:
        size = max(1, min(PIECE, max(FEW, -(-int(counts.sum()) // partitions))))
        pieces = np.maximum(1, -(-counts // PIECE))
        small = np.where(pieces == 1, counts, 0)
        first = (np.cumsum(small) - small) // size
        n = int(first[-1]) + 1
        large = np.flatnonzero(pieces > 1)
        first[large] = n + np.cumsum(pieces[large]) - pieces[large]
        total = n + int(pieces[large].sum())
        local = np.zeros(len(counts), np.int64)
        few = np.flatnonzero(pieces == 1)
        local[few] = np.arange(len(few)) - np.searchsorted(first[few], first[few])
        return cls(first, pieces, local, np.maximum(1, np.bincount(first[few], minlength=total)))

    def find(self, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows with these places and ids their parts, and the places' numbers there."""
        return self.first[place] + exact.dealt(ids, self.pieces[place].astype(np.uint64)), self.local[place].astype(np.int32)

    def questions(self, batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, groups: int) -> pa.RecordBatch:
        """A row for each part and group of queries that chose places of it: ids, vectors, and for each query a bit for each place."""
        n = self.pieces[place]
        part = np.repeat(self.first[place] + n - np.cumsum(n), n) + np.arange(int(n.sum()))
        row, local = np.repeat(row, n), np.repeat(self.local[place], n)
        qid, vectors = batch.column("qid").to_numpy(), matrix(batch.column("qv"))
        cell = part * groups + exact.dealt(qid, groups)[row]
        order = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
        out = []
        for own in np.split(order, begin[1:]):
            asking, which = np.unique(row[own], return_inverse=True)
            bits = np.zeros((len(asking), int(self.sizes[part[own[0]]])), bool)
            bits[which, local[own]] = True
            out.append((int(part[own[0]]), qid[asking].tobytes(), vectors[asking].tobytes(), np.packbits(bits, axis=1).tobytes(), False, int(cell[own[0]])))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["part", "ids", "vectors", "bits", "single", "cell"])

    def nearest(self, metric: str, left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(qid, id, nearness) of the k nearest rows of each query among the places that it chose."""
        (qids, queries), (ids, rows) = exact.unpacked(left), exact.unpacked(right)
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(qids) and len(ids):
            width = int(self.sizes[left.column("part")[0].as_py()])
            bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(qids), -1)
            place = np.frombuffer(b"".join(right.column("places").to_pylist()), np.int32)
            order = np.argsort(place, kind="stable")
            ids, rows, place = ids[order], rows[order], place[order]
            held = np.bincount(place, minlength=width)
            for a in range(0, len(qids), exact.QUERIES):
                some = slice(a, a + exact.QUERIES)
                chosen = np.unpackbits(bits[some], axis=1, count=width).astype(bool)
                found = []
                if 8 * int((chosen * held).sum()) > len(chosen) * len(ids):  # one product of matrices, whose other cells don't count
                    for b in range(0, len(ids), exact.ROWS):
                        own = slice(b, b + exact.ROWS)
                        found.append(exact.nearest(metric, ids[own], rows[own], qids[some], queries[some], k, allowed=None if chosen[:, place[own]].all() else chosen[:, place[own]].T))
                else:
                    ends = np.cumsum(held)
                    for p in np.flatnonzero((held > 0) & chosen.any(0)).tolist():
                        own, asking = slice(int(ends[p] - held[p]), int(ends[p])), np.flatnonzero(chosen[:, p])
                        column, *other = exact.nearest(metric, ids[own], rows[own], qids[some][asking], queries[some][asking], k)
                        found.append((asking[column], *other))
                column, *other = exact.best(found, k)
                for x, y in zip(out, (qids[some][column], *other)):
                    x.append(y)
        return tuple(np.concatenate(x) for x in out)


class VectorIndex:
    def __init__(self, spark: SparkSession, config: IndexConfig, factory: Factory = train_mlp):
        self.spark, self.config, self.factory = spark, config, factory
        self.routers: list[Router] = []
        self.parts: dict[int, list[Part]] = {}
        #: Rows of each bucket of each level; the buffer has one bucket.
        self.counts: dict[int, np.ndarray] = {BUFFER: np.zeros(1, np.int64)}
        self._own: set[Part] = set()
        self._replaced: list[Part] = []
        self._cold_cache: OrderedDict[tuple[int, int], None] = OrderedDict()
        self._cached: DataFrame | None = None

    def copy(self, **changes) -> VectorIndex:
        """An index of the same rows, with changes of the configuration, that leaves this one's folders alone."""
        out = VectorIndex(self.spark, self.config.with_(**changes), self.factory)
        out.routers, out.parts = list(self.routers), {k: list(v) for k, v in self.parts.items()}
        out.counts = {k: v.copy() for k, v in self.counts.items()}
        return out

    @property
    def levels(self) -> list[int]:
        """Rows of each level."""
        return [int(self.counts[i].sum()) for i in range(len(self.routers))]

    @property
    def buffered(self) -> int:
        return int(self.counts[BUFFER].sum())

    # -- parts

    def is_cold(self, level: int) -> bool:
        c = self.config
        return c.cold_storage_dir is not None and c.cold_threshold_level is not None and level >= c.cold_threshold_level

    def level_rows(self, level: int, buckets: list[int] | None = None) -> DataFrame:
        """The level's records, of the named buckets alone if there are few."""
        rows = [self.spark.read.schema("bucket int, vec_id long, embedding array<float>").option("basePath", p.path).parquet(p.path) for p in self.parts.get(level, [])]
        out = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "bucket int, vec_id long, embedding array<float>")
        if buckets is not None and len(buckets) <= MOST_LISTED:
            out = out.where(F.col("bucket").isin([int(b) for b in buckets]))
        return out.select(F.lit(level).alias("level"), "bucket", "vec_id", "embedding")

    @property
    def records(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.level_rows(i) for i in (*range(len(self.routers)), BUFFER)])

    def _write(self, rows: DataFrame, levels: list[int]) -> None:
        """Adds rows (level, bucket, vec_id, embedding) to their levels, which are among levels: hot ones in one job, cold ones in another."""
        for cold in (False, True):
            own = [i for i in levels if self.is_cold(i) == cold]
            if not own:
                continue
            path = f"{(self.config.cold_storage_dir if cold else shared_folder(self.spark)).rstrip('/')}/index-{uuid.uuid4().hex}"
            some = rows.where(F.col("level").isin(own))
            # a rebalance, not a repartition: a bucket of many rows is split over several tasks and files
            (some.hint("rebalance", "level", "bucket") if cold else some).write.partitionBy("level", *["bucket"] * cold).parquet(path)
            held = self.spark.read.schema("vec_id long, bucket int, level int").parquet(path).groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"))
            for r in held.collect():
                self.counts[r["level"]][r["bucket"]] += r["n"]
                part = Part(f"{path}/level={r['level']}", cold)
                if part not in self.parts.setdefault(r["level"], []):
                    self.parts[r["level"]].append(part)
                    self._own.add(part)

    def _emptied(self, levels) -> list[Part]:
        """Forgets the rows of levels, whose parts it returns."""
        gone = [p for i in levels for p in self.parts.pop(i, [])]
        for i in levels:
            self.counts[i] = np.zeros_like(self.counts[i])
        return gone

    def _done(self, gone: list[Part]) -> VectorIndex:
        """Ends a verb that replaced parts."""
        for p in self._replaced:
            removed(self.spark, p.path)
        self._replaced = [p for p in gone if p in self._own]
        self._own -= set(gone)
        self.invalidate_cold_cache()
        return self

    # -- inserting

    def _routed(self, rows: DataFrame) -> DataFrame:
        """rows (level, vec_id, embedding) with the likeliest bucket of their level, the lower of equals."""
        shipped = self.spark.sparkContext.broadcast(self.routers)

        def route(batches):
            for batch in batches:
                level = batch.column("level").to_numpy()
                bucket = np.zeros(len(level), np.int32)
                vectors = matrix(batch.column("embedding"))
                for i in np.unique(level[level >= 0]).tolist():
                    router, whole = shipped.value[i], np.flatnonzero(level == i)
                    n = max(1, CELLS // router.n_buckets)
                    for of in (whole[a : a + n] for a in range(0, len(whole), n)):
                        bucket[of] = np.argmax(np.round(router.probabilities(vectors[of]), 15), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array(bucket), batch.column("vec_id"), batch.column("embedding")], ["level", "bucket", "vec_id", "embedding"])

        return rows.select("level", "vec_id", "embedding").mapInArrow(route, RECORDS)

    def insert(self, vectors: DataFrame, order: list[str] | None = None) -> VectorIndex:
        """Appends rows in the given order. Placement depends on counts alone, so every row moves once, straight to its last level.

        Rows that lack an id or a vector are left out. What fits into the buffer is written there, and nothing else is.
        """
        rows, n = numbered(prepared(vectors, self.config), order or ["vec_id"])
        if not n:
            return self
        had = self.levels
        state = leveling.State.of(self.config, had, self.buffered)
        state.insert(n)
        stays: dict[int, int] = {}
        news = []
        for level, segments in [*enumerate(state.levels), (BUFFER, state.buffer)]:
            for o, size in segments:
                if o[0] == "new":
                    news.append((o[1], o[1] + size, level))
                else:
                    stays[o[1] if o[0] == "level" else BUFFER] = level
        of_new = lambda parts: reduce(lambda a, b: a | b, [F.col("seq").between(o[1], o[1] + size - 1) for o, size in parts if o[0] == "new"], F.lit(False))
        for level in sorted(state.trained_on):
            parts = state.trained_on[level]
            founding = self._founding([o[1] if o[0] == "level" else BUFFER for o, _ in parts if o[0] != "new"], rows.where(of_new(parts)))
            self.routers.append(self.factory(founding, sum(s for _, s in parts), level, self.config))
            self.counts[level] = np.zeros(self.config.n_buckets(level), np.int64)
        moved = [k for k, v in stays.items() if k != v]
        if self.config.train.retrain_strategy == "from_scratch":  # a level that was empty is trained on what it gets
            for level in range(len(had)):
                if not had[level] and (parts := state.levels[level]):
                    founding = self._founding([k for k in moved if stays[k] == level], rows.where(of_new(parts)))
                    self.routers[level] = self.factory(founding, sum(s for _, s in parts), level, self.config)
        target = F.lit(None).cast("int")
        for a, b, level in news:
            target = F.when(F.col("seq").between(a, b - 1), F.lit(level)).otherwise(target)
        coming = [rows.withColumn("level", target).select("level", "vec_id", "embedding")]
        coming += [self.level_rows(k).select(F.lit(stays[k]).alias("level"), "vec_id", "embedding") for k in moved]
        routed = self._routed(reduce(DataFrame.unionByName, coming))
        gone = self._emptied(moved)
        self._write(routed, sorted({level for _, _, level in news} | {stays[k] for k in moved}))
        return self._done(gone)

    insert_bulk = insert

    def _founding(self, levels: list[int], rows: DataFrame) -> DataFrame:
        """vec_id and embedding of the rows and of those in levels."""
        return reduce(DataFrame.unionByName, [self.level_rows(k).select("vec_id", "embedding") for k in levels], rows.select("vec_id", "embedding"))

    def upsert(self, vectors: DataFrame, order: list[str] | None = None) -> VectorIndex:
        """Replaces rows by id. Of rows that name an id twice the last by order counts, of equals the greatest vector."""
        named = vectors.where("vec_id is not null and embedding is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
        others = [c for c in order or [] if c != "vec_id"]
        last = named.agg(F.max(F.struct(*others, F.col("embedding"))).alias("last"))
        self.delete(vectors.select("vec_id"))
        return self.insert(last.select("vec_id", *[F.col("last")[c].alias(c) for c in others], F.col("last.embedding").alias("embedding")), order)

    # -- deleting

    def delete(self, ids: DataFrame) -> int:
        """Removes all rows whose vec_id is among ids, then rebuilds levels that became underutilized. Returns how many went.

        Only levels that hold such rows are written anew.
        """
        ids = ids.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
        there = {r["level"]: r["n"] for r in self.records.select("level", "vec_id").join(ids, "vec_id", "left_semi").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not there:
            return 0
        left = reduce(DataFrame.unionByName, [self.level_rows(i) for i in sorted(there)]).join(ids, "vec_id", "left_anti").select("level", "bucket", "vec_id", "embedding")
        gone = self._emptied(there)
        self._write(left, sorted(there))
        self._done(gone)
        for level in sorted(x for x in there if x != BUFFER):
            if leveling.underutilized(self.config, level, self.levels[level]):
                self.rebuild(level)
        return sum(there.values())

    def rebuild(self, level: int) -> None:
        strategy = self.config.rebuild_strategy
        if strategy == "no_rebuild":
            return
        if strategy == "basic_rebuild":
            move = leveling.basic_move(self.config, self.levels, level)
            moves = [move] if move else []
            if not move and level == 0 and self.buffered and self.config.capacity(0) - self.levels[0] >= self.buffered:
                moves = [(BUFFER, 0)]
        else:
            moves = leveling.greedy_moves(self.config, self.levels, level)
        if moves:
            coming = reduce(DataFrame.unionByName, [self.level_rows(a).withColumn("level", F.lit(b)) for a, b in moves])
            routed = self._routed(coming)
            gone = self._emptied([a for a, _ in moves])
            self._write(routed, sorted({b for _, b in moves}))
            self._done(gone)

    def retrain(self, level: int) -> None:
        """With the strategy from_scratch, trains the level's router anew on its rows and routes them again; else does nothing."""
        if self.config.train.retrain_strategy != "from_scratch" or not self.levels[level]:
            return
        own = self.level_rows(level)
        self.routers[level] = self.factory(own.select("vec_id", "embedding"), self.levels[level], level, self.config)
        routed = self._routed(own)
        gone = self._emptied([level])
        self._write(routed, [level])
        self._done(gone)

    # -- searching

    def predictions(self, queries: DataFrame) -> DataFrame:
        """(qid, level, bucket, prob) of every level that holds rows."""
        used = [i for i, n in enumerate(self.levels) if n]
        shipped = self.spark.sparkContext.broadcast({i: self.routers[i] for i in used})

        def predict(batches):
            for batch in batches:
                whole, vectors = batch.column("qid").to_numpy(), matrix(batch.column("qv"))
                for i, a, n in ((i, a, n) for i in used for n in [max(1, CELLS // shipped.value[i].n_buckets)] for a in range(0, len(whole), n)):
                    qid, p = whole[a : a + n], shipped.value[i].probabilities(vectors[a : a + n])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, p.shape[1])), pa.array(np.full(p.size, i, np.int32)), pa.array(np.tile(np.arange(p.shape[1], dtype=np.int32), len(qid))), pa.array(p.ravel())], ["qid", "level", "bucket", "prob"])

        return _asked(queries).mapInArrow(predict, "qid long, level int, bucket int, prob double")

    def _ranking(self, n_candidates: int | None):
        """A function that gives for a batch of queries, some at a time, (those, row, place, priority, occ, before) of the buckets that the budget reaches, best first.

        rows are places among those queries, places among (levels, buckets).
        """
        used = [i for i, n in enumerate(self.levels) if n]
        shipped = self.spark.sparkContext.broadcast({i: self.routers[i] for i in used})
        occ = np.concatenate([np.zeros(0, np.int64), *(self.counts[i] for i in used), self.counts[BUFFER]])
        scale = np.repeat([float(self.config.arity) ** i for i in used], [len(self.counts[i]) for i in used])
        n = max(1, CELLS // len(occ))

        def rank(whole):
            for batch in (whole.slice(at, n) for at in range(0, whole.num_rows, n)):
                vectors = matrix(batch.column("qv"))
                p = [shipped.value[i].probabilities(vectors) for i in used]
                priority = np.round(np.concatenate([np.zeros((len(vectors), 0)), *p], axis=1).clip(0) * scale, 9)
                priority = np.concatenate([priority, np.ones((len(vectors), 1))], axis=1)
                order = np.argsort(-np.where(occ > 0, priority, -1), axis=1, kind="stable")
                held = occ[order]
                before = np.cumsum(held, axis=1) - held
                row, k = np.nonzero((held > 0) & (before < (np.inf if n_candidates is None else n_candidates)))
                place = order[row, k]
                yield batch, row, place, priority[row, place], held[row, k], before[row, k]

        return rank

    def _places(self, stored: bool) -> tuple[np.ndarray, np.ndarray]:
        """Levels and buckets in the order that ``_ranked`` has them; the buffer as it is stored, or as the level after the last."""
        used = [i for i, n in enumerate(self.levels) if n]
        end = (BUFFER, 0) if stored else (len(self.levels), sum(self.config.n_buckets(i) for i in range(len(self.levels))))
        sizes = [len(self.counts[i]) for i in used]
        return np.append(np.repeat(used, sizes), end[0]).astype(np.int32), np.append(np.concatenate([np.zeros(0), *map(np.arange, sizes)]), end[1]).astype(np.int32)

    def candidates(self, queries: DataFrame, n_candidates: int | None = None) -> DataFrame:
        """(qid, level, bucket, priority, occ, before): non-empty buckets, and the rows that come before each. The buffer stands as the level after the last."""
        level, bucket = self._places(False)
        rank = self._ranking(n_candidates)

        def listed(batches):
            for batch, row, place, *numbers in (x for whole in batches for x in rank(whole)):
                columns = [batch.column("qid").take(pa.array(row)), pa.array(level[place]), pa.array(bucket[place]), *map(pa.array, numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "level", "bucket", "priority", "occ", "before"])

        return _asked(queries).mapInArrow(listed, "qid long, level int, bucket int, priority double, occ long, before long")

    def selected(self, queries: DataFrame, n_candidates: int) -> DataFrame:
        return self.candidates(queries, n_candidates)

    def search(self, queries: DataFrame, k: int = DEFAULT_K, n_candidates: int | None = DEFAULT_CANDIDATES, search_strategy: str = "model") -> DataFrame:
        """(qid, rank, vec_id, score) for each of queries (qid, qv): the k nearest among the buckets that the budget reaches (None: all), ties by vec_id.

        Only buckets that some query chose are read. Buckets are put together in parts of at most PIECE rows, or 2 * PIECE with the last
        one; larger ones are split. A query goes once to each part that it chose buckets of, with a bit for each bucket, and k rows a query
        leave it. Queries that lack an id or a vector find nothing.
        """
        if search_strategy not in STRATEGIES:
            raise ValueError(f"unknown search strategy {search_strategy!r}")
        rank, asked = self._ranking(n_candidates), _asked(queries)
        level, bucket = self._places(True)

        def reach(batches):
            n, met = 0, np.zeros(len(level), bool)
            for whole in batches:
                n += whole.num_rows
                for _, _, place, *_ in rank(whole):
                    met[place] = True
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.packbits(met).tobytes()])], ["n", "places"])

        told = asked.mapInArrow(reach, "n long, places binary").collect()  # a bit a bucket from each task
        met = np.zeros(len(level), bool)
        for r in told:
            met |= np.unpackbits(np.frombuffer(r["places"], np.uint8), count=len(level)).astype(bool)
        if not met.any():
            return self.spark.createDataFrame([], "qid long, rank long, vec_id long, score double")
        by_level: dict[int, list[int]] = {}
        for i, b in zip(level[met].tolist(), bucket[met].tolist()):
            by_level.setdefault(i, []).append(b)
        counts = np.where(met, np.concatenate([self.counts[i] for i in dict.fromkeys(level.tolist())]), 0)
        parts = Parts.of(counts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        start = {int(i): int(np.flatnonzero(level == i)[0]) for i in np.unique(level)}
        groups = exact.grid(1, sum(r["n"] for r in told), self.config.input_shape, 1)[1]
        metric = self.config.distance_fn

        def ask(batches):
            for batch, row, place, *_ in (x for whole in batches for x in rank(whole)):
                if len(row):
                    yield parts.questions(batch, row, place, groups)

        def deal(batches):
            for batch in batches:
                at = batch.column("bucket").to_numpy() + np.array([start[i] for i in batch.column("level").to_pylist()], np.int64)
                kept = np.flatnonzero(met[at])
                part, local = parts.find(at[kept], batch.column("vec_id").to_numpy()[kept])
                yield exact.packed(batch.take(pa.array(kept)), part, "vec_id", "embedding", places=local)

        def near(key, left, right):
            found = parts.nearest(metric, left, right, k)
            return pa.table(dict(zip(["qid", "vec_id", "near"], found)))

        chosen = asked.mapInArrow(ask, exact.PACKED + ", bits binary, single boolean, cell int")
        cell = F.explode(F.expr(f"transform(sequence(0, {groups - 1}), x -> part * {groups} + x)"))
        rows = self._read(by_level).mapInArrow(deal, exact.PACKED + ", places binary, single boolean").withColumn("cell", cell)
        found = chosen.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(near, "qid long, vec_id long, near double")
        return exact.ranked(found, k, metric)

    search_bulk = search

    def search_one(self, vector, k: int = DEFAULT_K, n_candidates: int = DEFAULT_CANDIDATES, search_strategy: str = "model") -> list[int]:
        query = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, qv array<double>")
        return [r["vec_id"] for r in self.search(query, k, n_candidates, search_strategy).orderBy("rank").collect()]

    def _read(self, by_level: dict[int, list[int]]) -> DataFrame:
        """The rows of the chosen buckets. Cold ones that the cache has room for are read from it, the last used ones stay."""
        cold = [(i, b) for i, buckets in by_level.items() for b in sorted(buckets) if any(p.cold for p in self.parts.get(i, []))]
        room = distance.cached_buckets(self.config.cold_cache_size_bytes, self.config.bucket_size, self.config.input_shape) if self.config.cold_cache_size_bytes else 0
        wanted, kept = cold[:room], set(self._cold_cache)
        if wanted:
            for x in wanted:
                self._cold_cache[x] = None
                self._cold_cache.move_to_end(x)
            while len(self._cold_cache) > room:
                self._cold_cache.popitem(last=False)
            if not set(wanted) <= kept or self._cached is None:
                before, self._cached = self._cached, self.scan(list(self._cold_cache)).persist()
                if before is not None:
                    before.unpersist()
        left = {i: [b for b in buckets if (i, b) not in set(wanted)] for i, buckets in by_level.items()}
        rows = [self.level_rows(i, buckets) for i, buckets in left.items() if buckets]
        if wanted:
            rows.append(self._cached.where(_any_of(wanted)))
        return reduce(DataFrame.unionByName, rows)

    def invalidate_cold_cache(self) -> None:
        self._cold_cache.clear()
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    # -- statistics

    def bucket_counts(self) -> DataFrame:
        """(level, bucket, occ) of buckets that hold rows."""
        held = [(i, int(b), int(n[b])) for i, n in self.counts.items() for b in np.flatnonzero(n)]
        return self.spark.createDataFrame(held, "level int, bucket int, occ long")

    def level_stats(self) -> DataFrame:
        """(level, n_buckets, capacity, occupied, n_empty) of every level, empty ones too."""
        rows = [(i, self.config.n_buckets(i), self.config.capacity(i), n, int((self.counts[i] == 0).sum())) for i, n in enumerate(self.levels)]
        return self.spark.createDataFrame(rows, "level int, n_buckets long, capacity long, occupied long, n_empty long")

    def bucket_stats(self) -> DataFrame:
        """(level, bucket, occupied) of every bucket, empty ones too."""
        return self.spark.createDataFrame([(i, b, int(n)) for i in range(len(self.routers)) for b, n in enumerate(self.counts[i])], "level int, bucket int, occupied long")

    def stats(self) -> DataFrame:
        """One row: n_levels, n_buckets, size (capacity with the buffer's), occupied, buffer_occupied, n_empty_buckets."""
        one = self.level_stats().agg(F.count(F.lit(1)).alias("n_levels"), F.sum("n_buckets").alias("n_buckets"), (F.sum("capacity") + self.config.buffer_size).alias("size"), (F.sum("occupied") + self.buffered).alias("occupied"), F.sum("n_empty").alias("n_empty_buckets"))
        return one.withColumn("buffer_occupied", F.lit(self.buffered).cast("long"))

    def memory_usage(self) -> int:
        """Logical bytes of hot rows, the buffer and the routers; cold levels count nothing."""
        hot = sum(n for i, n in enumerate(self.levels) if not self.is_cold(i)) + self.buffered
        return hot * (4 * self.config.input_shape + 4) + sum(a.nbytes for r in self.routers for a in r.arrays().values() if a.dtype.kind in "fiu")

    # -- storage

    def cool(self) -> VectorIndex:
        """Moves levels that the configuration makes cold and that aren't yet, as after a change of it."""
        warm = [i for i in range(len(self.routers)) if self.is_cold(i) and any(not p.cold for p in self.parts.get(i, []))]
        if not warm:
            return self
        rows = reduce(DataFrame.unionByName, [self.level_rows(i) for i in warm])
        gone = self._emptied(warm)
        self._write(rows, warm)
        return self._done(gone)

    def scan(self, buckets: list[tuple[int, int]]) -> DataFrame:
        """The rows of the named buckets (level, bucket); of cold levels only their folders are read."""
        by_level: dict[int, list[int]] = {}
        for level, bucket in buckets:
            by_level.setdefault(level, []).append(bucket)
        rows = [self.level_rows(i, b).where(F.col("bucket").isin([int(x) for x in b])) for i, b in by_level.items()]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], RECORDS)

    def save(self, path: str) -> None:
        """A new folder with the hot records and what else there is to know, that points at cold parts where they lie; one that exists raises."""
        cold = {i: [p.path for p in parts if p.cold] for i, parts in self.parts.items()}
        meta = {"config": _config_json(self.config), "counts": {i: n.tolist() for i, n in self.counts.items()}, "cold": cold, "routers": [packed(r) for r in self.routers]}
        warm = [self.level_rows(i) for i, parts in self.parts.items() if parts and not parts[0].cold]
        hot = reduce(DataFrame.unionByName, warm, self.spark.createDataFrame([], RECORDS))
        hot.write.mode("errorifexists").partitionBy("level").parquet(f"{path}/records")
        write_text(self.spark, json.dumps(meta), f"{path}/meta")
        self._own -= {p for parts in self.parts.values() for p in parts if p.cold}  # the copy needs them

    dump = save

    @classmethod
    def load(cls, spark: SparkSession, path: str, factory: Factory = train_mlp) -> VectorIndex:
        meta = json.loads(read_text(spark, f"{path}/meta"))
        out = cls(spark, _config_of(meta["config"]), factory)
        out.routers = [unpacked(r) for r in meta["routers"]]
        out.counts = {int(i): np.array(n, np.int64) for i, n in meta["counts"].items()}
        for i, n in out.counts.items():
            cold = [Part(p, True) for p in meta["cold"].get(str(i), [])]
            out.parts[i] = cold or ([Part(f"{path}/records/level={i}")] if n.any() else [])
        return out


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("qid is not null and qv is not null").select(F.col("qid").cast("long").alias("qid"), F.col("qv").cast("array<double>").alias("qv"))


def _any_of(buckets: list[tuple[int, int]]):
    return reduce(lambda a, b: a | b, [(F.col("level") == int(i)) & (F.col("bucket") == int(b)) for i, b in buckets])


def _config_json(config: IndexConfig) -> dict:
    from dataclasses import asdict

    return asdict(config)


def _config_of(data: dict) -> IndexConfig:
    return IndexConfig(**{**data, "layers": tuple((k, n) for k, n in data["layers"]), "train": TrainParams(**data["train"])})
