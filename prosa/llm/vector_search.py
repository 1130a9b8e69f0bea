"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(256 x), held as doubles, which hold every such number. They are laid down in blocks: for each block a grid of `cells`
cells per dimension between the block's least and greatest value, one byte per component with the cell's number, and the exact vectors.
For a query q, a vector in cells c has the score q.low(c) + sum(max(q, 0) (width - 1)) at most, where low(c) is the cell's lower
corner; that is one product of the query with the bytes. Queries scan these bounds, read the exact vectors of the best ones, and then of all
others whose bound is not below the k-th exact score so far, highest bound first: the k-th result is then certain.

Blocks stay where they are: the query set is cut into groups of at most `group` queries (and GROUP_NUMBERS components, 32 MB), and each group in turn is
broadcast to the tasks, which go over their blocks with it (a stated set against all rows, in blocks). A task keeps the k best of each query over all its
blocks, so that later blocks are read against what earlier ones gave, and sends only these; a window keeps the best k. Hot or equal vectors
don't gather anywhere, and no vector is shuffled but the queries themselves and rows that share a vec_id.

Products whose terms could exceed 2^53 in sum are made with whole numbers of any size, their bounds widened by the rounding of doubles. Scores beyond the
range of a long are ranked exactly and given as the nearest long.

Defined cases: vectors that are null, empty or hold null or non-finite components (or ones whose 256-fold is no finite double), and rows without a
vec_id, take no part; vectors of any length are compared whole, with those of the same length only; rows equal in vec_id and integers count once, rows
that share only the vec_id each count, as candidates and as queries; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prosa.llm.common import stage, stage_parts

#: Components of a broadcast group of queries, and of vectors that a task holds before it lays down a block.
GROUP_NUMBERS = 4_000_000
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class SearchOptions:
    k: int = 5
    every: int = 50
    cells: int = 64
    block: int = 4096
    group: int = 16_384
    at_once: int = 256
    first_read: int = 32


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and exact (whole numbers as doubles) of the vectors that take part; rows equal in both once."""
    known = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256.0 * x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    rows = known.where(finite).select("vec_id", F.transform("embedding", lambda x: whole(256.0 * x)).alias("exact"))
    again = stage(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    return rows.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id", "left_semi").dropDuplicates(["vec_id", "exact"]))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Vectors of one length, up to `most` in a row: dim, ids and exact (packed doubles)."""

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}
        numbers = 0

        def row(dim):
            nonlocal numbers
            ids, vectors = held.pop(dim)
            numbers -= dim * len(ids)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], names=["dim", "ids", "exact"])

        for batch in batches:
            lists = batch.column(1)
            lengths, flat, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), batch.column(0).to_pylist()
            at = 0
            for i, dim in zip(ids, lengths.tolist()):
                own = held.setdefault(dim, ([], []))
                own[0].append(i)
                own[1].append(flat[at : at + dim])
                at += dim
                numbers += dim
                if len(own[0]) == most or dim * len(own[0]) >= GROUP_NUMBERS:
                    yield row(dim)
                elif numbers > 2 * GROUP_NUMBERS:  # many lengths: the fullest goes
                    yield row(max(held, key=lambda d: d * len(held[d][0])))
        for dim in list(held):
            yield row(dim)

    return rows.mapInArrow(pack, "dim int, ids binary, exact binary")


def quantised(exact: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least values and widths by dimension, and the cell of each component."""
    least = exact.min(0)
    width = np.maximum(1.0, np.ceil((exact.max(0) / cells - least / cells) + 1.0 / cells))
    return least, width, np.minimum(np.floor(exact / width - least / width), cells - 1).clip(0).astype(np.uint8)


def _with_cells(blocks: DataFrame, cells: int) -> DataFrame:
    def quantise(batches):
        for batch in batches:
            parts = [[x.tobytes() for x in quantised(np.frombuffer(exact).reshape(-1, dim), cells)] for dim, exact in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(list(c), pa.binary()) for c in zip(*parts))], names=["dim", "ids", "exact", "low", "width", "cell"])

    return blocks.mapInArrow(quantise, "dim int, ids binary, exact binary, low binary, width binary, cell binary")


def scores_of(rows: np.ndarray, query: np.ndarray, small: bool) -> list[int]:
    """Exact inner products as whole numbers. small: doubles are exact."""
    if small:
        return (rows @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(row, q)) for row in rows]


class Best:
    """The k best (score, vec_id) of a query so far, as ascending (-score, vec_id)."""

    __slots__ = ("found", "k")

    def __init__(self, k: int):
        self.found, self.k = [], k

    def add(self, scores: list[int], ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            least = sorted(scores)[-self.k]
            keep = [(-s, i) for s, i in zip(scores, ids.tolist()) if s >= least]
        else:
            keep = [(-s, i) for s, i in zip(scores, ids.tolist())]
        self.found = sorted(self.found + keep)[: self.k]

    def may_enter(self, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places whose bound allows them to be among the k best."""
        if len(self.found) < self.k:
            return np.flatnonzero(bound > -np.inf)
        score, last = -self.found[-1][0], self.found[-1][1]
        at = float(min(max(score, -(10**308)), 10**308))
        return np.flatnonzero((bound > at) | (bound == at) & (ids < last)) if abs(score) <= EXACT else np.flatnonzero(bound >= at * (1 - 1e-15 if at > 0 else 1 + 1e-15))


def search_block(best: list[Best], queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, exact: np.ndarray, low: np.ndarray, width: np.ndarray, cell: np.ndarray, options: SearchOptions) -> None:
    """Brings the k best of each query up to date with a block; a query's own row is the one of its id and vector."""
    cells, dim = cell.astype(np.float64), len(low)
    reach = np.maximum(np.abs(exact.min(0)), np.abs(exact.max(0)))
    shared = np.isin(query_ids, ids)
    with np.errstate(over="ignore", invalid="ignore"):
        small = bool(np.abs(queries).max() * reach.max() * dim < EXACT)
        for at in range(0, len(queries), options.at_once):
            q = queries[at : at + options.at_once]
            bounds = (q * width) @ cells.T + (q @ low + np.maximum(q, 0) @ (width - 1))[:, None]
            if not small:
                bounds += ((np.abs(q) @ (reach + width)) * (dim + 8) * 2.0**-50)[:, None]
                bounds[~np.isfinite(bounds)] = np.inf
            for own, bound, query, number in zip(best[at : at + options.at_once], bounds, q, range(at, len(queries))):
                if shared[number]:
                    alike = np.flatnonzero(ids == query_ids[number])
                    bound[alike[(exact[alike] == query).all(1)]] = -np.inf
                rest = own.may_enter(bound, ids)
                if not len(rest):
                    continue
                first = rest if len(rest) <= options.first_read else rest[np.argpartition(-bound[rest], options.first_read)[: options.first_read]]
                own.add(scores_of(exact[first], query, small), ids[first])
                if len(rest) > len(first):
                    bound[first] = -np.inf
                    rest = own.may_enter(bound, ids)
                    rest = rest[np.argsort(-bound[rest], kind="stable")]
                    for part in np.array_split(rest, max(1, len(rest) // 1024)):
                        part = part[own.may_enter(bound[part], ids[part])]
                        if len(part):
                            own.add(scores_of(exact[part], query, small), ids[part])


def far(score: int) -> str:
    """A key that orders scores beyond the range of a long, which are given as its end: after "~" for those within."""
    digits = str(abs(score))
    if score > MOST_LONG:
        return f"~~{len(digits):04d}{digits}"
    return "~" if score >= LEAST_LONG else "".join(str(9 - int(c)) for c in f"{len(digits):04d}{digits}")


FOUND = "group long, number long, query_id long, vec_id long, score long, far string"


def top_k(vectors: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    valid = _valid(vectors)
    blocks = stage(_with_cells(_packed(valid, options.block), options.cells), "va-file")
    asked = valid.where(F.col("vec_id") % options.every == 0)
    groups = stage(_packed(asked.repartition(1 + asked.count() // options.group), options.group), "query-groups")

    def found_for(number: int, sent, dim: int) -> DataFrame:
        def search(batches):
            own_ids, packed = sent.value
            queries, query_ids = np.frombuffer(packed).reshape(-1, dim), np.frombuffer(own_ids, np.int64)
            best = [Best(options.k) for _ in query_ids]
            for batch in batches:
                for ids, exact, low, width, cell in zip(*(batch.column(c).to_pylist() for c in ("ids", "exact", "low", "width", "cell"))):
                    search_block(best, queries, query_ids, np.frombuffer(ids, np.int64), np.frombuffer(exact).reshape(-1, dim), np.frombuffer(low), np.frombuffer(width), np.frombuffer(cell, np.uint8).reshape(-1, dim), options)
            rows = [(number, n, q, i, min(max(-s, LEAST_LONG), MOST_LONG), far(-s)) for n, (q, own) in enumerate(zip(query_ids.tolist(), best)) for s, i in own.found]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["group", "number", "query_id", "vec_id", "score", "far"])

        return blocks.where(F.col("dim") == dim).select("ids", "exact", "low", "width", "cell").mapInArrow(search, FOUND)

    def each_group():
        for number, group in enumerate(groups.toLocalIterator()):  # one bounded group at a time
            sent = spark.sparkContext.broadcast((bytes(group["ids"]), bytes(group["exact"])))
            yield found_for(number, sent, group["dim"])
            sent.destroy()

    found = stage_parts(spark, each_group(), FOUND, "found")
    rank = F.row_number().over(Window.partitionBy("group", "number").orderBy(F.desc("score"), F.desc("far"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= options.k).select("query_id", "rank", "vec_id", "score")
