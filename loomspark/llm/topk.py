"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in vertical layout: a block of vectors holds each group of dimensions as one matrix, its
vectors in falling order of mass. A task takes one candidate block and one query block and adds the inner
products group by group. Before the first and after each group it bounds what the remaining dimensions can
add (Cauchy-Schwarz on the remaining masses); a pair whose bound stays below the query's floor, a proven
lower bound of its k-th best score, is out. Floors start from the block of the heaviest vectors, which
every query meets first, are carried to all other blocks, and rise with the lower bounds found there.
While many pairs are left, whole matrices are multiplied; once few are, the survivors of each query are
compacted to a list of pairs, and only these go on. All arithmetic is on integers, so scores are exact;
what 64 bits don't hold is an error.

Query blocks meet candidate blocks as rows (query block, candidate block): a stated query set against
all rows, in blocks. Each meeting gives k rows a query at most; a window keeps the k best of them.

Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows
without an id. Vectors of different length never meet. Repeated rows are candidates each by itself, under
the same id, and queries each by itself: a query row leaves out itself only, so a second row of its id
is a candidate. Ties of score and id are copies. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

_PACKED = "dim int, ids binary, rows binary, body binary, is_query boolean, mass double"


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, asked: Column | bool = False) -> DataFrame:
    """(vec_id, v array<bigint>, asked): floor(scale * x) of each usable vector; an error where that exceeds 64 bits."""
    usable = (
        F.col(vector_col).isNotNull()
        & (F.size(vector_col) > 0)
        & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    )
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    wide = F.raise_error(F.lit("a scaled component exceeds 64 bits")).cast("long")
    whole = F.transform(vector_col, lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**63), F.floor(scaled(x))).otherwise(wide))
    return df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(F.lit(asked), F.lit(False)).alias("asked"))


def _blocks(vectors: DataFrame, rows: int, query_rows: int, candidates: bool = True) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length, heavy ones first, packed dimension by dimension, and
    blocks of up to ``query_rows`` of those that are asked. Rows get numbers, negative ones where they are no
    candidates."""
    numbered = vectors.withColumn("row", F.monotonically_increasing_id() if candidates else -1 - F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}
        most = {False: rows, True: query_rows}

        def out(dim: int, is_query: bool, parts) -> pa.RecordBatch:
            ids, number, body = (np.concatenate([p[k] for p in parts]) for k in range(3))
            mass = np.sqrt((body.astype(np.float64) ** 2).sum(1))
            order = np.argsort(-mass, kind="stable")
            binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
            columns = [pa.array([dim], pa.int32()), binary(ids[order]), binary(number[order]), binary(body[order].T), pa.array([is_query]), pa.array([float(mass.max())])]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "rows", "body", "is_query", "mass"])

        for batch in batches:
            ids, asked, number = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), np.asarray(batch.column(3))
            lists = batch.column(1)
            flat, off = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            off = off - off[0]
            size = np.diff(off)
            for dim in np.unique(size):
                for is_query in (False, True) if candidates else (True,):
                    at = np.flatnonzero((size == dim) & (asked | (not is_query)))
                    key = (int(dim), is_query)
                    while len(at):
                        parts = held.setdefault(key, [])
                        room = most[is_query] - sum(len(p[0]) for p in parts)
                        some, at = at[:room], at[room:]
                        parts.append((ids[some], number[some], flat[off[some][:, None] + np.arange(dim)]))
                        if len(some) == room:
                            yield out(*key, held.pop(key))
        for key, parts in held.items():
            yield out(*key, parts)

    return numbered.select("vec_id", "v", "asked", "row").mapInArrow(run, _PACKED)


class Work:
    """Products of single dimensions: how many were made, of how many."""

    def __init__(self) -> None:
        self.done = self.all = 0


def best_of_block(q_rows: np.ndarray, queries: np.ndarray, c_rows: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int, floor: np.ndarray | None = None, step: int = 8, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate id, score) of up to k best candidates of each query that may reach its floor.

    queries: dimensions x queries, block: dimensions x candidates, both integers; q_rows and c_rows: the
    rows' numbers. Sums run in doubles where these hold them exactly, else in 64-bit integers, else in
    Python's; only doubles are pruned. A score of over 64 bits is an error.
    """
    dims, nq, nc = len(block), queries.shape[1], block.shape[1]
    largest = float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    exact = largest < 2**52
    work = work or Work()
    work.all += dims * nq * nc
    own = q_rows[:, None] == c_rows  # a query's own row is no candidate
    if not exact:
        kind = np.int64 if largest < 2**62 else object
        work.done += dims * nq * nc
        score = queries.astype(kind).T @ block.astype(kind)
        row, col = np.nonzero(~own)
        score = score[row, col]
        if kind is object:
            if len(score) and max(abs(score.max()), abs(score.min())) >= 2**63:
                raise OverflowError("a score exceeds 64 bits")
            score = score.astype(np.int64)
        return _first_k(row, ids[col], score, k)
    order = np.argsort(-(np.abs(queries).sum(1) * np.abs(block).sum(1).astype(np.float64)), kind="stable")  # heavy dimensions first
    q, c = queries[order].astype(np.float64), block[order].astype(np.float64)
    cuts = [*range(0, dims, step), dims]
    tail = lambda m: np.sqrt(np.concatenate([np.cumsum((m**2)[::-1], 0)[::-1], np.zeros((1, m.shape[1]))]))[cuts]  # noqa: E731  mass from a cut on
    q_mass, c_mass = tail(q), tail(c)
    floor = np.full(nq, -np.inf) if floor is None else floor.astype(np.float64)
    cols = np.flatnonzero((np.outer(q_mass[0], c_mass[0]) * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(0))
    score = np.zeros((nq, len(cols)))
    pairs = None  # (query, column of cols) of the survivors, once they are few
    for at, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        if pairs is None:
            work.done += (b - a) * score.size
            score += q[a:b].T @ c[a:b][:, cols]
            slack = 1e-6 if b < dims else 0

            def most(some) -> np.ndarray:
                """What the remaining dimensions can add to the score of some columns."""
                return np.outer(q_mass[at] * (1 + 1e-9), c_mass[at][cols[some]]) + slack

            if 2 * b >= dims:  # the k-th best lower bound of any candidates is a floor
                head = slice(0, 1024)
                low = score[:, head] - most(head)
                low[own[:, cols[head]]] = -np.inf
                if low.shape[1] > k:
                    floor = np.maximum(floor, np.partition(low, low.shape[1] - k, 1)[:, low.shape[1] - k])
            # Whether few are left shows on some columns; only then are all bounds worth their while.
            sample = slice(None, None, max(1, len(cols) // 128))
            if b < dims and ((score[:, sample] + most(sample)) >= floor[:, None]).mean() * 8 > 1:
                continue
            alive = ((score + most(slice(None))) >= floor[:, None]) & ~own[:, cols]
            if alive.sum() * 4 < alive.size or b == dims:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            row, col = pairs
            work.done += (b - a) * len(row)
            for i in range(0, len(row), 1 << 17):
                part = slice(i, i + (1 << 17))
                score[part] += np.einsum("dp,dp->p", q[a:b][:, row[part]], c[a:b][:, cols[col[part]]])
            keep = score + q_mass[at][row] * c_mass[at][cols[col]] * (1 + 1e-9) + 1e-6 >= floor[row]
            pairs, score = (row[keep], col[keep]), score[keep]
    row, col = pairs
    return _first_k(row, ids[cols[col]], score.astype(np.int64), k)


def _first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's pairs the k of highest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def top_k(df: DataFrame, queries: DataFrame | Column | str, k: int = 5, scale: int = 256, block_rows: int = 8192, query_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best rows of ``df``, ties to the smaller id.

    queries: a condition on the rows of ``df`` (such a row leaves out itself), or a table of vectors of
    its own, for which all rows of ``df`` are candidates.
    """
    own = not isinstance(queries, DataFrame)
    asked = (F.expr(queries) if isinstance(queries, str) else queries) if own else False
    blocks = materialize(_blocks(quantised(df, id_col, vector_col, scale, asked), block_rows, query_rows))
    packed = blocks.where("is_query") if own else materialize(_blocks(quantised(queries, id_col, vector_col, scale, True), block_rows, query_rows, False))
    # Candidate blocks get numbers; query blocks go to each number once.
    numbered = blocks.where("NOT is_query").withColumn("_to", F.xxhash64("rows", "dim")).drop("is_query")
    groups = numbered.select("_to", "dim", "mass")
    wanted = packed.select("dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("body").alias("q_body"))
    cut = lambda x: np.frombuffer(x, np.int64)

    def meetings(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, rows, body, q_ids, q_rows, q_body, floor = (batch.column(n)[i].as_py() for n in range(8))
                least = None if floor is None else np.frombuffer(floor, np.float64)
                best = best_of_block(cut(q_rows), cut(q_body).reshape(dim, -1), cut(rows), cut(ids), cut(body).reshape(dim, -1), k, least)
                yield q_ids, q_rows, q_body, dim, best

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_rows, q_body, dim, (row, _, score) in meetings(batches):
            floor = np.full(len(q_rows) // 8, -np.inf)
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            floor[row[last]] = score[last] - np.abs(score[last]) * 1e-12 - 1
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (q_ids, q_rows, q_body, floor.tobytes()))], names=["dim", "q_ids", "q_rows", "q_body", "floor"])

    order = ["dim", "ids", "rows", "body", "q_ids", "q_rows", "q_body", "floor"]
    heaviest = groups.groupBy("dim").agg(F.max_by("_to", F.struct("mass", "_to")).alias("_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    wanted = wanted.withColumn("floor", F.lit(None).cast("binary"))
    if heaviest.limit(1).count():
        first = wanted.join(numbered.join(heaviest, ["dim", "_to"]), "dim", "left")
        lone = first.where("ids IS NULL").select(*wanted.columns)
        wanted = materialize(first.where("ids IS NOT NULL").select(*order).mapInArrow(floors, "dim int, q_ids binary, q_rows binary, q_body binary, floor binary").unionByName(lone))
    met = numbered.join(wanted.join(groups.drop("mass"), "dim"), ["_to", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_rows, _, _, (row, found, score) in meetings(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cut(q_ids)[row]), pa.array(cut(q_rows)[row]), pa.array(found), pa.array(score)], names=["query_id", "query_row", "vec_id", "score"])

    some = met.select(*order).mapInArrow(run, "query_id long, query_row long, vec_id long, score long")
    ranked = some.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) as int)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    return top_k(load(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


OP5_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
