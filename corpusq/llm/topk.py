"""Exact top-k by inner product with multi-resolution segment statistics.

With m and s the mean and the standard deviation of a segment of length l, the centred parts obey
Cauchy-Schwarz, so <q, x> <= sum over segments of l * (m_q * m_x + s_q * s_x); the squared distance has the
matching lower bound |q|^2 + |x|^2 - 2 * that. Coarse segments are tried first, survivors meet finer ones, and
what is left is computed exactly in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import checkpoint, ship

#: Rows of a block of queries and of a block of candidates; a task holds a few arrays of QUERY_BLOCK x ROW_BLOCK doubles.
QUERY_BLOCK, ROW_BLOCK = 512, 2048
#: Bytes of query vectors that are broadcast at once.
TURN_BYTES = 32 << 20
#: Segments of the resolutions, coarse to fine.
LEVELS = (1, 4, 16)


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of n segments, each multiplied by the root of its length."""
    edges = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    centred = x - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1))


def block_topk(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query row, id, score) of candidates that may be among a query's k best.

    ``floor``: a score that k candidates of each query are known to reach (-inf at first); it rises in place.
    """
    qf, xf = q.astype(float), x.astype(float)
    qn, xn = np.sqrt((qf * qf).sum(1)), np.sqrt((xf * xf).sum(1))
    slack = 1e-9 * qn.max(initial=0) * xn.max(initial=0) + 1e-6
    if len(ids) >= k and np.isneginf(floor).any():  # any k scores give a valid floor; those of the best bounds are high
        pick = np.argsort(-xn, kind="stable")[: 4 * k]
        some = np.sort(qf @ xf[pick].T, axis=1)[:, -k] if len(pick) > k else (qf @ xf[pick].T).min(axis=1)
        same = np.isin(ids[pick], qid).any()
        if not same:
            np.maximum(floor, some - slack, out=floor)
    alive = None
    for n in LEVELS:
        (qm, qs), (xm, xs) = segments(qf, n), segments(xf, n)
        if alive is None:
            bound = qm @ xm.T + qs @ xs.T
            alive = np.nonzero(bound + slack >= floor[:, None])
        elif len(alive[0]) > 0.3 * len(q) * len(x):  # nearly all survive: one product is cheaper than gathering
            bound = qm @ xm.T + qs @ xs.T
            ok = np.zeros_like(bound, bool)
            ok[alive] = True
            alive = np.nonzero(ok & (bound + slack >= floor[:, None]))
        else:
            a, b = alive
            ok = np.concatenate([(qm[a[i : i + 65536]] * xm[b[i : i + 65536]]).sum(1) + (qs[a[i : i + 65536]] * xs[b[i : i + 65536]]).sum(1) + slack >= floor[a[i : i + 65536]] for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            alive = a[ok], b[ok]
    a, b = alive
    fits = float(np.abs(qf).max(initial=0)) * float(np.abs(xf).max(initial=0)) * max(1, x.shape[1]) < 2.0**53
    if fits and len(a) > 0.2 * len(q) * len(x):  # integers below 2^53 are exact in doubles
        score = (qf @ xf.T)[a, b].astype(np.int64)
    else:
        score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
    other = qid[a] != ids[b]
    a, b, score = a[other], b[other], score[other]
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    start = np.searchsorted(a, np.arange(len(q)))
    rank = np.arange(len(a)) - start[a]
    best = rank < k
    last = rank == k - 1
    np.maximum.at(floor, a[last], score[last].astype(float))
    return a[best], ids[b[best]], score[best]


def _packed(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one dimension: dim, ids and values as little-endian 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim):
            ids, vals = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vals, "<i8").tobytes()], pa.binary())], ["dim", f"{tag}_ids", f"{tag}_vals"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, f"dim int, {tag}_ids binary, {tag}_vals binary")


def exact_topk(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x), x as double. ``queries`` selects the query rows; candidates are all
    rows but those of the query's own id. Ties go to the smaller id. Vectors or ids that are null, and vectors
    holding null, NaN or infinite components, take no part; vectors meet vectors of the same length only. A
    repeated row counts once if the id and the vector repeat; one id with several vectors keeps each (equal
    scores of one id then rank by no further rule). Scores must fit 64 bits.

    Candidates are dealt by id into partitions of a few blocks. A query block meets every candidate block of its
    dimension: a stated query set against all rows. Query blocks are broadcast in turns of at most TURN_BYTES, which
    are counted first, so candidates never move again; beyond one turn, a further one reads the packed candidates
    again. A task carries the k-th best score of its query blocks along, emits k rows per query and block pair
    at most, and a grouped top-k (limited on the map side) merges them.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ints = good.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), "q")
    size = good.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("q"), 1)).alias("asked"), F.coalesce(F.sum(F.when(F.col("q"), 8 + 8 * F.size("v"))), F.lit(0)).alias("bytes")).first()
    blocks, cores = -(-size["rows"] // ROW_BLOCK), spark.sparkContext.defaultParallelism
    parts = max(1, min(blocks, 2 * cores), -(-blocks // 16))
    turns = max(1, -(-size["bytes"] // TURN_BYTES))
    base = ints.repartition(parts, "id").distinct()
    right = _packed(base.select("id", "v"), ROW_BLOCK, "x")
    if turns > 1:
        right = checkpoint(right)
    asked = ints.where("q").select("id", "v").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for dim, qi, qv, xi, xv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qid, ids = np.frombuffer(qi, "<i8"), np.frombuffer(xi, "<i8")
                if len(floors) > 4096:
                    floors.clear()
                floor = floors.setdefault(qi, np.full(len(qid), -np.inf))
                a, b, s = block_topk(qid, np.frombuffer(qv, "<i8").reshape(len(qid), dim), floor, ids, np.frombuffer(xv, "<i8").reshape(len(ids), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    found = None
    for turn in range(turns):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).repartition(max(1, -(-size["asked"] // (turns * QUERY_BLOCK))))
        left = F.broadcast(_packed(mine, QUERY_BLOCK, "q").withColumnRenamed("dim", "qdim"))
        pairs = right.join(left, F.col("qdim") == F.col("dim")).select("dim", "q_ids", "q_vals", "x_ids", "x_vals")
        got = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
        found = got if found is None else found.unionAll(got)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
