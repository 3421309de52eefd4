"""Exact top-k search by inner product, pruned with segment means and deviations at several resolutions.

For vectors q and v cut into segments of length L, the squared distance is at least the sum of L ((mean q - mean v)^2 +
(dev q - dev v)^2). With q.v = (|q|^2 + |v|^2 - distance^2) / 2 that bounds the inner product from above. Candidates are
bounded with few segments, then with more, and what can still enter the k best is multiplied out exactly.

Tasks pack candidates and queries into cells of bounded size; each cell of queries meets each cell of candidates once. What a task
has found for a query, in whatever cell, is its bar for the cells that come after: a cell whose outline (the range of its members'
outlines) can't reach the bar of any query is passed over whole, and in others the bounds prune by the best bar so far.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions

#: Vectors of a cell, and segments at each resolution, coarse to fine.
CANDIDATES, QUERIES, SEGMENTS = 4096, 512, (2, 8, 32)
#: Query rows that are bounded at once.
ROWS = 64

CELL = "task int, dim int, ids binary, body binary"


def outline(body: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the means and deviations of its segments, scaled so that the product of two outlines bounds that of the vectors."""
    d = body.shape[1]
    at = np.unique(np.arange(segments) * d // segments)
    length = np.diff(np.append(at, d))
    total, square = np.add.reduceat(body, at, 1), np.add.reduceat(body * body, at, 1)
    mean = total / length
    spread = np.sqrt(np.maximum(square / length - mean * mean, 0))
    return np.concatenate((mean, spread), 1) * np.sqrt(np.concatenate((length, length)))


def top_pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, body: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query, by score and then smaller id; its own id left out.

    bars: per query a score that k others reach already (-inf at first). Candidates below it may be left out, and it is raised
    to what k candidates reach here."""
    bars = np.full(len(query_ids), -np.inf) if bars is None else bars
    if len(np.unique(ids)) < len(ids):  # rows of one id would take several of the k places: all are scored, in as many rounds
        order = np.argsort(ids, kind="stable")
        turn = np.arange(len(ids)) - np.searchsorted(ids[order], ids[order])
        rounds = [order[turn == t] for t in range(int(turn.max()) + 1)]
        # only the first round's ids differ from one another: it alone may raise the bars
        out = top_pairs(query_ids, queries, ids[rounds[0]], body[rounds[0]], k, bars)
        return out + [x for some in rounds[1:] for x in top_pairs(query_ids, queries, ids[some], body[some], k, bars.copy())]
    n, d = body.shape
    out: list[tuple[int, int, int]] = []
    if not d:
        return [(int(q), int(v), 0) for q in query_ids for v in np.sort(ids[ids != q])[:k]]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(body).max(initial=0)) * d
    if largest >= 2.0**53:  # beyond exact doubles: whole numbers of any size, cut to the range of a long
        qs, vs = ([[int(x) for x in row] for row in m] for m in (queries, body))
        for q, row in zip(query_ids.tolist(), qs, strict=True):
            scored = [(max(min(sum(a * b for a, b in zip(row, v, strict=True)), 2**63 - 1), -(2**63)), i) for i, v in zip(ids.tolist(), vs, strict=True) if i != q]
            out += [(q, i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
        return out
    levels = [(outline(queries, s), outline(body, s)) for s in SEGMENTS if s < d]
    if levels and not may_reach(levels[0][0], levels[0][1], bars):
        return out
    slack = 1e-9 * np.linalg.norm(queries, axis=1)[:, None] * max(float(np.linalg.norm(body, axis=1).max()), 1.0) + 1e-6
    for a in range(0, len(queries), ROWS):
        rows = np.arange(a, min(a + ROWS, len(queries)))
        own = query_ids[rows, None] == ids[None]
        coarse = levels[0][0][rows] @ levels[0][1].T if levels else queries[rows] @ body.T
        coarse[own] = -np.inf
        m = min(k, n)
        first = np.argpartition(-coarse, m - 1, 1)[:, :m]
        seed = np.einsum("rkd,rd->rk", body[first], queries[rows])
        seed[np.take_along_axis(own, first, 1)] = -np.inf
        bar = np.maximum(seed.min(1), bars[rows]) if m == k else bars[rows]  # k candidates are at least that good
        i, j = np.nonzero(~own & (coarse + slack[rows] >= bar[:, None]))
        for mine, theirs in levels[1:]:
            if len(i) < 0.05 * own.size:
                bound = np.einsum("pd,pd->p", mine[rows[i]], theirs[j])
            else:
                bound = (mine[rows] @ theirs.T)[i, j]
            keep = bound + slack[rows[i], 0] >= bar[i]
            i, j = i[keep], j[keep]
        score = np.einsum("pd,pd->p", queries[rows[i]], body[j]) if len(i) < 0.05 * own.size else (queries[rows] @ body.T)[i, j]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        full = place == k - 1
        bars[rows[i[full]]] = np.maximum(bars[rows[i[full]]], score[full])
        out += zip(query_ids[rows[i[best]]].tolist(), ids[j[best]].tolist(), score[best].astype(np.int64).tolist(), strict=True)
    return out


def may_reach(queries: np.ndarray, candidates: np.ndarray, bars: np.ndarray) -> bool:
    """Whether some query may reach its bar with some candidate, by the range of the candidates' outlines."""
    low, high = candidates.min(0), candidates.max(0)
    bound = np.maximum(queries * low, queries * high).sum(1)
    return bool((bound + 1e-6 * (1 + np.abs(bound)) >= bars).any())


def _cells(vectors: DataFrame, size: int, tasks: int) -> DataFrame:
    """Vectors of one dimension by up to `size`; a task is named by the cell's first id."""

    def run(batches):
        held: dict[int, list] = {}

        def cell(dim):
            parts = held.pop(dim)
            ids = np.concatenate([p[0] for p in parts])
            body = np.concatenate([p[1] for p in parts])
            name = int(np.uint64(ids[0] * 2654435761 % (1 << 32)) % np.uint64(tasks))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([body.tobytes()], pa.binary())], names=["task", "dim", "ids", "body"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy()
            lengths = np.diff(ends)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                body = values[(ends[:-1][at][:, None] + np.arange(dim)).astype(np.int64)] if dim else np.empty((len(at), 0))
                for a in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[at[a : a + size]], body[a : a + size]))
                    if sum(len(p[0]) for p in held[dim]) >= size:
                        yield cell(dim)
        for dim in list(held):
            yield cell(dim)

    return vectors.mapInArrow(run, CELL)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k best others by inner product of the vectors'
    components as floor(scale * x), ties to the smaller id.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors meet those of their own
    dimension. Rows with the same id are one vector to its queries: listed once, by the best score, and never as their own
    answer. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    tasks = partitions(spark)
    raw = F.col(vector_col).cast("array<double>")
    fine = ~F.exists(raw, lambda x: x.isNull() | F.isnan(x * 0.0))  # NaN and infinities times 0 are NaN
    # floor in doubles: no range is lost
    down = F.transform(raw, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = sound.select(F.col(id_col).cast("long").alias("id"), down.alias("v"), is_query.alias("asks"))
    candidates = _cells(rows.select("id", "v"), CANDIDATES, tasks)
    queries = _cells(rows.where("asks").select("id", "v"), QUERIES, tasks).select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("t"), F.col("dim").alias("d"), F.col("ids").alias("query_ids"), F.col("body").alias("queries")
    )
    met = candidates.join(queries, (F.col("task") == F.col("t")) & (F.col("dim") == F.col("d"))).select("dim", "query_ids", "queries", "ids", "body")

    def run(batches):
        bars: dict[tuple[int, bytes], np.ndarray] = {}  # of each cell of queries that this task has met: a number per query
        for batch in batches:
            for r in range(batch.num_rows):
                d, *cells = (batch.column(c)[r].as_py() for c in range(5))
                query_ids, ids = np.frombuffer(cells[0], "<i8"), np.frombuffer(cells[2], "<i8")
                asked, body = np.frombuffer(cells[1], "<f8").reshape(len(query_ids), d), np.frombuffer(cells[3], "<f8").reshape(len(ids), d)
                name = (d, md5(cells[0] + cells[1]).digest())
                out = top_pairs(query_ids, asked, ids, body, k, bars.setdefault(name, np.full(len(query_ids), -np.inf)))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
