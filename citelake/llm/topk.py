"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are integers. A block of candidates has, per dimension, its postings in order of
the component's quantised level, measured from the dimension's end that the query's sign
points away from, so that every impact ``|q_d| * level`` is a gain. A segment is the
postings of one level; the segments of a dimension whose impact lies in a band are one run.
A query takes bands of impact in descending order, over all dimensions, and adds each
posting's impact to its vector's accumulator. After a band down to ``t``, a dimension that
a vector has not met yet can add at most ``min(t, the dimension's largest impact)``, and
quantisation can have cut off a known amount. Only vectors that can so reach the k-th best
accumulator are possible members. The search stops when these are few, which proves the
rest out, and scores the possible members, all of them, exactly.

A block is one task's index, built once; the queries stream through it. Its k best per
query meet the other blocks' in one last ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.common import tidy

_COMPONENTS = 1 << 20  # of a block: about 60 MB of index
_LEAST_BLOCK = 1024
_LEVELS = 256
_ONE = 1 << 44  # a dimension met, in an accumulator's high bits


class ImpactIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = _LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        low, high = self.vectors.min(0), self.vectors.max(0)
        self.step = np.maximum(1, -(-(high - low + 1) // levels))
        self.top = (high - low) // self.step
        rising = np.argsort(self.vectors, axis=0, kind="stable").T
        sorted_by = np.take_along_axis(self.vectors.T, rising, 1)
        # postings and levels by rising level, for queries that are positive or negative there
        self.postings = np.ascontiguousarray(rising), np.ascontiguousarray(rising[:, ::-1])
        self.levels = (
            (sorted_by - low[:, None]) // self.step[:, None],
            np.ascontiguousarray(((high[:, None] - sorted_by) // self.step[:, None])[:, ::-1]),
        )
        #: segments' postings taken, all of them, rows rescored, searches
        self.work = np.zeros(4, np.int64)

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows of other ids, by score, then id."""
        others = np.flatnonzero(self.ids != own)
        possible = self._possible(others, query, k) if len(others) > k else others
        exact = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        self.work += 0, 0, len(possible), 1
        return [(int(self.ids[possible[b]]), int(exact[b])) for b in best]

    def _possible(self, others: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
        weight = np.abs(query) * self.step
        most = weight * self.top
        cut = int((np.abs(query) * (self.step - 1)).sum())
        dims = np.flatnonzero(most)
        lists = [(self.postings[side][d], self.levels[side][d]) for d in dims for side in (int(query[d] < 0),)]
        weights, mosts, ends = weight[dims].tolist(), most[dims].tolist(), [len(self.ids)] * len(dims)
        packed = int(most.sum()) < _ONE
        sums, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        few = max(32, 4 * k)
        self.work += 0, len(self.ids) * len(dims), 0, 0
        down_to = int(most.max(initial=0)) // 8
        while True:
            for x, (postings, levels) in enumerate(lists):
                if mosts[x] > down_to:
                    start, end = int(levels.searchsorted(down_to // weights[x], "right")), ends[x]
                    if start < end:
                        run, ends[x] = postings[start:end], start
                        if packed:
                            sums[run] += levels[start:end] * weights[x] + _ONE
                        else:
                            sums[run] += levels[start:end] * weights[x]
                            met[run] += 1
                        self.work[0] += end - start
            gained, times = (sums & (_ONE - 1), sums >> 44) if packed else (sums, met)
            rest = int(np.minimum(most, down_to).sum()) + cut
            gained, times = gained[others], times[others]
            kth = np.partition(gained, len(others) - k)[len(others) - k]
            possible = others[gained + rest - down_to * times >= kth]
            if len(possible) <= few or down_to == 0:
                return possible
            down_to //= 2


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` with floor(256 * x) of each component; vectors that are null or hold null
    or non-finite components, and rows without an id, take no part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long"))
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v")
    )


def _lengths(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return rows.column("v").value_lengths().to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else np.concatenate([_lengths(b) for b in rows.to_batches()])


def _matrix(rows: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors, cut or filled up with zeros to ``width``."""
    if isinstance(rows, pa.Table):
        return np.concatenate([_matrix(b, width) for b in rows.to_batches()])
    lengths = _lengths(rows)
    flat = rows.column("v").flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), width), np.int64)
    inside = place < width
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], place[inside]] = flat[inside]
    return out


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, candidates before queries: the k best of the block per query."""
    block, held, index, width = None, [], None, 0
    for batch in batches:
        if not len(batch):
            continue
        blocks, asks = batch.column("b").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if blocks[start] != block:
                block, held, index = blocks[start], [], None
            part = batch.slice(start, stop - start)
            if not asks[start]:
                held.append(part)
                continue
            if index is None:
                if not held:
                    continue
                rows = pa.Table.from_batches(held)
                width = int(max(_lengths(rows).max(), 1))
                index, held = ImpactIndex(rows.column("id").to_numpy(), _matrix(rows, width)), []
            found = []
            # what a query has beyond the candidates' width meets zeros
            asking = zip(part.column("id").to_pylist(), part.column("q").to_pylist(), _matrix(part, width), strict=True)
            for own, q, query in asking:
                found += [(own, q, i, s) for i, s in index.search(own, query, k)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "q", "id", "score"])


def top_k(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5
) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row that ``is_query`` holds for, the k rows
    of other ids with the highest integer inner product, ties to the smaller id; all rows if
    there are fewer. A shorter vector counts as filled up with zeros. Equal query rows are
    one query; equal candidate rows are ranked each. Scores must fit in 64 bits.
    """
    base = integer_vectors(rows, id_col, vector_col)
    queries = integer_vectors(rows.where(is_query), id_col, vector_col).distinct().withColumn("q", F.xxhash64("id", "v"))
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(_LEAST_BLOCK, _COMPONENTS // max(1, width))
    blocks = max(1, -(-n // block), min(tasks, n // _LEAST_BLOCK))
    no = F.lit(False)
    candidates = base.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), no.alias("asks"), "id", "v", F.lit(0).cast("long").alias("q"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), (~no).alias("asks"), "id", "v", "q")
    dealt = candidates.union(asked).repartition(tasks, "b").sortWithinPartitions("b", "asks")
    scored = dealt.mapInArrow(tidy(lambda batches: _answers(batches, k)), "query_id long, q long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
