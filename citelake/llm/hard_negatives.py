"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. For an anchor at an
angle a to a reference and a row at b, the angle between the two is at least |a - b| and at
most the smaller of a + b and 2 pi - a - b; over all references that is an interval of the
cosine, and times both norms one of the score, widened by more than floating point can have
cut off. Only where this interval meets the window of scores that the anchor asks for is the
integer score computed.

A block of rows is one task's index: its rows, by label, nearest reference and angle to it,
are in groups with their ranges of angles and norms. A group outside an anchor's window goes
as a whole; of the others each row's own interval by the group's reference is looked at. Two
passes over the blocks: the first finds each anchor's positives, its window's lower end
rising with the scores it has found; their scores set the windows of the second.

The reference directions are those around which a bounded sample of the rows is densest:
vectors near one get narrow intervals. They change what is skipped, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.common import materialize, tidy

_SAMPLE_COMPONENTS = 1 << 17
_REFERENCES = 16
_NEAR = np.cos(np.radians(30))
_COMPONENTS = 1 << 20  # of a block
_LEAST_BLOCK = 1024
_GROUP = 64
_ANCHORS = 128
_SLACK = 1e-6  # radians; arccos loses half of the digits near 0 and pi
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, v)`` with floor(256 * x) of each component. Rows without an id, a label or
    a vector, and those with a null or non-finite component, take no part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite
    return rows.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


def padded(column: pa.Array | pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    """Lists as rows of a matrix, cut or filled up with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), width), kind)
    inside = place < width
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], place[inside]] = flat[inside]
    return out


def reference_directions(sample: np.ndarray, count: int = _REFERENCES) -> np.ndarray:
    """Unit vectors, each the sample's with most uncovered vectors near it, then those that
    are farthest from the ones chosen."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    cos = unit @ unit.T
    near, open_ = cos > _NEAR, np.ones(len(unit), bool)
    chosen, closest = [], np.full(len(unit), -1.0)
    for _ in range(min(count, len(unit))):
        reach = near[:, open_].sum(1)
        k = int(reach.argmax()) if reach.max(initial=0) > 1 else int(closest.argmin())
        chosen.append(k)
        open_ &= ~near[k]
        closest = np.maximum(closest, cos[k])
    return unit[chosen]


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references; a zero vector is at right angles to all."""
    x = vectors.astype(float)
    norms = np.linalg.norm(x, axis=1)
    return norms, np.arccos(np.clip((x @ references.T) / np.where(norms > 0, norms, 1)[:, None], -1, 1))


class Anchors:
    """Anchors of a batch, with the lowest and highest score each asks for."""

    def __init__(self, ids, labels, vectors, norms, angles, low, high):
        self.ids, self.labels, self.vectors, self.norms, self.angles = ids, labels, vectors, norms, angles
        self.low, self.high = low, high


class AngleIndex:
    def __init__(self, ids, labels, vectors, norms, angles):
        home = angles.argmin(1) if angles.shape[1] else np.zeros(len(ids), np.int64)
        nearest = angles[np.arange(len(ids)), home] if angles.shape[1] else np.zeros(len(ids))
        order = np.lexsort((nearest, home, labels))
        self.ids, self.labels, self.vectors, self.norms, self.angles = (x[order] for x in (ids, labels, vectors, norms, angles))
        home = home[order]
        new = np.flatnonzero((np.diff(self.labels) != 0) | (np.diff(home) != 0)) + 1
        runs = np.concatenate([[0], new, [len(ids)]])
        self.starts = np.concatenate([np.arange(a, b, _GROUP) for a, b in zip(runs, runs[1:])])
        self.ends = np.append(self.starts[1:], len(ids))
        self.home, self.group_labels = home[self.starts], self.labels[self.starts]
        self.nearest, self.farthest = (f.reduceat(self.angles, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.least, self.most = (f.reduceat(self.norms, self.starts) for f in (np.minimum, np.maximum))
        self.largest = int(np.abs(self.vectors).max(initial=0))
        #: pairs of anchors and rows: in all, left by groups, left by rows (scored)
        self.work = np.zeros(3, np.int64)

    @staticmethod
    def _scores_between(closest, widest, norms, least, most) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of a score from those of the angle and of the norms."""
        up, down = np.cos(np.maximum(closest - _SLACK, 0)), np.cos(np.minimum(widest + _SLACK, np.pi))
        large, small = norms * most, norms * least
        spare = 1 + 1e-9 * large
        return np.where(down < 0, down * large, down * small) - spare, np.where(up > 0, up * large, up * small) + spare

    def group_bounds(self, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
        shape = len(anchors.ids), len(self.starts)
        closest, widest = np.zeros(shape), np.full(shape, np.pi)
        for r in range(self.angles.shape[1]):
            a, b, c = anchors.angles[:, r, None], self.nearest[:, r], self.farthest[:, r]
            np.maximum(closest, np.maximum(b - a, a - c), out=closest)
            np.minimum(widest, np.minimum(a + c, 2 * np.pi - a - b), out=widest)
        return self._scores_between(closest, widest, anchors.norms[:, None], self.least, self.most)

    def _row_bounds(self, anchors: Anchors, own: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(self.starts[g], self.ends[g])
        if not self.angles.shape[1]:
            closest = widest = np.zeros((len(own), 1))
            return self._scores_between(closest, widest + np.pi, anchors.norms[own, None], self.norms[rows], self.norms[rows])
        a, b = anchors.angles[own, self.home[g], None], self.angles[rows, self.home[g]]
        widest = np.minimum(a + b, 2 * np.pi - a - b)
        return self._scores_between(np.abs(a - b), widest, anchors.norms[own, None], self.norms[rows], self.norms[rows])

    def _products(self, anchors: Anchors, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x, y = anchors.vectors[own], self.vectors[rows]
        if int(np.abs(x).max(initial=0)) * self.largest * x.shape[1] < 1 << 53:
            return (x.astype(float) @ y.T.astype(float)).astype(np.int64)  # whole numbers that a double holds
        return x @ y.T

    def scores(self, anchors: Anchors, same_label: bool, rising: int = 0) -> np.ndarray:
        """Scores of the rows in the anchors' windows, other places have ``_NONE``. With
        ``rising`` the window's lower end is the so-manieth best score found, once there."""
        found = np.full((len(anchors.ids), len(self.ids)), _NONE)
        low, high = anchors.low.copy(), anchors.high
        down, up = self.group_bounds(anchors)
        wanted = (anchors.labels[:, None] == self.group_labels) == same_label
        best = np.full((len(anchors.ids), rising), _NONE)
        self.work[0] += int((wanted * (self.ends - self.starts)).sum())
        for g in np.argsort(-np.where(wanted, up, -np.inf).max(0), kind="stable").tolist():
            own = np.flatnonzero(wanted[:, g] & (up[:, g] >= low) & (down[:, g] <= high))
            if not len(own):
                continue
            rows = np.arange(self.starts[g], self.ends[g])
            self.work[1] += len(own) * len(rows)
            least, most = self._row_bounds(anchors, own, g)
            meets = (most >= low[own, None]) & (least <= high[own, None]) & (anchors.ids[own, None] != self.ids[rows])
            some, any_ = np.flatnonzero(meets.any(1)), np.flatnonzero(meets.any(0))
            if not len(some):
                continue
            meets = meets[np.ix_(some, any_)]
            own, rows = own[some], rows[any_]
            self.work[2] += int(meets.sum())
            exact = np.where(meets, self._products(anchors, own, rows), _NONE)
            found[np.ix_(own, rows)] = exact
            if rising:
                both = np.concatenate([best[own], exact], axis=1)
                best[own] = np.partition(both, both.shape[1] - rising, axis=1)[:, -rising:]
                low[own] = np.maximum(low[own], best[own].min(1))
        return found

    def first(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """``at`` by falling score, then rising id."""
        return at[np.lexsort((self.ids[at], -scores[at]))]


def _anchors(part: pa.RecordBatch, width: int, low, high) -> Anchors:
    angles = padded(part.column("angles"), len(part.column("angles")[0]), float)
    return Anchors(part.column("id").to_numpy(), part.column("label").to_numpy(), padded(part.column("v"), width), part.column("norm").to_numpy(), angles, low, high)


def _positives(index: AngleIndex, part: pa.RecordBatch, width: int, k: int) -> list[tuple]:
    n = len(part)
    anchors = _anchors(part, width, np.full(n, _NONE), np.full(n, np.iinfo(np.int64).max))
    scores, out = index.scores(anchors, True, rising=k), []
    for a, (own, q) in enumerate(zip(part.column("id").to_pylist(), part.column("q").to_pylist(), strict=True)):
        at = np.flatnonzero(scores[a] != _NONE)
        if len(at) > k:
            at = at[scores[a, at] >= np.partition(scores[a, at], len(at) - k)[len(at) - k]]
        out += [(own, q, 0, int(index.ids[i]), int(scores[a, i])) for i in index.first(at, scores[a])[:k]]
    return out


def window(positives: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return np.array([-(-low * p // 100) for p in positives], np.int64), np.array([high * p // 100 for p in positives], np.int64)


def _negatives(index: AngleIndex, part: pa.RecordBatch, width: int, k: int, low: int, high: int) -> list[tuple]:
    asked = [window(s, low, high) for s in part.column("positives").to_pylist()]
    anchors = _anchors(part, width, np.array([a.min() for a, _ in asked]), np.array([b.max() for _, b in asked]))
    scores, out = index.scores(anchors, False), []
    for a, (own, q) in enumerate(zip(part.column("id").to_pylist(), part.column("q").to_pylist(), strict=True)):
        s = scores[a]
        at = index.first(np.flatnonzero((s != _NONE) & (s >= anchors.low[a]) & (s <= anchors.high[a])), s)
        falling = -s[at]
        for which, (least, most) in enumerate(zip(*asked[a], strict=True)):
            start, stop = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            out += [(own, q, which, int(index.ids[i]), int(s[i])) for i in at[start : min(stop, start + k)]]
    return out


_FOUND = "anchor long, q long, which int, id long, score long"


def _answers(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Rows by block, candidates before anchors: what ``answer`` finds in the block."""
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
                width = max(1, max(int(x.value_lengths().to_numpy(zero_copy_only=False).max()) for x in rows.column("v").chunks))
                angles = padded(rows.column("angles"), len(rows.column("angles")[0]), float)
                index = AngleIndex(rows.column("id").to_numpy(), rows.column("label").to_numpy(), padded(rows.column("v"), width), rows.column("norm").to_numpy(), angles)
                held = []
            for at in range(0, len(part), _ANCHORS):
                found = answer(index, part.slice(at, _ANCHORS), width)
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["anchor", "q", "which", "id", "score"])


def _measure(batches: Iterator[pa.RecordBatch], references: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms, angles = angles_to(padded(batch.column("v"), references.shape[1]), references)
        # components beyond the references' width are at right angles to them, but have a norm
        lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        if len(lengths) and lengths.max() > references.shape[1]:
            whole = padded(batch.column("v"), int(lengths.max()))
            wide = np.pad(references, ((0, 0), (0, whole.shape[1] - references.shape[1])))
            norms, angles = angles_to(whole, wide)
        stored = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * angles.shape[1], pa.int32()), pa.array(angles.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), stored], names=["id", "label", "v", "anchor", "norm", "angles"])


def mine(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    references: int = _REFERENCES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for
    each row that ``is_anchor`` holds for and each of its ``positives`` best rows of the same
    label, the first ``k`` rows of other labels whose score is ``low`` to ``high`` hundredths
    of the positive's. Scores are integer inner products; ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    An anchor's other rows are those of other ids. Equal anchor rows are one anchor; equal
    rows are ranked each. A shorter vector counts as filled up with zeros. A positive without
    negatives in its window, and an anchor without positives, have no row. Labels are whole
    numbers; scores must fit in 64 bits. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    base = whole_vectors(rows, id_col, vector_col, label_col)
    marked = rows.where(F.coalesce(is_anchor, F.lit(False)))
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(1, width)
    sample = base.orderBy(F.xxhash64("id", "label", "v"), "id").limit(max(64, _SAMPLE_COMPONENTS // width)).select("v").collect()
    directions = reference_directions(padded(pa.array([r["v"] for r in sample], pa.list_(pa.int64())), width), references)
    tagged = base.withColumn("anchor", F.lit(False)).union(whole_vectors(marked, id_col, vector_col, label_col).distinct().withColumn("anchor", F.lit(True)))
    stored = tagged.mapInArrow(
        tidy(lambda batches: _measure(batches, directions)), "id long, label long, v array<long>, anchor boolean, norm double, angles array<double>"
    )
    stored = materialize(stored, "angles")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(_LEAST_BLOCK, _COMPONENTS // width)
    blocks = max(1, -(-n // block), min(tasks, n // _LEAST_BLOCK))
    fields = "id", "label", "v", "norm", "angles"
    none = F.array().cast("array<long>")
    dealt = stored.where(~F.col("anchor")).select(
        F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("asks"), *fields, F.lit(0).cast("long").alias("q"), none.alias("positives")
    )
    anchors = stored.where("anchor").select(*fields, F.xxhash64("id", "label", "v").alias("q"))

    def asked(these: DataFrame, answer) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
        both = dealt.union(these.select(every, F.lit(True).alias("asks"), *fields, "q", "positives"))
        sorted_ = both.repartition(tasks, "b").sortWithinPartitions("b", "asks")
        return sorted_.mapInArrow(tidy(lambda batches: _answers(batches, answer)), _FOUND)

    best = asked(anchors.withColumn("positives", none), lambda index, part, w: _positives(index, part, w, positives))
    order = F.row_number().over(Window.partitionBy("anchor", "q").orderBy(F.desc("score"), F.asc("id")))
    best = best.withColumn("rank", order).where(F.col("rank") <= positives)
    lists = best.groupBy("anchor", "q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    lists = materialize(lists, "positives")
    asking = anchors.join(lists.select(F.col("anchor").alias("id"), "q", F.col("found.score").alias("positives")), ["id", "q"])
    near = asked(asking, lambda index, part, w: _negatives(index, part, w, k, low, high))
    order = F.row_number().over(Window.partitionBy("anchor", "q", "which").orderBy(F.desc("score"), F.asc("id")))
    ranked = near.withColumn("rank", order).where(F.col("rank") <= k).join(lists, ["anchor", "q"])
    positive = F.get("found", F.col("which"))
    return ranked.select(
        F.col("anchor").alias("anchor_id"), positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
