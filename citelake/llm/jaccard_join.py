"""N-gram Jaccard join: which texts share 90 % of their word shingles.

A text is its set of distinct shingles. Two sets link when
``den * |A & B| >= num * |A | B|`` (num / den = 0.9). Equal sets are one node.

1. *Meeting.* Sets that link share a shingle among the first ``n - ceil(n * num / den) + 1``
   of either, in any order that holds for all sets. The order puts shingles that a sample of
   texts shows to be frequent last, so passages that many texts share bring few together.
   Which are known as frequent (a bounded table) changes speed, never links. A task sends a
   shingle once, however many of its sets have it; the others are in its own entries.
2. *Count-vector R-tree.* A set is a point: its numbers of shingles in hash groups. Over the
   points that met at a shingle stands a tree whose boxes hold coordinate minima and maxima.
   A descent over pairs of boxes keeps a pair only while the summed minima of their maxima,
   an upper bound of any overlap inside, reach the overlap that a link needs; leaves apply
   the bound point by point, on finer groups for large sets. What survives it, as a spanning
   forest, is joined to components, which are as tight as the bound.
3. *Verifying.* A component's sets are dealt to tasks, a large one as pairs of chunks. There
   the tree prunes again, and surviving pairs are verified on the sets. Pairs already
   connected aren't verified again, since components are asked for; what is returned is a
   spanning forest of true links, so its size follows the sets, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import connected_components, discard, join_back, materialize, tidy, with_roots
from citelake.llm.textarrays import mix, slices, words

NUM, DEN = 90, 100
_DIMS = 64
_LEAF = 16
_CHUNK = 1024
_CHUNK_SHINGLES = 1_500_000
_RUN_TOKENS = 1_000_000
_KNOWN = 1 << 18
_BUCKET_SHINGLES = 4_000_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: pa.Array, width: int = 3):
    """The sorted distinct shingle hashes of each text; a text of fewer words than
    ``width`` is one shingle, an empty or null one none."""
    for _, _, raw, at in slices(texts):
        h, n = words(raw, at)
        ends = np.cumsum(n)
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = mix(rolled * _K[1] + h[k : k + len(rolled)] + _K[0])
        for end, count in zip(ends.tolist(), n.tolist(), strict=True):
            first = end - count
            if count >= width:
                yield np.unique(rolled[first : end - width + 1])
            elif count:
                short = np.full(1, _K[2] * np.uint64(1) + np.uint64(count))
                for k in range(count):
                    short = mix(short * _K[1] + h[first + k : first + k + 1] + _K[3])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _set_ids(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, of 64 bits each; sets are equal where both are."""
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)), mix(s + _K[1]).sum(dtype=np.uint64)], np.uint64)
    a, b, c = mix(both + np.uint64(len(s)))[:, None]
    return tuple(int(mix(x).view(np.int64)[0]) for x in (a + b * _K[1], b + c * _K[3]))


def least_overlap(n, num: int, den: int):
    """Elements of a set of size n that a linked one must have."""
    return -(-n * num // den)


def count_vector(s: np.ndarray) -> bytes:
    """Shingles in each of a power of two of groups, 64 at least, up to eight in one on average."""
    groups = max(_DIMS, 1 << (len(s) // 8).bit_length())
    while True:
        counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def most_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The bound of two count vectors; the finer one is folded to the other's groups."""
    d = min(len(a), len(b))
    x, y = (v.reshape(-1, d).sum(0, dtype=np.int64) for v in (a, b))
    return int(np.minimum(x, y).sum())


class Order:
    """Shingles by how frequent they are known to be, then by hash."""

    def __init__(self, content: bytes):
        half = len(content) // 2
        self.known, self.times = np.frombuffer(content[:half], np.uint64), np.frombuffer(content[half:], np.int64)

    def first(self, s: np.ndarray, count: int) -> np.ndarray:
        if not len(self.known):
            return s[:count]
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        rank = np.where(self.known[at] == s, self.times[at], 0)
        return s[np.argsort(rank, kind="stable")[:count]] if rank.any() else s[:count]


def _frequent(docs: DataFrame, text_col: str, width: int) -> bytes:
    """The content of an ``Order``: shingles that two texts or more of one in 32 have, the
    most frequent 262,144 or fewer, as a histogram of their counts says."""

    def count(batches):
        for batch in batches:
            held = list(shingle_sets(batch.column(0), width)) or [np.zeros(0, np.uint64)]
            for start in range(0, len(held), 64):
                h, n = np.unique(np.concatenate(held[start : start + 64]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(32)) == 0).select(text_col)
    counts = some.mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts, "frequent")
    level = F.length(F.bin("n"))
    least, left = 65, _KNOWN
    for row in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect():
        if row["n"] > left:
            break
        least, left = row["l"], left - row["n"]
    found = counts.where(level >= least).toArrow()
    discard(counts)
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order].tobytes() + n[order].astype(np.int64).tobytes()


def _deal(batches, width: int, num: int, den: int, buckets: int, order: Order):
    """First shingles by ranges, ``buckets`` of them, with the sets that they belong to.

    A run of texts sends a shingle once, with the smallest of its sets. If the run has
    several, all are entries already and travel with one of its rows. A set's hash is sent
    once a bucket, a shingle as its low six bytes, the range giving the high ones.
    """
    seen: dict[int, np.ndarray] = {}

    def flush():
        ids = np.array(sorted(seen), np.int64)
        each = [seen[i] for i in ids.tolist()]
        seen.clear()
        own = np.repeat(np.arange(len(ids)), [len(e) for e in each])
        tokens = np.concatenate(each)
        by = np.argsort(tokens, kind="stable")  # within a shingle by set
        tokens, own = tokens[by], own[by]
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        times = np.diff(np.append(first, len(tokens)))
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        several = np.repeat(times > 1, times)
        entries = _named(tokens[several], bucket[several]).tobytes(), ids[own[several]].tobytes()
        tokens, own, bucket = tokens[first], own[first], bucket[first]
        by = np.lexsort((own, bucket))
        tokens, own, bucket = tokens[by], own[by], bucket[by]
        full, at = np.unique(bucket, return_index=True)
        runs = list(zip(at.tolist(), [*at[1:].tolist(), len(tokens)], strict=True))
        sets, times, tails = [], [], []
        for i, j in runs:
            start = np.flatnonzero(np.diff(own[i:j], prepend=-1))
            sets.append(ids[own[i:j][start]].tobytes())
            times.append(np.diff(np.append(start, j - i)).astype(np.uint32).tobytes())
            tails.append(tokens[i:j].view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())
        carrier = int(ids.view(np.uint64).sum() % np.uint64(len(runs)))
        own_entries = [[e if k == carrier else b"" for k in range(len(runs))] for e in entries]
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (sets, times, tails, *own_entries))],
            names=["bucket", "sets", "times", "tails", "own_tokens", "own_sets"],
        )

    total = 0
    for batch in batches:
        for s in shingle_sets(batch.column(0), width):
            if len(s) and (name := _set_ids(s)[0]) not in seen:
                seen[name] = order.first(s, len(s) - least_overlap(len(s), num, den) + 1)
                total += len(seen[name])
                if total >= _RUN_TOKENS:
                    yield flush()
                    total = 0
    if seen:
        yield flush()


def _named(tokens: np.ndarray, bucket) -> np.ndarray:
    """A shingle by its low six bytes and its range."""
    return (tokens & np.uint64((1 << 48) - 1)) + (np.uint64(bucket) << np.uint64(48))


def _meet(batches):
    """Entries ``(token, set_id)`` of the shingles that several sets have."""
    for (bucket,), table in _groups(batches, ("bucket",)):
        ids, tokens, entries = [], [], []
        columns = ([x.as_buffer() for x in table.column(c)] for c in ("sets", "times", "tails", "own_tokens", "own_sets"))
        for sets, times, tails, own_tokens, own_sets in zip(*columns, strict=True):
            wide = np.zeros((len(tails) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(tails, np.uint8).reshape(6, -1).T
            tokens.append(wide.view(np.uint64).ravel())
            ids.append(np.repeat(np.frombuffer(sets, np.int64), np.frombuffer(times, np.uint32)))
            entries.append((np.frombuffer(own_tokens, np.uint64), np.frombuffer(own_sets, np.int64)))
        ids, tokens = np.concatenate(ids), np.concatenate(tokens)
        by = np.argsort(tokens)
        ids, tokens = ids[by], tokens[by]
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        times = np.diff(np.append(first, len(tokens)))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        several = np.repeat(several, times)
        entries.append((_named(tokens[several], bucket), ids[several]))
        for k, v in entries:
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v)], names=["token", "set_id"])


class RTree:
    """Bulk-loaded over count vectors: the points in tree order, and per level the boxes of
    runs of points, each level halving the runs."""

    def __init__(self, points: np.ndarray):
        self.order = self._arrange(points)
        self.points = points[self.order]
        self.levels = []
        n = len(points)
        run = _LEAF
        while True:
            at = np.arange(0, n, run)
            self.levels.append((run, np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at)))
            if run >= n:
                break
            run *= 4

    @staticmethod
    def _arrange(points: np.ndarray) -> np.ndarray:
        """Split at the median of the widest of size and coordinates, down to leaves."""
        out, todo = [], [np.arange(len(points))]
        wide = np.column_stack([points.sum(1), points])
        while todo:
            part = todo.pop()
            if len(part) <= _LEAF:
                out.append(part)
                continue
            values = wide[part]
            axis = int(np.argmax(values.max(0) - values.min(0)))
            half = max(_LEAF, (len(part) // 2 + _LEAF - 1) // _LEAF * _LEAF)
            ranked = part[np.argsort(values[:, axis], kind="stable")]
            todo += [ranked[half:], ranked[:half]]
        return np.concatenate(out)


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def link(points: np.ndarray, sizes: np.ndarray, own: np.ndarray, other: np.ndarray, overlap, num: int = NUM, den: int = DEN):
    """A spanning forest of the links between ``own`` and ``other`` (places in ``points`` and
    ``sizes``; equal arrays: among themselves), where ``overlap`` of two places is asked for
    those that the tree leaves. Second, how many pairs there were, how many the tree left
    and how many were asked for."""
    same = own is other or len(own) == len(other) and bool((own == other).all())
    left = RTree(points[own])
    right = left if same else RTree(points[other])
    a_ids, b_ids = own[left.order], other[right.order]
    parent = list(range(len(points)))
    links = []
    work = [len(own) * (len(own) - 1) // 2 if same else len(own) * len(other), 0, 0]

    def needs(a, b):
        return (a + b) * num  # against overlap * (num + den)

    # descend over pairs of boxes, level by level
    depth = max(len(left.levels), len(right.levels)) - 1
    pairs = np.zeros((1, 2), np.int64)
    for level in range(depth, -1, -1):
        boxes = []
        for tree in (left, right):
            run, low, high = tree.levels[min(level, len(tree.levels) - 1)]
            boxes.append((run, low.sum(1), high))
        kept = []
        for start in range(0, len(pairs), 4096):
            i, j = pairs[start : start + 4096].T
            bound = np.minimum(boxes[0][2][i], boxes[1][2][j]).sum(1)
            ok = bound * (num + den) >= needs(boxes[0][1][i], boxes[1][1][j])
            kept.append(pairs[start : start + 4096][ok])
        pairs = np.concatenate(kept)
        if level and len(pairs):
            grown = []
            for side, tree in enumerate((left, right)):
                here = tree.levels[min(level, len(tree.levels) - 1)][0]
                below = tree.levels[min(level - 1, len(tree.levels) - 1)][0]
                grown.append((here // below, len(tree.levels[min(level - 1, len(tree.levels) - 1)][1])))
            (fa, na), (fb, nb) = grown
            i = (pairs[:, 0, None, None] * fa + np.arange(fa)[:, None]).repeat(fb, 2).reshape(-1)
            j = (pairs[:, 1, None, None] * fb + np.arange(fb)[None, :]).repeat(fa, 1).reshape(-1)
            inside = (i < na) & (j < nb)
            if same:
                inside &= i <= j
            pairs = np.column_stack([i[inside], j[inside]])
    for i, j in pairs.tolist():
        x, y = a_ids[i * _LEAF : (i + 1) * _LEAF], b_ids[j * _LEAF : (j + 1) * _LEAF]
        roots = {_find(parent, k) for k in x.tolist()} | {_find(parent, k) for k in y.tolist()}
        if len(roots) == 1:
            continue
        bound = np.minimum(points[x][:, None], points[y][None]).sum(2)
        ok = bound * (num + den) >= needs(sizes[x][:, None], sizes[y][None])
        for p, q in np.argwhere(ok).tolist():
            a, b = int(x[p]), int(y[q])
            work[1] += 1
            ra, rb = _find(parent, a), _find(parent, b)
            if a == b or ra == rb:
                continue
            work[2] += 1
            if overlap(a, b) * (num + den) >= needs(int(sizes[a]), int(sizes[b])):
                parent[max(ra, rb)] = min(ra, rb)
                links.append((a, b))
    return links, work


def _points(vectors: list[np.ndarray]) -> np.ndarray:
    return np.stack([v.reshape(-1, _DIMS).sum(0, dtype=np.int32) for v in vectors])


def _cells(batches, num: int, den: int, load):
    """Links in each cell (root, x, y) of rows ``(root, x, y, own, node, ...)``; ``load`` gives
    points, sizes and the overlap of a cell's distinct nodes."""
    for (_, x, y), table in _groups(batches, ("root", "x", "y")):
        ids, at = np.unique(table.column("node").to_numpy(), return_index=True)
        side = table.column("own").to_numpy()[at]
        a = np.flatnonzero(side == x)
        b = a if x == y else np.flatnonzero(side == y)
        if len(a) and len(b) and len(ids) > 1:
            found, _ = link(*load(table.take(pa.array(at)), a, b), num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(k)]) for k in zip(*found, strict=True)], names=["a", "b"])


def _by_vectors(rows: pa.Table, a: np.ndarray, b: np.ndarray):
    vectors = [np.frombuffer(v.as_buffer(), np.uint8) for v in rows.column("counts")]
    sizes = rows.column("n").to_numpy()
    return _points(vectors), sizes, a, b, lambda i, j: most_overlap(vectors[i], vectors[j])


def _by_sets(rows: pa.Table, a: np.ndarray, b: np.ndarray):
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
    points = np.stack([np.bincount((s >> np.uint64(20)).astype(np.int64) % _DIMS, minlength=_DIMS) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    return points.astype(np.int32), sizes, a, b, lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))


def _in_cells(rows: DataFrame, chunks: Column, tasks: int, num: int, den: int, load, *columns: str) -> DataFrame:
    """Links ``(a, b)`` among the nodes of each root: a root's rows are dealt to ``chunks``,
    and each pair of chunks is a cell."""
    own = F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")
    dealt = rows.withColumn("_chunks", chunks.cast("int")).withColumn("own", own)
    dealt = dealt.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    x, y = F.least("own", "peer").alias("x"), F.greatest("own", "peer").alias("y")
    dealt = dealt.select("root", x, y, "own", "node", *columns).repartition(tasks, "root", "x", "y")
    return dealt.sortWithinPartitions("root", "x", "y").mapInArrow(tidy(lambda batches: _cells(batches, num, den, load)), "a long, b long")


def _groups(batches, keys: tuple[str, ...]):
    """Runs of equal keys of sorted batches, as tables."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        if not len(batch):
            continue
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *cuts.tolist(), len(batch)]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield last, pa.Table.from_batches(held)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, more: list[str]):
    """Rows with shingles, as ``(id_col, n_shingles, set_id, *more, root, component_id)``, and
    rows without, as ``(id_col, n_shingles, *more)``; ``more`` names long columns of ``docs``."""
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_id", T.LongType()),
            T.StructField("check", T.LongType()),
            T.StructField("counts", T.BinaryType()),
            *(docs.schema[c] for c in more),
        ]
    )

    def sign(batches):
        for batch in batches:
            n, ids, counts = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                ids.append(_set_ids(s) if len(s) else (None, None))
                counts.append(count_vector(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    *(pa.array(x, pa.int64()) for x in list(zip(*ids, strict=True)) or [[], []]),
                    pa.array(counts, pa.binary()),
                    *batch.columns[2:],
                ],
                names=[id_col, "n_shingles", "set_id", "check", "counts", *more],
            )

    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = materialize(docs.select(id_col, text_col, *more).mapInArrow(tidy(sign), schema), "signed")
    members = signed.where("set_id is not null")
    # one row per distinct set, with its first document, and a number
    firsts = members.groupBy("set_id", "check").agg(
        F.min(id_col).alias("first"), F.max("n_shingles").alias("n"), F.max("counts").alias("counts")
    )
    firsts = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "sets")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    buckets = max(tasks, total // _BUCKET_SHINGLES)
    known = spark.sparkContext.broadcast(_frequent(docs, text_col, width))

    def deal(batches):
        yield from _deal(batches, width, num, den, buckets, Order(known.value))

    dealt = docs.select(text_col).mapInArrow(
        tidy(deal), "bucket int, sets binary, times binary, tails binary, own_tokens binary, own_sets binary"
    )
    met = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_meet), "token long, set_id long")
    entries = materialize(met.distinct(), "entries")
    # near copies meet at many shingles: of those with the same sets, one will do
    marks = [F.sum(F.xxhash64("set_id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    alike = entries.groupBy("token").agg(F.count("*").alias("k"), *marks)
    alike = alike.groupBy("k", "s0", "s1").agg(F.min("token").alias("token")).select("token", "k")
    runs = join_back(entries, alike, "token").select("set_id", F.col("token").alias("root"), "k")
    runs = runs.join(firsts.select("set_id", "node", "n", "counts"), "set_id")
    bounded = _in_cells(runs, F.ceil(F.col("k") / _CHUNK), tasks, num, den, _by_vectors, "n", "counts")
    near = with_roots(connected_components(bounded))
    discard(entries)

    # chunks: a component's sets are dealt over as many as keep a task's share small
    placed = firsts.drop("counts").join(near, "node")
    sums = placed.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    placed = join_back(placed, sums, "root")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    picked = placed.select("root", "node", "k", "total", "set_id", "check", "first").join(
        texts, F.col("_id").eqNullSafe(F.col("first"))
    ).select("root", "node", "k", "total", "set_id", "check", "_text")

    def load(batches):
        for batch in batches:
            wanted = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            sets = list(shingle_sets(batch.column(6), width))
            right = [k for k, s in enumerate(sets) if len(s) and _set_ids(s) == wanted[k]]
            kept = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:4], pa.array([sets[k].tobytes() for k in right], pa.binary())],
                names=["root", "node", "k", "total", "shingles"],
            )

    loaded = picked.mapInArrow(tidy(load), "root long, node long, k long, total long, shingles binary")
    # sets are larger than points, so their cells are smaller
    several = F.least(F.lit(16), F.ceil(F.col("k") / 128))
    chunks = F.greatest(several, F.ceil(F.col("k") / _CHUNK), F.ceil(F.col("total") / _CHUNK_SHINGLES))
    links = _in_cells(loaded, chunks, tasks, num, den, _by_sets, "shingles")
    joined = connected_components(links)
    smallest = firsts.join(with_roots(joined), "node", "left").select(
        "set_id", "check", "first", F.coalesce("root", "node").alias("root")
    )
    smallest = materialize(smallest, "classes")
    of_root = smallest.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = join_back(smallest, of_root, "root").select("set_id", "check", "root", "component_id")
    some = members.join(of_set, ["set_id", "check"]).select(id_col, "n_shingles", "set_id", *more, "root", "component_id")
    return some, signed.where("set_id is null").select(id_col, "n_shingles", *more)


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """One row per document: ``n_shingles`` and ``component_id``, the smallest id that links
    reach from it, itself included.

    Null and empty texts have no shingles and are alone, their own component. A component
    whose ids are all null has a null id. Repeated rows and ids are rows of their own; equal
    sets link. Other columns are not read. An empty table gives an empty one.
    """
    some, none = _components(docs, id_col, text_col, width, num, den, [])
    none = none.withColumn("component_id", F.col(id_col))
    return some.select(id_col, "n_shingles", "component_id").union(none.select(id_col, "n_shingles", "component_id"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """One row of each component, all columns: that of the smallest id, then set and text;
    null ids come last. Of rows of equal id and text any one stays. Rows without shingles
    all stay."""
    text = F.xxhash64(text_col)
    some, none = _components(docs.withColumn("_text", text), id_col, text_col, width, num, den, ["_text"])
    # equal rows by their number, so that one component has one candidate for each
    rows = some.groupBy("root", id_col, "set_id", "_text").agg(F.count("*").alias("times"))
    order = F.struct(F.isnull(id_col).alias("last"), F.col(id_col).alias("_head"), "set_id", F.col("_text").alias("_head_text"), "times")
    heads = rows.groupBy("root").agg(F.min(order).alias("h")).select("h._head", "h._head_text", "h.times")
    stay = none.select(F.col(id_col).alias("_head"), F.col("_text").alias("_head_text"), F.lit(1).cast("long").alias("times"))
    heads = materialize(heads.union(stay), "heads")
    same = F.col(id_col).eqNullSafe(F.col("_head")) & (text == F.col("_head_text"))
    once = docs.join(heads.where("times = 1"), same, "left_semi")
    again = docs.join(heads.where("times > 1"), same, "left_semi")
    again = again.withColumn("_text", text).dropDuplicates([id_col, "_text"]).drop("_text")
    return once.union(again)
