"""Language-model scores by deleted interpolation.

A bigram model mixes three estimates of a token w after v: c(v,w)/c(v), c(w)/N and
1/(V+1). The mixture weights depend on the bucket of c(v), one bucket per power of two.
Training documents are split: an eighth (by id) is deleted from the counts, and
expectation-maximisation on its bigrams, against the counts of the others, learns the
weights. The scores then use these weights with the counts of all training documents.

Counts cover the whole corpus and are never cut. How they move: each task packs its
documents into blocks of a bounded number of tokens and sends every distinct word and
bigram of a block once, as a 64-bit hash with its count, to the hash's bucket. A bucket
sums the counts and sends each block the totals it asked for. Words and pairs that are in
an eighth of about ``_SAMPLE_BLOCKS`` sampled blocks go another way, for a bucket would get an
entry of theirs from every block of the corpus: each task sums them over all its blocks,
their totals are one small aggregation, and go to every task. The sample bounds their number
(at most eight times the keys of a block) and changes what is sent, never a count. The blocks
and the totals are written to the shared folder; the learning step reads the blocks of
deleted documents alone.

Memory: a task holds one block or one bucket at a time, about 100 bytes for each of its
``block_tokens`` tokens or ``_BUCKET_KEYS`` keys, besides one Arrow batch; a key outside the
sample's adds entries for about an eighth of the blocks at most. Keys travel as
differences, counts in as many bytes as the largest one takes. What is sent is linear in
the corpus: no row is empty, so there are never more rows than keys. Rows get short where
blocks and buckets are both many; larger blocks, for executors that can hold them, keep
them long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import discard, materialize, tidy
from citelake.llm.textarrays import mix, slices, words

KEPT, DELETED, HELD_OUT = 0, 1, 2
_END = np.uint64(0x5851F42D4C957F2D)
_BLOCK_TOKENS = 250_000
_BUCKET_KEYS = 1_000_000
_SAMPLE_BLOCKS, _HOT_SHARE = 64, 8
_TOTALS = "block long, part int, bucket int, kind int, n int, kept binary, every binary, types long"
_SENT = "bucket int, kind int, block long, part int, keys binary, counts binary"
_EVENTS = "cvw long, cv long, cw long, n long"


def held_out(id_col: str):
    """Documents that no count or weight learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def _part(id_col: str):
    deleted = F.crc32(F.concat(F.lit("deleted "), F.col(id_col).cast("string"))) % 8 == 0
    return F.when(held_out(id_col), HELD_OUT).when(deleted, DELETED).otherwise(KEPT)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest takes, by byte planes, which compress."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _unpack(data, n: int) -> np.ndarray:
    width = len(data) // n if n else 1
    planes = np.frombuffer(data, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their differences."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(data) -> np.ndarray:
    return np.cumsum(_unpack(data, len(data) // 8), dtype=np.uint64)


def _cells(table: pa.Table | pa.RecordBatch, column: str) -> list:
    """The buffers of a binary column, not copied."""
    return [x.as_buffer() for x in table.column(column)]


def _encode(batches, block_tokens: int):
    """Blocks of documents of one part: their tokens as places in a sorted word list."""
    id_type = None
    held = {p: ([], [], [], 0) for p in (KEPT, DELETED, HELD_OUT)}
    made = TaskContext.get().partitionId() << 24

    def flush(part):
        nonlocal made
        tokens, ids, lens, _ = held[part]
        held[part] = ([], [], [], 0)
        uniq, at = np.unique(np.concatenate(tokens), return_inverse=True)
        made += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([made], pa.int64()),
                pa.array([part], pa.int32()),
                pa.array([pa.chunked_array(ids).to_pylist()], pa.list_(id_type)),
                pa.array([np.concatenate(lens).tolist()], pa.list_(pa.int64())),
                pa.array([uniq.tobytes()], pa.binary()),
                pa.array([_pack(at)], pa.binary()),
                pa.array([len(at)], pa.int64()),
            ],
            names=["block", "part", "ids", "lens", "uniq", "tokens", "n_tokens"],
        )

    for batch in batches:
        id_type = batch.schema.field(0).type
        parts = batch.column(2).to_numpy(zero_copy_only=False)
        for start, stop, raw, at in slices(batch.column(1)):
            h, n = words(raw, at)
            doc = np.repeat(np.arange(stop - start), n)
            flat = np.full(len(h) + stop - start, _END)
            flat[np.arange(len(h)) + doc] = h
            lens = n + 1
            owner = np.repeat(parts[start:stop], lens)
            for part in held:
                mine = np.flatnonzero(parts[start:stop] == part)
                if len(mine):
                    tokens, ids, sizes, total = held[part]
                    tokens.append(flat[owner == part])
                    ids.append(batch.column(0).take(pa.array(mine + start)))
                    sizes.append(lens[mine])
                    held[part] = (tokens, ids, sizes, total + int(lens[mine].sum()))
                    if held[part][3] >= block_tokens:
                        yield flush(part)
    for part in held:
        if held[part][0]:
            yield flush(part)


class _Block:
    """A block's words and distinct bigrams, each sorted by its 64-bit key."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, row: int = 0):
        self.number, self.part = rows.column("block")[row].as_py(), rows.column("part")[row].as_py()
        self.words = np.frombuffer(rows.column("uniq")[row].as_buffer(), np.uint64)
        self.tokens = _unpack(rows.column("tokens")[row].as_buffer(), rows.column("n_tokens")[row].as_py()).astype(np.int64)
        end = int(np.searchsorted(self.words, _END))
        before = np.concatenate([[end], self.tokens[:-1]])
        codes, self.pair, self.pair_n = np.unique(
            before * len(self.words) + self.tokens, return_inverse=True, return_counts=True
        )
        self.v, self.w = np.divmod(codes, len(self.words))
        keys = mix(self.words[self.v] * np.uint64(0xD6E8FEB86659FD93) + mix(self.words[self.w]))
        self.order = np.argsort(keys)
        self.pair_keys = keys[self.order]

    def in_pair_order(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out


class Hot:
    """Sorted keys of words and of bigrams that many blocks have, with their totals."""

    def __init__(self, keys: list[np.ndarray]):
        self.keys, self.kept, self.every = keys, None, None

    def has(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are hot, and their places among the hot ones."""
        own = self.keys[kind]
        at = np.searchsorted(own, keys)
        found = np.zeros(len(keys), bool)
        if len(own):
            found = own[np.minimum(at, len(own) - 1)] == keys
        return found, at[found]


def _keys_of(batches):
    """Every distinct key of a block."""
    for batch in batches:
        for row in range(len(batch)):
            block = _Block(batch, row)
            for kind, keys in ((0, block.words), (1, block.pair_keys)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64))], names=["kind", "key"])


def find_hot(blocks: DataFrame, n_blocks: int) -> Hot:
    """Keys in at least an eighth, and two, of about ``_SAMPLE_BLOCKS`` blocks."""
    sample = blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks))) < _SAMPLE_BLOCKS)
    least = max(2, min(n_blocks, _SAMPLE_BLOCKS) // _HOT_SHARE)
    many = sample.mapInArrow(tidy(_keys_of), "kind int, key long").groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = many.select("kind", "key").toArrow()
    kinds, keys = found.column("kind").to_numpy(), found.column("key").to_numpy().view(np.uint64)
    return Hot([np.sort(keys[kinds == k]) for k in (0, 1)])


def _hot_counts(batches, hot: Hot):
    """A task's counts of the hot keys."""
    sums = [np.zeros((2, len(k)), np.int64) for k in hot.keys]
    for batch in batches:
        for row in range(len(batch)):
            block = _Block(batch, row)
            word_n = np.bincount(block.tokens, minlength=len(block.words))
            for kind, keys, counts in ((0, block.words, word_n), (1, block.pair_keys, block.pair_n[block.order])):
                found, at = hot.has(kind, keys)
                sums[kind][1, at] += counts[found]
                if block.part == KEPT:
                    sums[kind][0, at] += counts[found]
    for kind, (kept, every) in enumerate(sums):
        some = np.flatnonzero(every)
        columns = np.full(len(some), kind), hot.keys[kind][some].view(np.int64), kept[some], every[some]
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "key", "kept", "every"])


def count_hot(blocks: DataFrame, hot: Hot) -> Hot:
    """``hot`` with its totals: sums of the tasks' sums, of no more tasks than run at once."""
    together = blocks.where(F.col("part") != HELD_OUT).coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    counted = together.mapInArrow(tidy(lambda batches: _hot_counts(batches, hot)), "kind int, key long, kept long, every long")
    sums = counted.groupBy("kind", "key").agg(F.sum("kept").alias("kept"), F.sum("every").alias("every")).toArrow()
    kinds, keys = sums.column("kind").to_numpy(), sums.column("key").to_numpy().view(np.uint64)
    out = Hot(hot.keys)
    out.kept, out.every = ([np.zeros(len(k), np.int64) for k in hot.keys] for _ in range(2))
    for kind in (0, 1):
        mine = kinds == kind
        _, at = hot.has(kind, keys[mine])
        out.kept[kind][at], out.every[kind][at] = sums.column("kept").to_numpy()[mine], sums.column("every").to_numpy()[mine]
    return out


def _send(batches, buckets: int, hot: Hot):
    """Every distinct key of a block that isn't hot with its count, cut by ranges of keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    for batch in batches:
        for row in range(len(batch)):
            block = _Block(batch, row)
            word_n = np.bincount(block.tokens, minlength=len(block.words))
            for kind, keys, counts in ((0, block.words, word_n), (1, block.pair_keys, block.pair_n[block.order])):
                cold = ~hot.has(kind, keys)[0]
                keys, counts = keys[cold], counts[cold]
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                runs = list(zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True))
                counted = block.part != HELD_OUT
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array(np.full(len(full), kind), pa.int32()),
                        pa.array(np.full(len(full), block.number), pa.int64()),
                        pa.array(np.full(len(full), block.part), pa.int32()),
                        pa.array([_pack_keys(keys[i:j]) for i, j in runs], pa.binary()),
                        pa.array([_pack(counts[i:j]) if counted else b"" for i, j in runs], pa.binary()),
                    ],
                    names=["bucket", "kind", "block", "part", "keys", "counts"],
                )


def _sum_up(table: pa.Table) -> pa.Table:
    """Totals of one bucket, as each block listed its keys."""
    parts = table.column("part").to_numpy()
    keys = [_unpack_keys(k) for k in _cells(table, "keys")]
    ends = np.cumsum([0, *map(len, keys)])
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    kept, every = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
    places = [at[i:j] for i, j in zip(ends, ends[1:])]
    for part, place, counts in zip(parts, places, _cells(table, "counts"), strict=True):
        if part != HELD_OUT:
            n = _unpack(counts, len(place))
            every[place] += n  # a block lists a key once
            if part == KEPT:
                kept[place] += n
    types = np.zeros(len(parts), np.int64)
    types[0] = (every > 0).sum()
    return pa.table(
        {
            "block": table.column("block"),
            "part": table.column("part"),
            "bucket": table.column("bucket"),
            "kind": table.column("kind"),
            "n": pa.array(np.diff(ends), pa.int32()),
            "kept": pa.array([_pack(kept[p]) if part == DELETED else b"" for part, p in zip(parts, places, strict=True)], pa.binary()),
            "every": pa.array([_pack(every[p]) for p in places], pa.binary()),
            "types": pa.array(types),
        }
    )


def _totals(block: _Block, table: pa.Table, column: str, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the block's words and of its bigrams: those of hot keys, and the others filled
    in bucket by bucket."""
    out = np.zeros(len(block.words), np.int64), np.zeros(len(block.pair_keys), np.int64)
    cold, filled = [], [0, 0]
    for kind, keys in enumerate((block.words, block.pair_keys)):
        found, at = hot.has(kind, keys)
        out[kind][found] = getattr(hot, column)[kind][at]
        cold.append(np.flatnonzero(~found))
    if not len(table):  # all of its keys are hot
        return out[0], block.in_pair_order(out[1])
    kinds, buckets, lens = (table.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    cells = _cells(table, column)
    for k in np.lexsort((buckets, kinds)).tolist():
        kind, n = kinds[k], int(lens[k])
        out[kind][cold[kind][filled[kind] : filled[kind] + n]] = _unpack(cells[k], n)
        filled[kind] += n
    return out[0], block.in_pair_order(out[1])


def _events(left: pa.Table, right: pa.Table, hot: Hot) -> pa.Table:
    """The deleted bigrams of a block with their counts among the kept documents."""
    if not len(left):
        return pa.table({c: pa.array([], pa.int64()) for c in ("cvw", "cv", "cw", "n")})
    block = _Block(left)
    one, two = _totals(block, right, "kept", hot)
    t = pa.table({"cvw": two, "cv": one[block.v], "cw": one[block.w], "n": block.pair_n.astype(np.int64)})
    return t.group_by(["cvw", "cv", "cw"]).aggregate([("n", "sum")]).rename_columns(["cvw", "cv", "cw", "n"])


def _bucket(cv):
    return F.when(cv > 0, F.length(F.bin(cv))).otherwise(0)


def learn_weights(events: DataFrame, kept_tokens: int, types: int, rounds: int = 20, until: float = 1e-3) -> list:
    """EM for (bigram, unigram, uniform) weights by context bucket, 0 for unseen contexts.

    Each round is one aggregation over the events; 64 rows at most reach the driver. A
    bucket without events takes the weights of the next lower one."""
    start = [(0.0, 0.8, 0.2)] + [(0.4, 0.4, 0.2)] * 63
    if kept_tokens == 0:
        return start
    rows = events.select(
        _bucket(F.col("cv")).alias("b"),
        F.when(F.col("cv") > 0, F.col("cvw") / F.col("cv")).otherwise(0.0).alias("p2"),
        (F.col("cw") / F.lit(kept_tokens)).alias("p1"),
        "n",
    )
    weights = start
    for _ in range(rounds):
        part = [F.get(F.array(*[F.lit(w[k]) for w in weights]), F.col("b")) for k in range(3)]
        terms = [part[0] * F.col("p2"), part[1] * F.col("p1"), part[2] * F.lit(1.0 / (types + 1))]
        split = rows.select("b", "n", *[t.alias(f"t{k}") for k, t in enumerate(terms)])
        total = F.col("t0") + F.col("t1") + F.col("t2")
        sums = split.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"t{k}") / total).alias(f"e{k}") for k in range(3)])
        found = {r["b"]: (r["e0"], r["e1"], r["e2"]) for r in sums.collect()}
        new, last = [], start[0]
        for b in range(64):
            if b in found:
                e = [found[b][0] + (b > 0) * 0.5, found[b][1] + 0.5, found[b][2] + 0.5]
                last = tuple(x / sum(e) for x in e)
            elif b == 1 and 0 in found:
                last = start[1]
            new.append(last)
        moved = max(abs(x - y) for a, c in zip(new, weights, strict=True) for x, y in zip(a, c, strict=True))
        weights = new
        if moved < until:
            break
    return weights


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = _BLOCK_TOKENS,
    bucket_keys: int = _BUCKET_KEYS,
) -> DataFrame:
    """One row per document: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-half unigrams) and ``score``, both log10 probabilities of the text.

    A null or empty text is its end token alone. A null id counts as a training document.
    Repeated rows are scored, and counted, each. Other columns are not read. An empty table
    gives an empty one; with no training document every token costs the uniform share.
    """
    spark = docs.sparkSession
    id_field = docs.schema[id_col]
    rows = docs.select(F.col(id_col), F.col(text_col), _part(id_col).cast("int").alias("part"))
    blocks_schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("ids", T.ArrayType(id_field.dataType)),
            T.StructField("lens", T.ArrayType(T.LongType())),
            T.StructField("uniq", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    blocks = materialize(rows.mapInArrow(tidy(lambda batches: _encode(batches, block_tokens)), blocks_schema), "blocks")
    # the more tokens, the more buckets, so that a bucket's size is bounded too
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("blocks")).collect()
    sizes = {r["part"]: r["n"] for r in parts}
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, sum(sizes.values()) // bucket_keys, 8)
    hot = count_hot(blocks, find_hot(blocks, sum(r["blocks"] for r in parts)))
    sent = blocks.mapInArrow(tidy(lambda batches: _send(batches, buckets, hot)), _SENT)
    totals = materialize(sent.groupBy("bucket", "kind").applyInArrow(_sum_up, _TOTALS), "totals")
    types = (totals.where("kind = 0").agg(F.sum("types")).first()[0] or 0) + int((hot.every[0] > 0).sum())
    kept = sizes.get(KEPT, 0)
    n = kept + sizes.get(DELETED, 0)

    deleted = blocks.where(F.col("part") == DELETED).groupBy("block")
    events = deleted.cogroup(totals.where(F.col("part") == DELETED).groupBy("block")).applyInArrow(lambda left, right: _events(left, right, hot), _EVENTS)
    events = events.groupBy("cvw", "cv", "cw").agg(F.sum("n").alias("n"))
    events = materialize(events, "events")
    weights = np.array(learn_weights(events, kept, types))
    discard(events)

    out_schema = T.StructType(
        [
            id_field,
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        one, two = _totals(block, right, "every", hot)
        cv = one[block.v]
        context = np.frexp(cv.astype(float))[1]  # 0 for a count of 0
        p = weights[context, 0] * two / np.maximum(cv, 1)
        p += weights[context, 1] * one[block.w] / max(n, 1) + weights[context, 2] / (types + 1)
        lens = left.column("lens").combine_chunks().flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        base = np.log10((one + 0.5) / (n + 0.5 * (types + 1)))
        return pa.table(
            [
                left.column("ids").combine_chunks().flatten(),
                pa.array(np.full(len(lens), block.part == HELD_OUT)),
                pa.array(lens),
                pa.array(np.add.reduceat((one > 0).astype(np.int64)[block.tokens], at)),
                pa.array(np.full(len(lens), n, np.int64)),
                pa.array(np.add.reduceat(base[block.tokens], at)),
                pa.array(np.add.reduceat(np.log10(p)[block.pair], at)),
            ],
            names=[f.name for f in out_schema],
        )

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(finish, out_schema)
