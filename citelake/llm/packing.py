"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces
are dealt at random to partitions of a bounded number of rows; each partition packs by
best-fit decreasing and computes lower bounds of its bin count from dual-feasible
functions. Where the bound meets the count, the packing is proven to be the best and stands.
Partitions with a gap exchange their pieces: these are dealt anew, to fewer and larger
partitions, and packed again. After the last round the rest stands as packed.

Only pieces' sizes move, never texts or ids, and no partition holds more than its share.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.bpe import Coder, loaded
from citelake.llm.common import kept, materialize, tidy

CAPACITY = 2048


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is left
    open_rooms = 0  # bit r: some bin has r left
    made = 0
    for k in order.tolist():
        size = int(sizes[k])
        fit = open_rooms >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            where = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, where = capacity, made
            made += 1
        bins[k], offsets[k] = where, capacity - left
        left -= size
        if left:
            room[left].append(where)
            open_rooms |= 1 << left
    return bins, offsets, made


def lower_bound(sizes: np.ndarray, capacity: int, most_k: int = 32) -> int:
    """The best of two families of dual-feasible functions, over all their parameters.

    f_l: sizes over capacity - l count as full, those under l as nothing. u_k: a size counts
    by its whole (k+1)-ths of the capacity, each worth 1/k, and as itself where it is an
    exact multiple. The sum of either over all items, in capacities, bounds the bins.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, weight = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(weight[-1]) // capacity)
    lows = np.arange(1, capacity // 2 + 1)
    full = count[-1] - count[capacity - lows]
    middle = weight[capacity - lows] - weight[lows - 1]
    best = max(best, int((full + -(-middle // capacity)).max(initial=0)))
    for k in range(1, most_k + 1):
        whole = (k + 1) * size
        # in units of capacity * k, to stay in whole numbers
        value = np.where(whole % capacity == 0, size * k, whole // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)``: each document's ids and its end id."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    last = int(end).to_bytes(4, "little")

    def run(batches):
        coder = kept(("plain coder", spec.value), lambda: Coder(loaded(spec.value)))
        for batch in batches:
            for part in coder.runs(batch.column(1)):
                ids, bounds = part.ids()
                data, bounds = memoryview(ids).cast("B"), bounds.tolist()
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for row, (begin, stop) in enumerate(zip(bounds, bounds[1:]), part.first):
                    total = stop - begin + 1  # and the end id
                    for k, at in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - at)
                        from_, to = begin + at, min(begin + at + length, stop)
                        crc = zlib.crc32(data[4 * from_ : 4 * to])
                        rows.append(row)
                        pieces.append(k)
                        starts.append(at)
                        lengths.append(length)
                        sums.append(crc if to - from_ == length else zlib.crc32(last, crc))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def pack_sizes(pieces: DataFrame, capacity: int = CAPACITY, rows_a_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("_gap", T.BooleanType()),
        ]
    )

    def packer(number):
        def run(batches):
            batches = [b for b in batches if len(b)]
            if not batches:
                return
            table = pa.Table.from_batches(batches)
            sizes = table.column("length").to_numpy()
            bins, offsets, made = best_fit_decreasing(sizes, capacity)
            gap = made > lower_bound(sizes, capacity)
            first = (number << 56) + (TaskContext.get().partitionId() << 26)
            table = table.append_column("sequence_id", pa.array(bins + first))
            table = table.append_column("offset", pa.array(offsets))
            table = table.append_column("_gap", pa.array(np.full(len(table), gap)))
            yield from table.to_batches()

        return run

    done, left, columns = None, pieces, pieces.columns
    for number in range(rounds):
        n = left.count()
        if number and not n:
            break
        parts = max(1, -(-n // (rows_a_partition << number)))
        dealt = left.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(number)))
        packed = materialize(dealt.repartition(parts, "_deal").drop("_deal").mapInArrow(tidy(packer(number)), schema), "packed")
        final = packed if number == rounds - 1 else packed.where("not _gap")
        done = final if done is None else done.union(final)
        left = packed.where("_gap").select(*columns)
    return done.drop("_gap")


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0
) -> DataFrame:
    """One row per piece: ``piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is its end id alone. Repeated rows and null ids are documents of
    their own. Other columns are not read. An empty table gives an empty one.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end), "pieces")
    return pack_sizes(pieces, capacity)
