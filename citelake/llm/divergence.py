"""How far the sources of a language are from each other, by a minimal-perfect-hash recount.

First pass: each task counts in how many of its documents a term is; the exact sums keep a
language's terms at or above a limit. The kept terms of a language are dealt over shards by
their hash, and each shard gets a minimal perfect hash (levels of bits, each key at the
first level where no other key shares its place; its rank among the set bits is its slot),
with the terms themselves stored in slot order. Second pass: the shards are broadcast,
a bounded number of bytes at a time, each task finds its terms' slots, compares the stored
key, and increments dense slots per (language, source). Slots that aren't zero leave the
task; sums, shares and ranks are DataFrame expressions over them.

Bounds: a task holds a slice of texts, the broadcast shards and ``_CELLS`` dense slots; when
these are full, they leave and start anew. Where the kept terms take more than
``round_bytes``, the documents are read once for each such round. The driver sees one row a
shard and one round's shards. Distances between sources are sums over blocks of slots and
pairs of blocks of sources, so that no task holds a whole language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.common import materialize, tidy
from citelake.llm.textarrays import mix, slices

SCALE = 1_000_000_000
SMOOTH = 5
_SHARD_TERMS = 1 << 16
_ROUND_BYTES = 64 << 20
_CELLS = 1 << 22
_HELD_ROWS = 1 << 20
_SLOT_BLOCK, _SOURCE_BLOCK = 2048, 128
_GAMMA, _LEVELS = 2, 40
#: Letters A-Z, a-z and all bytes of characters beyond ASCII are part of a term.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_arrays(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a slice of texts in order, and the text each is in."""
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = inside & edge[: len(raw)]
    starts[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(starts)
    # terms have all bytes that are inside: without the others they follow each other
    bounds = np.append(np.cumsum(inside)[first] - 1, np.count_nonzero(inside)).astype(np.int32)
    data = _LOWER[raw[inside]]
    terms = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return terms, np.searchsorted(at, first, "right") - 1


def _strings(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column's values and the values."""
    coded = column.cast(pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the task with the term, in bounded runs."""
    held, rows = [], 0
    for batch in batches:
        langs, names = _strings(batch.column("lang"))
        for start, stop, raw, at in slices(batch.column("text")):
            terms, doc = term_arrays(raw, at)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            n = len(coded.dictionary)
            doc, code = np.divmod(np.unique(doc * n + coded.indices.to_numpy()), n)
            pairs, counts = np.unique(langs[start:stop][doc] * n + code, return_counts=True)
            lang, code = np.divmod(pairs, n)
            held.append(pa.table({"lang": names.take(pa.array(lang)), "term": coded.dictionary.take(pa.array(code)), "n": counts}))
            rows += len(counts)
            if rows > _HELD_ROWS:
                held = [_summed(held)]
                rows = len(held[0])
                if rows > _HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()


def _summed(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "term"]).aggregate([("n", "sum")])
    return sums.rename_columns(["lang", "term", "n"]).combine_chunks()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``(lang, term, h)``: terms in at least ``least`` documents of their language."""
    counted = docs.select("lang", "text").mapInArrow(tidy(_document_counts), "lang string, term string, n long")
    many = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return many.select("lang", "term", F.xxhash64("term").alias("h"))


def term_hashes(terms: pa.Array) -> np.ndarray:
    """Spark's ``xxhash64`` of strings."""
    return np.array([xxhash.xxh64_intdigest(t, seed=42) for t in terms.cast(pa.binary()).to_pylist()], np.uint64)


class PerfectHash:
    """Slots 0 to n - 1 for n terms; every other string has none."""

    def __init__(self, sizes: list[int], bits: bytes, keys: pa.Array):
        self.sizes, self.keys = sizes, keys
        self.bits = np.frombuffer(bits, np.uint64)
        ranks = np.cumsum(np.bitwise_count(self.bits).astype(np.int64))
        self.before = ranks - np.bitwise_count(self.bits)
        placed = int(ranks[-1]) if len(ranks) else 0
        self.rest = {k: placed + i for i, k in enumerate(keys.slice(placed).to_pylist())}

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        turned = hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(turned) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, terms: pa.Array, hashes: np.ndarray) -> tuple[list[int], bytes, pa.Array]:
        """Sizes of the levels in bits, the bits, and the terms in slot order. Terms that no
        level tells apart (equal 64-bit hashes) come last and are looked up by themselves."""
        open_, sizes, words, order = np.arange(len(terms)), [], [], []
        for level in range(_LEVELS):
            if not len(open_):
                break
            size = -(-_GAMMA * len(open_) // 64) * 64
            at = cls.place(hashes[open_], level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            order.append(open_[alone][np.argsort(at[alone])])
            open_ = open_[~alone]
        order = np.concatenate([*order, open_]).astype(np.int64)
        return sizes, np.concatenate([np.zeros(0, np.uint64), *words]).tobytes(), terms.take(pa.array(order))

    def slots(self, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The terms' slots, -1 for those whose stored key is another."""
        out = np.full(len(terms), -1)
        open_, base = np.arange(len(terms)), 0
        for level, size in enumerate(self.sizes):
            at = self.place(hashes[open_], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_, base = open_[~hit], base + size // 64
        found = np.flatnonzero(out >= 0)
        if len(found):
            same = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found)))
            out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        if self.rest:
            for k in np.flatnonzero(out < 0).tolist():
                out[k] = self.rest.get(terms[k].as_py(), -1)
        return out


def _build(table: pa.Table) -> pa.Table:
    terms = table.column("term").combine_chunks()
    order = pc.sort_indices(terms)  # so that a rerun gives the same slots
    terms, hashes = terms.take(order), table.column("h").combine_chunks().take(order).to_numpy().view(np.uint64)
    sizes, bits, keys = PerfectHash.build(terms, hashes)
    one = {"lang": table.column("lang")[:1], "shard": table.column("shard")[:1]}
    return pa.table(one | {"n": [len(keys)], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([keys.to_pylist()], pa.list_(pa.string()))})


def perfect_hashes(terms: DataFrame) -> DataFrame:
    """One row a shard: ``lang, shard, n, sizes, bits, keys`` and ``base``, the slots of the
    language before it. A shard has about ``_SHARD_TERMS`` terms."""
    shards = terms.groupBy("lang").agg(F.ceil(F.count("*") / _SHARD_TERMS).alias("shards"))
    dealt = terms.join(shards, "lang").select("lang", F.pmod("h", "shards").cast("long").alias("shard"), "term", "h")
    schema = "lang string, shard long, n long, sizes array<long>, bits binary, keys array<string>"
    built = materialize(dealt.groupBy("lang", "shard").applyInArrow(_build, schema), "shards")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = built.select("lang", "shard", "n").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return built.join(bases.select("lang", "shard", "base"), ["lang", "shard"])


class _Lookup:
    """The broadcast shards of one round, by language; slots count from the round's first."""

    def __init__(self, rows):
        self.shards: dict[str, dict[int, tuple[PerfectHash, int, int]]] = {}
        self.width: dict[str, int] = {}
        self.modulus: dict[str, int] = {}
        for r in rows:
            of = self.shards.setdefault(r["lang"], {})
            start = self.width.get(r["lang"], 0)
            of[r["shard"]] = PerfectHash(r["sizes"], bytes(r["bits"]), pa.array(r["keys"], pa.string())), start, r["base"]
            self.width[r["lang"]] = start + r["n"]
            self.modulus[r["lang"]] = r["shards"]

    def slots(self, lang: str, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), -1)
        shard = hashes.view(np.int64) % self.modulus[lang]
        for k, (table, start, _) in self.shards[lang].items():
            mine = np.flatnonzero(shard == k)
            found = table.slots(terms.take(pa.array(mine)), hashes[mine])
            out[mine] = np.where(found >= 0, found + start, -1)
        return out

    def numbers(self, lang: str) -> np.ndarray:
        """Slots of the language for those of the round."""
        parts = [np.arange(len(t.keys)) + base for t, _, base in self.shards[lang].values()]
        return np.concatenate(parts)


class _Dense:
    """Counts per (language, source) and slot."""

    def __init__(self, lookup: _Lookup):
        self.lookup, self.rows, self.cells = lookup, {}, 0

    def add(self, lang: str, source: str, slots: np.ndarray) -> None:
        if (lang, source) not in self.rows:
            self.rows[lang, source] = np.zeros(self.lookup.width[lang], np.int64)
            self.cells += self.lookup.width[lang]
        np.add.at(self.rows[lang, source], slots, 1)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.rows.items():
            at = np.flatnonzero(counts)
            if len(at):
                columns = pa.repeat(pa.scalar(lang, pa.string()), len(at)), pa.repeat(pa.scalar(source, pa.string()), len(at))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(self.lookup.numbers(lang)[at]), pa.array(counts[at])], names=["lang", "source", "slot", "n"])
        self.rows, self.cells = {}, 0


def _recount(batches: Iterator[pa.RecordBatch], lookup: _Lookup) -> Iterator[pa.RecordBatch]:
    dense = _Dense(lookup)
    for batch in batches:
        langs, names = _strings(batch.column("lang"))
        sources, hosts = _strings(batch.column("source"))
        names, hosts = names.to_pylist(), hosts.to_pylist()
        for start, stop, raw, at in slices(batch.column("text")):
            terms, doc = term_arrays(raw, at)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            code, hashes = coded.indices.to_numpy(), term_hashes(coded.dictionary)
            lang, source = langs[start:stop][doc], sources[start:stop][doc]
            for x in np.unique(lang).tolist():
                if names[x] not in lookup.shards:
                    continue
                mine = np.flatnonzero(lang == x)
                used, place = np.unique(code[mine], return_inverse=True)
                slots = lookup.slots(names[x], coded.dictionary.take(pa.array(used)), hashes[used])[place]
                mine, slots = mine[slots >= 0], slots[slots >= 0]
                order = np.argsort(source[mine], kind="stable")
                groups, starts = np.unique(source[mine][order], return_index=True)
                for y, run in zip(groups.tolist(), np.split(slots[order], starts[1:]), strict=True):
                    dense.add(names[x], hosts[y], run)
                    if dense.cells > _CELLS:
                        yield from dense.flush()
    yield from dense.flush()


def recount(docs: DataFrame, hashes: DataFrame, round_bytes: int = _ROUND_BYTES) -> DataFrame:
    """``(lang, source, slot, n)`` of the counts that aren't zero, in rounds of broadcast
    shards of ``round_bytes`` together, or of one shard."""
    spark = docs.sparkSession
    size = F.length("bits") + F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 4)
    shards = hashes.select("lang", "shard", size.alias("bytes")).orderBy("lang", "shard").collect()
    rounds, total = [[]], 0
    for s in shards:
        if rounds[-1] and total + s["bytes"] > round_bytes:
            rounds.append([])
            total = 0
        rounds[-1].append((s["lang"], s["shard"]))
        total += s["bytes"]
    last = {s["lang"]: s["shard"] + 1 for s in shards}
    found = None
    for own in rounds:
        wanted = spark.createDataFrame(own, "lang string, shard long")
        rows = [r.asDict() | {"shards": last[r["lang"]]} for r in hashes.join(F.broadcast(wanted), ["lang", "shard"]).orderBy("lang", "shard").collect()]
        table = spark.sparkContext.broadcast(_Lookup(rows))
        part = docs.select("lang", "source", "text").mapInArrow(
            tidy(lambda batches, table=table: _recount(batches, table.value)), "lang string, source string, slot long, n long"
        )
        found = part if found is None else found.union(part)
    return found.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def _distances(table: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block of slots, for pairs of sources of one pair of blocks."""
    name, sides = table.column("source").combine_chunks().dictionary_encode(), table.column("side").to_numpy()
    code, at, p = name.indices.to_numpy(), table.column("at").to_numpy(), table.column("p").to_numpy()
    marks = np.flatnonzero(at < 0)
    width = table.column("width")[int(marks[0])].as_py()
    shares = np.zeros((len(name.dictionary), width), np.int64)
    shares[code[marks]] = p[marks][:, None]
    counted = np.flatnonzero(at >= 0)
    shares[code[counted], at[counted]] = p[counted]
    side = np.zeros(len(name.dictionary), np.int64)
    side[code] = sides
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
    one, two, value = [], [], []
    for k, a in enumerate(left.tolist()):
        others = left[k + 1 :] if x == y else right
        one.append(np.full(len(others), a))
        two.append(others)
        value.append(np.abs(shares[others] - shares[a]).sum(1))
    one, two, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (one, two, value))
    lang = pa.repeat(table.column("lang")[0], len(value))
    return pa.table({"lang": lang, "a": name.dictionary.take(pa.array(one)), "b": name.dictionary.take(pa.array(two)), "value": value})


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: distance of each two sources of a language."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / _SOURCE_BLOCK).alias("sides"))
    side = F.pmod(F.xxhash64("source"), F.col("sides")).cast("long")
    groups = groups.join(blocks, "lang").withColumn("side", side)
    last = F.greatest(F.lit(0), F.ceil(F.col("terms") / _SLOT_BLOCK) - 1)
    ours = "lang", "source", "side", "sides"
    marks = groups.select(*ours, "terms", F.coalesce("zero", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    width = F.least(F.lit(_SLOT_BLOCK), F.col("terms") - F.col("block") * _SLOT_BLOCK)
    marks = marks.select(*ours, "block", F.lit(-1).alias("at"), "p", width.cast("int").alias("width"))
    block = F.expr(f"slot div {_SLOT_BLOCK}")
    rows = counts.join(groups.select(*ours), ["lang", "source"])
    rows = rows.select(*ours, block.alias("block"), (F.col("slot") % _SLOT_BLOCK).cast("int").alias("at"), "p", F.lit(0).alias("width"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    both = marks.union(rows).withColumn("other", other)
    both = both.select("lang", "source", "side", "block", "at", "p", "width", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
    parts = both.groupBy("lang", "block", "x", "y").applyInArrow(_distances, "lang string, a string, b string, value long")
    # rows of a block come in any order, so which of two sources of one side is first differs from block to block
    sums = parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    return sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, least: int = 30, top: int = 50, round_bytes: int = _ROUND_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``. Part ``pair``: each other source of the
    language, by falling distance; part ``term``: the ``top`` terms that the source has in a
    larger share than its language. Shares are whole billionths, smoothed, all exact.

    Null texts, languages and sources count as ''. Repeated rows count each. A group without
    terms, or a language of which no term is kept, still has its pairs (value 0 for the
    latter). Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    hashes = materialize(perfect_hashes(materialize(kept_terms(docs, least), "terms")), "hashes")
    counts = materialize(recount(docs, hashes, round_bytes), "counts")
    sizes = hashes.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["terms", "total"])
    zero = F.when(F.col("terms") > 0, _share("0", "total", "terms"))
    groups = materialize(groups.withColumn("zero", zero), "groups")

    shared = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    shared = shared.select("lang", "source", "slot", _share("n", "total", "terms").alias("p"))
    pairs = _pairs(shared, groups)

    of_lang = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    own = of_lang.join(lang_total, "lang").select("lang", "slot", _share("n", "total", "terms").alias("q"))
    names = hashes.select("lang", "base", F.posexplode("keys").alias("at", "term")).select("lang", (F.col("base") + F.col("at")).alias("slot"), "term")
    terms = shared.join(own.join(names, ["lang", "slot"]), ["lang", "slot"]).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [
        rows.withColumn("rank", F.row_number().over(order)).where(upto).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        for part, rows, upto in (("pair", pairs, F.lit(True)), ("term", terms, F.col("rank") <= top))
    ]
    return ranked[0].union(ranked[1])
