"""BPE encoding and decoding with a public word-level vocabulary.

Texts are cut at added tokens, put into NFC and lower case, and split at white space into
chunks, which no pre-token crosses. A chunk is split into words as the tokenizer file's
pre-tokenizer pattern says. A word's ids come from a transducer lexicon of the corpus'
frequent words (``citelake.llm.lexicon``), built once, broadcast (its size is a parameter)
and memory-mapped by each worker; unseen words are merged exactly, pair by pair in rank
order, many words at a time as arrays.

Runs of texts are coded as arrays: chunks are told apart by 64-bit hashes of their bytes,
only distinct ones become strings, and a chunk that a worker has met keeps its ids, up to a
bound.

Tasks need the tokenizer file's content alone, which is broadcast (1.7 MB, fixed).
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections import Counter
from functools import cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import discard, kept, materialize, tidy
from citelake.llm.lexicon import Lexicon, compile_words
from citelake.llm.textarrays import slices, spans

_NONE = 1 << 62
_SHIFT = 20
_LOW = (1 << _SHIFT) - 1
_LONG = 48
CHUNKS_KEPT = 1_000_000
_RUN_BYTES = 1 << 20
#: Unicode White_Space
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: blanks for str.split() that aren't White_Space
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(f"{_SUFFIXES}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")


@cache
def _pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Letters, single numbers and runs of anything else, by Unicode category, for texts of
    characters up to ``last``: short classes match faster."""
    runs = {"L": [], "N": []}
    before = ""
    for code in range(last + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in runs:
            if kind == before:
                runs[kind][-1][1] = code
            else:
                runs[kind].append([code, code])
        before = kind
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k]) for k in "LN")
    return re.compile(f"{_SUFFIXES}|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")


def _pattern_for(text: str) -> re.Pattern:
    if text.isascii():
        return _ASCII
    last = ord(max(text))
    return _pattern(0xFF if last <= 0xFF else 0xFFFF if last <= 0xFFFF else sys.maxunicode)


def byte_characters() -> list[str]:
    """Printable stand-ins for the 256 bytes: themselves where printable, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Bpe:
    """The tokenizer of one file: ``words`` and ``merge`` take a text to ids."""

    def __init__(self, spec: bytes):
        file = json.loads(spec)
        model = file["model"]
        self.vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = self.vocab[a + b]
            self.pairs[self.vocab[a] << _SHIFT | self.vocab[b]] = rank << _SHIFT | joined
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + suffix] for c in chars]
        self.inner_array, self.final_array = np.array(self.inner), np.array(self.final)
        self.pair_keys = np.array(sorted(self.pairs))
        self.pair_values = np.array([self.pairs[k] for k in self.pair_keys.tolist()])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def chunks(self, text: str) -> list[str]:
        """Normalised runs without white space, which are split into words each on its own.
        An added token is a chunk with a blank in front, which no other chunk has."""
        if "<|" not in text or len(parts := self.at_added.split(text)) == 1:
            return self._normal(text)
        out = []
        for k, part in enumerate(parts):
            out += [" " + part] if k % 2 else self._normal(part)
        return out

    @staticmethod
    def _normal(text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # lower case letter by letter: no final sigma
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if _SEPARATORS.search(text):  # blanks for split(), not for the pattern
            return _pattern_for(text).findall(text)
        return text.split()

    @staticmethod
    def words(chunk: str) -> list[str]:
        return [chunk] if chunk[0] == " " else _pattern_for(chunk).findall(chunk)

    def split(self, text: str) -> list[str]:
        """All words of a text."""
        if "<|" not in text and text.isascii():
            return _ASCII.findall(text.lower())
        return [w for chunk in self.chunks(text) for w in self.words(chunk)]

    def merge(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.added[word[1:]]]
        ids = self._bytes(word)
        return self._merge_long(ids) if len(ids) > _LONG else self._merge(ids)

    def _bytes(self, word: str) -> list[int]:
        data = word.encode()
        return [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """``merge`` of many words: those of one length as the rows of an array."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            size = 0 if word[0] == " " else len(word.encode())
            if 1 < size <= _LONG:
                by_size.setdefault(size, []).append(k)
            else:
                out[k] = self.merge(word)
        for size, places in by_size.items():
            if len(places) < 16:
                for k in places:
                    out[k] = self.merge(words[k])
                continue
            raw = np.frombuffer("".join([words[k] for k in places]).encode(), np.uint8).reshape(-1, size)
            ids = np.concatenate([self.inner_array[raw[:, :-1]], self.final_array[raw[:, -1:]]], 1)
            self._merge_rows(ids, np.array(places), out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pair_keys, key := a << _SHIFT | b)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_values[at], _NONE)

    def _merge_rows(self, ids: np.ndarray, places: np.ndarray, out: list[list[int]]) -> None:
        """One merge of each row a turn; rows without a mergeable pair are done."""
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while ranks.shape[1]:
            row = np.arange(len(ids))
            at = ranks.argmin(1)
            best = ranks[row, at]
            if (done := best == _NONE).any():
                for k, values in zip(places[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = values
                ids, ranks, at, best, places = (x[~done] for x in (ids, ranks, at, best, places))
                row = np.arange(len(ids))
            if not len(ids):
                return
            ids[row, at] = best & _LOW
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(ids), -1)
            for side in (at - 1, at):
                has = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                k = side[has]
                ranks[has, k] = self._ranks(ids[has, k], ids[has, k + 1])
        for k, values in zip(places.tolist(), ids.tolist(), strict=True):
            out[k] = values

    def _merge(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) != _NONE:
            k = ranks.index(best)
            ids[k : k + 2] = [best & _LOW]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << _SHIFT | ids[k], _NONE)
            if k < len(ranks):
                ranks[k] = get(ids[k] << _SHIFT | ids[k + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        get = self.pairs.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(v, k, ids[k], ids[k + 1]) for k in range(n - 1) if (v := get(ids[k] << _SHIFT | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            value, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = value & _LOW, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (v := get(ids[k] << _SHIFT | ids[after[k]])) is not None:
                    heapq.heappush(heap, (v, k, ids[k], ids[after[k]]))
            p = before[k]
            if p >= 0 and (v := get(ids[p] << _SHIFT | ids[k])) is not None:
                heapq.heappush(heap, (v, p, ids[p], ids[k]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Run:
    """Texts ``first`` to ``first + len(n_chunks)``: their chunks as places in ``starts`` and
    ``lens``, which say where the ids of each distinct chunk are in ``flat``."""

    def __init__(self, first: int, n_chunks: np.ndarray, places: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray):
        self.first, self.n_chunks, self.places = first, n_chunks, places
        self.starts, self.lens, self.flat = starts, lens, flat

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin and the last one's end."""
        lens = self.lens[self.places]
        ends = np.cumsum(lens)
        shift = np.repeat(self.starts[self.places] - (ends - lens), lens)
        shift += np.arange(len(shift))
        return self.flat[shift], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_chunks)])]


class Pieces:
    """A text for each id, and texts of runs of ids joined by blanks, as Arrow arrays."""

    def __init__(self, texts: dict[int, str]):
        each = [(texts.get(i, "") + " ").encode() for i in range(max(texts, default=0) + 1)]
        self.lens = np.fromiter(map(len, each), np.int32, len(each))
        self.starts = (np.cumsum(self.lens) - self.lens).astype(np.int32)
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each run ``ids[bounds[k]:bounds[k + 1]]``."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.repeat((self.starts[ids] - (ends - lens)).astype(np.int32), lens)
        at += np.arange(len(at), dtype=np.int32)
        cuts = np.concatenate([[0], ends])[bounds]
        full = np.diff(bounds) > 0
        keep = np.ones(len(at), bool)
        keep[cuts[1:][full] - 1] = False  # the blank after a run's last text
        offsets = (cuts - np.concatenate([[0], np.cumsum(full)])).astype(np.int32)
        data = self.flat[at[keep]]
        return pa.StringArray.from_buffers(len(full), pa.py_buffer(offsets), pa.py_buffer(data))


class Coder:
    """Codes texts and remembers the ids of chunks by hash: sorted hashes and flat arrays, a
    few dozen bytes a chunk. A full memory starts anew."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None = None):
        self.bpe, self.lexicon = bpe, lexicon
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def runs(self, texts: pa.Array):
        held, size = [], 0
        for start, stop, raw, at in slices(texts):
            held.append((start, raw, *spans(raw, at)))
            size += len(raw)
            if size >= _RUN_BYTES or stop == len(texts):
                yield self._run(held)
                held, size = [], 0

    def _run(self, held) -> Run:
        hashes = np.concatenate([h for _, _, h, *_ in held])
        uniq, at, places = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CHUNKS_KEPT:
            self._forget()
        where = np.searchsorted(self.hashes, uniq)
        where[where == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[where] != uniq) if len(self.hashes) else np.arange(len(uniq))
        if len(new):
            ends = np.cumsum([len(h) for _, _, h, *_ in held])
            strings = []
            part = np.searchsorted(ends, at[new], "right")
            for k, p in zip(at[new].tolist(), part.tolist(), strict=True):
                _, raw, h, _, first, last = held[p]
                k -= int(ends[p]) - len(h)
                strings.append(raw[first[k] : last[k] + 1].tobytes().decode("utf-8", "replace"))
            self._add(uniq[new], self._code(strings))
        where = np.searchsorted(self.hashes, uniq)
        counts = np.concatenate([n for _, _, _, n, *_ in held])
        return Run(held[0][0], counts, places, self.starts[where], self.lens[where], self.flat)

    def _code(self, chunks: list[str]) -> list[list[int]]:
        bpe = self.bpe
        words = [bpe.split(c) for c in chunks]
        distinct = list(set().union(*words))
        ids = {}
        if self.lexicon is not None:
            ids = {w: found for w in distinct if w[0] != " " and (found := self.lexicon.get(w)) is not None}
            distinct = [w for w in distinct if w not in ids]
        ids.update(zip(distinct, bpe.merge_all(distinct), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in words]

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(lens) - lens
        self.flat = np.concatenate([self.flat, np.fromiter((i for each in ids for i in each), np.uint32, int(lens.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.lens = np.concatenate([self.lens, lens])[order]


def loaded(content: bytes, kind=Bpe):
    return kept((kind.__name__, content), lambda: kind(content))


def frequent_words(docs: DataFrame, spec, text_col: str = "text", size: int = 32_768) -> dict[str, list[int]]:
    """The corpus' most frequent words, about ``size``, with their ids.

    Tasks pass on the count of every chunk between blanks, run by run, so the sums are those
    of the corpus, however it is cut; distinct chunks are split into words. A histogram of
    the counts, 1,024 rows at most, says down to which count the words are taken, and what
    share, by hash, of those that stand on the edge. So the driver gets about ``size`` words,
    whatever the corpus has. Which words the lexicon holds changes speed, never ids.
    """

    def chunks(batches):
        for batch in batches:
            held, size = [], 0
            for _, stop, raw, at in slices(batch.column(0)):
                hashes, _, first, last = spans(raw, at)
                _, place, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((hashes[place], n, _cut_out(raw, first[place], last[place] + 1)))
                size += len(raw)
                if size >= _RUN_BYTES or stop == len(batch):
                    h, n, texts = zip(*held, strict=True)
                    _, place, back = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
                    total = np.bincount(back, np.concatenate(n)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(texts).take(pa.array(place)), pa.array(total)], names=["chunk", "n"]
                    )
                    held, size = [], 0

    def split(batches):
        bpe = loaded(spec.value)
        for batch in batches:
            words: Counter[str] = Counter()
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in bpe.split(chunk):
                    words[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"]
            )

    counts = docs.select(text_col).mapInArrow(tidy(chunks), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = counts.mapInArrow(tidy(split), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    bits = F.length(F.bin("n"))
    level = F.struct(bits.alias("bits"), F.expr("shiftright(n, greatest(length(bin(n)) - 5, 0))").alias("lead"))
    counts = counts.where(~F.startswith("word", F.lit(" "))).withColumn("level", level)
    counts = materialize(counts, "words")
    left, whole, share = size, [], (None, 0)
    for row in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if row["n"] > left:
            share = row["level"], (left << 20) // row["n"]
            break
        whole, left = row["level"], left - row["n"]
    taken = F.lit(False)
    for edge, test in ((whole, F.col("level") >= _level(whole)), (share[0], (F.col("level") == _level(share[0])) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share[1]))):
        if edge:
            taken = taken | test
    top = sorted(r["word"] for r in counts.where(taken).select("word").collect())
    discard(counts)
    return dict(zip(top, Bpe(spec.value).merge_all(top), strict=True))


def _level(row):
    return F.struct(F.lit(row["bits"]).alias("bits"), F.lit(row["lead"]).cast("long").alias("lead")) if row else F.lit(None)


def _cut_out(raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The strings at ``raw[first:stop]``."""
    lens = stop - first
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + lens, lens)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets), pa.py_buffer(raw[at]))


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_size: int = 32_768,
) -> DataFrame:
    """One row ``(id_col, n_tokens, ids, decoded)`` per document; ``ids`` is the decimal ids
    joined by blanks, ``decoded`` the text that they decode to.

    A null or empty text has no ids and decodes to the empty text. Repeated rows and null
    ids are rows of their own; other columns are not read. An empty table gives an empty one.
    """
    sc = docs.sparkSession.sparkContext
    spec = sc.broadcast(Path(tokenizer_path).read_bytes())
    block = sc.broadcast(compile_words(frequent_words(docs, spec, text_col, lexicon_size)))
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.StringType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches):
        bpe = loaded(spec.value)
        coder = kept(("coder", block.value), lambda: Coder(bpe, loaded(block.value, Lexicon)))
        numbers = kept(("numbers", spec.value), lambda: Pieces({i: str(i) for i in bpe.tokens}))
        tokens = kept(("tokens", spec.value), lambda: Pieces(bpe.tokens))
        for batch in batches:
            for part in coder.runs(batch.column(1)):
                ids, bounds = part.ids()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(bounds) - 1),
                        pa.array(np.diff(bounds)),
                        numbers.joined(ids, bounds),
                        tokens.joined(ids, bounds),
                    ],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
