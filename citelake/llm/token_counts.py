"""Token counts of a unigram segmentation, by trie-shared dynamic programming.

Pre-tokens are words ``[^\\x20\\x09-\\x0D]+`` with a word-start mark in front. Their best
unigram segmentation is a forward recursion over characters, and the score of a prefix
doesn't depend on what follows it. So each worker puts its distinct pre-tokens in a trie,
computes the forward score of a prefix once for all words that share it, and keeps the
token count at each terminal. Words are told apart by 64-bit hashes of their bytes, only new
ones become strings, and a worker keeps terminals' counts across tasks, up to a bound.
Nothing is shuffled: a document's count is the sum over its words' terminals.

The piece table is a file of a public tokenizer. It lists pieces by rank, without
probabilities, so ``zipf_scores`` gives rank r the log probability of 1/(r+1), normalised.
A character that no piece covers costs ``unknown_penalty`` more than the least likely piece
and counts as its UTF-8 bytes (byte fallback). Among segmentations of equal score the one
with fewer tokens counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citelake.llm.common import kept, tidy
from citelake.llm.textarrays import slices, spans

WORD_START = "▁"
WORDS_KEPT = 1_000_000


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model in rank order, control and byte pieces left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
    ]


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    total = math.log(math.fsum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class Trie:
    """Prefixes with their forward scores. ``max_nodes`` bounds the memory: a fuller trie
    starts anew, which costs repeated work but changes no result."""

    def __init__(self, scores: dict[str, float], unknown_penalty: float = 10.0, max_nodes: int = 400_000):
        self.unknown = min(scores.values(), default=0.0) - unknown_penalty
        self.max_nodes = max_nodes
        # pieces from their last character back, to find all that end at a place
        self.back: list[dict[str, int]] = [{}]
        self.piece: list[float | None] = [None]
        for text, score in scores.items():
            state = 0
            for char in reversed(text):
                step = self.back[state].get(char)
                if step is None:
                    step = self.back[state][char] = len(self.back)
                    self.back.append({})
                    self.piece.append(None)
                state = step
            self.piece[state] = score
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def add(self, words: list[str]) -> list[int]:
        """Insert words, their token counts; sorted ones find their shared prefixes warm."""
        child, score, tokens, back, piece = self.child, self.score, self.tokens, self.back, self.piece
        terminals = []
        for word in words:
            text = WORD_START + word
            path, node = [0], 0
            for end, char in enumerate(text):
                step = child.get((node, char))
                if step is None:
                    best, count = score[node] + self.unknown, tokens[node] + len(char.encode("utf-8", "replace"))
                    state, start = 0, end
                    while start >= 0 and (state := back[state].get(text[start])) is not None:
                        if (s := piece[state]) is not None:
                            s += score[path[start]]
                            n = tokens[path[start]] + 1
                            if s > best or s == best and n < count:
                                best, count = s, n
                        start -= 1
                    step = child[node, char] = len(score)
                    score.append(best)
                    tokens.append(count)
                node = step
                path.append(node)
            terminals.append(tokens[node])
            if len(score) > self.max_nodes:
                self.clear()
                child, score, tokens = self.child, self.score, self.tokens
        return terminals


class Counter:
    """Token counts of texts; known words are a sorted array of hashes beside their counts."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, raw, at in slices(texts):
            h, n, first, last = spans(raw, at)
            uniq, where, place = np.unique(h, return_index=True, return_inverse=True)
            if len(self.hashes) > WORDS_KEPT:
                self._forget()
            known = np.searchsorted(self.hashes, uniq)
            new = np.flatnonzero((known == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[known] != uniq))
            strings = [raw[first[k] : last[k] + 1].tobytes().decode("utf-8", "replace") for k in where[new].tolist()]
            order = sorted(range(len(strings)), key=strings.__getitem__)
            found = np.zeros(len(strings), np.int64)
            found[order] = self.trie.add([strings[k] for k in order])
            at_new = np.searchsorted(self.hashes, uniq[new])
            self.hashes = np.insert(self.hashes, at_new, uniq[new])
            self.tokens = np.insert(self.tokens, at_new, found)
            each = self.tokens[np.searchsorted(self.hashes, uniq)][place]
            sums = np.concatenate([[0], np.cumsum(each)])
            bounds = np.concatenate([[0], np.cumsum(n)])
            words.append(n)
            tokens.append(np.diff(sums[bounds]))
        return np.concatenate(words), np.concatenate(tokens)


def token_counts(
    docs: DataFrame,
    pieces: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    unknown_penalty: float = 10.0,
) -> DataFrame:
    """One row ``(id_col, n_words, n_tokens)`` per row of ``docs``.

    Null and empty texts have no words and no tokens. Null or repeated ids, extra columns
    and repeated rows pass through as rows of their own; an empty table gives an empty one.
    ``pieces`` is the tokenizer's vocabulary, of a fixed size, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches):
        mark = repr((unknown_penalty, shared.value)).encode()
        counter = kept(("token counter", mark), lambda: Counter(Trie(zipf_scores(shared.value), unknown_penalty)))
        for batch in batches:
            words, tokens = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(tokens)], names=[id_col, "n_words", "n_tokens"]
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
