"""Token counts under a unigram vocabulary, with one trie for all pre-tokens.

The best segmentation of a pre-token is found from left to right: the best score of a prefix is the best, over
the vocabulary pieces that end it, of the score of what stands before plus the piece's. That only depends on
the prefix, so pre-tokens are inserted in a trie and every node is scored once, however many pre-tokens share
it; the node where a pre-token ends stores its number of tokens. Each task has a trie of its own, of bounded
size, and adds up the counts of its documents; no text leaves its task.

Pieces come from a SentencePiece model file. Such a file of the BPE kind has ranks for scores; a piece of rank r
is given the log-probability -log(r + 10) less a constant, after Zipf's law. A character in no piece is spelt
in byte pieces, at a score below that of all pieces.

A pre-token is a run of characters other than white space with the mark U+2581 before it. Equal scores go to
the segmentation with fewer tokens.

Defined results: a pre-token of any length, as in texts without spaces, is scored whole; a NULL or empty text has no tokens; repeated rows stay repeated; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import gc
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Rows, texts_of, tidy
from .registry import query

MARK = "▁"
#: Nodes of a trie, and words with known counts; what is fuller is thrown away and started anew.
MOST_NODES, MOST_WORDS = 400_000, 1_000_000
#: Prefixes of up to so many characters are shared; what follows in a longer pre-token is scored without being kept,
#: and its count is not kept either.
SHARED_LETTERS = 64


def piece_scores(model: bytes) -> tuple[dict[str, float], float]:
    """Ordinary pieces with their log-probabilities, and that of a byte piece."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 10) for r in range(len(pieces))))
    scores = {p: -math.log(r + 10) - total for r, p in enumerate(pieces)}
    return scores, -math.log(len(pieces) + 10) - total - 10.0


class Trie:
    """A trie of pre-tokens whose nodes hold the best (score, tokens) of their prefix.

    Along with it goes the trie of the pieces: each node also keeps the piece-trie nodes of all pieces that could
    still go on through it, with the score and count of what stands before them.
    """

    def __init__(self, scores: dict[str, float], byte_score: float) -> None:
        # The piece trie: nodes are lists of children by character and the score of the piece that ends there.
        self.pieces: list = [{}, None]
        for piece, value in scores.items():
            at = self.pieces
            for c in piece:
                at = at[0].setdefault(c, [{}, None])
            at[1] = value
        self.byte_score = byte_score
        self.clear()

    def clear(self) -> None:
        self.nodes = 1
        # A node: its children by character, its best score and tokens, the pieces under way.
        self.root: tuple = ({}, 0.0, 0, [(self.pieces[0], 0.0, 0)])

    def _grow(self, parent: tuple, c: str, kept: bool = True) -> tuple:
        under_way, best, tokens = [], -math.inf, 0
        for children, before, n in parent[3]:
            further = children.get(c)
            if further is None:
                continue
            onward, value = further
            if onward:
                under_way.append((onward, before, n))
            if value is not None:
                value += before
                if value > best or (value == best and n + 1 < tokens):
                    best, tokens = value, n + 1
        alone = self.pieces[0].get(c)
        if alone is None or alone[1] is None:  # no piece of its own: spell it
            size = len(c.encode("utf-8", "surrogatepass"))
            value = parent[1] + size * self.byte_score
            if value > best:
                best, tokens = value, parent[2] + size
        under_way.append((self.pieces[0], best, tokens))
        node = ({}, best, tokens, under_way)
        if kept:
            parent[0][c] = node
            self.nodes += 1
        return node

    def tokens(self, pre_token: str) -> int:
        if self.nodes > MOST_NODES:
            self.clear()
        at = self.root
        for c in pre_token[:SHARED_LETTERS]:
            at = at[0].get(c) or self._grow(at, c)
        for c in islice(pre_token, SHARED_LETTERS, None):
            at = self._grow(at, c, kept=False)
        return at[2]


class Counter(dict):
    """Terminal counts: the tokens of a word, looked up in the trie the first time it is seen."""

    def __init__(self, scores: dict[str, float], byte_score: float) -> None:
        self.trie = Trie(scores, byte_score)

    def __missing__(self, word: str) -> int:
        found = self.trie.tokens(MARK + word)
        if len(word) < SHARED_LETTERS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    """One per worker, kept between tasks."""
    return Counter(*piece_scores(model))


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_pre_tokens", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_pre_tokens, n_tokens``."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = counter(shipped.value), Rows(COUNTED)
        # Tries hold no cycles, and walking millions of nodes for cycles would cost more than all the rest.
        gc.disable()
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                    found = list(map(known.__getitem__, text.split()))
                    rows.add((doc_id, len(found), sum(found)))
                    if rows.full():
                        yield rows.take()
            yield from rows.rest()
        finally:
            gc.enable()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, n_pre_tokens bigint, n_tokens bigint")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
