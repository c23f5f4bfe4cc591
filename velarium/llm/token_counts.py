"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a byte trie with failure links: leaving a node v on a byte it has no child
for pops |F(v)| finished pieces and continues at f(v). Both are closed into dense tables, so
each byte costs one step and no piece is ever built.

Vocabulary: the byte strings of a rank file (base64 token, rank). A leading space marks pieces
that start a word, all others continue one; every single byte is a piece, so no word is
unknown. A word is read as one space followed by its bytes.

Null and empty texts have no words and count 0. Repeated rows are counted each; any other
columns pass through unless they are asked away; clashing output names are replaced. Null
ids are kept; a very long text is a slice of its own, whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import Words, bytes_of, ship, slices, table


def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """next[v, byte], pops[v, byte], ends[v]: state after a byte, pieces finished on the way,
    pieces that remain when a word ends in v."""

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final, depth = [False], [0]
        usable = {t for t in tokens if t and not any(c in b"\t\n\x0b\x0c\r " for c in t[1:])}
        usable |= {bytes([c]) for c in range(256)}
        for t in sorted(usable):
            v = 0
            for c in t:
                w = children[v].get(c)
                if w is None:
                    w = children[v][c] = len(children)
                    children.append({})
                    final.append(False)
                    depth.append(depth[v] + 1)
                v = w
            final[v] = True
        n = len(children)
        parent, by = np.zeros(n, np.int32), np.zeros(n, np.int16)
        for v, kids in enumerate(children):
            for c, w in kids.items():
                parent[w], by[w] = v, c
        final, depth = np.array(final), np.array(depth)
        self.next = np.zeros((n, 256), np.int32)
        self.pops = np.zeros((n, 256), np.uint16)
        fail, popped, self.ends = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for d in range(depth.max() + 1):
            at = np.flatnonzero(depth == d)
            if d:
                u, c = parent[at], by[at]
                here = final[at]
                fail[at] = np.where(here, 0, self.next[fail[u], c])
                popped[at] = np.where(here, 1, popped[u] + self.pops[fail[u], c])
                self.ends[at] = popped[at] + self.ends[fail[at]]
                self.next[at] = self.next[fail[at]]
                self.pops[at] = self.pops[fail[at]] + popped[at, None]
            kids = np.flatnonzero((depth == d + 1))
            self.next[parent[kids], by[kids]] = kids
            self.pops[parent[kids], by[kids]] = 0
        self.next, self.pops = self.next.ravel(), self.pops.ravel()
        self.start = int(self.next[32])

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of each word; all words step together, longest first."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        at, left = offsets[:-1][order], size[order]
        state = np.full(len(order), self.start, np.int64)
        count = np.zeros(len(order), np.int64)
        alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        for step, k in enumerate(alive):
            key = state[:k] * 256 + data[at[:k] + step]
            count[:k] += self.pops[key]
            state[:k] = self.next[key]
        count += self.ends[state]
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One per worker process and vocabulary."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_bytes, n_tokens) for each row of docs; no shuffle."""
    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocab_path)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                words = Words(part)
                index, uniq = words.encoded()
                lengths = auto.lengths(*bytes_of(uniq)) if len(uniq) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(lengths[index])]) if len(index) else np.zeros(1, np.int64)
                n = total[words.bounds[1:]] - total[words.bounds[:-1]]
                size = np.diff(bytes_of(part)[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(words.bounds), pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64())],
                    names=[id_col, "n_words", "n_bytes", "n_tokens"],
                )

    schema = T.StructType([kind, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_bytes", "n_tokens"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
