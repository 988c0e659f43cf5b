"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie.  A node's failure link leads to where matching goes on once
the longest tokens of its string have been taken off its front, and its pop count is
how many tokens those are; both are computed once, so a word is counted by one pass
over its bytes without building a piece.

Defined results: a null or empty text has no tokens; a byte that no token holds
counts as one token; repeated rows, null and repeated doc_ids give a result for each
row; a very long text is a chunk of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import BYTE_BPE, CHUNK, PreTokens, WordCache, read_vocabulary, token_bytes
from .textvec import chunks, held, map_texts


class LongestMatch:
    """Trie of the tokens with failure links and pop counts."""

    def __init__(self, tokens: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for token in {*tokens, *(bytes([b]) for b in range(256))} - {b""}:
            node = 0
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = self.child[node][b]
            ends[node] = True
        self.fail, self.pops = [0] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, v in self.child[node].items():
                queue.append(v)
                if ends[v]:
                    self.pops[v] = 1  # its whole string is the longest token
                else:
                    at, n = self.fail[node], self.pops[node]
                    while b not in self.child[at]:
                        at, n = self.fail[at], n + self.pops[at]
                    self.fail[v], self.pops[v] = self.child[at][b], n

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = n = 0
        for b in word:
            while b not in child[node]:
                n += pops[node]
                node = fail[node]
            node = child[node][b]
        while node:
            n += pops[node]
            node = fail[node]
        return n


def counter(vocabulary: str) -> WordCache:
    parsed = json.loads(vocabulary)
    special = {t["id"] for t in parsed["added_tokens"]}
    match = LongestMatch(t for i, t in token_bytes(parsed).items() if i not in special)
    return WordCache(lambda words: [[match.count(w.encode())] for w in words])


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """A row for each document: doc_id, n_words (pre-tokens), n_tokens (longest-match pieces of all of them)."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # a file of some MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(("counts", shared.value), lambda: counter(shared.value))
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                words = PreTokens(part.column("text"))
                counts, _ = known.lookup(words)
                total = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])[words.first]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_tokens"])

    return map_texts(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
