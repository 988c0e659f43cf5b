"""Quality rules as a short-circuit cascade.

A rule rejects the documents whose measure lies outside its bounds.  Measures are
computed for all documents of a chunk at once, from one division into words.  Before
the run each rule is timed on a bounded sample, its words found beforehand, and its
rejections there are counted; rules then run by falling rejections per second, each
only on what the rules before it kept (to within an eighth of the documents: fewer are
not worth moving the others together).  The order changes the cost and never the
verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words, so all counts are 0 and ratios
are 0; rules of equal gain run in the order given; repeated rows give repeated equal
results, as do a null or repeated doc_id; a very long text is a chunk of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import RAW_WORDS, U, Words, chunks, fresh_key, grams, map_texts, mix

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 400
SAMPLE_BYTES = 64 << 10  # of a text of the sample


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL = _flags(SYMBOLS.encode())
_NOT_FIRST = (np.arange(256) & 0xC0) == 0x80  # bytes of a character after its first
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_MARK = _flags(b"!?")
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 128)


class Measures:
    """Measures of a chunk of texts, each computed when first asked for."""

    def __init__(self, words: Words):
        self.words = words
        self._known: dict[str, np.ndarray] = {}

    def select(self, keep: np.ndarray) -> Measures:
        """The same of some of the texts; what is known of them stays known."""
        some = Measures(self.words.select(keep))
        some._known = {name: x[keep] for name, x in self._known.items()}
        return some

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, "_" + name)()
        return self._known[name]

    def _count(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[self.words.offsets])

    def _n_words(self) -> np.ndarray:
        return self.words.counts()

    def _word_chars(self) -> np.ndarray:
        return self._count(self.words.inside & ~_NOT_FIRST[self.words.raw])

    def _n_symbols(self) -> np.ndarray:
        return self._count(_SYMBOL[self.words.raw])

    def _n_dup_lines(self) -> np.ndarray:
        raw, offsets = self.words.raw.tobytes(), self.words.offsets.tolist()
        out = np.zeros(len(offsets) - 1, np.int64)
        for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            lines = [line for line in raw[a:b].split(b"\n") if line.strip()]  # of bytes, strip() takes the characters between words
            out[d] = len(lines) - len(set(lines))
        return out

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        document = w.document()
        keys = grams(w.hash, 3)
        at = np.flatnonzero(document[: len(keys)] == document[2:]) if len(keys) else np.zeros(0, np.int64)
        keys = keys[at] ^ mix(document[at].astype(np.uint64) + U(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(document) + 2, bool)
        for k in range(3):
            covered[at[twice] + k] = True
        return np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])

    def _upper_share(self) -> np.ndarray:
        upper = self._count(_UPPER[self.words.raw])
        return upper / np.maximum(upper + self._count(_LOWER[self.words.raw]), 1)

    def _mark_share(self) -> np.ndarray:
        return self._count(_MARK[self.words.raw]) / np.maximum(self["n_words"], 1)

    def _wordless_share(self) -> np.ndarray:
        w = self.words
        total = np.concatenate([[0], np.cumsum(_LETTER[w.raw])])
        bare = total[w.ends] == total[w.starts]
        return np.diff(np.concatenate([[0], np.cumsum(bare)])[w.first]) / np.maximum(self["n_words"], 1)

    def _symbol_share(self) -> np.ndarray:
        return self["n_symbols"] / np.maximum(self["n_words"], 1)

    def _mean_word(self) -> np.ndarray:
        return self["word_chars"] / np.maximum(self["n_words"], 1)

    def _dup_line_share(self) -> np.ndarray:
        lines = self._count(self.words.raw == 10) + 1
        return self["n_dup_lines"] / lines

    def _repeat_share(self) -> np.ndarray:
        return self["n_repeat_words"] / np.maximum(self["n_words"], 1)


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose measure is under `least` or over `most`."""

    name: str
    measure: str
    least: float = float("-inf")
    most: float = float("inf")

    def rejects(self, measures: Measures) -> np.ndarray:
        x = measures[self.measure]
        return (x < self.least) | (x > self.most)


BASE_RULES = (Rule("few words", "n_words", least=50), Rule("repeated words", "repeat_share", most=0.5))
RULES = (
    Rule("symbols", "symbol_share", most=0.2),
    Rule("words without letters", "wordless_share", most=0.3),
    Rule("capitals", "upper_share", most=0.5),
    Rule("marks", "mark_share", most=0.2),
    Rule("word length", "mean_word", least=2, most=20),
    Rule("repeated lines", "dup_line_share", most=0.5),
)


def cascade(measures: Measures, rules: Sequence[Rule]) -> np.ndarray:
    """Number of the rule (in the given order) that rejects each text, or -1; later rules see what is left."""
    verdict = np.full(len(measures.words.offsets) - 1, -1)
    at = np.arange(len(verdict))  # the texts in measures
    for k, rule in enumerate(rules):
        now = verdict[at]
        verdict[at[rule.rejects(measures) & (now < 0)]] = k
        left = verdict[at] < 0
        if not left.any():
            break
        if 8 * left.sum() < 7 * len(left):
            at, measures = at[left], measures.select(left)
    return verdict


def order_rules(documents: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[Rule]:
    """The rules by falling rejections per second, as measured on at most sample_rows documents of at most sample_bytes bytes each."""
    short = documents.select(F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    rows = short.sample(0.2, seed=1).limit(sample_rows).collect()
    if not rows:
        return list(rules)
    words = Words(pa.array([r["text"] for r in rows], pa.large_string()), RAW_WORDS)
    return sorted(rules, key=lambda rule: -_gain(rule, words))


def _gain(rule: Rule, words: Words) -> float:
    began = time.perf_counter()
    rejected = int(rule.rejects(Measures(words)).sum())
    return rejected / (time.perf_counter() - began)


def quality_cascade(
    documents: DataFrame,
    rules: Sequence[Rule] = BASE_RULES + RULES,
    report: Sequence[str] = (),
    first: Sequence[Rule] = (),
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """A row for each document: doc_id, the measures named in report (computed for all documents), kept.

    Rules in `first` go before the ordered ones, where their measures are reported and so cost nothing more.
    """
    ordered, key = [*first, *order_rules(documents, rules, text, sample_rows)], fresh_key()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    report = list(report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                measures = Measures(Words(part.column("text"), RAW_WORDS, key))
                columns = [pa.array(measures[name].astype(np.float64 if name.endswith("share") else np.int64)) for name in report]
                kept = cascade(measures, ordered) < 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(kept)], names=["doc_id", *report, "kept"])

    kinds = "".join(f", {name} {'double' if name.endswith('share') else 'long'}" for name in report)
    return map_texts(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{kinds}, kept boolean")


def base_digest(documents: DataFrame) -> DataFrame:
    """The columns of the query: the base's exact counts and verdict, and the cascade's."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_cascade(documents, RULES, report=counts, first=BASE_RULES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *counts, failed.alias("base_failed"), "kept")
