"""The library's ids of words put together, and what it is asked for."""

import pyarrow as pa

from tracewell.llm import token_files
from tracewell.llm.pretokens import WordCache, flat, read_vocabulary

TEXTS = ["", " ", "  two  blanks \n\n lines\t\ttabs ", "it's we'll 'd x're", " é à nbsp　wide", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "12 345 6,7.8 -- ... \U0001f600 \U0001f600\U0001f600", "\x00 \x1f\r\n", " ".join(f"w{k}x{k * k}" for k in range(700))]


class IdsOnly:
    """The library's encoder without the call that makes offsets and word numbers."""

    def __init__(self, tokenizer):
        self.encode_batch_fast = tokenizer.encode_batch_fast


def test_ids_are_the_librarys_and_nothing_else_is_asked_for():
    encoder = token_files.LibraryEncoder(read_vocabulary("byte_bpe_50k.json"))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    encoder.tokenizer = IdsOnly(encoder.tokenizer)
    for _ in range(2):  # the second time from the cache
        ids, to = encoder.encode(pa.array(TEXTS))
        assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == want


def test_cache_takes_lists_or_flat_ones():
    from tracewell.llm.pretokens import PreTokens

    lists = lambda words: [list(w.encode()) for w in words]
    tokens = PreTokens(pa.array(["a bc a", None, " bc d"]))
    for compute in (lists, lambda words: flat(lists(words))):
        cache = WordCache(compute)
        for _ in range(2):
            values, to = cache.lookup(tokens)
            assert bytes(values.tolist()) == b"a bc a bc d"
            assert to.tolist() == [0, 1, 4, 6, 9, 11]
