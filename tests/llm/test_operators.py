"""Every operator against brute force on odd documents, and on none."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, near_dedup, quality, resharding, secret_scan, substring_dedup, textvec, token_counts, token_files
from tracewell.llm.components import connected_components
from tracewell.llm.pretokens import PreTokens, read_vocabulary, token_bytes

VOCABULARY = "byte_bpe_50k.json"


def got(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


def expected(values):
    return sorted(values, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(read_vocabulary(VOCABULARY))


def test_quality(docs, rows, empty):
    found = quality.base_digest(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(found, "doc_id", *counts) == expected((i, *brute.quality(t)) for i, t, *_ in rows)
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert not any(kept[i] for i, t, *_ in rows if t and t.startswith(("###", "Und ")))
    assert quality.base_digest(empty).count() == 0


def test_rule_order_changes_no_verdict(rows):
    column = pa.array([t for _, t, *_ in rows], pa.string())
    rules = quality.BASE_RULES + quality.RULES
    measures = lambda: quality.Measures(textvec.Words(column, textvec.RAW_WORDS))
    alone = [rule.rejects(measures()) for rule in rules]
    assert ((quality.cascade(measures(), rules) < 0) == ~np.any(alone, axis=0)).all()
    assert ((quality.cascade(measures(), rules[::-1]) < 0) == ~np.any(alone, axis=0)).all()


def test_secrets(docs, rows, empty):
    found = secret_scan.digest(docs)
    want = []
    for i, t, *_ in rows:
        spans = brute.secrets(t)
        n = Counter(k for k, _, _ in spans)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(brute.joined(spans).encode()).hexdigest()))
    assert got(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected(want)
    spans = {r["doc_id"]: set(r["spans"].split(",")) for r in found.collect()}
    assert all(set(brute.joined(brute.secrets(t)).split(",")) - {""} <= spans[i] for i, t, *_ in rows)
    random = {r["doc_id"]: r["spans"] for r in found.collect() if "random" in r["spans"]}
    assert [t for i, t, *_ in rows if i in random] == [t for _, t, *_ in rows if t and "9fK3x" in t]
    assert secret_scan.digest(empty).count() == 0


def test_secret_thresholds_and_redaction(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(letters, 40)) for _ in range(200)]
    names = [f"getUserName{k}FromHttpServletRequestHandlerFactory" for k in range(200)]
    frame = spark.createDataFrame([(k, f"a {key} b {name} c") for k, (key, name) in enumerate(zip(keys, names, strict=True))], "doc_id long, text string")
    found = secret_scan.with_spans(frame, secret_scan.thresholds(frame))
    texts = [r[0] for r in found.select(secret_scan.redacted(found.text, found.spans)).collect()]
    assert sum("[secret]" in t for t in texts) >= 190
    assert sum("getUserName" in t for t in texts) >= 190


def test_token_files(spark, docs, rows, empty, tokenizer, tmp_path):
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    want, start = [], 0
    for i, *_ in sorted(rows, key=lambda r: r[0]):
        want.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    assert got(token_files.through_files(docs), "doc_id", "start", "n_tokens", "ids_crc32") == expected(want)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, parts=2)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, path).collect()} == ids
    import pyarrow.parquet as pq

    column = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0).column(4)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index
    assert token_files.through_files(empty).count() == 0


def test_language(docs, rows, empty, spark):
    en, fr = "the and then thing with that is of", "le la que nous avec dans être été"
    rng = np.random.default_rng(1)
    learn = [(k, " ".join(rng.choice((en if k % 2 else fr).split(), 12)), "en" if k % 2 else "fr") for k in range(200)]
    found = langid.cross_checked(spark.createDataFrame(learn, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in learn}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in held)
    odd = {r["doc_id"]: r for r in langid.cross_checked(docs).collect()}
    assert len(odd) == len({i for i, *_ in rows})
    for i, t, *_ in rows:
        bare = not any(c.isalpha() for c in t or "")
        assert (odd[i]["lang_pred"] == "und") == bare and (not bare or odd[i]["score"] == 0)
    assert langid.cross_checked(empty).count() == 0


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8).copy()
    data[data == 0] = 255
    return int(textvec.hash_ranges(data, np.array([0]), np.array([len(data)]))[0])


def test_substring_dedup(docs, rows, empty):
    want = brute.repeats({i: t for i, t, *_ in rows}, 14, word_hash)
    found = {r["doc_id"]: r for r in substring_dedup.digest(docs).collect()}
    assert {i: r["removed"] for i, r in found.items()} == {i: ",".join(f"{a}:{b}" for a, b in x) for i, x in want.items()}
    assert substring_dedup.digest(docs).count() == len(rows) and substring_dedup.digest(empty).count() == 0


def test_substring_removal(spark):
    frame = spark.createDataFrame([("añb cde f", [(1, 3), (5, 7)]), ("xy", [])], "t string, r array<struct<start:int,end:int>>")
    assert [r[0] for r in frame.select(substring_dedup.without(frame.t, frame.r)).collect()] == ["a c f", "xy"]


@pytest.mark.parametrize(("n", "threshold"), [(3, "0.85"), (5, "0.8")])
def test_near_duplicates(docs, rows, empty, n, threshold):
    limit = Fraction(threshold)
    component, sets = brute.components({i: t for i, t, *_ in rows}, n, limit.numerator, limit.denominator)
    found = near_dedup.near_duplicates(docs, n, threshold)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == expected((i, len(sets[i]), component[i], component[i] == i) for i, *_ in rows)
    assert near_dedup.near_duplicates(empty, n, threshold).count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """A family of copies of copies: blocks of four make groups of many blocks, whose links must all be found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng, base = np.random.default_rng(5), [f"w{k}" for k in range(150)]
    family = [list(base)]
    for k in range(60):
        copy = list(family[rng.integers(len(family))])
        for place in rng.integers(0, 150, 3):
            copy[place] = f"e{k}x{place}"
        family.append(copy)
    texts = {i: " ".join(t) for i, t in enumerate(family)}
    component, _ = brute.components(texts, 3, 85, 100)
    found = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, "0.85")
    assert got(found, "doc_id", "component_id") == expected(component.items())


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for size in (8, 50, 400, 5000):
        errors = []
        for _ in range(20):
            h = rng.integers(0, 2**64 - 1, size + size // 8 * 2, dtype=np.uint64)
            a, b = np.sort(h[: size + size // 8]), np.sort(h[size // 8 :])
            r = near_dedup.sketch([a, b])
            assert (r > 0).all()
            errors.append(near_dedup.estimate((r[0] == r[1]).sum()) - size / (size + size // 8 * 2))
        assert abs(np.mean(errors)) < 0.08


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got_ = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got_ == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_token_counts(docs, rows, empty):
    import json

    tokens = token_bytes(json.loads(read_vocabulary(VOCABULARY)))
    known = {t for i, t in tokens.items() if i != 50256}

    def greedy(word):
        n = 0
        while word:
            length = next(k for k in range(len(word), 0, -1) if word[:k] in known or k == 1)
            word, n = word[length:], n + 1
        return n

    want = []
    for i, t, *_ in rows:
        words = PreTokens(pa.array([t or ""]))
        parts = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
        assert b"".join(parts).decode() == (t or "")
        want.append((i, len(parts), sum(map(greedy, parts))))
    assert got(token_counts.token_counts(docs), "doc_id", "n_words", "n_tokens") == expected(want)
    assert token_counts.token_counts(empty).count() == 0


def test_longest_match_without_whole_words():
    match = token_counts.LongestMatch([b"abc", b"abcde", b"cd", b"dx"])
    assert [match.count(w) for w in (b"abcd", b"abcdx", b"abcde", b"bcdx", b"")] == [2, 2, 1, 3, 0]


def test_resharding_plan_uses_every_byte():
    files = [resharding.File(k % 3, f"f{k}", 7 + k % 5, 3) for k in range(20)] + [resharding.File(6, "g", 100, 1)]
    done = resharding.plan(files, 4)
    assert sorted([f.name for f in done.stay] + [f.name for f, _ in done.move] + [f.name for f, _ in done.cut]) == sorted(f.name for f in files)
    total = Counter()
    for to, size in [(f.shard, f.size) for f in done.stay] + [(to, f.size) for f, to in done.move] + [x for _, parts in done.cut for x in parts]:
        total[to] += size
    assert [total[j] for j in range(4)] == resharding.equal_capacities(sum(f.size for f in files), 4)
    assert resharding.plan([], 4).stay == []


def test_resharding(docs, rows, empty):
    found = resharding.digest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in found)
    assert all(abs(sizes[s] - sum(sizes.values()) / 8) <= largest for s in range(8))
    assert resharding.digest(empty).count() == 0


def test_resharding_moves_the_least(spark, tmp_path):
    """Bytes that leave their shards, against the least that any assignment of these sizes moves; files of what stays are not written again."""
    rng = np.random.default_rng(8)
    rows = [(None if k % 50 == 0 else k % 700, "é" * int(rng.integers(0, 60)) + "x" * int(k == 5) * 400, f"s{min(int(rng.geometric(0.4)), 6)}") for k in range(3000)]
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12)
    old = {f"s{k}": k % 5 for k in range(1, 7)}
    shard = F.element_at(F.create_map(*[F.lit(x) for pair in old.items() for x in pair]), F.col("source"))
    path, new = str(tmp_path / "old"), str(tmp_path / "new")
    resharding.write_layout(frame.withColumn("doc_id", F.concat_ws("|", "doc_id", "source")), path, shard)
    before = {f.name: (tmp_path / "old" / f.name).read_bytes() for f in resharding.files_of(spark, path)}
    done, manifest = resharding.reshard(spark, path, new, shards=4, doc_id_type="string")
    found = resharding.read_shards(manifest, "string").collect()
    size = lambda t: len(t.encode()) + 1
    assert Counter((r["doc_id"].rpartition("|")[2], r["text"], r["size"]) for r in found) == Counter((s, t, size(t)) for _, t, s in rows)
    supply, after = Counter(), Counter()
    for _, t, s in rows:
        supply[old[s]] += size(t)
    for r in found:
        after[r["shard"]] += r["size"]
    capacity = resharding.equal_capacities(sum(supply.values()), 4)
    assert all(abs(after[j] - capacity[j]) <= 20 for j in range(4))
    least = sum(max(0, supply[i] - (capacity[i] if i < 4 else 0)) for i in range(5))
    moved = sum(r["size"] for r in found if old[r["doc_id"].rpartition("|")[2]] != r["shard"])
    assert abs(moved - least) <= 50
    assert done.stay and done.move and done.cut and len(done.cut) < 4 * 5
    assert all((tmp_path / "old" / name).read_bytes() == content for name, content in before.items())
    assert {r["name"] for r in manifest.collect() if r["folder"] == path} == {f.name for f in done.stay}
    rewritten = sum(f.stat().st_size for f in (tmp_path / "new").rglob("*.parquet"))
    assert rewritten < sum(map(len, before.values())) * 0.75
    for j in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == j) == list(range(sum(r["shard"] == j for r in found)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=4), st.integers(1, 4))
def test_flow_moves_the_least(supply, shards):
    capacity = resharding.equal_capacities(sum(supply), shards)
    flow = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
    stays = sum(flow[i][i] for i in range(min(len(supply), shards)))
    assert stays == sum(min(s, c) for s, c in zip(supply, capacity, strict=False))


def test_bpe(docs, rows, empty, tokenizer):
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert got(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)
    assert bpe.round_trip(empty).count() == 0
    assert got(bpe.decode(bpe.encode(docs)), "doc_id", "text") == expected((i, t or "") for i, t, *_ in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\n\tstmdrevl129._-é中　 "), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_bpe_of_any_text(tokenizer, texts):
    codec = bpe.codec(read_vocabulary(VOCABULARY))
    ids, to = codec.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[to[k] : to[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_word_cache_forgets_and_still_answers():
    from tracewell.llm.pretokens import WordCache

    cache = WordCache(lambda words: [[len(w)] for w in words], most=10)
    for k in range(30):
        tokens = PreTokens(pa.array([f" common w{k} x{k * 7}"]))
        values, _ = cache.lookup(tokens)
        assert values.tolist() == (tokens.ends - tokens.starts).tolist()
    assert len(cache.slot) < 30


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 300])
def test_decontamination(spark, docs, rows, empty, block_bytes):
    texts = [t for _, t, *_ in rows]
    long = next(t for t in texts if t and len(brute.alnum(t)) > 200)
    w = brute.alnum(long)
    items = [(1, " ".join(w[20:45])), (2, " ".join(w[40:50])), (3, "one two three"), (4, None), (5, "!!"), (10, " ".join(w[5:16]).upper()), (6, "never anywhere to be seen at all in these ten words"), (2, " ".join(w[60:72])), (None, "12 34")]
    items += [(100 + k, " ".join(w[k : k + 12])) for k in range(100, 160, 20)]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id long")
    found = decontam.digest(decontam.decontaminate(docs, bench, block_bytes=block_bytes))
    want = brute.contamination(texts, items)
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == expected((r[0], *x) for r, x in zip(rows, want, strict=True))
    assert decontam.digest(decontam.decontaminate(empty, bench)).count() == 0
    assert got(decontam.digest(decontam.decontaminate(docs, bench.where("false"))), "n_hit") == [(0,)] * len(rows)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 60])
def test_clean_judges_each_row_where_it_is(spark, docs, rows, empty, block_bytes):
    """Null and repeated doc_ids with different texts; items that repeat each other; columns as they were."""
    words = [f"w{k}" for k in range(30)]
    texts = [(None, " ".join(words)), (None, "fine"), (7, "x " + " ".join(words[5:16])), (7, " ".join(words[:9])), (8, None), (9, "")]
    frame = spark.createDataFrame([(i, t, True) for i, t in texts], "doc_id long, text string, n_hit boolean")
    bench = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words).upper()), (3, "quite another item of words that are nowhere")], "item_id long, text string")
    left = decontam.clean(frame, bench, block_bytes=block_bytes)
    assert left.schema == frame.schema
    assert got(left, "doc_id", "text") == expected([texts[1], texts[3], texts[4], texts[5]])
    assert decontam.clean(empty, bench, block_bytes=block_bytes).count() == 0
    assert decontam.clean(docs, bench, block_bytes=block_bytes).count() == len(rows)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 60])
def test_frequent_fingerprints(spark, block_bytes):
    """A passage in very many items and places, and a text of one word against items of it."""
    same = " ".join("ha" for _ in range(14))
    items = [(k, f"{same} z{k} and so on") for k in range(9)] + [(20, "ha"), (21, "HA"), (22, same), (23, " ".join(["ha"] * 3000))]
    texts = [" ".join("ha" for _ in range(40)), f"a {same} z3 and so on", "no laughing", "ha", " ".join(["ha"] * 60_000)]
    frame, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(frame, bench, block_bytes=block_bytes)
    want = brute.contamination(texts, items)
    assert got(decontam.digest(found), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == expected((k, *x) for k, x in enumerate(want))
    runs = {r["doc_id"]: [(x["first"], x["end"]) for x in r["runs"]] for r in found.collect()}
    assert runs == {0: [(0, 40)], 1: [(1, 19)], 2: [], 3: [(0, 1)], 4: [(0, 60_000)]}


def test_secrets_of_a_text_with_many_matches(spark):
    """More matches than are placed in one run, of kinds that are kept and dropped."""
    text = " é ".join(f"token = a{k} {'0123456789abcdef' * 2} password: hunter{k} AKIA{'B2' * 8}" for k in range(900))
    found = secret_scan.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["base_sha256"] == hashlib.sha256(brute.joined(brute.secrets(text)).encode()).hexdigest()
    assert (found["n_assign"], found["n_access"], found["n_hex"]) == (900, 900, 900)
