"""Secrets in texts: fixed patterns, and strings that pass for random ones.

Everything is DataFrame expressions.  Unbroken runs of 20 and more letters, digits and
+ / _ - are looked for once in a text; keys of fixed form and hexadecimal strings lie in
them.  The other runs are candidates if their characters fit an encoding (hexadecimal,
base 32, 36, 62 or 64, or letters of both cases).  Two questions are asked of each:

Does it look random?  A battery tests "drawn at random from that alphabet": chi-squared
uniformity of the alphabet's counts, the number of runs above and below the alphabet's
middle, and the lag-1 serial correlation; three times the least p-value must be LEVEL at
least, so that of random strings a share of LEVEL is dismissed.  Short strings of any
kind pass, as the battery has little power there.

Is there evidence that it is no ordinary string?  A name, path or number keeps to a kind
of character (lower case, capitals, digits, marks) at a share STAY of its places, and its
letters are as frequent as in English.  The ratio of a string's probability among random
ones to that among ordinary ones is 1 at most on average over ordinary strings (an
e-value), whatever its length; so short strings seldom reach much.  Ratios are judged
together for each encoding and length band by the Benjamini-Hochberg rule for e-values:
of m candidates the k largest ratios count if they are m / (q k) at least, so of the
strings reported at most a share q is expected to be ordinary, however they depend on
each other.  Ratios are counted in a fixed number of bins, so the rule takes one
aggregation whatever the number of candidates, and its outcome is a threshold for each band.

Defined results: a null text is read as an empty one; kinds may overlap, but a random
string that overlaps a pattern's span is left out; equal candidates are judged alike, each
counts; repeated rows, null and repeated doc_ids are rows like others; matches of a very long text
are placed in runs of WALK; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leftmost non-overlapping matches; letters of the words in either case (ASCII only).
_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
MAY_ASSIGN = rf"""[:=]\x20*["']?{_VALUE}{{6}}"""  # in every text with a match that counts, and found sooner
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 and more; a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"
_PART = "[A-Za-z0-9+/_-]"
RUN = f"(?<!{_PART}){_PART}{{20,}}"  # with all keys of fixed form and hexadecimal strings
KINDS = ["assign", "access", "hex", "random"]

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",  # - and _ count as + and /
}
#: Letters in 100 of English text, a to z (fixed values, as published).
FREQUENCY = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
STAY = 0.7
LEVEL = 0.001
BINS = 400
IN_A_DOUBLING = 4  # bins of the ratio
Q = 0.01
WALK = 256
BETWEEN = "(?<=.)(?=.)"  # characters of a string without line ends
_SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs_of(array: Column) -> Column:
    """An array cut into arrays of WALK: an array grows by copying, so what is put together one by one stays short."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / WALK).cast("int")), lambda c: F.slice(array, c * WALK + 1, WALK))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, found) of a pattern's matches, in code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("found"))
        counts = F.length(F.regexp_extract(x["m"], pattern, group)) >= least if least else F.lit(True)
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))
    parts = lambda all_: F.transform(_runs_of(all_), lambda run: F.aggregate(run, start, step))
    # Places count from each run's start first; the runs are put after each other then.
    walked = _let(_let(zipped, parts), lambda runs: F.flatten(F.transform(runs, lambda x, i: _moved(x["out"], F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda at, y: at + y["at"])))))
    return F.when(F.size(found) > 0, walked).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["found"].alias("found")))


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _assigned(text: Column) -> Column:
    return F.when(text.rlike(MAY_ASSIGN), _spans(text, ASSIGN, 0, 1, 6)).otherwise(_none())


def _found_runs(text: Column) -> Column:
    return F.when(text.rlike(RUN), _spans(text, RUN, 3)).otherwise(_none())


def _inside(runs: Column, pattern: str, kind: int) -> Column:
    """A pattern's matches in runs."""
    within = lambda x: F.when(x["found"].rlike(pattern), _moved(_spans(x["found"], pattern, kind), x["start"])).otherwise(_none())
    return F.flatten(F.transform(runs, within))


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail beyond |z|, to seven digits (fixed coefficients of a published approximation)."""
    series = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return _let(F.abs(z), lambda x: F.exp(-x * x / 2) / 2.5066282746310002 * _let(1 / (1 + 0.2316419 * x), series))


def encoding(found: Column) -> Column:
    """The smallest alphabet that a candidate fits; null if it is of one kind of character, or holds a pattern's match."""
    has = lambda some: found.rlike(f"[{some}]")
    one_case = found.rlike("^[0-9a-z]*$|^[0-9A-Z]*$") & has("0-9") & has("A-Za-z")
    mixed = has("a-z") & has("A-Z")
    return (
        F.when(found.rlike(ACCESS) | found.rlike(HEX), None)
        .when(one_case & found.rlike("^[0-9a-fA-F]*$"), "hex")
        .when(one_case & found.rlike("^[A-Z2-7]*$"), "base32")
        .when(one_case, "base36")
        .when(mixed & found.rlike("^[A-Za-z]*$"), "letters")
        .when(mixed & found.rlike("^[A-Za-z0-9]*$"), "base62")
        .when(mixed & has("0-9"), "base64")
    )


def _ratio(found: Column, size: Column) -> Column:
    """Logarithm to base 2 of a string's probability among random ones over that among ordinary ones."""
    n = F.length(found).cast("double")
    changes = F.regexp_count(found, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_-])[^+/_-]"))
    total = sum(FREQUENCY)
    weights = {c: F.lit(f / total) for c, f in zip(LOWER, FREQUENCY, strict=True)} | {c: F.lit(0.1) for c in DIGITS} | {c: F.lit(0.25) for c in "+/_-"}
    weight = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.log2(w))])
    characters = F.aggregate(F.split(F.lower(found), BETWEEN), F.lit(0.0), lambda a, c: a + F.element_at(weight, c))
    ordinary = F.log2(F.lit(0.25)) + (n - 1 - changes) * F.log2(F.lit(STAY)) + changes * F.log2(F.lit((1 - STAY) / 3)) + characters
    return -n * F.log2(size) - ordinary


def _battery(own: Column, alphabet: Column, n: Column, size: Column) -> Column:
    """Three times the least p-value of the tests, at most 1, for a string of n characters out of an alphabet of that size."""
    square = F.aggregate(F.split(alphabet, BETWEEN), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(own, c, F.lit(""))), F.lit(2.0)))
    free = size - 1
    chi = square * size / n - n
    # With few characters for each letter the statistic varies less than its limit: scale it to the same variance.
    scaled = free + (chi - free) / F.sqrt((n - 1) / n)
    cube = (F.pow(F.greatest(scaled, F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    p_chi = _let(cube, lambda z: F.when(z >= 0, _tail(z)).otherwise(1 - _tail(z)))
    middle = (size / 2).cast("int")
    halves = F.call_function("translate", own, alphabet, F.concat(F.repeat(F.lit("l"), middle), F.repeat(F.lit("h"), middle)))
    counts = _let(halves, lambda x: F.struct((F.regexp_count(x, F.lit("(?<=l)h|(?<=h)l")) + 1.0).alias("runs"), F.length(F.replace(x, F.lit("l"), F.lit(""))).cast("double").alias("high")))

    def p_of_runs(x: Column) -> Column:
        mean = 2 * x["high"] * (n - x["high"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(spread > 0, 2 * _tail((F.abs(x["runs"] - mean) - 0.5) / F.sqrt(spread))).otherwise(0.0)

    p_runs = _let(counts, p_of_runs)
    centre = (size - 1) / 2
    values = F.transform(F.split(own, BETWEEN), lambda c: F.call_function("instr", alphabet, c) - 1 - centre)
    top = _let(values, lambda v: F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    p_serial = 2 * _tail(top / (((size * size - 1) / 12) * F.sqrt(n - 1)))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _of(name: Column, values: dict[str, str | float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), name)


def random_p(found: Column, name: Column) -> Column:
    """The battery's p of a candidate in its encoding."""
    own = F.when(name.isin("hex", "base36"), F.lower(found)).when(name == "base64", F.translate(found, "-_", "+/")).otherwise(found)
    given = F.struct(own.alias("own"), _of(name, ALPHABETS).alias("alphabet"), F.length(found).cast("double").alias("n"))
    return _let(given, lambda x: _battery(x["own"], x["alphabet"], x["n"], F.length(x["alphabet"]).cast("double")))


def evidence(found: Column, name: Column) -> Column:
    """The bin of a candidate's ratio, 0 for all up to 1."""
    ratio = _ratio(found, _of(name, {k: float(len(a)) for k, a in ALPHABETS.items()}))
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(IN_A_DOUBLING * ratio))).cast("int")


def band(found: Column, name: Column) -> Column:
    return F.concat(name, F.lit(":"), F.floor(F.log2(F.length(found).cast("double")) * 2).cast("string"))


def thresholds(documents: DataFrame, text: str = "text", q: float = Q) -> dict[str, int]:
    """For each band the least bin of the ratio whose strings are reported, over all documents; bands where none is are left out.

    The bands are six encodings times half powers of two of the length, so this is a few dozen rows.
    """
    texts = documents.select(F.col(text).alias("text")).where(F.col("text").rlike(RUN))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("found"))
    named = found.withColumn("name", encoding(F.col("found"))).where("name is not null")
    # Strings that the battery dismisses count among the candidates, with no evidence.
    bin_ = F.when(random_p(F.col("found"), F.col("name")) >= LEVEL, evidence(F.col("found"), F.col("name"))).otherwise(0)
    bins = named.select(band(F.col("found"), F.col("name")).alias("band"), bin_.alias("bin")).groupBy("band", "bin").agg(F.count("*").alias("n"))
    one = Window.partitionBy("band")
    above = F.sum("n").over(one.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = bins.select("band", "bin", above.alias("rank"), F.sum("n").over(one).alias("m"))
    good = ranked.where(F.pow(F.lit(2.0), F.col("bin") / IN_A_DOUBLING) >= F.col("m") / (q * F.col("rank")))
    return {r["band"]: r["bin"] for r in good.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def _overlaps(sorted_: Column, x: Column) -> Column:
    """Whether one of some sorted spans, none of which overlap, overlaps x: the last that starts before its end, found by halving."""
    half = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] < s["hi"], F.when(F.element_at(sorted_, half(s))["start"] < x["end"], F.struct(half(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (half(s) - 1).alias("hi")))).otherwise(s)
    last = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_) + 1.0)).cast("int")), F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi")), step)["lo"]
    return (F.size(sorted_) > 0) & _let(last, lambda k: F.when(k > 0, F.element_at(sorted_, F.greatest(k, F.lit(1)))["end"] > x["start"]).otherwise(False))


def with_spans(documents: DataFrame, limits: dict[str, int], text: str = "text", spans: str = "spans") -> DataFrame:
    """The documents with a column more: spans (start, kind, end), by start and then kind's number in KINDS; ends are exclusive."""
    own = F.coalesce(F.col(text), F.lit(""))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map().cast("map<string,int>")

    def reported(x: Column) -> Column:
        found = x["found"]
        passes = lambda name: F.when(name.isNull(), False).when(evidence(found, name) < F.coalesce(F.element_at(limit, band(found, name)), F.lit(BINS + 1)), False).otherwise(random_p(found, name) >= LEVEL)
        return _let(encoding(found), passes)

    def every(s: Column) -> Column:
        random = F.filter(s["runs"], lambda x: reported(x) & ~_overlaps(s["assigned"], x))
        all_ = F.concat(s["assigned"], _inside(s["runs"], ACCESS, 1), _inside(s["runs"], HEX, 2), random)
        return F.array_sort(F.transform(all_, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))

    return documents.withColumn(spans, _let(F.struct(_assigned(own).alias("assigned"), _found_runs(own).alias("runs")), every))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of the query: counts of the base kinds, sha256 of the base spans, and all spans."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_spans(docs, thresholds(docs))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, sign: str = "[secret]") -> Column:
    """The text with each span, or chain of overlapping spans, replaced by the sign.

    What stays is cut out of the text for runs of WALK spans first, and then for each span out of its run's part.
    """

    def step(acc: Column, x: Column) -> Column:
        kept = F.struct(acc["at"].alias("a"), x["start"].alias("b"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out"))

    def cut(runs: Column) -> Column:
        ends = F.transform(runs, lambda run: F.array_max(F.transform(run, lambda x: x["end"])))
        none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

        def pieces(run: Column, ends: Column, i: Column) -> Column:
            before = F.when(i > 0, F.array_max(F.slice(ends, 1, F.greatest(i, F.lit(1))))).otherwise(0)
            kept = F.aggregate(run, F.struct(before.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
            part = F.substring(text, before + 1, F.greatest(F.lit(0), F.element_at(ends, i + 1) - before))
            return _let(F.struct(kept.alias("kept"), part.alias("part"), before.alias("before")), lambda s: F.transform(s["kept"], lambda r: F.substring(s["part"], r["a"] - s["before"] + 1, r["b"] - r["a"])))

        return _let(ends, lambda e: F.concat(F.flatten(F.transform(runs, lambda run, i: pieces(run, e, i))), F.array(F.substring(text, F.array_max(e) + 1, F.length(text)))))

    return F.when(F.size(spans) > 0, F.array_join(_let(_runs_of(spans), cut), sign)).otherwise(text)


def without_secrets(documents: DataFrame, limits: dict[str, int], text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents, columns as they are, with a sign in place of each secret; their length follows the text."""
    spans = "spans"
    while spans in documents.columns:
        spans += "_"
    found = with_spans(documents, limits, text, spans).withColumn(text, redacted(F.col(text), F.col(spans)))
    kind = documents.schema[length].dataType
    return found.withColumn(length, F.when(F.size(spans) > 0, F.length(text).cast(kind)).otherwise(F.col(length))).select(documents.columns)
