"""What the randomness battery and the evidence against ordinary strings report, by length."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tracewell.llm import secret_scan

ORDINARY = [
    "getHTTPResponseCode200OkNow", "Base64EncoderStreamV2Impl", "IPv6AddressResolverFactory", "org/apache/Spark3/sql/Functions", "SHA256WithRSAEncryption", "AbstractSingletonProxyFactoryBean2",
    "com/example/Service2/HandlerImpl", "parseISO8601DateTimeString", "createOAuth2ClientConnection", "X509CertificateTrustManager", "convertUTF8ToUTF16LittleEndian", "Vector3DistanceSquaredTo",
    "HelloWorldExampleApplicationTests", "internationalization2024conference", "MAX_RETRY_COUNT_FOR_HTTP2", "20240131235959000000", "deadlockDetectionIntervalMs", "VERSION2RELEASECANDIDATE",
    "libstdc6-linux-gnu-x86-64-dev", "usersGuide/Chapter10/Section3", "ThisIsAVeryLongIdentifier42", "EC2InstanceMetadataService", "S3BucketLifecycleConfiguration", "iPhone15ProMaxSilicone",
]
ALPHABETS = {
    "hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
    "letters": string.ascii_letters, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


def keys(name, n, count, seed):
    rng = random.Random(f"{name}{n}{seed}")
    return ["".join(rng.choice(ALPHABETS[name]) for _ in range(n)) for _ in range(count)]


def reported(spark, strings):
    frame = spark.createDataFrame([(k, f"see ({s}) and on") for k, s in enumerate(strings)], "doc_id long, text string").repartition(4)
    rows = secret_scan.digest(frame).collect()
    return {strings[r["doc_id"]] for r in rows if r["spans"]}


def test_recall_and_precision_by_length(spark):
    """Of random strings 9 in 10 from 32 characters on and no ordinary one, whether they are a half or a 20th of all."""
    made = {(name, n): keys(name, n, 60, 1) for name in ALPHABETS for n in (20, 24, 32, 40, 64)}
    planted = [s for some in made.values() for s in some]
    found = reported(spark, planted + ORDINARY * 20)
    assert not found & set(ORDINARY)
    for (name, n), some in made.items():
        share = sum(s in found for s in some) / len(some)
        assert share >= (0.9 if n >= 32 else 0.5), (name, n, share)


def test_ordinary_strings_alone(spark):
    assert not reported(spark, ORDINARY)
    assert not reported(spark, ORDINARY[:12])


def test_uneven_strings_are_dismissed(spark):
    """Strings that are no ordinary ones and yet no random ones either: the battery rejects them."""
    uneven = ["aZ0" * 14, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0A1B2C3D4E5F" * 4, "Qz9Qz9Qz9Qz9Qz9Qz9Qz9Qz9"]
    assert not reported(spark, uneven * 3)


def test_statistics_of_random_strings(spark):
    """The battery keeps nearly all random strings, and the ratio is 1 at most on average over strings drawn from the model of ordinary ones."""
    rng = random.Random(2)
    total = sum(secret_scan.FREQUENCY)
    kinds = {"l": string.ascii_lowercase, "u": string.ascii_uppercase, "d": string.digits, "m": "+/_-"}

    def ordinary():
        kind, out = rng.choice("ludm"), ""
        for _ in range(24):
            out += rng.choices(kinds[kind], [f / total for f in secret_scan.FREQUENCY] if kind in "lu" else None)[0]
            kind = kind if rng.random() < secret_scan.STAY else rng.choice([k for k in "ludm" if k != kind])
        return out

    random_ = [s for name in ALPHABETS for n in (20, 32, 48) for s in keys(name, n, 200, 3)]
    frame = spark.createDataFrame([(0, s) for s in random_] + [(1, ordinary()) for _ in range(4000)], "ordinary int, found string").repartition(4)
    named = frame.withColumn("name", secret_scan.encoding(F.col("found")))
    kept = named.where("ordinary = 0 and name is not null").select(F.avg((secret_scan.random_p(F.col("found"), F.col("name")) >= secret_scan.LEVEL).cast("double"))).first()[0]
    assert kept > 0.985
    e = named.where("ordinary = 1").select(F.when(F.col("name").isNull(), 0.0).otherwise(F.pow(F.lit(2.0), secret_scan.evidence(F.col("found"), F.col("name")) / 4)).alias("e"))
    assert e.where("e >= 100").count() <= 40  # a hundredth of 4,000


@pytest.mark.parametrize("n", [3, 700])
def test_redaction_of_many_and_overlapping_spans(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice("aé b") for _ in range(n * 20))
    spans, at = [], 0
    for _ in range(n):
        at += rng.randint(0, 12)
        spans.append((at, rng.randint(0, 3), min(len(text), at + rng.randint(1, 15))))
    spans = sorted({(s, k, e) for s, k, e in spans if s < e})
    want, at = "", 0
    for s, _, e in spans:
        if s >= at:
            want += text[at:s] + "[secret]"
        at = max(at, e)
    frame = spark.createDataFrame([(text, spans), (text, []), (None, [])], "t string, s array<struct<start:int,kind:int,end:int>>")
    assert [r[0] for r in frame.select(secret_scan.redacted(frame.t, frame.s)).collect()] == [want + text[at:], text, None]


def test_random_strings_beside_assignments(spark):
    key = keys("base62", 40, 1, 5)[0]
    text = f"{key} token={key} {key}secret: abcdefgh, {key}"
    spans = secret_scan.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"].split(",")
    assert [s.split(":")[0] for s in spans] == ["random", "assign", "assign", "random"]
