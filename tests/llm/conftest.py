import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Extra columns whose names clash with those of operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, digest string, part int, shard int, spans string, text_hash long, id long, start long"


def texts():
    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "é", "ß", "in", "ed", "of", "to"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ".\n"]) for _ in range(n))
    passage, base = prose(60) + ".", [prose(n) for n in (5, 40, 120, 300, 80, 64, 200, 90)]
    near = base[3].split(" ")
    near[10] = "changed"
    many = [" ".join(base[6].split(" ")[:k] + ["edit%d" % k] + base[6].split(" ")[k + 1 :]) for k in range(0, 180, 9)]
    key = "9fK3xQ7LmZ2vT8bR4wYc6NdH1sJp5GtE0uXa"
    odd = [
        None, "", " \n\t ", "a", "A b", "one two three", "…", "\x00 \x00", "12 34", "word\n" * 40, "x" * 5000, base[2] + " " + passage, passage + "\n" + base[4], base[3], base[3], " ".join(near),
        base[3].upper(), 'secret = "abc12"', "token=token: abcdef PASSWORD:'hunter22'", "AKIA" + "A" * 15, "AKIA" + "A1" * 10, "é deadbeefdeadbeefdeadbeef " + key, "<|endoftext|>don't 'll we're", prose(4000), "Und " * 80, "### $$$ %%% " * 30,
    ]
    return [*odd, *base, *many]


@pytest.fixture(scope="session")
def rows():
    langs = ["en", "fr", None]
    out = [(k * 3 + 1, t, langs[k % 3], f"s{k % 5}" if k % 7 else None, None) for k, t in enumerate(texts())]
    return [*out, out[13]]  # a repeated row


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, False, 5, "d", 1, 2, "s", 3, 4, 6) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
