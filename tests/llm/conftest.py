import random

import pytest

WORDS = "the of and cat dog house river stone green little walks runs über éclair naïve 42 tree lamp window bread salt".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    common = "This very line stands in many of the documents, word for word."
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randrange(1, 60)) + "\n" + prose(rng, 8), f"s{i % 3}") for i in range(30)]
    rows += [(40 + i, base + " tail%d" % i, "s0") for i in range(6)] + [(50, base, None), (51, base, "s1"), (51, base, "s1")]
    rows += [(60 + i, f"{common}\n{prose(rng, 5)}\n  {common.upper()} ", "s2") for i in range(7)]
    rows += [(70, None, "s1"), (71, "", "s1"), (72, " \n\t", "s2"), (73, "\n\n", "s2"), (None, "no id here", "s0"), (None, None, None), (80, base, "s0"), (80, "another text under the same id", "s0")]
    rows += [(90, prose(rng, 30_000), "s0"), (91, "x" * 70_000, "s1"), (92, common, "s1"), (93, "a\x00b \ud7ff 日本", "s2")]
    extra = ["media", "keys", "key", "value", "hash", "block", "slot", "shard", "rep", "component", "grade", "kept", "_id", "node", "piece", "length", "size", "target", "vector", "guest", "bucket", "lang", "n_chars"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *(["?"] * len(extra))) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
