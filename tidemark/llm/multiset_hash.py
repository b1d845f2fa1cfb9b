"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text's paragraphs (its lines) are a multiset. Each paragraph is hashed to a wide vector, and a fingerprint is the sum of
the vectors, lane by lane, modulo 2**BITS. So the order of paragraphs does not matter, and paragraphs or whole documents
are inserted and deleted by adding and subtracting vectors. A paragraph's vector has

* IDENTITY lanes, slices of BITS bits of the paragraph's SHA-256: multisets that differ agree in them with about 2**-(IDENTITY * BITS);
* one lane that counts the paragraph's parts, runs of at most PART_WORDS words that end with a sentence;
* SEEDS * 64 lanes: in how many parts the hash with that seed has that bit set. Parts that share one 64-bit hash differ in the
  others, and none of these lanes is needed for equality.

Twice a count less the number of parts is a random signed sum over the parts. The cosine of two documents' signed sums
estimates the cosine of their parts' counts, with an error of about 1 / sqrt(64 * SEEDS), whatever their lengths. Counts are
gathered in packed form, for at most PACKED_PARTS parts at a time so that no count carries into its neighbour, and then
added up in lanes of their own, so they are exact for texts and collections of any length.

Order of documents: ascending doc_id, null first; rows with the same id by the hash of their text; equal rows follow each other.
Nulls: a null text is the empty text, which is one empty paragraph without parts. Repeated rows get the same fingerprint.
Only the id and the text are read, so extra columns cannot clash. An empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY, SEEDS, BITS = 4, 3, 60
SIGNS = SEEDS * 64
LANES = IDENTITY + 1 + SIGNS
MODULUS = 1 << BITS
PART_WORDS = 3
#: Words do not cross lines; a word of more than 64 characters counts as several.
PART = rf"(?:[^ \n]{{0,63}}[^ \n.!?] +){{0,{PART_WORDS - 1}}}[^ \n]{{1,64}}"
FIELD = 8  # bits of a packed count
PACKED_PARTS = (1 << FIELD - 1) - 1  # the highest field must not reach the sign
_FIELDS = sum(1 << FIELD * k for k in range(64 // FIELD))
ROWS_A_TASK, MOST_TASKS = 8192, 100_000


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def parts(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PART), F.lit(0))


def _modulo(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MODULUS - 1))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _bound(value: Column, use) -> Column:
    """use(value), with ``value`` computed once however often it is used: bound as the element of an array."""
    return F.transform(F.array(value), use)[0]


def _identity(text: Column) -> Column:
    slices = lambda d: F.array(*[F.conv(F.substring(d, 1 + k * BITS // 4, BITS // 4), 16, 10).cast("long") for k in range(IDENTITY)])
    hashed = F.transform(paragraphs(text), lambda line: _bound(F.sha2(line.cast("binary"), 256), slices))
    return F.aggregate(hashed, _zeros(IDENTITY), lambda total, h: F.zip_with(total, h, lambda x, y: _modulo(x + y)))


def _bit_counts(found: Column, seed: int) -> Column:
    """64 lanes: in how many of the parts ``found`` the hash with this seed has bit i set."""

    def packed(some: Column) -> Column:
        """FIELD numbers; number j holds the counts of bits j, j + FIELD, ... in fields of FIELD bits."""
        hashes = F.transform(some, lambda p: F.xxhash64(F.lit(seed), p))
        return F.aggregate(hashes, _zeros(FIELD), lambda v, h: F.transform(v, lambda x, j: x + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(_FIELDS))))

    def unpacked(total: Column, counts: Column) -> Column:
        low = (1 << FIELD) - 1
        return F.transform(total, lambda x, i: x + F.call_function("shiftrightunsigned", F.get(counts, i.bitwiseAND(F.lit(FIELD - 1))), i.bitwiseAND(F.lit(-FIELD))).bitwiseAND(F.lit(low)))

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.call_function("div", F.size(found) - 1, F.lit(PACKED_PARTS)).cast("int")))
    return F.aggregate(blocks, _zeros(64), lambda total, b: _bound(packed(F.slice(found, b * PACKED_PARTS + 1, PACKED_PARTS)), lambda counts: unpacked(total, counts)))


def vector(text: Column) -> Column:
    """The fingerprint of a text as array<bigint> of LANES lanes."""
    sketch = _bound(parts(text), lambda p: F.concat(F.array(F.size(p).cast("long")), *[_bit_counts(p, k) for k in range(SEEDS)]))
    return F.concat(_identity(text), sketch)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: _modulo(x + y))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint after the second multiset is deleted from the first."""
    return F.zip_with(a, b, lambda x, y: _modulo(x - y))


def digest(vec: Column) -> Column:
    """Lowercase hexadecimal numbers, one a lane."""
    return F.lower(F.array_join(F.transform(vec, lambda x: F.hex(x)), "."))


def _signs(vec: Column) -> Column:
    return F.slice(vec, IDENTITY + 2, SIGNS)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def summary(vec: Column) -> Column:
    """(parts, total, size): the number of parts, the sum of all counts and the squared length of the signed sums."""
    squares = F.struct(vec[IDENTITY].cast("double").alias("n"), _sum(F.transform(_signs(vec), lambda x: x.cast("double"))).alias("total"), _sum(F.transform(_signs(vec), lambda x: x.cast("double") * x.cast("double"))).alias("squares"))
    return _bound(squares, lambda s: F.struct(s["n"].alias("parts"), s["total"].alias("total"), (4 * s["squares"] - 4 * s["n"] * s["total"] + SIGNS * s["n"] * s["n"]).alias("size")))


def _likeness(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    product = _sum(F.zip_with(_signs(a), _signs(b), lambda x, y: x.cast("double") * y.cast("double")))
    dot = 4 * product - 2 * sb["parts"] * sa["total"] - 2 * sa["parts"] * sb["total"] + SIGNS * sa["parts"] * sb["parts"]
    cosine = F.when((sa["size"] > 0) & (sb["size"] > 0), dot / F.sqrt(sa["size"] * sb["size"])).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the estimated cosine of the parts' counts, from 0 to 1; 0 if a side has no parts or is null."""
    return _bound(F.struct(summary(a).alias("a"), summary(b).alias("b")), lambda s: _likeness(a, b, s["a"], s["b"]))


def collection(df: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    """One fingerprint for all documents of each group: sums lane by lane, combined before the shuffle, so hot groups are cheap."""
    lanes = [F.pmod(F.sum(F.col(vec)[i].cast("decimal(20,0)")), F.lit(MODULUS).cast("decimal(20,0)")).cast("long").alias(f"_{i}") for i in range(LANES)]
    return df.groupBy(*by).agg(*lanes).select(*by, F.array(*[F.col(f"_{i}") for i in range(LANES)]).alias(vec))


def _literal(values: list, kind: str) -> Column:
    """An array literal that the optimizer folds, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _last_at_most(keys: Column, n: int, key: Column) -> Column:
    """Position, from 0, of the last of ``n`` ascending keys that is not above ``key``; 0 if all are. A binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, (n - 1).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(keys, at + step) <= key, at + step).otherwise(at))


def _order_key() -> Column:
    """Sorts like (doc_id, hash of the text), null ids first."""
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0")), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def with_next(docs: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(doc_id, text, next): the text, vector and summary of the next document; after the last comes the first.

    Borders between buckets are taken from the ids themselves, so a bucket holds about ``rows_a_task`` rows however the ids
    are spread, and each bucket is one task; texts are shuffled once. A border is the key of a row: that row also goes
    to the bucket before it, as a guest behind its last row. More than ``rows_a_task`` equal rows are spread over buckets of
    their own: there a row is followed by its like. One copy in ``rows_a_task`` stays, so that one is followed by the next document.
    The driver holds one key of 33 characters a task, at most MOST_TASKS, and one for each set of so many equal rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_key", _order_key())
    n = docs.count()
    tasks = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / rows_a_task)))
    limit = max(rows_a_task, math.ceil(n / tasks))
    # equal rows are counted before the shuffle; each key weighs as many rows as it has, ``limit`` at most
    keys = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.select("_key", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(limit)))).alias("_copy"))
    some = F.struct("_key", "n")
    found = keys.repartitionByRange(tasks, "_key").groupBy(F.spark_partition_id()).agg(F.min("_key").alias("low"), F.collect_set(F.when((F.col("n") > limit) & (F.col("_copy") == 1), some)).alias("many")).collect()
    borders = sorted(r["low"] for r in found) or [""]
    many = sorted((m["_key"], m["n"]) for r in found for m in r["many"])
    first = _literal(borders, "string")
    rows = rows.withColumn("_bucket", _bound(F.col("_key"), lambda k: _last_at_most(first, len(borders), k)))
    label, total = F.col("_bucket"), len(borders)
    if many:
        spread = [math.ceil(c / limit) for _, c in many]
        offsets = [total + sum(spread[:i]) - i for i in range(len(spread))]
        names = _literal([k for k, _ in many], "string")
        at = _bound(F.col("_key"), lambda k: _bound(_last_at_most(names, len(many), k), lambda i: F.when(F.get(names, i) == k, i)))
        rows = rows.withColumn("_at", at).withColumn("_sub", F.xxhash64(F.monotonically_increasing_id()))
        rows = rows.withColumn("_sub", F.coalesce(F.pmod("_sub", F.get(_literal(spread, "long"), F.col("_at"))), F.lit(0).cast("long")).cast("int"))
        label = F.when(F.col("_sub") > 0, F.get(_literal(offsets, "int"), F.col("_at")) + F.col("_sub") - 1).otherwise(label)
        total += sum(spread) - len(spread)
    place = lambda to, guest: F.struct(to.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    own = place(label, False)
    before = F.pmod(F.col("_bucket") - 1, F.lit(len(borders)))
    is_border = (F.get(first, F.col("_bucket")) == F.col("_key")) & (label == F.col("_bucket"))
    rows = rows.select("doc_id", "text", "_key", F.inline(F.when(is_border, F.array(own, place(before, True))).otherwise(F.array(own))))
    rows = rows.repartitionById(total, F.col("bucket")).withColumn("vector", vector(F.col("text"))).withColumn("summary", summary(F.col("vector")))
    ordered = Window.partitionBy("bucket").orderBy("guest", "_key")
    follower = F.struct("text", "vector", "summary")
    return rows.withColumn("next", F.lead(follower).over(ordered)).where(~F.col("guest")).withColumn("next", F.coalesce("next", follower)).drop("_key", "guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter of code points is replaced by the first as
    many (or all) of the next document's; likeness to the edited text and to the next document.

    A single document is its own next document."""
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next.text, 1, cast(floor(length(text) / 4) as int))"))
    out = with_next(docs).withColumn("edited", edited)
    out = out.withColumn("edited_vector", F.when(F.length("text") < 4, F.col("vector")).otherwise(vector(F.col("edited")))).withColumn("edited_summary", summary(F.col("edited_vector")))
    near = lambda b, sb: _likeness(F.col("vector"), F.col(b), F.col("summary"), F.col(sb))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("vector")).alias("fingerprint"), digest(F.col("edited_vector")).alias("edited_fingerprint"),
        near("edited_vector", "edited_summary").alias("near_edited"), near("next.vector", "next.summary").alias("near_next"),
    )
