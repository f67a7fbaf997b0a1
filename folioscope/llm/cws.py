"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its pairs of neighbouring words (the last word with nothing), weighted by their counts: a term that comes n times
is n elements, the numbered copies 1 to n. In round d (0, 1, 2, ...) every element throws one dart, by a hash of term, copy and d: it hits one
of `slots` slots, at a height of d + u, u uniform in [0, 1). A slot's sample is the lowest dart in it. What an element throws depends on
nothing but itself, and elements are alike, so the lowest dart of two texts together is equally often that of each of their elements: two
documents have the same sample with a probability equal to the generalised Jaccard similarity of their weights. The height itself stands for
the dart: its 16-bit hash is a slot of the fingerprint, and likeness is the share of equal slots.

Higher darts don't count once each slot is hit, so a text of n words throws for ceil(HITS * slots / n) rounds, instead of drawing for each term
and slot. Where no dart hits a slot (one text in 10 ** 8 or less), it takes the sample of the next slot of its four that has one; this too is told
by the text alone.

The edited text of a document (its second half replaced by the beginning of the next document by ascending doc_id) is
fingerprinted beside it. Next documents come from ranges of doc_id: one shuffle of the texts brings a range together, and
the last row of each range gets the first of the next range by an equi-join on the range's number. Counting and sampling
then group by the range first, so the texts move once.

Nulls: a null text is empty; null doc_ids sort first. A text without words has no samples and a fingerprint of zeros; two such
are alike (1). Equal doc_ids are ordered by text; repeated rows give a row each. A single document is its own next one.
Very long texts are one row like others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, plan_bytes, range_buckets, table, written

SLOTS = 128
#: Bytes of the documents, as the plan estimates them, that a partition of ranges takes.
PARTITION_BYTES = 128_000_000
#: Slots that a number of the fingerprint holds, and that are columns of one aggregation.
PART = 4
#: Darts of a text for each slot: each slot is missed with a probability of exp(-HITS).
HITS = 24


def terms_of(rows: DataFrame, keys: list[str], texts: list[str], slots: int) -> DataFrame:
    """keys, term (64-bit hash of a pair of words) and, for each text, n0, n1, ...: how often that text has it, and r0, r1, ...: rounds of that
    text, where it has the term; a null term for texts without words."""
    words = lambda text: F.array_remove(F.split(F.col(text), SPACE), "")
    split = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(j).alias("of"), words(text).alias("w")) for j, text in enumerate(texts)])))
    split = split.select("*", F.ceil(F.lit(float(HITS * slots)) / F.greatest(F.size("w"), F.lit(1))).alias("rounds"))
    pairs = split.select(*keys, "of", "rounds", F.explode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    terms = pairs.select(*keys, "of", F.when(F.col("p").isNotNull(), F.col("rounds")).otherwise(1).alias("rounds"), F.when(F.col("p").isNotNull(), F.xxhash64("p.a", "p.b")).alias("term"))
    of = lambda j, value: F.when(F.col("of") == j, value)
    return terms.groupBy(*keys, "term").agg(*[x for j in range(len(texts)) for x in (F.count(of(j, 1)).alias(f"n{j}"), F.max(of(j, F.col("rounds"))).alias(f"r{j}"))])


def fingerprints(rows: DataFrame, keys: list[str], text: str, slots: int = SLOTS) -> DataFrame:
    """keys and `print` (numbers of four slots each) of each row, by the keys' groups; keys must tell rows apart."""
    return fingerprints_of(rows, keys, [text], slots).withColumnRenamed("print0", "print")


def darts_of(rows: DataFrame, keys: list[str], texts: list[str], slots: int) -> DataFrame:
    """keys, of, round and dart (64-bit hash; null for texts without words): an element's dart is thrown once for all texts of a row that have
    it, of: whose it is, a bit for each text."""
    each = range(len(texts))
    copies = terms_of(rows, keys, texts, slots).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), *[F.col(f"n{j}") for j in each]))).alias("copy"))
    limits = [F.when(F.col("copy") <= F.col(f"n{j}"), F.col(f"r{j}")).otherwise(0).alias(f"r{j}") for j in each]
    thrown = copies.select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term", "copy")).alias("element"), *limits)
    thrown = thrown.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), *[F.col(f"r{j}") for j in each]) - 1)).alias("round"))
    of = reduce(Column.bitwiseOR, [F.when(F.col("round") < F.col(f"r{j}"), F.lit(1 << j)).otherwise(0) for j in each])
    return thrown.select(*keys, of.alias("of"), "round", F.when(F.col("element").isNotNull(), F.xxhash64("element", "round")).alias("dart"))


def fingerprints_of(rows: DataFrame, keys: list[str], texts: list[str], slots: int = SLOTS) -> DataFrame:
    """keys and, for each of the columns `texts`, print0, print1, ..., each the same as if its text were alone."""
    if slots % PART:
        raise ValueError(f"slots come in {PART}s")
    parts, each, bits = slots // PART, range(len(texts)), len(texts)
    # a dart's first 32 bits tell its slot, its last 40 how high it is within its round; what has no words has a row without a dart
    slot = F.shiftright(F.shiftrightunsigned("dart", 32) * slots, 32)
    hit = darts_of(rows, keys, texts, slots).select(*keys, "of", "round", "dart", slot.alias("slot"))
    hit = hit.select(*keys, F.shiftleft(F.coalesce(F.shiftright("slot", 2), F.lit(0)), bits).bitwiseOR(F.col("of")).alias("at"), F.col("slot").bitwiseAND(F.lit(PART - 1)).alias("lane"), "round", "dart")
    # the groups' last column is a hash of the others, which alone are mixed so little by an aggregation's map that many of its groups meet in one place
    hit = hit.select(*keys, "at", F.xxhash64(*keys, "at").alias("mixed"), "lane", "round", F.col("dart").bitwiseAND(F.lit((1 << 40) - 1)).alias("low"))
    height = F.floor((F.col("round") + F.col("low") * F.lit(2.0**-40)) * F.lit(2.0**40))
    least = hit.groupBy(*keys, "at", "mixed").agg(*[F.min(F.when(F.col("lane") == k, height)).alias(f"s{k}") for k in range(PART)])
    its = lambda j: F.col("at").bitwiseAND(F.lit(1 << j)) != 0
    values = least.groupBy(*keys, F.shiftright("at", bits).alias("part")).agg(*[F.min(F.when(its(j), F.col(f"s{k}"))).alias(f"s{j}_{k}") for j in each for k in range(PART)])
    values = values.select(*keys, F.struct("part", F.struct(*[packed_slots(f"s{j}_").alias(f"own{j}") for j in each])).alias("p")).groupBy(*keys).agg(F.map_from_entries(F.collect_list("p")).alias("ps"))
    own = lambda j: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda k: F.coalesce(F.col("ps")[k][f"own{j}"], F.lit(0).cast("long")))
    return values.select(*keys, *[own(j).alias(f"print{j}") for j in each])


def packed_slots(prefix: str) -> Column:
    """The 16-bit hashes of four samples in a number; a slot without one takes the next one's. Null if there is none."""
    sample = lambda k: F.coalesce(*[F.col(f"{prefix}{(k + step) % PART}") for step in range(PART)])
    lane = lambda k: F.shiftleft(F.xxhash64(sample(k)).bitwiseAND(F.lit(0xFFFF)), 48 - 16 * k)
    return F.when(sample(0).isNotNull(), reduce(Column.bitwiseOR, [lane(k) for k in range(PART)]))


def printed(print_: Column) -> Column:
    """The fingerprint's text: four hexadecimal digits a slot; zeros where there is none."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, slots: int) -> Column:
    """Share of equal slots of two fingerprints."""
    equal = lambda x: reduce(Column.__add__, [F.when(F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0) for k in range(4)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + equal(x)) / F.lit(float(slots))


def with_next(docs: DataFrame, partitions: int, ranges: int = 8) -> DataFrame:
    """bucket, row (number within the bucket), doc_id, text and next_text; hash-partitioned by bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = range_buckets(rows, "doc_id", partitions * ranges)
    # the first text of each range, filed under the range before it: at most as many rows as ranges
    ids = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    around = Window.orderBy("bucket")
    ids = ids.select("first_id", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(F.col("before").alias("bucket")).agg(F.min("text").alias("first_text"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.repartition(partitions, "bucket").select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text"))
    return rows.join(heads.repartition(partitions, "bucket"), "bucket", "left").select("bucket", "row", "doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by as many of the following text's first (or all of them)."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    # a task's groups - of each row, part of the slots and whose a dart is - are few enough for the aggregation's small, fast map
    partitions = max(12 * int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs) // PARTITION_BYTES)
    key = ["bucket", "row"]
    rows = with_next(docs, partitions, 2).select(*key, "doc_id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    told = rows.select(*key, "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = rows.select(*key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("edited", F.lit("")).alias("edited"))
    pairs = fingerprints_of(both, key, ["text", "edited"], slots).select(*key, F.col("print0").alias("fingerprint"), F.col("print1").alias("edited_fingerprint"))
    found = written(told.join(pairs, key), "fingerprints")

    # the next document's fingerprint: within a range by its row, over its end from the next range's first row
    around = Window.orderBy("bucket")
    firsts = found.where("row = 1").select("bucket", F.col("fingerprint").alias("first_print"))  # at most as many rows as ranges
    firsts = firsts.select(F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"), "first_print")
    following = F.coalesce(F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("row")), "first_print")
    found = found.join(firsts, "bucket", "left").withColumn("next_print", following)
    return found.select("doc_id", "n_chars", "edited_sha256", printed(F.col("fingerprint")).alias("fingerprint"), printed(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint"), slots).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print"), slots).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
