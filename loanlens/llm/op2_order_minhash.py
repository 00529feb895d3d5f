"""Operator 2: document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are its runs of three consecutive words, each numbered by its
occurrence, so repeats count. For each of 32 tuples, two k-mers are selected,
each minimal under an order of its own (the k-mer's hash XOR a constant), put in
text order, and hashed. Two texts' tuples agree if the same k-mers are
selected and stand in the same order, so the share of equal tuples falls with
the edit distance, also for texts with the same k-mers in another order.

Minima are plain ``min`` over longs (hash in the high bits, position in the
low ones), which combine within a task. Documents are dealt into blocks of 1024
consecutive ids, in which the next document is found by a window; each block
holds a copy of the next block's first document. So the text is shuffled once,
and neither windows nor aggregates shuffle again.

Words (not characters) make the k-mers: they bring a text's numbers down by
six, which the time allows for both versions of all texts.

Defined cases: a null text is empty; a text of fewer than three words has one
k-mer of all of them (of none for an empty text); rows with one ``doc_id`` follow
each other in text order; rows without ``doc_id`` come after all others, by a hash
of their text; a single document is its own next; a row holds fewer than 2^31 words,
so positions are exact; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import materialized, read_table, sha256_hex

K = 3
TUPLES, PER_TUPLE = 32, 2
POSITION_BITS = 31              # a string has fewer than 2^31 words, so every position fits
BLOCK_IDS = 1024
RANGES = 64

_LOW = (1 << POSITION_BITS) - 1


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def _order(j: int, member: int) -> int:
    """The constant of an order: any fixed spread of the high bits."""
    x = (j * PER_TUPLE + member + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return _signed((x ^ x >> 31) & ~_LOW)


def _hash_part(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _with_position(h: Column, position: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(_LOW)))


def kmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: a long for each k-mer, hash of (k-mer, occurrence) in the high bits, position in the low ones."""
    words = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    df = df.withColumn("__words", words)
    plain = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__words") - K, F.lit(0))), lambda i: _with_position(
        F.xxhash64(*(F.get("__words", i + j) for j in range(K))), i))
    df = df.withColumn("__sorted", F.sort_array(plain)).drop("__words")
    runs = F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), lambda j: (j == 0) | (
        _hash_part(F.get("__sorted", j)) != _hash_part(F.get("__sorted", j - 1))))
    df = df.withColumn("__runs", runs)

    def numbered(first: Column, run: Column) -> Column:
        last = F.coalesce(F.get("__runs", run + 1), F.size("__sorted")) - 1
        return F.transform(F.sequence(first, last), lambda j: F.when(j == first, F.get("__sorted", j)).otherwise(
            _with_position(F.xxhash64(_hash_part(F.get("__sorted", j)), j - first), F.get("__sorted", j))))
    # only texts that repeat a k-mer need the numbering
    all_ = F.when(F.size("__runs") == F.size("__sorted"), F.col("__sorted")).otherwise(
        F.flatten(F.transform("__runs", numbered)))
    return df.withColumn(out, all_).drop("__sorted", "__runs")


def _tuple(j: int) -> Column:
    """Hash of the tuple: its members' hashes in text order."""
    members = [F.col(f"m{j}_{i}").bitwiseXOR(F.lit(_order(j, i))) for i in range(PER_TUPLE)]
    in_order = F.array_sort(F.array(*(F.struct(m.bitwiseAND(F.lit(_LOW)).alias("at"), _hash_part(m).alias("h")) for m in members)))
    return F.xxhash64(*(F.get(in_order, F.lit(i))["h"] for i in range(PER_TUPLE))).bitwiseAND(F.lit(0xFFFFFFFF))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique) and ``print``: TUPLES numbers of 32 bits."""
    # never empty; the outer form, as Spark infers filters from the other, which repeat the whole expression
    rows = kmers(df.select(*keys, F.col(text).alias("__text")), "__text", "__kmers").select(*keys, F.explode_outer("__kmers").alias("e"))
    least = rows.groupBy(*keys).agg(*(F.min(F.col("e").bitwiseXOR(F.lit(_order(j, i)))).alias(f"m{j}_{i}")
                                      for j in range(TUPLES) for i in range(PER_TUPLE)))
    return least.select(*keys, F.array(*(_tuple(j) for j in range(TUPLES))).alias("print"))


def printed(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(TUPLES))


def _following(blocks: DataFrame) -> DataFrame:
    """(block, before): the block that comes before it in descending order; before the first comes the last."""
    # ranges first, so each window holds a share of the blocks; written, so the ranges are the same in both uses
    ranged = materialized(blocks.repartitionByRange(RANGES, F.desc("block")).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(F.desc("block"))
    ends = ranged.groupBy("range").agg(F.min("block").alias("last"))          # one row for each range
    across = Window.orderBy("range")
    ends = ends.withColumn("last_before", F.coalesce(
        F.lag("last").over(across), F.last("last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return (ranged.withColumn("near", F.lag("block").over(inside)).join(ends, "range")
            .select("block", F.coalesce("near", "last_before").alias("before")))


def order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows without an id: below all ids, spread by their text
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_signed(1 << 63)) + F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    src = docs.select("doc_id", text.alias("text"), place.alias("place")).withColumn(
        "block", F.floor(F.col("place") / F.lit(BLOCK_IDS).cast("decimal(20,0)")).cast("long")).withColumn("tail", F.lit(0))
    before = _following(src.select("block").distinct())
    down = F.lit(0).cast("decimal(20,0)") - F.col("place")
    firsts = src.groupBy("block").agg(F.min(F.struct(down.alias("down"), "text", "doc_id", "place")).alias("first"))
    tails = firsts.join(before, "block").select("first.doc_id", "first.text", "first.place", F.col("before").alias("block"), F.lit(1).alias("tail"))
    order = Window.partitionBy("block").orderBy("tail", F.desc("place"), "text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = (src.unionByName(tails).withColumn("next", F.lead("text").over(order)).withColumn("turn", F.row_number().over(order))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third)))
            .select("block", "turn", "tail", "doc_id", n.cast("long").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"),
                    F.when(F.col("tail") == 0, F.array("text", "edited")).otherwise(F.array("text")).alias("versions")))
    keys = ["block", "turn", "tail", "doc_id", "n_chars", "edited_sha256", "version"]
    prints = fingerprints(rows.select(*keys[:-1], F.posexplode_outer("versions").alias("version", "content")), keys, "content")
    own = F.when(F.col("version") == 0, F.col("print"))
    edited = F.when(F.col("version") == 1, F.col("print"))
    both = prints.groupBy(*keys[:-1]).agg(F.max(own).alias("own"), F.max(edited).alias("edited"))
    done = both.withColumn("next", F.lead("own").over(Window.partitionBy("block").orderBy("turn"))).where("tail = 0")
    return done.select("doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("edited").alias("edited_fingerprint"),
                       likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(read_table(spark, sf_dir, "documents"))
