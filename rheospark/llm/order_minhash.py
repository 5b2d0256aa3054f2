"""Order MinHash: fingerprints of texts that are sensitive to edit distance, with DataFrame functions only.

A text is the sequence of its k-mers, k words each, every one numbered by its occurrence, so that repeats count. A hash
of (k-mer, number) deals these into bins by its first bits. Each bin selects its `pick` minimal k-mers, keeps them in the
order of the text, and hashes them as one tuple. The bins stand for as many hash functions (one-permutation hashing),
so every k-mer is hashed once. Bins without a k-mer stay empty; two fingerprints are alike to the share of bins, of
those that either fills, in which their tuples agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_clashes, table, written

#: Words of a k-mer; bins as a power of two; k-mers that a bin selects (2 or 1, if it has no more).
K, BIN_BITS, PICK = 3, 6, 2
#: Low bits of a long that hold a position: more words than any text that Spark can hold has.
POSITION = 30
#: Bytes of text in a bucket of neighbouring documents, about; with more bytes than MOST_BUCKETS buckets hold so, they
#: hold more. The table of buckets that is broadcast has at most that many rows of two numbers.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 100_000


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _up_to(n: Column) -> Column:
    """0 .. n - 1 as an array; empty for n = 0 (sequence() would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _packed(hashed: Column, position: Column) -> Column:
    """High bits of a hash, and a position; sorts by the hash."""
    return F.shiftleft(F.shiftright(hashed, POSITION), POSITION).bitwiseOR(position.cast("long"))


def _run_starts(values: Column, n: Column, shift: int) -> Column:
    """Where a sorted array begins a new run of values that agree above `shift` bits."""
    high = lambda i: F.shiftright(F.get(values, i), shift)
    return F.filter(_up_to(n), lambda i: (i == 0) | (high(i) != high(i - 1)))


def signature(text: Column, k: int = K, bin_bits: int = BIN_BITS) -> Column:
    """The fingerprint as an array of long: for each bin that isn't empty its number and 32 bits of its tuple's hash.

    Null, empty and blank texts: an empty array. Fewer than k words: all of them are the one k-mer.
    """
    spaces = "\t\n\x0b\x0c\r"
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), spaces, " " * len(spaces)), " "), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def kmers(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(_packed(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")), F.lit(0)))
        each = F.transform(_up_to(n - (k - 1)), lambda i: _packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))
        return F.sort_array(F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(each))

    def numbered(s: Column) -> Column:
        """From sorted (k-mer, position) to sorted (hash of k-mer and number, position)."""
        n = F.size(s)

        def of(starts: Column) -> Column:
            def run(at: Column, j: Column) -> Column:
                size = F.coalesce(F.get(starts, j + 1), n) - at
                value = F.shiftright(F.get(s, at), POSITION)
                mask = (1 << POSITION) - 1
                return F.transform(_up_to(size), lambda o: _packed(F.xxhash64(value, o), F.get(s, at + o).bitwiseAND(F.lit(mask).cast("long"))))

            return F.flatten(F.transform(starts, run))

        return F.sort_array(_let(_run_starts(s, n, POSITION), of))

    def binned(e: Column) -> Column:
        n, shift = F.size(e), 64 - bin_bits

        def of(starts: Column) -> Column:
            def tuple_of(at: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), n)
                mask = F.lit((1 << POSITION) - 1).cast("long")
                first, second = F.get(e, at), F.get(e, at + 1)
                a, b = F.shiftright(first, POSITION), F.shiftright(second, POSITION)
                hashed = (
                    F.when(at + 1 >= end, F.xxhash64(a))
                    .when(first.bitwiseAND(mask) < second.bitwiseAND(mask), F.xxhash64(a, b))
                    .otherwise(F.xxhash64(b, a))
                )
                number = F.shiftright(first, shift) + (1 << (bin_bits - 1))
                return F.shiftleft(number, 32).bitwiseOR(F.shiftrightunsigned(hashed, 32))

            return F.transform(starts, tuple_of)

        return _let(_run_starts(e, n, shift), of)

    return _let(hashes, lambda h: _let(kmers(h), lambda s: _let(numbered(s), binned)))


def printed(sig: Column) -> Column:
    """The fingerprint as a string: ten hex digits for each bin that isn't empty."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that a or b fills, from 0 to 1; 1 if both are empty."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Add next_text to docs (doc_id, text): the text of the next row by descending doc_id, then text (null id last);
    the first row's after the last. Texts are shuffled once, by bucket of neighbouring ids. A bucket's last row gets the
    first text of the next bucket that isn't empty from a table of one row per bucket."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    parts = 256
    marks = [i / parts for i in range(parts + 1)]
    total, marks = slim.agg(F.sum("n"), F.percentile_approx("doc_id", F.array(*map(F.lit, marks)), 10_000)).first()
    marks = sorted(set(marks or [0])) or [0]
    buckets = min(MOST_BUCKETS, max(1, (total or 0) // bucket_bytes))
    # place among the quantiles, between two of them in proportion: grows with doc_id, however the ids are spread
    bounds = F.array(*[F.lit(m).cast("long") for m in marks])
    at = F.size(F.filter(bounds, lambda m: m <= F.col("doc_id")))
    low, high = F.get(bounds, F.greatest(at - 1, F.lit(0))), F.get(bounds, at)
    place = (at + F.coalesce((F.col("doc_id") - low) / (high - low), F.lit(0.0))) / (len(marks) + 1)
    bucket = F.coalesce(F.floor(place * buckets).cast("long"), F.lit(-1))
    tops = slim.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("doc_id"))
    tops = written(tops, "tops")  # one row per bucket
    down = Window.orderBy(F.desc("bucket"))
    follows = tops.select("bucket", F.coalesce(F.lead("bucket").over(down), F.max("bucket").over(Window.partitionBy())).alias("next"))
    own = docs.withColumn("bucket", bucket)
    firsts = own.alias("d").join(F.broadcast(tops.alias("t")), (F.col("d.bucket") == F.col("t.bucket")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    firsts = firsts.groupBy(F.col("d.bucket").alias("next")).agg(F.max(F.coalesce("text", F.lit(""))).alias("first_text"))
    firsts = follows.join(firsts, "next").select("bucket", "first_text")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")).desc())
    out = own.repartition("bucket").withColumns({"last": F.lead(F.lit(1)).over(order).isNull(), "next_text": F.lead(F.coalesce("text", F.lit(""))).over(order)})
    out = out.join(firsts, "bucket", "left")
    return out.withColumn("next_text", F.when(F.col("last"), F.col("first_text")).otherwise(F.col("next_text"))).drop("last", "first_text", "bucket")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """Add fingerprint (string) to every row of docs. Equal texts have equal fingerprints; nulls, empty and blank texts
    have the empty one. Repeated rows and an empty table are nothing special; a column fingerprint is replaced."""
    return drop_clashes(docs, ["fingerprint"], keep=(text,)).withColumn("fingerprint", printed(signature(F.col(f"`{text}`"), k)))


def edit_trial(docs: DataFrame, k: int = K) -> DataFrame:
    """docs: doc_id, text. Fingerprints of every text and of its edited text, whose second half is taken from the next
    text by descending doc_id, and how alike they are. Null text: empty. Rows with equal ids stand in the order of
    their texts. Empty table: empty result."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited})
    sigs = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array(signature(F.col("text"), k), signature(F.col("edited"), k), signature(F.col("next_text"), k)).alias("s"),
    )
    sig = [F.col("s")[i] for i in range(3)]
    return sigs.select(
        "doc_id", "n_chars", "edited_sha256", printed(sig[0]).alias("fingerprint"), printed(sig[1]).alias("edited_fingerprint"),
        likeness(sig[0], sig[1]).alias("near_edited"), likeness(sig[0], sig[2]).alias("near_next"),
    )


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_trial(table(spark, sf_dir, "documents").select("doc_id", "text"))
