"""Line dedup: repeated runs of lines, by a suffix array over sequences of line ids, made by prefix doubling.

A suffix is a position (document, line). Its rank after round k is where the interval of the suffixes that share its first
2 ** k lines begins in the suffix array; the intervals are the array's intervals of a longest common prefix of at least
2 ** k lines. Round k + 1 orders the suffixes of an interval by the rank of the suffix 2 ** k lines on. A suffix that
shares its interval with no other is in its final place and drops out. Distinct pairs of ranks are counted before they
are put in order, by prefix sums over buckets of them, so a rank costs no sort of all suffixes in one place. The interval
of a common prefix of any length n is named by the ranks of the two blocks of 2 ** k <= n lines at its ends.

A run counts if it has more than min_words words. Of a maximal repeated run of that many words every line lies in a
shortest such prefix from some line on, or in a shortest such one up to some line; and all those repeat as the run does.
So the intervals of these two prefixes of each line are looked up, the first position of each is kept, and the union of
all others is the union of all later copies of maximal runs. Lines without words stand in no sequence, hence such a
prefix has at most min_words + 1 lines, which bounds the rounds. They are deleted between two deleted lines.

Positions are ordered by document key, then line. Whole texts that equal an earlier one are found first, by their hash,
and leave the sequences. Line ids are two 64-bit hashes. Rows of a very frequent line, interval or text are salted where
they meet the one row that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, drop_clashes, join_hot, table, written

#: A run of lines is deleted if it has more words than this.
MIN_WORDS = 50
KEY = ["k", "t1", "t2"]
#: Buckets that distinct line ids, and the distinct continuations of one interval, are put in order in.
ID_BUCKETS, NEXT_BUCKETS = 1 << 14, 64
#: Names with more than this share of all rows that have a name in common with others, and at least so many, are hot.
HOT_SHARE, HOT_ROWS = 1000, 1000


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (all columns), k (the key), t1 and t2 (hashes of the text): these name a document and put documents in order."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.lit(1), whole).alias("t1"), F.xxhash64(F.lit(2), whole).alias("t2"))


def _order(*more: str) -> Column:
    return F.struct(F.col("k").isNull().alias("none"), *KEY, *more)


def _join_names(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    return join_hot(rows, names, on, [*KEY, *[c for c in ("pos",) if c in rows.columns]], HOT_SHARE, HOT_ROWS)


def _line_ranks(lines: DataFrame) -> DataFrame:
    """a, b, n, rank of the line ids that occur twice or more, in the order of the ids."""
    counted = written(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "line-ids")
    bucket = F.shiftright("a", 64 - ID_BUCKETS.bit_length() + 1).cast("int")
    counted = counted.withColumn("bucket", bucket)
    sums = counted.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most ID_BUCKETS rows are broadcast
    ranked = counted.withColumn("inside", inside).join(F.broadcast(sums.select("bucket", before.alias("before"))), "bucket")
    return written(ranked.select("a", "b", "n", (F.col("before") + F.col("inside")).alias("rank")), "line-ranks")


def _pair_ranks(pairs: DataFrame, total: int) -> DataFrame:
    """r1, r2, n, rank of the pairs that occur twice or more: within the interval that begins at r1 in the order of r2."""
    counted = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
    counted = written(counted.withColumn("bucket", F.floor(F.col("r2") * NEXT_BUCKETS / F.lit(float(total))).cast("int")), "pairs")
    sums = counted.groupBy("r1", "bucket").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("r1").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("r1", "bucket").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("inside", inside).join(sums.select("r1", "bucket", before.alias("before")), ["r1", "bucket"])
    return written(ranked.select("r1", "r2", "n", (F.col("r1") + F.col("before") + F.col("inside")).alias("rank")), "pair-ranks")


def repeated_runs(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows (k, t1, t2, pos, length) that also stand at an earlier position; lines: k, t1, t2, pos, a, b."""
    columns = [*KEY, "pos", "rank"]
    ranks = _line_ranks(lines)
    total = ranks.agg(F.sum("n")).first()[0] or 0
    level = written(_join_names(lines, ranks, ["a", "b"]).select(*columns), "level-0")
    discard(ranks)
    named: list[DataFrame] = []
    size = 1
    while not level.isEmpty():
        tail = level.select(*KEY, (F.col("pos") + size).alias("end"), F.col("rank").alias("r2"))
        here = windows.where((F.col("length") >= size) & (F.col("length") < 2 * size)).withColumn("end", F.col("pos") + F.col("length"))
        both = _on_position(_on_position(here, level), tail, "end")
        named.append(written(both.select(*KEY, "pos", "length", F.col("rank").alias("r1"), "r2"), "named"))
        ahead = level.select(*KEY, (F.col("pos") - size).alias("pos"), F.col("rank").alias("r2"))
        pairs = written(_on_position(level, ahead).select(*KEY, "pos", F.col("rank").alias("r1"), "r2"), "rank-pairs")
        ranks = _pair_ranks(pairs, total)
        longer = written(_join_names(pairs, ranks, ["r1", "r2"]).select(*columns), "level")
        for done in (level, pairs, ranks):
            discard(done)
        level, size = longer, 2 * size
    discard(level)
    if not named:
        return windows.limit(0)
    every = named[0]
    for x in named[1:]:
        every = every.unionByName(x)
    interval = ["length", "r1", "r2"]
    first = written(every.groupBy(*interval).agg(F.min(_order("pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "intervals")
    return _join_names(every, first, interval).where(F.col("first") < _order("pos")).select(*KEY, "pos", "length")


def _on_position(left: DataFrame, right: DataFrame, pos: str = "pos", how: str = "inner") -> DataFrame:
    """Join on document and position; a null key is a document like any other."""
    at = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if c == "k" else F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*KEY, pos]]
    joined = left.alias("l").join(right.alias("r"), on=_all(at), how=how)
    for c in [*KEY, pos]:
        joined = joined.drop(F.col(f"r.{c}"))
    return joined


def _same_document() -> Column:
    """Of sides l and r; a null key is a key like any other."""
    return _all([F.col("l.k").eqNullSafe(F.col("r.k")), *[F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("t1", "t2")]])


def _shortest(i: Column, least: int) -> Column:
    """Of the word counts w: the shortest windows with more than `least` words from i on and up to i, as (pos, length)."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    longer = lambda s, x: F.when(s["sum"] > least, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")))
    window = lambda a, pos: F.when(a["sum"] > least, F.struct(pos(a["n"]).alias("pos"), a["n"].alias("length")))
    ahead = F.aggregate(F.slice("w", i + 1, least + 1), start, longer)
    low = F.greatest(F.lit(0), i - least)
    back = F.aggregate(F.reverse(F.slice("w", low + 1, i - low + 1)), start, longer)
    return F.filter(F.array(window(ahead, lambda n: i), window(back, lambda n: i - n + 1)), lambda x: x.isNotNull())


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete from the texts of docs every run of whole lines with more than min_words words that stands at an earlier
    position too, and add n_lines and n_deleted_lines. All rows stay; a text of which nothing is left is empty.

    Rows are put in order by key (null last), then text hash. Rows that agree in key and text are one document: they
    all get the same result. A null text has no lines and stays null; an empty text has one empty line. Columns of docs
    named n_lines or n_deleted_lines are replaced, all others stay, whatever their names. Empty table: empty result.
    """
    keyed = _keyed(drop_clashes(docs, ["n_lines", "n_deleted_lines"], keep=(key, text)), key, text)
    whole_text = F.col("doc").getField(text)
    lines = F.split(whole_text, "\n", -1)
    line = lambda x, i: F.struct(i.alias("line"), F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"))
    slim = keyed.where(whole_text.isNotNull()).select(*KEY, F.filter(F.transform(lines, line), lambda x: x["words"] > 0).alias("lines"))
    sequence = written(slim.dropDuplicates(KEY), "lines")
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    whole = sequence.groupBy("t1", "t2").agg(F.min(_order()).alias("first"), F.count("*").alias("n"), F.max(words).alias("words"))
    whole = written(whole.where((F.col("n") > 1) & (F.col("words") > min_words)).select("t1", "t2", "n", "first"), "wholes")
    copies = written(_join_names(sequence.select(*KEY), whole, ["t1", "t2"]).where(F.col("first") < _order()).select(*KEY), "copies")
    rest = written(sequence.alias("l").join(copies.alias("r"), _same_document(), "left_anti"), "firsts")
    positions = rest.select(*KEY, F.posexplode("lines").alias("pos", "x")).select(*KEY, "pos", "x.a", "x.b")
    counts = rest.select(*KEY, "lines", F.transform("lines", lambda x: x["words"]).alias("w"))
    spans = counts.select(*KEY, F.explode(F.array_distinct(F.flatten(F.transform("w", lambda _, i: _shortest(i, min_words))))).alias("s"))
    spans = written(spans.select(*KEY, F.col("s.pos").alias("pos"), F.col("s.length").alias("length")), "spans")
    runs = repeated_runs(positions, spans)
    # runs of one document as disjoint pieces, first by number in the sequence, then as lines of the text
    before = Window.partitionBy(*KEY).orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("end", F.col("pos") + F.col("length"))
    pieces = runs.withColumn("past", F.max("end").over(before)).withColumn("from", F.greatest("pos", F.coalesce("past", F.lit(0)))).where("end > from")
    pieces = pieces.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "end", (F.col("from") == F.col("past")).alias("on")))).alias("cuts"))
    number = rest.select(*KEY, F.transform("lines", lambda x: x["line"]).alias("at"))
    cuts = pieces.alias("l").join(number.alias("r"), _same_document()).select(*[F.col(f"l.{c}") for c in KEY], "cuts", "at")
    # a piece that begins where the one before has ended also takes the lines without words between them
    piece = lambda x: F.struct(F.when(x["on"], F.get("at", x["from"] - 1) + 1).otherwise(F.get("at", x["from"])).alias("from"), (F.get("at", x["end"] - 1) + 1).alias("end"))
    cuts = cuts.select(*KEY, F.transform("cuts", piece).alias("cuts"))
    cuts = cuts.unionByName(copies.withColumn("cuts", F.lit(None).cast(cuts.schema["cuts"].dataType))).withColumn("hit", F.lit(True))
    joined = keyed.alias("l").join(cuts.alias("r"), _same_document(), "left")
    for c in KEY:
        joined = joined.drop(F.col(f"r.{c}"))
    n = F.when(whole_text.isNull(), 0).otherwise(F.size(lines))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["end"]))
    ends = F.concat(F.transform("cuts", lambda x: x["from"]), F.array(n))
    gaps = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")))
    left = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"] + 1, g["n"]))), "\n")
    deleted = F.aggregate("cuts", F.lit(0), lambda s, x: s + (x["end"] - x["from"]))
    deleted = F.when(F.col("hit").isNull(), 0).when(F.col("cuts").isNull(), n).otherwise(deleted)
    new = F.when(F.col("hit").isNull(), whole_text).when(F.col("cuts").isNull(), F.lit("")).otherwise(left)
    cells = [(new if c.lower() == text.lower() else F.col("doc").getField(c)).alias(c) for c in keyed.schema["doc"].dataType.names]
    return joined.select(*cells, n.cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted_lines"))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
