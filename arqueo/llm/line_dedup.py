"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line (by id of the document, then line number) is within one edit of it, or equal. Two lines are
within one edit only if they, or they after one deletion, have a common variant. So every distinct line emits the key of
itself and of all its variants with one character deleted, equal keys are joined, and the edit distance of the
pairs is verified. Of two lines within one edit, the characters that differ are at one place, so one half of the common
variant is the same in both lines. A key is the hash of a half that the deletion left alone, the length and the number of
characters of each class in the variant. Variants that agree in these, wherever the deletion was, have one key: at most six
per line however long it is. Equal variants always have equal keys; what else meets does not pass the verification.

Pairs are made only of keys with few lines. Lines of a key with more than `CROWD` (a template filled in many ways) emit the
hashes of their real variants instead, with the place of the deletion. Lines of one length that are equal without the
character at one place are all within one edit of each other, and so are a line and the variants equal to it: the earliest
place of each group says which lines go, and no pairs are made. Keys with lines longer than `LONG`, whose variants would take
the square of their length, are always paired.

Equal lines are reduced to one row on the map side before anything else, so a line that a third of all documents repeat is
one row. Only keys that two different lines share are joined.

Defined cases: lines end at each line feed; empty lines stay; lines under `SHORTEST` characters are compared for equality only; a
null text has no lines and stays null; an empty one has one empty line; rows with the same id are ordered by a hash of their text,
rows equal in id and text are one document and get the same answer; null ids come last; an empty table gives an empty
result; other columns are ignored by `decide` and kept by `clean`.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import fresh, landed, release

BOUND = 1  # edits
SHORTEST = 8
CLASSES = ("aeioutnAEIOUTN02468",)  # any other character is of the last class
CROWD = 32  # lines of a key that are compared in pairs
LONG = 1024  # characters of a line whose variants are hashed one by one
FILTER_BITS = 2 ** 26  # 8 MB: hashes that are wanted


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    named = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return named.where("line != ''").withColumn("line_hash", F.xxhash64("line"))


def _distinct_lines(lines: DataFrame) -> DataFrame:
    """Per distinct line its first place and what its keys are made of: its length, how many of its characters are in
    each class, hashes of the halves of the line and of the line shortened by one character."""
    length = F.length("line").cast("long")
    near = length >= SHORTEST
    in_class = [F.when(near, length - F.length(F.regexp_replace("line", f"[{c}]+", ""))).alias(f"n{i}") for i, c in enumerate(CLASSES)]
    halves = []
    for short in (0, 1):  # of the line itself and of its variants; the half without the deletion is the same in both
        first = F.floor((F.col("length") - short) / 2)
        halves += [F.xxhash64(F.substr("line", F.lit(1), first.cast("int"))).alias(f"head{short}"),
                   F.xxhash64(F.substr("line", (first + 1 + short).cast("int"))).alias(f"tail{short}")]
    seen = lines.withColumn("length", length).select("*", *in_class, *halves)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line_no")
    made = [f"n{i}" for i in range(len(CLASSES))] + ["length", "head0", "tail0", "head1", "tail1"]
    return seen.groupBy("line_hash").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in made))


def _keys(distinct: DataFrame) -> DataFrame:
    """line_hash, length, key: of the line and of every variant, with either half."""
    counts = [F.col(f"n{i}") for i in range(len(CLASSES))]
    counts.append(F.col("length") - sum(counts[1:], counts[0]))
    own = [F.xxhash64(F.lit(side), "length", *counts, half) for side, half in (("head", "head0"), ("tail", "tail0"))]
    shorter = []
    for i, count in enumerate(counts):
        after = [c - 1 if i == j else c for j, c in enumerate(counts)]
        shorter += [F.when(count > 0, F.xxhash64(F.lit(side), F.col("length") - 1, *after, half)) for side, half in (("head", "head1"), ("tail", "tail1"))]
    keys = F.array_distinct(F.array_compact(F.array(*own, *shorter)))
    return distinct.where("n0 is not null").select("line_hash", "length", F.explode(keys).alias("key"))


def filter_of(hashes: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): one bit for each hash, FILTER_BITS in all, so never more than 8 MB."""
    place = F.pmod(column, F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    return (hashes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))


def marked(rows: DataFrame, column: str, filter_: DataFrame) -> DataFrame:
    """`rows` with `passes`: false only if the hash in `column` is certainly not among those of the filter."""
    place = F.pmod(column, F.lit(FILTER_BITS)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    passes = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = rows.join(F.broadcast(filter_), F.bitmap_bucket_number(place) == F.col("bucket"), "left")
    return met.withColumn("passes", F.coalesce(passes, F.lit(False))).drop("bucket", "bits")


def crowded_copies(lines: DataFrame) -> DataFrame:
    """line_hash of the lines (line_hash, place, line) that have an earlier one within the bound among them."""
    at = F.col("at")
    rest = F.concat(F.substr("line", F.lit(1), at - 1), F.substr("line", at + 1))
    variants = (lines.select("line_hash", "place", "line", F.explode(F.sequence(F.lit(0), F.length("line"))).alias("at"))  # 0: the line itself
                .select("line_hash", "place", "at", F.when(at == 0, F.col("line_hash")).otherwise(F.xxhash64(rest)).alias("variant")))
    place, same, equal = F.col("place"), Window.partitionBy("variant", "at"), Window.partitionBy("variant")
    told = variants.select("line_hash", "place", "at", F.min("place").over(same).alias("first"),
                           F.min(F.when(at == 0, place)).over(equal).alias("whole"), F.min(F.when(at > 0, place)).over(equal).alias("longer"))
    later = F.when(at == 0, place > F.col("longer")).otherwise((place > F.col("first")) | F.coalesce(place > F.col("whole"), F.lit(False)))
    return told.where(later).select("line_hash").distinct()


def near_copies(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """line_hash of the lines that have an earlier one within the bound."""
    keys = _keys(distinct)
    shared = (keys.groupBy("key").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
              .where("low < high").select("key", ((F.col("n") > CROWD) & (F.col("longest") <= LONG)).alias("crowded")))
    met = landed(keys.select("line_hash", "key").join(shared, "key").join(distinct.select("line_hash", "place"), "line_hash"))
    release(lines.sparkSession)
    few = met.where("not crowded")
    crowd = landed(met.where("crowded").groupBy("line_hash").agg(F.first("place").alias("place")))
    later, earlier = few.alias("later"), few.alias("earlier")
    pairs = landed(later.join(earlier, F.col("later.key") == F.col("earlier.key")).where("earlier.place < later.place")
                   .select(F.col("later.line_hash").alias("later"), F.col("earlier.line_hash").alias("earlier")).distinct())
    wanted = pairs.select(F.explode(F.array("later", "earlier")).alias("line_hash")).union(crowd.select("line_hash")).distinct()
    wanted = landed(wanted)
    passed = marked(lines.select("line_hash", "line"), "line_hash", landed(filter_of(wanted, "line_hash"))).where("passes").drop("passes")
    texts = landed(passed.join(wanted, "line_hash").groupBy("line_hash").agg(F.first("line").alias("line")))
    both = (pairs.join(texts.toDF("later", "later_line"), "later").join(texts.toDF("earlier", "earlier_line"), "earlier"))
    paired = both.where(F.levenshtein("later_line", "earlier_line", BOUND) >= 0).select(F.col("later").alias("line_hash"))
    return paired.union(crowded_copies(crowd.join(texts, "line_hash"))).distinct()


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, dropped (numbers of the lines that go, from 0) of the documents that lose a line."""
    lines = _lines(docs, id_column, text_column)
    distinct = landed(_distinct_lines(lines))
    near = landed(near_copies(lines, distinct))
    release(docs.sparkSession)
    later = landed(distinct.join(near.withColumn("near", F.lit(True)), "line_hash", "left").where("n > 1 or near").select(
        "line_hash", "place", F.coalesce("near", F.lit(False)).alias("near")))  # landed: both sides of the join below can then be split
    met = lines.select("line_hash", "doc_id", "text_hash", "line_no").join(later, "line_hash")
    first = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_hash") == F.col("place.text_hash")) & (F.col("line_no") == F.col("place.line_no"))
    return (met.where(F.col("near") | ~first).groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.collect_set("line_no")).alias("dropped")))


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", report: bool = False) -> DataFrame:
    """`docs` without the lines that go; with `report` also n_lines and dropped (their numbers)."""
    gone = landed(dropped_lines(docs, id_column, text_column).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.col("dropped").alias("gone")))
    release(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text_column).cast("string").alias("text"),
                       F.col(id_column).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("hash"))
    rows = marked(rows, "hash", landed(filter_of(gone, "gone_hash")))
    # Only texts that may lose a line are moved.
    losing = rows.where("passes").join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")
    met = losing.select("doc", "text", "gone").unionByName(rows.where("not passes").select("doc", "text", F.lit(None).cast("array<int>").alias("gone")))
    numbers = F.coalesce("gone", F.array().cast("array<int>"))
    parts = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(parts, lambda line, number: ~F.array_contains(F.col("gone"), number)), "\n"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_column: left}
    out = [column.alias(name) for name, column in columns.items()]
    if report:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias(fresh(docs, "n_lines")), numbers.alias(fresh(docs, "dropped"))]
    return met.select(*out)
