"""Mixing sources to target weights.

Every source gets a target number of words; its documents, in the order of a random key taken from a hash of their id,
are taken until the target is met exactly, going round again (repeating epochs) if the target exceeds the source.
The order inside a source is cut into ranges of the key (`BUCKETS` of them), so a source that holds a third of all rows is
sorted in as many tasks; the prefix sum of a row is that of its range plus that inside the range.

Defined cases: a null text has no words; null sources form one source, the last; a null id hashes like an empty text; rows
that tie in key, id and size are interchangeable; a source without words has target 0; an empty table gives an empty
result. All decimals of the target are kept, the words taken are the target rounded to a whole number.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import SPACE, WORD, fresh, landed, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source
BUCKETS_HEX = 3  # key digits that make a range: 16 ** 3 = 4,096 ranges per source
SEED = "mix"


def words(text: Column) -> Column:
    """Number of words: each, with the space after it, becomes one character."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{WORD}{SPACE}*", "x")).cast("long")


def random_key(id_column: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sizes` (source, source_size), one row per source -> with `target`. Sources are taken by code point, null last, and
    get the weights in turn. Sources are filled up in the order of the level (words per weight) at which they reach
    `most` times their size; one that does not reach it shares what is left by weight. One row per source, so the
    windows over all sources are small."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = most * F.col("source_size")
    weighed = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (weighed.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0)))
              .withColumn("open_weight", F.sum("weight").over(after))
              .withColumn("rank", F.row_number().over(order))
              .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))))
    # The share of this source if all before it are full and none from here on is; the first that fits gives the level.
    even = (F.col("total") - F.col("full")) / F.col("open_weight")
    level = F.min(F.when(even <= F.col("level"), F.struct("rank", even.alias("even")))).over(Window.partitionBy())["even"]
    return filled.withColumn("even", level).select(
        "source", "source_size",
        F.when(F.col("even").isNull() | (F.col("level") < F.col("even")), F.col("limit").cast("double"))
        .otherwise(F.least(F.col("weight") * F.col("even"), F.col("limit").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
        size: Column | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: int = MOST) -> DataFrame:
    """`doc` (a struct of all columns), doc_id, size, source_size, target, taken: words the mix takes of each row, repeats
    counted. `size` gives the size of a row where it is not to be counted from the text."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"), (words(text_of(text_column)) if size is None else size).alias("size"),
        random_key(id_column, seed).alias("key")).withColumn("range", F.substring("key", 1, BUCKETS_HEX))
    # The same key tells a null source from any other, so that null joins null.
    rows = rows.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    ranges = landed(rows.groupBy("source_key", "range").agg(F.sum("size").alias("words"), F.first("source", True).alias("source")))
    sums = ranges.groupBy("source_key").agg(F.sum("words").alias("source_size"), F.first("source", True).alias("source"))
    aims = targets(sums.select("source", "source_size"), weights, share, most).select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("source_key"),
        "source_size", "target")
    up_to = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = landed(ranges.select("source_key", "range", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("start"))
                    .join(aims, "source_key"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_key", "range"])
    budget = F.round("target").cast("long")
    rest = F.when(F.col("source_size") > 0, F.pmod(budget, F.col("source_size"))).otherwise(F.lit(0))
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return placed.select("doc", "doc_id", "size", "source_size", "target", (rounds * F.col("size") + cut).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for every time a document is taken, the last one cut after the
    word at which the target is met. Rows without words are taken once if their source's target is not 0."""
    taken = mix(docs, id_column, source_column, text_column, **options)
    pieces = F.split(F.coalesce(F.col(f"doc.`{text_column}`"), F.lit("")), f"(?<={WORD[:-1]})(?={SPACE})")
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.when(F.col("target") > 0, 1).otherwise(0))
    rest = F.when(F.col("size") > 0, F.col("taken") - whole * F.col("size")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    cut = fresh(docs, "cut")
    out = taken.withColumn(cut, F.explode(copies))
    text = F.when(F.col(cut) < 0, F.col(f"doc.`{text_column}`")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col(cut).cast("int")), ""))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_column: text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col(cut) < 0, F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(column.alias(name) for name, column in columns.items()))
