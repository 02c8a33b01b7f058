"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are the same after every run of ASCII white space became one space; null counts as empty.
Equality is decided on SHA-256 of the normalised text. Digests that a Misra-Gries sketch (Spark's `approx_top_k`, a
fixed number of counters per task) reports as frequent are counted exactly; their winners, at most `candidates` rows of
about 100 bytes, are broadcast and settle their groups where the rows are. All other digests take the ordinary shuffle,
whose groups are small because the large ones are gone.

Defined cases: of equal texts the row with the smallest id stays (a null id comes last; of rows equal in id and text one
stays, whichever); empty and null texts form one group; an empty table gives an empty result; other columns, whatever
their names, do not matter to `decide` and are kept by `drop_copies`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import SPACE, landed, text_of
from arqueo.llm.line_dedup import filter_of, marked

CANDIDATES = 1_000  # digests broadcast at most
COUNTERS = 10_000  # of each Misra-Gries sketch


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, f"{SPACE}+", " ").cast("binary"), 256)


def frequent(digests: DataFrame, candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """The digests (column `text_sha256`) that the sketch reports, at most `candidates` rows."""
    top = digests.agg(F.expr(f"approx_top_k(text_sha256, {candidates}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("x")).select(F.col("x.item").alias("text_sha256"))


def _winners(digests: DataFrame) -> DataFrame:
    """Per digest the row that stays, and how many rows there are. Combined on the map side."""
    return (digests.groupBy("text_sha256")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"),
                 F.count(F.lit(1)).alias("group_size"))
            .select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))


def decide(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = landed(docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                                 digest(text_of(text_column)).alias("text_sha256")))
    hot_digests = F.broadcast(frequent(digests, candidates, counters))
    hot = landed(_winners(digests.join(hot_digests, "text_sha256", "left_semi")))  # <= candidates rows, exact counts
    tail = digests.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    settled = digests.join(F.broadcast(hot), "text_sha256").unionByName(tail.join(_winners(tail), "text_sha256"))
    return settled.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns. A filter of fixed size over the digests that occur more than once lets all other rows
    through where they are; of the rest, copies of frequent digests are dropped in place and what is left of them moves."""
    marked_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_column).alias("doc_id"),
                              digest(text_of(text_column)).alias("text_sha256"))
    digests = landed(marked_rows.select("doc_id", "text_sha256", F.lit(0).alias("row")))
    hot_digests = F.broadcast(frequent(digests, candidates, counters))
    hot = landed(_winners(digests.join(hot_digests, "text_sha256", "left_semi")))
    tail = digests.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    copied = landed(_winners(tail).unionByName(hot).where("group_size > 1").select("text_sha256", "keep_id"))
    known = filter_of(copied.select(F.xxhash64("text_sha256").alias("digest_hash")), "digest_hash")
    met = marked(marked_rows.withColumn("digest_hash", F.xxhash64("text_sha256")), "digest_hash", known)
    often = F.broadcast(hot.select("text_sha256", F.col("keep_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    doubtful = met.where("passes").join(often, "text_sha256", "left").where(F.col("is_hot").isNull() | F.col("doc_id").eqNullSafe(F.col("hot_id")))
    found = doubtful.join(copied.withColumn("copied", F.lit(True)), "text_sha256", "left")
    kept = found.where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows with the same id and text tie for the first place.
    return met.where(~F.col("passes")).select("doc.*").unionByName(kept.dropDuplicates(["text_sha256"]).select("doc.*"))
