"""N-gram Jaccard join with multiple-global-order filtering.

A document is the set of its distinct shingles of five words. Two sets with a Jaccard of 0.8 share a token in their
prefixes (the first n - ceil(0.8 n) + 1 tokens) under every global order, so a candidate pair must do so under all of
`ORDERS` different ones before its sets are compared in full. All shingles of all texts are counted in a sketch of `WIDTH`
counters; in each order those that stand out of it come last, by powers of two, so passages that many documents share are
rarely in a prefix. Among equals the order is a hash of the shingle, another one each time. What else falls on a counter changes
the order only, never the result.

Equal sets are one node (its id is a 64-bit hash of the set). Nodes that share a prefix token form a bucket; buckets of the
same nodes are one. Not all pairs of a bucket are compared: first each node meets one pivot of the bucket, and what is linked
becomes one component; in later rounds only nodes of different components meet. As soon as the pairs that share a bucket and
lie in different components are no more than `DIRECT` per row that the buckets had at first, or a pivot no longer halves them, all of
them are compared, so no link between components is lost. Rows bring the prefix of the second order along, one token of which linked
sets share too, so that a pair is dropped where it is met. A bucket with more than `CROWDED` pairs per row is split by those tokens first,
in slices that write no more rows than the prefixes of the first order had.

Defined cases: fewer than five words are one shingle; no words (or null) is an empty set that links with nothing; a null id
has the smallest non-null id of its component, or null; repeated rows are one node; an empty table gives an empty result; other columns
are ignored by `join_groups` and kept by `one_of_each`.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm import words as W
from arqueo.llm.common import discard, landed, release, text_of
from arqueo.llm.components import components

PERCENT = 80  # two sets link when 100 x common >= PERCENT x union
ORDERS = 3
WIDTH = 2 ** 22  # counters of the sketch: 16 MB while they are summed, 4 MB broadcast
BLOCK = 2 ** 14  # counters that are summed together
FAN = 1_024  # tasks whose sketches one group sums: at most 100 MB
ROUNDS = 6  # pivots at most before the rest is compared pair by pair
FILTER_BITS = 2 ** 26  # 8 MB: sets that are wanted for comparison
SLICE_BYTES = 2_000_000  # text whose sets a task works out at once
DIRECT = 4  # pairs that are compared at once, per row that the buckets have at first
CROWDED = 64  # pairs per row of a bucket from which it is split


def prefix_length(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(size > 0, size + 1 + (-percent * size // 100), 0)


def _prefix_rows_of(rows: DataFrame) -> int:
    """How many tokens the prefixes of all rows have."""
    length = F.col("size") + 1 - F.ceil(F.col("size").cast("long") * PERCENT / 100)
    return rows.agg(F.sum(F.when(F.col("size") > 0, length))).first()[0] or 0


class Sets:
    """Shingle sets of batches of texts, and their prefixes."""

    def __init__(self, levels: np.ndarray | None = None):
        self.words = W.Words()
        self.levels = levels  # how common the shingles of each counter are

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return W.distinct(*W.shingle_hashes(*self.words.hashes(data, offsets)))

    @staticmethod
    def names(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A hash per set; the sum does not depend on the order."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values, 11))])
        ends = np.cumsum(counts)
        return W.mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64), 13).view(np.int64)

    def ranks(self, values: np.ndarray, order: int) -> np.ndarray:
        """The place of shingles in a global order: the level, then a hash."""
        return (W.mix(values, 100 + order) >> np.uint64(8)) | (self.levels[_counter(values)].astype(np.uint64) << np.uint64(56))

    def prefixes(self, values: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the prefixes, in their order, and how many each set has."""
        ranks = self.ranks(values, order)
        lengths = prefix_length(counts)
        ends = np.cumsum(counts)
        picked = np.empty(int(lengths.sum()), np.int64)
        place = 0
        for first, last, length in zip((ends - counts).tolist(), ends.tolist(), lengths.tolist()):
            if length:
                part = ranks[first:last]
                least = np.argpartition(part, length - 1)[:length]
                picked[place:place + length] = first + least[np.argsort(part[least])]
                place += length
        return values[picked], lengths


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, size, node (null without words) of every row."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch, data, offsets in W.chunks(batches, size=SLICE_BYTES):
            values, counts = sets.of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(Sets.names(values, counts), mask=counts == 0)], ["doc_id", "size", "node"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("size", T.LongType()), T.StructField("node", T.LongType())])
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(named, schema)


def _counter(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(WIDTH)).view(np.int64)


def shingle_levels(texts: DataFrame) -> np.ndarray:
    """For every counter the power of two by which its texts stand out of the middle counter's (0: they do not). Each task sends
    what it counted in blocks; blocks are summed for `FAN` tasks at a time, then for all."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counters = Sets(), np.zeros(WIDTH, np.uint32)
        for _, data, offsets in W.chunks(batches, 0, SLICE_BYTES):
            np.add.at(counters, _counter(sets.of(data, offsets)[0]), np.uint32(1))
        for block in range(WIDTH // BLOCK):
            part = counters[block * BLOCK:(block + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                                  pa.array([part[at].tobytes()], pa.binary())], ["block", "places", "counts"])

    def summed(key, rows):
        total = np.zeros(BLOCK, np.uint64)
        for places, counts in zip(rows["places"], rows["counts"]):
            total[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), np.uint32)
        at = np.flatnonzero(total)
        most = np.minimum(total[at], 2 ** 32 - 1).astype(np.uint32)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                         pa.array([most.tobytes()], pa.binary())], ["block", "places", "counts"])

    schema = "block int, places binary, counts binary"
    found = texts.mapInArrow(counted, schema).withColumn("some", F.expr(f"spark_partition_id() div {FAN}"))
    found = found.groupBy("block", "some").applyInArrow(summed, schema).groupBy("block").applyInArrow(summed, schema)
    counters = np.zeros((WIDTH // BLOCK, BLOCK), np.uint32)
    for block, places, counts in found.collect():  # at most 6 bytes per counter
        counters[block, np.frombuffer(places, np.uint16)] = np.frombuffer(counts, np.uint32)
    return levels_of(counters)


def levels_of(counters: np.ndarray) -> np.ndarray:
    """Levels of all counters, a block (row) at a time: the driver holds no wider copy of them."""
    middle, levels = float(np.median(counters)), np.empty(counters.shape, np.uint8)
    for out, part in zip(levels, counters):
        out[:] = np.log2(1 + np.maximum(part.astype(np.int64) - middle, 0) / (2 + 2 * middle ** 0.5))
    return levels.ravel()


def _prefix_rows(texts: DataFrame, levels) -> DataFrame:
    """(token, node, place, size) for the prefixes under the first order: `place` tokens of the set come before this one."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(levels.value)
        for _, data, offsets in W.chunks(batches, 0, SLICE_BYTES):
            values, counts = sets.of(data, offsets)
            tokens, lengths = sets.prefixes(values, counts, 0)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.repeat(Sets.names(values, counts), lengths)),
                                              pa.array(places.astype(np.int32)), pa.array(np.repeat(counts, lengths).astype(np.int32))], ["token", "node", "place", "size"])

    return texts.mapInArrow(rows, "token long, node long, place int, size int")


def _may_link(place: str, size: str, other_place: str, other_size: str) -> Column:
    """Two sets whose first common token is here have no more in common than what follows it in either."""
    common = F.least(F.col(size) - F.col(place), F.col(other_size) - F.col(other_place)).cast("long")
    return common * (100 + PERCENT) >= (F.col(size).cast("long") + F.col(other_size)) * PERCENT


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """One bit for each node, FILTER_BITS bits in all: which sets are wanted, and by chance some others."""
    place = F.pmod("node", F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    found = (nodes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())  # at most FILTER_BITS / 8 bytes
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, part in found:
        at = (bucket - 1) * 4096
        bits[at:at + len(part)] = np.frombuffer(part, np.uint8)[:len(bits) - at]
    return bits


def _wanted(texts: DataFrame, wanted: DataFrame, columns, schema: str) -> DataFrame:
    """One row per wanted node: node and what `columns` makes of its set. Texts are not moved: each task works out its sets again and
    sends something of those that are wanted."""
    bits = texts.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for _, data, offsets in W.chunks(batches, 0, SLICE_BYTES):
            values, counts = sets.of(data, offsets)
            names = Sets.names(values, counts)
            place = names % FILTER_BITS
            once = np.zeros(len(names), bool)
            once[np.unique(names, return_index=True)[1]] = True
            passed = once & (counts > 0) & (bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            arrays = columns(values[np.repeat(passed, counts)], counts[passed])
            yield pa.RecordBatch.from_arrays([pa.array(names[passed]), *arrays], ["node", *(f"c{i}" for i in range(len(arrays)))])

    return texts.mapInArrow(found, f"node long, {schema}").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _prefixes_of(texts: DataFrame, wanted: DataFrame, levels) -> DataFrame:
    """node, its prefixes under all orders but the first, and the share of its shingles that do not
    stand out. Half a hash is enough to pass all pairs that share a token."""
    def columns(values: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        sets = Sets(levels.value)
        found = (sets.prefixes(values, counts, k) for k in range(1, ORDERS))
        owner = np.repeat(np.arange(len(counts)), counts)
        rare = np.bincount(owner, sets.levels[_counter(values)] == 0, len(counts)) / np.maximum(counts, 1)
        return [*(_array(tokens.astype(np.uint32).view(np.int32), lengths) for tokens, lengths in found), pa.array(rare)]

    fields = [f"c{k} array<int>" for k in range(ORDERS - 1)] + [f"c{ORDERS - 1} double"]
    return _wanted(texts, wanted, columns, ", ".join(fields)).withColumnRenamed(f"c{ORDERS - 1}", "rare")


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    return _wanted(texts, wanted, lambda values, counts: [_array(values.view(np.int64), counts)], "c0 array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. Filters first: sizes, then prefixes under all other orders; then the sets."""
    size = nodes.select("node", "size")
    sized = (pairs.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
             .where(f"100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b)").select("a", "b"))
    names = [f"c{k}" for k in range(ORDERS - 1)]
    prefixes = prefixes.drop("rare")
    met = sized.join(prefixes.toDF("a", *(f"{c}_a" for c in names)), "a").join(prefixes.toDF("b", *(f"{c}_b" for c in names)), "b")
    for c in names:
        met = met.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    near = landed(met.select("a", "b"))
    wanted = landed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    del met, sized
    release(texts.sparkSession)
    sets = landed(_sets_of(texts, wanted))
    release(texts.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    links = landed(both.mapInArrow(linked, "a long, b long"))
    del both
    discard(near, wanted, sets)
    release(texts.sparkSession)
    return links


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for first, last in zip(offsets[:-1], offsets[1:]):
        yield values[first:last]


def _with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _linkable(met: DataFrame) -> DataFrame:
    """(a, b) of the pairs of rows whose sizes and places allow a link."""
    return met.where(_may_link("place", "size", "other_place", "other_size")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _meeting(rows: DataFrame, *on: str) -> DataFrame:
    """Rows of different components that agree in `on`; the columns of one are named `other...`. Both sides are made by the same
    steps, so that Spark shuffles the rows once."""
    def side(prefix: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"{prefix}{c}") for c in (*on, *(c for c in rows.columns if c not in on))))

    first, other = side("one_"), side("other_")
    both = first.join(other, [first[f"one_{c}"] == other[f"other_{c}"] for c in on]).where("one_component < other_component")
    return both.withColumnsRenamed({"one_node": "node", "one_place": "place", "one_size": "size", "other_node": "other"})


def _all_pairs(rows: DataFrame, crowded: DataFrame, others: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of all pairs of different components that share a bucket and may link. `crowded` (token) are the buckets with
    more pairs than their rows are compared in."""
    spark, crowded = rows.sparkSession, landed(crowded)
    near = others.select("node", F.col("c0").alias("tokens"))
    met = _meeting(rows.join(crowded, "token", "left_anti").join(near, "node").select("token", "node", "component", "place", "size", "tokens"), "token")
    found = [landed(_linkable(met.where(_may_link("place", "size", "other_place", "other_size")).where(F.arrays_overlap("one_tokens", "other_tokens"))))]
    del met
    release(spark)
    rest = rows.join(crowded, "token").select("token", "node", "component", "place", "size")
    slices = -(-_prefix_rows_of(rest) // max(1, _prefix_rows_of(nodes)))
    for part in range(slices):
        mine = rest.where(F.pmod(F.xxhash64("token", F.lit(slices)), F.lit(slices)) == part)
        split = mine.join(near, "node").select("token", F.explode("tokens").alias("second"), "node", "component", "place", "size")
        found.append(landed(_linkable(_meeting(split, "token", "second"))))
        del mine, split
        release(spark)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def node_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have links. `docs` (doc_id, text), `nodes` (node, size, doc_id)."""
    texts = docs.select("text")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(texts))
    release(docs.sparkSession)
    prefixes = _prefix_rows(texts, levels)
    shared = prefixes.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    buckets = landed(prefixes.join(shared, "token").distinct())
    del prefixes, shared
    release(docs.sparkSession)
    # A row that could link with no other of its bucket is left out: of two rows that is known, of more a bound is.
    about = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest"), F.sum("size").alias("sizes"), F.sum("place").alias("places"),
                                         F.bit_xor(F.xxhash64("node")).alias("members"))
    rest = (buckets.join(about, "token").withColumn("other_size", F.col("sizes") - F.col("size")).withColumn("other_place", F.col("places") - F.col("place")))
    bound = (F.col("size") - F.col("place")).cast("long") * (100 + PERCENT) >= (F.col("size").cast("long") + F.col("smallest")) * PERCENT
    # Near copies share many tokens, whose buckets hold the same nodes. These become one, named by a hash of its nodes, with the earliest
    # place of each: that is where the first common token of any two of them is. Different ones under one hash would be joined, which loses no pair.
    viable = landed(rest.where(F.when(F.col("n") == 2, _may_link("place", "size", "other_place", "other_size")).otherwise(bound))
                    .groupBy(F.xxhash64("members", "n").alias("token"), "node").agg(F.min("place").alias("place"), F.min("size").alias("size")))
    discard(buckets)
    wanted = landed(viable.select("node").distinct())
    others = landed(_prefixes_of(texts, wanted, levels))
    buckets = landed(viable.join(others.select("node", "rare"), "node"))
    discard(viable, wanted)
    links, found, tested, pairs_before = None, None, None, float("inf")
    for turn in range(ROUNDS + 1):
        everywhere = landed(_with_component(buckets, found))
        mixed = everywhere.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        rows = landed(everywhere.join(mixed, "token"))
        discard(everywhere, buckets)
        buckets = rows.drop("component")  # components only grow, so a bucket within one is done with
        buckets.landed_path = rows.landed_path
        per_component = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        per_token = per_component.groupBy("token").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"), F.sum("n").alias("n"))
        count, pairs_left = per_token.agg(F.sum("n"), F.sum("twice") / 2).first()
        if not count:
            break
        if turn == 0:
            few = DIRECT * count
        last = turn == ROUNDS or pairs_left <= few or pairs_left > pairs_before / 2
        pairs_before = pairs_left
        if last:
            pairs = _all_pairs(rows, per_token.where(f"twice > 2 * {CROWDED} * n").select("token"), others, nodes)
        else:
            # The first pivot is the node with fewest shingles of its own, as the original of a family of copies has; then any.
            order = F.struct("rare", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)))
            pivot = rows.groupBy("token").agg(F.min_by(F.struct("node", "component", "place", "size"), order).alias("pivot"))
            met = rows.join(pivot, "token").where(F.col("component") != F.col("pivot.component")).select(
                "node", "place", "size", F.col("pivot.node").alias("other"), F.col("pivot.place").alias("other_place"), F.col("pivot.size").alias("other_size"))
            pairs = _linkable(met)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = landed(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = _verified(pairs, nodes, texts, others)
        links = new if links is None else links.unionByName(new)
        before, settled = found, components(links)
        found = landed(settled)
        discard(settled, *([] if before is None else [before]))
        release(docs.sparkSession)
        if last:
            break
    discard(others, buckets)
    return found if found is not None else nodes.select("node", F.col("node").alias("component")).where("false")


def _grouped(named: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, component, component_id, first) of every node; `first` is the node of the component's document that stays."""
    nodes = landed(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size")))
    found = node_components(docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")), nodes)
    grouped = _with_component(nodes, found)
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"))
    return grouped.join(first, "component").select("node", "component", F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("first"))


def join_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, node (the id of its set), component, component_id (the smallest id that
    links lead to)."""
    named = landed(_named(docs, id_column, text_column))
    of_node = _grouped(named, docs, id_column, text_column)
    with_words = named.where("node is not null").join(of_node, "node")
    without = named.where("node is null").select("doc_id", "size", "node", F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    return (with_words.select("doc_id", "size", "node", "component", "component_id").unionByName(without)
            .withColumnRenamed("size", "n_shingles"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one document of each component, that with the smallest id; documents without words stay. Of rows equal
    in id and set one stays."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    fields = [T.StructField("doc", row_type(docs)), T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("node", T.LongType())]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch, data, offsets in W.chunks(batches, 2, SLICE_BYTES):
            values, counts = sets.of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(Sets.names(values, counts), mask=counts == 0)], ["doc", "doc_id", "node"])

    marked = docs.select(row.alias("doc"), F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(named, T.StructType(fields))
    rows = landed(_named(docs, id_column, text_column))
    of_node = _grouped(rows, docs, id_column, text_column)
    counts = rows.where("node is not null").join(of_node.select("node", "component"), "node").groupBy("component").count().where("count > 1")
    groups = landed(of_node.join(counts, "component"))  # of more than one row
    met = marked.join(groups.select("node", "component", "component_id", "first"), "node", "left")
    single = met.where("component is null").select("doc.*")
    stays = met.where(F.col("component").isNotNull() & (F.col("node") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return single.unionByName(stays.dropDuplicates(["component"]).select("doc.*"))


def row_type(docs: DataFrame) -> T.StructType:
    return T.StructType(docs.schema.fields)
