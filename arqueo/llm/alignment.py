"""Alignment of the tokens of two tokenizers, over Arrow arrays.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces, which adds the space itself) the text. Tokens of a
chunk of texts are flat arrays with parent indices; segmented cumulative sums of their byte lengths give where each ends in its
document, and an Acero hash join on (document, end) finds the links: pairs of an A and a B token that end together. These ends cut
both token sequences into groups.

`Table.group_by` counts the id pairs of a chunk, Spark adds the counts up over all chunks and sends each chunk the totals of its own
pairs, so no task ever holds the pairs of all documents. The aligned chunks are written to the shared folder in between; a
document's links are kept as places in its chunk's list of pairs. A chunk is `CHUNK_BYTES` of text, or one longer text.

Tokens of A come from the rank form of the vocabulary through `tiktoken`; a text that it cannot split is encoded by `tokenizers`. Strings of
special tokens in a text are plain text for both.

Defined cases: a text that is null or empty, or that one of the tokenizers does not keep byte by byte (B reads U+2581 as a space, for
instance), has no tokens: all numbers 0, the digest empty; repeated rows are aligned, and counted, each; an empty table
gives an empty result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import landed
from arqueo.llm.packing import encoding, vocabulary_path
from arqueo.llm.words import chunks

SPACE_MARK = "▁"
CHUNK_BYTES = 1_500_000  # text aligned at once
PAIR_BASE = 1 << 32  # a pair of ids is one number: A's id times this, plus B's


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class BytePairs:
    """Tokenizer A and the bytes of its tokens."""

    def __init__(self, path: str):
        self.path, self.ranks, self.whole = path, encoding(path), None
        self.bytes = pa.array([self.ranks.decode_single_token_bytes(i) for i in range(self.ranks.n_vocab)], pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # the splitting pattern exceeded its stack
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path.removesuffix(".tiktoken") + ".json")
                self.whole.encode_special_tokens = True
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def tokens(self, texts: list[str]) -> pa.LargeListArray:
        ids = [self.encode(f" {text}") for text in texts]
        return listed(np.concatenate(ids) if ids else [], [len(i) for i in ids])


class Pieces:
    """Tokenizer B and the bytes of its tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = pa.array(
            [bytes.fromhex(piece[3:5]) if self.model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode() for i, piece in enumerate(pieces)],
            pa.large_binary())

    def tokens(self, texts: list[str]) -> pa.LargeListArray:
        ids = self.model.encode(texts, num_threads=1)
        return listed(np.fromiter(chain.from_iterable(ids), np.int64), [len(i) for i in ids])


def listed(values: np.ndarray, counts: list[int]) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *counts])), pa.array(np.asarray(values, np.int64)))


def ends_of(lists: pa.LargeListArray, token_bytes: pa.Array) -> tuple[pa.Table, np.ndarray, pa.Buffer]:
    """Tokens as rows (doc, end, id, place), where each document's bytes end, and the bytes."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    spelled = token_bytes.take(ids)
    total = pc.cumulative_sum(pc.binary_length(spelled))
    upto = np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()]
    end = pc.subtract(total, pa.array(upto[:-1]).take(doc))
    table = pa.table({"doc": doc, "end": end, "id": ids, "place": pa.array(np.arange(len(ids)))})
    return table, upto, spelled.buffers()[2] or pa.py_buffer(b"")


def kept(spelled: pa.Buffer, upto: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Which documents have exactly the wanted bytes."""
    view = memoryview(spelled).cast("B")
    return np.array([view[a:b] == text for a, b, text in zip(upto[:-1].tolist(), upto[1:].tolist(), wanted)], bool)


def spelled_groups(a: pa.Table, b: pa.Table, doc_count: int, common: np.ndarray, start: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The groups of all documents as text, one after the other, and where each document's text ends. `common` are the shared
    ends, rising, counted over all documents; `start` is where each document's bytes start in that count."""
    sides = []
    for table in (a, b):
        doc = table["doc"].to_numpy()
        end = table["end"].to_numpy() + start[doc]
        sides.append((doc, end, np.searchsorted(common, end), table["id"].to_numpy()))
    (doc_a, end_a, group_a, ids_a), (doc_b, end_b, group_b, ids_b) = sides
    size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    at_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    marks = np.zeros(len(ids), np.int8)
    marks[at_a[end_a == common[group_a]]] = 1
    marks[at_b[end_b == common[group_b]]] = 2
    per_doc = np.bincount(doc_a, minlength=doc_count) + np.bincount(doc_b, minlength=doc_count)
    stops = np.cumsum(per_doc)
    marks[stops[per_doc > 0] - 1] = 3
    after = pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(marks))
    text = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.large_string()), after, pa.scalar("", pa.large_string()))
    places = np.frombuffer(text.buffers()[1], np.int64)
    return memoryview(text.buffers()[2] or b""), np.concatenate([[0], places[stops]])


def align_texts(texts: list[str | None], first: BytePairs, second: Pieces, spell: bool = False) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """One row per text (n_a, n_b, n_groups, groups_sha256, links as places in the list of pairs, groups as text if `spell`), the pairs
    of the texts, and how often each holds a link."""
    said = [text or "" for text in texts]
    tables, good = [], np.array([bool(text) for text in said], bool)
    wanted = [b" " + text.encode() if text else b"" for text in said]
    for tokenizer in (first, second):
        table, upto, spelled = ends_of(tokenizer.tokens(said), tokenizer.bytes)
        good &= kept(spelled, upto, wanted)
        tables.append(table)
    usable = pa.array(good)
    a, b = (table.filter(usable.take(table["doc"])) for table in tables)
    n_a, n_b = (np.bincount(table["doc"].to_numpy(), minlength=len(texts)) for table in (a, b))
    a, b = (table.set_column(3, "place", pa.array(np.arange(len(table)))) for table in (a, b))
    links = a.join(b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by([("place", "ascending"), ("place_b", "ascending")])
    doc = links["doc"].to_numpy()
    start = np.cumsum([0, *map(len, wanted)])[:-1]
    shared = links["end"].to_numpy() + start[doc] if len(links) else np.empty(0, np.int64)
    new = np.ones(len(shared), bool)
    new[1:] = shared[1:] != shared[:-1]
    n_links, n_groups = np.bincount(doc, minlength=len(texts)), np.bincount(doc[new], minlength=len(texts))
    text, stops = spelled_groups(a, b, len(texts), shared[new], start)
    digests = [hashlib.sha256(text[i:j]).hexdigest() if i < j else "" for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]
    coded = pc.dictionary_encode(pc.add(pc.multiply(links["id"], PAIR_BASE), links["id_b"]).combine_chunks())
    counted = pa.table({"pair": coded.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    columns = {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": pa.array(digests, pa.string()),
        "links": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_links]), pa.int32()), coded.indices),
    }
    if spell:
        columns["groups"] = [bytes(text[i:j]).decode() for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]
    return pa.table(columns), coded.dictionary.to_numpy(), counted["count_all"].to_numpy()


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
          pieces: str | None = None, spell: bool = False) -> DataFrame:
    """One row per document: chunk, doc_id, n_a, n_b, n_groups, groups_sha256 (of `a1,a2|b1;a3|b2,b3`: ids of each group), links (places in the
    pairs of the chunk) and `groups` (that text) if `spell`. The first row of a chunk has its pairs and their counts."""
    paths = vocabulary or vocabulary_path(), pieces or piece_path()
    id_type = docs.schema[id_column].dataType
    long, some = T.LongType(), T.ArrayType(T.LongType())
    fields = [("chunk", long), ("doc_id", id_type), ("n_a", long), ("n_b", long), ("n_groups", long), ("groups_sha256", T.StringType()),
              ("links", T.ArrayType(T.IntegerType())), ("groups", T.StringType()), ("pairs", some), ("counts", some)]
    fields = [f for f in fields if spell or f[0] != "groups"]
    names = [f[0] for f in fields]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = BytePairs(paths[0]), Pieces(paths[1])
        task = TaskContext.get().partitionId() << 32
        for number, (rows, _, _) in enumerate(chunks(batches, size=CHUNK_BYTES)):
            table, pairs, counts = align_texts(rows.column(1).to_pylist(), *tokenizers, spell)
            more = [None] * (rows.num_rows - 1)
            table = (table.add_column(0, "chunk", pa.array([task | number] * rows.num_rows)).add_column(1, "doc_id", rows.column(0))
                     .append_column("pairs", pa.array([pairs, *more], pa.list_(pa.int64())))
                     .append_column("counts", pa.array([counts, *more], pa.list_(pa.int64()))))
            yield from table.select(names).combine_chunks().to_batches()
            del table, pairs, counts
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(aligned, schema)


def asked(aligned: DataFrame) -> DataFrame:
    """The pairs of each chunk: chunk, place, pair, n."""
    lists = aligned.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    return lists.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Over all documents: pair, a, b, count, and whether no other pair of the B id holds more links."""
    totals = landed(asked(aligned).groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", F.lit(PAIR_BASE))))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(most, "b").select("pair", F.shiftright("pair", 32).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"))


def compare(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links of which no pair with the same B id holds more links in all
    documents), count_sum (over the links: links of all documents that hold the same pair), groups_sha256."""
    aligned = landed(align(docs, id_column, text_column, vocabulary, pieces))
    totals = pair_counts(aligned).select("pair", "count", "best")
    answers = asked(aligned).join(totals, "pair").select("chunk", "place", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def answered(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs["place"].to_numpy())
        links = mine["links"].combine_chunks()
        offsets = links.offsets.to_numpy()
        place = links.values.to_numpy()
        columns = {}
        for name, kind in (("best", np.int64), ("count", np.int64)):
            values = theirs[name].to_numpy().astype(kind)[order][place]
            columns[name] = np.concatenate([[0], np.cumsum(values)])[offsets]
        sums = {"n_links": np.diff(offsets), "n_best": np.diff(columns["best"]), "count_sum": np.diff(columns["count"])}
        for name, values in sums.items():
            mine = mine.append_column(name, pa.array(values.astype(np.int64)))
        return mine.select(names)

    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)] + [T.StructField(n, long) for n in names[1:-1]]
                          + [T.StructField("groups_sha256", T.StringType())])
    documents = aligned.select(F.col("chunk").alias("part"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return documents.groupBy("part").cogroup(answers.groupBy("chunk")).applyInArrow(answered, schema)
