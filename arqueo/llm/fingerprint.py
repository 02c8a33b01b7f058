"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs, long ones cut at sentence ends. Each is hashed to a wide vector: 16 lanes of
64 random bits, summed modulo 2^64, and 256 lanes of +1 or -1, summed modulo 2^32. A document's fingerprint is the sum of
its vectors, so it does not depend on their order, and adding or taking out a paragraph adds or takes away its
vector. Equal multisets have equal fingerprints; the first part tells different ones apart, and the cosine of the
second part estimates how much of the two multisets is common.

Defined cases: null counts as empty, the fingerprint of which is zero; the likeness of equal fingerprints is 1, that of
an empty and another text 0; rows with the same id are taken in the order of their texts; null ids come after all
others; the only row of a table follows itself; an empty table gives an empty result; other columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import text_of

WIDE, SIGNS = 16, 256
UNIT = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")
SLICE_CHARS = 1_000_000
_ODD = np.arange(1, 2 * WIDE, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def units(text: str) -> list[str]:
    """Paragraphs, cut at sentence ends; white space around them does not matter."""
    return [u for u in map(str.strip, UNIT.findall(text)) if u]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums per text: (n, WIDE) uint64 and (n, SIGNS) uint32."""
    from xxhash import xxh3_128_digest

    parts = [units(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    wide, signs = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), SIGNS), np.uint32)
    seeds = np.frombuffer(b"".join(xxh3_128_digest(u) for p in parts for u in p), np.uint64).reshape(-1, 2)
    if len(seeds):
        lanes = _mix(seeds[:, :1] * _ODD + _mix(seeds[:, 1:] + _ODD))
        bits = np.unpackbits(_mix(lanes[:, :SIGNS // 64] ^ seeds[:, 1:]).view(np.uint8), axis=1)
        some = counts > 0
        first = (np.cumsum(counts) - counts)[some]
        wide[some] = np.add.reduceat(lanes, first, axis=0)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        signs[some] = (2 * ones - counts[some, None]).astype(np.uint32)
    return wide, signs


def to_hex(wide: np.ndarray, signs: np.ndarray) -> list[str]:
    return [(a.astype("<u8").tobytes() + b.astype("<u4").tobytes()).hex() for a, b in zip(wide, signs)]


def from_hex(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [bytes.fromhex(f) for f in fingerprints]
    return (np.array([np.frombuffer(r[:WIDE * 8], "<u8") for r in raw]).reshape(-1, WIDE),
            np.array([np.frombuffer(r[WIDE * 8:], "<u4") for r in raw]).reshape(-1, SIGNS))


def insert(fingerprint: str, text: str, times: int = 1) -> str:
    """The fingerprint with the paragraphs of `text` put in `times` times; taken out if negative."""
    wide, signs = from_hex([fingerprint])
    more_wide, more_signs = vectors([text])
    factor = np.array(times).astype(np.uint64), np.array(times).astype(np.uint32)
    return to_hex(wide + more_wide * factor[0], signs + more_signs * factor[1])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.clip(np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0), 0, 1)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, cosine)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_hex(*vectors([text]))[0] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(hashed, schema)


def edited_text(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows sorted by id inside ranges of the id, each range followed by the first row of the next (`ghost`), the last range
    by the very first row. The cuts are ids of the table, as many as there are shuffle partitions; texts move once."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    least, cuts = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).first()
    edges = np.unique(np.array([least, *cuts] if cuts else [], np.int64))  # first id of each range

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            values = np.asarray(ids.fill_null(0))
            last = max(len(edges) - 1, 0)
            place = np.where(known, np.searchsorted(edges, values, "right") - 1, last)
            first = known & np.isin(values, edges)
            ghosts = np.nonzero(first)[0]
            take = pa.array(np.concatenate([np.arange(len(values)), ghosts]))
            before = (place[ghosts] - 1) % max(len(edges), 1)
            flags = np.repeat([0, 1], [len(values), len(ghosts)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place, before]), pa.int64()), pa.array(flags, pa.int32()),
                                              ids.take(take), batch.column(1).take(take)], ["place", "ghost", "doc_id", "text"])

    return (rows.mapInArrow(dealt, "place long, ghost int, doc_id long, text string").repartition(parts, "place")
            .sortWithinPartitions("place", "ghost", F.col("doc_id").asc_nulls_last(), "text"))


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of the text edited with the next row's, and both likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finished(rows: list, texts: list) -> pa.RecordBatch:
        """`rows` are positions in `texts` whose following text is the next one, and their ids."""
        at = np.array([r[0] for r in rows])
        follow = np.array([r[1] for r in rows])
        edits = [edited_text(texts[a], texts[b]) for a, b in zip(at, follow)]
        own, changed = vectors(texts), vectors(edits)
        mine, following = tuple(v[at] for v in own), tuple(v[follow] for v in own)
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for r in rows], pa.int64()), pa.array([len(texts[a]) for a in at], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]),
            pa.array(to_hex(*mine)), pa.array(to_hex(*changed)),
            pa.array(likeness(mine, changed)), pa.array(likeness(mine, following))], names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        held = first = None  # the row that waits for the next one; the first text of the range
        def close():
            """A range without a follower (no id anywhere): its first text follows."""
            texts.extend([held[2], first])
            rows.append((len(texts) - 2, len(texts) - 1, held[1]))

        for batch in batches:
            for place, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != place:
                    close()
                    held = None
                if held is None and not ghost:
                    first = text
                if held is not None:
                    if not texts or texts[-1] is not held[2]:
                        texts.append(held[2])
                    texts.append(text)
                    rows.append((len(texts) - 2, len(texts) - 1, held[1]))
                    size += len(text)
                held = None if ghost else (place, doc_id, text)
                if size > SLICE_CHARS:
                    yield finished(rows, texts)
                    rows, texts, size = [], [], 0
        if held is not None:
            close()
        if rows:
            yield finished(rows, texts)

    return in_order(docs, id_column, text_column).mapInArrow(
        compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
