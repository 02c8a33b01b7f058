"""Packing by power-of-two decomposition.

A document's tokens are split into pieces whose lengths are the binary digits of their number: full pieces of `longest`
tokens, then falling powers of two. Each piece is a sequence of its own, so no sequence crosses documents and none needs
padding; sequences of one length belong to one bucket, which is the highest part of the sequence id. Everything
happens where the document is read: nothing is shuffled and no table grows with the input.

Tokens come from the byte-level BPE vocabulary `byte_bpe_50k`, read in its rank form by `tiktoken`: the same ids as those
of `tokenizers` on the JSON form (tested), several times faster. A text that `tiktoken` cannot split (a run of about a million
white-space characters exceeds its stack) is encoded by `tokenizers` itself. `<|endoftext|>` in a text is its own token there, as here.

Defined cases: a null or empty text is the end token alone; repeated ids are packed once per row; a null id stays null; an
empty table gives an empty result; other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import text_of

LONGEST = 2048
END = 1  # id after each document
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The tokenizer, kept by tiktoken's registry for the life of the Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    from tiktoken.registry import ENCODINGS

    if path not in ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ENCODINGS[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return ENCODINGS[path]


def encoder(path: str):
    """A function from text to ids."""
    ranks = encoding(path)
    whole = []

    def encode(text: str) -> np.ndarray:
        try:
            return ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the splitting pattern exceeded its stack
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json"))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def binary_lengths(total: int, longest: int = LONGEST) -> list[int]:
    """Falling powers of two, at most `longest` each, that add up to `total`."""
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << bit for bit in reversed(range(longest.bit_length() - 1)) if rest >> bit & 1]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST,
         vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per sequence: doc_id, start, length, ids (array<int>, if `keep_ids`), ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id, offset. `longest` is a power of two."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = vocabulary or vocabulary_path()
    id_type = docs.schema[id_column].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId()
        numbers = [0] * longest.bit_length()  # sequences of each length so far in this task
        for batch in batches:
            rows, firsts, lengths, sums, totals, sequences, kept = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), END).astype("<u4")
                start = 0
                for length in binary_lengths(len(ids), longest):
                    bucket = length.bit_length() - 1
                    rows.append(row)
                    firsts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[start:start + length]))
                    totals.append(len(ids))
                    sequences.append(bucket << 58 | task << 32 | numbers[bucket])
                    numbers[bucket] += 1
                    start += length
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (firsts, lengths))]
            if keep_ids:
                values = np.concatenate(kept) if kept else np.empty(0, "<u4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values.view(np.int32))))
            columns += [pa.array(x, pa.int64()) for x in (sums, totals, sequences, [0] * len(rows))]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [("doc_id", id_type), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.ArrayType(T.IntegerType())),
              ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    fields = [f for f in fields if keep_ids or f[0] != "ids"]
    names = [f[0] for f in fields]
    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(pieces, schema)
