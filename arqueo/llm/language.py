"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed from left to
right into phrases, each the longest match in the language's sample; the phrases, times the bits that point to a place in
the sample, per character, are the text's cross entropy to the language, and the smallest one wins.

Texts are parsed in blocks of `BLOCK` characters, all blocks of a batch and all languages at once: one table look-up per
byte and language moves an automaton on and says whether a phrase ended. Only the sample is bounded; every text is
read whole. Letters are lower-cased, marks on them are kept, anything between them counts as one space. What is parsed are
the UTF-8 bytes, so letters of every script are told apart and the tables have at most 256 columns.

Defined cases: `und` with score 0 where the text is null or has no letter; ties go to the language that sorts first;
bytes that no sample has cost a phrase in every language; without any labelled text all is `und`; repeated rows are
predicted alike; an empty table gives an empty result; other columns are ignored.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm import words as W
from arqueo.llm.common import text_of

SAMPLE_ROWS = 400  # labelled rows per language, those with the smallest hash of their id
SAMPLE_CHARS = 300  # of each, from a place that the hash picks
LANGUAGE_CHARS = 30_000  # of each language's automaton
BLOCK = 256  # bytes
SLICE_BYTES = 500_000  # text parsed at once
PAD, SPACE_CODE, OTHER = 0, 1, 2
SPACE = ord(" ")


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
           rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language -> text; at most `rows` x `chars` characters per language reach the driver."""
    place = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    text = text_of(text_column)
    first = F.pmod(place, F.greatest(F.length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    known = labelled.where(F.col(label_column).isNotNull())
    label = F.col(label_column).cast("string").alias("label")
    # Only rows whose hash is small enough for the place to be among the first come to the ranking: about 8 x `rows` per label
    # however many there are.
    counts = known.select(label).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    share = F.pmod(place, F.lit(2 ** 40)) / F.lit(float(2 ** 40))
    parts = (known.select(label, share.alias("place"), F.substr(text, first, F.lit(chars)).alias("part")).join(counts, "label")
             .where(F.col("place") * F.col("count") < 8.0 * rows).select("label", "place", "part"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place", "part"))
    found = parts.withColumn("rank", rank).where(F.col("rank") <= rows).orderBy("label", "rank").select("label", "part").collect()
    texts: dict[str, list[str]] = {}
    for label, part in found:
        texts.setdefault(label, []).append(part)
    return {label: " ".join(parts) for label, parts in texts.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for code in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in moves[state]:
            moves[state][code] = new
            state = link[state]
        if state >= 0:
            after = moves[state][code]
            if length[after] == length[state] + 1:
                link[new] = after
            else:
                twin = len(moves)
                moves.append(dict(moves[after]))
                length.append(length[state] + 1)
                link.append(link[after])
                while state >= 0 and moves[state].get(code) == after:
                    moves[state][code] = twin
                    state = link[state]
                link[after] = link[new] = twin
        last = new
    return moves


class Model:
    """Codes of bytes and one table for the automata of all languages. Entry `state + code` holds the next state
    (as its row in the table) times four, plus the phrases that end."""

    def __init__(self, texts: dict[str, str], chars: int = LANGUAGE_CHARS):
        self.languages = sorted(texts)
        every = [chr(i) for i in range(0x110000)]
        self.letter = np.array([c.isalpha() for c in every])
        mark = np.array([unicodedata.category(c)[0] == "M" for c in every])
        self.points = np.where(self.letter | mark, np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in every], np.uint32), SPACE)
        samples = [self.normal([texts[language]])[0][:chars] for language in self.languages]
        encoded = [utf8(points) for points in samples]
        scripts = {script(chr(p)) for points in samples for p in np.unique(points).tolist() if self.letter[p]}
        self.familiar = np.array([letter and script(c) in scripts for c, letter in zip(every, self.letter.tolist())])
        own = np.unique(np.concatenate([np.empty(0, np.uint8), *encoded]))
        own = own[own != SPACE]
        self.codes = np.full(256, OTHER, np.uint16)
        self.codes[own] = OTHER + 1 + np.arange(len(own))
        self.codes[SPACE] = SPACE_CODE
        self.width = OTHER + 1 + len(own)
        small = 2 * sum(len(e) + 1 for e in encoded) * self.width * 4 < 2 ** 31  # an automaton has at most two states a byte
        self.table = np.empty(0, np.int32 if small else np.int64)
        tables, self.roots, self.bits, base = [], [], [], 0
        for points, sample_bytes in zip(samples, encoded):
            moves = suffix_automaton(self.codes[sample_bytes].tolist())
            next_state = np.full((len(moves), self.width), -1, np.int64)
            for state, found in enumerate(moves):
                next_state[state, list(found)] = list(found.values())
            restart = next_state[0]
            known = restart >= 0
            ended = np.where(np.arange(len(moves)) > 0, 1, 0)[:, None]
            table = np.where(next_state >= 0, (next_state + base) * self.width * 4,
                             np.where(known, (restart + base) * self.width * 4 + ended, base * self.width * 4 + ended + 1))
            table[:, PAD] = (np.arange(len(moves)) + base) * self.width * 4
            tables.append(table.ravel().astype(self.table.dtype))
            self.roots.append(base * self.width)
            self.bits.append(np.log2(max(2, len(points))))
            base += len(moves)
        self.table = np.concatenate([self.table, *tables])
        self.roots = np.array(self.roots, self.table.dtype)

    def normal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased letters of all texts in one array, what is between them as one space; characters per text, 0 where
        there is no letter."""
        read = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = self.points[read]
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        space = points == SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[starts[lengths > 0]] = True
        owner_end = np.concatenate([[0], np.cumsum(keep)])
        kept = owner_end[starts + lengths] - owner_end[starts]
        letters = np.concatenate([[0], np.cumsum(self.letter[read])])
        has = letters[starts + lengths] > letters[starts]
        keep &= np.repeat(has, lengths)
        return points[keep], np.where(has, kept, 0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per language and text; characters per text after normalising (0: no letter)."""
        points, characters = self.normal(texts)
        ends = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])[np.cumsum(characters)]
        lengths = np.diff(ends, prepend=0)
        codes = self.codes[utf8(points)]
        blocks = -(-lengths // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        lanes = np.zeros(int(blocks.sum()) * BLOCK, np.uint16)
        within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lanes[np.repeat(first_block * BLOCK, lengths) + within] = codes
        steps = np.ascontiguousarray(lanes.reshape(-1, BLOCK).T)
        state = np.repeat(self.roots[:, None], steps.shape[1], axis=1)
        ended = np.zeros(state.shape, np.int32)
        for step in steps:
            found = self.table[state + step]
            ended += found & 3
            state = found >> 2
        ended += state != self.roots[:, None]
        total = np.zeros((len(self.roots), len(texts) + 1), np.int64)
        owner = np.repeat(np.arange(len(texts)), blocks)
        for language in range(len(self.roots)):
            total[language] = np.bincount(owner, ended[language], len(texts) + 1)
        return total[:, :-1], characters

    def has_familiar(self, texts: list[str]) -> list[bool]:
        """Whether a letter of the text is of a script that a sample has."""
        read = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.concatenate([[0], np.cumsum(self.familiar[read])])
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return (np.diff(found[ends], prepend=0) > 0).tolist()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score (how much fewer bits than the second best, 0 to 1) and whether a letter is of a sample's script."""
        counts, lengths = self.phrases([t or "" for t in texts])
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        bits = counts * np.array(self.bits)[:, None] / np.maximum(lengths, 1)
        best = bits.argmin(axis=0)
        ordered = np.sort(bits, axis=0)
        second = ordered[1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(lengths > 0, 1 - ordered[0] / np.maximum(second, 1e-12), 0.0)
        languages = [self.languages[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist())]
        return languages, np.clip(score, 0, 1).tolist(), self.has_familiar([t or "" for t in texts])


def utf8(points: np.ndarray) -> np.ndarray:
    return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


def script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    return Model(sample(docs.where(F.col(id_column).isNotNull() & ~held_out(id_column)), id_column, text_column, label_column))


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_familiar (whether a letter is of a script that a labelled sample has)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x LANGUAGE_CHARS
    at = docs.columns.index(text_column)
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
              T.StructField("lang_familiar", T.BooleanType())]
    names = [f.name for f in fields]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in W.chunks(batches, at, SLICE_BYTES):
            languages, scores, familiar = shared.value.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar, pa.bool_())], names)

    return docs.mapInArrow(predicted, T.StructType(fields))


def reject(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """The rows whose text has a language, with the columns of `docs`: `und` goes, and text without a label of which no
    letter is of a script that a labelled text has. How short or how unusual a text is does not matter."""
    model = train(docs, id_column, text_column, label_column)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text_column).alias("text"),
                      F.col(label_column).isNotNull().alias("labelled"))
    known = predict(row, model).where((F.col("lang_pred") != "und") & (F.col("labelled") | F.col("lang_familiar")))
    return known.select("doc.*")
