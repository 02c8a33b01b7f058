"""Scoring by a bigram model with Katz backoff.

Counts are taken from all training documents. A seen pair has its Good-Turing discounted count over the count of its
history; what the discounts free is spread over the words that the history was never seen with, in proportion to the
discounted unigrams, and the unigrams leave their freed part to the one class of unknown words. Both levels add up to 1
exactly: backoff(h) = freed(h) / (1 - sum of unigrams of the words seen after h).

    log p(text) = sum over tokens:  seen pair    log disc(c(h, w)) - log c(h)
                                    other        log freed'(h) - log c(h) + log p1(w)     (known h; freed' = freed x c(h))
                                    unknown h    log p1(w)

so -log c(h) is a matter of single words, the rest one of pairs. No document is joined token by token in the JVM. For every
chunk of texts, the distinct words (or pairs) and the documents of the chunk that have them are sent, as arrays, to the part of the
key space they belong to; there counts meet and every document's share is added up. Pairs go in `SLICES` passes, each over a part
of the key space and all texts, so that the shuffle of one pass is what the disk must hold. All pairs of a history
meet in one part, which so knows what its discounts free; only the unigrams of rare words are joined to it. Counts are kept as tables in
the shared folder.

Hot keys: the `HOT` most frequent words and pairs, at most 1 MB each, are broadcast. What documents get from them is added
where the documents are read, and their documents are not sent; the pairs of a history that is a hot word are spread over all parts.

Words are 64-bit hashes of their lower-case bytes (A-Z); a key that needs no more than that.

Defined cases: null counts as empty, which has the end token only; a null id counts as training; rows equal in id and text
have one score; without training documents every token is unknown and has probability 1; an empty table gives an empty
result; other columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm import words as W
from arqueo.llm.common import landed, release, text_of

END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A27557A27)
GOOD_TURING = 5  # counts up to this one are discounted by Good-Turing, larger ones by DELTA
DELTA = 0.5
HOT = 65_536
HOT_SHARE = 40_000  # a pair is a candidate for the hot ones where a chunk has it once in so many tokens
LEAST_HOT = 4  # and that often at least
SLICES = 3
CHUNK = 2_500_000  # bytes of text at once


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def pair_ids(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(history * np.uint64(0x9FB21C651E98DF25) + W.mix(word, 3), 5)


def pair_keys(history: np.ndarray, ids: np.ndarray, hot: "Known") -> np.ndarray:
    """Where pairs belong. All pairs of one history share the upper 24 bits, and so their part, unless the history is one of
    the hot words: those pairs are spread over all parts."""
    low = np.uint64(2 ** 40 - 1)
    return np.where(hot.find(history)[1], ids, (W.mix(history, 9) & ~low) | (ids & low))


def discounts(counts: dict[int, int]) -> list[float]:
    """Discounted counts for 1 to GOOD_TURING, from the numbers of items seen once, twice ...; where the estimate is not below the
    count or not above the one before, DELTA is taken off instead."""
    out = []
    for r in range(1, GOOD_TURING + 1):
        now, after = counts.get(r, 0), counts.get(r + 1, 0)
        guess = (r + 1) * after / now if now else 0.0
        out.append(guess if (out[-1] if out else 0.0) < guess < r else r - DELTA)
    return out


def discounted(count: Column, table: list[float]) -> Column:
    out = count - F.lit(DELTA)
    for r, value in enumerate(table, 1):
        out = F.when(count == r, F.lit(value)).otherwise(out)
    return out.cast("double")


class Chunk:
    """Tokens of one chunk: words and an end per document, and the histories of all."""

    def __init__(self, hasher: W.Words, data: np.ndarray, offsets: np.ndarray):
        words, counts = hasher.hashes(data, offsets)
        self.docs = len(counts)
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes)
        self.tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        inner = np.ones(len(self.tokens), bool)
        inner[ends - 1] = False
        self.tokens[inner] = words
        self.tokens[~inner] = END
        self.history = np.empty_like(self.tokens)
        self.history[1:] = self.tokens[:-1]
        self.history[ends - self.sizes] = START
        self.owner = np.repeat(np.arange(self.docs, dtype=np.int32), self.sizes)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the unsigned key, so keys in order are parts in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def part_of(key: str, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(F.col(key), 32) * F.lit(parts).cast("long"), 32).cast("int")


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `known` (rising) and whether the keys are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Known:
    """Looks keys up in a small set of them: the upper 20 bits say where to begin."""

    def __init__(self, known: np.ndarray):
        self.known = np.append(known, np.uint64(2 ** 64 - 1))
        places = (known >> np.uint64(44)).astype(np.int64)
        self.begins = np.searchsorted(places, np.arange(2 ** 20)).astype(np.int32)
        self.steps = int(np.bincount(places, minlength=1).max()) if len(known) else 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys and whether they are there."""
        at = self.begins[keys >> np.uint64(44)]
        for _ in range(self.steps):
            at += self.known[at] < keys
        there = (self.known[at] == keys) & (at < len(self.known) - 1)
        return np.where(there, at, 0), there


def _list(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.ListArray:
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return out


class Scorer:
    def __init__(self, docs: DataFrame, id_column: str, text_column: str):
        self.spark = docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        text = text_of(text_column)
        self.id_type = docs.schema[id_column].dataType
        self.docs = docs.select(F.xxhash64(F.col(id_column), text).alias("doc"), held_out(id_column).alias("held_out"), text.alias("text"), F.col(id_column).alias("doc_id"))

    # Words

    def count_words(self) -> None:
        """Words and candidates for hot pairs, counted in the training documents."""
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = W.Words()
            for batch, data, offsets in W.chunks(batches, 1, CHUNK):
                chunk = Chunk(hasher, data, offsets)
                training = ~np.asarray(batch.column(0))[chunk.owner]
                tokens, pairs = chunk.tokens[training], pair_ids(chunk.history, chunk.tokens)[training]
                out = []
                for kind, values in ((0, tokens), (1, pairs)):
                    values.sort()
                    first = runs(values)
                    counts = np.diff(np.append(first, len(values)))
                    if kind:
                        often = counts >= max(LEAST_HOT, len(values) // HOT_SHARE)
                        first, counts = first[often], counts[often]
                    out.append((np.full(len(first), kind, np.int32), values[first].view(np.int64), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "key", "c"])

        counts = landed(self.docs.select("held_out", "text").mapInArrow(counted, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")))
        self.words = counts.where("kind = 0").select("key", "c")
        self.total, self.distinct = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.documents = self.words.where(F.col("key") == int(END.view(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        self.word_discounts = discounts(self.seen_times(self.words))
        freed = self.words.agg(F.coalesce(F.sum(F.col("c") - discounted(F.col("c"), self.word_discounts)), F.lit(0.0))).first()[0]
        self.unknown = freed / self.total if self.total else 1.0
        self.hot_words = self.most(self.words)
        self.hot_pairs = np.sort(self.most(counts.where("kind = 1"))[0])

    @staticmethod
    def seen_times(counts: DataFrame) -> dict[int, int]:
        return dict(counts.where(F.col("c") <= GOOD_TURING + 1).groupBy("c").count().collect())

    @staticmethod
    def most(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Keys, rising, and counts of the most frequent ones; at most HOT rows."""
        top = counts.select("key", "c").orderBy(F.desc("c"), "key").limit(HOT).toPandas()
        keys, c = top["key"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
        order = np.argsort(keys)
        return keys[order], c[order]

    def word_values(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Base score, whether known, and -log10 of the count as a history, per word."""
        base = np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        history = np.where((counts > 0) & (keys != END), -np.log10(np.maximum(counts, 1)), 0.0)
        return np.stack([base, (counts > 0).astype(np.float64), history])

    def score_words(self) -> DataFrame:
        """doc, base, known, history: what documents get from the words that are not hot."""
        parts, hot, values_of = self.parts, self.spark.sparkContext.broadcast(self.hot_words[0]), self.values()

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, hot_words = W.Words(), Known(hot.value)
            for batch, data, offsets in W.chunks(batches, 1, CHUNK):
                chunk = Chunk(hasher, data, offsets)
                rare = ~hot_words.find(chunk.tokens)[1]
                yield from _packed(chunk.tokens[rare], chunk.owner[rare], np.asarray(batch.column(0)), parts)

        def answered(key, asked_rows, model):
            known = model["key"].to_numpy().view(np.uint64)
            order = np.argsort(known)
            known, counts = known[order], model["c"].to_numpy()[order]
            packed = []
            for keys, per_key, doc, names in zip(*(_flat(asked_rows[c]) for c in ("keys", "per_key", "docs", "names"))):
                keys = keys.view(np.uint64)
                at, there = find(known, keys)
                values = values_of(keys, np.where(there, counts[at], 0) if len(counts) else np.zeros(len(keys)))
                spread = np.repeat(values, per_key, axis=1)
                packed.append(_shares(names, *(np.bincount(doc, row, len(names)) for row in spread)))
            return pa.table([asked_rows["chunk"].cast(pa.int64()), pa.array(packed, pa.binary())], ["chunk", "shares"])

        requests = self.docs.select("doc", "text").mapInArrow(asked, REQUESTS)
        table = self.words.withColumn("part", part_of("key", parts))
        packed = requests.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answered, "chunk long, shares binary")
        shares = _of_documents(packed, {"base": "double", "known": "double", "history": "double"})
        return landed(shares.groupBy("doc").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("history").alias("history")))

    def values(self):
        """`word_values` without the tables of this object."""
        small = object.__new__(Scorer)
        small.total, small.distinct = self.total, self.distinct
        return small.word_values

    # Pairs

    def match_pairs(self, slice_: int) -> DataFrame:
        """One slice of the pairs, as rows of four kinds: (h, w, n) of the training pairs; chunk with, for its documents, the log of the larger
        counts and the numbers of pairs seen 1, 2 ... times; doc, h, w, n of pairs that were never seen; h with the numbers of its pairs seen 1, 2 ...
        times or more and the unigrams of those of its words that are hot."""
        width = -(-self.parts // SLICES)
        shared = self.spark.sparkContext.broadcast((*self.hot_words, self.hot_pairs))
        p1 = np.array([0.0, *self.word_discounts])
        total = max(self.total, 1)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, hot_words, hot_pairs = W.Words(), Known(shared.value[0]), Known(shared.value[2])
            for batch, data, offsets in W.chunks(batches, 2, CHUNK):
                chunk = Chunk(hasher, data, offsets)
                ids = pair_ids(chunk.history, chunk.tokens)
                keys = pair_keys(chunk.history, ids, hot_words)
                mine = np.flatnonzero(parts_of(keys, width * SLICES) // width == slice_)
                keys, owner, history, tokens = keys[mine], chunk.owner[mine], chunk.history[mine], chunk.tokens[mine]
                names = np.asarray(batch.column(0))
                hot_here = hot_pairs.find(ids[mine])[1]
                training = ~np.asarray(batch.column(1))[owner]
                for test in (False, True):
                    some = ~hot_here & (training != test)
                    yield from _packed(keys[some], owner[some], names, width * SLICES, history[some], tokens[some], test)
                some = hot_here & training  # counted, but no documents are sent
                yield from _packed(keys[some], owner[some], names, width * SLICES, history[some], tokens[some], False, True)

        def matched(key, rows):
            hot_words, hot_counts = Known(shared.value[0]), shared.value[1]
            lists = list(zip(*(_flat(rows[c]) for c in ("per_key", "docs", "names", "histories", "words"))))
            tests, silents, chunks = (rows[c].to_pylist() for c in ("test", "silent", "chunk"))
            shares = []
            keyed = [pair_keys(h.view(np.uint64), pair_ids(h.view(np.uint64), w.view(np.uint64)), hot_words) for *_, h, w in lists]
            taught = [i for i, test in enumerate(tests) if not test]
            keys, times, history, word = (np.concatenate([x[i] for i in taught]) if taught else np.empty(0, kind) for x, kind in (
                (keyed, np.uint64), ([x[0] for x in lists], np.int32), ([x[3] for x in lists], np.int64), ([x[4] for x in lists], np.int64)))
            order = np.argsort(keys)
            first = runs(keys[order])
            known, history, word = keys[order[first]], history[order[first]], word[order[first]]
            counts = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
            at, hot = hot_words.find(word.view(np.uint64))
            out = [_rows(PAIRS, history, word, counts, rare=~hot)]
            if len(known):
                c = hot_counts[at] if len(hot_counts) else np.zeros(len(at), np.int64)
                covered = np.where(hot, np.where(c > GOOD_TURING, c - DELTA, p1[np.minimum(c, GOOD_TURING)]) / total, 0.0)
                order = np.argsort(history)
                begins = runs(history[order])
                classes = np.stack([np.add.reduceat((np.minimum(counts, GOOD_TURING + 1) == r)[order].astype(np.int32), begins) for r in range(1, GOOD_TURING + 2)], axis=1)
                out.append(_rows(HISTORIES, history[order[begins]], value=np.add.reduceat(covered[order], begins), seen=classes))
            logs_of = np.log10(np.maximum(counts, GOOD_TURING + 1) - DELTA)
            for (per_key, doc, names, h, w), k, test, silent, chunk in zip(lists, keyed, tests, silents, chunks):
                if silent or not len(k):
                    continue
                at, there = find(known, k)
                c = np.where(there, counts[at], 0) if len(counts) else np.zeros(len(k), np.int64)
                logs = np.where(c > GOOD_TURING, logs_of[at], 0.0) if len(counts) else np.zeros(len(k))
                classes = np.bincount(doc * np.int64(GOOD_TURING + 2) + np.repeat(np.minimum(c, GOOD_TURING + 1), per_key), minlength=len(names) * (GOOD_TURING + 2))
                by_class = classes.reshape(-1, GOOD_TURING + 2)[:, 1:].T.astype(np.int32)
                shares.append((chunk, _shares(names, np.bincount(doc, np.repeat(logs, per_key), len(names)), *by_class)))
                if test:
                    unseen = np.repeat(c == 0, per_key)
                    out.append(_rows(UNSEEN, names[doc[unseen]], np.repeat(h, per_key)[unseen], np.repeat(w, per_key)[unseen]))
            if shares:
                chunks, packed = zip(*shares)
                out.append(_rows(SHARES, np.array(chunks, np.int64), shares=packed))
            return pa.concat_tables(out)

        return landed(self.docs.select("doc", "held_out", "text").mapInArrow(asked, PAIR_REQUESTS).groupBy("part").applyInArrow(matched, MATCHES))

    def log_unigrams(self) -> DataFrame:
        return self.words.select(F.col("key").alias("w"), (discounted(F.col("c"), self.word_discounts) / F.lit(float(max(self.total, 1)))).alias("p1"))

    def score(self) -> DataFrame:
        spark = self.spark
        self.count_words()
        from_words = self.score_words()
        release(spark)
        slices = []
        for slice_ in range(SLICES):
            slices.append(self.match_pairs(slice_))
            release(spark)
        found = slices[0]
        for table in slices[1:]:
            found = found.unionByName(table)
        pairs = found.where(F.col("kind") == PAIRS).select(F.col("a").alias("h"), F.col("b").alias("w"), "c", "rare")
        pair_discounts = discounts(self.seen_times(pairs))
        classes = [*SEEN, "more"]
        seen_in = [F.col("seen")[i].alias(c) for i, c in enumerate(classes)]
        rare = pairs.where("rare").join(self.log_unigrams(), "w").groupBy("h").agg(F.sum("p1").alias("covered"))
        histories = found.where(F.col("kind") == HISTORIES).select(F.col("a").alias("h"), F.col("value").alias("covered"), *seen_in)
        whole = landed(histories.unionByName(rare, allowMissingColumns=True).groupBy("h").agg(*(F.sum(c).alias(c) for c in ("covered", *classes))))
        release(spark)
        freed = F.col("more") * F.lit(DELTA) + sum((F.col(c) * F.lit(r - d) for r, (c, d) in enumerate(zip(SEEN, pair_discounts), 1)), F.lit(0.0))
        backoff = whole.select("h", F.log10(freed / (1 - F.col("covered"))).alias("backoff"))
        unseen = found.where(F.col("kind") == UNSEEN).select(F.col("a").alias("doc"), F.col("b").alias("h"), F.col("c").alias("w"))
        backed = (unseen.join(backoff, "h", "left").join(self.log_unigrams(), "w", "left").groupBy("doc")
                  .agg(F.sum(F.coalesce("backoff", F.lit(0.0)) + F.coalesce(F.log10("p1"), F.lit(math.log10(self.unknown or 1.0)))).alias("backed")))
        seen = sum((F.sum(c) * F.lit(math.log10(d)) for c, d in zip(SEEN, pair_discounts)), F.sum("value"))
        packed = found.where(F.col("kind") == SHARES).select(F.col("a").alias("chunk"), "shares")
        shares = _of_documents(packed, {"value": "double"} | dict.fromkeys(classes, "int"))
        matched = shares.groupBy("doc").agg(seen.alias("matched"))
        sums = landed(from_words.join(matched, "doc", "full").join(backed, "doc", "full"))
        release(spark)
        return self.finish(sums, pairs, pair_discounts)

    def finish(self, sums: DataFrame, pairs: DataFrame, pair_discounts: list[float]) -> DataFrame:
        """Reads the documents once more for what they get from hot words and pairs, and adds the rest."""
        shared = self.spark.sparkContext.broadcast(self.hot_pairs)
        hot_counts = np.zeros(len(self.hot_pairs), np.int64)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot_pairs = Known(shared.value)
            for batch in batches:
                keys = pair_ids(np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)).view(np.uint64))
                there = hot_pairs.find(keys)[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[there].view(np.int64)), batch.column(2).filter(pa.array(there))], ["key", "c"])

        often = pairs.where(F.col("c") >= LEAST_HOT).select("h", "w", "c")
        rows = often.mapInArrow(keyed, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toPandas()  # at most HOT
        at, there = find(self.hot_pairs, rows["key"].to_numpy(np.int64).view(np.uint64))
        hot_counts[at[there]] = rows["c"].to_numpy(np.int64)[there]
        logs = np.log10(np.where(hot_counts > GOOD_TURING, hot_counts - DELTA, np.array([1.0, *pair_discounts])[np.minimum(hot_counts, GOOD_TURING)]))
        shared = self.spark.sparkContext.broadcast((*self.hot_words, self.hot_pairs, logs))
        values_of, start = self.values(), -math.log10(self.documents) if self.documents else 0.0

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, (words, counts, pairs_, pair_logs) = W.Words(), shared.value
            values, words, pairs_ = values_of(words, counts), Known(words), Known(pairs_)
            for batch, data, offsets in W.chunks(batches, 1, CHUNK):
                chunk = Chunk(hasher, data, offsets)
                at, there = words.find(chunk.tokens)
                base, known, history = (np.bincount(chunk.owner[there], v[at[there]], chunk.docs) for v in values)
                at, there = pairs_.find(pair_ids(chunk.history, chunk.tokens))
                score = history + start + np.bincount(chunk.owner[there], pair_logs[at[there]], chunk.docs)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(chunk.sizes.astype(np.int64)),
                                                  *map(pa.array, (base, known, score))], HERE)

        kinds = [("doc", T.LongType()), ("doc_id", self.id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()),
                 *((c, T.DoubleType()) for c in ("base_here", "known_here", "score_here"))]
        here = self.docs.select("doc", "text", "doc_id", "held_out").mapInArrow(added, T.StructType([T.StructField(*k) for k in kinds]))
        here = landed(here)
        copies = here.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        part = {c: F.coalesce(F.col(c), F.lit(0.0)) / F.coalesce(F.col("copies"), F.lit(1)) for c in ("base", "known", "history", "matched", "backed")}
        return here.join(sums, "doc", "left").join(copies, "doc", "left").select(
            "doc_id", "held_out", "n_tokens", F.round(F.col("known_here") + part["known"]).cast("long").alias("n_known"),
            F.lit(self.total).cast("long").alias("train_tokens"), (F.col("base_here") + part["base"]).alias("base_score"),
            (F.col("score_here") + part["history"] + part["matched"] + part["backed"]).alias("score"))


HERE = ["doc", "doc_id", "held_out", "n_tokens", "base_here", "known_here", "score_here"]
SEEN = [f"c{r}" for r in range(1, GOOD_TURING + 1)]
_SENT = "part int, chunk long, per_key array<int>, docs array<int>, names array<long>"
REQUESTS = _SENT + ", keys array<long>"
PAIR_REQUESTS = _SENT + ", histories array<long>, words array<long>, test boolean, silent boolean"
MATCHES = "kind int, a long, b long, c long, rare boolean, value double, seen array<int>, shares binary"
PAIRS, SHARES, UNSEEN, HISTORIES = range(4)  # kinds of rows: h, w, count; chunk; doc, h, w; h
_TYPES = {"double": np.dtype(np.float64), "int": np.dtype(np.int32)}


def _shares(names: np.ndarray, *columns: np.ndarray) -> bytes:
    """What one part has for the documents of one chunk: their names, then each column."""
    return b"".join(np.ascontiguousarray(values).tobytes() for values in (names, *columns))


def _of_documents(packed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """doc and the sums of its columns, from (chunk, shares). All parts send a chunk one row, and they meet by chunk; so no row per document and
    part is ever made, and a group is bounded by the documents of a chunk."""
    kinds = [_TYPES[kind] for kind in columns.values()]
    width = 8 + sum(kind.itemsize for kind in kinds)

    def summed(rows):
        names, found = [], [[] for _ in kinds]
        for share in rows["shares"].to_pylist():
            n, at = len(share) // width, 0
            for out, kind in zip((names, *found), (np.dtype(np.int64), *kinds)):
                out.append(np.frombuffer(share, kind, n, at))
                at += n * kind.itemsize
        docs, place = np.unique(np.concatenate(names), return_inverse=True)
        sums = (np.bincount(place, np.concatenate(values), len(docs)).astype(kind) for values, kind in zip(found, kinds))
        return pa.table([pa.array(docs), *map(pa.array, sums)], ["doc", *columns])

    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return packed.groupBy("chunk").applyInArrow(summed, f"doc long, {schema}")


def _packed(keys: np.ndarray, owner: np.ndarray, names: np.ndarray, parts: int, history: np.ndarray | None = None,
            words: np.ndarray | None = None, test: bool = False, silent: bool = False) -> Iterator[pa.RecordBatch]:
    """One row per part: its distinct keys in order (of pairs the two words), how often each comes, and the document of each time as a
    place in `names`; no documents if `silent`."""
    if not len(keys):
        return
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    per_key = np.diff(np.append(first, len(keys)))
    part = parts_of(keys[first], parts)
    begins = runs(part)
    key_bounds = np.append(begins, len(first))
    entries = np.append(first, len(keys))[key_bounds]
    docs = owner[order]
    own_names, name_bounds, here = [], [0], np.zeros(len(names), bool)
    if silent:
        docs, bounds = docs[:0], np.zeros(len(entries), np.int64)
        own_names, name_bounds = [names[:0]], [0] * len(entries)
    else:
        bounds = entries
        for a, b in zip(entries[:-1], entries[1:]):
            here[:] = False
            here[docs[a:b]] = True
            docs[a:b] = (np.cumsum(here) - 1)[docs[a:b]]
            own_names.append(names[here])
            name_bounds.append(name_bounds[-1] + len(own_names[-1]))
    chunk = W.mix(names.view(np.uint64), 7).sum(dtype=np.uint64).view(np.int64)  # chunks with one number would only meet in one group
    columns = [pa.array(part[begins]), pa.array(np.full(len(begins), chunk)), _list(per_key.astype(np.int32), key_bounds), _list(docs, bounds), _list(np.concatenate(own_names), np.array(name_bounds))]
    if history is None:
        yield pa.RecordBatch.from_arrays([*columns, _list(keys[first], key_bounds)], ["part", "chunk", "per_key", "docs", "names", "keys"])
    else:
        at = order[first]
        columns += [_list(history[at], key_bounds), _list(words[at], key_bounds), pa.array([test] * len(begins)), pa.array([silent] * len(begins))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "per_key", "docs", "names", "histories", "words", "test", "silent"])


def _rows(kind: int, a: np.ndarray, b=None, c=None, rare=None, value=None, seen=None, shares=None) -> pa.Table:
    def column(values, type_=pa.int64()):
        return pa.nulls(len(a), type_) if values is None else pa.array(values, type_)

    ints = pa.list_(pa.int32())
    lists = pa.nulls(len(a), ints) if seen is None else pa.ListArray.from_arrays(
        pa.array(np.arange(len(a) + 1, dtype=np.int32) * (GOOD_TURING + 1)), pa.array(seen.astype(np.int32).ravel()))
    return pa.table([pa.array(np.full(len(a), kind, np.int32)), *map(column, (a, b, c)), column(rare, pa.bool_()), column(value, pa.float64()), lists, column(shares, pa.binary())],
                    ["kind", "a", "b", "c", "rare", "value", "seen", "shares"])


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    return Scorer(docs, id_column, text_column).score()
