"""Periodic runs of words, by Baier's grouping of suffixes.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least `least_words` and
`least_periods` * q words long, that no neighbouring word extends. Its first q words are kept and the rest may be dropped.

Phase one of Baier's suffix sorter puts suffixes into groups that share their longest Lyndon prefix, from the highest group
down; the length of a group's prefix when its turn comes is the Lyndon array at its suffixes. Done under the order of the words and
under the opposite order, this yields two Lyndon words per position, and each run has one of them as a root. Roots are extended to both
sides by longest common extensions (exact names of all stretches of 1, 2, 4 ... words) to full runs.

Only stretches in which every window of eight words occurs again in the same document are searched: a run of 24 words or more and
three periods or more consists of such windows, so none is lost. `least_words` and `least_periods` must not be below these values.
Everything happens where a document is read: nothing is shuffled. Texts are handled in chunks of a few megabytes; a longer
text is a chunk of its own. Words are compared as 64-bit hashes.

Defined cases: a null or empty text has no words, no run and an empty rest; repeated rows give the same result each; of runs with
the same exponent the first in the text, then the one with the smaller period counts; an empty table gives an empty result; other
columns are ignored by `find` and kept by `collapse`.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.words import Words, chunks, mix

WINDOW = 8
LEAST_WORDS = 24
LEAST_PERIODS = 3


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by phase one of Baier's grouping."""
    n = len(ranks)
    members: list[list[int]] = []  # of each group, rising; those that have moved on are passed over
    above: list[int] = []
    below: list[int] = []
    length: list[int] = []
    group = [0] * n
    by_rank: dict[int, list[int]] = defaultdict(list)
    for at, rank in enumerate(ranks):
        by_rank[rank].append(at)
    for number, rank in enumerate(sorted(by_rank)):
        places = by_rank[rank]
        members.append(places)
        below.append(number - 1)
        above.append(number + 1)
        length.append(1)
        for at in places:
            group[at] = number
    if members:
        above[-1] = -1
    longest = [0] * n
    previous = [-2] * n  # nearest place before in a lower group; -2 until the group's turn
    turn = len(members) - 1
    while turn >= 0:
        size = length[turn]
        grown: dict[int, dict[int, list[int]]] = {}  # group -> times the prefix follows -> places
        last, times = -1, 0

        def note(place: int, times: int) -> None:
            lists = grown.setdefault(group[place], {})
            if times in lists:
                lists[times].append(place)
            else:
                lists[times] = [place]

        for at in members[turn]:
            if group[at] != turn:
                continue
            place = at - 1
            while place >= 0:
                before = previous[place]
                if before == -2:
                    break
                place = before
            previous[at] = place
            longest[at] = size
            if place == last:
                times += 1
            else:
                if last >= 0:
                    note(last, times)
                last, times = place, 1
        if last >= 0:
            note(last, times)
        for old, lists in grown.items():
            under = old
            for times in sorted(lists):
                new = len(members)
                places = lists[times]
                members.append(places)
                length.append(length[old] + times * size)
                over = above[under]
                above.append(over)
                below.append(under)
                above[under] = new
                below[over] = new  # there is one: the group whose turn it is stands above
                under = new
                for place in places:
                    group[place] = new
        turn = below[turn]
    return longest


class Extensions:
    """Longest common extensions: names of all stretches of 2^k symbols, equal for equal stretches. `longest` bounds an extension."""

    def __init__(self, symbols: np.ndarray, longest: int):
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
        self.levels = [names]
        width = 1
        while 2 * width <= longest:
            follower = np.zeros(len(names), np.int64)
            follower[:-width] = names[width:].astype(np.int64) + 1
            names = np.unique(names.astype(np.int64) << 32 | follower, return_inverse=True)[1].astype(np.int32)
            self.levels.append(names)
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from `a` and from `b` on. The symbols end with one that occurs nowhere else."""
        a, b = a.copy(), b.copy()
        done = np.zeros(len(a), np.int64)
        last = len(self.levels[0]) - 1
        for level in reversed(range(len(self.levels))):
            names, width = self.levels[level], 1 << level
            same = np.flatnonzero(names[np.minimum(a, last)] == names[np.minimum(b, last)])
            a[same] += width
            b[same] += width
            done[same] += width
        return done

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal up to and with `a` and `b`, backwards (`a` < `b`)."""
        a, b = a.copy(), b.copy()
        done = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            names, width = self.levels[level], 1 << level
            room = np.flatnonzero(a - width + 1 >= 0)
            same = room[names[a[room] - width + 1] == names[b[room] - width + 1]]
            a[same] -= width
            b[same] -= width
            done[same] += width
        return done


def runs(symbols: np.ndarray, longest: int | None = None, least_words: int = LEAST_WORDS,
         least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. `longest` bounds the length of a run, where it is known."""
    n = len(symbols)
    if n < least_words:
        return np.empty((0, 3), np.int64)
    longest = min(longest or n, n)
    ranks = np.unique(symbols, return_inverse=True)[1]
    ended = np.append(ranks, ranks.max() + 1)  # a last symbol that occurs nowhere else
    shared = Extensions(ended, longest)
    found = []
    for order in (ranks, -ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        first = np.arange(n)
        follows = ended[np.minimum(first + period, n)] == ended[first]
        precedes = (first > 0) & (ended[np.maximum(first - 1, 0)] == ended[first + period - 1])
        first = np.flatnonzero((period * least_periods <= longest) & (follows | precedes))
        period = period[first]
        start = first - shared.left(first - 1, first + period - 1)
        length = first - start + period + shared.right(first, first + period)
        whole = length >= np.maximum(least_words, least_periods * period)
        found.append(np.stack([start, period, length], axis=1)[whole])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def candidates(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [first, last) of words in which every window of `WINDOW` words occurs again in its text and which can hold a run."""
    if len(words) < LEAST_WORDS:
        return []
    text = np.repeat(np.arange(len(counts)), counts)
    windows = np.zeros(len(words) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        windows += mix(words[k:len(words) - WINDOW + 1 + k], k + 1)
    inside = np.flatnonzero(text[:len(windows)] == text[WINDOW - 1:])
    keys = mix(windows[inside] + mix(text[inside].astype(np.uint64) + np.uint64(1), 3))
    order = np.argsort(keys)
    twins = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(words) + 1, bool)
    again[inside[order[1:][twins]]] = True
    again[inside[order[:-1][twins]]] = True
    edges = np.zeros(len(words) + 2, np.int8)
    edges[1:-1] = again[:-1]
    steps = np.diff(edges)
    begins, stops = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    long = stops - begins >= LEAST_WORDS - WINDOW + 1
    return [(int(a), int(b) + WINDOW - 1) for a, b in zip(begins[long], stops[long])]


def chunk_runs(words: np.ndarray, counts: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all texts of a chunk: rows (start among the chunk's words, length, period), and the text of each."""
    parts = candidates(words, counts)
    if not parts:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64)
    names = np.unique(np.concatenate([words[a:b] for a, b in parts]), return_inverse=True)[1]
    between = int(names.max()) + 1  # symbols that occur once stand between the stretches, so no run crosses them
    pieces, places, begin = [], [], 0
    for number, (a, b) in enumerate(parts):
        pieces += [names[begin:begin + b - a], [between + number]]
        places += [np.arange(a, b), [-1]]
        begin += b - a
    found = runs(np.concatenate(pieces), max(b - a for a, b in parts), least_words, least_periods)
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found, np.searchsorted(np.cumsum(counts), found[:, 0], "right")


def kept_words(total: int, found: np.ndarray) -> np.ndarray:
    """False for the words that some run contains after its first period."""
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def exact_words() -> Words:
    """Word hashes that tell upper from lower case."""
    words = Words()
    words.numbers = mix(np.arange(1, 257, dtype=np.uint64), 7)
    return words


def searched_chunks(batches: Iterator[pa.RecordBatch], least_words: int, least_periods: int, column: int = 1) -> Iterator[tuple]:
    """Of each chunk: its rows, words before each text, runs, their texts, the kept words as bytes joined by spaces, and where each text's end."""
    hashing = exact_words()
    for rows, data, offsets in chunks(batches, column):
        words, counts = hashing.hashes(data, offsets)
        found, text = chunk_runs(words, counts, least_words, least_periods)
        kept = kept_words(len(words), found)
        inside = hashing.inside[data]
        edge = np.ones(len(data) + 1, bool)
        np.logical_not(inside[:-1], out=edge[1:-1])
        edge[offsets] = True
        starts = np.flatnonzero(inside & edge[:-1])
        edge[:-1] |= ~inside
        ends = np.flatnonzero(inside & edge[1:]) + 1
        before = np.concatenate([[0], np.cumsum(counts)])
        number = np.concatenate([[0], np.cumsum(kept)])
        last = np.zeros(len(words) + 1, bool)  # the last kept word of a text has no space after it
        of_text = number[before[1:]]
        some = of_text > number[before[:-1]]
        last[np.flatnonzero(kept)[of_text[some] - 1]] = True
        spaced = kept & ~last[:-1]
        change = np.zeros(len(data) + 2, np.int8)
        change[starts[kept]] += 1
        change[ends[kept] + spaced[kept]] -= 1
        copied = np.cumsum(change[:-2], dtype=np.int8).astype(bool)
        clean = data.copy()
        clean[ends[spaced]] = 32
        length = np.concatenate([[0], np.cumsum(copied)])
        yield rows, before, found, text, clean[copied].tobytes(), length[offsets]


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS,
         least_periods: int = LEAST_PERIODS, keep_runs: bool = True) -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, runs (array of start, length,
    period, if `keep_runs`), runs_sha256 (of `start,length,period` and a line feed for each) and collapsed_sha256 (of the kept words, joined by one space)."""
    if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
        raise ValueError(f"runs have at least {LEAST_WORDS} words and {LEAST_PERIODS} periods")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, before, found, text, clean, length in searched_chunks(batches, least_words, least_periods):
            found[:, 0] -= before[text]
            firsts = np.searchsorted(text, np.arange(rows.num_rows + 1))
            best, digests, rest = [], [], []
            for row, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
                mine = found[a:b].tolist()
                top = None
                for run in mine:  # rising by start and period, so the first of equals stays
                    if top is None or run[1] * top[2] > top[1] * run[2]:
                        top = run
                best.append((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2]))
                digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest())
                rest.append(hashlib.sha256(clean[length[row]:length[row + 1]]).hexdigest())
            columns = [rows.column(0), pa.array(np.diff(firsts)), *(pa.array([b[k] for b in best], pa.int64()) for k in range(4))]
            if keep_runs:
                values = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], ["start", "length", "period"])
                columns.append(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), values))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests), pa.array(rest)], names)

    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    fields = [("doc_id", docs.schema[id_column].dataType), *((name, T.LongType()) for name in ("n_runs", "start", "length", "period", "exponent_milli")),
              ("runs", T.ArrayType(run)), ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]
    fields = [f for f in fields if keep_runs or f[0] != "runs"]
    names = [f[0] for f in fields]
    schema = T.StructType([T.StructField(*f) for f in fields])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(searched, schema)


def collapse(docs: DataFrame, text_column: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """`docs` with the repetitions of every run dropped; a text without a run, and null, stay as they are."""
    names = docs.columns
    place = names.index(text_column)
    if not isinstance(docs.schema[text_column].dataType, T.StringType):
        raise ValueError(f"{text_column} must hold strings")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, text, clean, length in searched_chunks(batches, least_words, least_periods, place):
            has = np.zeros(rows.num_rows, bool)
            has[text] = True
            old = rows.column(place).to_pylist()
            new = [clean[length[k]:length[k + 1]].decode() if has[k] else old[k] for k in range(rows.num_rows)]
            columns = list(rows.columns)
            columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(shortened, docs.schema)
