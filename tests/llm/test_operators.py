"""Each operator against a plain Python version on small tables with every odd case: nulls, empty and very long texts,
ties, repeated rows, empty tables, other columns with clashing names."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.llm import components, exact_dedup, fingerprint, katz, language, line_dedup, mixing, near_join, packing, pages, personal
from arqueo.llm.common import landed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, doc string"


def texts(seed=1, count=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["über", "ça", "niño", "The", "the"]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    out = [some(rng.randint(1, 80)) for _ in range(count)]
    out += [None, "", " \n\t ", "one", "a b c d", "a b c d e", out[0], out[0].replace(" ", "\n\t "), out[1] + "  ", some(6000), "x" * 50_000, "Line one here\n" * 300]
    near = some(100).split()
    for i in range(6):
        copy = list(near)
        copy[i * 15] = f"edit{i}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 7 == 0], len(t or ""), 5, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[0], rows[3], (None, "no id here at all", "en", "s1", 1, 1, None, None), (None, "no id here at all", "en", "s1", 1, 1, None, None)]
    rows.append((2, "another text under the same id", "de", "s2", 1, 1, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# Exact copies

def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("candidates", [1, 1000])
def test_exact_copies(docs, candidates):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(normal(r.text).encode()).hexdigest()].append(r.doc_id)
    found = exact_dedup.decide(docs, candidates=candidates).collect()
    assert len(found) == len(rows)
    for sha, ids in groups.items():
        mine = [r for r in found if r.text_sha256 == sha]
        first = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {(r.keep_id, r.group_size) for r in mine} == {(first, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [first]
    kept = exact_dedup.drop_copies(docs, candidates=candidates)
    assert kept.columns == docs.columns
    assert sorted(hashlib.sha256(normal(r.text).encode()).hexdigest() for r in kept.collect()) == sorted(groups)


# Mix

def plain_targets(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def test_mix(docs):
    sizes = Counter()
    rows = docs.select("doc_id", "source", "text").collect()
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    aims = plain_targets(sizes)
    found = mixing.mix(docs).select("doc.source", "doc_id", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    for source, size in sizes.items():
        mine = [r for r in found if r.source == source]
        assert all(r.source_size == size and math.isclose(r.target, aims[source], rel_tol=1e-12) for r in mine)
        assert sum(r.taken for r in mine) == round(aims[source])
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        for a, b in ((min(r.taken // r.size for r in mine if r.size), max(-(-r.taken // r.size) for r in mine if r.size)),):
            assert b - a <= 1
    again = mixing.mix(docs.repartition(7)).select("doc.source", "doc_id", "size", "source_size", "target", "taken")
    assert collected(again, *again.columns) == sorted((tuple(r) for r in found), key=str)


def test_mixed_rows_have_the_words_taken(docs):
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("source", "text", "n_chars").collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    expected = Counter()
    for r in mixing.mix(docs).select("doc.source", "taken").collect():
        expected[r.source] += r.taken
    assert +words == +expected
    originals = [r.text or "" for r in docs.select("text").collect()]
    assert all(any(t.startswith(r.text or "") for t in originals) for r in mixed.select("text").collect())


# Packing

def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = docs.sparkSession.createDataFrame([(900, "a <|endoftext|> b", *[None] * 6), (901, "😀 ​ \x00 end ", *[None] * 6), (902, "word " * 5000, *[None] * 6)], SCHEMA)
    everything = docs.where("doc_id > 3").unionByName(extra)
    pieces = defaultdict(list)
    found = packing.pack(everything).collect()
    for p in found:
        pieces[p.doc_id].append(p)
    for r in everything.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert [i for p in mine for i in p.ids] == ids
        for p in mine:
            assert p.doc_tokens == len(ids) and p.length == len(p.ids) <= 2048 and p.length & (p.length - 1) == 0 and p.offset == 0
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
    assert len({p.sequence_id for p in found}) == len(found)
    assert all(p.sequence_id >> 58 == p.length.bit_length() - 1 for p in found)


def test_very_long_white_space_is_packed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "two words" + " " * 2_000_000 + "end"), (2, "a<|endoftext|>" + "\n" * 2_000_000), (3, "a short text")]
    pieces = defaultdict(list)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        pieces[p.doc_id].append((p.start, p.ids))
    for doc_id, text in rows:
        assert [i for _, ids in sorted(pieces[doc_id]) for i in ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_repeated_rows_are_packed_each(docs):
    some = docs.where("doc_id = 0 or doc_id is null")
    found = packing.pack(some, keep_ids=False)
    assert found.agg(F.sum("length")).first()[0] == sum(r[0] for r in found.groupBy("doc_id", "doc_tokens").agg((F.sum("length")).alias("n")).select("n").collect())
    assert found.select("sequence_id").distinct().count() == found.count()


# Language

def phrases(text, sample):
    """Greedy longest matches, by substring search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    samples = {k: "".join(rng.choice(letters) for _ in range(400)) for k, letters in (("a", "abcd "), ("b", "cdef "))}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    model = language.Model(samples)
    queries = ["abcd dcba abc", "fed cdef", "zzz", "", "12 3", "ab" * 100, "a z b"]
    counts, lengths = model.phrases(queries)
    for i, query in enumerate(queries):
        if not re.search("[a-z]", query):
            assert lengths[i] == 0
            continue
        for row, name in enumerate(model.languages):
            assert counts[row][i] == phrases(query, samples[name]), (query, name)
    long = "abc dcb" * 200  # longer than a block
    assert model.phrases([long])[0][0][0] >= phrases(long, samples["a"])


def test_language_of_every_row(spark, none):
    rng = random.Random(5)
    vocabularies = {"xx": ["tar", "melo", "sint", "vara"], "yy": ["gru", "hok", "bzim", "plok"]}
    rows = [(i, " ".join(rng.choice(vocabularies[lang]) for _ in range(40)), lang) for i in range(120) for lang in [["xx", "yy"][i % 2]]]
    rows += [(500, None, "xx"), (501, "12 !! \n", "yy"), (502, "", None), (503, "Ж", None), (None, "gru hok hok", None), (1, rows[1][1], "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(docs, language.train(docs)).collect()
    assert len(found) == len(rows)
    by_text = {r.text: r for r in found}
    assert all(by_text[t].lang_pred == lang for _, t, lang in rows[:120])
    assert [by_text[t].lang_pred for t in (None, "12 !! \n", "")] == ["und"] * 3 and by_text["Ж"].lang_pred in ("xx", "yy")
    assert all(0 <= r.lang_score <= 1 for r in found)
    left = language.reject(docs)
    assert left.columns == docs.columns and {r.text for r in left.collect()} == {t for _, t, _ in rows} - {None, "12 !! \n", "", "Ж"}
    assert language.predict(none.select("doc_id", "text"), language.train(docs)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict(unlabelled, language.train(unlabelled)).collect()} == {"und"}


def test_languages_in_several_scripts(spark):
    """Two languages of each script, with far more than 60 letters together."""
    rng = random.Random(7)
    scripts = {"latin": "abcdefghijklmnopqrstuvwxyzàâçéèêëîïôûùüñö", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
               "han": "".join(map(chr, range(0x4E00, 0x5E00))), "hangul": "".join(map(chr, range(0xAC00, 0xB400))), "thai": "".join(map(chr, range(0x0E01, 0x0E2F)))}
    words = {f"{script}{i}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(300)]
             for script, letters in scripts.items() for i in (1, 2)}
    rows = [(100 * k + i, " ".join(rng.choice(words[lang]) for _ in range(40)).title(), lang) for k, lang in enumerate(words) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    known = {d: lang for d, _, lang in rows}
    held_out = language.predict(docs, model).where(language.held_out()).collect()
    assert {known[r.doc_id] for r in held_out} == set(words) and [r.doc_id for r in held_out if r.lang_pred != known[r.doc_id]] == []
    assert all(r.lang_score > 0 for r in held_out)
    # Marks belong to their letters, but are none: phrases are those of the bytes of the lower-cased text.
    marks = language.Model({"a": "กิน กา e\u0301te\u0301", "b": "กน กอ ete"})
    assert marks.predict(["กิน", "e\u0301T", "\u0301", "ete"])[0] == ["a", "a", "und", "b"]
    texts = ["กินกา", "Éte\u0301 ก", "龘"]
    counts, lengths = marks.phrases(texts)
    assert lengths.tolist() == [5, 6, 1]
    for row, sample in enumerate(("กิน กา e\u0301te\u0301", "กน กอ ete")):
        assert counts[row].tolist() == [phrases(t.lower().encode(), sample.encode()) for t in texts]


def test_short_and_unusual_texts_keep_their_language(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["tar", "melo", "sint", "vara"]) for _ in range(40)), "xx") for i in range(120)]
    stay = [(600, "A.", "xx"), (601, "q", None), (602, "zzyzx qwkj", None), (604, "Ж tar", None)]
    go = [(700, "Ж", None), (701, "7.", "xx"), (702, None, "xx"), (703, "字 Ж", None)]
    docs = spark.createDataFrame(rows + stay + go, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.reject(docs).collect()} == {r.doc_id for r in docs.collect()} - {r[0] for r in go}


def test_language_holds_a_slice_of_a_batch_at_once(spark, monkeypatch):
    class Sizes:
        def predict(self, texts):
            return ["xx"] * len(texts), [float(sum(len(t or "") for t in texts))] * len(texts), [True] * len(texts)

    monkeypatch.setattr(language, "SLICE_BYTES", 100)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: SimpleNamespace(value=value))
    rows = [(1, "a" * 60), (2, None), (3, "b" * 60), (4, "c" * 300), (5, ""), (6, "d" * 30)]
    found = language.predict(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Sizes())
    assert [tuple(r)[:4] for r in found.orderBy("doc_id").collect()] == [
        (d, t, "xx", score) for (d, t), score in zip(rows, (60.0, 60.0, 60.0, 300.0, 30.0, 30.0))]


# Near copies

def plain_components(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str), {root(i) for i in range(len(rows)) if sets[i]}


@pytest.mark.parametrize("rounds, direct", [(6, 4), (6, 0), (0, 0)])
def test_near_copies(docs, monkeypatch, rounds, direct):
    monkeypatch.setattr(near_join, "ROUNDS", rounds)
    monkeypatch.setattr(near_join, "DIRECT", direct)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected, groups = plain_components(rows)
    found = near_join.join_groups(docs)
    assert collected(found, "doc_id", "n_shingles", "component_id") == expected
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups) + sum(not (t or "").split() for _, t in rows)


def test_chains_and_borders(spark):
    """A chain of links, and pairs at 79 and 80 per cent."""
    base = [f"t{i}" for i in range(204)]
    chain = [" ".join([*(f"c{k}" for k in range(i * 8)), *base[i * 8:]]) for i in range(8)]
    border = [" ".join(f"b{i}" for i in range(104)), " ".join([*(f"b{i}" for i in range(93)), *(f"z{i}" for i in range(11))]),
              " ".join([*(f"b{i}" for i in range(92)), *(f"y{i}" for i in range(12))])]
    rows = list(enumerate(chain + border))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_join.join_groups(docs), "doc_id", "n_shingles", "component_id") == plain_components(rows)[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in found} == {(x, root(x)) for x in linked} and len(found) == len(linked)


def test_components_stop_when_settled_and_leave_one_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "landed", lambda df: written.append(landed(df)) or written[-1])
    found = components.components(spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51)], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, 1) for i in range(1, 40)} | {(50, 50), (51, 50)}
    assert len(written) == 2  # the links, and one round
    assert [os.path.exists(t.landed_path.removeprefix("file:")) for t in written] == [False, True] and found.landed_path == written[-1].landed_path


def test_what_few_rows_leave_is_compared_at_once(spark, monkeypatch):
    """A large family that one pivot settles, and a small one whose members share tokens but do not link."""
    rng = random.Random(4)

    def family(name, count, changes):
        for i in range(count):
            words = [f"{name}{k}" for k in range(200)]
            for k in rng.sample(range(200), changes if i or changes > 2 else 0):
                words[k] = f"{name}x{i}y{k}"
            yield " ".join(words)

    rows = list(enumerate([*family("a", 120, 1), *family("b", 24, 4)]))
    turns, verified = [], near_join._verified
    monkeypatch.setattr(near_join, "_verified", lambda *a: turns.append(1) or verified(*a))
    found = near_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(found, "doc_id", "n_shingles", "component_id") == plain_components(rows)[0]
    assert len(turns) <= 2


@pytest.mark.parametrize("crowded", [64, 0])
def test_texts_that_share_a_passage_and_do_not_link(spark, monkeypatch, crowded):
    """Pivots settle nothing among them. With a sketch that tells no shingle apart all are in each other's buckets."""
    rng = random.Random(5)
    rows = list(enumerate(" ".join([*(f"g{group}w{k}" for k in range(20)), *(f"o{rng.random()}" for _ in range(40))]) for group in range(16) for _ in range(25)))
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(0, 400, 9)]
    monkeypatch.setattr(near_join, "CROWDED", crowded)
    monkeypatch.setattr(near_join, "shingle_levels", lambda texts: np.zeros(near_join.WIDTH, np.uint8))
    turns, verified, split, meeting = [], near_join._verified, [], near_join._meeting
    monkeypatch.setattr(near_join, "_verified", lambda *a: turns.append(1) or verified(*a))
    monkeypatch.setattr(near_join, "_meeting", lambda rows, *on: split.append(len(on) > 1) or meeting(rows, *on))
    found = near_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(found, "doc_id", "n_shingles", "component_id") == plain_components(rows)[0]
    assert len(turns) <= 3 and any(split) == (crowded == 0)


# Lines

def test_lines(spark):
    rows = [(3, "The first line of all\nsame line here\n\nshort\nThe first line of al"), (1, "same line here\nshore\nA line with number 17"),
            (2, None), (4, ""), (5, "A line with number 27\nA line with numbre 17\nsame  line here"), (6, "same line here" * 2000),
            (6, "same line here" * 1999 + "same line her"), (7, "ñandú ñandú ñandú\nÑandú ñandú ñandú"), (None, "A line with number 17"),
            (9, "tail\n"), (9, "tail\n")]
    rows += [(100 + i, f"page number {i} of the long book") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.clean(docs, report=True).collect()
    assert len(found) == len(rows)

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]

    by_hash = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, by_hash[r[1]]))
    seen, expected = [], {}
    for doc_id, text in order:
        gone = []
        for i, line in enumerate(text.split("\n")):
            if line and any(near(line, s) for s in seen):
                gone.append(i)
            seen += [line] if line else []
        expected[doc_id, by_hash[text]] = ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), gone)
    originals = {(r[0], by_hash.get(r[1])): r[1] for r in rows}
    left = sorted(((r.doc_id, r.text, r.n_lines, r.dropped) for r in found), key=str)
    wanted = sorted(((d, None, 0, []) if t is None else (d, *expected[d, by_hash[t]][:1], len(t.split("\n")), expected[d, by_hash[t]][1]) for d, t in rows), key=str)
    assert left == wanted and originals


@pytest.mark.parametrize("crowd, long", [(32, 1024), (2, 1024), (2, 44), (10 ** 9, 1024)])
def test_lines_of_a_template(spark, monkeypatch, crowd, long):
    """Lines of one template, as equal as any to the keys: few pairs are made, and the answer is that of brute force."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "LONG", long)
    rng = random.Random(11)
    lines = ["Order %0*d was shipped in time, ñandú." % (rng.choice([5, 6, 7]), rng.randrange(99_999)) for _ in range(600)]
    for i in range(0, 600, 7):  # one character less, more or other
        p, line = rng.randrange(len(lines[i])), lines[i]
        lines.append(line[:p] + rng.choice(["", "x" + line[p], "é"]) + line[p + 1:])
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:p] + b[p + 1:] == a for p in range(len(b)))

    expected = [i for i, line in enumerate(lines) if any(near(line, other) for other in lines[:i])]
    made = []
    monkeypatch.setattr(line_dedup, "landed", lambda df: (made.append(landed(df)), made[-1])[1])
    found = line_dedup.clean(docs, report=True).where("size(dropped) > 0").collect()
    assert sorted(r.doc_id for r in found) == expected and 60 < len(expected) < 600
    if crowd == 32:
        assert sum(df.count() for df in made if df.columns == ["later", "earlier"]) <= 32 * 6 * len(lines) / 2
        assert max(df.count() for df in made) < 20_000


def test_katz_shares_of_documents_move_by_chunk(spark):
    """Every part sends one row per chunk; a document that a chunk holds twice, or two parts have, is added up there."""
    def share(names, values, counts):
        return katz._shares(np.array(names), np.array(values, float), np.array(counts, np.int32))

    rows = [(1, share([7, 9], [0.5, -1.0], [1, 2])), (1, share([9], [2.0], [3])), (1, share([], [], [])), (2, share([9, -4], [4.0, 1.0], [5, 0]))]
    found = katz._of_documents(spark.createDataFrame(rows, "chunk long, shares binary"), {"value": "double", "c1": "int"})
    assert sorted(map(tuple, found.collect())) == [(-4, 1.0, 0), (7, 0.5, 1), (9, 1.0, 5), (9, 4.0, 5)]
    names = np.array([7, 9, 9])
    keys = np.arange(6, dtype=np.uint64) << np.uint64(62)
    batch = next(katz._packed(np.sort(keys), np.array([0, 1, 2, 0, 1, 2], np.int32), names, 4))
    assert batch.num_rows == 4 and len(set(batch.column("chunk").to_pylist())) == 1


# Language model

def test_katz(docs):
    rows = sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}, key=str)
    seen = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    test = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    unigrams, bigrams = Counter(), Counter()
    for d, t in seen:
        if not test(d):
            words = [*(t or "").encode().lower().split(), None]
            unigrams.update(words)
            bigrams.update(zip(["<s>", *words[:-1]], words))
    total, distinct = sum(unigrams.values()), len(unigrams)

    def discount(counts):
        table = katz.discounts(Counter(counts.values()))
        return lambda c: table[c - 1] if c <= katz.GOOD_TURING else c - katz.DELTA

    one, two = discount(unigrams), discount(bigrams)
    unknown = sum(c - one(c) for c in unigrams.values()) / total
    p1 = lambda w: one(unigrams[w]) / total if w in unigrams else unknown
    count, freed, covered = Counter(), Counter(), Counter()
    for (h, w), c in bigrams.items():
        count[h] += c
        freed[h] += c - two(c)
        covered[h] += p1(w)

    def p(h, w):
        if (h, w) in bigrams:
            return two(bigrams[h, w]) / count[h]
        return freed[h] / count[h] / (1 - covered[h]) * p1(w) if h in count else p1(w)

    for h in list(count)[:20]:
        assert math.isclose(sum(p(h, w) for w in unigrams) + p(h, "never seen"), 1)
    found = defaultdict(list)
    for r in katz.score(docs).collect():
        found[r.doc_id].append(r)
    assert sum(map(len, found.values())) == len(seen) and len(rows) < len(seen)
    for d, t in seen:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((unigrams[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        score = sum(math.log10(p(h, w)) for h, w in zip(["<s>", *words[:-1]], words))
        expected = (test(d), len(words), sum(w in unigrams for w in words), total)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected and math.isclose(r.base_score, base, rel_tol=1e-9)
                   and math.isclose(r.score, score, rel_tol=1e-9) for r in found[d])


# Main text

def test_main_text_of_other_pages():
    model = pages.train()
    page = ("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><div id=nav class='main-menu'><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></div>"
            "<script>var a='<p>no</p>';</script><article><h1>Title &amp; more</h1><p>First\n  paragraph &lt;here&gt;, with <b>bold</b> text.<br>Second line."
            "<p>Unclosed paragraph &copy; with some words in it.<aside><p>Read also this other story.</p></aside><ul><li>One item of the list.<li>Another item of it.</ul></article>"
            "<section class='comments'><p>I do not agree with this at all.</p></section><!-- <p>no</p> --><footer><p>Copyright of the site.</p></footer>")
    assert model.main_text(page) == ("Title & more\nFirst paragraph <here>, with bold text. Second line.\nUnclosed paragraph © with some words in it.\n"
                                     "One item of the list.\nAnother item of it.")


def test_formulas_and_what_stands_in_for_scripts_are_text():
    page = ("<article><h1>On numbers and sums</h1><p>The sum <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math> is known to all of us, says "
            "<svg><style>p{}</style><g><text>the figure</text></g></svg> in this long paragraph.</p><noscript><p>This paragraph is for readers without scripts at all.</p></noscript>"
            "<p>A plan <object data=x>of the whole house</object> is here, and <math><mi>c</mi> is never closed.<p>The last paragraph of the article is this.</article>")
    assert pages.train().main_text(page) == (
        "On numbers and sums\nThe sum a+b is known to all of us, says the figure in this long paragraph.\nThis paragraph is for readers without scripts at all.\n"
        "A plan of the whole house is here, and c is never closed.\nThe last paragraph of the article is this.")


def test_stray_end_tags_take_no_time():
    """Times the number of open elements they took minutes."""
    start = time.perf_counter()
    pages.parse("<div>" * 40_000 + "</p></section><td>x</td><li>y" * 40_000)
    assert time.perf_counter() - start < 20


def test_marginals_are_exact():
    """Sum-product against the sum over all states of a small page."""
    model = pages.train()
    tree = pages.parse("<body><div class=ad>Buy it.</div><main><p>Some text here.</p>More of it</main></body>")
    count = len(tree.tag)
    totals, all_ = [0.0] * count, 0.0
    for states in range(2 ** (count - 1)):
        state = [0, *(states >> i & 1 for i in range(count - 1))]
        weight = sum(model.edge[tree.tag[n] == pages.TEXT][state[tree.parent[n]]][state[n]] + state[n] * sum(model.seen.get(w, 0.0) for w in pages.observed(tree, n)) for n in range(1, count))
        all_ += math.exp(weight)
        for n in range(count):
            totals[n] += state[n] * math.exp(weight)
    assert all(math.isclose(t / all_, m, abs_tol=1e-9) for t, m in zip(totals, model.marginals(tree)))


def test_labelled_pages_held_out():
    """Trained on two thirds of the labelled pages, right for 95 per cent of the texts of the rest."""
    labelled = pages.labelled_pages()
    model = pages.train([p for i, p in enumerate(labelled) if i % 3 != 1])
    right = total = 0
    for page in labelled[1::3]:
        tree = pages.parse(page)
        for node, chance in enumerate(model.marginals(tree)):
            if tree.tag[node] == pages.TEXT:
                total += 1
                right += (chance > 0.5) == tree.mark[node]
    assert right / total > 0.94


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "just text"), (4, "u", "<p"), (5, "u", "<article><p>Hello there, my friend.</article>"), (5, "u", "<article><p>Hello there, my friend.</article>"),
            (6, "u", "<div>" * 3000 + "<p>deep words are here." + "</div>" * 10), (7, "u", "<" * 20000)]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 5] == ["Hello there, my friend."] * 2
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Fingerprints

def test_fingerprints(docs):
    rows = docs.select("doc_id", "text").collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    expected = []
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    found = fingerprint.compare_edited(docs)
    assert collected(found, "doc_id", "n_chars", "edited_sha256") == sorted(expected, key=str)
    all_ = found.collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in all_)
    plain = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(docs).collect()}
    assert {(r.doc_id, r.fingerprint) for r in all_} == plain


def test_fingerprints_are_homomorphic():
    a, b, c = "First paragraph here.\nSecond one", "Third of them\nFirst paragraph here.", ""
    of = lambda t: fingerprint.to_hex(*fingerprint.vectors([t]))[0]
    assert of(a + "\n" + b) == of(b + "\n" + a) == fingerprint.insert(of(a), b)
    assert fingerprint.insert(of(a + "\n" + b), b, -1) == of(a) and set(of(c)) == {"0"}
    assert of("x\nx") != of("x") != of("y")
    half = "\n".join(f"sentence number {i}" for i in range(60)), "\n".join(f"sentence number {i}" for i in range(30, 90))
    assert 0.35 < fingerprint.likeness(*(fingerprint.vectors([t]) for t in half))[0] < 0.65


def test_likeness_of_very_many_equal_lines():
    """Half of 60,000 equal lines replaced: the cosine of the multisets, which sums modulo 2^16 would turn over."""
    text = "the same line\n" * 60_000
    edited = "the same line\n" * 30_000 + "\n".join(f"another line {i}" for i in range(30_000))
    true = 30_000 * 60_000 / math.sqrt(60_000 ** 2 * (30_000 ** 2 + 30_000))
    assert abs(fingerprint.likeness(fingerprint.vectors([text]), fingerprint.vectors([edited]))[0] - true) < 0.05


def test_likeness_is_the_cosine_of_the_multisets():
    rng = random.Random(9)
    apart = []
    for _ in range(60):
        words = [f"unit {i}" for i in range(rng.randint(5, 400))]
        a, b = ([w for w in words if rng.random() < 0.7] * rng.randint(1, 3) for _ in range(2))
        x, y = Counter(a), Counter(b)
        true = sum(x[w] * y[w] for w in x) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()) or 1)
        apart.append(fingerprint.likeness(*(fingerprint.vectors(["\n".join(t)]) for t in (a, b)))[0] - true)
    assert max(map(abs, apart)) < 0.3 and sum(d * d for d in apart) / len(apart) < 0.07 ** 2


def test_fingerprint_without_ids(spark):
    docs = spark.createDataFrame([(None, "b text"), (None, "a text"), (None, None)], "doc_id long, text string")
    assert fingerprint.compare_edited(docs).count() == 3
    assert fingerprint.compare_edited(docs.limit(1)).first().near_next == 1.0


# Personal data

def plain_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(re.sub("[ -]", "", m[0])) <= 19 and personal.luhn(re.sub("[ -]", "", m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(((m.start(), m.end(), k) for k, m in found), key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_personal_data_like_the_patterns():
    rng = random.Random(7)
    alphabet = ["1", "2", "0", "25", ".", ".", " ", "-", "+", "@", "a", "b.c", "é", "(", ")", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.zz", "10.0.0.255", "a@b.c.d@e.f", "@", "256.1.1.1"]
    automaton = personal.anchors()
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        base = [s for s in personal.spans(text, automaton) if s[2] in personal.BASE_KINDS]
        assert base == plain_spans(text), text


def test_personal_data_of_odd_rows(docs, none):
    assert personal.find(docs).count() == docs.count() and personal.find(none).count() == 0
    some = docs.sparkSession.createDataFrame([(1, "token = \"24be64439e3e49cf\" and a@b.co"), (2, None), (3, "ftp://joe:pw@host.example/x clean")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal.find(some).select("doc_id", personal.joined(F.col("spans")).alias("spans")).collect()}
    assert found == {1: "account:9:25,email:31:37", 2: "", 3: "url:0:27,email:10:25"}
    assert {r.text for r in personal.redact(some).collect()} == {'token = "[account]" and [email]', None, "[url] clean"}


# All of them

def test_empty_tables(none):
    for df in (exact_dedup.decide(none), exact_dedup.drop_copies(none), mixing.mix(none), mixing.mixed(none), packing.pack(none), near_join.join_groups(none),
               near_join.one_of_each(none), line_dedup.clean(none), katz.score(none), fingerprint.compare_edited(none), language.reject(none), personal.redact(none)):
        assert df.count() == 0


def test_levels_hold_no_wide_copy_of_the_counters():
    """The driver's share of the count sketch: as before, with a few blocks at a time beside the counters."""
    counters = np.random.default_rng(3).poisson(6, 2 ** 20).astype(np.uint32)
    counters[::1000] *= 5000
    middle = float(np.median(counters))
    plain = np.log2(1 + np.maximum(counters.astype(np.int64) - middle, 0) / (2 + 2 * middle ** 0.5)).astype(np.uint8)
    tracemalloc.start()
    levels = near_join.levels_of(counters.reshape(64, -1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(levels, plain) and peak < 2 * counters.nbytes
