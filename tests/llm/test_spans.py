"""URL rules, token alignment and periodic runs against plain Python versions on small tables with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.llm import alignment, periodic, url_rules
from arqueo.llm.common import read
from arqueo.llm.queries import URL_RULES, op12_token_alignment, op13_periodic_runs

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk string, pairs long, runs string, start string"


# URL rules

def fitting(url, rules, otherwise="allow"):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), match[1]), match[2]) if match else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/", "https://xexample.net/en/", "http://net/en",
    "http://a.b.c.org/fr/1", "http://org/fr/", "http://org/fr", "https://é.example.com/de/ü", "x://a//b://c/", "http://a.org?u=/fr/", "http://a.org#/fr/",
    "http://a.org/x?u=http://b.net/", "http://a..net/", "http://.net/", "http://net./", "http://u@a.net:80/en/", "http://a.net\n/en/", "http://" + "a." * 3000 + "net/" + "x/" * 5000,
]


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize("seed", range(2))
def test_url_rules(spark, seed, partitions):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "ab", "net", "org"], ["", "/", "/a", "/a/", "/a/b", "/b/", "/ab"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    urls = ODD_URLS + [f"http://{host()}{rng.choice(parts)}{rng.choice(parts)}" for _ in range(400)]
    urls += ["http://a.b.net/a/b"] * 300  # one URL, and with it one host, that owns a large share
    rules = {(host(), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rules += [("", "/ab", "block")] if seed else []
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, best string, Rule string, `od.d` int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert found.columns == ["page_id", "url", "best", "od.d", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: fitting(u, rules) for i, u in enumerate(urls)}


def test_url_rules_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id long, url string")
    rules = url_rules.rule_table(spark, URL_RULES)
    none = rules.limit(0)
    assert sorted(tuple(r)[2:] for r in url_rules.judge(pages, rules).collect()) == [("", "", None, "allow")] + [("a.net", "/x", "net/", "block")] * 2
    assert [r.verdict for r in url_rules.judge(pages, none, otherwise="block").collect()] == ["block"] * 3
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    twice = url_rules.rule_table(spark, [("NET", "/", "block"), ("net", "/", "allow"), (None, None, "allow")])
    assert sorted((r.rule, r.verdict) for r in url_rules.judge(pages, twice).collect()) == [("", "allow"), ("net/", "block"), ("net/", "block")]


def test_url_rules_have_no_python_and_no_pairs(spark):
    plan = url_rules.judge(read(spark, SMALL, "pages"), url_rules.rule_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


# Alignment of two tokenizers

def byte_of():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


def aligned_plainly(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte, linked, counts = byte_of(), [], Counter()
    for text in texts:
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            linked.append(None)
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
        common = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in common]
        counts.update(links)
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b)))
                          for low, high in zip([0, *common], common))
        linked.append((len(a), len(b), links, groups))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0,) * 6 + ("",) if x is None else (
        x[0], x[1], len(x[2]), len(x[2]), sum(counts[p] == top[p[1]] for p in x[2]), sum(counts[p] for p in x[2]), hashlib.sha256(x[3].encode()).hexdigest()) for x in linked]


ODD_TEXTS = [None, "", " ", "▁x", "a<|endoftext|>b <s> <unk> <0x41>", "日本語 テスト 😀 ok", "\n\n \t x", "  lead", "a\x00b", "é" * 300, "x" * 5000, "same text", "same text", "ﬁ ½ é"]


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_alignment(spark, monkeypatch, size):
    """In chunks of many texts, and of one or two."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    texts = ODD_TEXTS + [r.text for r in read(spark, SMALL, "documents").orderBy("doc_id").limit(40).collect()]
    docs = spark.createDataFrame([(i, t, "c", 7, "r", "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = alignment.compare(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == aligned_plainly(texts)


def test_alignment_query(spark):
    rows = read(spark, SMALL, "documents").orderBy("doc_id").collect()
    found = op12_token_alignment(spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(r.doc_id, *x) for r, x in zip(rows, aligned_plainly([r.text for r in rows]))]


def test_alignment_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two"), (4, None)], "doc_id long, text string")
    found = alignment.compare(rows).collect()
    assert sorted((str(r.doc_id), r.n_links, r.count_sum, r.n_best) for r in found) == [("3", 2, 6, 2), ("3", 2, 6, 2), ("4", 0, 0, 0), ("None", 2, 6, 2)]
    assert alignment.compare(rows.limit(0)).count() == 0
    spelled = alignment.align(rows, spell=True).where("doc_id = 3").first().groups
    assert re.fullmatch(r"\d+\|\d+;\d+\|\d+", spelled)


def test_alignment_of_very_long_texts(spark):
    texts = [" " * 1_200_000, "ab " * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alignment.compare(docs).orderBy("doc_id").collect()
    assert found[1].n_groups == found[1].n_links > 400_000 and found[0].n_a > 0


# Periodic runs

def lyndon_plainly(t):
    return [next((j - i for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t) - i) for i in range(len(t))]


def runs_plainly(t, words=24, periods=3):
    n, out = len(t), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(words, periods * q):
                if not any(t[i:i + length - r] == t[i + r:i + length] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    for n in range(9):
        for t in itertools.product(range(3), repeat=n):
            assert periodic.lyndon_array(list(t)) == lyndon_plainly(t)
    rng = random.Random(2)
    for _ in range(200):
        t = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 90))]
        assert periodic.lyndon_array(t) == lyndon_plainly(t)


@pytest.mark.parametrize("words,periods", [(24, 3), (6, 2), (2, 2)])
def test_runs(words, periods):
    rng = random.Random(words)
    for _ in range(400):
        t = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 100))]
        if t and rng.random() < 0.7:
            a, p = rng.randrange(len(t)), rng.randint(1, 9)
            t[a:] = [t[a + (i - a) % p] if a + (i - a) % p < len(t) else 0 for i in range(a, len(t))]
        found = periodic.runs(np.array(t, np.int64), least_words=words, least_periods=periods)
        assert [tuple(r) for r in found.tolist()] == runs_plainly(t, words, periods)


def expected(words):
    found = runs_plainly(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts():
    rng = random.Random(4)
    out = [None, "", " \n ", "one", "a " * 23, "a " * 24, "a A " * 30, "x " * 24 + "y " * 24, "\n".join(["p q r s t u v w x"] * 3),
           "\t".join(["p q r s t u v w"] * 3), "q w e " * 5 + "q w E " * 9 + "ü ß " * 13 + "end", "\u00a0x " * 40, " ".join("ab" * 40) + " " + " ".join("abc" * 9)]
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            base = [rng.choice(["a", "b", "ç"]) for _ in range(rng.randint(1, 12))]
            words += (base * 30)[:rng.randint(1, 5 * len(base) + 20)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
        out.append(rng.choice([" ", "  ", "\r\n"]).join(words) + rng.choice(["", "\n"]))
    return out


@pytest.mark.parametrize("size", [4_000_000, 200])
def test_periodic_texts(spark, monkeypatch, size):
    monkeypatch.setattr(periodic.chunks, "__defaults__", (1, size))
    texts = periodic_texts()
    docs = spark.createDataFrame([(i, t, "c", 7, "r", "s") for i, t in enumerate(texts)], SCHEMA).repartition(2)
    found = periodic.find(docs).orderBy("doc_id").collect()
    assert [tuple(r.asDict()[c] for c in found[0].asDict() if c not in ("doc_id", "runs")) for r in found] == [expected(split(t)) for t in texts]
    assert [[tuple(x) for x in r.runs] for r in found] == [runs_plainly(split(t)) for t in texts] and sum(r.n_runs for r in found) > 40
    short = periodic.collapse(docs)
    assert short.columns == docs.columns
    for r in short.collect():
        if found[r.doc_id].n_runs:
            assert hashlib.sha256(r.text.encode()).hexdigest() == found[r.doc_id].collapsed_sha256
        else:
            assert r.text == texts[r.doc_id]


def test_periodic_query(spark):
    found = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, SMALL).collect()}
    rows = read(spark, SMALL, "documents").collect()
    assert len(found) == len(rows)
    planted = 0
    for r in rows:
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if n > 600:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            planted += 1
        assert found[r.doc_id] == expected(words)
    assert planted > 10


def test_periodic_runs_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, "a " * 30), (1, "a " * 30), (1, "a " * 30)], "doc_id long, text string")
    assert [r.n_runs for r in periodic.find(rows).collect()] == [1, 1, 1]
    assert periodic.find(rows.limit(0)).count() == 0 and periodic.collapse(rows.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 60_000)], "doc_id long, text string").withColumn("n_chars", F.lit(1))
    assert tuple(periodic.find(long, keep_runs=False).first())[1:6] == (1, 0, 180_000, 3, 60_000_000)
    assert periodic.collapse(long).first().text == "a b c"
