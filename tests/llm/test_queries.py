"""The registered queries on the smallest given tables, and the pipeline against a plain Python version of its decisions."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from arqueo.llm import exact_dedup, language, mixing, near_join, packing
from arqueo.llm.common import landed, read
from arqueo.llm.queries import JOBS, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = JOBS[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted(tuple(r) for r in df.select(*columns).collect())
    assert mine == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()) and mine


@pytest.mark.parametrize("name", sorted(set(JOBS) - set(SQL)))
def test_query_has_a_row_for_every_document(spark, name):
    df = JOBS[name](spark, SMALL)
    rows = read(spark, SMALL, "pages" if "page_id" in df.columns else "documents").count()
    key = "page_id" if "page_id" in df.columns else "doc_id"
    assert df.select(key).distinct().count() == rows and (name == "op3_packing" or df.count() == rows)


def test_held_out_language(spark):
    docs = read(spark, SMALL, "documents")
    found = JOBS["op1_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_model_beats_its_base_on_held_out_documents(spark):
    found = JOBS["op4_katz_score"](spark, SMALL).where("held_out").collect()
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


def test_every_labelled_document_keeps_its_language(spark):
    docs = read(spark, SMALL.replace("sf0.001", "sf0.1"), "documents")
    labelled = docs.where("lang is not null and text rlike '[a-zA-Z]'").select("doc_id")
    assert labelled.count() > 9000 and labelled.join(language.reject(docs), "doc_id", "left_anti").count() == 0


def test_pipeline(spark):
    """Every stage against plain Python over the rows that came in."""
    docs = read(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    stages = dict(corpus_pipeline.STAGES)

    known = landed(stages["language"](spark, docs, SMALL))
    assert known.columns == docs.columns and known.count() == docs.count()  # every document here has a language

    single = landed(stages["exact_dedup"](spark, known, SMALL))
    first = {}
    for r in sorted(known.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())

    apart = landed(stages["near_dedup"](spark, single, SMALL))
    sets = {}
    for r in single.collect():
        words = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}
    ids, parent = sorted(sets), {i: i for i in sets}
    by_shingle = defaultdict(list)
    for i in ids:
        for shingle in sets[i]:
            by_shingle[shingle].append(i)
    common = Counter((a, b) for group in by_shingle.values() for n, b in enumerate(group) for a in group[:n])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in apart.collect()) == sorted({root(i) for i in ids})

    mix = landed(stages["mix"](spark, apart, SMALL))
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert mix.columns == docs.columns and abs(words(mix) - 1.5 * words(apart)) <= 20

    packed = stages["pack"](spark, mix, SMALL)
    assert packed.where("start = 0").count() == mix.count()
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()
    assert {exact_dedup, language, mixing, near_join, packing} and corpus_pipeline.ORACLE_SQL is None
