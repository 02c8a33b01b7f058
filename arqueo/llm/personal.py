"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over the text: at-signs, schemes, identifier cues and the digit
pairs that every number has. A small deterministic parser per kind grows each anchor to its boundaries and
validates it. Kinds, in this order: email, ip, card, phone; then `url` (an address that carries a user name) and `account`
(a number or key after its cue). Spans of one kind do not overlap; positions are code points, the end is exclusive.

A candidate that fails its validation is dropped and still takes up its place, so nothing inside it is tried again.

Defined cases: null counts as empty; no finding gives an empty array; repeated rows give the same spans; an empty table gives an empty
result; other columns are ignored by `find` and kept by `redact`.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "password", "api_key", "apikey", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_URL = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
VALUE = re.compile(r"(?:[\x20\t]*(?:number|no\.?|nr\.?|id|key|#))?[\x20\t]*[:=#][\x20\t]*[\"']?([A-Za-z0-9][A-Za-z0-9-]{5,})", re.IGNORECASE)


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for a in DIGITS:
        found.add_word(f"{a}.", ("ip", 2))
        found.add_word(f"+{a}", ("phone", 2))
        for b in DIGITS:
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def run_start(text: str, at: int, least: int, members) -> int:
    while at > least and text[at - 1] in members:
        at -= 1
    return at


def spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """All findings as (start, end, kind), by start and kind."""
    found = []
    free = dict.fromkeys(KINDS, 0)  # where the last candidate of the kind ended
    for last, (kind, width) in automaton.iter(text):
        end, start = last + 1, last + 1 - width
        if start < free[kind] and kind != "ip":
            continue
        if kind == "email":
            local = run_start(text, start, free[kind], LOCAL)
            if local < start and (match := DOMAIN.match(text, end)):
                free[kind] = match.end()
                found.append((local, match.end(), kind))
        elif kind == "ip":
            if start >= free[kind] and (match := ADDRESS.match(text, run_start(text, start, free[kind], DIGITS))):
                free[kind] = match.end()
                if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match[0].split(".")):
                    found.append((match.start(), match.end(), kind))
        elif kind == "card":
            match = CARD.match(text, start)
            free[kind] = match.end()
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((start, match.end(), kind))
        elif kind == "phone":
            if match := PHONE.match(text, start):
                free[kind] = match.end()
                if 10 <= sum(c in DIGITS for c in match[0]) <= 15:
                    found.append((start, match.end(), kind))
        elif kind == "url":
            if match := USER_URL.match(text, end):
                free[kind] = match.end()
                found.append((start, match.end(), kind))
        elif match := VALUE.match(text, end):
            if any(c in DIGITS for c in match[1]):
                free[kind] = match.end(1)
                found.append((match.start(1), match.end(1), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(text, automaton)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], ["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(searched, schema)


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; of overlapping spans the one that starts first counts."""
    def masked(texts):
        import pandas as pd

        automaton = anchors()
        out = []
        for text in texts:
            parts, done = [], 0
            for start, end, kind in spans(text, automaton) if text else ():
                if start >= done:
                    parts += [text[done:start], f"[{kind}]"]
                    done = end
            out.append(None if text is None else "".join([*parts, text[done:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_column, F.pandas_udf(masked, "string", F.PandasUDFType.SCALAR)(F.col(text_column)))


def joined(spans_column: Column) -> Column:
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans_column: Column, kind: str) -> Column:
    return F.size(F.filter(spans_column, lambda s: s["kind"] == kind)).cast("long")
