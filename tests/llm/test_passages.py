"""Passages that begin and end anywhere, against plain Python."""

import re

import pytest

from tests.llm.test_texts import frame, prose
from weftgraph.llm import passages, substring_dedup


def plain_words_left(rows, n):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first, left = {}, {}
    for i in sorted(words, key=lambda i: (i is not None, i or 0)):
        w, gone = words[i], set()
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        for p in range(len(w) - n + 1):
            j, q = first.setdefault(tuple(low[p : p + n]), (i, p))
            if j != i or p - q >= n:
                gone.update(range(p, p + n))
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


def made():
    one = re.sub(r"[.!?]", "", prose(70, 61))
    short = " ".join(f"{prose(80 + k, 4)}." for k in range(15))
    exact, less = prose(90, 50), prose(91, 49)
    rows = [(1, f"{prose(1, 30)} {one} {prose(2, 30)}\nlast line"), (2, f"{prose(3, 20)} {one.upper() if one.isascii() else one} {prose(4, 9)}. End"), (3, f"{prose(5, 11)} {short} {prose(6, 13)}")]
    rows += [(4, f"x {short} y"), (5, f"a {exact} b {less} c"), (6, f"d {exact}\n{less} e"), (7, exact), (8, f"top\n{exact}\nend"), (9, None), (10, ""), (11, "Der " * 400), (12, f"{one} z {one}"), (None, f"n {one} n"), (13, f"é  {prose(7, 300)}"), (14, f"{prose(7, 300)} ж")]
    return [(i, t, "en", "s") for i, t in rows]


@pytest.mark.parametrize("size", [5, 1000])
def test_passages_go_wherever_they_begin(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        rows = made()
        got = {r["doc_id"]: r["text"] for r in passages.drop_passages(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = plain_words_left(rows, 50)
    assert {i: (t or "").split() for i, t in got.items()} == wanted
    assert got[9] is None and got[10] == "" and got[7] == "" and got[8] == "top\nend" and got[4] == "x y"
    assert passages.drop_passages(frame(spark, [])).count() == 0
    assert passages.drop_passages(frame(spark, rows[:2] * 2)).count() == 4


def test_the_stage_drops_passages_inside_sentences(spark):
    import corpus_pipeline

    rows = [(i, t, "en", "s") for i, t, *_ in made() if i in (1, 2, 3, 4)]
    units = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_units(frame(spark, rows)).collect()}
    assert units[2] == rows[1][1] and units[4] == rows[3][1]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, frame(spark, rows), "").collect()}
    assert {i: t.split() for i, t in got.items()} == plain_words_left(rows, 50)
