"""Substring dedup by hashing lines or paragraphs, and the sentences in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, hot_keys, materialize, n_words

#: Words that a repeated line or paragraph, and a repeated sentence inside one, must have to go.
MIN_WORDS, MIN_SENTENCE_WORDS = 5, 8
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Sentences end before a space after one of these; joined by a space, they give the unit again.
SENTENCE_END = r"(?<=[.!?]) "
SPANS = "array<struct<start:int,end:int>>"
#: By which a line's number goes into that of a place: more than a line can have sentences.
PLACES = 1 << 31


def normalised(unit: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def _sentences(unit: Column) -> Column:
    return F.split(unit, SENTENCE_END)


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_sentence_words: int = MIN_SENTENCE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each repeated unit removed but in its earliest place, by (id, position); adds n_units, n_removed and removed_spans.

    A unit is a line or a paragraph (between blank lines), or a sentence inside one: a passage may stand in the middle of a line. Units with fewer words than asked for stay. Digests are MD5 of the
    normalised unit. removed_spans has [start, end) in code points of the original text for each removed unit, in order, so the original can be restored. What remains is
    joined as it was split; a line goes when all its sentences do. A sentence's earliest place is never in a line that goes, since that line would have an earlier one.

    Null texts stay null, empty ones empty, both with n_units 0; a null id ranks first. Rows that repeat id and text are one document: they get
    the same result. A document whose units are all repeats keeps its row with an empty text. Columns named like new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    sep = SEPARATORS[unit]
    new = ["n_units", "n_removed", "removed_spans"]
    kept = [c for c in docs.columns if c not in new]
    ident, text = F.col(id_col), F.col(text_col)
    print_of = F.xxhash64(text)
    lines = docs.filter(F.length(text) > 0).select(ident.alias("__id"), print_of.alias("__print"), F.posexplode(F.split(text, sep)).alias("__line", "__whole"))
    # a place is line * PLACES, plus 1 + k for its sentence k
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.col("__whole").alias("unit")))
    inner = F.transform(_sentences(F.col("__whole")), lambda x, k: F.struct((k + 1).alias("sub"), x.alias("unit")))
    found = lines.select("__id", "__print", "__line", F.inline(F.when(F.size(inner) > 1, F.concat(whole, inner)).otherwise(whole)))
    long_enough = found.withColumn("__norm", normalised(F.col("unit"))).filter(n_words(F.col("__norm")) >= F.when(F.col("sub") == 0, min_words).otherwise(min_sentence_words))
    # one small table of places: id, print of the text, place, digest
    at = F.col("__line").cast("long") * PLACES + F.col("sub")
    units = materialize(long_enough.select("__id", "__print", at.alias("__at"), F.unhex(F.md5("__norm")).alias("__digest")), "units")
    place = F.struct("__id", "__print", "__at")
    firsts = units.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")).filter("__n > 1").drop("__n")
    # a digest above a thousandth of all places is met by broadcast (there are fewer than a thousand); the rest can't be hot
    hot = hot_keys(units, "__digest")
    hot_firsts = F.broadcast(firsts.join(F.broadcast(hot), "__digest", "left_semi"))
    often = units.join(hot_firsts, "__digest", "inner")
    seldom = units.join(F.broadcast(hot), "__digest", "left_anti").join(firsts, "__digest", "inner")
    repeats = often.unionByName(seldom).filter(~place.eqNullSafe(F.col("__first")))
    gone = repeats.groupBy("__id", "__print").agg(F.collect_set("__at").alias("__gone"))
    joined = docs.select(*kept, print_of.alias("__p")).join(gone, ident.eqNullSafe(F.col("__id")) & (F.col("__p") == F.col("__print")), "left")
    units_of = F.when(F.length(text) > 0, F.size(F.split(text, sep))).otherwise(0)

    @F.pandas_udf(f"rest string, spans {SPANS}")
    def cut(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text_batch, gone_batch in texts:
            done = [_without(t, set(g.tolist()), sep) if t is not None else (None, []) for t, g in zip(text_batch, gone_batch, strict=True)]
            yield pd.DataFrame({"rest": [x for x, _ in done], "spans": [[{"start": a, "end": b} for a, b in y] for _, y in done]})

    # only texts that lose units go to Python; without asNondeterministic() they would go twice if a filter on what is left follows
    loses = F.col("__gone").isNotNull()
    parted = joined.select(*kept, "__gone", units_of.alias("n_units"), cut.asNondeterministic()(F.when(loses, text), F.coalesce("__gone", F.array().cast("array<bigint>"))).alias("__cut"))
    spans = F.when(loses, F.col("__cut.spans")).otherwise(F.array().cast(SPANS))
    others = [F.col(c) if c != text_col else F.when(loses, F.col("__cut.rest")).otherwise(text).alias(text_col) for c in kept]
    return parted.select(*others, "n_units", F.size(spans).alias("n_removed"), spans.alias("removed_spans"))


def _without(text: str, gone: set[int], sep: str) -> tuple[str, list[tuple[int, int]]]:
    """A text without the units at some places, and where these were."""
    kept, spans, at = [], [], 0
    for i, line in enumerate(text.split(sep)):
        place, end = i * PLACES, at + len(line)
        if place in gone:
            spans.append((at, end))
        else:
            pieces = re.split(SENTENCE_END, line)
            stay, begin = [], at
            for k, piece in enumerate(pieces):
                if place + 1 + k in gone:
                    spans.append((begin, begin + len(piece)))
                else:
                    stay.append(piece)
                begin += len(piece) + 1
            if stay:
                kept.append(" ".join(stay))
        at = end + len(sep)
    return sep.join(kept), spans


_NORM = "trim(regexp_replace(lower({x}), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"
_COUNT = "len(regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+'))"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, lang, source, n_chars, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS parts FROM documents),
p AS (SELECT doc_id, pos, parts[pos] AS unit FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM d)),
q AS (SELECT doc_id, pos, unit, string_split(regexp_replace(unit, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS pieces, sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(unit) - 1 AS start FROM p),
s AS (SELECT doc_id, pos, sub, pieces[sub] AS piece FROM (SELECT doc_id, pos, pieces, unnest(range(1, len(pieces) + 1)) AS sub FROM q WHERE len(pieces) > 1)),
n AS (SELECT doc_id, pos, 0 AS sub, {_NORM.format(x="unit")} AS norm FROM q UNION ALL SELECT doc_id, pos, sub, {_NORM.format(x="piece")} FROM s),
u AS (SELECT doc_id, pos, sub, md5(norm) AS digest FROM n WHERE {_COUNT.format(x="norm")} >= CASE WHEN sub = 0 THEN {MIN_WORDS} ELSE {MIN_SENTENCE_WORDS} END),
r AS (SELECT doc_id, pos, sub FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, pos, sub) AS rn FROM u) WHERE rn > 1),
t AS (SELECT s.doc_id, s.pos, s.sub, s.piece, r.sub IS NOT NULL AS gone, sum(length(s.piece) + 1) OVER (PARTITION BY s.doc_id, s.pos ORDER BY s.sub) - length(s.piece) - 1 AS start
      FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND s.pos = r.pos AND s.sub = r.sub),
l AS (SELECT doc_id, pos, count(*) FILTER (WHERE gone) AS n_gone, string_agg(piece, ' ' ORDER BY sub) FILTER (WHERE NOT gone) AS stay FROM t GROUP BY doc_id, pos),
m AS (SELECT q.doc_id, q.pos, CASE WHEN r.sub IS NOT NULL THEN NULL WHEN coalesce(l.n_gone, 0) = 0 THEN q.unit ELSE l.stay END AS rest, r.sub IS NOT NULL AS whole, q.start, length(q.unit) AS size
      FROM q LEFT JOIN r ON q.doc_id = r.doc_id AND q.pos = r.pos AND r.sub = 0 LEFT JOIN l ON q.doc_id = l.doc_id AND q.pos = l.pos),
x AS (SELECT doc_id, start::BIGINT AS a, (start + size)::BIGINT AS b FROM m WHERE whole UNION ALL
      SELECT t.doc_id, (m.start + t.start)::BIGINT, (m.start + t.start + length(t.piece))::BIGINT FROM t JOIN m ON t.doc_id = m.doc_id AND t.pos = m.pos WHERE t.gone AND NOT m.whole),
spans AS (SELECT doc_id, count(*) AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM x GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(rest, chr(10) ORDER BY pos) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, d.lang, d.source, d.n_chars, len(d.parts)::INTEGER AS n_units,
       coalesce(spans.n_removed, 0)::INTEGER AS n_removed, coalesce(spans.spans, '') AS removed_spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN spans ON d.doc_id = spans.doc_id
"""
