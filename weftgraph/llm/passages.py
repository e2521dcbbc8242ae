"""Passages that repeat, wherever they begin and end: every run of `words` words that occurs at an earlier place goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, hot_keys, materialize
from weftgraph.llm.shingles import _POWERS, chunks, mix, word_hashes

WORDS = 50
_WHITE = b" \t\n\x0b\x0c\r"


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    m = 1
    while 2 * m <= n:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (n - m)], x[n - m :]) if n > m else x


def _read(texts: list[str], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text of n words or more: its number, the hash of each run of n words, and the least hash of the runs of n // 2 words in it, by which runs are met."""
    done = 0
    for part in chunks([t.encode() for t in texts]):
        words, of = word_hashes(part)
        bounds = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a >= n:
                yield done + k, _runs(words[a:b], n).view(np.int64), _least(_runs(words[a:b], n // 2), n - n // 2 + 1).view(np.int64)
        done += len(part)


def _beginnings(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the key changes; and within a stretch longer than one place of a key can make, as the words in it repeat."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    at = np.arange(len(keys))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.flatnonzero(since % (n - n // 2 + 1) == 0)


def _rest(text: str, at: list[int], n: int) -> str:
    """A text without the runs of n words that begin at the words `at`; lines left without words go, if they had some."""
    raw = text.encode()
    edge = np.diff(np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(_WHITE, np.uint8)).astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist()
    out, upto, last = [], 0, None
    cuts: list[list[int]] = []
    for p in sorted(at):
        if last is not None and p <= last:
            cuts[-1][1] = ends[p + n - 1]
        else:
            cuts.append([starts[p], ends[p + n - 1]])
        last = p + n
    for a, b in cuts:
        out.append(raw[upto:a])
        while b < len(raw) and raw[b] in b" \t":
            b += 1
        if (a == 0 or raw[a - 1] == 10) and b < len(raw) and raw[b] == 10:
            b += 1
        upto = b
    return b"".join([*out, raw[upto:]]).decode()


def _hot_runs(texts: DataFrame, hot: DataFrame, words: int, kind: str, most: int = 1000) -> tuple[np.ndarray, list[tuple]]:
    """Runs under the hot keys that more than one in `most` of all runs under these are, so fewer than `most`: sorted, with the first place (id, print, word) of each. Texts with such a key are read; what a batch holds of a run is one row."""
    keys = [r["key"] for r in hot.collect()]  # fewer than a thousand
    if not keys:
        return np.zeros(0, np.int64), []
    mine = texts.withColumn("keys", F.array_intersect("keys", F.array(*map(F.lit, keys)).cast("array<bigint>"))).filter(F.size("keys") > 0)

    def combined(batches):
        for batch in batches:
            first: dict[int, list] = {}
            ids, prints = batch["id"].to_pylist(), batch["print"].to_pylist()
            for k in sorted(range(len(ids)), key=lambda k: (True, ids[k], prints[k]) if ids[k] is not None else (False, prints[k])):
                for _, run, key in _read([batch["text"][k].as_py()], words):
                    at = np.flatnonzero(np.isin(key, batch["keys"][k].values.to_numpy()))
                    for r, a in zip(run[at].tolist(), at.tolist(), strict=True):
                        if r in first:
                            first[r][0] += 1
                        else:
                            first[r] = [1, k, a]
            if first:
                take = pa.array([k for _, k, _ in first.values()], pa.int64())
                yield pa.RecordBatch.from_pydict({"run": pa.array(list(first), pa.int64()), "n": pa.array([n for n, *_ in first.values()], pa.int64()), "id": batch["id"].take(take), "print": batch["print"].take(take), "at": pa.array([a for *_, a in first.values()], pa.int32())})

    told = materialize(mine.mapInArrow(combined, f"run long, n long, id {kind}, print long, at int"), "hot-runs")
    total = told.agg(F.sum("n")).first()[0] or 0
    rows = told.groupBy("run").agg(F.sum("n").alias("n"), F.min(F.struct("id", "print", "at")).alias("f")).filter((F.col("n") > total / most) & (F.col("n") > 1)).collect()
    rows.sort(key=lambda r: r["run"])
    return np.array([r["run"] for r in rows], np.int64), [tuple(r["f"]) for r in rows]


def drop_passages(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words that stand in a run of `words` words (of [^\\x20\\x09-\\x0D]+, A-Z as a-z) which occurs at an earlier place by (id, word) too, not overlapping it.

    Such runs share the least hash of the runs of half as many words in them; only runs whose key occurs twice are compared, all of them, so the result is that of comparing all runs.
    Null and shorter texts stay. Rows that repeat id and text are one document: they get the same result.
    """
    bound_batches(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.length(text) > 2 * words - 2).select(ident.alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))

    def table(batch: pa.RecordBatch, of: list[np.ndarray], more: dict[str, list[np.ndarray]], gone: pa.Array | None = None) -> pa.RecordBatch:
        take = pa.array(np.concatenate(of))
        return pa.RecordBatch.from_pydict({"id": batch["id"].take(take), "print": batch["print"].take(take)} | {k: pa.array(np.concatenate(v)) for k, v in more.items()} | ({} if gone is None else {"gone": gone}))

    def keyed(batches):
        for batch in batches:
            of, keys = [], []
            for k, _, key in _read(batch["text"].to_pylist(), words):
                keys.append(key[_beginnings(key, words)])
                of.append(np.full(len(keys[-1]), k))
            if of:
                yield table(batch, of, {"key": keys})

    keys = materialize(rows.mapInArrow(keyed, f"id {kind}, print long, key long"), "passage-keys")
    twice = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    hot = F.broadcast(hot_keys(keys, "key"))
    met = keys.join(hot, "key", "left_semi").unionByName(keys.join(hot, "key", "left_anti").join(twice, "key", "left_semi"))
    met = met.groupBy("id", "print").agg(F.collect_set("key").alias("keys")).select(F.col("id").alias("__id"), F.col("print").alias("__print"), "keys")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print"))

    texts_met = rows.join(met, same).select("id", "print", "text", "keys")
    first_of_hot = _hot_runs(texts_met, hot, words, kind)
    known = docs.sparkSession.sparkContext.broadcast(first_of_hot)

    def runs(batches):
        for batch in batches:
            of, hashes, ats, gone = [], [], [], []
            ids, prints = batch["id"].to_pylist(), batch["print"].to_pylist()
            for k, run, key in _read(batch["text"].to_pylist(), words):
                at = np.flatnonzero(np.isin(key, batch["keys"][k].values.to_numpy()))
                # runs that very many texts hold are told by a table of bounded size, the others are met by a join
                place = np.minimum(np.searchsorted(known.value[0], run[at]), max(len(known.value[0]) - 1, 0))
                told = known.value[0][place] == run[at] if len(known.value[0]) else np.zeros(len(at), bool)
                mine = [int(a) for a, p in zip(at[told].tolist(), place[told].tolist(), strict=True) if known.value[1][p][:2] != (ids[k], prints[k]) or a - known.value[1][p][2] >= words]
                at = at[~told]
                more = int(bool(mine))
                of.append(np.full(len(at) + more, k))
                hashes.append(np.r_[run[at], np.zeros(more, np.int64)])
                ats.append(np.r_[at, np.zeros(more, np.int64)].astype(np.int32))
                gone += [None] * len(at) + ([mine] if mine else [])
            if of:
                yield table(batch, of, {"run": hashes, "at": ats}, pa.array(gone, pa.list_(pa.int32())))

    found = materialize(texts_met.mapInArrow(runs, f"id {kind}, print long, run long, at int, gone array<int>"), "passage-runs")
    at_once, found = found.filter("gone is not null").select("id", "print", F.explode("gone").alias("at")), found.filter("gone is null").drop("gone")
    firsts = found.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "print", "at")).alias("first")).filter("n > 1").drop("n")
    hot = hot_keys(found, "run")
    hot_firsts = F.broadcast(firsts.join(F.broadcast(hot), "run", "left_semi"))
    both = found.join(hot_firsts, "run").unionByName(found.join(F.broadcast(hot), "run", "left_anti").join(firsts, "run"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("print") == F.col("first.print"))
    repeats = both.filter(~own | (F.col("at") - F.col("first.at") >= words)).select("id", "print", "at").unionByName(at_once)
    gone = repeats.groupBy(F.col("id").alias("__id"), F.col("print").alias("__print")).agg(F.collect_set("at").alias("__gone"))

    @F.pandas_udf("string")
    def rest(texts, gone):
        return texts.combine(gone, lambda t, at: None if t is None else _rest(t, at.tolist(), words))

    joined = docs.withColumn("__p", F.xxhash64(text)).join(gone, ident.eqNullSafe(F.col("__id")) & (F.col("__p") == F.col("__print")), "left")
    # only texts that lose words go to Python
    loses = F.col("__gone").isNotNull()
    # else Spark would work it out a second time, in one more Python worker a task, for a filter on the texts
    cut = F.when(loses, rest.asNondeterministic()(F.when(loses, text), F.col("__gone"))).otherwise(text)
    return joined.select(*(cut.alias(c) if c == text_col else F.col(c) for c in docs.columns))
