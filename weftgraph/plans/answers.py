"""Models' answers by content: what was asked once isn't asked again, by a later run, nor by one that goes on where another broke off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.registry import Conflict, Registry
from weftgraph.plans.staging import materialize

#: Texts that are asked for in one job: a run that breaks off loses the answers of the last one at most.
WAVE_ROWS = 20_000


def answered(rows: DataFrame, text_col: str, model: str, registry: Registry, ask: Callable[[DataFrame], DataFrame], out: str, wave_rows: int = WAVE_ROWS, run: str = "") -> DataFrame:
    """rows with the answer (column `out`, "answer" or "vector") to their text; null where ask() gave an error.

    Texts are known by the model and the SHA-256 of the text. ask() gets (digest, text_col) of those that have no answer in the registry, each once, in waves; it returns digest and out, and maybe error. Each wave's answers are added to
    the registry's table in one commit before the next wave begins. Null texts have no answer.

    If ask() returns `call` too (requests, tokens, seconds, refusals of a request, on one of its rows), the same commit has a row of the table `calls`, under the name of the run: sums over what was written, in which a task that was
    repeated has its rows once.
    """
    spark = rows.sparkSession
    keyed = materialize(rows.withColumn("__digest", F.sha2(F.col(text_col), 256)), "asked")
    texts = keyed.filter("__digest is not null").select(F.col("__digest").alias("digest"), text_col).dropDuplicates(["digest"])
    known = lambda: registry.table("answers").filter(F.col("model") == model).select("digest", out)
    new = materialize(texts.join(known().select("digest"), "digest", "left_anti"), "new-texts")
    waves = -(-new.count() // wave_rows)
    failed = None
    for wave in range(waves):
        mine = new.filter(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
        got = materialize(ask(mine), "answers-of-wave")
        good = got.filter(F.col("error").isNull()) if "error" in got.columns else got
        told = {"answer": F.lit(None).cast("string"), "vector": F.lit(None).cast("array<float>")} | {out: F.col(out)}
        added = {"answers": good.select(F.lit(model).alias("model"), "digest", *[c.alias(n) for n, c in told.items()])}
        if "call" in got.columns:
            sums = [F.coalesce(F.sum(f"call.{c}"), F.lit(0)).alias(c) for c in ("requests", "tokens", "seconds", "refusals")]
            wrong = F.count("error") if "error" in got.columns else F.lit(0)
            added["calls"] = got.agg(*sums, F.count(F.lit(1)).alias("texts"), wrong.alias("errors")).select(F.lit(run).alias("run"), F.lit(model).alias("model"), "requests", "texts", "tokens", "seconds", "refusals", "errors")
        _add(registry, added)
        if "error" in got.columns:
            bad = got.filter(F.col("error").isNotNull()).select("digest", "error")
            failed = bad if failed is None else failed.unionByName(bad)
    failed = failed if failed is not None else spark.createDataFrame([], "digest string, error string")
    said = known().dropDuplicates(["digest"]).withColumnsRenamed({"digest": "__d", out: "__out"})
    wrong = failed.select(F.col("digest").alias("__e"), F.col("error").alias("__error"))
    joined = keyed.drop(out, "error").join(said, F.col("__digest") == F.col("__d"), "left").join(wrong, F.col("__digest") == F.col("__e"), "left")
    return joined.withColumn(out, F.col("__out")).withColumn("error", F.col("__error")).drop("__d", "__e", "__out", "__error", "__digest")


def call_metrics(registry: Registry) -> DataFrame:
    """run, model, requests, texts, tokens, seconds, refusals, errors: a row for each run that asked a model."""
    return registry.table("calls").groupBy("run", "model").agg(*[F.sum(c).alias(c) for c in ("requests", "texts", "tokens", "seconds", "refusals", "errors")])


def _add(registry: Registry, added: dict[str, DataFrame]) -> None:
    """Answers are added again where another writer came between: they hang on nothing else in the registry."""
    for _ in range(20):
        try:
            return registry.commit(added)
        except Conflict:
            continue
    raise Conflict(f"no answer could be added to {registry.path}")
