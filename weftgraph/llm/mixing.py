"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 17
TEMPERATURE = 0.7
#: Sources up to this rate carry a table of cumulative probabilities; documents of others add the probabilities up.
TABLE_RATE = 200.0
#: Copies of a document that are made in one go where the rate is above TABLE_RATE.
BLOCK_COPIES = 1000


def mixing_rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """source, n_source, rate (mean repetitions of a document) and cdf (cumulative Poisson probabilities; null above TABLE_RATE) for each source.

    rate = target share * all documents / documents of the source, so the expected size of the mix is that of docs. Without targets
    (columns source, weight) a source's weight is its count to the power `temperature`. A source without a target has rate 0.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_source"))
    if targets is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_source").cast("double"), F.lit(temperature)))
    else:
        aim = targets.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = counts.join(aim, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").fillna(0.0, ["weight"])
    whole = weighed.agg(F.sum("weight").alias("__weights"), F.sum("n_source").alias("__docs"))  # one row
    rated = weighed.join(F.broadcast(whole)).withColumn("rate", F.col("weight") / F.col("__weights") * F.col("__docs") / F.col("n_source"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 12).cast("int")
    begun = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("upto"), F.array().cast("array<double>").alias("cdf"))

    def add(state, k):
        log_fact = state["log_fact"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        upto = state["upto"] + F.exp(k * F.log(F.col("rate")) - F.col("rate") - log_fact)
        return F.struct(log_fact.alias("log_fact"), upto.alias("upto"), F.array_append(state["cdf"], upto).alias("cdf"))

    cdf = F.when(F.col("rate") > TABLE_RATE, F.lit(None).cast("array<double>")).when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), last), begun, add, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))
    return rated.select("source", "n_source", "rate", cdf.alias("cdf"))


def _times_at(rate: Column, u: Column) -> Column:
    """How many of the cumulative Poisson probabilities are at most u, for a rate above TABLE_RATE: those from 12 deviations below it on are added up, as less than 1e-30 lies before."""
    first = F.floor(rate - 12 * F.sqrt(rate)).cast("long")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("long")
    k = first.cast("double")
    # Stirling's series; k is over 30
    log_p = k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * F.pi() * k) / 2 - 1 / (12 * k) + 1 / (360 * F.pow(k, F.lit(3.0))) - 1 / (1260 * F.pow(k, F.lit(5.0)))
    begun = F.struct(F.exp(log_p).alias("p"), F.exp(log_p).alias("upto"), first.alias("times"))

    def add(state, k):
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), (state["upto"] + p).alias("upto"), (state["times"] + (state["upto"] <= u).cast("long")).alias("times"))

    return F.aggregate(F.sequence(first + 1, last), begun, add, lambda s: s["times"])


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", most_broadcast: int = 50_000) -> DataFrame:
    """Each document as often as the inverse of its source's Poisson distribution says at a hash of (seed, id), dealt out in an order that depends on (seed, id, copy) alone.

    Adds rate, copy (from 1) and mix_key, by which the rows are shuffled globally: partitions are a hash of it, each sorted by it.
    The rates are broadcast up to `most_broadcast` sources (counted first); beyond that a join by source is used, whose hot sources Spark's adaptive execution splits.

    A null source is a source of its own; a null id hashes as the empty string. Rows that repeat an id get the same count each. Rates have
    no bound: above TABLE_RATE a document's copies are dealt out in blocks. Empty tables give no rows. Columns of docs named like new ones are replaced.
    """
    new = ["rate", "copy", "mix_key"]
    kept = [c for c in docs.columns if c not in new]
    rates = mixing_rates(docs, targets, temperature, source_col).select(F.col("source").alias("__source"), "rate", F.col("cdf").alias("__cdf"))
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("most")).first()
    rates = F.broadcast(rates) if size["n"] <= most_broadcast else rates
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    rows = docs.select(*kept, unit.alias("__u")).join(rates, F.col(source_col).eqNullSafe(F.col("__source")))
    often = F.col("rate") > TABLE_RATE
    counted = rows.filter(~often).withColumn("__times", F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).filter(F.col("__times") > 0)
    copies = counted.select(*kept, "rate", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("copy"))
    if (size["most"] or 0.0) > TABLE_RATE:
        many = rows.filter(often).withColumn("__times", _times_at(F.col("rate"), F.col("__u")))
        blocks = many.select(*kept, "rate", "__times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / BLOCK_COPIES))).alias("__block")).repartition(ident, F.col("__block"))
        upto = F.least("__times", (F.col("__block") + 1) * BLOCK_COPIES)
        copies = copies.unionByName(blocks.select(*kept, "rate", F.explode(F.sequence((F.col("__block") * BLOCK_COPIES + 1).cast("int"), upto.cast("int"))).alias("copy")))
    keyed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.col("copy").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


ORACLE_SQL = f"""
WITH n AS (SELECT source, count(*) AS n_source FROM documents GROUP BY source),
w AS (SELECT source, n_source, pow(n_source::DOUBLE, {TEMPERATURE}) AS weight FROM n),
r AS (SELECT source, weight / sum(weight) OVER () * sum(n_source) OVER () / n_source AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 13)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
cdf AS (SELECT source, any_value(rate) AS rate, list(c ORDER BY k) AS cdf
        FROM (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source),
d AS (SELECT d.*, rate, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS times
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
e AS (SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(1, times + 1)) AS copy FROM d)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copy::INTEGER AS copy, md5('{SEED}:' || doc_id || ':' || copy) AS mix_key FROM e
"""
