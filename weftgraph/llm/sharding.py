"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until splitters meet tolerance, then one exchange.

A document's sort key is a 63-bit integer: 31 bits of a hash of its text, then 32 bits of a hash of its id. Copies of a text are
neighbours in this order and share a shard, unless they hold so many bytes that no boundary beside them meets the tolerance; then the
boundary runs through the group, by the hash of the id. So a text that a third of all rows carry is split over as many shards as it needs.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftgraph.llm.common import materialize, partitions

KEY_BITS = 63
FIRST_BITS = 12
NEXT_BITS = 7


def sort_key(id_col: Column, text: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(text), 33)
    low = F.xxhash64(id_col).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def find_splitters(keys: DataFrame, key: str, weight: str, targets: list[tuple[float, float]]) -> list[int]:
    """For each (weight that should lie below, tolerance), a boundary b so that the sum of `weight` over key < b is within the tolerance, or the nearest that the keys allow.

    Every round counts, in one aggregation over all rows, the exact weight in equal cells of the intervals still open; an interval of one key can't be cut further.
    The driver receives at most 2**FIRST_BITS sums in the first round and 2**NEXT_BITS for each open target in later ones.
    """
    done: dict[int, int] = {}
    opened = {0: list(range(len(targets)))}  # prefix of the key -> targets inside
    below = {0: 0}
    shift = KEY_BITS
    while opened:
        bits = min(shift, FIRST_BITS if shift == KEY_BITS else NEXT_BITS)
        rows = keys
        if shift < KEY_BITS:
            rows = keys.filter(F.shiftright(key, shift).isin(list(opened)))
        cell = F.shiftright(key, shift - bits)
        sums = {r["cell"]: int(r["w"]) for r in rows.groupBy(cell.alias("cell")).agg(F.sum(weight).alias("w")).collect()}
        still: dict[int, list[int]] = {}
        base: dict[int, int] = {}
        for prefix, inside in opened.items():
            cells = sorted(c for c in sums if c >> bits == prefix)
            upto = [below[prefix], *(below[prefix] + s for s in accumulate(sums[c] for c in cells))]
            for t in inside:
                goal, slack = targets[t]
                i = min(max(bisect_left(upto, goal), 1), len(cells))
                if not cells:
                    done[t] = prefix << shift
                    continue
                # the goal lies in cell i - 1: its edges are the candidates
                c = cells[i - 1]
                edges = ((abs(upto[i - 1] - goal), c), (abs(upto[i] - goal), c + 1))
                off, edge = min(edges)
                if off <= slack or shift == bits:
                    done[t] = edge << (shift - bits)
                else:
                    still.setdefault(c, []).append(t)
                    base[c] = upto[i - 1]
        opened, below, shift = still, base, shift - bits
    return [done[t] for t in range(len(targets))]


def _position(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= key))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, ranges_per_shard: int | None = None) -> DataFrame:
    """docs with size (UTF-8 bytes of the text plus 1), text_crc32, law ("bytes"), shard, slot and grown_shard (always null).

    The shards' sizes differ from an equal share by `tolerance` of a share, or by one document where that is more. Slots number a shard's
    documents from 0 without gaps, in the order of the sort key. `ranges_per_shard` ranges of each shard are sorted by a task each.

    Null or empty texts have size 1 and crc 0 and are one group of equal texts. Null ids hash alike. Rows that repeat both id and text share a
    key and are numbered in any order among themselves. An empty table stays empty. Columns of docs with the names of new ones are replaced.
    """
    spark = docs.sparkSession
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c) for c in docs.columns if c not in new or c in (id_col, text_col)]
    keyed = docs.select(*kept, (F.octet_length(text).cast("long") + 1).alias("__size"), F.crc32(F.encode(text, "UTF-8")).alias("__crc"), sort_key(F.col(id_col), text).alias("__key"))
    # the keys alone, written once: each round of counting reads 16 bytes a document, not its text
    keys = materialize(keyed.select("__key", "__size"), "shard-keys")
    total = keys.agg(F.sum("__size")).first()[0] or 0
    per = ranges_per_shard or max(4, -(-2 * partitions(spark) // n_shards))
    ranges = n_shards * per
    share, part = total / n_shards, total / ranges
    targets = [(part * r, tolerance * share if r % per == 0 else part / 4) for r in range(1, ranges)]
    bounds = find_splitters(keys, "__key", "__size", targets) if total else [0] * (ranges - 1)
    for i in range(1, len(bounds)):  # edges chosen with slack may pass each other
        bounds[i] = max(bounds[i], bounds[i - 1])
    top = [bounds[r - 1] for r in range(per, ranges, per)]
    within = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[s * per : (s + 1) * per - 1]]) for s in range(n_shards)])
    shard = _position(F.col("__key"), top)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("__shard", shard)
        return df.withColumn("__range", F.col("__shard") * per + F.size(F.filter(F.element_at(within, F.col("__shard") + 1), lambda b: b <= F.col("__key"))))

    counts = {r["__range"]: r["n"] for r in placed(keys).groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `ranges` rows
    starts = []
    for s in range(n_shards):
        starts += [0, *accumulate(counts.get(r, 0) for r in range(s * per, (s + 1) * per - 1))]
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__range") + 1)
    order = Window.partitionBy("__range").orderBy("__key", id_col)
    return placed(keyed).withColumn("__row", F.row_number().over(order)).select(
        *kept, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").cast("int").alias("shard"), (start + F.col("__row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
