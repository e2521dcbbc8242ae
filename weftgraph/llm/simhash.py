"""SimHash near-duplicates: fingerprints of 64 bits that differ in few of them, found by the generalised pigeonhole principle.

The bits are cut into m parts. A pair that differs in at most `most` bits differs in at most t_i bits of some part i, whenever the t_i, each -1 (the part isn't probed) or more, add up to most - m + 1. So each
fingerprint may have thresholds of its own: the ones that its parts make cheapest. Correlated bits stand in one part; how many fingerprints a part lets through is estimated from counts over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, scratch, small_batches
from weftgraph.operators.components import connected_components

SEED = 42
#: Bits that are counted together; a part is one or more of these groups.
GROUP_BITS = 8
GROUPS = 64 // GROUP_BITS
#: Shingles that are hashed at a time.
CHUNK_SHINGLES = 1 << 16
#: Members of a key that one task compares with each other; keys of more are dealt as pairs of blocks.
BLOCK_ROWS = 1 << 14
#: A key that is sent around costs as much as this many comparisons.
PROBE_COST = 20.0
#: Fingerprints that the number of parts is chosen by (any number of parts finds all pairs).
PLAN_ROWS = 2_000


def fingerprint(text: bytes, shingle: int = 4) -> tuple[int, int]:
    """The fingerprint of a text in UTF-8, unsigned, and how many shingles, repeats included, it is made of: runs of `shingle` words [^\\x20\\x09-\\x0D]+, A-Z in lower case, joined by spaces; with fewer words, all of them as one; without words, 0 of 0."""
    raw = np.frombuffer(text.lower(), np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~white
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one white byte after each word
    flat = np.where(white, np.uint8(32), raw)[keep]
    if len(flat) and flat[-1] != 32:
        flat = np.append(flat, np.uint8(32))
    ends = np.flatnonzero(flat == 32)
    if not len(ends):
        return 0, 0
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(ends) - shingle + 1)
    ends = ends[min(shingle, len(ends)) - 1 :]
    whole, h, counts = flat.tobytes(), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK_SHINGLES):
        hashes = [h(whole[a:b], SEED) for a, b in zip(starts[at : min(n, at + CHUNK_SHINGLES)].tolist(), ends[at : at + CHUNK_SHINGLES].tolist(), strict=False)]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]), n


def gather(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each fingerprint the number that the given bits make, the first one lowest."""
    out = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits.tolist()):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def correlated_groups(both: np.ndarray, n: int) -> np.ndarray:
    """The 64 bits as rows of GROUP_BITS, each begun with the free bit that has most to do with the others and filled with those that have most to do with it. both: how many of n fingerprints have bits i and j."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    return np.array(_gathered(like, GROUP_BITS))


def _gathered(like: np.ndarray, size: int) -> list[list[int]]:
    free, out = list(range(len(like))), []
    while free:
        own = [max(free, key=lambda b: (like[b, free].sum(), -b))]
        free.remove(own[0])
        while free and len(own) < size:
            own.append(max(free, key=lambda b: (like[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def part_layout(m: int) -> list[range]:
    """Groups of bits for each of m parts, the wider parts first; neighbouring groups go together."""
    edges = [(GROUPS * i + m - 1) // m for i in range(m + 1)]
    return [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Plan:
    """Parts, and how many fingerprints lie within t bits of a value of each, estimated from counts of all values of each group of bits as if groups were independent."""

    def __init__(self, groups: np.ndarray, counts: np.ndarray, m: int, most: int) -> None:
        self.m, self.most = m, most
        self.layout = part_layout(m)
        self.bits = [groups[list(r)].ravel() for r in self.layout]
        self.groups, self.n = groups, max(int(counts[0].sum()), 1)
        # share of all fingerprints at d bits from each value of a group
        far = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        self.near = np.stack([np.stack([(far == d) @ c for d in range(min(most, GROUP_BITS) + 1)], 1) for c in counts / self.n])
        self.ball = np.array([[sum(comb(len(b), d) for d in range(t + 1)) for t in range(most + 1)] for b in self.bits])

    def expected(self, prints: np.ndarray) -> np.ndarray:
        """fingerprints x parts x (0 to most): how many others are expected within so many bits."""
        out = np.zeros((len(prints), self.m, self.most + 1))
        for i, r in enumerate(self.layout):
            dist = np.zeros((len(prints), self.most + 1))
            dist[:, 0] = 1
            for g in r:
                own = self.near[g][gather(prints, self.groups[g]).astype(np.int64)]
                dist = np.stack([sum(dist[:, d - e] * own[:, e] for e in range(min(d, own.shape[1] - 1) + 1)) for d in range(self.most + 1)], 1)
            out[:, i] = self.n * np.cumsum(dist, 1)
        return out

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The thresholds of each part, and what they cost: by dynamic programming over the parts, of most + 1 units that they share (a threshold of -1 takes none)."""
        n, units = len(prints), self.most + 1
        cost = np.concatenate([np.zeros((n, self.m, 1)), self.expected(prints) + PROBE_COST * self.ball[None]], 2)
        best = np.full((n, units + 1), np.inf)
        best[:, 0] = 0
        took = np.zeros((self.m, n, units + 1), np.int64)
        for i in range(self.m):
            tried = np.stack([np.concatenate([np.full((n, e), np.inf), best[:, : units + 1 - e] + cost[:, i, e, None]], 1) for e in range(units + 1)], 2)
            took[i] = tried.argmin(2)
            best = tried.min(2)
        out, left, rows = np.zeros((n, self.m), np.int64), np.full(n, units), np.arange(n)
        for i in range(self.m - 1, -1, -1):
            out[:, i] = took[i][rows, left] - 1
            left -= out[:, i] + 1
        return out, best[:, units]

    def sent(self, t: np.ndarray) -> np.ndarray:
        """How many keys each fingerprint stands under, with thresholds t."""
        return sum(self.ball[i, np.maximum(t[:, i], 0)] for i in range(self.m))


def flips(width: int, t: int) -> np.ndarray:
    """All numbers of `width` bits with at most t of them set."""
    return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)], np.uint64)


def signatures(prints: np.ndarray, t: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """part, value, index of the fingerprint, and whether the value is its own: the own one of each part, and those probed within the part's threshold t."""
    part, value, of, own = [], [], [], []
    for i, bits in enumerate(plan.bits):
        values = gather(prints, bits)
        for radius in range(-1, plan.most + 1):
            at = np.flatnonzero(t[:, i] == radius)
            masks = flips(len(bits), max(radius, 0))
            part.append(np.full(len(at) * len(masks), i, np.int32))
            value.append((values[at, None] ^ masks[None, :]).ravel())
            of.append(np.repeat(at, len(masks)))
            own.append(np.tile(masks == 0, len(at)))
    return tuple(np.concatenate(x) for x in (part, value, of, own))


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as the links x-y, one at most for each."""
    names, at = np.unique(np.r_[x, y], return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        then = label.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        np.minimum.at(then, label[i], low)
        np.minimum.at(then, label[j], low)
        then = then[then]
        if (then == label).all():
            break
        label = then
    some = np.flatnonzero(label != np.arange(len(names)))
    return names[some], names[label[some]]


def links_of_keys(group: np.ndarray, prints: np.ndarray, own: np.ndarray, side: np.ndarray, most: int, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that stand under one key (neighbouring rows of equal `group`) and differ in at most `most` bits. Of two that only probe the key none is asked for; side: 0 and 1, where only pairs of different sides are asked for, else 2."""
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(edge)
    left, right = [], []
    # small keys all at once: each row with the one s places on
    small = np.repeat(size <= few, size)
    last = np.repeat(edge[1:], size)
    for s in range(1, min(few, size.max(initial=0))):
        i = np.flatnonzero(small & (np.arange(len(group)) + s < last))
        j = i + s
        near = (np.bitwise_count(prints[i] ^ prints[j]) <= most) & (prints[i] != prints[j]) & (own[i] | own[j]) & ((side[i] == 2) | (side[i] != side[j]))
        left.append(prints[i[near]])
        right.append(prints[j[near]])
    for g in np.flatnonzero(size > few).tolist():
        mine = slice(edge[g], edge[g + 1])
        p, o, at = prints[mine], own[mine], side[mine]
        x, y = [], []
        for a in np.array_split(np.flatnonzero(o & (at != 1)), max(1, len(p) * int(o.sum()) // (1 << 22) + 1)):
            b = np.flatnonzero(at != 0)
            i, j = np.nonzero(np.bitwise_count(p[a][:, None] ^ p[b][None, :]) <= most)
            x.append(p[a][i])
            y.append(p[b][j])
        if (at == 1).any():  # own rows of the other side with those that probe on this one
            for a in np.array_split(np.flatnonzero(o & (at == 1)), max(1, len(p) * int(o.sum()) // (1 << 22) + 1)):
                b = np.flatnonzero((at == 0) & ~o)
                i, j = np.nonzero(np.bitwise_count(p[a][:, None] ^ p[b][None, :]) <= most)
                x.append(p[a][i])
                y.append(p[b][j])
        u, v = _forest(np.concatenate(x), np.concatenate(y))
        left.append(u)
        right.append(v)
    return (np.concatenate(left), np.concatenate(right)) if left else (prints[:0], prints[:0])


def simhash_components(docs: DataFrame, shingle: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and n_shingles for each row of docs.

    A bit of the fingerprint is set if it is in over half the XXH64 hashes (seed 42) of the text's shingles, repeats included; see fingerprint(). Rows link when their fingerprints differ in at most `most` bits;
    component_id is the smallest id that links reach, the row's own included.

    Null, empty and blank texts have the fingerprint zero, and link by it like any other. Rows with a null id take part; their component_id is null only if no row they reach has an id. Rows that repeat an id are rows of their own, and
    equal texts have one fingerprint, which is looked for once. Ids may be of any type that can be ordered. An empty table gives no rows. Other columns of docs are not returned.
    """
    with scratch(docs.sparkSession):
        return _components(docs, shingle, most, id_col, text_col)


def _components(docs: DataFrame, shingle: int, most: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            made = [fingerprint(t or b"", shingle) for t in df["text"]]
            yield pd.DataFrame({"id": df["id"], "fp": np.array([m[0] for m in made], np.uint64).view(np.int64), "n": np.array([m[1] for m in made], np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    with small_batches(spark):
        rows = materialize(texts.mapInPandas(prints, "id string, fp long, n long"), "prints", keep=True)
    rows = rows.withColumn("id", F.col("id").cast(kind))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = hamming_links(classes.select("fp"), most)
    joined = classes.join(connected_components(links, "x", "y").withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(joined.select(F.col("fp").alias("__fp"), "component").join(lows, "component").select("__fp", "component_id"), "components", keep=True)
    # a fingerprint may be that of very many rows: these are met by a broadcast of at most a thousand, the others by a join
    often = F.broadcast(named.join(_often(rows), "__fp", "left_semi").withColumn("__often", F.lit(True)))
    met = rows.join(often.select(F.col("__fp").alias("__hot"), F.col("component_id").alias("__met"), "__often"), F.col("fp") == F.col("__hot"), "left")
    hot = met.filter("__often").select("id", "fp", "n", F.col("__met").alias("component_id"))
    rest = met.filter("__often is null").join(named, F.col("fp") == F.col("__fp")).select("id", "fp", "n", "component_id")
    return hot.unionByName(rest).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_shingles"))


def _often(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Fingerprints of more than one row in `most`, so of fewer than `most`, by name."""
    limit = rows.count() / most
    return rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col("fp").alias("__fp"))


def choose_plan(fps: DataFrame, most: int) -> Plan:
    """Groups of correlated bits and counts of their values, over all fingerprints; of 2 to most + 1 parts the number that a few fingerprints find cheapest. The driver sees 2,080 and then 2,048 counts."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for df in batches:
            bits = np.unpackbits(df["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "c": total[i, j].astype(np.int64)})

    seen = fps.mapInPandas(pairs, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    both = np.zeros((64, 64))
    both[seen["i"], seen["j"]] = both[seen["j"], seen["i"]] = seen["c"]
    groups = correlated_groups(both, fps.count())

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((GROUPS, 256), np.int64)
        for df in batches:
            p = df["fp"].to_numpy(np.int64).view(np.uint64)
            for g in range(GROUPS):
                total[g] += np.bincount(gather(p, groups[g]).astype(np.int64), minlength=256)
        g, v = np.nonzero(total)
        yield pd.DataFrame({"g": g.astype(np.int32), "v": v.astype(np.int32), "c": total[g, v]})

    held = fps.mapInPandas(values, "g int, v int, c long").groupBy("g", "v").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros((GROUPS, 256))
    counts[held["g"], held["v"]] = held["c"]
    some = fps.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_ROWS).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plans = [Plan(groups, counts, m, most) for m in range(2, min(most + 1, GROUPS) + 1)] or [Plan(groups, counts, 1, most)]
    return min(plans, key=lambda p: float(p.thresholds(some)[1].sum()))


def hamming_links(fps: DataFrame, most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """x, y: links that join the same fingerprints (fp, each once) as all pairs that differ in at most `most` bits do; at most one for each fingerprint under a key of many."""
    plan = choose_plan(fps, most)
    with_plan = fps.sparkSession.sparkContext.broadcast(plan)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            p = df["fp"].to_numpy(np.int64).view(np.uint64)
            t, _ = with_plan.value.thresholds(p)
            # about a million rows at a time
            rows = np.cumsum(with_plan.value.sent(t))
            for some in np.split(np.arange(len(p)), np.flatnonzero(np.diff(rows >> 20)) + 1):
                part, value, of, own = signatures(p[some], t[some], with_plan.value)
                yield pd.DataFrame({"part": part, "value": value.view(np.int64), "fp": p[some][of].view(np.int64), "own": own})

    signed = materialize(fps.mapInPandas(sign, "part int, value long, fp long, own boolean"), "signatures")
    # a key that nobody probes, or that only probes meet, has no pairs; one of many members is dealt as pairs of blocks
    keys = signed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select("part", "value", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = signed.join(keys, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("a", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    placed = placed.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["part", "value", "i", "j"]
    grid = placed.select("part", "value", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), (F.col("a") > F.least("a", "b")).alias("upper"), "fp", "own").repartition(*place).sortWithinPartitions(*place)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def found(df: pd.DataFrame) -> pd.DataFrame:
            part, value, i, j = (df[c].to_numpy(np.int64) for c in place)
            new = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(df) else np.zeros(0, bool)
            side = np.where(i == j, 2, df["upper"].to_numpy(bool).astype(np.int64))
            x, y = links_of_keys(np.cumsum(new), df["fp"].to_numpy(np.int64).view(np.uint64), df["own"].to_numpy(bool), side, most)
            x, y = x.view(np.int64), y.view(np.int64)
            return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})

        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            last = (df[place] == df[place].iloc[-1]).all(axis=1).to_numpy()
            cut = len(df) - int(last[::-1].argmin() if not last.all() else len(df))
            rest = df.iloc[cut:]
            if cut:
                yield found(df.iloc[:cut])
        if rest is not None and len(rest):
            yield found(rest)

    return materialize(grid.mapInPandas(link, "x long, y long").distinct(), "links")
