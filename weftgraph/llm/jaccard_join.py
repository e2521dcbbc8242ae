"""N-gram Jaccard join by signature trees.

A document's set is that of its distinct word shingles; documents with equal sets are one class, so copies are never compared. Any global order of shingles
makes this true: two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each. The order here puts shingles last that many rows of a
bounded sample hold; it changes how much work there is, never the result. Sets that share such a key come together in buckets:

- a key of few sets gives pairs; their number of shared keys bounds their overlap, and the pairs that can still be similar form clusters, each a bucket. A cluster of more than BLOCK_SETS sets may be a chain
  of pairs that aren't links: it is cut into blocks, and only those pairs of blocks are made that hold a pair, each of the sets of its pairs alone;
- a key of many sets (copies with small changes, or a common passage) is a bucket itself. There, only pairs count whose smallest key of this kind is the bucket's.

In a bucket the sets are the leaves of a signature tree whose nodes hold the OR of their token bitmaps and the range of their sizes. Two nodes are compared only if the
largest overlap that bitmaps and sizes allow could be enough; what is left is counted exactly. Keys of more than BLOCK_SETS sets are dealt over tasks as pairs of blocks, by classes of size: sets of classes that
aren't neighbours can't be similar.
A bucket passes on a link count for each set and one edge for each set it has joined to others, not its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, materialize, scratch
from weftgraph.llm.shingles import shingle_sets
from weftgraph.operators.components import connected_components

#: Rows whose shingles set the order, and how many of these shingles are kept: a broadcast of at most 2 MB.
SAMPLE_ROWS, COMMON_SHINGLES = 8_192, 131_072
#: A shingle in this many sampled rows is dealt out by set as well as by key.
HEAVY_ROWS = 8
#: A key of more sets than this is a bucket.
FEW_SETS = 96
BLOCK_SETS = 512
#: Numbers of blocks of a class of size, more than a class can have.
CLASS_BLOCKS = 1 << 40
FAN_OUT = 8


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m shingles with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    """How many of its first shingles a set of n must show."""
    return n - (-(-percent * n // 100)) + 1


class SignatureTree:
    """Levels of nodes over sets: OR-combined bitmaps, size ranges, and the most shingles that fall on bits already set."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            at = (s % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # neighbours in the tree are sets with the same smallest shingle, then of like size
        self.order = np.lexsort((self.sizes, [s[0] for s in sets]))
        maps, sizes = maps[self.order], self.sizes[self.order]
        extra = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, extra)]
        while len(maps) > 1:
            starts = np.arange(0, len(maps), FAN_OUT)
            _, low, high, extra = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, starts)
            self.levels.append((maps, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(extra, starts)))


def tree_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: places (in the original order) of all pairs whose bitmaps and sizes allow the similarity. Shingles in common lie on bits of both, one to a bit but for the extra ones."""

    def possible(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (ma, low_a, high_a, ex_a), (mb, low_b, high_b, ex_b) = a.levels[la], b.levels[lb]
        fit = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
        i, j = i[fit], j[fit]
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 65_536):
            x, y = i[k : k + 65_536], j[k : k + 65_536]
            shared = np.bitwise_count(ma[x] & mb[y]).sum(axis=1, dtype=np.int64) + np.minimum(ex_a[x], ex_b[y])
            most = np.minimum(shared, np.minimum(high_a[x], high_b[y]))
            keep[k : k + 65_536] = most >= needed(low_a[x], low_b[y], percent)
        return np.stack([i[keep], j[keep]])

    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        i, j = possible(la, lb, i, j)
        if la == lb == 0 or not len(i):
            return a.order[i], b.order[j]
        if la >= lb:
            la -= 1
            i, j = _children(i, j, len(a.levels[la][0]))
        else:
            lb -= 1
            j, i = _children(j, i, len(b.levels[lb][0]))


def _children(parents: np.ndarray, others: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    kids = parents[:, None] * FAN_OUT + np.arange(FAN_OUT)
    there = kids < count
    return kids[there], np.broadcast_to(others[:, None], kids.shape)[there]


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections a[i] & b[j]: one by one, or as products of incidence matrices if most pairs are asked for."""
    if 8 * len(i) < len(a) * len(b) or len(a) * len(b) < 4_096:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    words, of = np.unique(np.concatenate(a), return_inverse=True)
    rows_a = np.repeat(np.arange(len(a)), [len(s) for s in a])
    flat_b = np.concatenate(b)
    at = np.minimum(np.searchsorted(words, flat_b), len(words) - 1)
    hit = words[at] == flat_b
    rows_b, of_b = np.repeat(np.arange(len(b)), [len(s) for s in b])[hit], at[hit]
    # shingles that both sides hold, renumbered
    both, of_b = np.unique(of_b, return_inverse=True)
    place = np.full(len(words), -1)
    place[both] = np.arange(len(both))
    rows_a, of_a = rows_a[place[of] >= 0], place[of][place[of] >= 0]
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(both), 2_048):
        x, y = np.zeros((len(a), 2_048), np.float32), np.zeros((len(b), 2_048), np.float32)
        mine, theirs = (of_a >= k) & (of_a < k + 2_048), (of_b >= k) & (of_b < k + 2_048)
        x[rows_a[mine], of_a[mine] - k] = 1
        y[rows_b[theirs], of_b[theirs] - k] = 1
        total += x @ y.T
    return total[i, j].astype(np.int64)


def _first_common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, key: int | None) -> np.ndarray:
    """Of pairs: whether `key` is the smallest key of large buckets that both have; without a key, whether they have none in common."""
    names = np.unique(np.concatenate([*a, *b, np.zeros(0, np.int64)]))
    names = names if key is None else names[names < key]
    if not len(names) or not len(i):
        return np.ones(len(i), bool)

    def matrix(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), len(names)), np.float32)
        for row, keys in zip(out, lists, strict=True):
            keys = keys if key is None else keys[keys < key]
            row[np.searchsorted(names, keys)] = 1
        return out

    if len(i) < 64:
        return np.array([not len(np.intersect1d(np.intersect1d(a[x], b[y]), names)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    return (matrix(a) @ matrix(b).T)[i, j] == 0


def join_blocks(a: dict, b: dict | None, key: int | None, percent: int) -> pd.DataFrame:
    """Links between two blocks of sets, or within one (b None): for each set that has any, the number of documents that it links with, and the least set it is joined to."""
    same = b is None
    b = a if same else b
    bits = 64
    while bits < 4_096 and bits < 1.5 * max(len(s) for s in [*a["sets"], *b["sets"]]):
        bits *= 2
    ta = SignatureTree(a["sets"], bits)
    tb = ta if same else SignatureTree(b["sets"], bits)
    i, j = tree_pairs(ta, tb, percent)
    if same:
        i, j = i[i < j], j[i < j]
    mine = _first_common(a["hot"], b["hot"], i, j, key)
    i, j = i[mine], j[mine]
    both = overlaps(a["sets"], b["sets"], i, j)
    n, m = ta.sizes[i], tb.sizes[j]
    linked = 100 * both >= percent * (n + m - both)
    i, j = i[linked], j[linked]
    names = a["digests"] if same else a["digests"] + b["digests"]
    copies = np.array(a["copies"] if same else a["copies"] + b["copies"], np.int64)
    if not same:
        j = j + len(a["digests"])
    links = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
    # labels: the least place reachable
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        then = label.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        then = then[then]
        if (then == label).all():
            break
        label = then
    some = np.flatnonzero(links)
    return pd.DataFrame({"digest": [names[x] for x in some], "root": [names[label[x]] for x in some], "links": links[some].astype(np.int64)})


def document_sets(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """For each row of docs its id, print (a hash of the text), the digest and size of its set and, once for equal sets in a task, the set's first shingles in the common order; n_heavy counts those at their end that many sampled rows hold."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("print"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "print"), F.lit(1_000_000)) < int(1_000_000 * share)).dropDuplicates(["print"])

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sets = shingle_sets(df["text"].tolist(), shingle)
            if sets:
                yield pd.DataFrame({"h": np.concatenate(sets).view(np.int64)})

    counts = picked.select("text").mapInPandas(explode, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    common = counts.orderBy(F.desc("c"), "h").limit(COMMON_SHINGLES).toPandas()
    at = np.argsort(common["h"].to_numpy(np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast((common["h"].to_numpy(np.int64).view(np.uint64)[at], common["c"].to_numpy(np.int64)[at]))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, often = known.value
        seen: set[bytes] = set()
        for df in batches:
            out = []
            for s in shingle_sets(df["text"].tolist(), shingle):
                if not len(s):
                    out.append((None, 0, None, 0))
                    continue
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if name in seen:
                    out.append((name, len(s), None, 0))
                    continue
                seen.add(name)
                p = prefix_length(len(s), percent)
                rank = np.zeros(len(s), np.int64)
                if len(hashes):
                    near = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[near] == s, often[near], 0)
                first = np.argsort(rank, kind="stable")[:p]
                out.append((name, len(s), s[first].view(np.int64), int((rank[first] >= HEAVY_ROWS).sum())))
            yield pd.DataFrame({"id": df["id"], "print": df["print"], "digest": [x[0] for x in out], "n": np.array([x[1] for x in out], np.int32), "keys": [x[2] for x in out], "n_heavy": np.array([x[3] for x in out], np.int32)})

    return rows.mapInPandas(digest, "id string, print long, digest binary, n int, keys array<long>, n_heavy int").withColumn("id", F.col("id").cast(kind))


def _candidates(keyed: DataFrame, percent: int) -> DataFrame:
    """From (key, salt, heavy, s, n), sorted by key within partitions: pairs (a, b) of sets that share a key of few sets, and (a, key) for each set of a key of many."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last key, which may go on, each set once; none of a key of many sets, whose rows are passed on as they come
        long_key: tuple | None = None

        def groups(df: pd.DataFrame, last: bool):
            nonlocal rest, long_key
            if rest is not None:
                df = pd.concat([rest, df])
            rest = None
            if not len(df):
                return
            key, salt, heavy, s, n = (df[c].to_numpy() for c in ("key", "salt", "heavy", "s", "n"))
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]), True])
            many = np.diff(edge)
            upto = len(many)
            tail = (key[-1], salt[-1])
            if not last and tail != long_key and not heavy[-1]:
                once = df.iloc[edge[-2] :].drop_duplicates("s")
                if len(once) <= FEW_SETS:
                    rest, upto = once, upto - 1
            a_out, b_out, key_out, n_out, m_out = [], [], [], [], []
            begun = edge[:upto]
            going_on = (key[begun] == long_key[0]) & (salt[begun] == long_key[1]) if long_key else np.zeros(upto, bool)
            for g in np.flatnonzero((many[:upto] > 1) | heavy[begun] | going_on).tolist():
                x, y = edge[g], edge[g + 1]
                ids, at = np.unique(s[x:y], return_index=True)
                size = n[x:y][at]
                if heavy[x] or len(ids) > FEW_SETS or (key[x], salt[x]) == long_key:
                    if len(ids) > FEW_SETS:
                        long_key = (key[x], salt[x])
                    a_out.append(ids)
                    b_out.append(np.zeros(len(ids), np.int64))
                    key_out.append(np.full(len(ids), key[x]))
                    n_out.append(size)
                    m_out.append(np.zeros(len(ids), np.int64))
                elif len(ids) > 1:
                    i, j = np.triu_indices(len(ids), 1)
                    fit = (100 * size[i] >= percent * size[j]) & (100 * size[j] >= percent * size[i])
                    i, j = i[fit], j[fit]
                    a_out.append(ids[i])
                    b_out.append(ids[j])
                    key_out.append(np.zeros(len(i), np.int64))
                    n_out.append(size[i])
                    m_out.append(size[j])
            if a_out:
                m = np.concatenate(m_out)
                yield pd.DataFrame({"pair": m > 0, "a": np.concatenate(a_out), "b": np.concatenate(b_out), "key": np.concatenate(key_out), "n": np.concatenate(n_out), "m": m})

        for df in batches:
            yield from groups(df, False)
        if rest is not None:
            yield from groups(rest.iloc[:0], True)

    return keyed.mapInPandas(match, "pair boolean, a long, b long, key long, n long, m long")


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of docs.

    Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; a set has the distinct runs of `shingle` words, or the whole sequence if there are fewer. Rows link when
    100 * intersection >= percent * union. component_id is the smallest id that links reach; n_links counts the other rows that a row links with.

    Null, empty and blank texts have an empty set: they link with nothing and are their own component. Rows with a null id take part; their component_id is null only if no row they
    reach has an id. Rows that repeat an id are rows of their own. An empty table gives no rows. Other columns of docs are not returned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with scratch(spark):
        return _components(docs, shingle, percent, id_col, text_col)


def _components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sets = materialize(document_sets(docs, shingle, percent, id_col, text_col), "sets", keep=True)
    classes = materialize(sets.filter("n > 0").groupBy("digest").agg(F.min(F.struct("id", "print")).alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")
    # 64 bits name a set: under the first seed that tells all sets apart
    short = next(h for h in (F.xxhash64(F.lit(seed), "digest") for seed in range(64)) if classes.groupBy(h.alias("s")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty())
    classes = classes.withColumn("s", short)

    once = sets.filter("keys is not null").select(short.alias("s"), "n", F.size("keys").alias("p"), "n_heavy", F.posexplode("keys").alias("pos", "key"))
    heavy = F.col("pos") >= F.col("p") - F.col("n_heavy")
    keyed = once.select("key", F.when(heavy, F.pmod("s", F.lit(64))).otherwise(0).cast("int").alias("salt"), heavy.alias("heavy"), "s", F.col("n").cast("long").alias("n"))
    found = materialize(_candidates(keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "s"), percent), "candidates")

    # pairs: with c shared keys, the overlap is at most c and what either set has beyond its keys
    n, m = F.col("n"), F.col("m")
    beyond = F.greatest(n - prefix_of(n, percent), m - prefix_of(m, percent))
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    pairs = found.filter("pair").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("m").alias("m")).filter(F.col("c") + beyond >= least).select("a", "b")
    pairs = materialize(pairs, "pairs")
    clusters = materialize(connected_components(pairs, "a", "b").select(F.col("component").alias("bucket"), F.col("node").alias("s")), "clusters")
    large = found.filter("not pair").groupBy(F.col("key").alias("bucket"), F.col("a").alias("s")).agg(F.max("n").alias("n"))
    members = materialize(_dealt(clusters, pairs, large, percent), "members")

    # each needed text once, compressed, with the keys of large buckets that its set has
    squeeze = _squeeze()
    hot = members.filter("not cluster").select("s", "bucket").distinct().groupBy("s").agg(F.collect_list("bucket").alias("hot"))
    wanted = classes.join(members.select("s").distinct().hint("merge"), "s", "left_semi").join(hot, "s", "left").select("s", "digest", "copies", "rep", F.coalesce("hot", F.array().cast("array<long>")).alias("hot"))
    text_of = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__print"), F.col(text_col).alias("__text"))
    matched = text_of.join(wanted, F.col("__id").eqNullSafe(F.col("rep.id")) & (F.col("__print") == F.col("rep.print"))).dropDuplicates(["digest"])
    texts = materialize(matched.select("s", "digest", "copies", "hot", squeeze("__text").alias("packed")), "texts")

    place = ["bucket", "cluster", "i", "j"]
    grid = members.join(texts, "s").drop("s").repartition(*place).sortWithinPartitions(*place)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swell = zstandard.ZstdDecompressor()

        def block(df: pd.DataFrame) -> dict:
            return {"sets": shingle_sets([swell.decompress(x).decode() for x in df["packed"]], shingle), "hot": [np.asarray(x, np.int64) for x in df["hot"]], "digests": df["digest"].tolist(), "copies": df["copies"].tolist()}

        def run(df: pd.DataFrame) -> pd.DataFrame:
            first = df.iloc[0]
            key = None if first["cluster"] else int(first["bucket"])
            mine = df[df["block"] == first["i"]]
            other = df[df["block"] == first["j"]] if first["i"] != first["j"] else None
            if not len(mine) or (other is not None and not len(other)):
                return pd.DataFrame({"digest": [], "root": [], "links": []})
            return join_blocks(block(mine), None if other is None else block(other), key, percent)

        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            tag = df[place].apply(tuple, axis=1) if len(df) else pd.Series([], dtype=object)
            edge = np.flatnonzero(np.r_[True, (tag.shift() != tag).to_numpy()[1:]]) if len(df) else np.zeros(0, int)
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                yield run(df.iloc[x:y])
            rest = df.iloc[edge[-1] :] if len(edge) else None
        if rest is not None and len(rest):
            yield run(rest)

    linked = materialize(grid.mapInPandas(link, "digest binary, root binary, links long"), "links")
    joined = connected_components(linked, "digest", "root")
    counts = linked.groupBy("digest").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "least", "copies").join(joined.withColumnRenamed("node", "digest"), "digest", "left").join(counts, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    lows = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = materialize(named.join(lows, "component").select(F.col("digest").alias("__digest"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "components", keep=True)
    return sets.join(result, F.col("digest") == F.col("__digest"), "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _dealt(clusters: DataFrame, pairs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """bucket, cluster, s, block, i, j: what sets each pair (i, j) of blocks of a bucket gets, and the block of each. Buckets of one set are left out."""
    ends = lambda block, other: [F.least(block, other).alias("i"), F.greatest(block, other).alias("j")]
    # clusters: small ones are one block; of others the blocks' pairs that hold a pair
    sizes = clusters.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK_SETS).cast("int")).drop("size")
    zero = F.lit(0).alias
    small = clusters.join(sizes.filter("blocks = 1"), "bucket").select("bucket", F.lit(True).alias("cluster"), "s", zero("block"), zero("i"), zero("j"))
    block_of = lambda s: F.pmod(F.xxhash64(s), "blocks").cast("int")
    chained = clusters.join(sizes.filter("blocks > 1"), "bucket").withColumnRenamed("s", "a").join(pairs, "a").withColumns({"x": block_of("a"), "y": block_of("b")})
    both = F.inline(F.array(F.struct(F.col("a").alias("s"), F.col("x").alias("block")), F.struct(F.col("b").alias("s"), F.col("y").alias("block"))))
    chained = chained.select("bucket", F.lit(True).alias("cluster"), *ends("x", "y"), both).distinct().select("bucket", "cluster", "s", "block", "i", "j")
    # keys of many sets: a class of size meets itself and its neighbours; classes are a little wider than the ratio of sizes that a link allows
    step = math.log(100 / percent) * 1.000001 if percent < 100 else 1e-9
    classed = large.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step).cast("long"))
    counts = classed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size"))
    shape = counts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("size") / BLOCK_SETS).cast("int")))).alias("blocks"), F.sum("size").alias("size")).filter("size > 1")
    one = F.col("size") <= BLOCK_SETS
    placed = classed.join(shape, "bucket").withColumn("block", F.when(one, 0).otherwise(F.col("class") * CLASS_BLOCKS + F.pmod(F.xxhash64("s"), F.element_at("blocks", F.col("class")))))
    near = F.flatten(F.transform(F.sequence(F.col("class") - 1, F.col("class") + 1), lambda c: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("blocks", c), F.lit(0))), lambda h: c * CLASS_BLOCKS + h)))
    known = F.filter(near, lambda x: F.pmod(x, F.lit(CLASS_BLOCKS)) < F.coalesce(F.try_element_at("blocks", F.shiftright(x, 40)), F.lit(0)))
    meets = F.when(one, F.array(F.lit(0).cast("long"))).otherwise(known)
    keyed = placed.withColumn("other", F.explode(meets)).select("bucket", F.lit(False).alias("cluster"), "s", F.col("block").cast("long"), *ends(F.col("block").cast("long"), F.col("other")))
    return small.unionByName(chained).select("bucket", "cluster", "s", *[F.col(c).cast("long") for c in ("block", "i", "j")]).unionByName(keyed)


def prefix_of(n, percent: int):
    return n - F.ceil(F.lit(percent) * n / 100) + 1


def _squeeze():
    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: pack.compress(t.encode()))

    return squeeze


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows that link, over any number of others, to one of smaller id. Rows that repeat the smallest id of a group all stay, as do rows with an empty set or without an id."""
    found = jaccard_components(docs, shingle, percent, id_col, text_col).filter("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, F.col(id_col) == F.col("__gone"), "left_anti")
