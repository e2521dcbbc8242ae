"""Document fingerprints from prefix polynomial hashes.

For code points c[0], c[1], ... the prefix array is H[i] = sum of c[j] * B**j for j < i, modulo a prime. The hash of the span [i, i + m) moved to
place 0 is (H[i + m] - H[i]) * B**-i: two spans, of one text or of two, are taken as equal when these agree modulo both primes (62 bits), and the
longest common extension of two places is found by binary search over m. A fingerprint holds the length, the hash of the whole text and the
smallest hashes among all windows of the text (a bottom-k sketch), all read from the prefix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, partitions

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW, SKETCH, MARKS = 16, 64, 32
#: Texts below FINE_CHARS also carry a sketch of short windows; it decides if the shorter text has under SHORT_CHARS.
FINE_WINDOW, FINE_CHARS, SHORT_CHARS = 4, 192, 96


class _Powers:
    """Powers of the bases and of their inverses, grown by doubling."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> _Powers:
        while len(self.up[0]) < n:
            m = len(self.up[0])
            for table, signs in ((self.up, 1), (self.down, -1)):
                for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
                    step = np.uint64(pow(b, signs * m, p))
                    table[k] = np.concatenate([table[k], table[k] * step % np.uint64(p)])
        return self


_POWERS = _Powers()


class PrefixHash:
    """Prefix arrays of a text; None counts as empty."""

    def __init__(self, text: str | None) -> None:
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = n = len(codes)
        self.powers = _POWERS.upto(n + 1)
        self.h = []
        for k, p in enumerate(PRIMES):
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * self.powers.up[k][:n] % np.uint64(p), out=h[1:])
            self.h.append(h % np.uint64(p))

    def span(self, i: int, m: int) -> tuple[int, ...]:
        """The hash of the m code points from i on, alike wherever they stand."""
        return tuple((int(h[i + m]) - int(h[i])) * int(down[i]) % p for h, down, p in zip(self.h, self.powers.down, PRIMES, strict=True))

    def windows(self, m: int) -> np.ndarray:
        """The hashes of all windows of m code points, by the first prime."""
        if self.n < m:
            return np.zeros(0, np.uint64)
        p = np.uint64(PRIMES[0])
        return (self.h[0][m:] + p - self.h[0][:-m]) % p * self.powers.down[0][: self.n - m + 1] % p


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, m: int) -> bool:
    """Whether a[i:i+m] and b[j:j+m] are equal, both within their texts."""
    return i + m <= a.n and j + m <= b.n and a.span(i, m) == b.span(j, m)


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The largest m with a[i:i+m] == b[j:j+m]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        m = (low + high + 1) // 2
        if a.span(i, m) == b.span(j, m):
            low = m
        else:
            high = m - 1
    return low


def _smallest(values: np.ndarray, k: int) -> list[int]:
    """The k smallest distinct values, mixed first so that order says nothing about text."""
    v = ((values + np.uint64(0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    take = 2 * k
    while True:
        some = np.unique(v if take >= len(v) else np.partition(v, take)[:take])
        if len(some) >= k or take >= len(v):
            return some[:k].tolist()
        take *= 4


def _spacing(n: int) -> int:
    """The power of two by which a text of n code points has at most MARKS marks."""
    return 1 << max(0, (max(n, 1) - 1) // MARKS).bit_length()


def fingerprint(text: PrefixHash) -> str:
    """length.whole.sketch.fine.marks, each in hexadecimal; equal texts give equal strings. Marks are the prefix array at multiples of a spacing."""
    whole = "".join(f"{x:08x}" for x in text.span(0, text.n))
    fine = _smallest(text.windows(FINE_WINDOW), SKETCH) if text.n < FINE_CHARS else []
    step = _spacing(text.n)
    lists = _smallest(text.windows(WINDOW), SKETCH), fine, text.h[0][step : text.n + 1 : step].tolist()
    return ".".join((f"{text.n:x}", whole, *("".join(f"{x:08x}" for x in s) for s in lists)))


def _beginning(a: list[str], b: list[str]) -> float:
    """The share of the longer text up to the last mark at which both prefixes are equal, by binary search over the marks that both have."""
    n, m = int(a[0], 16), int(b[0], 16)
    x, y = _spacing(n), _spacing(m)
    step = max(x, y)
    mark = lambda s, k, own: s[8 * (k * step // own - 1) : 8 * (k * step // own)]
    low, high = 0, min(n, m) // step
    while low < high:
        k = (low + high + 1) // 2
        if mark(a[4], k, x) == mark(b[4], k, y):
            low = k
        else:
            high = k - 1
    return low * step / max(n, m, 1)


def _alike(a: str, b: str) -> float:
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    if not x or not y:
        return 0.0
    full = len(x) == SKETCH or len(y) == SKETCH
    union = sorted(x | y)[: SKETCH if full else None]
    both = len(x & y & set(union))
    return 2 * both / (len(union) + both)


def likeness(a: str, b: str) -> float:
    """How much two texts have in common, from their fingerprints: the share of their windows (Dice coefficient of the sketches) or the share that their common beginning has in the longer one, whichever is more; 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = a.split("."), b.split(".")
    short = min(int(x[0], 16), int(y[0], 16)) < SHORT_CHARS and x[3] and y[3]
    return max(_alike(x[3], y[3]) if short else _alike(x[2], y[2]), _beginning(x, y))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """For each document: n_chars, its fingerprint, and those of its edited text, whose last quarter is the beginning of the next document by id.

    Adds edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and shared_prefix (longest common extension of text and edited text at 0).
    The order is by id in `buckets` ranges, twice as many as shuffle partitions: only their bounds reach the driver. Each range is sorted by one task; the first row of a range is
    also sent to the range before it (the very first one to the last), so each text is moved once.

    Ids are integers. A null text counts as empty; null ids come first, all in one range; equal ids are ordered by a hash of the text, then by its compressed form. A single document is its own next one.
    An empty table gives no rows. Other columns of docs are not returned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = buckets or 2 * partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select(F.col("id").cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.25 / n)
    bounds = np.unique(np.array([int(x) for x in cuts], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")), dtype="int32")

    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in texts:
            yield batch.map(lambda t: squeeze.compress(f"{fingerprint(PrefixHash(t))}\n{t}".encode()))

    @F.pandas_udf("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long")
    def compare(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        swell = zstandard.ZstdDecompressor()
        for packed, following in parts:
            out = []
            for own, after in zip(packed, following, strict=True):
                f, _, t = swell.decompress(own).decode().partition("\n")
                g, _, u = swell.decompress(after).decode().partition("\n")
                quarter = len(t) // 4
                e = t[: len(t) - quarter] + u[:quarter]
                a, b = PrefixHash(t), PrefixHash(e)
                h = f if t == e else fingerprint(b)
                out.append((len(t), hashlib.sha256(e.encode()).hexdigest(), f, h, likeness(f, h), likeness(f, g), longest_common_extension(a, 0, b, 0)))
            yield pd.DataFrame(out, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix"])

    # the first id of each range that has rows, and the range before it: at most n rows
    first = rows.select("id", bucket_of("id").alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"))).alias("least"))
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.withColumn("before", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(whole)))
    begin = first.select(F.col("least.id").alias("first_id"), F.col("before"))
    order = F.struct(F.xxhash64("text").alias("h"), F.col("text"))
    heads = rows.join(F.broadcast(begin), F.col("id").eqNullSafe(F.col("first_id"))).groupBy("before").agg(F.min_by(F.struct("id", F.xxhash64("text").alias("tie"), "text"), order).alias("row"))
    heads = heads.select("row.id", "row.tie", "row.text", F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    # what moves is each text with its fingerprint, compressed
    every = rows.select("id", F.xxhash64("text").alias("tie"), "text", bucket_of("id").alias("bucket"), F.lit(0).alias("extra")).unionByName(heads).withColumn("packed", pack("text")).drop("text")
    inside = Window.partitionBy("bucket").orderBy("extra", "id", "tie", "packed")
    paired = every.withColumn("next", F.lead("packed").over(inside)).filter("extra = 0")
    return paired.select(F.col("id").alias("doc_id"), compare("packed", "next").alias("c")).select("doc_id", "c.*")
