"""SimHash near-duplicates, conversation repair and centroid clustering against plain Python."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import clustering, conversations, simhash

# SimHash near-duplicates


def plain_fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(prints, most):
    """The least place reachable from each."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["tha", "re", "On", "ed", "é", "sh", "ti"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 3 + 9 * i) for i in range(1, 25)]
    words = base[20].split()
    near = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(0, 150, 3)]
    return [*base, *[base[5]] * 20, *near, None, "", " \n\t ", "one", "ONE two", "one  TWO", "ONE\x0btwo three\x0cFOUR ", "ж𝒳 " * 3000, prose(7, 20000)]


def test_fingerprints(texts):
    for t in texts:
        assert simhash.fingerprint((t or "").encode())[0] == plain_fingerprint(t)
    assert simhash.fingerprint(b"a b c d e")[1] == 2 and simhash.fingerprint(b" ")[1] == 0
    few, simhash.CHUNK_SHINGLES = simhash.CHUNK_SHINGLES, 7
    try:
        assert simhash.fingerprint(texts[10].encode())[0] == plain_fingerprint(texts[10])
    finally:
        simhash.CHUNK_SHINGLES = few


def test_simhash_components(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts, 100)] + [(None, prose(3, 9), 1, "x"), (None, texts[3], 1, "x"), (104, texts[4], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, fp string")
    got = sorted(simhash.simhash_components(docs).collect(), key=repr)
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    groups = collections.defaultdict(list)
    roots = plain_near(prints, 4)
    for (i, *_), r in zip(rows, roots, strict=True):
        groups[r].append(i)
    wanted = [(i, f"{p:016x}", min((x for x in groups[r] if x is not None), default=None)) for (i, *_), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == sorted(wanted, key=repr)
    # blank texts link with each other by the fingerprint zero
    assert len({r["component_id"] for r in got if r["fingerprint"] == "0" * 16}) == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["component_id"] for r in simhash.simhash_components(named).collect() if r["component_id"]} <= {f"d{i}" for i, *_ in rows}


@pytest.mark.parametrize("most, blocks", [(4, 1 << 14), (4, 40), (3, 1 << 14), (1, 1 << 14), (0, 1 << 14)])
def test_links_of_dense_and_scattered_fingerprints(spark, most, blocks):
    """Groups around centres, a chain, and many under one key, also when a key is dealt as blocks: the same components as all pairs."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    chain = rng.getrandbits(64)
    prints |= {chain ^ ((1 << 4 * k) - 1) for k in range(16)}
    prints = sorted(prints)
    fps = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["x"] % 2**64, r["y"] % 2**64) for r in simhash.hamming_links(fps, most, blocks).collect()]
    assert all((x ^ y).bit_count() <= 4 * len(prints) for x, y in links)
    place = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))
    for _ in range(len(prints)):
        before = list(parent)
        for x, y in links:
            low = min(parent[place[x]], parent[place[y]])
            parent[place[x]] = parent[place[y]] = low
        if parent == before:
            break
    assert parent == plain_near(prints, most)


def test_thresholds_find_every_pair_and_are_the_cheapest():
    """Any thresholds that a plan gives add up to what the pigeonhole principle needs; none that do cost less; correlated bits stand together."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    prints = np.where(rng.random(300) < 0.5, prints | np.uint64(0xFF), prints & ~np.uint64(0xFF))  # bits 0 to 7 go together
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    groups = simhash.correlated_groups(bits.T @ bits, len(prints))
    assert sorted(groups.ravel().tolist()) == list(range(64)) and list(range(8)) in groups.tolist()
    counts = np.stack([np.bincount(simhash.gather(prints, g).astype(int), minlength=256) for g in groups]).astype(float)
    for m in (2, 3, 4, 5):
        plan = simhash.Plan(groups, counts, m, 4)
        t, cost = plan.thresholds(prints)
        assert (t.sum(1) == 4 - m + 1).all() and (t >= -1).all()
        table = np.concatenate([np.zeros((len(prints), m, 1)), plan.expected(prints) + simhash.PROBE_COST * plan.ball[None]], 2)
        least = np.min([sum(table[:, i, e] for i, e in enumerate(deal)) for deal in itertools.product(range(6), repeat=m) if sum(deal) == 5], axis=0)
        assert np.allclose(least, cost)
    # within one group of bits the estimate is a count
    plan = simhash.Plan(groups, counts, 8, 4)
    mine = simhash.gather(prints, plan.bits[2])
    assert np.allclose(plan.expected(prints)[:, 2, 1], [(np.bitwise_count(mine ^ x) <= 1).sum() for x in mine])


# conversation repair


def plain_repair(rows):
    """conv -> what the contract asks for, by search over all edits."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            by[c] += [(t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    return {c: plain_account(rs) for c, rs in by.items()}


def plain_account(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, r, x in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", x)
        faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, *_ in rows if t is not None]
    then = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        edits = [(3, "I", i, then[state, n[0]], ((n, ""),)) for n in ("user", "assistant") if (state, n[0]) in then]
        if i < len(rows):
            _, r, x = rows[i]
            edits.append((4, "D", i + 1, state, ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                edits += [(more, "K", i + 1, then[state, r[:1]], ((r, x),))] if (state, r[:1]) in then else []
                edits += [(3 + more, "R", i + 1, then[state, n[0]], ((n, x),)) for n in ("user", "assistant") if (state, n[0]) in then]
        for c, e, j, s, m in edits:
            heapq.heappush(heap, (cost + c, audit + e, j, s, made + m))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{x}" for r, x in made)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


SAID = ["a.", "b", "", " \t", "c!", "d?\n", "e. f", None, "ж。", "a.\x00"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ünder"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = []
    for c in range(150):
        n = rng.randrange(1, 12)
        tame = rng.random() < 0.5
        for t in range(n):
            role = ("user", "assistant")[t % 2] if tame and rng.random() < 0.9 else rng.choice(ROLES)
            rows.append((c, None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 5]), role, rng.choice(SAID) if rng.random() < 0.4 else f"{prose(t, 4)}."))
    rows += [(None, t, rng.choice(ROLES), "null.") for t in range(5)] + [(200, 1, "user", "same.")] * 9 + [(201, None, None, None)] * 3
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversation_repair(spark, talks):
    made = [(*r, 7, "x") for r in talks]
    got = conversations.repair_digests(spark.createDataFrame(made, "conv_id long, turn long, role string, text string, part int, edits string"))
    assert got.columns == COLUMNS
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert found == plain_repair(talks)


def test_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_digests(spark.createDataFrame([], schema)).count() == 0
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = conversations.repair_digests(spark.createDataFrame([(c, 0, "user", "x.") for c in gone], schema)).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 3


@pytest.mark.parametrize("piece_rows", [1, 3, 256])
def test_pieces_make_no_difference(spark, piece_rows):
    """A long conversation cut into pieces has the cheapest audit of the whole, and real repaired rows; string ids, other column names."""
    rng = random.Random(2)
    rows = {f"c{c}": [(t, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["x.", "y", "z!", f"{t}.", f"{t}"])) for t in range(n)] for c, n in enumerate((1, 2, 40, 90, 333))}
    frame = spark.createDataFrame([(c, *r) for c, rs in rows.items() for r in rs], "c string, t int, r string, x string")
    repaired, account = conversations.repair(frame, "c", "t", "r", "x", piece_rows)
    audits = {r["conv"][1:]: r for r in conversations.digests(repaired).collect()}
    told = {r["conv_id"]: r for r in account.collect()}
    for c, rs in rows.items():
        wanted = plain_account(rs)
        assert (*[told[c][k] for k in COLUMNS[1:7]], audits[c]["audit"], audits[c]["repaired_sha256"]) == wanted
    roles = [r["role"][0] for r in repaired.filter("conv_id = 'c4' and edit <> 'D'").orderBy("part", "at", "no").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def test_each_signature_is_solved_once():
    conversations.costs.cache_clear()
    for _ in range(5):
        conversations.spans("uaUAuoa")
    assert conversations.costs.cache_info().misses == 4 * 8


# centroid clustering


def plain_clusters(vectors, k, rounds, seed=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in first[:k]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = near()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = near()
    inertia = collections.Counter()
    for d, c in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr)


def vectors_of(kind):
    rng = np.random.default_rng(1)
    if kind == "ties":  # few values, so that equal distances and equal vectors are common
        v = rng.integers(-1, 2, (300, 64)) * (rng.random((300, 64)) < 0.05) / 256
    else:
        centres = rng.normal(size=(12, 64))
        v = centres[rng.integers(0, 12, 300)] + 0.1 * rng.normal(size=(300, 64))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(400, None), (401, []), (402, [1.0] * 63), (403, [float("nan")] + [0.0] * 63), (404, [float("inf")] * 64), (405, [None] + [0.0] * 63), (None, [0.5] * 64), (7, rows[3][1]), (7, rows[7][1])]
    return rows + odd


SCHEMA = "vec_id long, embedding array<float>, cluster int, id string"


@pytest.mark.parametrize("kind", ["ties", "groups"])
def test_clusters(spark, kind):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors_of(kind)]
    got = clustering.cluster_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), k=20, rounds=4)
    found = sorted((tuple(r)[:6] for r in got.collect()), key=repr)
    assert found == plain_clusters(rows, 20, 4)
    if kind == "groups":  # the last assignment looks at few centroids
        assert got.agg(F.sum("worked")).first()[0] < 20 * len(found) / 3


def test_few_vectors_and_none(spark):
    rows = vectors_of("groups")[:3]
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    few = clustering.cluster_vectors(made, k=40).collect()
    assert sorted(r["cluster"] for r in few) == [0, 1, 2] and {r["inertia"] for r in few} == {0}
    assert [r["cluster"] for r in clustering.cluster_vectors(made.limit(1), k=40).collect()] == [0]
    assert {r["cluster"] for r in clustering.cluster_vectors(made, k=1).collect()} == {0}
    assert clustering.cluster_vectors(made.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64, 1, "x"), (2, [1.0] * 64, 1, "x")], SCHEMA)
    assert [r["vec_id"] for r in clustering.cluster_vectors(huge).collect()] == [2]


def test_bounds_skip_no_change():
    """Assignments with bounds over moving centroids are those of a full search, ties included."""
    rng = np.random.default_rng(4)
    x, c = rng.integers(-4, 5, (500, 64)), rng.integers(-4, 5, (15, 64))
    c[9] = c[4]
    near, upper, lower, shifts = np.zeros(500, np.int32), np.zeros(500), np.zeros(500), None
    saved = 0
    for _ in range(8):
        near, dist, upper, lower, worked = clustering.assign(x, near, upper, lower, clustering.Centroids(c, shifts))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (near == full.argmin(1)).all() and (dist == full.min(1)).all()
        saved += 15 * len(x) - worked
        moved = np.array([x[near == j].sum(0) // max((near == j).sum(), 1) if (near == j).any() else c[j] for j in range(15)])
        shifts = np.sqrt(((moved - c) ** 2).sum(1))
        c = moved
    assert saved > 0


def test_clusters_equal_their_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
        wanted = con.execute(clustering.ORACLE_SQL).df().sort_values("vec_id")
    got = clustering.cluster_vectors(spark.read.parquet(path)).toPandas().sort_values("vec_id")
    assert (got[wanted.columns].to_numpy() == wanted.to_numpy()).all()
