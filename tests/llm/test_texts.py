"""Operators over texts on small tables: nulls, empty and long texts, repeated rows, empty tables, clashing columns; results against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, common, fingerprints, jaccard_join, licenses, mixing, sharding, shingles, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, copy int, rate double, n_units int, token_ids string, __n int"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 99, 99, 9.9, 9, "x", 1) for i, t, lang, src in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["tha", "re", "On", "ed", "é", "sh", "ti"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [(i, prose(i, 5 + 7 * i), "en" if i % 3 else "fr", f"src{i % 4}") for i in range(1, 25)]
    copies = [(100 + i, base[5][1], "en", "src0") for i in range(20)]
    words = base[20][1].split()
    near = [(200 + i, " ".join([*words[:i], "x", *words[i + 1 :]]), "en", "src1") for i in range(8)]
    odd = [(300, None, None, None), (301, "", "en", "src1"), (302, " \n\t ", "en", "src1"), (303, "one", "en", "src2"), (304, "ONE two", "de", "src2"), (305, "one  TWO", "de", "src2"), (306, "ж𝒳 " * 3000, "ru", "src3"), (307, prose(7, 20000), "en", "src3"), (None, prose(3, 9), "en", "src3"), (2, base[1][1], "en", "src2")]
    return base + copies + near + odd


# fingerprints


def test_prefix_hashes_tell_spans_and_extensions():
    a, b = "the cat sat on the mat", "a cat sat on the moon"
    x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
    for i, j, m in itertools.product(range(len(a)), range(len(b)), (0, 1, 4, 9)):
        inside = i + m <= len(a) and j + m <= len(b)
        assert fingerprints.spans_equal(x, i, y, j, m) == (inside and a[i : i + m] == b[j : j + m])
        assert fingerprints.longest_common_extension(x, i, y, j) == next((k for k in range(len(a)) if a[i : i + k + 1] != b[j : j + k + 1] or i + k >= len(a) or j + k >= len(b)), len(a))


def test_fingerprints_of_edited_texts(spark, rows):
    unique = [r for r in rows if r[0] is not None and r[0] != 2]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, unique), buckets=7).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in unique)
    assert len(got) == len(ordered)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        f = fingerprints.fingerprint(fingerprints.PrefixHash(t))
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == f and got[i]["edited_fingerprint"] == fingerprints.fingerprint(fingerprints.PrefixHash(edited))
        assert 0 <= got[i]["near_next"] <= 1 and (len(t) < 8 or got[i]["near_edited"] > 0.6)


def plain_likeness(a, b):
    """Dice coefficient of the distinct windows, or what the common beginning is of the longer text."""
    if a == b:
        return 1.0
    short = min(len(a), len(b)) < fingerprints.SHORT_CHARS and max(len(a), len(b)) < fingerprints.FINE_CHARS
    m = fingerprints.FINE_WINDOW if short else fingerprints.WINDOW
    x, y = ({t[i : i + m] for i in range(len(t) - m + 1)} for t in (a, b))
    begin = next((i for i, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))
    return max(2 * len(x & y) / max(len(x) + len(y), 1) if x and y else 0.0, begin / max(len(a), len(b), 1))


def test_likeness_is_that_of_plain_windows():
    """From fingerprints alone: near what all windows and the whole beginnings say, for edited, shuffled, unrelated and repetitive texts of any length."""
    rng, off = random.Random(12), []
    for n in (3, 9, 40, 200, 900, 3000):
        a, b = prose(n, n), prose(n + 1, n)
        words = a.split()
        kinds = [a[: len(a) - len(a) // 4] + b[: len(a) // 4], a[len(a) // 2 :], " ".join(rng.sample(words, len(words))), b, a + b, " ".join("x" if rng.random() < 0.05 else w for w in words), "ab " * n, a[:1]]
        for other in kinds:
            got = fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHash(t)) for t in (a, other)))
            assert 0 <= got <= 1
            off.append(abs(got - plain_likeness(a, other)))
    assert max(off) < 0.25 and sum(off) / len(off) < 0.05


def test_fingerprints_with_null_and_repeated_ids(spark, rows):
    assert fingerprints.fingerprint_documents(frame(spark, rows)).count() == len(rows)
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    (alone,) = fingerprints.fingerprint_documents(frame(spark, [(1, "abcdefgh", "en", "s")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1


# byte-level BPE


def test_tokens_are_those_of_the_tokenizer(spark, rows):
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = byte_bpe.decode_documents(byte_bpe.encode_documents(frame(spark, rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    for r in done.collect():
        assert r["token_ids"] == reference.encode_ordinary(r["text"] or "") and r["decoded_text"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"])
    for r in byte_bpe.digest_documents(frame(spark, rows[:9]), PATH, public_tokenizers.PATTERN).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(reference.encode_ordinary(text), "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    tripped = byte_bpe.round_trip_documents(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert len(tripped) == len(rows) and all(r["round_trip"] and r["token_ids"] == reference.encode_ordinary(r["text"] or "") for r in tripped)
    assert byte_bpe.digest_documents(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_the_transducer_emits_after_bounded_lookahead():
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    machine = byte_bpe.Transducer(ranks)
    longest = max(map(len, ranks))
    data = "unbelievable straightforwardness ".encode() * 20
    state, out = machine.start, []
    for n, byte in enumerate(data):
        state, tokens = machine.step(state, byte)
        out += tokens
        assert len(state.window) <= longest
        assert n + 1 == len(state.window) + sum(len(machine._bytes[t]) for t in out)
    parts, _ = byte_bpe.merge_all(ranks, data)
    assert out + machine.flush(state) == [ranks[p] for p in parts]


def test_a_full_transducer_still_encodes(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_STATES", 3)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 2)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 2)
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for seed in range(20):
        text = prose(seed, 50) + "x" * 200
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_a_very_long_piece_adds_no_states_beyond_the_cap(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_STATES", 200)
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(8)
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 100_000, "straightforward" * 5_000):
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert len(encoder.transducer.states) <= 200


def encoders():
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    return byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_new_pieces_are_read_by_transitions(spark):
    """Of the bytes of pieces that aren't remembered, and are no token, at least 95 in 100 go through the transducer's transitions, with the pattern of the query; the ids are the tokenizer's."""
    encoder, reference = encoders()
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = encoder.encode_all(texts)
    new = {p for t in texts for p in encoder.find(t)}
    size = sum(len(x) for x in (p.encode() for p in new) if x not in encoder.transducer.ranks)
    assert encoder.machine.read >= 0.95 * size and encoder.machine.simulated == 0
    assert len(encoder.machine.states) > 1_000
    assert all(np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t) for ids, t in zip(got[::7], texts[::7], strict=True))


@pytest.mark.parametrize("states, pieces", [(1 << 12, 64), (1 << 7, 8_192), (1 << 17, 8_192)])
def test_a_machine_that_is_emptied_or_full_still_encodes(monkeypatch, states, pieces):
    monkeypatch.setattr(byte_bpe, "MACHINE_STATES", states)
    monkeypatch.setattr(byte_bpe, "MACHINE_PIECES", pieces)
    encoder, _ = encoders()
    rng = random.Random(3)
    made = [bytes(rng.choice(b"abcdeinorst \xc3\xa9\xff") for _ in range(rng.randrange(1, 33))) for _ in range(3_000)] + [b"a" * n for n in range(1, 33)] + [b" straightforwardness"]
    got = byte_bpe.Machine(encoder.transducer).encode(made)
    for piece, ids in zip(made, got, strict=True):
        parts, _ = byte_bpe.merge_all(encoder.transducer.ranks, piece)
        assert np.frombuffer(ids, "<u4").tolist() == [encoder.transducer.ranks[p] for p in parts]
    assert byte_bpe.Machine(encoder.transducer).encode([]) == []
    # full within a batch after it was emptied
    machine = byte_bpe.Machine(encoder.transducer, 1 << 10)
    assert machine.encode(made) == got and machine.encode(made[::-1]) == got[::-1]


def test_white_space_and_signs_between_words():
    ranks = byte_bpe.read_ranks(open(PATH, "rb").read())
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert encoder.spaced
    rng = random.Random(9)
    parts = ["a", "the", "re", " ", " ", "  ", "\n", " \n", "\t", "'s", " '", "é", "1", "½", "Ⅷ", "!", "...", "\x1c", "\x85", "\xa0", "日本", "ж", "e\u0301", "\u200d", "😀", "ing", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_decoding_bytes_that_are_no_characters():
    tokens = {i: bytes((i,)) for i in range(256)}
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([0x61, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(12)]
        decoder = byte_bpe.StreamingDecoder(tokens)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == bytes(ids).decode(errors="replace")


# n-gram Jaccard join


def plain_sets(rows, n):
    low = {c: c + 32 for c in range(65, 91)}
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def plain_components(rows, n, percent):
    sets = plain_sets(rows, n)
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    links = collections.Counter()
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            links[i] += 1
            links[j] += 1
            group[find(i)] = find(j)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i, links[k]) for k, (i, s) in enumerate(sets)), key=str)


def test_joined_documents_with_string_ids(spark, rows):
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    plain = [(None if i is None else f"d{i}", *rest) for i, *rest in rows]
    assert triples(jaccard_join.jaccard_components(named, 4, 85)) == plain_components(plain, 4, 85)


def triples(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_joined_documents(spark, rows, n, percent):
    assert triples(jaccard_join.jaccard_components(frame(spark, rows), n, percent)) == plain_components(rows, n, percent)


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Every bucket is a large one, of several blocks; keys of many sets are dealt out by set."""
    monkeypatch.setattr(jaccard_join, "FEW_SETS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "HEAVY_ROWS", 6)
    words = prose(1, 60).split()
    rng = random.Random(2)
    near = [(i, " ".join("y%d" % rng.randrange(9) if rng.random() < 0.01 * (i % 4) else w for w in words), "en", "s") for i in range(50)]
    common = " ".join(words[:30])
    shared = [(100 + i, common + " " + prose(50 + i, 30), "en", "s") for i in range(30)]
    rows = near + shared
    assert triples(jaccard_join.jaccard_components(frame(spark, rows), 4, 85)) == plain_components(rows, 4, 85)


def test_a_chain_of_candidates_that_are_no_links(spark, monkeypatch):
    """Each text shares a rare beginning with the next one: candidates chain, links don't. Some neighbours do link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    parts = [prose(900 + i, 14) for i in range(120)]
    rows = [(i, parts[i] + " " + parts[i + 1], "en", "s") for i in range(119)]
    rows += [(500 + i, rows[i][1] + " end", "en", "s") for i in range(0, 119, 10)]
    monkeypatch.setattr(jaccard_join, "prefix_of", lambda n, percent: n - n)  # no pair is left out by its count of keys
    seen = []
    dealt = jaccard_join._dealt

    def spied(*args):
        out = dealt(*args)
        seen.append(out.groupBy("bucket", "cluster", "i", "j").count().toPandas())
        return out

    monkeypatch.setattr(jaccard_join, "_dealt", spied)
    assert triples(jaccard_join.jaccard_components(frame(spark, rows), 4, 85)) == plain_components(rows, 4, 85)
    sizes = seen[0]["count"]
    assert len(sizes) and sizes.sum() <= 12 * len(rows) and sizes.max() <= 40


def test_keys_of_many_sets_meet_by_classes_of_size(spark, monkeypatch):
    """A passage that many texts of many lengths share is a large key; all links are found between neighbouring classes."""
    monkeypatch.setattr(jaccard_join, "FEW_SETS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "HEAVY_ROWS", 4)
    words = prose(77, 150).split()
    rows = [(i, " ".join(words[: 12 + i]), "en", "s") for i in range(0, 130, 2)]
    for percent in (85, 100):
        assert triples(jaccard_join.jaccard_components(frame(spark, rows), 4, percent)) == plain_components(rows, 4, percent)


@pytest.mark.parametrize("few", [3, 20])
def test_keys_that_go_on_over_batches(spark, rows, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW_SETS", few)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    words = prose(11, 40).split()
    near = [(500 + i, " ".join([*words[: i % 12], f"z{i % 12}", *words[i % 12 + 1 :]]), "en", "s") for i in range(60)]
    try:
        got = triples(jaccard_join.jaccard_components(frame(spark, rows + near).repartition(9), 4, 85))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_components(rows + near, 4, 85)


def test_one_of_a_group_stays(spark, rows):
    kept = [r["doc_id"] for r in jaccard_join.keep_one(frame(spark, rows), 4, 85).collect()]
    wanted = [i for i, n, least, _ in plain_components(rows, 4, 85) if n == 0 or i is None or least == i]
    assert sorted(map(str, kept)) == sorted(map(str, wanted))
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0


def test_shingles_are_those_of_words():
    texts = ["A b\tc  d", "a B c d e", "", None, "x", " a b c d ", "ÀÉ b c d"]
    ours = [set(s.tolist()) for s in shingles.shingle_sets(texts, 4)]
    theirs = [s for _, s in plain_sets(list(enumerate(texts)), 4)]
    for (i, a), (j, b) in itertools.product(enumerate(ours), enumerate(ours)):
        assert len(a & b) == len(theirs[i] & theirs[j])


# substring dedup


def plain_lines(rows, min_words=5, min_sentence_words=8):
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")

    def units(text):
        for k, line in enumerate(text.split("\n")):
            yield k, 0, line
            pieces = re.split(r"(?<=[.!?]) ", line)
            if len(pieces) > 1:
                yield from ((k, 1 + n, p) for n, p in enumerate(pieces))

    seen, out = {}, []
    for i, k, n, unit in sorted((i, k, n, unit) for i, t, *_ in rows if t for k, n, unit in units(t)):
        if len(norm(unit).split()) >= (min_sentence_words if n else min_words):
            seen.setdefault(norm(unit), (i, k, n))
    for i, t, *_ in rows:
        kept, spans, at = [], [], 0
        gone = lambda k, n, unit, i=i: len(norm(unit).split()) >= (min_sentence_words if n else min_words) and seen[norm(unit)] != (i, k, n)
        for k, line in enumerate(t.split("\n") if t else []):
            pieces = re.split(r"(?<=[.!?]) ", line)
            if gone(k, 0, line):
                spans.append((at, at + len(line)))
            elif len(pieces) == 1:
                kept.append(line)
            else:
                stay, start = [], at
                for n, p in enumerate(pieces):
                    if gone(k, 1 + n, p):
                        spans.append((start, start + len(p)))
                    else:
                        stay.append(p)
                    start += len(p) + 1
                if stay:
                    kept.append(" ".join(stay))
            at += len(line) + 1
        out.append((i, "\n".join(kept) if t is not None else None, spans))
    return sorted(out, key=str)


def test_passages_inside_lines(spark):
    passage = [f"{prose(s, 12)}." for s in range(60, 66)]
    rows = [(1, f"{prose(1, 20)} {' '.join(passage)} {prose(2, 20)}", "en", "s"), (2, f"{prose(3, 20)}. {' '.join(passage)} {prose(4, 20)}\nlast", "en", "s"), (3, " ".join(passage), "en", "s"), (4, f"{passage[0]}  {passage[1]}", "en", "s"), (5, f"{prose(5, 40)}. {prose(6, 9)}! Ok.", "en", "s")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_units(frame(spark, rows)).collect()}
    assert sorted(((i, r["text"], [(s["start"], s["end"]) for s in r["removed_spans"]]) for i, r in got.items()), key=str) == plain_lines(rows)
    assert got[1]["text"] == rows[0][1] and got[5]["text"] == rows[4][1] and got[3]["n_removed"] == 6
    for i, t, *_ in rows:
        assert all(t[s["start"] : s["end"]].strip() in passage for s in got[i]["removed_spans"])


def test_repeated_lines(spark):
    a, b, c = "A first line of words here", "another LINE of some words", "short line"
    rows = [(1, f"{a}\n{b}\n{c}", "en", "s"), (2, f"{c}\n  another line  of some words\nnew words that nobody has said", "en", "s"), (3, f"{a}\n{a}", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, f"é {a}\n\n{b}\n", "en", "s"), (7, "\n".join([a] * 3000), "en", "s")]
    got = substring_dedup.dedup_units(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"], [(s["start"], s["end"]) for s in r["removed_spans"]]) for r in got), key=str) == plain_lines(rows)
    assert all(r["n_removed"] == len(r["removed_spans"]) for r in got)
    twice = substring_dedup.dedup_units(frame(spark, rows[:2] * 2)).collect()
    assert len(twice) == 4 and {r["text"] for r in twice if r["doc_id"] == 1} == {rows[0][1]}
    assert substring_dedup.dedup_units(frame(spark, [])).count() == 0


# mixing


def test_mix_follows_targets_and_ids(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, None, None, None)]
    targets = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), (None, 0.001)], "source string, weight double")
    mixed = mixing.mix_sources(frame(spark, rows), targets)
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(counts["hot"] - 1500) < 150 and abs(counts["s0"] - 1500) < 150 and set(counts) <= {"hot", "s0", None}
    again = mixing.mix_sources(frame(spark, rows).repartition(5), targets)
    key = lambda df: sorted((r["mix_key"], r["copy"]) for r in df.collect())
    assert key(mixed) == key(again) and len(set(key(mixed))) == mixed.count()
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert key(mixing.mix_sources(frame(spark, rows), targets, most_broadcast=0)) == key(mixed)


def plain_times(rate, ident):
    u = int(hashlib.md5(f"{mixing.SEED}:{ident}".encode()).hexdigest()[:13], 16) / 2**52
    times, upto = 0, math.exp(-rate)
    while upto <= u:
        times += 1
        upto += math.exp(times * math.log(rate) - rate - math.lgamma(times + 1))
    return times


@pytest.mark.parametrize("few", [50_000, 0])
def test_rates_have_no_bound(spark, few):
    rows = [(i, "t", "en", "rare" if i < 3 else "one" if i == 3 else "rest") for i in range(3000)]
    targets = spark.createDataFrame([("rare", 0.3), ("one", 0.5), ("rest", 0.2)], "source string, weight double")
    got = mixing.mix_sources(frame(spark, rows), targets, most_broadcast=few).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("copies"), F.min("copy").alias("least"), F.max("copy").alias("most"), F.max("rate").alias("rate")).collect()
    wanted = {i: plain_times({"rare": 300.0, "one": 1500.0, "rest": 600 / 2996}[s], i) for i, _, _, s in rows}
    assert {r["doc_id"]: r["n"] for r in got} == {i: n for i, n in wanted.items() if n}
    assert all(r["least"] == 1 and r["n"] == r["copies"] == r["most"] for r in got)
    assert {round(r["rate"], 6) for r in got if r["doc_id"] < 4} == {300.0, 1500.0}


@pytest.mark.parametrize("rate", [200.5, 745.0, 31_000.0])
def test_counts_at_large_rates(spark, rate):
    rows = spark.range(300).select("id", F.md5(F.concat(F.lit(f"{mixing.SEED}:"), F.col("id").cast("string"))).alias("h"), F.lit(rate).alias("rate"))
    unit = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    assert all(r["n"] == plain_times(rate, r["id"]) for r in rows.select("id", mixing._times_at(F.col("rate"), unit).alias("n")).collect())


# sharding


def test_shards_are_even_and_slots_without_gaps(spark, rows):
    many = rows + [(1000 + i, prose(i % 40, 30), "en", "s") for i in range(4000)]
    got = sharding.shard_documents(frame(spark, many)).collect()
    texts = {i: t for i, t, *_ in many}
    assert len(got) == len(many)
    sizes, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[data].add(r["shard"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) + 2 * max(len((t or "").encode()) for t in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_of_copies_that_fills_shards_is_split(spark):
    got = sharding.shard_documents(frame(spark, [(i, "the same text", "en", "s") for i in range(800)])).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 2
    assert sharding.shard_documents(frame(spark, [])).count() == 0


# licenses


def plain_shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D\xA0]+", (text or "").lower().translate({ord(c): None for c in ".,;:!?\"'()[]{}<>`*_"})) if x]
    k = min(k, len(w)) or 1
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)], k


def plain_matches(text, template):
    """The largest share of a template's shingles in any window of as many shingles, rounded up to a power of two and doubled."""
    wanted, k = plain_shingles(template, licenses.SHINGLE)
    w = 1 << (len(wanted) - 1).bit_length()
    own, _ = plain_shingles(text, k)
    if len(own) and len(own[0]) != k:
        return 0.0
    return max((len(set(own[i : i + 2 * w]) & set(wanted)) / len(set(wanted)) for i in range(0, max(len(own), 1), w)), default=0.0)


def test_hundreds_of_long_templates_against_all_windows(spark):
    rng = random.Random(12)
    templates = [(f"t{i}", f"family {i % 50}", prose(3000 + i, rng.choice([1, 2, 4, 6, 30, 90, 200, 333]))) for i in range(300)]
    rows = []
    for i in range(70):
        t = templates[i * 7 % 300][2].split()
        part = list(t)
        for _ in range(len(t) // 60 * (i % 4)):  # some words differ
            part[rng.randrange(len(part))] = "changed"
        if i % 5 == 4:
            part = part[: len(part) // 2]
        rows.append((i, " ".join([prose(i, 5 * i), *part, prose(i + 1, 40)]), "en", "s"))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, rows[3][1], "en", "s"), (3, rows[3][1], "en", "s"), (None, rows[2][1], "en", "s"), (503, " ".join(t for _, _, t in templates[:40]), "en", "s")]
    got = {}
    for r in licenses.scan_licenses(frame(spark, rows), licenses.template_frame(spark, templates)).collect():
        got.setdefault(r["doc_id"], []).append({m["template_id"]: m["containment"] for m in r["matches"] or []})
    assert sum(map(len, got.values())) == len(rows)
    found = missed = 0
    for i, text, *_ in rows:
        wanted = {name: x for name, _, t in templates if (x := plain_matches(text, t)) >= licenses.CONTAINMENT}
        for own in got[i]:
            assert set(own) <= set(wanted) and all(own[x] == pytest.approx(wanted[x]) for x in own)
            found, missed = found + len(own), missed + len(wanted) - len(own)
    assert found > 40 and missed <= 0.02 * (found + missed)


def test_whole_licenses_are_found_and_no_templates_find_nothing(spark):
    made = [(i, f"{prose(i, 300)} Copyright 2020 somebody {t} {prose(i + 50, 200)}", "en", "s") for i, (_, _, t) in enumerate(licenses.TEXTS)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, made)).collect()}
    for i, (name, family, _) in enumerate(licenses.TEXTS):
        assert family in got[i]["licenses"] and name in {m["template_id"] for m in got[i]["matches"]}
    none = licenses.template_frame(spark).limit(0)
    assert all(r["licenses"] == [] and r["n_matches"] == 0 for r in licenses.scan_licenses(frame(spark, made), none).collect())


def test_license_statements_are_found(spark, rows):
    short = [s for _, _, s in licenses.TEMPLATES]
    made = [(2000 + k, f"{prose(k, 30 * (k % 3))}\n{s.upper() if k % 2 else s} {prose(k + 1, 40)}", "en", "s") for k, s in enumerate(short * 3)]
    partial = [(3000, "Permission is hereby granted free of charge to any human obtaining a copy of this software and associated documentation files", "en", "s"), (3001, "Permission is hereby granted", "en", "s"), (3002, "released under the license of MIT", "en", "s")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows[:-1] + made + partial)).collect()}
    assert len(got) == len(rows[:-1]) + len(made) + len(partial)
    for (k, (_, family, _)) in enumerate(licenses.TEMPLATES * 3):
        assert got[2000 + k]["licenses"] == [family]
    # four of sixteen shingles differ by one word: 11 of 16 are left
    assert got[3000]["n_matches"] == 0 and got[3001]["n_matches"] == 0 and got[3002]["n_matches"] == 0
    assert got[300]["licenses"] == [] and got[301]["licenses"] == []
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_what_a_worker_keeps_goes_when_it_is_idle():
    kept, made = common.Kept(seconds=0.3), []
    make = lambda: made.append(1) or object()
    first = kept.get("a", make)
    kept.done()
    assert kept.get("a", make) is first  # asked for in time
    time.sleep(0.6)
    assert kept.get("a", make) is first  # a task is at work
    kept.done()
    time.sleep(0.9)
    assert not kept.held and kept.get("a", make) is not first and len(made) == 2
