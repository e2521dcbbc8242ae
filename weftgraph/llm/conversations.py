"""Conversation repair by signature deduplication.

The rows of a conversation, in order, become a string of one letter each: role and fault. Equal strings have equal cheapest repairs, so each distinct one is solved once, by recursion over its ends that remembers what it
has solved; the audits are joined back and replayed on the rows. Rows that must go (blank, duplicate) leave no letter, as they are deleted whatever stands around them.

A conversation of any length is cut into pieces of at most PIECE_ROWS letters. What a piece can do is, for each state before it and after it, the least cost; costs of what follows are handed back from the last piece to the
first, then states from the first to the last, so that the cheapest and, of equal ones, first audit is that of the whole conversation. Rows stream through a task, sorted; no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.llm.common import materialize, scratch, small_batches
from weftgraph.operators.numbering import ranged_rows

PIECE_ROWS = 256
#: What edits cost, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Roles so far: none, only system, ends with user, ends with assistant. The last row's end costs what must be inserted there.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_WANTED = ("u", "u", "a", "u")
_AT_END = ("", "IuIa", "Ia", "")
END = tuple(INSERT * x.count("I") for x in _AT_END)
_NEVER = 1 << 40
WORD = r"[^\x20\x09-\x0D]"


def options(letter: str, state: int) -> list[tuple[str, int, int]]:
    """What can become of a row, in the order of the edits' initials, none of which begins another: edits (of I and R with the role that they make, as u or a), their cost and the state after. One insertion before a row at most, as two cost 6 and
    lead nowhere new; an insertion before a deletion comes later in order than after it."""
    stays, out = TRUNCATED * letter.isupper(), [("D", DELETE, state)]
    wanted = _WANTED[state]
    for before, now, cost in (("I" + wanted, _AFTER[state, wanted], INSERT + stays), ("", state, stays)):
        kept = _AFTER.get((now, letter.lower()))
        if kept is not None:
            out.append((before + "K", cost, kept))
        out.append((before + "R" + _WANTED[now], cost + REROLE, _AFTER[now, _WANTED[now]]))
    return out


@lru_cache(maxsize=1 << 16)
def costs(signature: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """For each state the least cost of a signature and of what follows, which costs `after` by state."""
    if not signature:
        return after
    rest = costs(signature[1:], after)
    return tuple(min(c + rest[then] for _, c, then in options(signature[0], state)) for state in range(4))


def spans(signature: str) -> list[tuple[int, ...]]:
    """For each state before a signature the least costs by state after it."""
    ends = [costs(signature, tuple(0 if s == t else _NEVER for s in range(4))) for t in range(4)]
    return [tuple(min(e[s], _NEVER) for e in ends) for s in range(4)]


def audit(signature: str, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The edits of each row, and the state they end in: of the cheapest ways the first in order of letters."""
    out = []
    for at in range(len(signature)):
        least, rest = costs(signature[at:], after)[state], costs(signature[at + 1 :], after)
        edit, _, state = next(o for o in options(signature[at], state) if o[1] + rest[o[2]] == least)
        out.append(edit)
    return out, state


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text as the contract of the query damages them, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes [.!?] from it, 3 repeats it, 4 makes its role user. Null roles, texts and parts of the key count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    told = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), key.alias("k")).filter("k <> 0")
    told = told.withColumns({"role": F.when(F.col("k") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return told.withColumn("k", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k")


def _letter(role: Column, truncated: Column) -> Column:
    first = F.substring(role, 1, 1)
    low = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(truncated, F.upper(low)).otherwise(low)


def ordered_rows(rows: DataFrame) -> DataFrame:
    """conv (the id as a string after "=", empty for null), turn, role, text in the order conv, turn (nulls first), role, text, stored: part and at say where a row stands. Equal rows may be dealt to neighbouring parts, so no number of them is too large for a task."""
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    placed = ranged_rows(named.withColumn("__tie", F.monotonically_increasing_id()), [F.col("conv"), F.asc_nulls_first("turn"), "role", "text", "__tie"])
    return placed.select("conv", "turn", "role", "text", F.col("__part").alias("part"), F.col("__at").alias("at"))


def faults(placed: DataFrame) -> DataFrame:
    """conv, part, at, turn, role, fault (blank, duplicate, truncated or null) and letter (empty for rows that must go). A text is first where its place is the least of its conversation's: found by places, so that a text of very many rows needs no task of its own."""
    digest = F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256)
    firsts = placed.groupBy("conv", digest.alias("digest")).agg(F.min(F.struct("part", "at")).alias("p")).select(F.col("p.part").alias("part"), F.col("p.at").alias("at"), F.lit(True).alias("first"))
    blank, cut = ~F.col("text").rlike(WORD), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    told = placed.select("conv", "part", "at", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), _letter(F.col("role"), cut).alias("letter"))
    told = told.join(firsts, ["part", "at"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return told.withColumn("fault", fault).select("conv", "part", "at", "turn", "initial", "fault", F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), "").otherwise(F.col("letter")).alias("letter"))


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def pieces(found: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Neighbouring rows of a conversation, at most piece_rows of them: conv, part, piece, signature, places (of rows with a letter), counts of faults, first and last initials, illegal neighbours inside."""
    one = F.struct("at", "initial", "letter")
    rows = found.groupBy("conv", "part", F.floor(F.col("at") / piece_rows).alias("piece")).agg(
        F.array_sort(F.collect_list(one)).alias("rows"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    lettered = F.filter("rows", lambda r: r["letter"] != "")
    beside = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), lambda a, b: _legal(a["initial"], b["initial"]))
    return rows.select(
        "conv", "part", "piece", "blank", "duplicate", "truncated",
        F.array_join(F.transform(lettered, lambda r: r["letter"]), "").alias("signature"), F.transform(lettered, lambda r: r["at"]).alias("places"),
        F.element_at("rows", 1)["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"), F.size(F.filter(beside, lambda x: ~x)).cast("long").alias("illegal"),
    )


def _solved(keys: DataFrame, solve, schema: str) -> DataFrame:
    """keys (each once) with what solve() makes of their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield solve(df)

    return keys.mapInPandas(run, schema)


def _joined_back(rows: DataFrame, solved: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """rows with the columns of solved (one row for each value of keys). Values that hold over one in `most` of the rows, fewer than `most`, are met by a broadcast, the others by a join."""
    limit = rows.count() / most
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys, F.lit(True).alias("__hot"))
    flagged = materialize(rows.join(F.broadcast(often), keys, "left"), "flagged")
    hot = flagged.filter("__hot").drop("__hot").join(F.broadcast(solved.join(often.drop("__hot"), keys, "left_semi")), keys)
    return hot.unionByName(flagged.filter("__hot is null").drop("__hot").join(solved, keys))


def _streamed(rows: DataFrame, order: list, schema: str, step) -> DataFrame:
    """Runs step(state, row) over each conversation's rows in an order; it returns the new state and what is added to the row. Only the state is held, over batches too."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                if row["conv"] != conv:
                    conv, state = row["conv"], None
                state, added = step(state, row)
                out.append(added)
            if out:
                yield pd.concat([df[names].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    kinds = StructType([*rows.schema.fields, *StructType.fromDDL(schema).fields])
    return rows.repartition("conv").sortWithinPartitions("conv", *order).mapInPandas(run, kinds)


def _back(state: list[int] | None, row: dict) -> tuple[list[int], dict]:
    """From the last piece to the first: what follows a piece costs, by state; the least made 0, as only differences matter."""
    after = list(END) if state is None else state
    low = min(after)
    span = np.array(row["span"], np.int64).reshape(4, 4)
    before = (span + np.array(after, np.int64)[None, :]).min(1)
    return (before - before.min()).tolist(), {"after": [a - low for a in after]}


def solve_pieces(cut: DataFrame) -> DataFrame:
    """pieces() with `edits` (of each row with a letter), the state before the piece and, in `ends`, the state after it."""
    signatures = cut.select("signature").distinct()
    matrix = _solved(signatures, lambda df: pd.DataFrame({"signature": df["signature"], "span": [[c for row in spans(s) for c in row] for s in df["signature"]]}), "signature string, span array<long>")
    known = materialize(_joined_back(cut.select("conv", "part", "piece", "signature"), matrix, ["signature"]), "spans")
    backward = materialize(_streamed(known, [F.desc("part"), F.desc("piece")], "after array<long>", _back).drop("span"), "after")

    def audits(df: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, a, *zip(*[audit(s, tuple(int(x) for x in a), state) for state in range(4)], strict=True)) for s, a in zip(df["signature"], df["after"], strict=True)]
        return pd.DataFrame([(s, a, list(e), list(n)) for s, a, e, n in rows], columns=["signature", "after", "audits", "next"])

    solved = _solved(backward.select("signature", "after").distinct(), audits, "signature string, after array<long>, audits array<array<string>>, next array<int>")
    both = materialize(_joined_back(backward, solved, ["signature", "after"]), "audits")
    forward = _streamed(both.select("conv", "part", "piece", "next"), ["part", "piece"], "before int, ends int", lambda state, row: (int(row["next"][state or 0]), {"before": state or 0, "ends": int(row["next"][state or 0])}))
    place = ["conv", "part", "piece"]
    return cut.join(both.drop("signature", "after", "next"), place).join(forward.drop("next"), place).withColumn("edits", F.element_at("audits", F.col("before") + 1)).drop("audits")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and the account of each conversation, both stored.

    Rows: conv_id and conv (a string of it), part, at, no (rows are in the order of these), turn, edit (D, K, R or I; deleted rows are there too), role and text as repaired. Account: conv_id, conv, gaps, blank, duplicate, truncated, illegal, cost.

    Conversations are taken by turn (nulls first), equal turns by role and text. Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last character that isn't white is none of [.!?]). Roles
    must come to `(s?(ua)+)?` by their initials: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert (user or assistant, empty) 3; a truncated row that stays adds 3. Of the
    cheapest audits the first in ASCII is taken. Null roles and texts count as one space; a null conversation id is a conversation. Other columns are not returned; an empty table gives no rows.
    """
    spark = rows.sparkSession
    renamed = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    with scratch(spark), small_batches(spark, 10_000):
        placed = ordered_rows(renamed)
        found = materialize(faults(placed), "faults")
        cut = materialize(pieces(found, piece_rows), "pieces")
        done = materialize(solve_pieces(cut), "repairs")
        account = materialize(_account(found, done), "account", keep=True)
        # the last piece of each conversation has what is inserted at the end
        lasts = done.groupBy("conv").agg(F.max(F.struct("part", "piece", "ends")).alias("l"))
        tail = lasts.select("conv", F.col("l.part").alias("part"), ((F.col("l.piece") + 1) * piece_rows).alias("at"), F.col("l.ends").alias("ends"))
        edits = done.select("part", F.explode(F.arrays_zip("places", "edits")).alias("e"), "before").select("part", F.col("e.places").alias("at"), F.col("e.edits").alias("edits"))
        told = placed.join(edits, ["part", "at"], "left").select("conv", "part", "at", "turn", "role", "text", F.coalesce("edits", F.lit("D")).alias("edits"))
        ends = tail.select("conv", "part", "at", F.lit(None).cast(placed.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.element_at(F.array(*map(F.lit, _AT_END)), F.col("ends") + 1).alias("edits")).filter("edits <> ''")
        kind = rows.schema[conv].dataType
        repaired = materialize(_replayed(told.unionByName(ends)).withColumn("conv_id", _id_of("conv", kind)), "repaired", keep=True)
        account = account.withColumn("conv_id", _id_of("conv", kind))
    return repaired, account


def _id_of(conv: str, kind) -> Column:
    return F.when(F.col(conv) != "", F.substring(conv, 2, 1 << 30).cast(kind))


def _replayed(told: DataFrame) -> DataFrame:
    """A row for each edit: inserted ones before the row that they were told with."""
    name = lambda letter: F.when(letter == "u", "user").otherwise("assistant")
    edits = F.regexp_extract_all("edits", F.lit("([DKRI][ua]?)"), F.lit(1))
    each = told.select("conv", "part", "at", "turn", "role", "text", F.posexplode(edits).alias("no", "e"))
    edit, to = F.substring("e", 1, 1), F.substring("e", 2, 1)
    added = edit == "I"
    return each.select("conv", "part", "at", "no", F.when(~added, F.col("turn")).alias("turn"), edit.alias("edit"), F.when(to != "", name(to)).otherwise(F.col("role")).alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256 (of `role:text` of the rows that stay, joined by newlines) of repair()'s rows. A hash over a conversation is made row by row: its rows go through one task in order, which holds the hash so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sha, audit, none = None, None, [], True
        for df in batches:
            out = []
            for c, edit, line in zip(df["conv"], df["edit"], df["line"], strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, sha, audit, none = c, hashlib.sha256(), [], True
                audit.append(edit)
                if edit != "D":
                    sha.update(line if none else b"\n" + line)
                    none = False
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, "".join(audit), sha.hexdigest())], columns=["conv", "audit", "repaired_sha256"])

    lines = repaired.select("conv", "part", "at", "no", "edit", F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).cast("binary").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "part", "at", "no").mapInPandas(run, "conv string, audit string, repaired_sha256 string")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """What the query returns: every conversation id of the rows given, with the account and digests of its rows as damage() leaves them."""
    spark = conversations.sparkSession
    with scratch(spark):
        repaired, account = repair(damage(conversations))
        with small_batches(spark):
            told = materialize(account.join(digests(repaired), "conv").drop("conv"), "digests", keep=True)
    ids = conversations.select(F.col("conv_id").alias("__conv")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(told, F.col("__conv").eqNullSafe(F.col("conv_id")), "left").select(F.col("__conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _account(found: DataFrame, done: DataFrame) -> DataFrame:
    """The numbers of each conversation: turns in partial counts of distinct ones, neighbours of pieces in order."""
    turns = found.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("x")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    seams = _streamed(done.select("conv", "part", "piece", "first", "last"), ["part", "piece"], "seam int", lambda state, row: (row["last"], {"seam": 0 if state is None or state + row["first"] in ("su", "ua", "au") else 1}))
    edited = F.aggregate("edits", F.lit(0).cast("long"), lambda s, e: s + INSERT * F.contains(e, F.lit("I")).cast("long") + DELETE * F.contains(e, F.lit("D")).cast("long") + REROLE * F.contains(e, F.lit("R")).cast("long"))
    stays = F.aggregate(F.zip_with("edits", F.split("signature", ""), lambda e, s: F.when((e != "D") & (s == F.upper(s)), TRUNCATED).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    last = F.max(F.struct("part", "piece", "ends"))["ends"]
    sums = done.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("inside"), (F.sum(edited + stays + DELETE * (F.col("blank") + F.col("duplicate"))) + F.element_at(F.array(*map(F.lit, END)), last + 1)).alias("cost"))
    beside = seams.groupBy("conv").agg(F.sum("seam").alias("seams"))
    return sums.join(beside, "conv").join(turns, "conv", "left").select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + F.col("seams")).cast("long").alias("illegal"), F.col("cost").cast("long").alias("cost"))
