"""Repair of conversation structure: the cheapest edits that make roles follow ``(s?(ua)+)?``.

Rows get a kind each: the initial of their role, whether the last sign of the text ends a sentence,
or that they must go (blank, or role and text seen earlier). The cheapest edits are a Viterbi search
over four states (nothing yet, after s, after u, after a). It runs from the end: the cost vector
before a row says, per state, what the rest costs. Rows are numbered in the order of conversations
and turns and cut into chunks of ``CHUNK`` rows, so a conversation of any size is dealt over tasks.

Chunks are searched in parallel by rank convergence. The part of a conversation in a chunk starts
from a speculative vector, that of the conversation's end. Then fix-up passes: a part whose right
neighbour now says another vector runs again, until its vectors differ from the earlier ones only
by a constant; what lies before is right but for that constant, which no decision depends on.
Passes end when no neighbour says anything new. Parts that never converge (a long row of roles
that all need the same edit can carry a parity on for ever) are settled after ``PASSES`` passes by
their 4 x 4 min-plus matrices, which double their reach each round.

With the vector at each part's end known, edits are traced forward from the start: of the
cheapest ones the smallest initial (D < I < K < R) is taken at each step, which gives the least
audit, as each initial leads to one next state. Parts are traced from all four states; mostly all
end in one, otherwise these maps are composed in rounds of doubled reach as well.

Cases: null texts and roles are one space, which is blank and no role; roles are judged by their
first letter (an empty role has none and is never kept); rows of the same turn are taken by role,
text and then copy; null turns come first and do not count for gaps; a null conv_id is a
conversation; rows alike are duplicates; a conversation without rows after damage gives zeros and
empty texts; an empty table gives an empty result; further columns are ignored. An audit and the
repaired rows of one conversation are one value by contract, so the rows of a conversation over
several chunks are hashed by one task, as a stream: bounded memory, no row held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hexlytics.llm.order import partitions, row_numbers
from hexlytics.session import checkpointed

CHUNK = 512
PASSES = 4
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
_NONE, _S, _U, _A = range(4)
_STATES = range(4)
_NEVER = 1 << 40
# What the state becomes after an initial, and the initial an edit may add in a state.
_STEP = {(_NONE, "s"): _S, (_NONE, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_NEXT = {_NONE: "u", _S: "u", _U: "a", _A: "u"}
LEGAL = ("su", "ua", "au")
END = (0, 4, 2, 0)  # cost of what is missing at the end, per state

# Kinds, one letter per row: the two that must go; role s, u, a or another, in capitals if cut off.
BLANK, REPEATED, OTHER = "b", "d", "o"


def _plain(vector: tuple[int, ...]) -> tuple[int, ...]:
    """The vector less its least cost: equal for vectors that differ by a constant."""
    least = min(vector)
    return tuple(v - least for v in vector)


def _edits(kind: str, state: int) -> Iterator[tuple[str, int, int, str]]:
    """(initial, cost, next state, role given) of the edits that take a row, least initial first."""
    yield "D", DELETE, state, ""
    if kind in (BLANK, REPEATED):
        return
    cut = CUT_OFF if kind.isupper() else 0
    kept = _STEP.get((state, kind.lower()))
    if kept is not None:
        yield "K", KEEP + cut, kept, ""
    role = _NEXT[state]
    yield "R", REROLE + cut, _STEP[state, role], role


@lru_cache(maxsize=1 << 16)
def before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector before a row, given the one after it; inserts may come first."""
    cost = [min(c + after[to] for _, c, to, _ in _edits(kind, s)) for s in _STATES]
    # An insert leads on to u or a; two of them reach every state that inserts can.
    for _ in range(2):
        cost = [min(cost[s], INSERT + cost[_STEP[s, _NEXT[s]]]) for s in _STATES]
    return tuple(cost)


@lru_cache(maxsize=1 << 16)
def _plain_before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return _plain(before(kind, after))


@lru_cache(maxsize=1 << 16)
def _choice(kind: str, after: tuple[int, ...], state: int) -> tuple[str, str, int]:
    """(audit, roles inserted or given, state after) of the least cheapest edits up to this row's."""
    audit, given = "", ""
    while True:
        best = before(kind, after)[state]
        takes = {e[0]: e for e in _edits(kind, state)}
        for initial in "DIKR":
            role = _NEXT[state]
            if initial == "I" and INSERT + before(kind, after)[_STEP[state, role]] == best:
                audit, given, state = audit + "I", given + role, _STEP[state, role]
                break
            if initial in takes and takes[initial][1] + after[takes[initial][2]] == best:
                return audit + initial, given + takes[initial][3], takes[initial][2]


def vectors(kinds: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vector after each row of a part, less constants."""
    out = []
    for kind in reversed(kinds):
        out.append(after)
        after = _plain_before(kind, after)
    return out[::-1]


def first_vector(kinds: str, after: tuple[int, ...], used: tuple[int, ...] | None = None,
                 said: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The vector before a part. With what an earlier pass ``used`` and ``said``, it stops where
    both vectors differ by a constant only."""
    after = _plain(after)
    for kind in reversed(kinds):
        if used is not None and after == used:
            return said
        after = _plain_before(kind, after)
        if used is not None:
            used = _plain_before(kind, used)
    return said if used is not None and after == used else after


def matrix(kinds: str) -> list[int]:
    """Row s, column e: cost of the part from state s to state e, without constants taken off."""
    columns = []
    for end in _STATES:
        at = tuple(0 if s == end else _NEVER for s in _STATES)
        for kind in reversed(kinds):
            at = before(kind, at)
        columns.append([min(v, _NEVER) for v in at])
    return [columns[e][s] for s in _STATES for e in _STATES]


def trace(kinds: str, after: tuple[int, ...], state: int, last: bool
          ) -> tuple[list[tuple[str, str]], str, int]:
    """((audit, roles) per row, roles inserted at the conversation's end, state after)."""
    edits = []
    for kind, vector in zip(kinds, vectors(kinds, _plain(after))):
        audit, given, state = _choice(kind, vector, state)
        edits.append((audit, given))
    tail = ""
    while last and END[state]:
        tail += _NEXT[state]
        state = _STEP[state, _NEXT[state]]
    return edits, tail, state


# The rows


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage that crc32 of ``conv_id:turn`` deals."""
    rows = df.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    hit = rows.select("*", (F.crc32(F.encode(F.concat(
        _text("conv_id"), F.lit(":"), _text("turn")), "UTF-8")) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(
        F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                      F.explode(copies).alias("copy"))


def ordered(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(the rows with ``n``, their number in the order of conversations and turns, and ``chunk``;
    conv_id, n, chunk and ``kind`` of each). Runs jobs when called."""
    sign = r"[^\x20\x09-\x0D]"
    numbered = row_numbers(
        rows, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"),
               F.col("copy")], "n").withColumn("chunk", F.expr(f"n div {chunk}"))
    first = F.substring("role", 1, 1)
    shape = F.when(~F.col("text").rlike(sign), BLANK).otherwise(F.concat(
        F.when(first.isin("s", "u", "a"), first).otherwise(OTHER),
        F.when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "").otherwise("t")))
    keyed = checkpointed(numbered.select(
        "conv_id", "n", "chunk", shape.alias("shape"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        .alias("digest")))
    # A row seen earlier: all but the first of its digest. Equal rows meet as one row per task.
    firsts = keyed.where(F.col("shape") != BLANK).groupBy("conv_id", "digest").agg(
        F.min("n").alias("n")).select("n", F.lit(True).alias("fresh"))
    kind = F.when(F.col("shape") == BLANK, BLANK).when(F.col("fresh").isNull(), REPEATED).when(
        F.length("shape") == 2, F.upper(F.substring("shape", 1, 1))).otherwise(F.col("shape"))
    return numbered, keyed.join(firsts, "n", "left").select("conv_id", "n", "chunk", kind.alias("kind"))


def _parts(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, of rows that come sorted."""
    held, at = [], object()
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if held and now != at:
                yield held
                held = []
            held.append(row)
            at = now
    if held:
        yield held


def _composed(parts: DataFrame, value: str, shift: int, compose, done: Column | None) -> DataFrame:
    """Each part's ``value`` put together with that of the part ``shift`` chunks on, and of parts
    ever further away, until every chain ends. Rounds double the reach; none is collected."""
    now = checkpointed(parts.select("conv_id", "chunk", F.col(value).alias("v"), done.alias("done")))
    while now.where("not done").limit(1).count():
        other = now.select(*[F.col(c).alias(f"o_{c}") for c in now.columns])
        joined = now.join(other, F.expr(
            f"conv_id <=> o_conv_id and o_chunk = chunk + {shift} and not done"), "left")
        met = F.col("o_chunk").isNotNull()
        now = checkpointed(joined.select(
            "conv_id", "chunk", F.when(met, compose(F.col("v"), F.col("o_v"))).otherwise(
                F.col("v")).alias("v"),
            (F.col("done") | ~met | F.col("o_done")).alias("done")))
        shift *= 2
    return now.select("conv_id", "chunk", F.col("v").alias(value))


def _product(left: Column, right: Column) -> Column:
    """Min-plus product of two 4 x 4 matrices."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.array_min(F.array(*[
        F.get(left, k - k % 4 + j) + F.get(right, k % 4 + 4 * j) for j in _STATES])))


def _fix_up(parts: DataFrame, passes: int) -> DataFrame:
    """(conv_id, chunk, kinds, last, after): ``after`` is the vector at each part's end."""
    kind = "kinds string, last boolean, used array<int>, said array<int>"
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema
                      if f.name in ("conv_id", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                told = tuple(row.pop("told") or END)
                used, said = row["used"], row["said"]
                row["moved"] = used is None or tuple(used) != told
                if row["moved"]:
                    now = first_vector(row["kinds"], told, tuple(used) if used else None,
                                       tuple(said) if said else None)
                    row["used"], row["said"] = list(told), list(now)
                    row["moved"] = said is None or tuple(said) != now
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    def told(now: DataFrame) -> DataFrame:
        right = now.select(F.col("conv_id").alias("_c"), (F.col("chunk") - 1).alias("_k"),
                           F.col("said").alias("told"))
        return now.join(right, F.expr("conv_id <=> _c and chunk = _k"), "left").drop("_c", "_k")

    full = StructType.fromDDL(f"{types}, {kind}, moved boolean")
    shape = to_arrow_schema(full)
    none = F.lit(None).cast("array<int>")
    now = checkpointed(parts.withColumns({"used": none, "said": none, "told": none}).mapInArrow(run, full))
    for _ in range(passes):
        now = checkpointed(told(now.drop("moved")).mapInArrow(run, full))
        if not now.where("moved").limit(1).count():
            break
    else:
        return _settled(told(now.drop("moved")))
    return told(now).select("conv_id", "chunk", "kinds", "last", F.coalesce(
        "told", F.array(*map(F.lit, END))).alias("after"))


def _settled(parts: DataFrame) -> DataFrame:
    """As ``_fix_up``, by matrices of all that follows a part."""
    squares = parts.withColumn("m", F.udf(matrix, "array<long>")("kinds"))
    whole = _composed(squares, "m", 1, _product, F.col("last"))
    end = F.array(*[F.lit(c).cast("long") for c in END])
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.array(*[
        F.get("m", s * 4 + j) + END[j] for j in _STATES])))
    raw = whole.select(F.col("conv_id").alias("_c"), (F.col("chunk") - 1).alias("_k"), vector.alias("v"))
    plain = F.transform("v", lambda x: x - F.array_min("v"))
    return parts.join(raw, F.expr("conv_id <=> _c and chunk = _k"), "left").select(
        "conv_id", "chunk", "kinds", "last", F.coalesce(plain, end).cast("array<int>").alias("after"))


def _entered(parts: DataFrame) -> DataFrame:
    """``parts`` with ``state``, in which the trace enters each of them."""

    def ends(kinds: str, after: list[int], first: bool) -> list[int]:
        return [trace(kinds, tuple(after), _NONE if first else s, False)[2] for s in _STATES]

    held = checkpointed(parts.withColumn("m", F.udf(ends, "array<int>")("kinds", "after", "first")))
    settled = F.size(F.array_distinct("m")) == 1
    compose = lambda here, earlier: F.transform(earlier, lambda s: F.get(here, s))
    left = _composed(held, "m", -1, compose, settled).select(
        F.col("conv_id").alias("_c"), (F.col("chunk") + 1).alias("_k"), F.get("m", F.lit(0)).alias("state"))
    return held.drop("m").join(left, F.expr("conv_id <=> _c and chunk = _k"), "left").drop(
        "_c", "_k").withColumn("state", F.coalesce("state", F.lit(_NONE)))


def _stitched(kinds: DataFrame, passes: int) -> DataFrame:
    """(conv_id, chunk, first, last, after, state) of the parts of conversations over several chunks."""
    span = kinds.groupBy("conv_id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where(
        "lo < hi").withColumnRenamed("conv_id", "_c")
    letters = F.array_join(F.sort_array(F.collect_list(F.struct("n", "kind")))["kind"], "")
    # At most a chunk's rows each.
    parts = kinds.join(span, F.expr("conv_id <=> _c")).groupBy("conv_id", "chunk", "lo", "hi").agg(
        letters.alias("kinds"))
    wide = checkpointed(parts.select(
        "conv_id", "chunk", "kinds", F.expr("chunk = lo").alias("first"), F.expr("chunk = hi").alias("last")))
    firsts = wide.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "first")
    fixed = _fix_up(wide.drop("first"), passes)
    return _entered(fixed.join(firsts, F.expr("conv_id <=> _c and chunk = _k")).drop("_c", "_k")).select(
        "conv_id", "chunk", "first", "last", "after", "state")


def _in_parts(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mended(part: list[dict], at: dict | None) -> dict:
    """Counts, edits and repaired lines of a part; ``at`` is known of parts of wide conversations."""
    first, last = at is None or at["first"], at is None or at["last"]
    line = "".join(r["kind"] for r in part)
    edits, tail, _ = trace(line, tuple(at["after"]) if at else END, at["state"] if at else _NONE, last)
    kept, cut = [], 0
    for row, (done, given) in zip(part, edits):
        for initial in done:
            if initial in "IR":
                role, given = ROLE[given[0]], given[1:]
            if initial == "I":
                kept.append(f"{role}:")
            elif initial != "D":
                kept.append(f"{role if initial == 'R' else row['role']}:{row['text']}")
                cut += row["kind"].isupper()
    kept += [f"{ROLE[r]}:" for r in tail]
    audit = "".join(a for a, _ in edits) + "I" * len(tail)
    initials = [r["role"][:1] for r in part]
    return {
        "conv_id": part[0]["conv_id"], "chunk": part[0]["chunk"], "first": first, "last": last,
        "blank": line.count(BLANK), "duplicate": line.count(REPEATED),
        "truncated": sum(k.isupper() for k in line),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R")
        + CUT_OFF * cut,
        "audit": audit, "kept": kept, "initials": [initials[0], initials[-1]]}


def repaired(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """(conv_id, chunk, first, last, blank, duplicate, truncated, illegal, cost, audit, kept,
    initials): each conversation's edits, part by part; ``kept`` holds the repaired ``role:text``
    lines of the part. ``rows`` as of ``damaged``. Runs jobs when called."""
    numbered, kinds = ordered(rows, chunk)
    kinds = checkpointed(kinds)
    told = kinds.groupBy("chunk").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("n", "kind")))["kind"], "").alias("kinds"))
    # Only the first and the last conversation of a chunk can lie in others too.
    wide = _stitched(kinds, passes).groupBy("chunk").agg(F.collect_list(F.struct(
        "conv_id", "first", "last", "after", "state")).alias("wide"))
    none = F.lit(None)
    heads = told.join(wide, "chunk", "left").select(
        none.alias("conv_id"), "chunk", F.lit(-1).cast("long").alias("n"), none.alias("role"),
        none.alias("text"), "kinds", "wide")
    body = numbered.select("conv_id", "chunk", "n", "role", "text", none.alias("kinds"), none.alias("wide"))
    # What is known of a chunk comes before its rows.
    spread = heads.unionByName(body).repartition(partitions(rows), "chunk").sortWithinPartitions("chunk", "n")
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"conv_id {conv}, chunk long, first boolean, last boolean, blank long, duplicate long, "
        "truncated long, illegal long, cost long, audit string, kept array<string>, "
        "initials array<string>")
    out = to_arrow_schema(schema)

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _parts(batches, ("chunk", "conv_id", "kinds")):
            if part[0]["n"] < 0:
                at, kinds_here = part[0]["wide"] or [], part[0]["kinds"]
                continue
            for row in part:
                row["kind"] = kinds_here[row["n"] % chunk]
            yield _mended(part, next((w for w in at if w["conv_id"] == part[0]["conv_id"]), None))

    return spread.mapInArrow(lambda batches: _in_parts(mended(batches), out), schema)


def digested(parts: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per
    conversation. A conversation in one part is hashed as a column. The parts of a wider one come to
    one task in order, as its hash has to be made in order, and pass by one at a time."""
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    alone = F.expr("first and last")
    rows = parts.select(
        "conv_id", "chunk", "first", "last", *sums, "audit", "initials",
        F.when(alone, F.sha2(F.encode(F.array_join("kept", "\n"), "UTF-8"), 256)).alias("repaired_sha256"),
        F.when(~alone, F.col("kept")).alias("kept"))
    spread = rows.repartition(partitions(parts), "conv_id").sortWithinPartitions("conv_id", "chunk")
    schema = StructType([f for f in rows.schema if f.name in ("conv_id", *sums, "audit", "repaired_sha256")])
    out = to_arrow_schema(schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                (part,) = batch.slice(k, 1).to_pylist()
                if part["first"] and part["last"]:
                    yield part
                    continue
                if part["first"]:
                    whole, audit, digest, gap = part, [], hashlib.sha256(), ""
                else:
                    for name in sums:
                        whole[name] += part[name]
                    whole["illegal"] += end + part["initials"][0] not in LEGAL
                audit.append(part["audit"])
                end = part["initials"][1]
                for line in part["kept"]:
                    digest.update((gap + line).encode("utf-8", "replace"))
                    gap = "\n"
                if part["last"]:
                    yield whole | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return spread.mapInArrow(lambda batches: _in_parts(joined(batches), out), schema)


def repair(df: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation of ``df``, damaged first. Runs jobs when called."""
    rows = damaged(df)
    gaps = rows.groupBy("conv_id").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    found = digested(repaired(rows, chunk, passes))
    every = df.select("conv_id").distinct()
    both = every.join(gaps.withColumnRenamed("conv_id", "_g"), F.expr("conv_id <=> _g"), "left").join(
        found.withColumnRenamed("conv_id", "_f"), F.expr("conv_id <=> _f"), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
