"""Secret scans with an inverted index of trigrams.

Each rule is a regular expression. From its parse follows a Boolean query over trigrams: a list
of clauses that must all hold, each a choice of trigram sets. Postings (trigram, row) are built
for the trigrams the rules ask for, sets are intersected by counting, and only rows that satisfy
a rule's clauses are searched with its expression. A rule without mandatory trigrams (a run of
hexadecimal digits) is searched in every row. The index only rules out rows that cannot match,
so results are those of a full scan.

Only column operations run here. Cases: null text counts as empty and has no spans; a row key is
a hash of doc_id and text, so null ids and repeated rows get the spans of their text; matches of
one rule never overlap, spans of different rules may; an empty table gives an empty result;
further columns are kept by ``redact``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The standard library's own parse of a pattern: a list of (operation, argument).
_parse = re._parser.parse
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads the same in Python and Java; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The patterns of the contract, in its order of kinds.
BASE = (
    Rule("assign",
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
# Published token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _product(a: set[str], b: set[str] | None) -> set[str] | None:
    if b is None or len(a) * len(b) > _MOST_STRINGS:
        return None
    return {x + y for x, y in itertools.product(a, b)}


def _strings(op, arg) -> set[str] | None:
    """All strings the item can match, lower-cased, or None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c).lower() for _, c in arg}
        return None
    if name == "AT":
        return {""}
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])
        return inner if inner is None or arg[0] == 1 else inner | {""}
    return None


def _sequence(items) -> set[str] | None:
    out: set[str] | None = {""}
    for op, arg in items:
        out = _product(out, _strings(op, arg))
        if out is None:
            return None
    return out


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[k:k + 3] for k in range(len(text) - 2))


def _choice(sets) -> list[frozenset[str]]:
    """Without the sets that hold another one: those add nothing to an OR."""
    kept = set(sets)
    return sorted((s for s in kept if not any(t < s for t in kept)), key=sorted)


def _clauses(items) -> list[list[frozenset[str]]]:
    out, run = [], {""}

    def flush():
        if min(map(len, run)) >= 3:
            out.append(_choice(map(_grams, run)))

    for op, arg in items:
        longer = _product(run, _strings(op, arg))
        if longer is not None:
            run = longer
            continue
        flush()
        run = {""}
        name = str(op)
        if name == "SUBPATTERN":
            out += _clauses(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            out += _clauses(arg[2])
    flush()
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that any text with a match satisfies: AND of (OR of trigram sets).

    No clauses: the pattern has no mandatory trigram. Case is folded.
    """
    return _clauses(_parse(pattern))


def _row_key() -> Column:
    # Only ever adds candidates where two rows share a hash; the search itself is exact.
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(gram, _key): the rows whose text, case folded, has the trigram."""
    folded = F.lower(F.coalesce("text", F.lit("")))
    has = F.filter(F.array(*[F.lit(g) for g in vocabulary]), lambda g: F.contains("_folded", g))
    return docs.select(_row_key().alias("_key"), folded.alias("_folded")).select(
        "_key", F.explode(has).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(_key, _kinds): the rules whose trigram query the row satisfies."""
    options: list[tuple[int, frozenset[str]]] = []  # (clause, trigrams)
    clauses_of: dict[str, list[int]] = {}
    n = 0
    for rule in rules:
        for clause in trigram_query(rule.pattern):
            options += [(n, grams) for grams in clause]
            clauses_of.setdefault(rule.kind, []).append(n)
            n += 1
    vocabulary = sorted(set().union(*[g for _, g in options]))
    users = F.create_map(*itertools.chain.from_iterable(
        (F.lit(g), F.array(*[F.lit(k) for k, (_, s) in enumerate(options) if g in s]))
        for g in vocabulary))
    needed = F.array(*[F.lit(len(s)) for _, s in options])
    clause = F.array(*[F.lit(c) for c, _ in options])
    met = (
        postings(docs, vocabulary).distinct()
        .select("_key", F.explode(users[F.col("gram")]).alias("option"))
        .groupBy("_key", "option").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.get(needed, "option"))
        .groupBy("_key").agg(F.collect_set(F.get(clause, "option")).alias("_met"))
    )
    kinds = [
        F.when(F.size(F.array_intersect("_met", F.array(*[F.lit(c) for c in own]))) == len(own),
               F.lit(kind))
        for kind, own in clauses_of.items()
    ]
    return met.select("_key", F.array_compact(F.array(*kinds)).alias("_kinds")).where(
        F.size("_kinds") > 0)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: what lies between matches gives their places, in code points."""
    rx = F.lit(rule.java)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.java, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), F.length).alias("checked"),
    )
    kind = "array<struct<start:int,rank:int,kind:string,stop:int>>"
    empty = F.array().cast(kind)

    def step(acc, p):
        start = acc["at"] + p["gap"]
        stop = start + F.coalesce(p["size"], F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"),
                                 F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        kept = F.when(p["checked"] >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"])
        return F.struct(stop.alias("at"), kept.cast(kind).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    walked = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(_probe(rule))), walked).otherwise(empty)


def _probe(rule: Rule) -> str:
    """A pattern found whenever a kept match exists; run first, as matches are rare."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        fixed = len(re.split(r"\[", rule.pattern)[0])
        return f"{rule.java[:-1]}{{{rule.least - fixed},}}"
    return rule.java


def _found(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(_row, text, _spans): the row as a struct, its text, null as empty, and its spans."""
    text = F.col("text")
    rows = docs.select(
        _row_key().alias("_key"), F.struct("*").alias("_row"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).join(candidates(docs, rules), "_key", "left")
    found = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(
                F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>"))
        found.append(spans)
    return rows.select("_row", "text", F.array_sort(F.concat(*found)).alias("_spans"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns plus ``spans``: (start, rank, kind, stop) by start, then order of rules.

    Columns of the names ``spans`` are replaced.
    """
    kept = [F.col(f"_row.{c}").alias(c) for c in docs.columns if c != "spans"]
    return _found(docs, rules).select(*kept, F.col("_spans").alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with each span replaced by ``[kind]``; rows without spans are unchanged.

    Spans that touch or overlap an earlier one extend it.
    """
    def step(acc, s):
        more = F.concat(
            acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]),
            F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("_spans", start, step, lambda acc: F.concat(
        acc["out"], F.substring("text", acc["at"] + 1, F.length("text") - acc["at"])))
    changed = F.size("_spans") > 0
    found = _found(docs, rules).select("_row", F.when(changed, masked).alias("_masked"))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return found.select(*[
        F.coalesce(new[c], F.col(f"_row.{c}")).alias(c) if c in new else F.col(f"_row.{c}")
        for c in docs.columns])
