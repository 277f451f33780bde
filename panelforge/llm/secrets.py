"""Secret scanning through a trigram index. DataFrame functions only.

For each rule's regular expression a Boolean query over trigrams is derived:
every match of the rule must contain, for each clause of the query, one of the
clause's trigrams. The index is a table of postings (trigram, document), written
once for the trigrams that the rules ask for. A query looks its trigrams up in
it: a clause is the union of its trigrams' postings, a rule the intersection of
its clauses, which leaves its candidate documents, and only these are scanned
with the expression. A rule whose matches need no fixed trigram, such as a run of
hex digits, scans every document.

Trigrams are of the lower-cased text, so one index serves expressions of either
case. The expressions themselves always run on the text as it is, and always
decide; the index can only spare them documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

try:  # the parser of the standard library's own module
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the group whose length must reach least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds first, in their order, then the kinds added here.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("bearer", r"[bB][eE][aA][rR][eE][rR]\x20+[A-Za-z0-9._~+/=-]+", 0, 23),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[^\x00-\x20/:@]+@", 0, 8),
)

#: Above so many strings a sub-expression counts as free.
MOST_STRINGS = 128


def _strings(parsed) -> tuple[list[set[str] | None], bool]:
    """Parts of a concatenation in order: the set of lower-cased strings each can be, or None where it is free."""
    parts: list[set[str] | None] = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts.append({chr(arg).lower()})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            parts.append(chars)
        elif op is sre.SUBPATTERN:
            parts += _strings(arg[-1])
        elif op is sre.BRANCH:
            parts.append(_alternatives([_strings(branch) for branch in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            inner_parts = _strings(inner)
            if low == 0 and high == 1 and len(inner_parts) == 1 and inner_parts[0] is not None:
                parts.append(inner_parts[0] | {""})
            else:
                for _ in range(min(low, 3)):
                    parts += inner_parts
                if low != high or low > 3:
                    parts.append(None)
        else:
            parts.append(None)
    return parts


def _alternatives(branches: list[list[set[str] | None]]) -> set[str] | None:
    out: set[str] = set()
    for parts in branches:
        whole = _product(parts)
        if whole is None:
            return None
        out |= whole
    return out


def _product(parts: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses that every match satisfies: a match contains a trigram of each. Empty: scan fully.

    A stretch of the expression with few possible strings gives a clause for
    every place at which all of its strings have a trigram.
    """
    runs: list[set[str]] = [{""}]
    for part in _strings(sre_parse.parse(pattern)):
        joined = None if part is None else _product([runs[-1], part])
        if joined is not None:
            runs[-1] = joined
        else:
            runs.append({""} if part is None or len(part) > MOST_STRINGS else set(part))
    clauses = set()
    for strings in runs:
        shortest = min(map(len, strings))
        for at in range(shortest - 2):
            clauses.add(frozenset(s[at : at + 3] for s in strings))
    best = sorted(clauses, key=lambda c: (len(c), sorted(c)))
    return [c for c in best if len(c) <= max(8, len(best[0]))][:4]


def clauses_of(rules: tuple[Rule, ...]) -> list[tuple[str, int, str]]:
    """(kind, clause, trigram) of the Boolean queries of all rules that have one."""
    return [(r.kind, i, t) for r in rules for i, clause in enumerate(trigram_query(r.pattern)) for t in sorted(clause)]


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index of rows(row_key, text): (trigram, row_key) for each of the trigrams that a text has, written as a table."""
    has = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return materialize(rows.withColumn("low", F.lower("text")).select(F.explode(F.array_compact(has)).alias("trigram"), "row_key"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, kinds): for each document the kinds whose clauses' postings all have it. index may serve several sets of rules."""
    asked = clauses_of(rules)
    terms = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(t).alias("trigram")) for k, c, t in asked]
    query = index.sparkSession.range(1).select(F.inline(F.array(*terms)))
    # Look-ups by trigram; the query has some hundred rows, which the rules bound. A union of postings has a document once.
    union = index.join(F.broadcast(query), "trigram").select("row_key", "kind", "clause").distinct()
    met = union.groupBy("row_key", "kind").agg(F.count(F.lit(1)).alias("met"))
    needs = {kind: len({c for k, c, _ in asked if k == kind}) for kind, _, _ in asked}
    of_kind = F.create_map(*[F.lit(x) for pair in needs.items() for x in pair])
    return met.filter(F.col("met") == of_kind[F.col("kind")]).groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Numbers of an array that are added up together.
STRETCH = 256


def sums_before(numbers: str) -> str:
    """SQL for the sum of the numbers before each number of an array.

    An accumulator that grows is copied for each number, so the array is cut: the
    sums of its stretches come first, then those inside each stretch.
    """
    none = "CAST(struct({at} AS at, array() AS out) AS struct<at:int,out:array<int>>)"
    grown = "(a, x) -> struct(a.at + x AS at, array_append(a.out, a.at) AS out), a -> a.out"
    cut = f"transform(array({numbers}), n -> transform(sequence(0, size(n) div {STRETCH}), i -> slice(n, i * {STRETCH} + 1, {STRETCH})))[0]"
    starts = f"aggregate(transform(cut, x -> aggregate(x, 0, (a, b) -> a + b)), {none.format(at=0)}, {grown})"
    return f"transform(array({cut}), cut -> flatten(zip_with(cut, {starts}, (part, first) -> aggregate(part, {none.format(at='first')}, {grown}))))[0]"


def spans(rule: Rule, order: int, text: str = "text") -> str:
    """SQL for the matches of a rule as array<struct<start, kind, span>>; code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so
    their lengths give the positions.
    """
    pattern = _lit(rule.pattern)
    pieces = f"transform(split({text}, {pattern}, -1), x -> length(x))"
    found = f"transform(regexp_extract_all({text}, {pattern}, 0), x -> length(x))"
    judged = f"transform(regexp_extract_all({text}, {pattern}, {rule.group}), x -> length(x))"
    matched = f"zip_with({found}, {judged}, (n, g) -> struct(n AS n, g AS g))" if rule.group else f"transform({found}, n -> struct(n AS n, n AS g))"
    # A list in an array of one is bound to a name, so that it is made once.
    return f"""filter(transform(array(zip_with({pieces}, {matched}, (gap, m) -> struct(gap AS gap, m.n AS n, m.g AS g))), ms ->
        zip_with(ms, {sums_before('transform(ms, m -> m.gap + coalesce(m.n, 0))')}, (m, at) ->
            CASE WHEN m.g >= {rule.least} THEN struct(at + m.gap AS start, {order} AS kind, concat('{rule.kind}:', at + m.gap, ':', at + m.gap + m.n) AS span) END))[0], s -> s IS NOT NULL)"""


SPANS = "array<struct<start:int,kind:int,span:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """One row for each row of docs: doc_id, text and found, the spans by start and kind.

    A null text counts as empty; it has no spans, like an empty one. Repeated
    rows and equal texts get equal spans; null ids are kept. The join key is a
    hash of id and text: should two rows share it, both are scanned for the
    kinds of either, and the expressions decide.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    index = postings(rows, sorted({t for _, _, t in clauses_of(rules)}))
    joined = rows.join(materialize(candidates(index, rules)), "row_key", "left")
    found = []
    for order, rule in enumerate(rules):
        scan = f"array_contains(kinds, '{rule.kind}')" if trigram_query(rule.pattern) else f"text RLIKE {_lit(rule.pattern)}"
        found.append(f"CASE WHEN {scan} THEN {spans(rule, order)} ELSE CAST(array() AS {SPANS}) END")
    return joined.select("doc_id", "text", F.expr(f"array_sort(concat({', '.join(found)}))").alias("found"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 over the base spans, and all spans joined."""
    joined = lambda which: f"array_join(transform({which}, x -> x.span), ',')"
    return find_secrets(docs).selectExpr(
        "doc_id",
        *[f"CAST(size(filter(found, x -> x.kind = {i})) AS bigint) AS n_{r.kind}" for i, r in enumerate(BASE)],
        f"sha2({joined(f'filter(found, x -> x.kind < {len(BASE)})')}, 256) AS base_sha256",
        f"{joined('found')} AS spans",
    )


def oracle_sql() -> str:
    """The same in DuckDB: every rule scans every text."""
    lists = []
    for order, rule in enumerate(BASE + ADDED):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        lists.append(
            f"""list_transform(list_filter(range(1, len(regexp_extract_all(text, {pattern})) + 1),
                   lambda i: length(regexp_extract_all(text, {pattern}, {rule.group})[i]) >= {rule.least}),
                 lambda i: {{'start': coalesce(list_sum(list_transform(string_split_regex(text, {pattern})[1:i], lambda x: length(x))), 0)
                          + coalesce(list_sum(list_transform(regexp_extract_all(text, {pattern})[1:i-1], lambda x: length(x))), 0),
                        'kind': {order}, 'name': '{rule.kind}', 'n': length(regexp_extract_all(text, {pattern})[i])}})"""
        )
    joined = lambda which: f"coalesce(array_to_string(list_transform({which}, lambda x: x.name || ':' || CAST(x.start AS BIGINT) || ':' || CAST(x.start + x.n AS BIGINT)), ','), '')"
    counts = ", ".join(f"CAST(len(list_filter(found, lambda x: x.kind = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, list_sort({' || '.join(lists)}) AS found FROM t)
SELECT doc_id, {counts}, sha256({joined(f'list_filter(found, lambda x: x.kind < {len(BASE)})')}) AS base_sha256, {joined('found')} AS spans
FROM f
"""
