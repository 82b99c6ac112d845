"""Secret scan with a trigram inverted index; built-in functions only.

From each rule's regex a Boolean query over trigrams is derived. One pass over the texts gives postings
(trigram, document) for the trigrams of the queries, A-Z folded; the postings of a document are intersected and united as its rules'
queries say; documents that are candidates of a rule are verified with the regex. Rules without mandatory trigrams
scan every text. Positions come from the texts between matches, as Spark has no function for them.

Defined results: a null text is empty and has no spans. Several rows with the same id are scanned each by
themselves. Matches of one rule do not overlap; spans of different rules may. Offsets are code points, end
exclusive. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions.text import let, prefix_sums
from graphtide.llm.columns import guarded
from graphtide.runtime import table


@dataclass(frozen=True)
class Rule:
    """A match counts if its group `group` has min_length characters at least; fold: letters of the regex stand in either case."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 1
    fold: bool = False


#: The base rules of the contract, then further rules of well-known token formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")

# A query is True (every document), a trigram, or ("and" | "or", frozenset of queries).
MAX_STRINGS = 64


def _join(op: str, parts) -> object:
    parts = list(parts)
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat = frozenset(parts)
    return next(iter(flat)) if len(flat) == 1 else (op, flat)


def _strings_query(strings: set[str]) -> object:
    """Documents that hold one of the strings."""
    needs = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    needs = [n for n in needs if not any(o < n for o in needs)]  # a and b, or a: a
    return _join("or", [_join("and", n) for n in needs])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the exact strings, or None if they are not all known, the query that any match implies)."""
    queries, run, known = [], {""}, True
    for op, arg in tree:
        exact, query = _item(op, arg)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, exact)}
            continue
        known = False
        queries += [_strings_query(run), query]
        run = {""} if exact is None else exact
    return (run, True) if known else (None, _join("and", [*queries, _strings_query(run)]))


def _item(op, arg) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower() if value < 128 else chr(value))
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is sre.BRANCH:
        found = [_walk(t) for t in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MAX_STRINGS:
            return set().union(*(e for e, _ in found)), True
        return None, _join("or", [q if e is None else _strings_query(e) for e, q in found])
    if op is sre.SUBPATTERN:
        exact, query = _walk(arg[3])
        return (exact, True) if exact is not None else (None, query)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _walk(body)
        if exact is not None and high == 1:
            return exact | ({""} if low == 0 else set()), True
        if low == 0:
            return None, True
        return None, query if exact is None else _strings_query(exact)
    return None, True


def trigram_query(regex: str) -> object:
    """The Boolean trigram query that every text with a match fulfils; True if there is none."""
    exact, query = _walk(sre_parser.parse(regex))
    return _strings_query(exact) if exact is not None else query


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _folded(text: Column) -> Column:
    """A-Z lower-cased; other letters may fold too, which can only add candidates."""
    return F.lower(text)


def postings(docs: DataFrame, wanted: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: (trigram number, document key), one row for each pair that occurs."""
    low = _folded(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return docs.select(F.col(key), F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: list[tuple[int, object]], wanted: list[str], key: str) -> DataFrame:
    """(document key, mask): bit r is set if the postings fulfil rule r's query."""
    number = {t: i for i, t in enumerate(wanted)}
    words = range((len(wanted) + 62) // 63)
    bits = index.groupBy(key).agg(*[F.expr(f"bit_or(if(trigram div 63 = {w}, shiftleft(1L, cast(trigram % 63 AS int)), 0L))").alias(f"__b{w}") for w in words])

    def holds(query: object) -> Column:
        if isinstance(query, str):
            i = number[query]
            return F.col(f"__b{i // 63}").bitwiseAND(F.lit(1 << (i % 63))) != 0
        parts = [holds(q) for q in sorted(query[1], key=str)]
        return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)

    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(q), F.lit(1 << r)).otherwise(F.lit(0)) for r, q in rules])
    return bits.select(key, mask.alias("__mask")).filter("__mask <> 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule's matches that are long enough: struct(start, order, kind, stop). A match starts after the matches and the gaps before it."""

    def spans(found: Column, gaps: Column) -> Column:
        def span(m: Column, start: Column) -> Column:
            size = F.length(F.regexp_extract(m, rule.regex, rule.group)) if rule.group else F.length(m)
            return F.when(size >= rule.min_length, F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + F.length(m)).alias("stop")))

        moves = F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0)))
        starts = F.zip_with(prefix_sums(moves), gaps, lambda before, g: (before + g).cast("int"))
        # one gap more than matches: the last pair has no match
        return F.filter(F.zip_with(found, starts, span), lambda x: x.isNotNull())

    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    gaps = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    return F.when(text.rlike(rule.regex), let(found, lambda f: let(gaps, lambda g: spans(f, g))))


@guarded
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start, ord, kind, stop>> by start, then rule."""
    docs = docs.drop("secrets").withColumn("__k", F.xxhash64(F.col(doc_id), F.col(text)))
    queries = [(r, trigram_query(rule.regex)) for r, rule in enumerate(rules)]
    indexed = [(r, q) for r, q in queries if q is not True]
    wanted = sorted(set().union(*(trigrams(q) for _, q in indexed))) if indexed else []
    df = docs
    if indexed:
        index = postings(docs.select("__k", F.col(text)), wanted, "__k", text)
        found = candidates(index, indexed, wanted, "__k").hint("shuffle_hash")
        df = docs.join(found, "__k", "left")
    else:
        df = docs.withColumn("__mask", F.lit(0))
    t, mask = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("__mask"), F.lit(0)).cast("long")
    nothing = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    full = {r for r, q in queries if q is True}
    parts = []
    for r, rule in enumerate(rules):
        spans = _spans(t, rule, r)
        parts.append(F.coalesce(spans if r in full else F.when(mask.bitwiseAND(F.lit(1 << r)) != 0, spans), nothing))
    return df.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("__k", "__mask")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>; overlapping spans become one, named after the first."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], x["stop"]).alias("at"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, empty, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).select("doc_id", F.explode(F.array("secrets")).alias("s"))
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("s")).alias("spans"))


def _sql() -> str:
    """The same spans by plain regex functions, without an index."""
    parts = []
    for r, rule in enumerate(RULES):
        regex = rule.regex.replace("'", "''")
        size = f"length(regexp_extract(m[k], '{regex}', {rule.group}))" if rule.group else "length(m[k])"
        parts.append(
            f"SELECT doc_id, {r} AS ord, '{rule.kind}' AS kind, st, st + length(m[k]) AS en FROM (SELECT doc_id, m, k, {size} AS n, "
            f"CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS st "
            f"FROM (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS g "
            f"FROM documents WHERE regexp_matches(text, '{regex}')))) WHERE n >= {rule.min_length}"
        )
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return (
        "WITH s AS (" + " UNION ALL ".join(parts) + "), a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        f"string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) FILTER (kind IN ({base})) AS b, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)"
    )


ORACLE_SQL = _sql()
