"""Secret scans by a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize


Query = bool | str | tuple  # True: all texts; a trigram; ("and" | "or", queries)


@dataclass(frozen=True)
class Kind:
    """A kind of secret. ``least``: characters of group ``group`` that a match needs."""

    name: str
    regex: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order of the contract.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are taken whole, so the length may stand in the pattern
)
#: Further kinds, by the public formats of these credentials.
MORE = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}"),
    Kind("google", r"AIza[A-Za-z0-9_-]{35}"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
KINDS = BASE + MORE

_EACH = 2  # trigrams of a mandatory string that the index has: each more costs a look at every text, and narrows little
_OFTEN = " etaoinshrdlcumwfgypbvkjxqz"  # fixed values: letters by falling frequency
_MOST = 64  # strings that a part of a pattern may stand for before its trigrams are taken


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True else ("and", (a, b))


def _rarest(s: str) -> list[str]:
    """The _EACH trigrams of a string that texts hold least, by the usual frequency of their letters."""
    found = dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))
    return sorted(found, key=lambda g: (-sum(_OFTEN.find(c) if c in _OFTEN else len(_OFTEN) for c in g), g))[:_EACH]


def _literal(strings: set[str]) -> Query:
    """All strings must be long enough; a text then holds the rarest trigrams of one of them. A string that
    holds another one of them is told by that.
    """
    if any(len(s) < 3 for s in strings):
        return True
    least = [s for s in sorted(strings) if not any(o != s and o in s for o in strings)]
    parts = [reduce(_both, _rarest(s)) for s in least]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _exact(op, arg) -> set[str] | None:
    """The few lower-case strings that this part of a pattern matches, or None."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT:
        return {""}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[3])
    if op is C.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 8:
        one = _exact_all(arg[2])
        if one is not None and sum(len(one) ** k for k in range(arg[0], arg[1] + 1)) <= _MOST:
            return {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=k)}
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > _MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(items) -> Query:
    now, out = {""}, True
    for op, arg in items:
        one = _exact(op, arg)
        if one is not None and len(now) * len(one) <= _MOST:
            now = {a + b for a in now for b in one}
            continue
        out = _both(out, _literal(now))
        now = one or {""}
        if one is None:
            if op is C.SUBPATTERN:
                out = _both(out, _query(arg[3]))
            elif op is C.BRANCH:
                parts = tuple(_query(p) for p in arg[1])
                out = out if True in parts else _both(out, ("or", parts))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                out = _both(out, _query(arg[2]))
    return _both(out, _literal(now))


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query that the lower-case form of every matching text answers."""
    return _query(_parser.parse(regex))


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _postings(query: Query, index: Column) -> Column:
    """The keys that answer a query, from a block's map of posting lists."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(index, F.lit(query)), F.array().cast("array<bigint>"))
    op = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(op, (_postings(q, index) for q in query[1]))


def candidates(docs: DataFrame, kinds: tuple[Kind, ...], block: int = 4096) -> DataFrame:
    """``_key``, ``_kinds``: which indexed kinds' queries a document answers, as a bit mask.

    The index has the trigrams that some query names. Keys are dealt by hash into blocks of about
    ``block``, so a posting list has one block's keys at most, and a query is a few intersections
    and unions of arrays in each block. Kinds without a mandatory trigram are in no mask.
    """
    queries = {i: q for i, k in enumerate(kinds) if (q := trigram_query(k.regex)) is not True}
    names = sorted(set().union(*map(trigrams, queries.values())))
    if not names:
        return docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.lit(0).cast("long").alias("_kinds")).limit(0)
    blocks = max(1, -(-docs.count() // block))
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select(F.xxhash64("doc_id", "text").alias("_key"), low.alias("_low"))
    found = found.select("_key", F.explode(F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in names]))).alias("_gram"))
    lists = found.groupBy(F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias("_block"), "_gram").agg(F.collect_set("_key").alias("_keys"))
    index = lists.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_gram", "_keys"))).alias("_index"))

    def hits(lists_of: Column) -> Column:  # inside a lambda, so that its size does not overflow generated code
        return F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), _postings(q, lists_of).alias("keys")) for i, q in queries.items()])

    each = index.select(F.explode(let(F.col("_index"), hits)).alias("h")).select("h.bit", F.explode("h.keys").alias("_key"))
    return each.groupBy("_key").agg(F.bit_or("bit").alias("_kinds"))


def _matches(text: Column, kind: Kind, order: int) -> Column:
    """All matches, leftmost and without overlap, as structs of start, kind and end (code points).

    Places follow from the lengths of the matches and of what lies between them.
    """
    between, whole = F.split(text, kind.regex, -1), F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(kind.group))

    def spans(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["skip"]
            one = F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["size"]).alias("end"))
            return F.struct((begin + x["size"]).alias("at"), F.when(x["ok"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, start, add, lambda acc: acc["out"])

    sizes = F.zip_with(
        F.zip_with(whole, tested, lambda w, t: F.struct(F.length(w).alias("size"), (F.length(t) >= kind.least).alias("ok"))),
        F.slice(F.transform(between, lambda b: F.length(b)), 1, F.size(whole)),
        lambda a, b: F.struct(b.alias("skip"), a["size"].alias("size"), a["ok"].alias("ok")),
    )
    return F.when(F.rlike(text, F.lit(kind.regex)), spans(sizes)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, keep: list[str] | None = None, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``docs`` (the columns in ``keep``, by default ``doc_id``) with ``spans``: an array of structs
    (start, kind, end) by start, then kind as listed.

    Candidates come from the index and meet the texts by a hash of id and text: broadcast while there are
    at most ``broadcast_keys`` of them (a checked size of some 16 MB), else both sides are shuffled. Equal rows share
    their candidates, and every candidate is verified by its regex. A null text is empty and has no span. Rows are never dropped or merged.
    """
    docs = docs.select(*dict.fromkeys([*(keep or ["doc_id"]), "doc_id", "text"]))
    found = materialize(candidates(docs, kinds), "secret-candidates")
    few = found.count() <= broadcast_keys
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(F.broadcast(found) if few else found, "_key", "left")
    text, mask = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("_kinds"), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [
        _matches(text, k, i) if trigram_query(k.regex) is True else F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, _matches(text, k, i)).otherwise(none)
        for i, k in enumerate(kinds)
    ]
    return keyed.select(*(keep or ["doc_id"]), F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The contract's columns: counts and digest of the base spans, and all spans as text."""
    found = scan(docs, kinds)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def of(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [of(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base, kinds), 256).alias("base_sha256"), _joined(F.col("spans"), kinds).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (spans that overlap, once) and ``n_chars`` to match.

    No document goes. A text without spans, null or empty, stays as it is.
    """
    columns = docs.columns
    inner = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(columns)}  # so that no name clashes
    found = scan(docs.select(*[F.col(c).alias(n) for c, n in inner.items()]), kinds, keep=list(inner.values()))
    text, any_ = F.col("text"), F.size("spans") > 0
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = found.select(*[F.when(any_, clean).otherwise(text).alias("text") if n == "text" else F.col(n) for n in inner.values()], any_.alias("any"))
    told = {}
    if "n_chars" in columns:
        told["n_chars"] = F.when(F.col("any"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(inner["n_chars"]))
    return found.select(*[told.get(c, F.col(n)).alias(c) for c, n in inner.items()])


def oracle(kinds: tuple[Kind, ...] = KINDS) -> str:
    """``digest`` as DuckDB SQL over ``documents``: every regex over every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, k in enumerate(kinds):
        regex = quoted(k.regex)
        parts.append(f"""SELECT r, {i} AS k, '{k.name}' AS name, list_sum(b[1:i]) + coalesce(list_sum(w[1:i - 1]), 0) AS s, w[i] AS n FROM (
    SELECT r, list_transform(string_split_regex(t, {regex}), lambda x: length(x)) AS b, list_transform(regexp_extract_all(t, {regex}), lambda x: length(x)) AS w,
           list_transform(regexp_extract_all(t, {regex}, {k.group}), lambda x: length(x)) AS g, unnest(generate_series(1, len(w))) AS i FROM texts) WHERE g[i] >= {k.least}""")
    union = "\n  UNION ALL ".join(parts)
    joined = "coalesce(string_agg({0}name || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k){1}, '')"
    base = joined.format("", f" FILTER (WHERE k < {len(BASE)})")
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{k.name}" for i, k in enumerate(BASE))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({union})
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {joined.format("", " FILTER (WHERE k IS NOT NULL)")} AS spans
FROM texts LEFT JOIN found USING (r) GROUP BY r, doc_id"""
