"""Secret scan over a trigram index, in DataFrame functions alone.

Each rule's regex is turned into a Boolean query over the trigrams that any match must hold.  The postings of those
trigrams (lists of row keys, in blocks of bounded size) are intersected and united as the query says, and the regex
runs only over the candidates.  A rule without mandatory trigrams runs over every text.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as _op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.binding import bound

from .shared import Scratch

#: Rows whose postings are intersected together, about, and the terms that a row has, about.
BLOCK_ROWS, _TERMS_A_ROW = 2048, 4
#: Kind, regex, group whose length counts, least length.  The first three are the base kinds.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}", 0, 1),
    ("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 24),
)
N_BASE = 3
#: Trigrams that are asked of a string, and fixed values: characters from the most frequent on (others, index -1, come first).
_TRIGRAMS, _FREQUENT = 2, " etaoinshrdlcumwfgypbvkjxqz0123456789-_.'\""
#: Elements of an array that are gone through together.
_PART = 512
#: Literal variants of a stretch of a regex that are followed at once.
_VARIANTS = 64

# A query is True (no demand), a trigram, or ("and" | "or", parts).


def _join(kind: str, parts: list):
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _demand(strings: set[str]):
    """What a text that holds one of the strings must hold: the string's rarest trigrams by the frequency of their letters."""

    def rarest(s: str) -> list[str]:
        found = dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))
        return sorted(sorted(found, key=lambda g: sum(map(_FREQUENT.find, g)), reverse=True)[:_TRIGRAMS])

    least = [s for s in strings if not any(t != s and t in s for t in strings)]  # who holds a longer one holds its part
    return _join("or", [_join("and", rarest(s)) for s in sorted(least)])


def _node(op, value):
    """(all strings it can match, lower-cased, or None if too many; query)."""
    if op is _op.LITERAL:
        return {chr(value).lower()}, True
    if op is _op.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is _op.LITERAL:
                chars.add(chr(v).lower())
            elif kind is _op.RANGE and v[1] - v[0] < _VARIANTS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is _op.SUBPATTERN:
        return _sequence(value[-1])
    if op is _op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        queries = _join("or", [_join("and", [q, _demand(s)]) if s is not None else q for s, q in parts])
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), queries
        return None, queries
    if op in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return (strings | {""} if least == 0 else strings), query if least else True
        if least and strings is not None:
            return None, _join("and", [query, _demand(strings)])
        return None, query if least else True
    return None, True


def _sequence(items):
    run, query, whole = {""}, True, True
    for op, value in items:
        strings, demand = _node(op, value)
        query = _join("and", [query, demand])
        wider = {a + b for a in run for b in strings} if strings is not None else set()
        if strings is not None and len(wider) <= _VARIANTS:
            run = wider
            continue
        query, whole = _join("and", [query, _demand(run)]), False
        run = strings if strings is not None else {""}
    return (run, query) if whole else (None, _join("and", [query, _demand(run)]))


def trigram_query(pattern: str):
    """The Boolean trigram query that every lower-cased text with a match fulfils; True if there is none."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _join("and", [query, _demand(strings)])


def _terms(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_terms, query[1]))


def _any_of(terms: list[str]) -> str:
    """A regex that finds every place where a trigram starts, tried by first letter."""
    by_first: dict[str, list[str]] = {}
    for t in terms:
        by_first.setdefault(t[0], []).append(t[1:])

    def quoted(s: str) -> str:
        return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in s)

    branches = "|".join(quoted(c) + "(?:" + "|".join(map(quoted, rest)) + ")" for c, rest in by_first.items())
    classes = "".join(f"[{''.join(map(quoted, sorted({t[k] for t in terms})))}]" for k in range(3))  # rejects most places at once
    return f"(?={classes})(?=({branches}))"


def _candidates(query, postings: Column) -> Column:
    """The row keys that fulfil a query, out of a map from trigram to row keys."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    merge = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(merge, [_candidates(q, postings) for q in query[1]])


def _spans(text: Column, rule: tuple) -> Column:
    """(start, kind number, end) of a rule's matches, leftmost and not overlapping, that are long enough.

    What lies between the matches and the matches themselves, by turns, give the places in code points.
    """
    pattern, group, least = rule[1:]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    number = [r[0] for r in RULES].index(rule[0])
    steps = F.arrays_zip(
        F.slice(between, 1, F.size(hits)).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        F.transform(measured, F.length).alias("counted"),
    )

    def placed(steps: Column) -> Column:
        at = _running(F.transform(steps, lambda s: s["gap"] + s["size"]), lambda a, b: a + b)
        found = F.zip_with(
            steps,
            at,
            lambda s, a: F.struct(
                (a + s["gap"]).alias("start"),
                F.lit(number).alias("kind"),
                (a + s["gap"] + s["size"]).alias("end"),
                s["counted"].alias("counted"),
            ),
        )
        enough = F.filter(found, lambda s: s["counted"] >= least)
        return F.transform(enough, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(steps, placed)).otherwise(none)


def _parts(values: Column) -> Column:
    """An array in parts of _PART."""
    last = ((F.size(values) - 1) / _PART).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * _PART + 1, F.lit(_PART)))
    return F.when(F.size(values) > 0, each).otherwise(F.array().cast("array<array<int>>"))


def _running(values: Column, combine) -> Column:
    """What the elements before each one come to, from 0 on.  Arrays are built in parts, as appending to an array copies it."""

    def before(part: Column, start: Column) -> Column:
        return F.slice(
            F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x))), 1, F.size(part)
        )

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), combine))
        return F.flatten(F.zip_with(parts, before(whole, F.lit(0)), before))

    return bound(values, lambda v: bound(_parts(v), joined))


def _fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    spans_col: str = "_secret_spans",
) -> DataFrame:
    """All rows and columns, with ``spans_col``: (start, kind number, end) of every match, in order.

    Null texts have no spans.  Repeated rows and null ids are kept; no text is shortened; other columns pass through, but
    one that is called ``spans_col`` is replaced.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, rules = _fresh(df, "_secret_key"), _fresh(df, "_secret_rules")
    row_key = F.xxhash64(F.col(id_col).cast("string"), text)
    queries = {k: trigram_query(rule[1]) for k, rule in enumerate(RULES)}
    terms = sorted(set().union(*map(_terms, queries.values())))

    # One pass over the text finds all terms: a look-ahead, so that they may overlap
    held = F.regexp_extract_all(F.lower(text), F.lit(_any_of(terms)), F.lit(1))
    # Rows that repeat, a third of the table perhaps, are one key: they are put together before the shuffle
    present = df.select(row_key.alias("key"), F.explode(F.array_distinct(held)).alias("term")).distinct()
    present = scratch.keep(present, "present")
    blocks = max(1, -(-present.count() // (_TERMS_A_ROW * block_rows)))
    postings = (
        present.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "term")
        .agg(F.collect_list("key").alias("rows"))  # distinct keys of one block
        .groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "rows"))).alias("postings"))
    )

    def tagged(rule: int) -> Column:
        rows = _candidates(queries[rule], F.col("postings"))
        return F.transform(rows, lambda k: F.struct(k.alias("key"), F.lit(rule).alias("rule")))

    listed = [tagged(k) for k, q in queries.items() if q is not True]
    found = (
        postings.select(F.explode(F.flatten(F.array(*listed))).alias("c"))
        .select("c.*")
        .groupBy("key")
        .agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))
    )
    # Written, so that its size is known when the join is planned: few candidates are broadcast, and no text is shuffled
    found = scratch.keep(found, "candidates").select(F.col("key").alias(key), F.col("rules").alias(rules))
    due = F.coalesce(F.col(rules), F.lit(0))
    each = [
        _spans(text, rule)
        if queries[k] is True
        else F.when(due.bitwiseAND(F.lit(1 << k)) != 0, _spans(text, rule))
        for k, rule in enumerate(RULES)
    ]
    spans = F.array_sort(F.flatten(F.array_compact(F.array(*each))))
    keyed = df.withColumn(key, row_key)
    return keyed.join(found, key, "left").withColumn(spans_col, spans).drop(key, rules)


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and listing of the spans of every row; see find_secrets for nulls and repeated rows."""
    found = find_secrets(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("_secret_spans", lambda s: s["kind"] < N_BASE)

    def count(kind: int) -> Column:
        return F.size(F.filter("_secret_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{RULES[k][0]}") for k in range(N_BASE)],
        F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.col("_secret_spans")).alias("spans"),
    )


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with every span of the text replaced by the mask; overlapping spans become one."""
    spans = _fresh(df, "_secret_spans")
    found = find_secrets(df, id_col, text_col, spans_col=spans)
    text = F.col(text_col)
    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # where the spans before each one end
    heads = F.filter(F.arrays_zip(F.col(spans).alias("span"), ends.alias("from")), lambda z: z["span"]["start"] >= z["from"])

    def masked(cuts: Column) -> Column:
        """Pieces between (from, start), in parts: a place in a text is found by going through it from its start."""
        parts = F.transform(
            F.sequence(F.lit(0), ((F.size(cuts) - 1) / _PART).cast("int")), lambda k: F.slice(cuts, k * _PART + 1, F.lit(_PART))
        )

        def part(cut: Column) -> Column:
            begin, end = F.get(cut, F.lit(0))["from"], F.element_at(cut, -1)["span"]["start"]
            return bound(
                F.substring(text, begin + 1, end - begin),
                lambda t: F.array_join(
                    F.transform(cut, lambda z: F.concat(F.substring(t, z["from"] - begin + 1, z["span"]["start"] - z["from"]), F.lit(mask))), ""
                ),
            )

        rest = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(F.transform(parts, part), ""), F.substring(text, rest + 1, F.length(text)))

    return found.withColumn(text_col, F.when(F.size(spans) > 0, bound(heads, masked)).otherwise(text)).drop(spans)
