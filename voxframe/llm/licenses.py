"""License scan: Aho-Corasick over tags and notice phrases, shunting-yard over license expressions.

Two automata run over each whole text.  One works on the words (lower-cased, joined by one space) and finds notice
phrases; the other works on the lower-cased text and finds identifier tags, whose expression (the rest of the line) is
turned into postfix order and evaluated.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .rows import map_texts

#: Phrases every scan counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices; they add labels and evidence only.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "@license ")
#: Identifier prefixes, longest first: label, and whether the terms are permissive.
FAMILIES = (
    ("public-domain", "public-domain", True),
    ("unlicense", "public-domain", True),
    ("apache", "apache", True),
    ("cc-by", "cc-by", True),
    ("agpl", "agpl", False),
    ("lgpl", "lgpl", False),
    ("zlib", "zlib", True),
    ("cc0", "cc0", True),
    ("bsd", "bsd", True),
    ("bsl", "bsl", True),
    ("epl", "epl", False),
    ("gpl", "gpl", False),
    ("isc", "isc", True),
    ("mit", "mit", True),
    ("mpl", "mpl", False),
)
FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_tags long, n_notices long, expression string, permissive boolean"
)

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEAD = re.compile(r"[ \t\r*/#\"';,-]*")
_ITEM = re.compile(r"[^\S\n]*([()]|[a-z0-9][a-z0-9.+-]*)")
_TAIL = re.compile(r"[ \t\r*/#\"';,-]*(?:\n|$)")
_FIRST = re.compile(r"[(),;.]*([^ \n(),;]*)")
_RANK = {"with": 3, "and": 2, "or": 1}


def family(identifier: str) -> tuple[str, bool] | None:
    return next(((label, free) for stem, label, free in FAMILIES if identifier.startswith(stem)), None)


def to_postfix(expression: str, start: int = 0, stop: int | None = None) -> list[str] | None:
    """Shunting-yard: with binds tighter than and, and tighter than or.  None if the expression is malformed.

    Reads from ``start`` to ``stop`` and no further than the first item that does not fit.
    """
    out, held, at, operand = [], [], start, True
    stop = len(expression) if stop is None else stop
    while found := _ITEM.match(expression, at, stop):
        at, item = found.end(), found[1]
        if item == "(":
            if not operand:
                return None
            held.append(item)
        elif item == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif item in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[item]:
                out.append(held.pop())
            held.append(item)
            operand = True
        else:
            if not operand:
                return None
            out.append(item)
            operand = False
    if operand or "(" in held or not _TAIL.match(expression, at, stop):
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[frozenset, bool]:
    """Labels named by the expression, and whether its terms can be met permissively.

    or: one permissive side is enough; and: both must be; with: the exception leaves the license before it as it is.
    Unknown identifiers carry no label and are not permissive.
    """
    stack: list[tuple[frozenset, bool]] = []
    for item in postfix:
        if item in _RANK:
            right, left = stack.pop(), stack.pop()
            if item == "with":
                stack.append(left)
            else:
                free = left[1] or right[1] if item == "or" else left[1] and right[1]
                stack.append((left[0] | right[0], free))
        else:
            known = family(item)
            stack.append((frozenset([known[0]]), known[1]) if known else (frozenset(), False))
    return stack[0]


def _automaton(keys: dict):
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, value in keys.items():
        made.add_word(key, (len(key), value))
    made.make_automaton()
    return made


def _kernel():
    phrases = _automaton(
        {f" {p} ": (True, label) for p, label in BASE.items()}
        | {f" {p} ": (False, label) for p, label in NOTICES.items()}
    )
    tags = _automaton({t: t for t in TAGS})

    def scan(text: str | None) -> tuple:
        data = (text or "").encode()
        words = data.translate(_WORD_BYTES).split()
        # Latin-1 keeps one character a byte: the phrases are ASCII, so matches are the same
        joined = b" " + b" ".join(words) + b" "
        base_at, base_labels, labels, notices = [], set(), set(), 0
        for end, (size, (is_base, label)) in phrases.iter(joined.decode("latin-1")):
            labels.add(label)
            if is_base:
                base_at.append(end + 1 - size)
                base_labels.add(label)
            else:
                notices += 1
        first = last = None
        if base_at:
            first = joined.count(b" ", 0, min(base_at) + 1) - 1
            last = joined.count(b" ", 0, max(base_at) + 1) - 1
        n_tags, expression, permissive = 0, None, None
        low = data.translate(_LOWER_BYTES).decode("latin-1")
        for end, _ in tags.iter(low):
            n_tags += 1
            start = _HEAD.match(low, end + 1).end()
            postfix = to_postfix(low, start)
            if postfix:
                found, free = evaluate(postfix)
                labels |= found
                if expression is None:
                    expression, permissive = " ".join(postfix), free
            else:  # prose after the identifier: keep what its first word names
                known = family(_FIRST.match(low, start)[1])
                if known:
                    labels.add(known[0])
        weight = len(base_at) + notices + 2 * n_tags
        return (
            len(words), len(base_at), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            weight / (1.0 + weight), n_tags, notices, expression, permissive,
        )

    names = [f.split()[0] for f in FIELDS.split(", ")]

    def work(texts: list) -> dict[str, list]:
        columns = zip(*map(scan, texts), strict=True) if texts else [[]] * len(names)
        return {n: list(c) for n, c in zip(names, columns, strict=True)}

    return work


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License evidence of every document.

    Null and empty texts give zero counts, null places, empty labels and score 0.  Repeated rows and null ids are
    kept, one result each; an empty table gives an empty result.  Extra columns are ignored.  Where no tag's expression
    is well formed, ``expression`` and ``permissive`` are null; the first well-formed one of a text is reported.
    """
    return map_texts(df, _kernel, FIELDS, id_col, text_col)
