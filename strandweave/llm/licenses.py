"""Licence scans: Aho-Corasick finds phrases and tags, a shunting-yard parser evaluates expressions.

Texts are taken as words of letters, digits and everything beyond ASCII, lower-cased in A-Z; one
pass of the automaton over the words finds all phrases and tags, overlapping ones too. Behind each
tag that it finds, if a colon follows there, the expression is read from the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import lean

#: Phrases that count as base places, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge to any person": "mit-notice",
    "permission to use copy modify and or distribute this software": "isc-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "gnu general public license as published by the free software foundation": "gpl-notice",
    "under the terms of the mozilla public license": "mpl-notice",
    "under the terms of the eclipse public license": "epl-notice",
    "licensed under the eupl": "eupl",
    "distributed under the boost software license": "boost",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "this work is licensed under a creative commons": "cc-notice",
}
TAG = "spdx license identifier"
#: Licences that a policy may take as permissive.
PERMISSIVE = frozenset({"0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"})

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_AFTER_TAG = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order, or None if there is none; what follows a whole expression is left.

    WITH binds before AND, AND before OR; parentheses group. WITH stands between one licence and
    one exception: after parentheses or an exception, or before parentheses, it makes no expression.
    Unbalanced parentheses make none either.
    """
    out: list[str] = []
    stack: list[str] = []
    at, last = 0, ""  # last: "licence", "exception", ")", an operator, or nothing yet
    while m := _TOKEN.match(expression, at):
        token = m[1].rstrip(".:-") if m[1] not in "()" else m[1]
        low, operand = token.lower(), last in ("licence", "exception", ")")
        if not operand and (low in _STRENGTH or token == ")") or last == "with" and token == "(" or low == "with" and last != "licence":
            return None
        if operand and token != ")" and low not in _STRENGTH or token == ")" and "(" not in stack:
            break
        at = m.end()
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            last = token
        elif low in _STRENGTH:
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            last = low
        else:
            out.append(low)
            last = "exception" if last == "with" else "licence"
    if last not in ("licence", "exception", ")") or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """The licences that an expression names, and whether ``allowed`` ones alone can satisfy it.

    ``x with e`` is a licence of its own, allowed as x is.
    """
    stack: list[tuple[str, set[str], bool]] = []
    for token in postfix:
        if token not in _STRENGTH:
            stack.append((token, {token}, token in allowed))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            name = f"{a[0]} with {b[0]}"
            stack.append((name, {name}, a[2]))
        else:
            stack.append((token, a[1] | b[1], a[2] or b[2] if token == "or" else a[2] and b[2]))
    return stack[-1][1], stack[-1][2]


_automata: list = []


def _automaton():
    import ahocorasick

    if not _automata:
        machine = ahocorasick.Automaton()
        for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES)):
            for phrase, label in phrases.items():
                machine.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
        machine.add_word(f" {TAG} ", ("tag", "", len(TAG) + 2))
        machine.make_automaton()
        _automata.append(machine)
    return _automata[0]


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, expressions (postfix), permissive (all expressions can be met by permissive licences; null without any).

    Null texts are empty: no words, no labels, score 0. A word beginning of a place counts from 0.
    Score: 1 for an identifier tag with a valid expression, else 0.9 for a base phrase, 0.6 for
    another notice, 0 for none. Null ids and repeated rows are documents like others; other columns
    are ignored; an empty table gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in batches:
            out: list[tuple] = []
            for lo, hi, data, offsets in T.chunks(batch.column(1)):
                low = T.LOWER[data]
                inside = _WORD[data]
                n_words = np.diff(T.rows_of(T.spans(inside, offsets)[0], offsets))
                # words divided by one space each, in one buffer; ``at`` is where its bytes come from
                kept = inside.copy()
                kept[1:] |= ~inside[1:] & inside[:-1]
                at = np.flatnonzero(kept)
                places = np.concatenate([[0], np.cumsum(kept)])[offsets]
                plain = np.where(inside, low, np.uint8(32))[at]
                spaces = np.concatenate([[0], np.cumsum(plain == 32)])
                raw = data.tobytes()
                letters = plain.tobytes().decode("latin-1")  # one letter a byte, so that places are places of bytes
                for row in range(hi - lo):
                    a, z = int(places[row]), int(places[row + 1])
                    # spaces at a row's beginning come from its border with the row before
                    skip = a + (len(letters[a:z]) - len(letters[a:z].lstrip(" ")))
                    out.append(_row(machine, letters, skip, z, spaces, at, raw, int(offsets[row + 1]), int(n_words[row])))
            columns = list(zip(*out, strict=True)) if out else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True))], ["doc_id", *(n for n, _ in _FIELDS)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(find), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean")


def _row(machine, letters: str, a: int, z: int, spaces: np.ndarray, at: np.ndarray, raw: bytes, end_of_row: int, n_words: int) -> tuple:
    """What stands in ``letters[a:z]``: words divided by one space each, the first at ``a``."""
    base, starts, notices = set(), [], set()
    expressions, named, permissive = [], set(), True
    for end, (kind, label, length) in machine.iter(f" {letters[a:z].rstrip(' ')} "):
        begin = a + end - length + 1  # of the phrase's first letter, in ``letters``
        if kind == "base":
            base.add(label)
            starts.append(int(spaces[begin] - spaces[a]))
        elif kind == "notice":
            notices.add(label)
        elif m := _AFTER_TAG.match(raw, int(at[begin + length - 3]) + 1, end_of_row):
            if postfix := parse(m[1].decode("utf-8", "replace")):
                names, allowed = evaluate(postfix)
                expressions.append(" ".join(postfix))
                named |= names
                permissive &= allowed
    score = 1.0 if expressions else 0.9 if base else 0.6 if notices else 0.0
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | notices | named)), score, expressions, permissive if expressions else None
