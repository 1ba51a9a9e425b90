"""Licence scan: Aho-Corasick for phrases and tags, shunting-yard for expressions.

A text is read as its lower-cased words. One automaton holds every notice phrase
and identifier tag as words between single spaces; one pass over the words finds
them all. Behind an identifier tag stands a licence expression ("MIT OR (BSD-3-Clause
AND Zlib)"): its tokens, taken from the original text up to the line's end, go
through a shunting-yard parser with AND above OR and WITH above both.

An expression is a choice of sets of licences. OR puts the choices of both sides
beside each other, AND joins each choice of one side with each of the other, WITH
adds an exception to the licence before it. Kept of it are the licences that are
named at all and those that every choice asks for, which is all that AND and OR need:
asked by "a AND b" are those of a and of b, asked by "a OR b" those of both. So
"MIT AND GPL-2.0" asks for both licences and "MIT OR GPL-2.0" for neither.

The labels are those of phrases and of all named licences: a family for the known
ones, the identifier itself for others. `required` holds what every choice of some
expression asks for, `exceptions` what stands behind WITH. The score is 1 - 2**-w,
where w adds 1 for each distinct phrase label and, for each expression, 1 and the
share of its named licences that it requires: 0 without any evidence, near 1 with much.

Null and empty texts have no words, no places, null first_word and last_word and
empty labels. Texts are read whole, whatever their length. Repeated rows are
scanned one by one; empty tables give empty results; other columns pass through
and columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import textvec

#: The phrases that count as places, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases that only add labels.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "isc license": "isc",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: Licence families by how an identifier begins.
FAMILIES = ("mit", "apache", "agpl", "lgpl", "gpl", "bsd", "mpl", "isc", "epl", "cc", "unlicense", "zlib")

_token = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_priority = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order, or None where it isn't one.

    Reads the longest run of tokens that can belong to an expression.
    """
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for m in _token.finditer(text):
        token = m[0]
        word = token.lower()
        if word == "(":
            if not wants_operand:
                break
            stack.append("(")
        elif word == ")":
            if wants_operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in _priority:
            if wants_operand:
                break
            while stack and stack[-1] != "(" and _priority[stack[-1]] >= _priority[word]:
                out.append(stack.pop())
            stack.append(word)
            wants_operand = True
        else:
            if not wants_operand:
                break
            out.append(token.rstrip("."))
            wants_operand = False
    if wants_operand or "(" in stack:
        return None
    return out + stack[::-1]


def label_of(identifier: str) -> str | None:
    """The family of a licence identifier; itself if it is of no known one; None for a plain word."""
    name = identifier.lower().rstrip("+")
    bare = name.lstrip("0123456789")
    for f in FAMILIES:
        if bare.startswith(f) and not bare[len(f) : len(f) + 1].isalpha():
            return f
    return name if any(c.isdigit() or c == "-" for c in name) else None


class Expression(NamedTuple):
    named: frozenset[str]
    required: frozenset[str]  # by every choice
    exceptions: frozenset[str] = frozenset()


def evaluate(postfix: list[str]) -> Expression:
    """What a postfix expression names and requires."""
    stack: list[tuple[str, Expression]] = []  # an operand's own token, and its value
    for token in postfix:
        if token in ("and", "or"):
            (_, b), (_, a) = stack.pop(), stack.pop()
            required = a.required | b.required if token == "and" else a.required & b.required
            stack.append((token, Expression(a.named | b.named, required, a.exceptions | b.exceptions)))
        elif token == "with":
            (exception, _), (name, a) = stack.pop(), stack.pop()
            stack.append((name, a._replace(exceptions=a.exceptions | {exception.lower()})))
        else:
            label = label_of(token)
            own = frozenset() if label is None else frozenset({label})
            stack.append((token, Expression(own, own)))
    return stack.pop()[1]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32


def _scan(batch: pa.RecordBatch, column: str, machine: ahocorasick.Automaton) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in RESULT.names}
    for chunk in textvec.chunks(batch[column]):
        w = textvec.words(chunk, textvec.ALNUM, hashed=False)
        # Words with one space after each: every word byte, and the first byte behind each word as the space.
        lengths = w.ends - w.starts
        place = np.cumsum(lengths + 1) - lengths - 1
        flat = np.full(int(place[-1] + lengths[-1] + 1) if len(place) else 0, 0x20, dtype=np.uint8)
        inside = np.ones(len(flat), dtype=bool)
        inside[place + lengths] = False
        source = np.repeat(w.starts - place, lengths + 1) + np.arange(len(flat))
        flat[inside] = _lower[chunk.buf[source[inside]]]
        for i in range(len(chunk)):
            low, high = int(w.range[i]), int(w.range[i + 1])
            base: set[str] = set()
            notices: set[str] = set()
            starts: list[int] = []
            expressions: list[Expression] = []
            if high > low:
                begin = int(place[low])
                text = " " + flat[begin : int(place[high - 1] + lengths[high - 1] + 1)].tobytes().decode("utf-8", "replace")
                read = at = 0
                for end, (kind, label, size) in machine.iter(text):
                    at += len(text[read:end].encode())
                    read = end
                    word = int(np.searchsorted(place[low:high], begin + at - size + 1))
                    if kind == "base":
                        base.add(label)
                        starts.append(word)
                    elif kind == "notice":
                        notices.add(label)
                    else:
                        behind = int(w.ends[low + word + 2])
                        line = chunk.buf[behind : chunk.bounds[i + 1]].tobytes().split(b"\n", 1)[0].decode("utf-8", "replace").lstrip(": \t")
                        if postfix := parse_expression(line):
                            expressions.append(evaluate(postfix))
            out["n_words"].append(high - low)
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            told = [e for e in expressions if e.named]
            every = lambda part: set().union(*(getattr(e, part) for e in told))
            out["labels"].append(",".join(sorted(base | notices | every("named"))))
            out["required"].append(",".join(sorted(every("required"))))
            out["exceptions"].append(",".join(sorted(every("exceptions"))))
            out["score"].append(1 - 2.0 ** -(len(base | notices) + sum(1 + len(e.required) / len(e.named) for e in told)))
    return out


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels", "required", "exceptions")]
    + [T.StructField("score", T.DoubleType())]
)


def scan_licenses(df: DataFrame, column: str = "text") -> DataFrame:
    """df without its text, with the scan's columns for each row."""
    kept = [c for c in df.columns if c not in (column, *RESULT.names)]
    schema = T.StructType([df.schema[c] for c in kept] + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            found = _scan(batch, column, machine)
            arrays = [batch[c] for c in kept] + [pa.array(found[f.name], type=pa.float64() if f.name == "score" else pa.int64() if f.dataType == T.LongType() else pa.string()) for f in RESULT.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[f"`{c}`" for c in kept], f"`{column}`").mapInArrow(run, schema)
