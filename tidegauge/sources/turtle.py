"""Turtle graphs as triples: one file is read by one task, the rest is joins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<string>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w.-]*))?'
    r"|(?P<at>@prefix|@base|PREFIX|BASE)|(?P<open>\[)|(?P<close>\])|(?P<mark>[;,.])(?=\s|$|[\]])|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s;,.\]]))|(?P<name>[\w-]*:[\w%.:-]*[\w%:-]|[\w-]*:|_:\w+|a\b|true\b|false\b)"
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(m: re.Match[str]) -> str:
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _LETTERS.get(m[3], m[3])


SCHEMA = "path string, s string, p string, o string, is_literal boolean, problem string"


def triples(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(subject, predicate, object, is_literal); names keep their prefix, `a` is rdf:type, blank nodes are numbered. ValueError where the text is no Turtle."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}: {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    blank, stack, skip = 0, [], 0
    subject = predicate = None
    for kind, value in tokens:
        if kind == "at":
            skip = 1
        elif skip:
            # A prefix declaration ends with its IRI (and a dot, which the next statement doesn't mind).
            skip = 0 if kind == "iri" else skip
        elif kind == "open":
            blank += 1
            node = f"_:b{blank}"
            if subject is not None and predicate is not None:
                yield subject, predicate, node, False
            stack.append((subject, predicate))
            subject, predicate = node, None
        elif kind == "close":
            node = subject
            subject, predicate = stack.pop() if stack else (None, None)
            subject = node if subject is None else subject
        elif kind == "mark":
            if value == ";":
                predicate = None
            elif value == ".":
                subject = predicate = None
        elif subject is None:
            subject = value.strip("<>")
        elif predicate is None:
            predicate = "rdf:type" if value == "a" else value.strip("<>")
        else:
            literal = kind in ("string", "number") or value in ("true", "false")
            body = value[3:-3] if value.startswith('"""') else value[1:-1] if kind == "string" else value.strip("<>")
            yield subject, predicate, _ESCAPE.sub(_unescaped, body) if "\\" in body else body, literal
    if subject is not None:
        raise ValueError("the last statement is not closed")


def load_turtle(spark: SparkSession, path: str) -> DataFrame:
    """path, s, p, o, is_literal of all files; a file that is no Turtle gives one row with its problem instead."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["path"], frame["value"], strict=True):
                try:
                    rows = [(name, *t, None) for t in triples(text)]
                except ValueError as e:
                    rows = [(name, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "is_literal", "problem"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, SCHEMA)
