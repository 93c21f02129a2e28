"""Fuzzy search for short licence notices.

A notice of ``n`` characters searched with at most ``k`` errors is cut into
``k + 1`` pieces. By the pigeonhole principle an occurrence with at most ``k``
insertions, deletions and substitutions holds at least one piece unchanged, so
one Aho-Corasick pass for all pieces of all notices finds every place that can
match. A bit-parallel edit distance drops the places that hold no match, and at
the others the regex library's bounded-error matching, told how few errors to
look for, verifies the edits and gives the span. Case is ignored.

Defined results: one row for each notice and place, overlapping matches of one
notice reduced to the one with the fewest errors (then the leftmost). A null or
empty text has none, and an empty table gives no row. A null ``doc_id`` is
reported as null. Repeated rows give repeated results. Very long texts are
searched whole, however many notices they hold. Only ``doc_id`` and ``text`` are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, text_chunks

#: Name and wording of each notice.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
    ("reserved-short", "All rights reserved."),
)
#: Errors allowed for each so many characters of a notice.
CHARS_PER_ERROR = 10
FOUND = "doc_id bigint, notice string, start_char int, end_char int, errors int, matched string"
SHAPE = pa.schema([("doc_id", pa.int64()), ("notice", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("errors", pa.int32()), ("matched", pa.string())])


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about the same length, with their offsets."""
    cut = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class Wording:
    """One notice, folded, with what its searches need."""

    def __init__(self, name: str, wording: str, chars_per_error: int):
        self.name, self.text = name, fold(wording)
        self.errors = len(self.text) // chars_per_error
        self.masks: dict[str, int] = {}
        for i, char in enumerate(self.text):
            self.masks[char] = self.masks.get(char, 0) | 1 << i
        self.patterns: dict[int, regex.Pattern] = {}

    def pattern(self, errors: int) -> regex.Pattern:
        if errors not in self.patterns:
            self.patterns[errors] = regex.compile(f"(?:{regex.escape(self.text)}){{e<={errors}}}", regex.BESTMATCH)
        return self.patterns[errors]

    def distances(self, window: str) -> np.ndarray:
        """For each place of the window, the least edit distance of the notice to a substring that ends there (Myers' bit vectors)."""
        size = len(self.text)
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, distance, get, out = full, 0, size, self.masks.get, []
        for char in window:
            eq = get(char, 0)
            x = eq | minus
            diagonal = (((x & plus) + plus) ^ plus) | x
            up, down = minus | ~(diagonal | plus) & full, plus & diagonal
            distance += bool(up & top) - bool(down & top)
            out.append(distance)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(diagonal | up) & full, up & diagonal
        return np.array(out, np.int64)


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], chars_per_error: int):
        self.plans: list[Wording] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for name, wording in notices:
            plan = Wording(name, wording, chars_per_error)
            for offset, piece in pieces(plan.text, plan.errors):
                seeds.setdefault(piece, []).append((len(self.plans), offset))
            self.plans.append(plan)
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, end, errors) of every match, sorted by notice order and place."""
        low = fold(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(low):
            for plan, offset in uses:
                own, at = self.plans[plan], end + 1 - length - offset
                windows.setdefault(plan, []).append([max(0, at - own.errors), min(len(low), at + len(own.text) + own.errors)])
        out = []
        for plan in sorted(windows):
            name = self.plans[plan].name
            merged: list[list[int]] = []
            for a, b in sorted(windows[plan]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                out += [(name, *m) for m in best_matches(self.plans[plan], low, a, b)]
        return out


def best_matches(plan: Wording, low: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches in ``low[a:b]``: the one with the fewest errors, leftmost on ties, then those on either side.

    Distances are computed once. After a match, only those of the few ends
    that a substring from before it can reach are computed again.
    """
    reach, ends, out, left = len(plan.text) + plan.errors, plan.distances(low[a:b]), [], [(a, b)]
    while left:
        x, y = left.pop()
        own = ends[x - a : y - a]
        if not len(own) or (edits := int(own.min())) > plan.errors:
            continue
        # the leftmost match ends this far after the first end with so few errors, at most
        end = x + int(own.argmin()) + 1
        m = plan.pattern(edits).search(low, max(x, end - reach), min(y, end + reach))
        out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        left += [(x, m.start()), (m.end(), y)]
        again = min(y, m.end() + reach)
        ends[m.end() - a : again - a] = plan.distances(low[m.end() : again])
    return sorted(out)


def scan_notices(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Matches of the notices in ``docs``; a map-only job that returns found spans, not texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_per_error)
        for part, texts in text_chunks(batches):
            out = [(doc_id, name, a, b, e, text[a:b]) for doc_id, text in zip(part.column(0).to_pylist(), texts) if text for name, a, b, e in scanner.find(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, SHAPE)], schema=SHAPE)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(table(spark, sf_dir, "documents"))
