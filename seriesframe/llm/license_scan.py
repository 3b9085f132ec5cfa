"""License scan by conditional compression.

Blocks are lines with a cue word and the lines next to them that have one as
well; lines longer than ``LONG`` characters are cut at sentences. A block is
only where the search begins: notices are looked for in as many words on either
side of it as the longest one can have, over line ends and comment marks, so
that hard-wrapped notices are whole. Every notice of every template is compared
by exact wording differences: the fewest words that must be put in, taken out or
replaced to turn it into a part of the text. A confirmed notice has differences
of at most ``MAX_CHANGED`` of its words, none of which is one of its telling
words (names and versions), and no word put in that tells another license
(``OTHER``). SPDX expressions are read exactly, each identifier by itself. Each one found is compressed alone and with each license template
as a raw zstandard dictionary; the share of bytes saved ranks the templates.
Texts are scanned whole, in Arrow batches; templates are fixed and small.

Defined results: a row with its own span for each confirmed notice, so several
where there are several licenses; a row with a null ``license`` for each block
that no confirmed notice touches. ``nearest`` names the template ranked best for
the span. Null and empty texts have no blocks. Repeated rows are all scanned.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from seriesframe.llm.common import read

#: Usual notices of public licenses, and the words that tell them apart.
TEMPLATES = {
    "Apache-2.0": (
        ["Licensed under the Apache License, Version 2.0.",
         "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
         "This project is licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0."],
        ["apache", "2.0"]),
    "MIT": (
        ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
        ["mit"]),
    "GPL-3.0": (
        ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
         "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
        ["gnu", "general", "3"]),
    "GPL-2.0": (
        ["This work is licensed under the GNU General Public License, version 2.",
         "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
        ["gnu", "general", "2"]),
    "LGPL-3.0": (["This library is licensed under the GNU Lesser General Public License, version 3."], ["gnu", "lesser", "3"]),
    "MPL-2.0": (["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."], ["mozilla", "2.0"]),
    "BSD-3-Clause": (
        ["Released under the BSD 3-Clause License.",
         "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
        ["bsd"]),
    "CC-BY-4.0": (["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."], ["4.0"]),
    "CC-BY-SA-4.0": (["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], ["4.0", "sa"]),
    "CC-BY-NC-4.0": (["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."], ["4.0", "nc"]),
    "CC0-1.0": (["Dedicated to the public domain under CC0 1.0."], ["domain", "1.0"]),
}
_NAMES = {name.lower(): name for name in TEMPLATES}
#: Notices whose wording replaces a telling word.
SPELLED = {"sa": ("sharealike",), "nc": ("noncommercial",), "mit": ("hereby",), "bsd": ("redistribution",)}
_GAP = r"[\W_]{1,40}"  # also over a line's end and a comment mark
CUE = re.compile(rf"licen[cs]e|copyright|spdx|creative{_GAP}commons|redistribut|public{_GAP}domain|permission{_GAP}is{_GAP}hereby", re.I)
WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
WORDS = WORD.findall
SENTENCES = re.compile(r"(?<=[.!?])\s+")
LONG = 400
MAX_CHANGED, CONFIRM = 0.25, len(TEMPLATES)
#: Words that make a notice one of another license.
OTHER = frozenset("nc sa nd noncommercial sharealike noderivatives noderivs lesser affero".split())
#: Words on either side of a cue that a notice with all allowed changes can reach.
REACH = max(int(len(WORDS(n)) * (1 + MAX_CHANGED)) for notices, _ in TEMPLATES.values() for n in notices)
TAG = "SPDX-License-Identifier:"
_WORD = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
_ID = rf"(?:\([ \t]*)*{_WORD}(?:[ \t]*\))*"
SPDX = re.compile(rf"{TAG}[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)", re.I)
IDENTIFIER = re.compile(rf"(with[ \t]+)?({_WORD})", re.I)
_ONE = 1 << 32  # a change; the rest of a cost is the distance of the match's start from the end, so that short ones win
_NEVER = 1 << 20


class Scanner:
    """Templates prepared for compression and comparison."""

    def __init__(self, templates=TEMPLATES, level: int = 19):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.templates, self.notices = [], []
        for name, (notices, telling) in templates.items():
            raw = zstandard.ZstdCompressionDict("\n".join([*notices, f"{TAG} {name}"]).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, zstandard.ZstdCompressor(level=level, dict_data=raw)))
            for n in notices:
                words = WORDS(n.lower())
                tells = {next((x for x in (w, *SPELLED.get(w, ())) if x in words), w) for w in telling}
                self.notices.append((name, words, Counter(words), tells))

    def rank(self, block: str) -> list[tuple[float, str]]:
        """Templates by the share of bytes that they save, best first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, name) for name, c in self.templates), key=lambda r: (-r[0], r[1]))

    def confirmed(self, words: list[str]) -> list[tuple[str, int, int, int]]:
        """License, first word, end word and changed words of each confirmed notice, best first."""
        bag = Counter(words)
        found = []
        for name, notice, count, tells in self.notices:
            most = int(MAX_CHANGED * len(notice))
            if all(t in bag for t in tells) and sum(min(c, bag[w]) for w, c in count.items()) >= len(notice) - most:
                found += [(changed / len(notice), -len(notice), name, a, b, changed, tells) for a, b, changed in _matches(notice, words, tells, most)]
        out, told = [], set()
        for *_, name, a, b, changed, tells in sorted(found, key=lambda r: r[:5]):
            here = {k for k in range(a, b) if words[k] in tells}
            if here <= told or any(n == name and c < b and a < d for n, c, d, _ in out):
                continue  # the same words, or the same license, in a closer notice
            told |= here
            out.append((name, a, b, changed))
        return out

    def judge(self, block: str):
        """The closest confirmed license, nearest template, share saved, changed words."""
        sure = [r[2:] for r in self.rows(block) if r[2]]
        ranked = self.rank(block)
        return min(sure, key=lambda r: r[3]) if sure else (None, ranked[0][1], ranked[0][0], None)

    def rows(self, text: str):
        """Start, end, license, nearest, saved and changed words: one for each confirmed notice and each block without any."""
        out = []
        seeds = list(blocks(text))
        if seeds:
            out += [(a, b, name, 0) for a, b, name in identifiers(text)]
        for lo, hi in regions(text, seeds):
            places = [m.span() for m in WORD.finditer(text, lo, hi)]
            for name, a, b, changed in self.confirmed([text[x:y].lower() for x, y in places]):
                start, end = places[a][0], places[b - 1][1]
                out.append((start, end + (text[end:end + 1] in (".", "!", "?")), name, changed))
        taken = [r[:2] for r in out]
        out += [(a, b, None, None) for a, b in seeds if not any(x < b and a < y for x, y in taken)]
        for a, b, name, changed in sorted(out, key=lambda r: r[:2]):
            ranked = self.rank(text[a:b] if " " in text[a:b] else f"{TAG} {text[a:b]}")
            yield a, b, name, ranked[0][1], ranked[0][0] if name is None else dict(map(reversed, ranked))[name], changed


def identifiers(text: str):
    """Start, end and license of each identifier with a template in the SPDX expressions of a text.

    The first one's span begins at the tag. Identifiers are exact: ``MIT-0`` is not ``MIT``.
    """
    for m in SPDX.finditer(text):
        start = m.start()
        for i in IDENTIFIER.finditer(text, *m.span(1)):
            name = i[2].lower()
            name = re.sub(r"-only$|-or-later$", "", name) if "gpl-" in name else name
            name = _NAMES.get(name.removesuffix("+"))
            if name and not i[1]:
                yield start, i.end(), name
            start = next((n.start(2) for n in IDENTIFIER.finditer(text, i.end(), m.end(1)) if n[2].lower() not in ("and", "or")), m.end(1))


def _matches(notice: list[str], words: list[str], tells: set, most: int):
    """Parts of ``words`` (start, end, changes) that ``notice`` turns into by at most ``most`` words put in, taken
    out or replaced, no telling word among them; of parts that overlap the one with the fewest changes."""
    m = len(words)
    enter = np.array([_NEVER if w in OTHER and w not in notice else 1 for w in words], np.int64) * _ONE
    run = np.concatenate([[0], np.cumsum(enter)])
    cost = m - np.arange(m + 1, dtype=np.int64)
    at = {}
    for k, w in enumerate(words):
        at.setdefault(w, []).append(k)
    for w in notice:
        change = np.maximum(enter, _ONE * (_NEVER if w in tells else 1))
        change[at.get(w, [])] = 0
        here = cost + _ONE * (_NEVER if w in tells else 1)
        np.minimum(here[1:], cost[:-1] + change, out=here[1:])
        cost = run + np.minimum.accumulate(here - run)
        if cost.min() >= (most + 1) * _ONE:
            return
    ends = np.flatnonzero(cost < (most + 1) * _ONE)
    taken = np.zeros(m + 1, bool)
    for b in ends[np.argsort(cost[ends], kind="stable")]:
        changed, back = divmod(int(cost[b]), _ONE)
        a = m - back
        if a < b and not taken[a:b].any():
            taken[a:b] = True
            yield a, int(b), changed


def regions(text: str, seeds):
    """Stretches of ``REACH`` words on either side of each block, those that meet as one."""
    held = None
    for a, b in seeds:
        lo, size = a, 16 * REACH
        while lo and len(before := [m.start() for m in WORD.finditer(text, lo, a)]) <= REACH:
            lo, size = max(0, lo - size), 2 * size
        if lo:
            lo = before[-REACH]
        hi = next((m.start() for m in islice(WORD.finditer(text, b), REACH, None)), len(text))
        if held and lo <= held[1]:
            held = (held[0], max(hi, held[1]))
        else:
            if held:
                yield held
            held = (lo, hi)
    if held:
        yield held


def blocks(text: str):
    """Start and end of each candidate block."""
    cues = [m.span() for m in CUE.finditer(text)]
    held, c, at = None, 0, 0
    while c < len(cues):
        at = text.rfind("\n", at, cues[c][0] + 1) + 1 or at
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = stop - at
        pieces = [(at, stop)]
        if line > LONG:
            cuts = [at, *(at + x for m in SENTENCES.finditer(text[at:stop]) for x in m.span()), stop]
            pieces = list(zip(cuts[::2], cuts[1::2]))
        for a, b in pieces:
            while c < len(cues) and cues[c][1] <= a:
                c += 1
            if c < len(cues) and cues[c][0] < b:
                if held and line <= LONG and text[held[1]:a] == "\n":
                    held = (held[0], b)
                else:
                    if held:
                        yield held
                    held = (a, b)
        while c < len(cues) and cues[c][1] <= stop + 1:
            c += 1
        at = stop + 1
    if held:
        yield held


def scan(docs: DataFrame) -> DataFrame:
    """A row for each confirmed notice and each other candidate block of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "end", "license", "nearest", "saved", "changed_words"]
    types = [docs.schema["doc_id"].dataType.simpleString() == "int" and pa.int32() or pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32()]

    def work(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                for a, b, found, nearest, saved, changed in scanner.rows(text):
                    rows.append((key.as_py(), a, b, found, nearest, round(saved, 6), changed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, start int, end int, license string, nearest string, saved double, changed_words int")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
