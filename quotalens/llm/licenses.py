"""License scans by conditional compression with license templates (operator 2)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Public license notices, as their authors ask for them to be quoted; several wordings of one license share its id.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
#: What a notice cannot do without, lower case; a line without any is no candidate.
CUES = (b"licen", b"hereby granted", b"redistribut", b"rights reserved", b"public domain", b"waived all copyright", b"spdx")
#: Words around the cues of a block, size reduction (of a template's own compressed size) from which it is confirmed, least share of a template's words found, and words below which a notice must stand exactly.
REACH, REDUCTION, FOUND, SHORT = 40, 0.05, 0.9, 8
#: Words that tell licenses apart, beside those with a digit: an edited notice must keep them.
KEPT = {"gnu", "lesser", "affero", "mit", "apache", "mozilla", "not"}
_TAG = "SPDX-License-Identifier:"
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)
_TOKEN = re.compile(r"\S+")


def _key(word: str) -> str:
    """A word without case and outer punctuation; what is inside (2.0, BY-NC) stays, as it tells licenses apart."""
    return word.lower().strip(".,;:()[]{}\"'*#$%&|!/\\<>")


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    """(license, words, compressor with them as dictionary, own compressed size) of every template and the tag, and the plain compressor."""
    alone, made = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False), []
    for name, text in (*TEMPLATES, (None, _TAG)):
        words = [k for w in text.split() if (k := _key(w))]
        joined = " ".join(words).encode()
        d = zstandard.ZstdCompressionDict(joined, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, words, zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False), len(alone.compress(joined))))
    return tuple(made), alone


def reductions(joined: bytes, near: bytes) -> list[tuple[float, str | None, list[str]]]:
    """(size reduction, license, words) of every template for a block, the largest first: by how much smaller its dictionary makes
    the block, for its own compressed size. Short templates, which save but a few bytes, are also measured on ``near``, the words
    next to the block's cues, and the larger reduction counts, as either size may waver by as much."""
    with_template, alone = _compressors()
    plain = {text: len(alone.compress(text)) for text in (joined, near)}
    found = []
    for name, words, c, own in with_template:
        saved = max(plain[text] - len(c.compress(text)) for text in {joined, near if len(words) < SHORT else joined})
        found.append((saved / own, name, words))
    return sorted(found, key=lambda r: (-r[0], r[1] or ""))


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks (code points, end exclusive): REACH words each side of a cue, joined where they overlap."""
    low = text.encode().lower()
    if not any(c in low for c in CUES):
        return []
    lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    cues = sorted({m.start() for c in CUES for m in re.finditer(re.escape(c.decode()), lower)})
    words = [m.span() for m in _TOKEN.finditer(text)]
    found: list[list[int]] = []
    at = 0
    for cue in cues:
        while at < len(words) and words[at][1] <= cue:
            at += 1
        first, last = max(0, at - REACH), min(len(words) - 1, at + 2 * REACH)
        if found and first <= found[-1][1]:
            found[-1][1] = max(found[-1][1], last)
        else:
            found.append([first, last])
    return [(words[a][0], words[b][1]) for a, b in found]


def _edited(template: list[str], words: list[str]) -> list[tuple[int, int, float]]:
    """(first word, last word, share of the wording) of all places that differ from the template in a few words, none in another.

    Words of the template vote for where it would start; around every start with votes enough the word differences decide.
    Numbers and license names must stand as they are: a changed version is another license.
    """
    n, at, votes = len(template), defaultdict(list), Counter()
    for i, w in enumerate(template):
        at[w].append(i)
    slack = max(2, n // 8)
    for j, w in enumerate(words):
        for i in at.get(w, ()):
            votes[(j - i) // slack] += 1
    found, free = [], 0
    for k in sorted(votes):
        if votes[k - 1] + votes[k] + votes[k + 1] < FOUND * n:
            continue
        low = max(free, (k - 1) * slack)
        same = [b for b in SequenceMatcher(None, template, words[low : (k + 2) * slack + n], autojunk=False).get_matching_blocks() if b.size]
        covered = sum(b.size for b in same)
        if covered < FOUND * n:
            continue
        kept = {i for b in same for i in range(b.a, b.a + b.size)}
        if any(i not in kept and (any(c.isdigit() for c in w) or w in KEPT) for i, w in enumerate(template)):
            continue
        first, last = low + same[0].b, low + same[-1].b + same[-1].size - 1
        if last - first < 2 * n:
            found.append((first, last, covered / n))
            free = last + 1
    return found


def _confirmed(template: list[str], words: list[str]) -> list[tuple[int, int, float, bool]]:
    """All places where the wording stands: exact ones and, between these, edited ones of notices of SHORT words or more."""
    n, exact, k = len(template), [], 0
    while k + n <= len(words):
        if words[k] == template[0] and words[k : k + n] == template:
            exact.append((k, k + n - 1, 1.0, True))
            k += n
        else:
            k += 1
    if n < SHORT:  # a short notice has no word to spare
        return exact
    edited, low = [], 0
    for first, last in [(f, t) for f, t, _, _ in exact] + [(len(words), len(words))]:
        edited += [(low + a, low + b, share, False) for a, b, share in _edited(template, words[low:first])]
        low = last + 1
    return exact + edited


def find_licenses(text: str) -> list[tuple[str, int, int, float, float, bool]]:
    """(license, start, end, size reduction, share of the wording found, exact) of a whole text, in order of start.

    A block is compressed alone and with each template as zstandard raw dictionary, and templates are ranked by the size
    they save. Those that save REDUCTION of their own compressed size or more, and no others, are held against the
    wording, all their places in the block. Where two notices overlap the exact or longer one stays. An SPDX tag names its
    license itself.
    """
    found = []
    for a, b in blocks(text):
        part = text[a:b]
        pairs = [(k, (m.start() + a, m.end() + a)) for m in _TOKEN.finditer(part) if (k := _key(m[0]))]
        words, spans = [k for k, _ in pairs], [s for _, s in pairs]
        hits = [k for k, w in enumerate(words) if any(c.decode().split()[0] in w for c in CUES)]
        near = sorted({i for k in hits for i in range(max(0, k - SHORT), min(len(words), k + SHORT + 1))})
        for saved, name, template in reductions(" ".join(words).encode(), " ".join(words[i] for i in near).encode()):
            if saved < REDUCTION:
                break
            if name is None:
                found += [(m[1], m.start() + a, m.end() + a, saved, 1.0, True) for m in _SPDX.finditer(part)]
            else:
                found += [(name, spans[first][0], spans[last][1], saved, share, exact) for first, last, share, exact in _confirmed(template, words)]
    chosen: list = []
    for one in sorted(set(found), key=lambda f: (not f[5], f[1] - f[2], f[1], f[0])):
        if all(one[2] <= c[1] or one[1] >= c[2] for c in chosen):
            chosen.append(one)
    return sorted(chosen, key=lambda f: (f[1], f[2], f[0]))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, start, end, reduction, wording double, exact) of every notice in every row's whole text.

    Null, empty and cue-less texts give no rows; a text with several notices gives several; repeated rows and null ids
    give their own rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, f) for k, t in enumerate(batch.column(1).to_pylist()) if t for f in find_licenses(t)]
            ids = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            columns = list(zip(*[f for _, f in found])) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types)]], names=[id_col, "license", "start", "end", "reduction", "wording", "exact"])

    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, license string, start long, end long, reduction double, wording double, exact boolean")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document; see ``license_spans``."""
    docs = table(spark, sf_dir, "documents")
    return license_spans(docs)
