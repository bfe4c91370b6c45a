"""License scans: sentence-rule recognition.

Texts are normalised (lower case, letters, digits and single spaces), and known
licence sentences are looked up in them at word boundaries, so it doesn't matter
how lines are wrapped, where a licence's own words hold stops or what stands around
them; of sentences that begin at the same word the longest counts.  Titles must be
a line or a sentence of their own.  What a document holds is thus a sequence of
sentence identifiers, and a rule is an ordered sequence of them: it matches where
its identifiers follow each other with no more than ``GAP`` other sentences
between two; sentences end at stops and blank lines, or at a line's end after one.
Of rules that match over one another's sentences the longest counts.

Only texts with a cue word are looked at (every known sentence has one, which
is checked when the module is loaded), so whole corpora are read at little cost.

Defined results: null and blank texts hold nothing; repeated rows each return a row;
other columns are ignored; a document that holds no licence has empty lists.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text

#: Most other sentences between two sentences of a rule.
GAP = 1

# Public licence sentences, normalised, by identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2.under": "licensed under the apache license version 2 0",
    "apache2.under_the": "licensed under the apache license version 2 0 the license",
    "apache2.may_not": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.under": "licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl2.under": "licensed under the gnu general public license version 2",
    "lgpl3.under": "licensed under the gnu lesser general public license version 3",
    "agpl3.under": "licensed under the gnu affero general public license version 3",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "this work is licensed under cc0 1 0",
    "ccby4.under": "licensed under cc by 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.under": "licensed under cc by sa 4 0",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.under": "licensed under cc by nc 4 0",
    "ccbyncnd4.under": "licensed under cc by nc nd 4 0",
    "ccbynd4.under": "licensed under cc by nd 4 0",
    "reserved": "all rights reserved",
    "mpl2.copy_http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "gpl3.later": "licensed under the gnu general public license version 3 or later",
    "gpl3.any_later": "licensed under the gnu general public license version 3 or any later version",
    "gpl2.later": "licensed under the gnu general public license version 2 or later",
    "gpl2.any_later": "licensed under the gnu general public license version 2 or any later version",
    "lgpl3.later": "licensed under the gnu lesser general public license version 3 or later",
    "agpl3.later": "licensed under the gnu affero general public license version 3 or later",
    "apache2.head": "apache license version 2 0 january 2004",
    "gpl3.head": "gnu general public license version 3 29 june 2007",
    "gpl2.head": "gnu general public license version 2 june 1991",
    "lgpl3.head": "gnu lesser general public license version 3 29 june 2007",
    "agpl3.head": "gnu affero general public license version 3 19 november 2007",
}
# Titles, which must stand alone.
TITLES = {
    "the mit license": "mit.title", "mit license": "mit.title", "the mit license mit": "mit.title", "apache license version 2 0": "apache2.title", "apache license 2 0": "apache2.title",
    "mozilla public license version 2 0": "mpl2.title", "mozilla public license 2 0": "mpl2.title", "bsd 3 clause license": "bsd3.title", "bsd 2 clause license": "bsd2.title", "isc license": "isc.title", "the isc license": "isc.title",
}
# Licence, and the ordered sentences that show it.
RULES = (
    ("MIT", ("mit.released",)), ("MIT", ("mit.licensed",)), ("MIT", ("mit.title",)), ("MIT", ("mit.grant", "mit.notice")), ("MIT", ("mit.grant",)),
    ("Apache-2.0", ("apache2.under",)), ("Apache-2.0", ("apache2.under_the", "apache2.may_not", "apache2.copy")), ("Apache-2.0", ("apache2.under_the",)),
    ("GPL-3.0", ("gpl3.work",)), ("GPL-3.0", ("gpl3.under",)), ("GPL-3.0-or-later", ("gpl.free", "gpl.copy")), ("GPL-3.0-or-later", ("gpl.free",)),
    ("GPL-2.0", ("gpl2.under",)), ("LGPL-3.0", ("lgpl3.under",)), ("AGPL-3.0", ("agpl3.under",)), ("MPL-2.0", ("mpl2.form", "mpl2.copy")), ("MPL-2.0", ("mpl2.form",)),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse")), ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    ("ISC", ("isc.grant",)), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0",)), ("CC-BY-4.0", ("ccby4.under",)), ("CC-BY-4.0", ("ccby4.work",)),
    ("CC-BY-SA-4.0", ("ccbysa4.under",)), ("CC-BY-SA-4.0", ("ccbysa4.work",)), ("CC-BY-NC-4.0", ("ccbync4.under",)), ("CC-BY-NC-ND-4.0", ("ccbyncnd4.under",)), ("CC-BY-ND-4.0", ("ccbynd4.under",)),
    ("Proprietary", ("reserved",)),
    ("MPL-2.0", ("mpl2.form", "mpl2.copy_http")), ("GPL-3.0-or-later", ("gpl3.later",)), ("GPL-3.0-or-later", ("gpl3.any_later",)), ("GPL-2.0-or-later", ("gpl2.later",)), ("GPL-2.0-or-later", ("gpl2.any_later",)),
    ("LGPL-3.0-or-later", ("lgpl3.later",)), ("AGPL-3.0-or-later", ("agpl3.later",)), ("Apache-2.0", ("apache2.head",)), ("GPL-3.0", ("gpl3.head",)), ("GPL-2.0", ("gpl2.head",)), ("LGPL-3.0", ("lgpl3.head",)), ("AGPL-3.0", ("agpl3.head",)),
    ("Apache-2.0", ("apache2.title",)), ("MPL-2.0", ("mpl2.title",)), ("BSD-3-Clause", ("bsd3.title",)), ("BSD-2-Clause", ("bsd2.title",)), ("ISC", ("isc.title",)),
)
CUES = re.compile(r"licen[sc]|copyright|redistribut|permission|software|mozilla|the\W+mpl|rights\W+reserved", re.I)
_STOP = re.compile(r"(?<=[^\W\d_])[.!?;:]+(?=\s|$)|(?<=\d)[.!?;:]+(?=\s+[A-Z]|\s*$)", re.M)
_BLANK = re.compile(r"(?:\r\n?|\n)[^\w\r\n]*(?=[\r\n])")  # a line without letters and digits, as in comments too
_OTHER = re.compile(r"[^a-z0-9]+")
_IDS = {text: name for name, text in SENTENCES.items()}
assert all(CUES.search(x) for x in (*_IDS, *TITLES))


def sentences(text: str) -> Iterator[str]:
    """The sentences, their wrapped lines joined, before normalisation."""
    for part in _BLANK.split(text):
        yield from _STOP.split(part)


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def _held(text: str) -> list[tuple[int, int, str]]:
    """First and last sentence's number and identifier of the known sentences a text holds, in order."""
    plain = f" {normalised(text)} "
    spots: list[tuple[int, int, str]] = []  # first character, end, identifier
    for known, name in _IDS.items():
        at = plain.find(f" {known} ")
        while at >= 0:
            if not plain.endswith(" not", 0, at):
                spots.append((at, at + 1 + len(known), name))
            at = plain.find(f" {known} ", at + 1)
    titled = [known for known in TITLES if f" {known} " in plain]
    if not spots and not titled:
        return []
    starts, at, cut = [], 0, [x for s in sentences(text) if (x := normalised(s))]
    for x in cut:
        starts.append(at)
        at += len(x) + 1
    if titled:
        for pieces in (cut, [x for line in text.splitlines() for s in _STOP.split(line) if (x := normalised(s))]):
            at = 0
            for x in pieces:
                if x in TITLES:
                    spots.append((at, at + 1 + len(x), TITLES[x]))
                at += len(x) + 1
    out, end = [], 0
    for first, last, name in sorted(set(spots), key=lambda s: (s[0], -s[1])):
        if first >= end - 1 or not out:
            out.append((bisect_right(starts, first) - 1, bisect_right(starts, last - 2) - 1, name))
            end = last + 1
    return out


def recognised(text: str | None, gap: int = GAP) -> tuple[list[str], list[str]]:
    """The licences a text shows, in order of first sight, and the known sentences it holds."""
    if not text or not CUES.search(text):
        return [], []
    held = _held(text)
    found: list[tuple[int, int, str]] = []  # first, last sentence, licence
    for licence, names in RULES if held else ():
        for k, (_, _, name) in enumerate(held):
            if name != names[0]:
                continue
            last, j = k, k
            for want in names[1:]:
                j = next((x for x in range(last + 1, len(held)) if held[x][2] == want and held[x][0] - held[last][1] <= gap + 1), -1)
                if j < 0:
                    break
                last = j
            else:
                found.append((k, last, licence))
    kept: list[tuple[int, int, str]] = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
        if all(m[1] < o[0] or m[0] > o[1] for o in kept):
            kept.append(m)
    return list(dict.fromkeys(licence for _, _, licence in sorted(kept))), [name for _, _, name in held]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, licences, sentence_ids for every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            found = [recognised(t) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(a) for a, _ in found], pa.int64()), pa.array([a for a, _ in found], pa.list_(pa.string())), pa.array([b for _, b in found], pa.list_(pa.string()))], names=["doc_id", "n_licences", "licences", "sentence_ids"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_licences long, licences array<string>, sentence_ids array<string>")
