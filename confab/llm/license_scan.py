"""Licence scans: TF-IDF cosine of notices and whole texts to templates, then inheritance from the nearest directory above."""
from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_mapper, stored

#: Notices by which licences are told: identifier, then short notices in their usual words. Fixed values.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-1.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GFDL-1.2": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation",
    ),
    "GFDL-1.3": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    ),
    "MPL-1.1": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
}
#: Licences that are told by their full texts or identifiers only, and those whose identifiers say "-only" or "-or-later".
OTHERS = ("0BSD", "Artistic-1.0-Perl", "BSD-1-Clause", "BSD-4-Clause", "MIT-0", "NCSA", "PostgreSQL", "PSF-2.0", "WTFPL", "X11", "curl")
VERSIONED = ("AGPL", "GFDL", "GPL", "LGPL")


def identifiers(name: str) -> list[str]:
    """The lines by which files name their licence."""
    ends = ("-only", "-or-later") if name.startswith(VERSIONED) else ("",)
    return [f"SPDX-License-Identifier: {name}{end}" for end in ends]


TEMPLATES: dict[str, tuple[str, ...]] = {name: (*NOTICES.get(name, ()), *identifiers(name)) for name in (*NOTICES, *OTHERS)}
#: Names of files that hold the licence of their directory, whatever else is in them. Fixed values.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([-._][^/]*)?$"
#: A notice holds at least one of these words.
_SIGN = re.compile(r"licen[cs]|redistribution|permission|copyright|free software|public domain|warranty|\bcc0\b|\bcc[ -]by\b", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
#: Least cosine of a notice to a template, and share of a text's words in notices that makes it a licence file.
LEAST, FILE_SHARE = 0.6, 0.5
#: Least cosine of a whole text to a full licence text that makes it a licence file. A text with fewer than a half or
#: more than twice the words of a full text is not compared with it.
FULL_LEAST, FULL_LENGTH = 0.8, 2.0
#: Windows whose cosines a task remembers; notices recur.
CACHE = 1 << 15


def full_texts() -> dict[str, tuple[str, ...]]:
    """Full licence texts by identifier, from the folder beside this module. That of AGPL-3.0 is made from GPL-3.0,
    from which it differs by its name and one section."""
    texts = {p.stem: (p.read_text(encoding="utf-8"),) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    gpl = texts["GPL-3.0"][0]
    texts["AGPL-3.0"] = (gpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public"),)
    return texts


def _terms(text: str) -> list[str]:
    words = _TERM.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


class Matcher:
    """Sparse unit vectors of the templates, posted by term."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        texts = [(name, Counter(_terms(t))) for name, ts in templates.items() for t in ts]
        df = Counter(t for _, c in texts for t in c)
        self.names = [n for n, _ in texts]
        self.unknown = math.log(1 + len(texts)) + 1
        self.idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
        self.posted: dict[str, list[tuple[int, float]]] = {}
        for k, (_, c) in enumerate(texts):
            w = {t: (1 + math.log(n)) * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                self.posted.setdefault(t, []).append((k, x / norm))
        #: Numbers of words of the templates, and by sign word where it stands in a template of how many words.
        self.lengths = [len(_TERM.findall(t.lower())) for ts in templates.values() for t in ts]
        self.longest = max(self.lengths, default=0)
        self.anchors: dict[str, set[tuple[int, int]]] = {}
        for t in (t for ts in templates.values() for t in ts):
            starts, _ = _tokens(t)
            for m in _SIGN.finditer(t):
                self.anchors.setdefault(m.group().lower(), set()).add((bisect_right(starts, m.start()) - 1, len(starts)))

    def best(self, text: str) -> tuple[float, str]:
        """Largest cosine, to nine decimals, and its licence; of equals the first in the order of the templates."""
        c = Counter(_terms(text))
        if not c:
            return 0.0, ""
        w = {t: (1 + math.log(n)) * self.idf.get(t, self.unknown) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        dots: dict[int, float] = {}
        for t, x in w.items():
            for k, y in self.posted.get(t, ()):
                dots[k] = dots.get(k, 0.0) + x * y
        if not dots:
            return 0.0, ""
        k = min(dots, key=lambda j: (-round(dots[j], 12), j))
        return round(dots[k] / norm, 9), self.names[k]


def _tokens(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text start and end."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return [x for x, _ in spans], [y for _, y in spans]


def remembered(matcher: Matcher):
    """matcher.best with a bounded memory."""
    return functools.lru_cache(CACHE)(matcher.best)


def notices(text: str | None, matcher: Matcher, least: float = LEAST, best=None) -> list[tuple[float, str, int]]:
    """(cosine, licence, words) of the notices of a whole text, in order; no two share a word. Windows are lines with a
    sign word, each alone and joined with the lines after it up to a blank one or twice the words of the longest
    template, beyond which cosines only fall, and, wherever lines break, the words about a sign word that stand where a
    template with this word has its own. Of windows that overlap the better counts. Every template has sign words, so
    a text without any has no notice."""
    if not text or not _SIGN.search(text):
        return []
    best = best or matcher.best
    lines, at, found = text.split("\n"), 0, set()
    for i, line in enumerate(lines):
        if _SIGN.search(line):
            top = (0.0, "", 0, 0)
            end = at - 1
            joined, words_in = "", 0
            for j in range(i, len(lines)):
                if not lines[j].strip() or words_in > 2 * matcher.longest:
                    break
                words_in += len(lines[j].split())
                joined = f"{joined} {lines[j]}" if joined else lines[j]
                end += len(lines[j]) + 1
                score, name = best(joined)
                if score > top[0]:
                    top = (score, name, at, end)
            if top[0] >= least:
                found.add(top)
        at += len(line) + 1
    starts, ends = _tokens(text)
    words = [text[a:b].lower() for a, b in zip(starts, ends, strict=True)]
    for m in _SIGN.finditer(text):
        here = bisect_right(starts, m.start()) - 1
        for offset, length in matcher.anchors.get(m.group().lower(), ()) if here >= 0 else ():
            a, b = max(here - offset, 0), min(here - offset + length, len(words))
            score, name = best(" ".join(words[a:b]))
            if score >= least:
                found.add((score, name, starts[a], ends[b - 1]))
    # Windows taken so far, by start; none overlap, so a new one can only meet those beside its place.
    taken: list[tuple[int, int, float, str]] = []
    for score, name, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[3], f[2])):
        k = bisect_right(taken, (a, b, 2.0, ""))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b, score, name))
    return [(score, name, len(text[a:b].split())) for a, b, score, name in taken]


def whole(text: str | None, full: Matcher) -> tuple[float, str]:
    """Cosine and licence of a text that is one full licence text, else (0.0, "")."""
    if not text or not _SIGN.search(text):
        return 0.0, ""
    n = len(_TERM.findall(text.lower()))
    if not any(x / FULL_LENGTH <= n <= x * FULL_LENGTH for x in full.lengths):
        return 0.0, ""
    score, name = full.best(text)
    return (score, name) if score >= FULL_LEAST else (0.0, "")


def directory(path: Column) -> Column:
    """The path without its last part; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = LEAST) -> DataFrame:
    """(doc_id, path, own_licence, score, n_notices, licence, from_dir) for each row.

    own_licence: the licence whose full text the whole text is, else the best notice of it, null without one; score is
    that cosine. A full text, a text of which half the words or more are notices, or one with a notice in a file that is
    named like a licence file, is one and holds for its directory; of several in one directory the one with the higher
    score (then the smaller id) does. licence: the own one, else that of the nearest directory at or above the file's that
    has a licence file; from_dir: that directory, null for own ones. Only distinct directories and their ancestors are
    joined, so a directory with very many files costs one row there.

    Null or empty texts have no notice and inherit; a null path has no directory and inherits nothing; ids may be null
    or repeat. An empty table gives an empty result; other columns are not read.
    """
    source = files.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(path_col).cast("string").alias("path"))
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("own_licence", pa.string()), ("score", pa.float64()), ("n_notices", pa.int32()), ("is_file", pa.bool_())])

    known = files.sparkSession.sparkContext.broadcast((Matcher(), Matcher(full_texts())))

    def make():
        matcher, full = known.value
        best = remembered(matcher)

        def row(r):
            found = notices(r[1], matcher, least, best)
            score, name = whole(r[1], full)
            if name:
                return [(r[0], r[2], name, score, len(found), True)]
            if not found:
                return [(r[0], r[2], None, 0.0, 0, False)]
            score, name, _ = max(found, key=lambda x: x[0])
            share = sum(n for _, _, n in found) / max(len(r[1].split()), 1)
            return [(r[0], r[2], name, score, len(found), share >= FILE_SHARE)]

        return row

    own = source.mapInArrow(row_mapper(make, ("i", "t", "path"), schema), "doc_id long, path string, own_licence string, score double, n_notices int, is_file boolean")
    named = F.col("own_licence").isNotNull() & F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    own = stored(own.withColumn("is_file", F.col("is_file") | named).withColumn("dir", directory(F.col("path"))))
    rank = F.struct(F.negative("score").alias("s"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "own_licence")
    held = own.where("is_file AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(F.min(rank)["own_licence"].alias("dir_licence"))
    dirs = own.where("own_licence IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))))
    above = above.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = above.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", F.col("above").alias("from_dir"), "dir_licence")).alias("n"))
    near = near.select(F.col("dir").alias("n_dir"), "n.from_dir", "n.dir_licence")
    out = own.join(near, (F.col("dir") == F.col("n_dir")) & F.col("own_licence").isNull(), "left")
    return out.select("doc_id", "path", "own_licence", "score", "n_notices", F.coalesce("own_licence", "dir_licence").alias("licence"), "from_dir")
