"""License scans: texts compared with licence templates by word bigrams.

A text's units are its lines, its paragraphs and the whole of it.  A unit is
normalised (lower case, anything but 0-9 and a-z parts words) and compared with
the templates by the Dice coefficient of their sets of word bigrams.  A score of
``least`` bounds how many bigrams a match can have, so only templates whose size
fits are looked at, and of those only the ones that share a bigram.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 0.8
#: What names no licence.
RESERVED = "all-rights-reserved"
#: What rounding may take off a size bound.
SLACK = 1e-9

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public
License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: Licence notices as they are commonly written, and the heads of whole licence texts, by licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    (RESERVED, "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("artistic-1.0", "The Artistic License"),
    ("bsd", "Licensed under the BSD License."),
    ("bsd", _BSD),
    ("bsd", _BSD_CLAUSES),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("gfdl-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("gfdl-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("gfdl-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("gpl-1.0", _GPL.format(1)),
    ("gpl-1.0", "GNU General Public License Version 1, February 1989"),
    ("gpl-2.0", "GNU General Public License Version 2, June 1991"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", _GPL.format(2)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _GPL.format(3)),
    ("gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("isc", _ISC),
    ("lgpl-2.0", _LGPL.format("Library", "2")),
    ("lgpl-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("lgpl-2.1", _LGPL.format("Lesser", "2.1")),
    ("lgpl-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("lgpl-3.0", _LGPL.format("Lesser", "3")),
    ("lgpl-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _MIT),
    ("mpl-1.1", "Mozilla Public License Version 1.1"),
    ("mpl-2.0", _MPL),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("unlicense", _UNLICENSE),
)

_WORD = re.compile(r"[0-9a-z]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(text: str) -> set[tuple[str, str]]:
    """The set of neighbouring words of normalised text."""
    words = _WORD.findall(text.translate(_UPPER))
    return set(zip(words, words[1:], strict=False))


class Matcher:
    """Templates by size and by bigram."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> None:
        sets = sorted(((len(g), name, g) for name, t in templates for g in [bigrams(t)] if g), key=lambda x: x[:2])
        self.sizes, self.names, self.least = [s[0] for s in sets], [s[1] for s in sets], least
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, grams) in enumerate(sets):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
        self.most = int(self.sizes[-1] * (2 - least) / least + SLACK) if sets else 0
        self.fewest = self.sizes[0] * least / (2 - least) - SLACK if sets else 1

    def unit(self, text: str) -> list[tuple[float, str]]:
        """Score and licence of every template that the unit matches."""
        if text.count(" ") + text.count("\t") + 1 < self.fewest:  # a bigram needs two words; signs part words as well
            if not _WORD.search(text) or len(_WORD.findall(text.translate(_UPPER))) <= self.fewest:
                return []
        grams = bigrams(text)
        n = len(grams)
        if not self.fewest <= n <= self.most:
            return []
        first, last = bisect_left(self.sizes, n * self.least / (2 - self.least) - SLACK), bisect_right(self.sizes, n * (2 - self.least) / self.least + SLACK)
        shared: dict[int, int] = {}
        for g in grams:
            for k in self.holders.get(g, ()):
                if first <= k < last:
                    shared[k] = shared.get(k, 0) + 1
        return [(2 * c / (n + self.sizes[k]), self.names[k]) for k, c in shared.items() if 2 * c / (n + self.sizes[k]) >= self.least]

    def text(self, text: str | None) -> list[tuple[str, float]]:
        """The best score of each licence that some unit of the text matches no worse than any other.

        So of notices that differ by a version only the nearest one counts.
        """
        best: dict[str, float] = {}
        lines = (text or "").split("\n")
        units, part = list(lines), []
        for line in [*lines, ""]:
            if line.strip(" \t\r"):
                part.append(line)
            elif part:
                if len(part) > 1:
                    units.append("\n".join(part))
                part = []
        if len(lines) > 1:
            units.append(text)
        for u in units:
            met = self.unit(u)
            nearest = max((score for score, _ in met), default=0.0)
            for score, name in met:
                if score == nearest:
                    best[name] = max(score, best.get(name, 0.0))
        return sorted(best.items())


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType())]))


def scan(text: Column, *, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> Column:
    """``license, score`` of every licence that a unit of ``text`` matches, by name.

    Null and empty texts match none; a template without two words is never matched.
    """
    held = tuple(templates)

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(held, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            yield pa.array([[{"license": n, "score": s} for n, s in matcher.text(t.as_py())] for t in batch], kind)

    return found(text)


def license_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, score, licenses, n_licenses``: the best licence (ties: by name) and all of them.

    A reserved right is only the best if no licence is named.  Null and empty texts
    match none and score 0; repeated rows are each scanned; no rows give no rows.
    Columns of other names aren't read.
    """
    rows = docs.select(doc_id, scan(F.col(text)).alias("found"))
    ranked = F.transform("found", lambda x: F.struct((x["license"] == RESERVED).alias("reserved"), (-x["score"]).alias("minus"), x["license"].alias("license"), x["score"].alias("score")))
    best = F.array_min(ranked)
    return rows.select(doc_id, best["license"].alias("license"), F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.array_join("found.license", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH tpl AS (
  SELECT name, {grams} AS g FROM (SELECT name, regexp_extract_all({low.format("t")}, '[0-9a-z]+') AS w FROM (VALUES {values}) v(name, t))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), u AS (
  SELECT r, row_number() OVER () AS k, t FROM (SELECT r, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n([ \t\r]*\n)+')), [text])) AS t FROM d)
), g AS (
  SELECT r, k, {grams} AS g FROM (SELECT r, k, regexp_extract_all({low.format("t")}, '[0-9a-z]+') AS w FROM u) WHERE len(w) > 1
), x AS (
  SELECT r, k, name, 2 * len(list_intersect(g.g, tpl.g)) / (len(g.g) + len(tpl.g))::DOUBLE AS score
  FROM g JOIN tpl ON len(g.g) * 0.6 <= len(tpl.g) AND len(tpl.g) * 0.6 <= len(g.g) WHERE score >= {LEAST} QUALIFY score = max(score) OVER (PARTITION BY k)
), m AS (
  SELECT r, name, max(score) AS score FROM x GROUP BY r, name
), b AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, arg_min((name, score), (name = '{RESERVED}', -score, name)) AS best FROM m GROUP BY r
)
SELECT doc_id, best[1] AS license, coalesce(best[2], 0.0::DOUBLE) AS score, coalesce(names, '') AS licenses, coalesce(n, 0)::BIGINT AS n_licenses FROM d LEFT JOIN b USING (r)
"""


SQL = _sql()
