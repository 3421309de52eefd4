"""License scans: sparse TF-IDF cosine of texts to notice templates, and inheritance from the nearest directory above.

Terms are those of the templates; their document frequencies are counted over all texts. Compared are lines, headers (blocks of
consecutive lines between those without a term, whatever the comment marks), whole licence files, and for each template every run
of as many terms as it has, over all the text regardless of lines: a notice is found wrapped over lines, and within a paragraph.
A vector is compared with every template that can reach the threshold: one of the template's heaviest terms must occur (without
all of them the cosine is below it, so nothing is lost). Files without a notice take that of the licence file in the nearest directory above, by a join of paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import read_table, small, through_table

#: Notices and heads of licence texts as they are commonly written, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A licence whose text holds all of another's, and the other.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Names that a tag may give, beside those of the templates and LicenseRef- names.
TAGS = frozenset("""
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Artistic-2.0 BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-ND-4.0
CC-BY-SA-3.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-1.1
MS-PL MS-RL NCSA OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split())
THRESHOLD = 0.85
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"

_TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Templates weighted by inverse document frequencies."""

    def __init__(self, n: int, frequency: dict[str, int], threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.threshold = threshold
        self.tags = TAGS | {name for name, _ in templates}
        vocabulary = sorted({t for _, text in templates for t in terms(text)})
        self.idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
        self.vectors = [(name, self.vector(terms(text))) for name, text in templates]
        self.lengths = [len(terms(text)) for _, text in templates]
        #: Positions of templates by heavy term.
        self.heavy: dict[str, list[int]] = {}
        for k, (_, v) in enumerate(self.vectors):
            rest = 1.0
            for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
                if rest < threshold**2:
                    break
                self.heavy.setdefault(t, []).append(k)
                rest -= w * w

    def vector(self, words: list[str]) -> dict[str, float]:
        counts = Counter(t for t in words if t in self.idf)
        weighted = {t: (1 + math.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weighted.values()))
        return {t: w / norm for t, w in weighted.items()} if norm else {}

    def best(self, text: str, whole: bool = False) -> tuple[str | None, float]:
        """License and score of the best line, header or run of terms, and of the text if `whole`; the first known name of an SPDX tag
        counts as 1. Of two licences found of which one holds the other's text it is the one, if either is best."""
        for tag in _TAG.finditer(text) if "SPDX" in text else ():
            for name in re.findall(r"[A-Za-z0-9.+-]+", tag[1]):
                if name in self.tags or name.startswith("LicenseRef-"):
                    return name, 1.0
        everything = terms(text)
        if self.heavy.keys().isdisjoint(everything):
            return None, 0.0
        found: dict[str, float] = {}

        def compare(words: list[str], templates) -> None:
            v = self.vector(words)
            for name, template in templates:
                score = sum(w * template[t] for t, w in v.items() if t in template)
                if score >= self.threshold:
                    found[name] = max(score, found.get(name, 0.0))

        header: list[str] = []
        lines = 0
        for line in [*text.split("\n"), ""]:
            words = terms(line)
            if words:
                header += words
                lines += 1
                if not self.heavy.keys().isdisjoint(words):
                    compare(words, self.vectors)
                continue
            if lines > 1 and not self.heavy.keys().isdisjoint(header):
                compare(header, self.vectors)
            header, lines = [], 0
        if whole:
            compare(everything, self.vectors)
        for k, start in self.runs(everything):
            compare(everything[start : start + self.lengths[k]], self.vectors[k : k + 1])
        if not found:
            return None, 0.0
        score, name = max((x, n) for n, x in found.items())
        more = next((a for a, b in HOLDS.items() if b == name and a in found), name)
        return more, round(score, 6)

    def runs(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(template, start) of the runs of the template's length that reach the threshold, about. Only runs with a heavy term of
        it are looked at; from one to the next, counts change by the term that leaves and the one that comes."""
        near: dict[int, list[int]] = {}
        for p, t in enumerate(words):
            for k in self.heavy.get(t, ()):
                near.setdefault(k, []).append(p)
        for k, places in near.items():
            size, template = self.lengths[k], self.vectors[k][1]
            most = max(len(words) - size, 0)
            at = 0
            while at < len(places):
                first, last = max(places[at] - size + 1, 0), places[at]
                at += 1
                while at < len(places) and places[at] - size + 1 <= last + 1:
                    last = places[at]
                    at += 1
                counts: Counter[str] = Counter()
                dot = square = 0.0
                first, last = min(first, most), min(last, most)
                for p in range(first, last + size):
                    for t, step in ((words[p] if p < len(words) else "", 1), (words[p - size] if p - size >= first else "", -1)):
                        if (idf := self.idf.get(t)) is None:
                            continue
                        c = counts[t]
                        counts[t] = c + step
                        old, new = (1 + math.log(x) if x else 0.0 for x in (c, c + step))
                        dot += (new - old) * idf * template.get(t, 0.0)
                        square += (new * new - old * old) * idf * idf
                    if p - first >= size - 1 and square > 0 and dot > 0 and dot * dot >= (self.threshold**2 - 1e-6) * square:
                        yield k, p - size + 1


def frequencies(files: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Texts, and texts with each template term: one count per term and task comes back, and one per term to the driver."""
    vocabulary = {t for _, text in templates for t in terms(text)}

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for cell in batch.column(0):
                counts[""] += 1
                counts.update(vocabulary.intersection(terms(cell.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    rows = files.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return found.pop("", 0), found


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, license, score, and the columns in keep): the best notice in each text, null where none reaches the threshold. Licence
    files are also compared as a whole. Written to the shared folder: the texts are read once for frequencies, and once here.

    Null and empty texts have none; equal scores go to the later name. Repeated rows and null paths give a row each; other
    columns are not read. Names in keep must not be path, license or score.
    """
    if clash := {"path", "license", "score"}.intersection(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    n, found = frequencies(files, text_col, templates)
    kept = files.select(*keep).schema.fields

    def run(batches):
        matcher = Matcher(n, found, threshold, templates)
        for batch in small(batches):
            cells = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            got = [matcher.best(cell.as_py() or "", re.search(LICENCE_FILE, (path or "").rpartition("/")[2]) is not None) for path, cell in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *batch.columns[2:]], names=["path", "license", "score", *keep])

    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), *keep)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), *kept])
    return through_table(rows.mapInArrow(run, schema), "license-scan")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds effective_license and inherited_from (the directory, where the notice is not the file's own) to rows of scan(), which
    are read three times: scan() has written them.

    A licence file speaks for its directory; of several in one directory the best score does, then the first path. Paths are
    cut at slashes; the root is the empty directory. Null paths inherit nothing. Other columns stay.
    """
    parts = F.split("path", "/")
    named = scanned.withColumns({"_directory": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), "_name": F.element_at(parts, -1)})
    files = named.where(F.col("license").isNotNull() & F.col("_name").rlike(LICENCE_FILE))
    first = Window.partitionBy("_directory").orderBy(F.col("score").desc(), "path", "license")
    holders = files.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("_directory").alias("_holder"), F.col("license").alias("_held"))
    # each directory once, joined with all that lie above it
    below = named.where("path IS NOT NULL").select("_directory").distinct().withColumn("_steps", F.split("_directory", "/"))
    depth = F.when(F.col("_directory") == "", 0).otherwise(F.size("_steps"))
    above = below.select("_directory", F.explode(F.sequence(F.lit(0), depth)).alias("_d"), "_steps").select("_directory", "_d", F.array_join(F.slice("_steps", F.lit(1), F.col("_d")), "/").alias("_holder"))
    nearest = above.join(holders, "_holder").groupBy("_directory").agg(F.max_by(F.struct("_holder", "_held"), "_d").alias("_near"))
    nearest = nearest.select(F.col("_directory").alias("_under"), "_near.*")
    joined = named.join(nearest, F.col("_directory") == F.col("_under"), "left")
    return joined.select(
        *scanned.columns,
        F.coalesce("license", "_held").alias("effective_license"),
        F.when(F.col("license").isNull(), F.col("_holder")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(path, text, doc_id): documents have no paths, so one follows from the columns: source / thousand / hundred / file; the first
    file of a hundred is its directory's licence file. Null ids are in files of that name."""
    d = F.col("doc_id").cast("long")
    thousand, hundred = (F.coalesce(F.floor(d / k).cast("string"), F.lit("none")) for k in (1000, 100))
    name = F.concat(F.when(d % 100 == 0, F.lit("LICENSE-")).otherwise(F.lit("file-")), F.coalesce(d.cast("string"), F.lit("none")))
    return docs.select(F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("none")), thousand, hundred, name).alias("path"), "text", d.alias("doc_id"))


def contract(spark, sf_dir: str) -> DataFrame:
    return inherit(scan(document_paths(read_table(spark, sf_dir, "documents")), keep=("doc_id",)))
