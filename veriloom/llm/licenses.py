"""License scan: headers and licence files against templates, then inheritance.

Each line of a text, each run of consecutive lines that may hold a wrapped notice,
and the whole text is a sparse TF-IDF vector; its cosines with the templates find
the licence it states.  The whole text is also compared with full licence texts.
Document frequencies of the templates' words are counted over all documents.  Texts
and runs are passed over only if they can't match: the squared weights of the
template's words that occur are an upper bound of the squared cosine.  Lines without
words, such as bare comment signs, are no lines.

A file whose whole text matches, or which has the name of a licence file, states
the licence of its directory; a file without a header of its own inherits from the
nearest directory above it, found by joins of path prefixes.

Relative and absolute paths have roots of their own.

Results in the odd cases: null text counts as empty; a null path is a file
without a directory, which inherits nothing; ties go to the higher score, then to
the licence first in the alphabet; rows that repeat a path are files of their
own; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import releasing, split_hot, written

# Notices by which licences are stated.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0)."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
NAMES = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
ALIKE = 0.75
WORD = re.compile(r"[a-z0-9]+")
#: Full texts, which a licence file is compared with.
FULL = {name: (pkgutil.get_data(__name__, f"notices/{name}.txt") or b"").decode() for name in ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0")}
VOCABULARY = sorted({w for texts in TEMPLATES.values() for t in texts for w in WORD.findall(t.lower())} | {w for t in FULL.values() for w in WORD.findall(t.lower())})
#: Twice the words of the longest notice: runs of lines whose inner lines have more are not compared.
LONGEST = 2 * max(len(WORD.findall(t)) for texts in TEMPLATES.values() for t in texts)


def _present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, vocabulary = Counter(), set(VOCABULARY)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            df.update(vocabulary.intersection(WORD.findall((text or "").lower())))
            df[""] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "df"])


class Matcher:
    def __init__(self, df: dict[str, int], alike: float) -> None:
        n = df.get("", 0)
        self.alike, self.rare = alike, math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        self.templates = [(name, self.vector(WORD.findall(t.lower()))) for name, texts in sorted(TEMPLATES.items()) for t in texts]
        self.full = [(name, self.vector(WORD.findall(t.lower()))) for name, t in sorted(FULL.items())]
        self.least = (alike - 1e-9) ** 2

    def vector(self, words: list[str]) -> dict[str, float]:
        out = {w: (1 + math.log(k)) * self.idf.get(w, self.rare) for w, k in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in out.values())) or 1.0
        return {w: x / norm for w, x in out.items()}

    def best(self, words: list[str], templates: list | None = None) -> tuple[str | None, float]:
        if not words:
            return None, 0.0
        own = self.vector(words)
        score, name = max(((sum(x * own[w] for w, x in t.items() if w in own), name) for name, t in templates or self.templates), key=lambda s: s[0])
        return (name, min(1.0, score)) if score >= self.alike else (None, 0.0)

    def reach(self, templates: list, present: set[str]) -> list:
        """The templates that words ``present`` may match."""
        return [(name, t) for name, t in templates if sum(t[w] * t[w] for w in present.intersection(t)) >= self.least]

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """The licence stated, its score, and if the whole text states it."""
        words = WORD.findall(text.lower())
        present = set(words)
        notices, full = self.reach(self.templates, present), self.reach(self.full, present)
        if not notices and not full:
            return None, 0.0, False
        whole = self.best(words, notices + full)
        name, score = whole
        lines = [x for line in text.lower().split("\n") if (x := WORD.findall(line))] if notices else []
        for licence, template in notices:
            for found, at in self.runs(lines, licence, template):
                if at > score or at == score and name is not None and found < name:
                    name, score = found, at
        return name, score, whole[0] is not None

    def runs(self, lines: list[list[str]], licence: str, template: dict[str, float]) -> Iterator[tuple[str, float]]:
        """Matches of one template with runs of lines; a best run begins and ends with a line that has a word of it."""
        own = [template.keys() & line for line in lines]
        for first in range(len(lines)):
            if not own[first]:
                continue
            present, mass, inner, words = set(), 0.0, 0, []
            for last in range(first, len(lines)):
                if inner > LONGEST:
                    break
                if last > first:
                    inner += len(lines[last])
                words += lines[last]
                mass += sum(template[w] ** 2 for w in own[last] - present)
                present |= own[last]
                if own[last] and mass >= self.least:
                    found, at = self.best(words, [(licence, template)])
                    if found is not None:
                        yield found, at


def _scanned(df: dict[str, int], alike: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(df, alike)
        for batch in batches:
            found = [own.scan(x or "") for x in batch.column("text").to_pylist()]
            name, score, whole = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], names=["doc_id", "path", "license", "score", "whole"])

    return run


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """doc_id, path, license, score, origin (header, file, inherited, none), inherited_from."""
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # as many rows as the templates have words
    df = {r["word"]: r["df"] for r in rows.select("text").mapInArrow(_present, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    found = written(rows.mapInArrow(releasing(_scanned(df, alike)), "doc_id long, path string, license string, score double, whole boolean"), "licenses")
    # a relative root is "", the absolute one "/"
    found = found.withColumn("dir", F.when(F.col("path").rlike("^/[^/]*$"), "/").otherwise(F.coalesce(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit(""))))
    licence_file = F.col("license").isNotNull() & (F.col("whole") | F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAMES))
    stated = found.where(licence_file & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    stated = stated.select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"), (-F.col("best.score")).alias("dir_score"))
    dirs = found.where(F.col("path").isNotNull()).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    names, absolute = F.split("dir", "/"), F.col("dir").startswith("/")
    depths = F.sequence(absolute.cast("int"), F.when(F.col("dir") == "", 0).when(F.col("dir") == "/", 1).otherwise(F.size(names)))
    prefix = F.when(absolute & (F.col("depth") == 1), "/").otherwise(F.array_join(F.slice(names, 1, F.col("depth")), "/"))
    ups = dirs.withColumn("depth", F.explode(depths)).withColumn("above", prefix)
    nearest = ups.join(stated, "above").groupBy("dir", "files").agg(F.max_by(F.struct("above", "dir_license", "dir_score"), "depth").alias("up"))
    per = written(nearest.select("dir", "files", "up.*"), "directories")
    met = split_hot(found, ["dir"], per, "files", found.count())
    has, inherits = F.col("license").isNotNull(), F.col("path").isNotNull() & F.col("dir_license").isNotNull()
    return met.select(
        "doc_id",
        "path",
        F.when(has, F.col("license")).when(inherits, F.col("dir_license")).alias("license"),
        F.when(has, F.col("score")).when(inherits, F.col("dir_score")).otherwise(0.0).alias("score"),
        F.when(has & F.col("whole"), "file").when(has, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(~has & inherits, F.col("above")).alias("inherited_from"),
    )
