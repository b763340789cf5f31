"""Licence scans: sparse TF-IDF cosine against templates, then inheritance from the nearest ancestor directory.

Every unit of a text (each line, each paragraph and the text as a whole) is a sparse TF-IDF vector over words; the idf is that
of the templates, words no template has weigh as much as the rarest.  There are two sets of templates: short notices, to which
all units are compared, and the full licence texts in ``licence_texts``, to which paragraphs and whole texts are.  A line or
paragraph at or above HEADER (FULL for full texts) is a header of its file; a text that is at or above WHOLE (FULL) as a whole
is a licence file.  A text's own licence is that of the whole text before that of a header, and 'All rights reserved' counts
only where nothing else is found.  A file without header takes the licence of the nearest ancestor directory that has a
licence file: ancestors are path prefixes, joined by equality, and the longest wins.

Defined cases: null or empty text has no licence of its own; ties go to the template that comes first by name, between
licence files of one directory to the higher score, then to the smaller path; rows with equal paths are kept apart and get
equal values; a null path has no directory; a file at the top level has the root directory ""; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean

HEADER = 0.6
WHOLE = 0.6
FULL = 0.7

NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_KINDS = [
    ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
]

# (SPDX id, text): short notices as they stand in headers, and the sentences that open the licence texts
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    *[(i, GNU.format(n, v)) for i, n, v in GNU_KINDS if i != "GPL-3.0"],
    *[(i, GNU.format(n, v) + " " + NO_WARRANTY.format(n)) for i, n, v in GNU_KINDS],
]


WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def full_texts() -> list[tuple[str, str]]:
    """(SPDX id, text) of the licence texts: a fixed number of files of this package."""
    found = [f for f in resources.files("gneiss.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(found, key=lambda f: f.name)]


class Templates:
    """Unit TF-IDF vectors of a few templates, and the best cosine of a unit to one of them."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        templates, self.least = sorted(templates), least
        counts = [Counter(words(text)) for _, text in templates]
        df = Counter(w for c in counts for w in c)
        self.names, self.at = [name for name, _ in templates], {w: i for i, w in enumerate(sorted(df))}
        self.rare = float(np.log(1.0 + len(templates)) + 1)
        self.idf = np.array([np.log((1.0 + len(templates)) / (df[w] + 1)) + 1 for w in self.at])
        self.weight = np.zeros((len(self.at), len(templates)))
        for t, c in enumerate(counts):
            for w, n in c.items():
                self.weight[self.at[w], t] = (np.log(n) + 1) * self.idf[self.at[w]]
        self.weight /= np.linalg.norm(self.weight, axis=0)
        self.square = self.weight**2
        # a unit without any of a template's heavy words, where the others have a norm below least, can't reach least
        self.heavy = set()
        vocabulary = list(self.at)
        for w in self.square.T:
            order = np.argsort(w, kind="stable")
            self.heavy |= {vocabulary[i] for i in order[np.cumsum(w[order]) >= (self.least - 1e-6) ** 2]}

    def possible(self, found: set[str]) -> bool:
        """False only where no unit of these words reaches least: a cosine is at most the norm of the shared words' weights."""
        if self.heavy.isdisjoint(found):
            return False
        return self.square[[self.at[w] for w in found & self.at.keys()]].sum(0).max() >= (self.least - 1e-6) ** 2

    def best(self, found: Counter) -> tuple[float, str] | None:
        """(score, licence) of the best template at or above least, for the word counts of a unit."""
        known = [w for w in found if w in self.at]
        if not known:
            return None
        at = [self.at[w] for w in known]
        w = (np.log([found[x] for x in known]) + 1) * self.idf[at]
        other = np.log([n for x, n in found.items() if x not in self.at] or [1.0]) + 1 if len(known) < len(found) else np.zeros(1)
        cos = np.round(w @ self.weight[at] / np.sqrt((w * w).sum() + (other * other).sum() * self.rare**2), 6)
        t = int(np.argmax(cos))
        return (float(cos[t]), self.names[t]) if cos[t] >= self.least else None


def own_licence(text: str, notices: Templates, full: Templates) -> tuple[bool, float, int, str, bool] | None:
    """(not proprietary, score, -unit, licence, whole) of the unit that gives the text its licence; see the module."""
    all_words = words(text)
    vocabulary = set(all_words)
    sets = [t for t in (notices, full) if t.possible(vocabulary)]
    if not sets:
        return None
    lines = text.split("\n")
    paragraphs = [p for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text) if "\n" in p]
    found = []
    for unit, part in enumerate([*lines, *paragraphs, text]):
        whole = unit == len(lines) + len(paragraphs)
        here = [t for t in sets if t is notices or unit >= len(lines)]
        have = all_words if whole else words(part) if here else []
        here = [t for t in here if t.possible(set(have))]
        counts = Counter(have) if here else None
        for templates in here:
            if b := templates.best(counts):
                found.append((b[1] != "proprietary", whole, b[0], -unit, b[1]))
    if not found:
        return None
    named, _, score, unit, licence = max(found)
    return named, score, unit, licence, any(x[1] for x in found)


# words of which each unit that a notice is found in has one; derived, so no template is left out
NAMES_A_LICENCE = rf"(?i)\b(?:{'|'.join(sorted(Templates(TEMPLATES, HEADER).heavy))})\b"


def scores(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """rid, named, score, unit, licence, whole of the texts that have a licence of their own."""
    notices, full = Templates(templates, HEADER), Templates(full_texts(), FULL)
    shared = files.sparkSession.sparkContext.broadcast((notices, full))
    columns = ["named", "score", "unit", "licence", "whole"]
    kinds = [pa.bool_(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]

    def look(batches):
        notices, full = shared.value
        for b in batches:
            got = [own_licence(t.as_py() or "", notices, full) for t in b.column(1)]
            mine = [i for i, g in enumerate(got) if g]
            cols = list(zip(*[got[i] for i in mine], strict=True)) or [()] * len(kinds)
            arrays = [b.column(0).take(pa.array(mine, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", *columns])

    schema = f"rid {files.schema['rid'].dataType.simpleString()}, named boolean, score double, unit long, licence string, whole boolean"
    return files.select("rid", "text").mapInArrow(lean(look), schema)


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """files(rid, path, text) -> rid, path, licence, how (file, header, inherited, none), score, from_path."""
    spark = files.sparkSession
    scratch = Scratch(spark, "licences")
    found = scratch.save(scores(files, templates), "scores")
    top = F.max(F.struct("named", "whole", "score", "unit", "licence"))
    own = found.groupBy("rid").agg(top.alias("b"), F.bool_or("whole").alias("file")).select("rid", "b.licence", "b.score", "file")
    paths = files.select("rid", "path")
    known = scratch.save(paths.join(own, "rid", "left"), "known")
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    of_dir = known.where("file").select(directory.alias("dir"), "licence", "score", "path").where("dir is not null")
    of_dir = of_dir.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("l"))
    of_dir = scratch.save(of_dir.select("dir", "l.licence", (-F.col("l.s")).alias("score"), F.col("l.path").alias("from_path")), "directories")
    parts = F.split(directory, "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    bare = known.where("licence is null and path is not null").select("rid", F.explode(F.array_distinct(ancestors)).alias("dir"))
    near = bare.join(of_dir, "dir").groupBy("rid").agg(F.max(F.struct(F.length("dir").alias("n"), "licence", "score", "from_path")).alias("i"))
    near = scratch.save(near.select("rid", F.struct("i.licence", "i.score", "i.from_path").alias("i")), "inherited")
    how = F.when(F.col("file"), "file").when(F.col("licence").isNotNull(), "header").when(F.col("i").isNotNull(), "inherited").otherwise("none")
    return known.join(near, "rid", "left").select(
        "rid", "path", F.coalesce("licence", "i.licence").alias("licence"), how.alias("how"), F.coalesce("score", "i.score").alias("score"),
        F.when(F.col("licence").isNull(), F.col("i.from_path")).alias("from_path"))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """documents as a tree source/lang/doc_id."""
    part = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("none")), "/", "_")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("rid"), F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    return scan(files).withColumnRenamed("rid", "doc_id")
