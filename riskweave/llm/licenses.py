"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are licence texts, or the notices their authors ask for, with their titles; a text counts whole and by
paragraph. Terms are weighted by how rare they are over all files. A passage is a run of lines each of whose terms
could reach the least cosine: no cosine to any template exceeds the share of a line's length, as a vector, that lies in
the templates' terms. Lines up to GAP apart are one passage. The template of highest cosine over a file's passages, if
it reaches LEAST, is the file's own licence. A file whose base name is a licence file's, or that consists mostly of
licence passages (MOSTLY of its terms, and at least TERMS), speaks for its directory: a file without a licence of its
own takes that of the nearest directory above it that has one, found by joining each file's ancestor paths to the
licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Scratch, load

LEAST, GAP, MOSTLY, TERMS = 0.55, 3, 0.8, 20

#: Titles, and texts or notices, of licences; base names of licence files.
TITLES = {
    "MIT": "The MIT License",
    "ISC": "ISC License",
    "BSD-2-Clause": "BSD 2-Clause License, Simplified BSD License",
    "BSD-3-Clause": "BSD 3-Clause License, New BSD License",
    "Zlib": "zlib License",
    "Unlicense": "The Unlicense",
    "Apache-2.0": "Apache License, Version 2.0",
    "MPL-2.0": "Mozilla Public License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "CC0-1.0": "CC0 1.0 Universal, Public Domain Dedication",
    "CC-BY-4.0": "CC BY 4.0, Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "CC BY-NC 4.0, Creative Commons Attribution-NonCommercial 4.0 International",
    "proprietary": "Copyright. All rights reserved",
}
WARRANTY = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.""",
    "BSD-2-Clause": f"{CLAUSES}\n\n{WARRANTY}",
    "BSD-3-Clause": f"{CLAUSES}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{WARRANTY}",
    "Zlib": """This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.""",
    "CC-BY-4.0": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "CC-BY-SA-4.0": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
    "CC-BY-NC-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
    "proprietary": """This material is confidential and proprietary. No part of it may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the copyright owner.""",
}
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
TEXTS |= {name: GNU.format(kind=kind, version=version) for name, kind, version in (("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser ", 3), ("AGPL-3.0", "Affero ", 3))}
NAMES = ["license", "licence", "copying", "notice", "unlicense"]

TERM = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def templates(titles: dict[str, str] = TITLES, texts: dict[str, str] = TEXTS) -> list[tuple[str, Counter]]:
    """(licence, term counts) of each title, each whole text and each of its paragraphs."""
    pieces = [(k, piece) for k, title in titles.items() for piece in title.split(". ")]
    pieces += [(k, piece) for k, text in texts.items() for piece in dict.fromkeys([text, *text.split("\n\n")])]
    return [(k, Counter(terms(piece))) for k, piece in pieces]


TEMPLATES = templates()
VOCABULARY = sorted({t for _, c in TEMPLATES for t in c})


def _document_frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = set(VOCABULARY)
    for f in frames:
        counts: Counter = Counter()
        for t in f["text"]:
            counts.update(known & set(TERM.findall(" ".join(set((t or "").lower().split())))))
        if counts:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})


class Matcher:
    """Cosines of term counts to each template, under the weights of the templates' terms; other terms weigh as the rarest."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.unknown = max(weights.values(), default=1.0)
        self.sizes: list[tuple[str, float]] = []
        self.having: dict[str, list[tuple[int, float]]] = {}
        for k, c in TEMPLATES:
            v = {t: (1 + math.log(n)) * weights[t] for t, n in c.items()}
            for t, x in v.items():
                self.having.setdefault(t, []).append((len(self.sizes), x))
            self.sizes.append((k, math.sqrt(sum(x * x for x in v.values()))))

    def within(self, found: list[str]) -> bool:
        """Whether a cosine of LEAST is possible: the share of the vector that lies in the templates' terms."""
        known = [t for t in found if t in self.weights]
        if not known:
            return False
        own = self.vector(found)
        total = sum(x * x for x in own.values())
        return sum(own[t] ** 2 for t in set(known)) >= (LEAST**2 - 1e-9) * total

    def vector(self, found: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.weights.get(t, self.unknown) for t, n in Counter(found).items()}

    def best(self, found: list[str]) -> tuple[str | None, float]:
        """The licence of highest cosine; of equal ones the last by name."""
        own = self.vector(found)
        size = math.sqrt(sum(x * x for x in own.values()))
        dots: dict[int, float] = {}
        for t, x in own.items():
            for i, y in self.having.get(t, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        return max(((self.sizes[i][0], z / (self.sizes[i][1] * size)) for i, z in dots.items()), key=lambda x: (round(x[1], 12), x[0]), default=(None, 0.0))

    def passages(self, text: str) -> list[list[str]]:
        """The terms of each run of lines that could be of a licence, lines of up to GAP between them included."""
        out: list[list[str]] = []
        between: list[list[str]] = []
        for line in text.split("\n"):
            found = terms(line)
            if found and self.within(found):
                if out and len(between) < GAP:
                    out[-1] += [t for x in between for t in x] + found
                else:
                    out.append(found)
                between = []
            elif out:
                between = between[-GAP:] + [found]
        return out


def _scan(weights: dict[str, float], least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(weights)
        for f in frames:
            rows = []
            for key, path, text in zip(f["key"], f["path"], f["text"], strict=True):
                found = [(match.best(p), len(p)) for p in match.passages(text or "")]
                (name, score), _ = max(found, key=lambda x: x[0][1], default=((None, 0.0), 0))
                base = (path or "").rpartition("/")[2].lower().partition(".")[0]
                of = sum(n for (_, cosine), n in found if cosine >= least)
                mostly = of >= TERMS and of >= MOSTLY * len(terms(text))
                rows.append((key, path, name if score >= least else None, score, base in NAMES or mostly))
            yield pd.DataFrame(rows, columns=["key", "path", "own", "cosine", "speaks"]).astype({"key": "Int64"})

    return run


def scan(files: DataFrame, scratch: Scratch | None = None, least: float = LEAST) -> DataFrame:
    """``key long, path, own_license, cosine, license, from_path``: a row per row of files (key, path, text).

    license is the file's own, else that of the nearest ancestor directory with one (from_path is that directory;
    of several files that speak for one directory the first by path decides), else null. Null texts hold nothing;
    a null path has no directory; equal paths are told apart by key; an empty table gives no rows.
    """
    scratch = scratch or Scratch(files.sparkSession, "licenses")
    src = files.select(F.col("key").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    n = src.count()
    frequencies = {r[0]: r[1] for r in src.select("text").mapInPandas(_document_frequencies, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    weights = {t: math.log((1 + n) / (1 + frequencies.get(t, 0))) + 1 for t in VOCABULARY}
    found = scratch.keep(src.mapInPandas(_scan(weights, least), "key long, path string, own string, cosine double, speaks boolean"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    speaking = found.where("speaks and own is not null and path is not null").groupBy(folder.alias("dir")).agg(F.min(F.struct("path", "own"))["own"].alias("dir_license"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    without = found.where("own is null and path is not null").select("key", "path", F.explode(F.array_union(F.array(F.lit("")), above)).alias("dir"))
    nearest = without.join(speaking, "dir").groupBy("key", "path").agg(F.max(F.struct(F.length("dir"), "dir", "dir_license")).alias("x"))
    joined = found.alias("a").join(nearest.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.path") == F.col("b.path")) & F.col("a.own").isNull(), "left")
    return joined.select("a.key", "a.path", F.col("a.own").alias("own_license"), "a.cosine", F.coalesce("a.own", "b.x.dir_license").alias("license"), F.col("b.x.dir").alias("from_path"))


def tree_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """Where a document lies in a tree of source, language and two levels of id ranges.

    One id in eight is a licence file, in the lower directory or (one in 32) the upper one; the others are texts in the
    lower one. A null id has a null path.
    """
    top = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.coalesce(lang, F.lit("unknown")), F.floor(doc_id / 1024).cast("string"))
    low = F.concat_ws("/", top, F.floor(F.pmod(doc_id, F.lit(1024)) / 128).cast("string"))
    named = F.concat(F.lit("LICENSE."), doc_id.cast("string"))
    text = F.concat(doc_id.cast("string"), F.lit(".txt"))
    where = F.when(doc_id % 32 == 0, top).otherwise(low)
    return F.concat(where, F.lit("/"), F.when(doc_id % 8 == 0, named).otherwise(text))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as files of the tree of tree_path."""
    docs = load(spark, sf_dir, "documents")
    path = tree_path(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"))
    out = scan(docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text"))
    return out.withColumnRenamed("key", "doc_id")
