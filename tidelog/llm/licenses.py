"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor.

Words are runs of letters and digits, lower-cased. The weight of a word is its count
times ln((1 + files) / (1 + files with the word)) + 1, over all files; words that no
template has weigh as if one file had them. Compared are

- in every file, each line and each paragraph (lines up to one without a word),
- in licence files (``LICENSE``, ``COPYING``, ...), the whole text too.

An index of the templates' words gives, for all lines and paragraphs of a batch at once,
the share of their weight that lies on words of templates. The cosine can't be larger than
the root of that share, so that only those which can reach ``MIN_COSINE`` are compared.

The best template counts from a cosine of ``MIN_COSINE`` on; score is its cosine, else 0. Reserved rights are a result
of their own, which inherits nothing; beside a licence that counts they are its usual
opening, and the licence holds. A licence file gives its
directory its licence; a file without a licence of its own takes that of the nearest
directory above it, found by joining the distinct directories' ancestors with the
directories that have one.

Scale: the passes over texts (one for the counts, one for the licences, and one for
those of licence files alone) are narrow and give a few numbers per file, in a time in
proportion to the text; word counts are added up map-side; the joins are on distinct directories, and the last one, of
files with their directory, is left to Spark to broadcast or to split where a directory
holds very many files.

Defined cases: null and empty texts have no licence of their own and inherit; a null
path is a file outside all directories, and no licence file; of several licence files
of a directory the best cosine counts, then the smaller path; of templates that tie the
smaller name; repeated rows get the same result each; an empty table gives no rows;
other columns pass through, whatever their names, those that ``scan`` sets are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut, free_names, map_in_arrow, share, table
from tidelog.llm.textkit import ALNUM, Words, slices, word_hash

MIN_COSINE = 0.75
LICENCE_FILE = r"(^|/)(?i:licen[cs]e|copying|unlicense|notice)([.\-][^/]*)?$"
RESERVED = "LicenseRef-All-Rights-Reserved"

# Licence notices by SPDX name, and whole licences where these are short.
_GRANT_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = [
    ("BSD-2-Clause", f"{_GRANT_BSD} {_DISCLAIMER_BSD}"),
    ("BSD-3-Clause", f"{_GRANT_BSD} {_NAMES_BSD} {_DISCLAIMER_BSD}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (RESERVED, "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text: str) -> list[bytes]:
    w = Words(pa.array([text]), ALNUM)
    return [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]


def rank(score: float, name: str) -> tuple[bool, float, str]:
    """Least first: licences that count, then reserved rights and what does not count, by cosine."""
    return (name == RESERVED or score < MIN_COSINE, -score, name)


class Templates:
    """Unit vectors of the templates over their words, with the weights of all files."""

    def __init__(self, files: int, with_word: dict[bytes, int], templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        bags = [Counter(_words(t)) for _, t in templates]
        vocabulary = sorted(set().union(*bags))
        idf = lambda df: math.log((1 + files) / (1 + df)) + 1
        self.idf = {w: idf(with_word.get(w, 0)) for w in vocabulary}
        self.other = idf(min(1, files))
        self.vectors = []
        for bag in bags:
            v = {w: n * self.idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({w: x / norm for w, x in v.items()})

    def best(self, bag: Counter) -> tuple[float, str]:
        own = {w: n * self.idf.get(w, self.other) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        if not norm:
            return 0.0, ""
        scores = [(round(sum(own[w] * x for w, x in v.items() if w in own) / norm, 12), n) for v, n in zip(self.vectors, self.names, strict=True)]
        return min(scores, key=lambda x: rank(*x))  # equal cosines differ by the order of their sums, hence rounded


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> list[bytes]:
    return sorted({w for _, t in templates for w in _words(t)})


def file_counts(files: DataFrame, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of files (path, text), and by word how many hold it; over all of them."""
    hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
    order = np.argsort(hashes)
    ordered = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(ordered), dtype=np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                found = Words(batch.column("text").slice(a, b - a), ALNUM)
                n += b - a
                h = found.hashes()
                at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                known = ordered[at] == h
                both = np.unique(found.row[known].astype(np.int64) * len(ordered) + at[known])
                counts += np.bincount(both % len(ordered), minlength=len(ordered))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(order, -1)), pa.array(np.append(counts, n))], ["word", "n"])

    sums = map_in_arrow(files.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in sums}
    return found.get(-1, 0), {words[k]: n for k, n in found.items() if k >= 0}


class Scanner:
    def __init__(self, templates: Templates) -> None:
        self.templates = templates
        words = list(templates.idf)
        hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], np.array([templates.idf[w] for w in words])[order]

    def own(self, texts: pa.Array, whole: list[bool]) -> list[tuple[float, str | None]]:
        """By text, the best (cosine, licence) that counts; (0, None) without one."""
        words = Words(texts, ALNUM)
        best = [(0.0, "")] * len(texts)
        if len(words):
            h = words.hashes()
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            line = np.cumsum(words.raw == 0x0A, dtype=np.int64)[words.start]
            other_text = words.row[1:] != words.row[:-1]
            ranges = {(int(words.first[r]), int(words.first[r + 1])) for r in np.flatnonzero(whole).tolist()}
            for lines in (1, 2):  # so many line ends part two lines, or two paragraphs
                begins = np.append(True, other_text | (line[1:] - line[:-1] >= lines))
                ranges.update(self._can_count(begins, at, known))
            for a, b in sorted(ranges):
                if a < b:
                    self._compare(words, int(words.row[a]), a, b, best)
        return [(s, n) if s >= MIN_COSINE else (0.0, None) for s, n in best]

    def _can_count(self, begins: np.ndarray, at: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int]]:
        """The segments (word ranges) of whose weight enough lies on words of templates."""
        segment, starts = np.cumsum(begins) - 1, np.append(np.flatnonzero(begins), len(begins))
        keys, n = np.unique(segment[known] * len(self.hashes) + at[known], return_counts=True)
        on = np.bincount(keys // len(self.hashes), weights=(n * self.idf[keys % len(self.hashes)]) ** 2, minlength=len(starts) - 1)
        off = np.bincount(segment[~known], minlength=len(starts) - 1) * self.templates.other**2  # at least
        for k in np.flatnonzero((on > 0) & (on >= (MIN_COSINE**2 - 1e-9) * (on + off))).tolist():
            yield int(starts[k]), int(starts[k + 1])

    def _compare(self, words: Words, row: int, a: int, b: int, best: list) -> None:
        bag = Counter(words.word(k) for k in range(a, b))
        score, name = self.templates.best(bag)
        if rank(score, name) < rank(*best[row]):
            best[row] = (score, name)


def directory(path: Column) -> Column:
    """The path without its last part; "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The columns of files (with path, text), and own_licence, score, licence, found (own, inherited or none), from_path."""
    count, with_word = file_counts(files, vocabulary(templates))
    shared = share(files.sparkSession, Scanner(Templates(count, with_word, templates)))
    whole, own_dir, at, from_, given = free_names([*files.columns, "own_licence", "score", "licence", "found", "from_path"], "_whole", "_own_dir", "_dir", "_from", "_licence")
    marked = files.withColumns(
        {
            "own_licence": F.lit(None).cast("string"),
            "score": F.lit(0.0),
            whole: F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)),
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found = shared.value.own(part.column("text"), part.column(whole).to_pylist())
                for k, (name, kind) in enumerate((("score", pa.float64()), ("own_licence", pa.string()))):
                    i = part.schema.get_field_index(name)
                    part = part.set_column(i, part.schema.field(i), pa.array([f[k] for f in found], kind))
                yield part

    scanned = map_in_arrow(marked, run, marked.schema)
    givers = marked.filter(F.col(whole)).select("path", "text", "own_licence", "score", whole)
    givers = map_in_arrow(givers, run, givers.schema).filter("own_licence is not null").select("path", "own_licence", "score")
    nearest = nearest_givers(files.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct(), givers)
    joined = scanned.withColumn(own_dir, directory(F.col("path"))).join(nearest.toDF(at, from_, given), F.col(own_dir) == F.col(at), "left")
    own = F.col("own_licence").isNotNull()
    return joined.withColumns(
        {
            "licence": F.coalesce("own_licence", given),
            "found": F.when(own, "own").when(F.col(given).isNotNull(), "inherited").otherwise("none"),
            "from_path": F.when(own, F.col("path")).otherwise(F.col(from_)),
        }
    ).drop(whole, own_dir, at, from_, given)


def nearest_givers(places: DataFrame, givers: DataFrame) -> DataFrame:
    """(dir, path, licence): for directories (dir), the licence file of the nearest of them and those above; givers: (path, own_licence, score)."""
    best = F.min(F.struct(-F.col("score"), F.col("path").alias("path"), F.col("own_licence").alias("licence"))).alias("g")
    given = cut(givers.groupBy(directory(F.col("path")).alias("at")).agg(best))
    parts = F.split("dir", "/")
    above = F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    nearest = (
        places.select("dir", above.alias("at"))
        .join(given, "at")  # very many directories share an ancestor: both sides are shuffled anew, so that Spark may split it
        .groupBy("dir")
        .agg(F.max_by("g", F.length("at")).alias("g"))
    )
    return cut(nearest.select("dir", "g.path", "g.licence"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Paths for documents: a folder for each source and hundred ids; what has a notice in any of its lines stands for a licence file."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"))
    notice = F.coalesce(F.col("text").rlike("(?i)licensed under|released under"), F.lit(False))
    name = F.concat(F.when(notice, "LICENSE.").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", "text", F.concat(folder, F.lit("/"), name).alias("path"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_paths(table(spark, sf_dir, "documents"))
    out = scan(files)
    return out.select("doc_id", "path", "own_licence", "licence", "found", "from_path", F.round("score", 9).alias("score"))
