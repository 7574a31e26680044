"""License scans by diagonal voting.

Word k-grams of documents are joined in Spark to their positions in license templates.  A document position minus a
template position is a diagonal: the k-grams of one quotation share it, and an inserted or lost word moves it by one.
Votes are counted for each document, template and diagonal, neighbouring diagonals are merged, and spans are verified: a
long text needs most of its words, among them those that tell it from its relatives, a short statement all of its words.
Spans over the same words compete; the best covered one, then the longest, is kept.  Beside this, fixed phrases are
counted wherever they stand.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage_table
from . import kernels as K
from .tokens import HashIndex

GRAM = 3
DIAGONAL_GAP = 2
SPAN_BREAK = 32  # words without a vote after which a span ends
MIN_COVERAGE = 0.6
SHORT_WORDS = 16  # statements of up to so many words stand whole or not at all

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The texts by which public licenses give their terms, and the notices that they ask to be put on a work.
WARRANTY = (
    "is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be "
    "liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or "
    "in connection with the software or the use or other dealings in the software."
)
GNU_NOTICE = (
    "{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version."
)
GNU_WARRANTY = (
    "{work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The software " + WARRANTY),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("gpl-3.0", GNU_NOTICE.format(work="This program", name="General Public License", version="3")),
    ("lgpl-3.0", GNU_NOTICE.format(work="This library", name="Lesser General Public License", version="3")),
    ("agpl-3.0", GNU_NOTICE.format(work="This program", name="Affero General Public License", version="3")),
    ("gpl", GNU_WARRANTY.format(work="This program", name="General Public License")),
    ("lgpl", GNU_WARRANTY.format(work="This library", name="Lesser General Public License")),
    ("agpl-3.0", GNU_WARRANTY.format(work="This program", name="Affero General Public License")),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at"),
]

# Names of licenses, and the conditions that Creative Commons licenses put together.
NAMES = {
    "mit": "MIT License", "apache-2.0": "Apache License, Version 2.0", "gpl-2.0": "GNU General Public License, version 2", "gpl-3.0": "GNU General Public License, version 3",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1", "lgpl-3.0": "GNU Lesser General Public License, version 3", "agpl-3.0": "GNU Affero General Public License, version 3",
    "mpl-2.0": "Mozilla Public License, version 2.0", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License", "isc": "ISC License", "zlib": "zlib License",
    "epl-2.0": "Eclipse Public License, version 2.0", "bsl-1.0": "Boost Software License, Version 1.0", "ofl-1.1": "SIL Open Font License, Version 1.1",
}
# The words by which a notice is told from those of other licenses or versions.
MARKS = {
    "apache-2.0": "Apache License", "gpl-2.0": "version 2", "gpl-3.0": "version 3", "lgpl-2.1": "Lesser", "lgpl-3.0": "Lesser", "lgpl": "Lesser", "agpl-3.0": "Affero",
    "gfdl-1.3": "Documentation License", "mpl-2.0": "Mozilla Public License", "epl-2.0": "Eclipse Public License", "cc0-1.0": "neighboring rights", "ofl-1.1": "Open Font License",
}
VERBS = ("licensed", "released", "distributed", "available")
CONDITIONS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}


def _statements() -> list[tuple[str, str]]:
    """How works say which license they are under: by name, by identifier, and by the marks of Creative Commons."""
    out = [(label, f"{verb} under the {name}") for label, name in NAMES.items() for verb in VERBS]
    out += [(label, f"SPDX-License-Identifier: {label}") for label in NAMES]
    for kind in ("by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd"):
        conditions = "-".join(CONDITIONS[c] for c in kind.split("-"))
        for version, suffix in (("3.0", "Unported"), ("4.0", "International")):
            out.append((f"cc-{kind}-{version}", f"licensed under a Creative Commons {conditions} {version} {suffix} License"))
            out.append((f"cc-{kind}-{version}", f"licensed under CC {kind.upper()} {version}"))
    return out


TEMPLATES = NOTICES + _statements()


def _words_of(texts: list[str]) -> K.Words:
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    return K.batch_words(batch, K.ALNUM, lower=True)


def _marked(label: str, text: str) -> list[int]:
    """Places of the template's words that a span has to hold."""
    found, mark = _words_of([text, MARKS.get(label, "")]).hashes(), len(MARKS.get(label, "").split())
    words, wanted = found[: len(found) - mark].tolist(), found[len(found) - mark :].tolist()
    at = next((i for i in range(len(words)) if wanted and words[i : i + mark] == wanted), None)
    return [] if at is None else list(range(at, at + mark))


def scan_words(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, gram: int = GRAM) -> DataFrame:
    """One row per document: its id, word count, phrase places, and the k-grams that occur in some template."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    known = np.unique(_words_of([t for _, t in templates]).ngram_hashes(gram)[1])
    wanted = {p: _words_of([p]).hashes() for p in phrases}

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words = K.batch_words(part, K.ALNUM, lower=True)
        hashes, counts, first = words.hashes(), words.counts, words.first
        n, texts = len(hashes), part.num_rows
        index = HashIndex()
        index.add(known)
        places, grams = words.ngram_hashes(gram, hashes)
        hit = index.find(grams) >= 0
        places, grams = places[hit], grams[hit]
        text_of = words.text_of
        left = np.repeat(first[1:], counts) - np.arange(n)
        at, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, phrase in enumerate(phrases):
            target = wanted[phrase]
            found = np.flatnonzero((hashes == target[0]) & (left >= len(target))) if n else np.zeros(0, np.int64)
            for j in range(1, len(target)):
                found = found[hashes[found + j] == target[j]]
            at.append(found)
            label.append(np.full(len(found), k))
        at, label = np.concatenate(at), np.concatenate(label)
        whose = text_of[at] if n else at
        n_base = np.bincount(whose, minlength=texts)
        low, high = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
        np.minimum.at(low, whose, at - first[whose])
        np.maximum.at(high, whose, at - first[whose])
        names, marks = list(phrases.values()), np.zeros((texts, len(phrases)), bool)
        marks[whose, label] = True
        base = [sorted({names[k] for k in np.flatnonzero(row)}) for row in marks]
        own = text_of[places] if n else places
        cuts = pa.array(np.searchsorted(own, np.arange(texts + 1)), pa.int32())
        none = n_base == 0
        columns = {
            "n_words": pa.array(counts), "n_base": pa.array(n_base.astype(np.int64)), "first_word": pa.array(low, pa.int64(), mask=none), "last_word": pa.array(high, pa.int64(), mask=none), "base_labels": pa.array(base, pa.list_(pa.string())),
            "places": pa.ListArray.from_arrays(cuts, pa.array(places - first[own], pa.int64())), "grams": pa.ListArray.from_arrays(cuts, pa.array(K.signed(grams))),
        }
        return K.with_columns(part, **columns)

    return K.map_texts(K.documents_of(docs), work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, places array<long>, grams array<long>")


def license_spans(scanned: DataFrame, templates: list[tuple[str, str]] | None = None, gram: int = GRAM, gap: int = DIAGONAL_GAP, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Verified spans: row_key, template, label, first_word, end_word and coverage of the template's words.

    Diagonals at most ``gap`` apart are one band; a band ends where SPAN_BREAK words have no vote, and begins anew.
    """
    templates = templates or TEMPLATES
    words = _words_of([t for _, t in templates])
    at, hashes = words.ngram_hashes(gram)
    template_of = words.text_of[at]
    rows = list(zip(K.signed(hashes).tolist(), template_of.tolist(), (at - words.first[template_of]).tolist(), strict=True))
    spark = scanned.sparkSession
    positions = F.broadcast(spark.createDataFrame(rows, "gram long, template int, template_at int"))  # as large as the templates
    facts = [(i, label, int(n), _marked(label, text)) for i, ((label, text), n) in enumerate(zip(templates, words.counts, strict=True))]
    about = F.broadcast(spark.createDataFrame(facts, "template int, label string, template_words int, marked array<int>"))
    votes = scanned.select("row_key", F.explode(F.arrays_zip("places", "grams")).alias("v")).select("row_key", F.col("v.places").alias("at"), F.col("v.grams").alias("gram"))
    votes = votes.join(positions, "gram").withColumn("diagonal", F.col("at") - F.col("template_at"))
    by_diagonal = Window.partitionBy("row_key", "template").orderBy("diagonal", "at")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= gap, 0).otherwise(1)
    votes = votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(by_diagonal))
    by_place = Window.partitionBy("row_key", "template", "band").orderBy("at", "template_at")
    far = F.when(F.col("at") - F.lag("at").over(by_place) <= SPAN_BREAK, 0).otherwise(1)
    votes = votes.withColumn("far", far).withColumn("part", F.sum("far").over(by_place))
    spans = votes.groupBy("row_key", "template", "band", "part").agg(F.collect_set("template_at").alias("hit"), F.min("at").alias("first_word"), (F.max("at") + gram).alias("end_word"))
    covered = F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x, x + gram - 1))))
    spans = spans.join(about, "template").withColumn("covered", covered).withColumn("coverage", F.size("covered") / F.col("template_words"))
    whole = F.when(F.col("template_words") <= SHORT_WORDS, F.col("coverage") == 1.0).otherwise(F.col("coverage") >= min_coverage)
    return spans.where(whole & (F.size(F.array_except("marked", "covered")) == 0)).select("row_key", "template", "label", "first_word", "end_word", "coverage", F.size("covered").alias("words"))


def best_spans(spans: DataFrame) -> DataFrame:
    """Of the spans of a row that share words, the best covered, then the longest, then the first label's; then the best of the rest.

    Spans that hang together by shared words are settled together; there are at most a few for each template.
    """
    in_order = Window.partitionBy("row_key").orderBy("first_word", "end_word", "template")
    reach = F.max("end_word").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("new", F.when(F.col("first_word") < reach, 0).otherwise(1)).withColumn("heap", F.sum("new").over(in_order))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("a"), (-F.col("words")).alias("b"), "label", "first_word", "end_word", "coverage")))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["first_word"] < x["end_word"]) & (x["first_word"] < k["end_word"]))
    heaps = joined.groupBy("row_key", "heap").agg(ranked.alias("x"))
    none = F.filter("x", lambda x: F.lit(False))
    kept = F.aggregate("x", none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return heaps.select("row_key", F.explode(kept).alias("x")).select("row_key", "x.label", "x.first_word", "x.end_word", "x.coverage")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licenses of each document: counts and places of the fixed phrases, labels of both ways, and a score.

    A label of a family (gpl, bsd) is not added where one of its licenses is found.  The score is 1 where a phrase
    stands, else the best coverage of a span, else 0.  Null or empty text: no
    words, no labels.  Rows that share a doc_id, or have none, and repeated rows are judged each on their own.  A text of
    any length is looked at whole.  No rows: no result.  Other columns are not looked at.
    """
    scanned = stage_table(scan_words(docs).withColumn("row_key", F.monotonically_increasing_id()), "license-words")
    found = best_spans(license_spans(scanned)).groupBy("row_key").agg(F.collect_set("label").alias("all"), F.max("coverage").alias("coverage"))
    family = lambda x: F.exists("all", lambda y: y.startswith(F.concat(x, F.lit("-"))))
    found = found.select("row_key", "coverage", F.filter("all", lambda x: ~family(x)).alias("found"))
    both = scanned.drop("places", "grams").join(found, "row_key", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
