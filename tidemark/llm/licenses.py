"""Licence scan by diagonal voting.

Every two consecutive words of a text form a gram; the hashes of all grams are joined with the grams of the template
texts.  A hit at word ``p`` of the text and word ``t`` of a template votes for the diagonal ``p - t``.  Votes are counted
for each document, template and diagonal; neighbouring diagonals (a few words inserted or left out) are merged, unless they
hit the same grams, for there the template begins anew.  A merged band is verified by aligning its words with the template's:
the longest chain of hits that go forward in both is a finding if it covers enough of the template and is not much longer
than it; what stands before and behind it is looked at in the same way.

The join side with the templates is a constant of this module, so it is broadcast; votes are pre-aggregated before
the shuffle.  The operator shuffles hits, never texts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as tx

#: Phrases that count wherever their words stand consecutively, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known public licence texts, passages of them, and notices, with labels; of any length from two words on.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("cc", "creative commons attribution"),
    ("cc", "licensed under cc by"),
    ("cc", "cc by nc"),
    ("cc", "cc by nd"),
    ("cc", "cc by sa"),
    ("proprietary", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
]

#: Names and abbreviations of usual licences, by label: notices that must stand whole.
NAMES = {
    "agpl": ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl v3", "agpl 3 0"],
    "apache": ["apache software license", "apache 2 0 license", "apache license 2 0"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "new bsd license", "simplified bsd license"],
    "bsl": ["boost software license"],
    "cc0": ["cc0 1 0", "creative commons zero", "creative commons cc0"],
    "epl": ["eclipse public license", "epl 2 0", "epl 1 0"],
    "eupl": ["european union public license", "european union public licence", "eupl 1 2"],
    "gpl": ["gnu gpl", "gpl v2", "gpl v3", "gpl 2 0", "gpl 3 0"],
    "isc": ["isc license"],
    "lgpl": ["lesser general public license", "library general public license", "gnu lgpl", "lgpl v2", "lgpl v3", "lgpl 2 1", "lgpl 3 0"],
    "mpl": ["mozilla public license", "mpl 2 0"],
    "public-domain": ["released into the public domain", "dedicated to the public domain", "public domain dedication"],
}
#: What follows "SPDX-License-Identifier:", up to the version, by label.
IDENTIFIERS = {"agpl": "agpl", "apache": "apache", "bsd": "bsd", "bsl": "bsl", "cc": "cc", "cc0": "cc0", "epl": "epl", "eupl": "eupl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense", "zlib": "zlib"}
TEMPLATES += [(label, name) for label, names in NAMES.items() for name in names] + [(label, f"spdx license identifier {name}") for label, name in IDENTIFIERS.items()]

GRAM = 2
#: A notice of at most so many grams has to stand whole: parts of it are words that stand together by chance.
WHOLE_GRAMS = 4
_MARKER = 0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gram hashes of each text in order, behind a marker that every text has."""
    for part in tx.slices(batches, "text"):
        data, offsets = tx.utf8(part.column("text"))
        data = tx.LOWER[data]
        starts, ends, doc = tx.words(data, offsets, tx.ALNUM)
        count = np.bincount(doc, minlength=part.num_rows)
        grams = tx.windows(tx.run_hashes(data, starts, ends, tx.ALNUM), GRAM)
        inside = doc[: len(grams)] == doc[GRAM - 1 : GRAM - 1 + len(grams)]
        grams, owner = grams[inside].view(np.int64), doc[: len(grams)][inside]
        lengths = np.bincount(owner, minlength=part.num_rows) + 1
        values = np.insert(grams, np.searchsorted(owner, np.arange(part.num_rows)), _MARKER)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(count, pa.int64()), tx.list_column(values, lengths, pa.int64())], ["doc_id", "digest", "n_words", "grams"])


def _template_rows(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple]:
    rows = [(_MARKER, -1, 0, 0, "", False)]
    for number, (label, text, base) in enumerate([(v, k, True) for k, v in phrases.items()] + [(*t, False) for t in templates]):
        grams = tx.windows(tx.hash_words(text), GRAM).view(np.int64).tolist()
        if not grams:
            raise ValueError(f"a template has two words or more: {text!r}")
        rows += [(g, number, place, len(grams), label, base) for place, g in enumerate(grams)]
    return rows


def aligned(hits: list[tuple[int, int]], size: int, min_cover: float) -> list[tuple[int, int, int]]:
    """First and last text place and number of hits of the chains that cover enough of a template of ``size`` grams.

    ``hits`` are places of the same gram in text and template.  A chain goes forward in both; the longest one is taken first
    (of equal ones that which ends first), and then those among the hits before and behind it.
    """
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    if len({t for _, t in hits}) < min_cover * size:
        return []
    ends: list[int] = []  # the smallest template place that a chain of each length ends with
    at: list[int] = []
    before = [-1] * len(hits)
    best = -1
    for i, (_, t) in enumerate(hits):
        k = bisect.bisect_left(ends, t)
        before[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(t)
            at.append(i)
            best = i
        else:
            ends[k], at[k] = t, i
    chain = []
    while best >= 0:
        chain.append(hits[best])
        best = before[best]
    first, last = chain[-1][0], chain[0][0]
    if len(chain) < min_cover * size:
        return []
    if last + GRAM - first > 1.5 * (size + 1):  # torn: the parts on both sides of the widest gap
        cut = max(range(1, len(chain)), key=lambda i: chain[i - 1][0] - chain[i][0])
        parts = [[h for h in hits if h[0] <= chain[cut][0]], [h for h in hits if h[0] > chain[cut][0]]]
        return [x for part in parts if len(part) < len(hits) for x in aligned(part, size, min_cover)]
    return [*aligned([h for h in hits if h[0] < first], size, min_cover), (first, last, len(chain)), *aligned([h for h in hits if h[0] > last], size, min_cover)]


_FINDING = pa.struct([("base", pa.bool_()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])


def _verify(batches: Iterator[pa.RecordBatch], min_cover: float) -> Iterator[pa.RecordBatch]:
    """Bands of the templates as findings; those of base phrases are exact already."""
    for batch in batches:
        out = []
        for size, label, base, diagonals in zip(*(batch.column(c).to_pylist() for c in ("size", "label", "base", "diagonals")), strict=True):
            if label is None:
                out.append([])
            elif base:
                out.append([{"base": True, "label": label, "start": d["diagonal"], "end": d["diagonal"] + size + GRAM - 1, "cover": 1.0} for d in diagonals])
            else:
                hits = [(d["diagonal"] + t, t) for d in diagonals for t in d["places"]]
                out.append([{"base": False, "label": label, "start": a, "end": b + GRAM, "cover": n / size} for a, b, n in aligned(hits, size, min_cover if size > WHOLE_GRAMS else 1.0)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "n_words", "copies")), pa.array(out, pa.list_(_FINDING))], ["doc_id", "digest", "n_words", "copies", "findings"])


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = BASE_PHRASES, templates: list[tuple[str, str]] = TEMPLATES, min_cover: float = 0.6, max_gap: int = 3) -> DataFrame:
    """Findings of each document of columns ``doc_id, text``: ``doc_id, n_words, findings``, a row for each input row.

    ``findings`` is an array of (base, label, start, end, cover): words from 0, end exclusive; cover is the share of the
    template's grams in the aligned chain, which is all of them for notices of at most four grams.  Base findings are the exact places of a phrase.  Occurrences of a template
    that follow each other, also without a word between, are findings of their own.  Null texts count as empty, empty
    texts have no findings; identifiers may be null or repeat (rows are told apart by identifier and text; equal rows have
    equal findings); columns besides the two are not looked at.  Templates are a list that a driver holds, of any length.
    """
    spark = docs.sparkSession
    marks = F.broadcast(spark.createDataFrame(_template_rows(phrases, templates), "gram long, template int, place int, size int, label string, base boolean"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    grams = texts.mapInArrow(_grams, f"doc_id {kind}, digest long, n_words long, grams array<long>")
    hits = grams.select("doc_id", "digest", "n_words", F.posexplode("grams").alias("at", "gram")).join(marks, "gram")
    diagonal = (F.col("at") - 1 - F.col("place")).alias("diagonal")
    votes = hits.groupBy("doc_id", "digest", "n_words", "template", "size", "label", "base", diagonal).agg(F.count("*").alias("votes"), F.collect_set("place").alias("places"))
    strong = F.col("base") & (F.size("places") == F.col("size")) | ~F.col("base") & (F.size("places") >= F.least(F.lit(2), F.col("size"))) | (F.col("template") < 0)
    order = W.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    anew = F.coalesce(F.arrays_overlap("places", F.lag("places").over(order)), F.lit(False))
    apart = F.col("base") | anew | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.lit(-1_000_000)) > max_gap)
    bands = votes.where(strong).repartition("doc_id", "digest").withColumn("band", apart.cast("int")).withColumn("band", F.sum("band").over(order))
    merged = bands.groupBy("doc_id", "digest", "n_words", "template", "size", F.when(F.col("template") >= 0, F.col("label")).alias("label"), "base", "band").agg(
        F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"), F.sort_array(F.collect_list(F.struct("diagonal", "places"))).alias("diagonals")
    )
    checked = merged.select("doc_id", "digest", "n_words", "copies", "size", "label", "base", "diagonals").mapInArrow(
        lambda b: _verify(b, min_cover), f"doc_id {kind}, digest long, n_words long, copies long, findings array<struct<base:boolean,label:string,start:long,end:long,cover:double>>"
    )
    found = checked.groupBy("doc_id", "digest", "n_words").agg(F.sort_array(F.flatten(F.collect_list("findings"))).alias("findings"), F.max("copies").alias("copies"))
    return found.withColumn("copy", F.explode(F.expr("array_repeat(1, int(copies))"))).select("doc_id", "n_words", "findings")


def license_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the scan, with ``n_spans`` (all findings)."""
    base = F.filter("findings", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("findings")).alias("labels"), F.coalesce(F.array_max(F.transform("findings", lambda x: x["cover"])), F.lit(0.0)).alias("score"), F.size("findings").alias("n_spans"),
    )
