"""License scans by a positional index of rare words. DataFrame functions alone.

1. Document frequencies of the words of all key phrases are counted over all documents; the rarest words of each
   phrase, with their positions in it, are its postings.
2. Each file is looked up once: the places of its words that are rare in some phrase.
3. For each phrase the places of its rare words, each minus its position in the phrase, are intersected: what is left
   are starts at which all its rare words stand at their relative positions.
4. At those starts the mandatory key phrase is verified word by word. A notice may need a second phrase elsewhere in the file, or
   be barred by one that another licence adds. The share of the whole notice's words that stand at their places relative to the
   phrase is the score.

So every place of a complete key phrase is found, whatever else a file holds, and however the words around it were changed.

Defined results: a null or empty text has no words, no labels (empty strings) and score 0; repeated rows are scanned alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import col

#: Java pattern of what stands between words of lower-case text: ASCII other than digits and letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class Template(NamedTuple):
    """A licence notice: the key phrase must stand there; before and after are the words usual around it.

    needs: another phrase that must stand somewhere in the file; bars: one that must not.
    """

    label: str
    phrase: str
    before: str = ""
    after: str = ""
    needs: str = ""
    bars: str = ""


def notice(label: str, phrase: str, text: str, needs: str = "", bars: str = "") -> Template:
    """The template of a notice's text, which holds the phrase."""
    before, found, after = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} ".partition(f" {phrase} ")
    assert found, phrase
    return Template(label, phrase, before.strip(), after.strip(), needs, bars)


#: Key phrases whose places count as base places: fixed values.
BASE = (
    Template("mit", "under the mit license", before="released"),
    Template("apache-2", "apache license version 2", before="licensed under the", after="0"),
    Template("cc-by-nc", "cc by nc", before="licensed under", after="4 0"),
)
#: Further labels, by how licences are named and by the notices that stand in files: fixed values.
ENDORSE = "may be used to endorse or promote products derived from this software"
FORMS = "redistribution and use in source and binary forms with or without modification are permitted"
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
MORE = (
    Template("gpl-3", "gnu general public license version 3", before="this work is licensed under the"),
    Template("gpl-2", "gnu general public license version 2", before="this work is licensed under the"),
    Template("lgpl", "gnu lesser general public license", before="licensed under the"),
    Template("agpl", "gnu affero general public license", before="licensed under the"),
    Template("mpl-2", "mozilla public license version 2", before="subject to the terms of the", after="0"),
    Template("cc-by-sa", "cc by sa", before="licensed under", after="4 0"),
    Template("cc0", "cc0 1 0 universal", before="licensed under"),
    Template("all-rights-reserved", "all rights reserved"),
    notice(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    notice("bsd-2-clause", FORMS, BSD, bars=ENDORSE),
    notice(
        "bsd-3-clause", ENDORSE,
        BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.""",
        needs=FORMS,
    ),
    notice(
        "apache-2", "you may not use this file except in compliance with the license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    *[
        notice(
            label, f"{name} as published by the free software foundation either version {version}".lower(),
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation,
either version {version} of the License, or (at your option) any later version.""",
        )
        for label, name, version in (
            ("gpl-3", "GNU General Public License", 3), ("gpl-2", "GNU General Public License", 2),
            ("lgpl", "GNU Lesser General Public License", 3), ("agpl", "GNU Affero General Public License", 3),
        )
    ],
    notice(
        "mpl-2", "subject to the terms of the mozilla public license v 2 0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    notice(
        "isc", "permission to use copy modify and or distribute this software",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    notice(
        "unlicense", "this is free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    notice("cc-by", "creative commons attribution 4 0 international license", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    notice("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    notice(
        "epl-2", "eclipse public license 2 0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    ),
)
#: Rare words of a phrase that are looked up.
RARE = 2


def lowered(text: Column) -> Column:
    """Lower-case text in which just A-Z can have become ASCII letters.

    Two other letters (dotted capital I, Kelvin sign) would lower to ASCII letters; they are replaced by one that doesn't.
    """
    safe = F.replace(F.replace(text, F.lit("İ"), F.lit("é")), F.lit("K"), F.lit("é"))
    return F.lower(safe)


def license_words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def is_word(word: str, spot: Column) -> Column:
    return spot["w"] == word


def less(by: int, spot: Column) -> Column:
    return spot["i"] - by


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrases_of(templates: tuple[Template, ...]) -> list[str]:
    """The different phrases that templates take, need or are barred by."""
    return list(dict.fromkeys(p for t in templates for p in (t.phrase, t.needs, t.bars) if p))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[str, int]:
    """How many documents hold each word of the phrases. The driver gets one row for each such word."""
    vocabulary = sorted({w for p in phrases_of(templates) for w in p.split()})
    held = docs.select(F.array_intersect(strings(vocabulary), license_words(col(text_col))).alias("w"))
    found = held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r.w: r.n for r in found}


def rarest(phrase: str, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest words of a phrase (highest IDF) and their positions."""
    found = sorted(enumerate(phrase.split()), key=lambda x: (frequency[x[1]], x[0]))
    return [(w, i) for i, w in found[:RARE]]


def postings(template: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    return rarest(template.phrase, frequency)


def scanned(docs: DataFrame, frequency: dict[str, int], base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    places: array of (label, start, words, share) of all verified key phrases, templates in their order.
    """
    templates = base + more
    phrases = phrases_of(templates)
    index = {p: rarest(p, frequency) for p in phrases}
    rare = strings(sorted({w for found in index.values() for w, _ in found}))
    rows = docs.select(col(id_col).alias("doc_id"), license_words(col(text_col)).alias("_w"))
    # Most files hold no rare word: they carry no words on.
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_w", F.when(F.arrays_overlap("_w", rare), F.col("_w")))
    spots = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x["w"]))
    rows = rows.withColumn("_spots", spots)

    def starts(phrase: str) -> Column:
        aligned = [F.transform(F.filter("_spots", partial(is_word, w)), partial(less, at)) for w, at in index[phrase]]
        words = phrase.split()
        there = lambda s: (s >= 0) & (s + len(words) <= F.size("_w"))
        same = lambda s: F.when(there(s), F.slice("_w", s + 1, len(words)) == strings(words)).otherwise(F.lit(False))
        return F.filter(reduce(F.array_intersect, aligned), same)

    at = {p: f"_p{k}" for k, p in enumerate(phrases)}
    rows = rows.withColumns({name: F.coalesce(starts(p), F.array().cast("array<int>")) for p, name in at.items()})

    def holds(t: Template) -> Column:
        """The starts of a template: none if what it needs is missing or what bars it is there."""
        fits = [(F.size(at[p]) > 0) == wanted for p, wanted in ((t.needs, True), (t.bars, False)) if p]
        return F.when(reduce(lambda a, b: a & b, fits), F.col(at[t.phrase])).otherwise(F.array().cast("array<int>")) if fits else F.col(at[t.phrase])

    def share(t: Template, s: Column) -> Column:
        """Share of the notice's words that stand at their places around a start."""
        words = f"{t.before} {t.phrase} {t.after}".split()
        first = s - len(t.before.split())
        cut = F.greatest(-first, F.lit(0))  # words of the notice before the file
        near = F.zip_with(F.slice("_w", F.greatest(first, F.lit(0)) + 1, F.lit(len(words)) - cut), F.slice(strings(words), cut + 1, len(words)), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return (F.size(F.filter(near, lambda x: x)) / F.lit(len(words))).cast("double")

    def place(t: Template, s: Column) -> Column:
        return F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("start"), F.lit(len(t.phrase.split())).alias("words"), share(t, s).alias("share"))

    found = [f"_s{k}" for k in range(len(templates))]
    rows = rows.withColumns({f: holds(t) for f, t in zip(found, templates, strict=True)})
    places = [F.transform(f, partial(place, t)) for f, t in zip(found, templates, strict=True)]
    rows = rows.select("doc_id", "n_words", F.concat(*[F.col(f) for f in found[: len(base)]]).alias("_base"), F.concat(*places).alias("places"), F.concat(*places[: len(base)]).alias("_base_places"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"), F.array_max("_base").cast("long").alias("last_word"),
        names("_base_places").alias("base_labels"), names("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, index and scan: see scanned()."""
    return scanned(docs, document_frequencies(docs, base + more, text_col), base, more, id_col, text_col)
