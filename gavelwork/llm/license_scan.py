"""License scan: units of text against license templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.llm.common import text_or_empty

THRESHOLD = 0.8

# The wording of license notices and of short grants, as published by their stewards.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
)


def template_bigrams(text: str) -> list[str]:
    """Different word bigrams of a text in the order of their first place."""
    found = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found[:-1], found[1:], strict=True)))


def least_shared(size: Column, smallest: int, threshold: float) -> Column:
    """Shared bigrams without which no template can reach the threshold: 2 c >= t (a + b)."""
    return F.lit(threshold) * (size + smallest) / 2


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, place, words): every line, every paragraph of several lines, and the whole
    text if it has several lines, normalised to lower-case letters and digits."""
    plain = F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z0-9\\n]+", " ")
    blocks = F.split(F.regexp_replace(F.col("plain"), "\\n[ \\n]*\\n", "\u0001"), "\u0001")

    def of(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("body")))

    rows = held(docs, F.col(doc_id).cast("long").alias("doc_id"), plain.alias("plain"))
    several = F.filter(of("paragraph", blocks), lambda b: b["body"].contains("\n"))
    several = F.when(F.col("plain").rlike("\\n[ \\n]*\\n"), several).otherwise(F.slice(several, 1, 0))
    whole = F.filter(of("text", F.array("plain")), lambda b: b["body"].contains("\n"))
    every = F.concat(of("line", F.split("plain", "\n")), several, whole)
    words = F.split(F.trim(F.translate("body", "\n", " ")), " +")
    return held(rows.select("doc_id", F.inline(every)), "doc_id", "unit", "place", words.alias("words"))


def held(rows: DataFrame, *columns) -> DataFrame:
    """The columns, each computed once per row: expressions are not moved through a generator,
    so none is repeated inside the filters and functions that use it."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, place, license, dice) of every unit that is like a template.

    A unit is compared with the templates whose number of bigrams can reach the threshold beside its
    own; the best counts, of equal ones the first license by name. Units that share too few
    bigrams with all templates together go before that. Null and empty texts match nothing;
    repeated rows match each for itself; other columns are ignored.
    """
    sized = [(name, template_bigrams(body)) for name, body in templates]
    every = sorted({b for _, own in sized for b in own})
    starts = sorted({b.split(" ")[0] for b in every})
    smallest, largest = min(len(b) for _, b in sized), max(len(b) for _, b in sized)
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(own)).alias("n"), F.array(*map(F.lit, own)).alias("bigrams")) for name, own in sized
    ])
    w = F.col("words")
    pair = F.transform(w, lambda x, i: F.when(x.isin(starts), F.concat(x, F.lit(" "), F.get(w, i + 1))))
    shared = F.array_distinct(F.filter(pair, lambda b: b.isin(every)))
    found = held(units(docs, doc_id, text).filter(F.size("words") > 1), "doc_id", "unit", "place", "words", shared.alias("shared"))
    found = found.filter(F.size("shared") >= least_shared(F.lit(1), smallest, threshold))
    pairs = F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    found = held(found, "doc_id", "unit", "place", "shared", F.size(F.array_distinct(pairs)).alias("n"))
    found = found.filter((F.size("shared") >= least_shared(F.col("n"), smallest, threshold)) & (F.col("n") <= largest * (2 - threshold) / threshold))
    # the Dice coefficient of sets of a and b members is at most 2 min(a, b) / (a + b)
    near = F.filter(table, lambda t: 2 * F.least(t["n"], F.col("n")) >= F.lit(threshold) * (t["n"] + F.col("n")))
    dice = F.transform(near, lambda t: F.struct(
        (-2.0 * F.size(F.array_intersect(t["bigrams"], F.col("shared"))) / (t["n"] + F.col("n"))).alias("minus"), t["name"].alias("license")
    ))
    best = held(found, "doc_id", "unit", "place", F.array_min(dice).alias("best"))
    return best.select(
        "doc_id", "unit", "place", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice")
    ).filter(F.col("dice") >= threshold)
