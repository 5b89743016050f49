"""Licence scans: parts of a text against licence templates by the Dice coefficient.

A part is a line, a paragraph (between blank lines) or the whole text, so a licence that stands
among other text is found as well as a licence file. Parts and templates are normalised the same
way (lower case, runs of anything but letters and digits become one blank) and compared as sets of
word bigrams. Dice of at least t needs sizes within a factor of (2 - t) / t, so only templates
inside these bounds are intersected with a part. All of it is one projection: no shuffle, no
Python; the templates are a constant of the plan.

Defined cases: null and empty texts, and parts of less than two words, match nothing; a tie for the
best template goes to the first name; rows are scanned one by one, so repeated rows and ids do not
matter; extra columns are kept, an input column named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bind, whole

MIN_DICE = 0.8

_GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the"
    " GNU {name} as published by the Free Software Foundation, either version {version} of the"
    " License, or (at your option) any later version."
)
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met:"
)
_BSD_COPIES = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce"
    " the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written"
    " permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR"
    " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER"
    " OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
    " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
    " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
    " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
    " POSSIBILITY OF SUCH DAMAGE."
)
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = {
    "GPL-2.0": ("General Public License", "2"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"),
    "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}

# Notices and passages of public licences. The opening that all BSD licences share
# does not tell which one it is.
TEMPLATES = {
    **{f"CC-{k}-4.0 short": f"Licensed under CC {k} 4.0." for k in _CC},
    **{
        f"CC-{k}-4.0": f"This work is licensed under the Creative Commons {v} 4.0 International License."
        for k, v in _CC.items()
    },
    **{
        k: f"This work is licensed under the GNU {name}, version {version}."
        for k, (name, version) in _GNU.items()
    },
    **{
        f"{k} header": _GNU_HEADER.format(
            what="library" if k.startswith("LGPL") else "program", name=name, version=version
        )
        for k, (name, version) in _GNU.items()
    },
    "BSD-2-Clause": _BSD_OPENING + _BSD_COPIES + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_OPENING + _BSD_COPIES + _BSD_NAMES + _BSD_DISCLAIMER,
    "BSD-3-Clause names": _BSD_NAMES,
    "BSD-family": _BSD_OPENING,
    "MIT notice": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the"
        " License for the specific language governing permissions and limitations under the"
        " License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If"
        " a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

NOT_IN_WORDS = "[^\\p{L}\\p{N}]+"
BLANK_LINES = "\\n[\\x20\\x09\\r]*\\n"


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _bigrams(part: Column) -> Column:
    """Distinct word bigrams of a part."""

    def pairs(words: Column) -> Column:
        length = F.greatest(F.size(words) - 1, F.lit(0))
        both = F.arrays_zip(F.slice(words, 1, length), F.slice(words, 2, length))
        return F.array_distinct(F.transform(both, lambda x: F.concat_ws(" ", x["0"], x["1"])))

    words = F.array_remove(F.split(F.regexp_replace(F.lower(part), NOT_IN_WORDS, " "), " "), "")
    return bind(words, pairs)


def scan_licenses(
    df: DataFrame,
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    min_dice: float = MIN_DICE,
) -> DataFrame:
    """``df`` with the licences found in each text.

    Adds license_matches (an array of license, dice and part, one entry for each template that a
    part matches), license and license_dice (the best match, null without one).
    """
    known = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"),
                F.array(*(F.lit(b) for b in bigrams)).alias("bigrams"),
                F.lit(len(bigrams)).alias("n"),
            )
            for name, text in sorted(templates.items())
            if (bigrams := template_bigrams(text))
        )
    )
    bound = (2 - min_dice) / min_dice

    def dice(own: Column, other: Column) -> Column:
        size = F.size(own)
        near = (size <= bound * other["n"]) & (other["n"] <= bound * size)
        shared = F.size(F.array_intersect(own, other["bigrams"]))
        return F.when(near, F.lit(2.0) * shared / (size + other["n"]))

    def matches(part: Column) -> Column:
        def found(own: Column) -> Column:
            scored = F.transform(
                known,
                lambda x: F.struct(
                    dice(own, x).alias("dice"), x["license"].alias("license"), part.alias("part")
                ),
            )
            return F.filter(scored, lambda x: x["dice"] >= min_dice)

        return bind(_bigrams(part), found)

    text = whole(text_col)
    parts = F.array_distinct(
        F.concat(F.split(text, "\n", -1), F.split(text, BLANK_LINES, -1), F.array(text))
    )
    staged = df.withColumn("license_matches", F.flatten(F.transform(parts, matches)))
    # the greatest by (dice, then the smaller name)
    best = F.aggregate(
        F.col("license_matches"),
        F.lit(None).cast("struct<dice:double,license:string,part:string>"),
        lambda a, x: F.when(
            a.isNull()
            | (x["dice"] > a["dice"])
            | ((x["dice"] == a["dice"]) & (x["license"] < a["license"])),
            x,
        ).otherwise(a),
    )
    return (
        staged.withColumn("__llm_best", best)
        .withColumn("license", F.col("__llm_best.license"))
        .withColumn("license_dice", F.col("__llm_best.dice"))
        .drop("__llm_best")
    )
