"""Licence recognition by sentences and ordered rules, in built-in functions only.

A text loses its comment marks and is cut into sentences; the lines of a
paragraph are joined.  Normalised sentences that are known become identifiers,
all others a mark between them.  The sequence is then matched against rules in
order: a rule whose identifiers are true neighbours names its licence and uses
them up, so a long rule is not reported again by a shorter one further down.
All of it is one expression of the row, so nothing is shuffled and nothing can
be skewed.

A sentence ends at its marks before white space, at an empty line and before a
list mark.  Since statements often stand on a line of their own after one
without a mark, a known sentence may also begin and end with any line; of those
that begin at a place the longest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence sentences, by identifier
SENTENCES = {
    "ApacheLine": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\")",
                   "Released under the Apache License, Version 2.0",
                   "This work is licensed under the Apache License, Version 2.0"],
    "ApacheUse": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "MITLine": ["Released under the MIT License", "Licensed under the MIT License",
                "This work is licensed under the MIT License"],
    "MITGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy",
                 "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:"],
    "MITNotice": ["The above copyright notice and this permission notice shall be included in all copies "
                  "or substantial portions of the Software"],
    "AsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
             "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
             "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "GPL3Line": ["This work is licensed under the GNU General Public License, version 3",
                 "Licensed under the GNU General Public License, version 3",
                 "Released under the GNU General Public License, version 3"],
    "GPL2Line": ["This work is licensed under the GNU General Public License, version 2",
                 "Licensed under the GNU General Public License, version 2",
                 "Released under the GNU General Public License, version 2"],
    "GPLFree": ["This program is free software: you can redistribute it and/or modify it under the terms "
                "of the GNU General Public License as published by the Free Software Foundation"],
    "GPL3Free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version"],
    # a semicolon ends a sentence: the notice of version 2 is three of them
    "GPLProgram": ["This program is free software"],
    "GPLTerms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                 "published by the Free Software Foundation"],
    "GPL2Later": ["either version 2 of the License, or (at your option) any later version"],
    "GPLWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "LGPLLine": ["Licensed under the GNU Lesser General Public License, version 3",
                 "Released under the GNU Lesser General Public License, version 3",
                 "This work is licensed under the GNU Lesser General Public License, version 3"],
    "LGPLProgram": ["This library is free software"],
    "LGPLTerms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                  "published by the Free Software Foundation"],
    "LGPL21Later": ["either version 2.1 of the License, or (at your option) any later version"],
    "LGPL3Free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                  "License, or (at your option) any later version",
                  "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                  "License, or (at your option) any later version"],
    "LGPLWarranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "AGPL3Free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                  "License, or (at your option) any later version"],
    "AGPLLine": ["Licensed under the GNU Affero General Public License, version 3",
                 "Released under the GNU Affero General Public License, version 3",
                 "This work is licensed under the GNU Affero General Public License, version 3"],
    "ISCGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                 "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
                 "copies"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "BSDSource": ["Redistributions of source code must retain the above copyright notice",
                  "Redistributions of source code must retain the above copyright notice, this list of conditions "
                  "and the following disclaimer"],
    "BSDBinary": ["Redistributions in binary form must reproduce the above copyright notice",
                  "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the "
                  "distribution"],
    "BSDName": ["Neither the name of the copyright holder nor the names of its contributors may be used "
                "to endorse or promote products derived from this software",
                "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                "or promote products derived from this software without specific prior written permission"],
    "MPLLine": ["This Source Code Form is subject to the terms of the Mozilla Public License, v",
                "Licensed under the Mozilla Public License, version 2.0"],
    "CCBYNC4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "CCBYSA4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "CCBY4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright",
            "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work"],
    "Reserved": ["All rights reserved"],
}
# fixed values: short licence identifiers of a source file's first lines, and the licence each means
SHORT = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0",
         "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1",
         "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0",
         "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "BSD-2-Clause": "BSD-2-Clause",
         "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "Unlicense": "Unlicense",
         "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0"}
SENTENCES |= {f"SPDX-{short}": [f"SPDX-License-Identifier: {short}"] for short in SHORT}
# fixed values: rules in order; the first whose sentences stand side by side takes them
RULES = [
    ("Apache-2.0", ["ApacheLine", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheLine", "ApacheUse"]),
    ("Apache-2.0", ["ApacheLine"]),
    ("MIT", ["MITGrant", "MITNotice", "AsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("MIT", ["MITLine"]),
    ("GPL-3.0", ["GPL3Line"]),
    ("GPL-2.0", ["GPL2Line"]),
    ("GPL-3.0", ["GPL3Free", "GPLWarranty"]),
    ("GPL-3.0", ["GPL3Free"]),
    ("GPL-2.0", ["GPLProgram", "GPLTerms", "GPL2Later", "GPLWarranty"]),
    ("GPL-2.0", ["GPLProgram", "GPLTerms", "GPL2Later"]),
    ("GPL", ["GPLFree", "GPLWarranty"]),
    ("GPL", ["GPLFree"]),
    ("LGPL-3.0", ["LGPLLine"]),
    ("LGPL-3.0", ["LGPL3Free", "GPLWarranty"]),
    ("LGPL-3.0", ["LGPL3Free", "LGPLWarranty"]),
    ("LGPL-3.0", ["LGPL3Free"]),
    ("LGPL-2.1", ["LGPLProgram", "LGPLTerms", "LGPL21Later", "LGPLWarranty"]),
    ("LGPL-2.1", ["LGPLProgram", "LGPLTerms", "LGPL21Later"]),
    ("AGPL-3.0", ["AGPL3Free", "GPLWarranty"]),
    ("AGPL-3.0", ["AGPL3Free"]),
    ("AGPL-3.0", ["AGPLLine"]),
    ("ISC", ["ISCGrant", "AsIs"]),
    ("ISC", ["ISCGrant"]),
    ("Unlicense", ["Unlicense"]),
    ("BSD-3-Clause", ["BSDSource", "BSDBinary", "BSDName"]),
    ("BSD-2-Clause", ["BSDSource", "BSDBinary"]),
    ("MPL-2.0", ["MPLLine"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC0-1.0", ["CC0"]),
    *((name, [f"SPDX-{short}"]) for short, name in SHORT.items()),
]
#: Comment marks at the start of a line.
COMMENT = r"[ \t\r]*(?://+|/\*+|\*+/|\*+|#+|--+|%+|>+)"
#: The numbers and letters of list items, and white space after them.
ITEM = r"[ \t\r]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"


def normal(sentence: str) -> str:
    """Lower case, and one space for whatever is neither a-z nor 0-9 (as the queries do it)."""
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower())
    return " ".join(kept.split())


def joined(text: Column) -> Column:
    """The normalised text: ``X`` around each sentence, ``N`` between the lines within one; a null text is empty.

    The rest is lower case, so the two capitals cannot be the text's own.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(low, rf"(?dm)^{COMMENT}(?=[ \t\r]|$)", "")
    begun = F.regexp_replace(bare, rf"(?dm)^(?:[ \t\r]*$|{ITEM})", "X")
    # a run of marks is tried once
    ended = F.regexp_replace(begun, r"(?<![.!?;])[.!?;]++(?=[ \t\r\nX]|\z)", "X")
    lined = F.concat(F.lit("X"), F.replace(ended, F.lit("\n"), F.lit("N")), F.lit("X"))
    # what is no letter or digit, by ranges: Java takes ten times as long for a negated class
    plain = F.regexp_replace(lined, r"[\x00-/:-@\[-`{-\x{10ffff}]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<![ N])[ N]*+X[ XN]*+", "X"), " ?N[ N]*+", "N")


def sentence_pattern(table: dict[str, list[str]], between: str) -> str:
    """Alternatives for the known sentences, longest first, with ``between`` for the space of two words; then any line."""
    known = sorted({normal(s) for many in table.values() for s in many}, key=lambda s: (-len(s), s))
    return "|".join([*(s.replace(" ", between) for s in known), "[a-z0-9 ]+"])


def identifiers(text: Column, table: dict[str, list[str]] | None = None) -> Column:
    """The identifiers of a joined text's known sentences, in order, and ``?`` for each other line."""
    table = table or SENTENCES
    by_text = {normal(s): key for key, many in table.items() for s in many}
    names = F.create_map(*(F.lit(x) for pair in sorted(by_text.items()) for x in pair))
    found = F.regexp_extract_all(text, F.lit(f"(?<=[XN])(?:{sentence_pattern(table, '[ N]')})(?=[XN])"), F.lit(0))
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(names, F.replace(s, F.lit("N"), F.lit(" "))), F.lit("?")))


def match(ids: Column, rules=None) -> Column:
    """(licences in rule order without repeats, identifiers that no rule used) of an identifier sequence with its ``?``."""
    rest = F.regexp_replace(F.concat(F.lit("|"), F.concat_ws("|", ids), F.lit("|")), r"\?[?|]*+", "?|")
    none = F.array().cast("array<string>")
    steps = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(keys) + "|").alias("wanted"))
                      for name, keys in rules or RULES))

    def step(state: Column, rule: Column) -> Column:
        # a doubled bar keeps neighbours apart, so the same rule can match twice in a row
        once = F.replace(state["rest"], rule["wanted"], F.lit("||"))
        return F.when(F.contains(state["rest"], rule["wanted"]), F.struct(
            F.replace(once, rule["wanted"], F.lit("||")).alias("rest"),
            F.array_append(state["licences"], rule["name"]).alias("licences"))).otherwise(state)

    def done(state: Column) -> Column:
        return F.struct(F.array_distinct(state["licences"]).alias("licences"),
                        F.filter(F.split(state["rest"], r"\|"), lambda s: ~s.isin("", "?")).alias("unmatched"))

    found = F.aggregate(steps, F.struct(rest.alias("rest"), none.alias("licences")), step, done)
    return F.when(F.exists(ids, lambda s: s != "?"), found).otherwise(
        F.struct(none.alias("licences"), none.alias("unmatched")))


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the licences of each row.

    Adds ``n_sentences`` (non-empty ones, lines joined), ``sentence_ids`` (identifiers in
    order), ``licences`` (in rule order) and ``unmatched`` (identifiers that no
    rule used).  Null and empty texts have none of either; repeated rows are
    handled alike; an empty table gives an empty one.  Columns of docs with
    these names are replaced.
    """
    added = ("n_sentences", "sentence_ids", "licences", "unmatched")
    keep = [c for c in docs.columns if c != text and c not in added]
    cut = docs.select(*keep, joined(F.col(text)).alias("_joined"))
    many = F.greatest(F.length(F.regexp_replace("_joined", "[a-z0-9 N]+", "")) - 1, F.lit(0)).cast("long")
    ids = cut.select(*keep, many.alias("n_sentences"), identifiers(F.col("_joined")).alias("_ids"))
    told = ids.select(*keep, "n_sentences", F.filter("_ids", lambda s: s != "?").alias("sentence_ids"),
                      match(F.col("_ids")).alias("_match"))
    return told.select(*keep, "n_sentences", "sentence_ids", "_match.licences", "_match.unmatched")
