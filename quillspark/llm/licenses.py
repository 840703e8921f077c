"""Operator 3 [native]: licence scans by sentence rules.

A sentence ends at a run of `.!?;:` before a separator. Each text is cut twice:
once line feeds end sentences too, so that a notice stands by itself between
other lines; once only blank lines do, so that a notice may be wrapped at any
width (marks of comments at a line's ends are no letters and vanish). A sentence
is normalised (A-Z lower-cased, each run of characters other than a-z, 0-9
becomes one space, trimmed). Known sentences map to identifiers through one
literal map; an unknown sentence becomes 0, a sentence without letters or digits
vanishes. The identifiers of a text, in order, are matched against ordered rules:
a rule is a licence and a sequence of identifiers that must stand next to each
other in one of the two cuts. The first rule that matches names the document's
licence, and all that match are listed.

Everything is column expressions over one scan, with no shuffle. Defined cases:
a null or empty text has no sentences and no licence; repeated rows are judged
one by one; texts of any length are cut whole; an empty table gives no rows;
further columns are passed over, whatever their names.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.texts import ascii_lower

# Known sentences of licences and of their notices, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: 'Licensed under the Apache License, Version 2.0 (the "License");',
    6: "you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at",
    8: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    15: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    16: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    17: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    24: "All rights reserved.",
    32: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    33: "either version 2 of the License, or (at your option) any later version.",
    34: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    35: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    36: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    37: "either version 2.1 of the License, or (at your option) any later version.",
    38: "This library is free software;",
    39: "This program is free software:",
    40: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    51: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    52: "If a copy of the MPL was not distributed with this file, You can obtain one at",
    55: "Distributed under the Boost Software License, Version 1.0.",
    56: "This is free and unencumbered software released into the public domain.",
    57: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    60: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    61: "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    62: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    63: "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    64: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    65: "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    66: "This work is dedicated to the public domain.",
}
# Ordered rules of licence, kind, identifiers that follow each other.
RULES = [
    ("apache-2.0", "permissive", (5, 6)),
    ("mit", "permissive", (10, 11)),
    ("mit", "permissive", (10, 12)),
    ("agpl-3.0-or-later", "copyleft", (39, 35)),
    ("lgpl-3.0-or-later", "copyleft", (39, 40)),
    ("lgpl-2.1-or-later", "copyleft", (38, 36, 37)),
    ("gpl-3.0-or-later", "copyleft", (39, 34)),
    ("gpl-2.0-or-later", "copyleft", (39, 32, 33)),
    ("mpl-2.0", "weak copyleft", (51,)),
    ("unlicense", "permissive", (56, 57)),
    ("isc", "permissive", (15,)),
    ("isc", "permissive", (16,)),
    ("0bsd", "permissive", (17,)),
    ("bsl-1.0", "permissive", (55,)),
    ("bsd-3-clause", "permissive", (23,)),
    ("bsd-2-clause", "permissive", (21, 22)),
    ("bsd", "permissive", (20,)),
    ("cc-by-sa-4.0", "copyleft", (62,)),
    ("cc-by-sa-4.0", "copyleft", (63,)),
    ("cc-by-nc-4.0", "non-commercial", (64,)),
    ("cc-by-4.0", "permissive", (60,)),
    ("cc-by-4.0", "permissive", (61,)),
    ("cc0-1.0", "permissive", (65,)),
    ("apache-2.0", "permissive", (1,)),
    ("apache-2.0", "permissive", (8,)),
    ("mit", "permissive", (2,)),
    ("mit", "permissive", (10,)),
    ("gpl-3.0", "copyleft", (3,)),
    ("cc-by-nc-4.0", "non-commercial", (4,)),
    ("public-domain", "permissive", (66,)),
    ("unlicense", "permissive", (56,)),
    ("proprietary", "proprietary", (24,)),
]
#: Ends of sentences: with line feeds, with blank lines.
CUT_LINES = r"[.!?;:]+[\x20\x09-\x0D]+|\n"
CUT_PARAGRAPHS = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09\x0B-\x0D]*\n"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def plain(text: str) -> str:
    """The normal form of a sentence, on the driver."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.sub("[^a-z0-9]+", " ", low).strip(" ")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """id, n_sentences, n_known, sentence_ids (`,1,0,2,`), all of the cut at line feeds, wrapped_ids (of the cut at blank lines), licence, kind, licences (all that match, in the rules' order, joined by `;`)."""
    known = F.create_map(*[x for i, s in sentences.items() for x in (F.lit(plain(s)), F.lit(i))])

    def identified(cut: str) -> Column:
        forms = F.filter(F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), cut), _plain), lambda s: s != "")
        return F.transform(forms, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)))

    def joined(ids: str) -> Column:
        return F.when(F.size(ids) > 0, F.concat(F.lit(","), F.array_join(F.col(ids).cast("array<string>"), ","), F.lit(","))).otherwise("")

    out = docs.select(F.col(id_col).alias("id"), identified(CUT_LINES).alias("ids"), identified(CUT_PARAGRAPHS).alias("wrapped"))
    out = out.select("id", F.size("ids").cast("long").alias("n_sentences"), F.size(F.filter("ids", lambda i: i > 0)).cast("long").alias("n_known"), joined("ids").alias("sentence_ids"), joined("wrapped").alias("wrapped_ids"))
    fits = lambda seq: F.col("sentence_ids").contains(seq) | F.col("wrapped_ids").contains(seq)
    hits = F.array_compact(F.array(*[F.when(fits("," + ",".join(map(str, seq)) + ","), F.lit(n)) for n, (_, _, seq) in enumerate(rules)]))
    # texts of which no sentence is known fit no rule
    some = F.col("sentence_ids").rlike("[1-9]") | F.col("wrapped_ids").rlike("[1-9]")
    out = out.withColumn("hits", F.when(some, hits).otherwise(F.array().cast("array<int>")))
    names = lambda k: F.array(*[F.lit(r[k]) for r in rules])
    first = lambda k: F.get(names(k), F.get("hits", F.lit(0)))
    all_ = F.array_distinct(F.transform("hits", lambda n: F.get(names(0), n)))
    return out.select(F.col("id").alias(id_col), "n_sentences", "n_known", "sentence_ids", "wrapped_ids", first(0).alias("licence"), first(1).alias("kind"), F.array_join(all_, ";").alias("licences"))
