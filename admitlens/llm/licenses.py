"""Licence scans: known licence sentences, then rules over the order in which they stand.

A text is cut into sentences; a sentence is normalised and looked up in a table of known ones, which gives a sequence of
sentence identifiers. A rule is an ordered sequence of identifiers and names a licence. Of rules that match at overlapping places the
longest counts. DataFrame functions only; the tables are ordinary DataFrames, however many sentences they hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from admitlens.llm.common import text_of, two_hashes

# Sentences of public licences and of the usual notices that name them.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-name": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "v2-later": "either version 2 of the License, or (at your option) any later version.",
    "v3-later": "either version 3 of the License, or (at your option) any later version.",
    "lgpl-free": "This library is free software;",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "v21-later": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "agpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies."
    ),
    "isc-grant-and": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies."
    ),
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-dedicated": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
    ),
    "cc0-name": "CC0 1.0 Universal",
    "bsd-numbered-source": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "spdx": "SPDX-License-Identifier:",
}

# Licence identifiers and the names that notices use for them.
NAMES = {
    "MIT": ["MIT License", "MIT licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 License", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 License", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
LEADS = ["Released under", "Licensed under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under"]
SUFFIXED = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]  # whose identifiers end in -only or -or-later

# Licence and its ordered sentences, one line per rule.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    ("MIT", ["mit-name", "mit-grant", "mit-keep", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "v2-later"]),
    ("GPL-2.0-only", ["gpl-free", "gpl2-only"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "v3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "v21-later"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy-s"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("CC0-1.0", ["cc0-name"]),
]


def _plain(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def notices() -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
    """(sentence identifier, sentence) and rules of the usual one-line notices and of SPDX lines, from the names of the licences."""
    known, seen, rules = [], {_plain(v) for v in SENTENCES.values()}, []

    def add(name: str, sentence: str) -> None:
        if _plain(sentence) not in seen:
            seen.add(_plain(sentence))
            known.append((name, sentence))

    for license_, names in NAMES.items():
        for name in names:
            for lead in LEADS:
                add(f"notice {license_}", f"{lead} {name}.")
                add(f"notice {license_}", f"{lead} the {name}.")
        rules.append((license_, [f"notice {license_}"]))
        for identifier in [f"{license_}-only", f"{license_}-or-later"] if license_ in SUFFIXED else [license_]:
            add(f"spdx {identifier}", identifier)
            rules.append((identifier, ["spdx", f"spdx {identifier}"]))
    return known, rules


ALL_SENTENCES = [*SENTENCES.items(), *notices()[0]]
ALL_RULES = [*RULES, *notices()[1]]

_ENDS = r"[.;:!?]+[\x20\x09-\x0D]+"
_BLANK_LINE = r"\n[\x20\x09-\x0D]*\n"


def normal(sentence: Column) -> Column:
    """Letters A-Z in lower case; every run of other characters than letters and digits is one blank; ends trimmed."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def _literal_rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A small table whose size Spark knows, so that its own size check broadcasts it."""
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sentence_table(spark: SparkSession, sentences: list[tuple[str, str]] | None = None) -> DataFrame:
    """(sentence, known): normalised sentence and identifier. Sentences of one identifier are variants of one another; a sentence has one identifier."""
    rows = [F.struct(F.lit(k).alias("known"), F.lit(raw).alias("raw")) for k, raw in sentences or ALL_SENTENCES]
    return _literal_rows(spark, rows).groupBy(normal(F.col("raw")).alias("sentence")).agg(F.min("known").alias("known"))


def rule_table(spark: SparkSession, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(license, sequence)."""
    rows = [F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, ids)).alias("sequence")) for name, ids in rules or ALL_RULES]
    return _literal_rows(spark, rows)


def recognised(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, t, part, line, known): known sentences of each distinct (doc_id, text hash t), by part and line.

    A sentence may run over several lines of a paragraph, or be a paragraph or line of its own without punctuation before it.
    """
    parts = docs.select("doc_id", F.xxhash64(text_of()).alias("t"), F.posexplode(F.split(text_of(), _ENDS)).alias("part", "body"))
    with_lines = lambda p: F.when(F.contains(p, F.lit("\n")), F.concat(F.array(p), F.split(p, "\n"))).otherwise(F.array(p))
    pieces = F.flatten(F.transform(F.split("body", _BLANK_LINE), with_lines))
    lines = parts.select("doc_id", "t", "part", F.posexplode(pieces).alias("line", "raw"))
    hashed = lambda c: [h.alias(n) for h, n in zip(two_hashes(c), ("h1", "h2"))]  # noqa: E731  shuffled instead of the sentences
    keyed = lines.select("doc_id", "t", "part", "line", normal(F.col("raw")).alias("sentence")).select("doc_id", "t", "part", "line", *hashed(F.col("sentence")))
    return keyed.join(sentences.select(*hashed(F.col("sentence")), "known"), ["h1", "h2"]).drop("h1", "h2").distinct()


def license_matches(docs: DataFrame, sentences: DataFrame, rules: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, t, license, first, last, n): the rules that match, places as positions among the recognised sentences.

    Between neighbouring sentences of a rule at most `gap` unknown parts may stand. A match within a longer one doesn't count; of
    rules that match the same sentences the first name counts.
    """
    hits = recognised(docs, sentences)
    row = W.partitionBy("doc_id", "t").orderBy("part", "line", "known")
    longest = rules.agg(F.max(F.size("sequence"))).first()[0] or 1
    ahead = lambda c: F.array(*[F.lead(c, k).over(row) for k in range(longest)])
    seen = hits.select("doc_id", "t", F.row_number().over(row).alias("first"), F.col("known").alias("head"), ahead("known").alias("ids"), ahead("part").alias("parts"))
    led = rules.select("license", "sequence", F.get("sequence", F.lit(0)).alias("head"), F.size("sequence").alias("n"))
    near = F.forall(F.sequence(F.lit(1), F.col("n")), lambda k: (k >= F.col("n")) | (F.get("parts", k) - F.get("parts", k - 1) <= gap + 1))
    same = F.slice("ids", F.lit(1), F.col("n")) == F.col("sequence")
    found = seen.join(led, "head").filter(same & near).select("doc_id", "t", "license", "first", (F.col("first") + F.col("n") - 1).alias("last"), "n")
    before = W.partitionBy("doc_id", "t").orderBy("first", F.desc("last"), "license").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("reached", F.max("last").over(before)).filter(F.col("reached").isNull() | (F.col("last") > F.col("reached"))).drop("reached")


def licenses_of(docs: DataFrame, sentences: DataFrame, rules: DataFrame, gap: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, n_matches and licenses, their names in the order of first appearance, without repeats.

    A null or empty text has none. Repeated rows get equal results; a null doc_id is a document like others; other columns are
    not read. An empty table gives no rows.
    """
    matches = license_matches(docs, sentences, rules, gap)
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first", "license"))), lambda x: x["license"]))
    found = matches.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n_matches"), names.alias("licenses"))
    found = found.select(F.col("doc_id").alias("id"), F.col("t").alias("found_t"), "n_matches", "licenses")
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("t"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("found_t")), "left")
    return joined.select("doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
