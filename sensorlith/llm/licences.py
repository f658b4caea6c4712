"""Licence scans by sentence rules, with DataFrame functions only.

Texts are split into sentences and normalised (A-Z in lower case, runs of other characters than letters and digits as one
space). Marks and line breaks end a sentence; successive lines that only together are a known sentence, as in wrapped texts
and comments, are one too, unless a mark or a blank line stands between them. A sentence that is known gets its identifier, and a document is left with the sequence of identifiers
and their places. Rules are ordered lists of identifiers; a rule is found where its sentences follow each other
with at most ``GAP`` unknown ones between two. Where a longer rule's place covers a shorter one's, the longer stays.

A sentence over several lines has the number of its first line where it starts and of its last where it ends; of unknown
text each line counts.

Results in special cases: null and empty texts and those without a known sentence have no rows; a known sentence
that no rule begins with gives none either; repeated rows give their rows each; null ids are scanned and
reported as null; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 2

# Sentences of public licence texts and notices, and the orders in which they stand for a licence.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-under": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software",
    "gpl3-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
}
RULES: dict[str, tuple[tuple[str, ...], ...]] = {
    "MIT": (("mit-notice",), ("mit-under",), ("mit-grant", "mit-condition"), ("mit-grant", "mit-condition", "as-is")),
    "Apache-2.0": (("apache-notice",), ("apache-header",), ("apache-header", "apache-may-not", "apache-copy"), ("apache-header", "apache-may-not", "apache-copy", "apache-url")),
    "GPL-3.0-only": (("gpl3-notice",),),
    "GPL-3.0-or-later": (("gpl-free", "gpl3-or-later"), ("gpl-free", "gpl3-or-later", "gpl-hope")),
    "GPL-2.0-or-later": (("gpl-free", "gpl2-or-later"), ("gpl-free", "gpl2-or-later", "gpl-hope")),
    "BSD-2-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary"),),
    "BSD-3-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"),),
    "CC-BY-NC-4.0": (("cc-by-nc-4-notice",),),
    "CC-BY-4.0": (("cc-by-4-notice",), ("cc-by-4-long",)),
    "CC-BY-SA-4.0": (("cc-by-sa-4-notice",),),
    "CC0-1.0": (("cc0-notice",),),
    "MPL-2.0": (("mpl2-notice",),),
    "Unlicense": (("unlicense",),),
    "LicenseRef-all-rights-reserved": (("all-rights",),),
}

_SENTENCE_END = "[.!?;:]+[ \t\r\n\f]+"
_OTHER = "[^a-z0-9\n]+"
_BREAK = " ?\n[ \n]*"
_FULL_BREAK = " ?\n ?\n[ \n]*"


def _normal(sentence: str) -> str:
    lower = "".join(c.lower() if c.isascii() else c for c in sentence)
    return " ".join("".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in lower).split())


#: what a wrapped sentence may have in its first line, and the words of the longest
_OPENINGS = sorted({" ".join(words[:n]) for words in (_normal(s).split() for s in SENTENCES.values()) for n in range(1, len(words))})
_LONGEST = max(len(_normal(s).split()) for s in SENTENCES.values())


def _marked(text: Column) -> Column:
    """Normalised text with a line break at each line's end, and two or more at a mark or blank line."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(folded, _SENTENCE_END, "\n\n"), _OTHER, " ")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once for each row: it would be made again wherever it is named."""
    return F.transform(F.array(value), use)[0]


def _wrapped(lines: Column) -> Column:
    """array<struct<place, end, id>> of the known sentences that go over several lines, the longest at each place."""
    table = F.array(*(F.struct(F.lit(_normal(s)).alias("norm"), F.lit(name).alias("id")) for name, s in SENTENCES.items()))

    def longest(text: Column, i: Column) -> Column:
        def here(k: Column) -> Column:
            size = F.length(k["norm"])
            breaks = size - F.length(F.translate(F.substring(text["rest"], F.lit(1), size), "\n", ""))
            return F.struct(size.alias("size"), i.alias("place"), (i + breaks).alias("end"), k["id"].alias("id"))

        fits = F.filter(table, lambda k: text["flat"].startswith(k["norm"]) & F.substring(text["rest"], F.length(k["norm"]) + 1, F.lit(1)).isin("", "\n"))
        return F.array_max(F.transform(fits, here))

    def at(line: Column, i: Column) -> Column:
        # the words that may belong to a sentence from here on, with their line breaks and without
        rest = F.ltrim(F.array_join(F.slice(lines, i + 1, F.lit(_LONGEST)), "\n"), F.lit("|"))
        both = lambda rest: F.struct(rest.alias("rest"), F.translate(rest, "\n", " ").alias("flat"))
        return F.when(F.ltrim(line, F.lit("|")).isin(_OPENINGS), _once(_once(rest, both), lambda text: longest(text, i)))

    every = F.filter(F.transform(lines, at), lambda x: x["end"] > x["place"])
    return F.transform(every, lambda x: F.struct(x["place"].alias("place"), x["end"].alias("end"), x["id"].alias("id")))


def _identified(lines: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (_normal(s), name)))
    every = F.transform(lines, lambda s, i: F.struct(i.alias("place"), i.alias("end"), F.element_at(known, F.ltrim(s, F.lit("|"))).alias("id")))
    single = F.filter(every, lambda x: x["id"].isNotNull())

    def merged(wrapped: Column) -> Column:
        # what lies within a longer place is a part of it
        part = lambda x: F.exists(wrapped, lambda w: (w["place"] <= x["place"]) & (w["end"] >= x["end"]) & (w["end"] - w["place"] > x["end"] - x["place"]))
        return F.when(F.size(wrapped) > 0, F.filter(F.array_sort(F.concat(single, wrapped)), lambda x: ~part(x))).otherwise(single)

    return _once(_wrapped(lines), merged)


def identified(text: Column) -> Column:
    """array<struct<place, end, id>> of the known sentences, with the numbers of their first and last line."""
    # a line after a full break starts with a bar, which no known sentence has
    lines = F.split(F.regexp_replace(_marked(text), _FULL_BREAK, "\n|"), _BREAK)
    return _once(F.transform(lines, lambda s: F.trim(s)), _identified)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, first_sentence, last_sentence (numbers from 0) and sentences (of the rule) of each rule found."""
    spark = docs.sparkSession
    rules = [(licence, list(rule), rule[0]) for licence, of in RULES.items() for rule in of]
    rules = spark.createDataFrame(rules, "licence string, rule array<string>, opens string")
    longest = max(len(rule) for of in RULES.values() for rule in of)
    # a number of its own for each row: ids may be null or repeat
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), identified(F.col("text")).alias("found")).where(F.size("found") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: F.slice("found", i, F.lit(longest)))
    rows = rows.select("doc_id", "row", F.explode(runs).alias("run")).withColumn("opens", F.col("run")[0]["id"])
    rows = rows.join(F.broadcast(rules), "opens").withColumn("run", F.expr("slice(run, 1, size(rule))"))
    near = F.forall(F.sequence(F.lit(1), F.size("run")), lambda i: (i == 1) | (F.element_at("run", i)["place"] - F.element_at("run", F.greatest(i - 1, F.lit(1)))["end"] <= GAP + 1))
    rows = rows.where((F.col("run")["id"] == F.col("rule")) & near)
    rows = rows.select("doc_id", "row", "licence", F.col("run")[0]["place"].alias("first_sentence"), F.element_at("run", -1)["end"].alias("last_sentence"), F.size("rule").alias("sentences"))
    # longer places first at each start: a later row that ends no further, and is shorter, lies within one before
    before = Window.partitionBy("row").orderBy("first_sentence", F.col("last_sentence").desc(), F.col("sentences").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cover = F.max(F.struct("last_sentence", "sentences")).over(before)
    rows = rows.withColumn("cover", cover)
    inside = (F.col("cover.last_sentence") >= F.col("last_sentence")) & (F.col("cover.sentences") > F.col("sentences"))
    return rows.where(F.coalesce(~inside, F.lit(True))).drop("cover", "row")
