"""License scans by sentences and rules.

Texts are cut into pieces at line breaks and ends of sentences, which are normalised. Pieces that follow each
other without a blank line between them and together are a known license sentence count as that sentence, so
it does not matter where its lines are wrapped and which comment signs they begin with. A rule is an
ordered list of sentence identifiers; it matches where its sentences follow each other in a text, with no
other sentence that has letters or digits between them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import with_row

# Sentences of public license texts and notices, as they stand there. {} is a name of up to ``NAME_WORDS`` words.
SENTENCES = {
    "mit-release": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-named": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "all-rights": "All rights reserved",
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {}",
    "bsd-names": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-of": "Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2",
    "gpl-2-title": "GNU General Public License Version 2, June 1991",
    "gpl-3-title": "GNU General Public License Version 3, 29 June 2007",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-2-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-2-only-as": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "gpl-3-only-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "lgpl-2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl-3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "lgpl-2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "lgpl-3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0",
    "bsl-1.0-title": "Boost Software License - Version 1.0 - August 17th, 2003",
}
#: Sentences that may carry a number or letter of a list.
LISTED = {"bsd-source", "bsd-binary", "bsd-ads", "bsd-names", "bsd-names-of", "bsd-name"}
NAME_WORDS = 16
# Rules, longest first among those that begin alike.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-2.0-named", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-named",)),
    ("Apache-2.0", ("apache-2.0",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl-3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("CC-BY-4.0", ("cc-by-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("proprietary", ("all-rights",)),
    ("MIT", ("mit-grant", "mit-notice-next", "as-is")),
    ("MIT", ("mit-grant", "mit-notice-next")),
    ("Apache-2.0", ("apache-2.0-title",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-names")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-names-of")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-of")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("MPL-1.1", ("mpl-1.1",)),
    ("MPL-2.0", ("mpl-2.0",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("GPL-2.0", ("gpl-2",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-2.0-only", ("gpl-2-only-free",)),
    ("GPL-2.0-only", ("gpl-2-only-as",)),
    ("GPL-3.0-only", ("gpl-3-only-free",)),
    ("LGPL-2.1", ("lgpl-2.1-title",)),
    ("LGPL-3.0", ("lgpl-3-title",)),
    ("LGPL-2.0-or-later", ("lgpl-2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-program",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-1.0",)),
    ("BSL-1.0", ("bsl-1.0-title",)),
]
#: A piece ends at a line break, or after . ; ! ? before white space. Version numbers have none. A comment word that
#: begins the next line belongs to the break.
END = r"(?<![\x20\x09])[\x20\x09]*+(?:\r\n?|\n)(?:[\x20\x09]*+(?i:dnl|rem)(?=[\x20\x09\r\n]))?|(?<=[.;!?])(?=[\x20\x09-\x0D])"
#: Begins a known sentence's number, and ends a piece that . ; ! ? ends; normalised texts have no such signs.
MARK, STOP = "\x01", "\x02"


def normal(sentence: Column) -> Column:
    """Lower case; runs of anything but letters and digits are one space; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _pattern(sentence: str, listed: bool) -> str:
    """A known sentence among normalised pieces: one break stands for a space anywhere in it. A name that ends it goes on
    to the end of the sentence."""
    gap, word = r"(?: |\x02?\n)", r"[^ \n\x01\x02]+"
    words = re.findall(r"\{\}|[^\W_]+", sentence.lower())
    name = word + "(?:" + gap + word + "){0,%d}?" % (NAME_WORDS - 1)
    last = word + r"(?:[ \n]" + word + r"){0,%d}?(?=\x02|\n\n)" % (NAME_WORDS - 1)
    parts = [w if w != "{}" else last if k == len(words) - 1 else name for k, w in enumerate(words)]
    return ("(?:(?:[0-9]{1,2}|[a-z]|i{1,3})" + gap + ")?" if listed else "") + gap.join(parts) + r"\x02?(?=\n)"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple]] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per match: row, doc_id, license, first_sentence, n_sentences, sentence_ids.

    Sentences count from 0 among those of the text that have letters or digits, over the whole text: a known
    sentence is one, whatever lines it stands on, and each piece outside of them is one. Where known sentences
    overlap, the longer one counts. Rules are tried in
    the order given; the first that fits at a place wins, and matching goes on behind it. Sentences that
    belong to no rule give no row. Null and empty texts match nothing; rows with one id are scanned one by
    one; an empty table gives an empty result; other columns are not looked at. The known sentences are a
    fixed list, which is why they may be sent to all tasks.
    """
    base = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row")
    names = list(sentences)
    patterns = {name: _pattern(sentence, name in LISTED) for name, sentence in sentences.items()}
    longest = sorted(names, key=lambda name: -len(patterns[name]))
    # a blank line is an empty piece, so that two breaks follow each other, which no known sentence has
    ended = lambda x: F.when(F.substring(x, -1, 1).isin(*".;!?"), F.lit(STOP)).otherwise("")
    pieces = F.array_join(F.transform(F.split("text", END), lambda x: F.concat(normal(x), ended(x))), "\n")
    texts = base.select("row", "doc_id", F.concat(F.lit("\n"), pieces, F.lit("\n")).alias("pieces"))
    texts = texts.filter(F.col("pieces").rlike("\n(?:" + "|".join(patterns[n] for n in longest) + ")"))
    for name in longest:  # most texts have none
        texts = texts.withColumn("pieces", F.regexp_replace("pieces", "(?<=\n)" + patterns[name], MARK + str(names.index(name))))
    # each text's sequence of identifiers, null where a sentence is not known
    cut = F.filter(F.split("pieces", STOP + "?\n"), lambda s: s != "")
    known = F.array(*[F.lit(name) for name in names])
    ids = texts.select("row", "doc_id", F.transform(cut, lambda s: F.when(s.startswith(MARK), F.get(known, F.substring(s, 2, 9).cast("int")))).alias("ids"))

    def rule_at(i: Column) -> Column:
        found = F.lit(None).cast("int")
        for number in range(len(rules) - 1, -1, -1):
            fits = F.lit(True)
            for k, name in enumerate(rules[number][1]):
                fits = fits & F.coalesce(F.get("ids", i + k) == name, F.lit(False))
            found = F.when(fits, F.lit(number)).otherwise(found)
        return found

    lengths = F.array(*[F.lit(len(r)) for _, r in rules])
    placed = F.filter(
        F.transform("ids", lambda x, i: F.struct(i.alias("at"), F.when(x.isNotNull(), rule_at(i)).alias("rule"))), lambda m: m["rule"].isNotNull()
    )
    # of overlapping matches the earlier one stays
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,rule:int>>").alias("found"))
    kept = F.aggregate(
        placed, start,
        lambda acc, m: F.when(
            m["at"] >= acc["free"],
            F.struct((m["at"] + F.get(lengths, m["rule"])).alias("free"), F.concat(acc["found"], F.array(m)).alias("found")),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )
    hits = ids.select("row", "doc_id", "ids", F.explode(kept).alias("m"))
    of_rule = F.array(*[F.lit(name) for name, _ in rules])
    size = F.get(lengths, F.col("m.rule"))
    return hits.select(
        "row", "doc_id", F.get(of_rule, F.col("m.rule")).alias("license"), F.col("m.at").cast("long").alias("first_sentence"),
        size.cast("long").alias("n_sentences"), F.slice("ids", F.col("m.at") + 1, size).alias("sentence_ids"),
    )
