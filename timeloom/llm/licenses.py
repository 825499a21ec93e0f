"""Licence recognition by sentences and rules, in DataFrame functions alone.

A text is cut into sentences; a sentence whose normalised form is known has an identifier; the sequence of identifiers
is matched against an ordered list of rules, each of which names a licence and takes its identifiers out of the sequence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normalised form (see normal()) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "http www apache org licenses license 2 0": "apache2-url",
    "released under the apache license version 2 0": "apache2-short",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "distributed under the mit license": "mit-short",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-copy-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-disclaimer",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-modify",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-modify",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-modify",
    "either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-made",
    "and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-made",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "distributed under the boost software license version 1 0": "boost-short",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under the isc license": "isc-short",
    "licensed under the gnu general public license version 2": "gpl2-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-modify",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "subject to the terms of the mozilla public license v 2 0": "mpl2-short",
    "licensed under the mozilla public license version 2 0": "mpl2-short",
    "licensed under cc by 4 0": "ccby4-short",
    "licensed under cc by sa 4 0": "ccbysa4-short",
    "licensed under cc by nd 4 0": "ccbynd4-short",
    "licensed under cc by nc 4 0": "ccbync4-short",
    "licensed under cc by nc sa 4 0": "ccbyncsa4-short",
    "licensed under cc by nc nd 4 0": "ccbyncnd4-short",
    "licensed under a creative commons attribution 4 0 international license": "ccby4-short",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-short",
    "released into the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Identifiers of the licence list that texts name after "SPDX-License-Identifier:".
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 W3C WTFPL Zlib"
).split()
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): f"spdx-{x}" for x in SPDX}
# Rules in the order in which they are tried; longer sequences stand before their parts.
RULES = [
    ("Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy")),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-head",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-short",)),
    ("GPL-2.0-or-later", ("gpl-modify", "gpl2-later", "gpl-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl3-modify", "gpl-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl3-modify",)),
    ("AGPL-3.0-or-later", ("agpl3-modify",)),
    ("LGPL-2.1-or-later", ("lgpl-modify", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("lgpl-modify", "gpl3-later")),
    ("LGPL", ("lgpl-modify",)),
    ("GPL-2.0-or-later", ("gpl-modify", "gpl2-later")),
    ("GPL-3.0-or-later", ("gpl-modify", "gpl3-later")),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("LGPL-3.0-only", ("lgpl3-short",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("GPL", ("gpl-modify",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("EPL-2.0", ("epl2-made",)),
    ("EPL-1.0", ("epl1-made",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("WTFPL", ("wtfpl-copy",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC-BY-4.0", ("ccby4-short",)),
    ("CC-BY-SA-4.0", ("ccbysa4-short",)),
    ("CC-BY-ND-4.0", ("ccbynd4-short",)),
    ("CC-BY-NC-4.0", ("ccbync4-short",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-short",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4-short",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("LicenseRef-proprietary", ("reserved",)),
    *((x, (f"spdx-{x}",)) for x in SPDX),
]
#: Every known sentence has one of these stems; a sentence without any is not looked up.
STEMS = r"licen[sc]|permi|redistrib|warrant|copyright|reserved|public\s+domain|terms\s+of|any\s+later\s+version"
#: A subject in front of a known sentence is no part of it.
SUBJECT = "^(this|the) (work|software|file|project|program|document|code|library|page|text) (is |was |has been )?|^(it )?is "
#: The mark of a licence's identifier is one sentence with what follows it.
MARK = "(?i)(spdx-license-identifier):"
_BREAK = r"([.!?;:])[ \t\r\f]+"
#: A line that a known sentence begins on begins with one of these words, its own first ones and those of subjects.
FIRST = "^(" + "|".join(sorted({s.split(" ")[0] for s in SENTENCES} | {"this", "the", "it", "is"})) + ")( |$)"
#: No known sentence with its subject is longer.
LONGEST = max(map(len, SENTENCES)) + len("this documentation has been ")
#: Nor does any have so many words, each of which may stand on a line of its own.
MOST_LINES = max(s.count(" ") for s in SENTENCES) + 5


def words(line: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 a space."""
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))


def _runs(lines: Column, known: Column) -> Column:
    """All runs of lines that together are a known sentence: structs of first line ``i``, last line ``j`` and ``id``, by
    first line, longer ones first."""
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(FIRST))

    def of(i: Column) -> Column:
        near = F.slice(lines, i, F.lit(MOST_LINES))
        # how many lines are no longer together than the longest sentence
        none = F.struct(F.lit(0).alias("length"), F.lit(0).alias("n"))
        add = lambda acc, w: F.struct((acc["length"] + F.length(w) + 1).alias("length"), (acc["n"] + (acc["length"] + F.length(w) <= LONGEST).cast("int")).alias("n"))
        reach = F.aggregate(near, none, add)["n"]
        said = lambda n: F.regexp_replace(F.array_join(F.slice(lines, i, n), " "), SUBJECT, "")
        runs = F.transform(F.sequence(reach, F.lit(1)), lambda n: F.struct(i.alias("i"), (i + n - 1).alias("j"), F.try_element_at(known, said(n)).alias("id")))
        return F.when(reach > 0, runs).otherwise(F.array().cast("array<struct<i:int,j:int,id:string>>"))

    return F.filter(F.flatten(F.transform(starts, of)), lambda r: r["id"].isNotNull())


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``sentence_ids`` (known sentences in order), ``licenses`` (sorted, distinct) and
    ``n_unknown`` (lines with a stem that are in no known sentence).

    Lines end at line ends and behind punctuation. A known sentence may be one line or any run of lines that together
    read like it, wherever it is wrapped; of sentences within one another the longest counts. Null and empty texts have
    empty lists and 0. Repeated rows are read one by one, rows without an id like others, and further columns are ignored
    whatever their names. Of licences with equal sentences the first rule's counts. An empty table gives an empty result.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    text = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), MARK, "$1")
    none = F.array().cast("array<string>")
    cut = F.split(F.regexp_replace(text, _BREAK, "$1\n"), "\n")
    said = F.filter(F.transform(cut, lambda x: F.struct(words(x).alias("w"), F.lower(x).rlike(STEMS).alias("stem"))), lambda x: x["w"] != "")
    lines = docs.select(F.col(id_column).alias("__id"), F.when(F.lower(text).rlike(STEMS), said).otherwise(F.array().cast("array<struct<w:string,stem:boolean>>")).alias("__lines"))
    found = lines.withColumn("__runs", F.when(F.size("__lines") > 0, _runs(F.col("__lines.w"), known)).otherwise(F.array().cast("array<struct<i:int,j:int,id:string>>")))
    # a longer run around a run begins no later and few runs before it, as no line begins more than a handful
    near = lambda p: F.slice("__runs", F.greatest(p + 1 - 8 * MOST_LINES, F.lit(1)), F.least(p, F.lit(8 * MOST_LINES)))
    kept = found.withColumn("__kept", F.filter("__runs", lambda r, p: ~F.exists(near(p), lambda q: q["j"] >= r["j"])))
    covered = F.flatten(F.transform("__kept", lambda r: F.sequence(r["i"], r["j"])))
    stems = F.filter(F.transform("__lines", lambda x, n: F.when(x["stem"], n + 1)), lambda n: n.isNotNull())
    ids = kept.select("__id", F.col("__kept.id").alias("sentence_ids"), F.size(F.array_except(stems, covered)).alias("n_unknown"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(parts)).alias("parts")) for name, parts in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(F.transform("sentence_ids", lambda x: F.concat(x, F.lit("|"))), "|")).alias("left"), none.alias("found"))
    matched = F.aggregate(
        rules,
        start,
        lambda acc, r: F.when(
            F.contains(acc["left"], r["parts"]),
            F.struct(F.replace(acc["left"], r["parts"], F.lit("|")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found")),
        ).otherwise(acc),
        lambda acc: F.array_sort(F.array_distinct(acc["found"])),
    )
    return ids.select(F.col("__id").alias(id_column), "sentence_ids", F.when(F.size("sentence_ids") > 0, matched).otherwise(none).alias("licenses"), "n_unknown")


def _sequence(parts: tuple[str, ...]) -> str:
    return "|" + "||".join(parts) + "|"
