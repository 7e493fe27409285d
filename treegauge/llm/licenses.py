"""Licence scans by sentence rules; DataFrame functions only.

A text is normalised as a whole (lower case, runs of other signs than a-z and 0-9 to one space, or to one mark where
a sentence, a line or a list mark ends). Known licence sentences are looked for from one mark to another, over any marks inside them,
so it does not matter where a notice is wrapped or which comment signs stand before its lines. The identifiers found, in the order of
the text, are matched against licence rules, each an ordered list of identifiers with anything known
between them. One narrow stage: whole texts are read once and nothing is shuffled.

Null and empty texts have no sentences and no licence. Repeated rows give repeated results. Other
columns are not read. An empty table gives an empty result.

The SQL twin is the narrower rule of one sentence a line, without `MORE_SENTENCES`; on the given tables, whose notices
stand so, both agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen

#: Sentences as published with the licences; fixed values. The key is the identifier, one letter.
SENTENCES = {
    "a": "Licensed under the Apache License, Version 2.0.",
    "b": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "c": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "d": "See the License for the specific language governing permissions and limitations under the License.",
    "e": "Released under the MIT License.",
    "f": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "g": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "h": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "i": "This work is licensed under the GNU General Public License, version 3.",
    "j": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "k": "You should have received a copy of the GNU General Public License along with this program.",
    "l": "Licensed under CC BY-NC 4.0.",
    "m": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "n": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "o": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "p": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "q": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "r": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "s": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Notices of further licences, which the SQL twin does not know.
MORE_SENTENCES = {
    "A": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "B": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "C": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "D": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "E": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "F": "This is free and unencumbered software released into the public domain.",
    "G": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "H": "Distributed under the Boost Software License, Version 1.0.",
}

#: (licence, identifiers in order). The first rule that matches names the licence of a text.
RULES = (
    ("Apache-2.0", "bcd"), ("Apache-2.0", "bc"), ("Apache-2.0", "a"),
    ("MIT", "fgh"), ("MIT", "fg"), ("MIT", "e"),
    ("GPL-3.0-or-later", "jk"), ("GPL-3.0-or-later", "j"), ("GPL-3.0-only", "i"),
    ("CC-BY-NC-4.0", "m"), ("CC-BY-NC-4.0", "l"), ("CC-BY-4.0", "n"),
    ("BSD-3-Clause", "opq"), ("BSD-2-Clause", "oq"),
    ("MPL-2.0", "rs"), ("MPL-2.0", "r"),
)

MORE_RULES = (
    ("GPL-2.0-or-later", "A"), ("LGPL-2.1-or-later", "B"), ("LGPL-3.0-or-later", "C"), ("AGPL-3.0-or-later", "D"),
    ("ISC", "E"), ("Unlicense", "F"), ("Zlib", "G"), ("BSL-1.0", "H"),
)


def normalised(sentence: str) -> str:
    """The form that sentences are looked up by."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _pieces(sentence: str) -> list[str]:
    """A known sentence as the splitter of the SQL twin sees it: one that holds a stop and a space comes apart."""
    return [normalised(p) for p in re.sub(r"([.!?])\s+", r"\1\n", sentence).split("\n")]


#: For the SQL twin: known sentences by their normalised first piece, which its splitter always leaves whole.
KNOWN = {_pieces(s)[0]: key for key, s in SENTENCES.items()}
if len(KNOWN) != len(SENTENCES):
    raise ValueError("two licence sentences start alike")


#: All known sentences whole, longer ones first.
WHOLE = {normalised(s): key for key, s in sorted((SENTENCES | MORE_SENTENCES).items(), key=lambda pair: -len(pair[1]))}
_FIND = "(?<=\n)(?:" + "|".join(s.replace(" ", "[ \n]") for s in WHOLE) + ")(?=\n)"
#: Ends of sentences, with quotes and brackets that close there, colons, and brackets of list marks.
_END = r"[.!?:;][\"')\]]{0,3}(?=\s)|(?<=[^a-z0-9][a-z0-9]{1,3})\)(?=\s)|[\r\n]"
_COMMENT_WORDS = r"(?m)^[ \t]{0,40}(?:rem|dnl)(?=[ \t])"


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, as one string."""
    plain = F.replace(F.regexp_replace(F.lower(text), _COMMENT_WORDS, ""), F.lit("https://"), F.lit("http://"))
    marked = F.concat(F.lit("\n"), F.regexp_replace(plain, _END, "\n"), F.lit("\n"))
    clean = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    known = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    hits = F.regexp_extract_all(clean, F.lit(_FIND), F.lit(0))
    return F.coalesce(F.concat_ws("", F.transform(hits, lambda s: F.element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))), F.lit(""))


def _pattern(rule: str) -> str:
    return ".*".join(rule)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_sentences known, sentence_ids, licenses (all, in rule order), license (the first)."""
    rows = chosen(docs, doc_id=doc_id, text=text).select("doc_id", identifiers(F.col("text")).alias("sentence_ids"))
    found = F.array_distinct(F.array_compact(F.array(
        *[F.when(F.col("sentence_ids").rlike(_pattern(rule)), F.lit(name)) for name, rule in RULES + MORE_RULES])))
    return (
        rows.withColumn("found", found)
        .select("doc_id", F.length("sentence_ids").cast("bigint").alias("n_sentences"), "sentence_ids",
                F.concat_ws(",", "found").alias("licenses"), F.get("found", F.lit(0)).alias("license"))
    )


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, '{key}')" for s, key in KNOWN.items())
    rules = ", ".join(f"({n}, {quoted(name)}, '{_pattern(rule)}')" for n, (name, rule) in enumerate(RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
rules(n, name, pattern) AS (VALUES {rules}),
split AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM
  (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents)),
hits AS (SELECT doc_id, string_agg(id, '' ORDER BY pos) AS ids FROM split
  JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY doc_id),
ided AS (SELECT d.doc_id, coalesce(ids, '') AS ids FROM documents d LEFT JOIN hits USING (doc_id)),
matched AS (SELECT doc_id, name, min(n) AS n FROM ided JOIN rules ON regexp_matches(ids, pattern) GROUP BY doc_id, name),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY n) AS licenses, arg_min(name, n) AS license FROM matched GROUP BY doc_id)
SELECT i.doc_id, CAST(length(ids) AS BIGINT) AS n_sentences, ids AS sentence_ids, coalesce(licenses, '') AS licenses, license
FROM ided i LEFT JOIN named USING (doc_id)"""


SQL = _sql()
