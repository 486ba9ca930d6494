"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at line ends and after sentence marks. Pieces are normalised (lower case, numbers
as 0, everything but letters as single spaces) and looked up among known licence sentences; up to four pieces
in a row are tried together. All of these sentences, and those of the published licences, their headers and
SPDX tags (`PUBLISHED`), are found in the joined pieces as well, so however many lines they are wrapped over or
commented, and as parts of longer sentences. The identifiers of a text, in order, form a sequence; ordered rules
turn runs of it into licences, longer runs first. A version number in a sentence becomes part of the licence.

Everything happens within a row: no shuffle, no join, no Python. Texts without any of the words that all
known sentences contain one of are not cut up; others are scanned whole, however long.

Null and empty texts have no licences. Null ids stay null. Repeated rows give repeated rows, and sentences that
are repeated in a text are reported as often. An empty table gives an empty result. Only doc_id and text are read,
so other columns, also such with the names of results, change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, and their identifiers: fixed values.
SENTENCES = {
    "licensed under the apache license version 0": "APACHE_NOTICE",
    "this project is licensed under the apache license version 0": "APACHE_NOTICE",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "this work is licensed under the gnu general public license version 0": "GPL_NOTICE",
    "this program is licensed under the gnu general public license version 0": "GPL_NOTICE",
    "licensed under the gnu general public license version 0": "GPL_NOTICE",
    "this program is free software": "GPL_FREE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL_TERMS",
    "licensed under the gnu lesser general public license version 0": "LGPL_NOTICE",
    "licensed under the gnu affero general public license version 0": "AGPL_NOTICE",
    "released under the mit license": "MIT_NOTICE",
    "licensed under the mit license": "MIT_NOTICE",
    "this project is licensed under the mit license": "MIT_NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_KEEP",
    "the software is provided as is without warranty of any kind": "MIT_WARRANTY",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
    "licensed under cc by 0": "CC_BY",
    "licensed under cc by sa 0": "CC_BY_SA",
    "licensed under cc by nd 0": "CC_BY_ND",
    "licensed under cc by nc 0": "CC_BY_NC",
    "licensed under cc by nc sa 0": "CC_BY_NC_SA",
    "licensed under cc by nc nd 0": "CC_BY_NC_ND",
    "this work is licensed under a creative commons attribution 0 international license": "CC_BY",
    "this work is licensed under a creative commons attribution sharealike 0 international license": "CC_BY_SA",
    "this work is licensed under a creative commons attribution noncommercial 0 international license": "CC_BY_NC",
    "this source code form is subject to the terms of the mozilla public license v 0": "MPL_NOTICE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ISC_GRANT",
}

#: Every known sentence contains one of these.
CUES = ("licens", "copyright", "permission", "redistribut", "free software", "without warranty")

#: Runs of identifiers and the licence they state, in the order of trial; + takes the first one's version.
RULES = (
    (("MIT_GRANT", "MIT_KEEP", "MIT_WARRANTY"), "MIT"),
    (("MIT_GRANT", "MIT_KEEP"), "MIT"),
    (("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"), "BSD-3-Clause"),
    (("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"), "BSD-2-Clause"),
    (("APACHE_NOTICE", "APACHE_COMPLY", "APACHE_COPY"), "Apache-+"),
    (("APACHE_NOTICE", "APACHE_COMPLY"), "Apache-+"),
    (("GPL_FREE", "GPL_TERMS"), "GPL"),
    (("APACHE_NOTICE",), "Apache-+"),
    (("GPL_NOTICE",), "GPL-+"),
    (("LGPL_NOTICE",), "LGPL-+"),
    (("AGPL_NOTICE",), "AGPL-+"),
    (("MIT_NOTICE",), "MIT"),
    (("MIT_GRANT",), "MIT"),
    (("CC_BY",), "CC-BY-+"),
    (("CC_BY_SA",), "CC-BY-SA-+"),
    (("CC_BY_ND",), "CC-BY-ND-+"),
    (("CC_BY_NC",), "CC-BY-NC-+"),
    (("CC_BY_NC_SA",), "CC-BY-NC-SA-+"),
    (("CC_BY_NC_ND",), "CC-BY-NC-ND-+"),
    (("MPL_NOTICE",), "MPL-+"),
    (("ISC_GRANT",), "ISC"),
)
WINDOW = 4

_IS = "(?:this (?:project|program|software|work|file) is )?"
_GNU = "you can redistribute (?:it|them) and or modify (?:it|them) under the terms of {}the gnu {}general public license{} as published by the free software foundation"
_DATE = "(?:[0-9]+ )?(?:january|february|june|november) [0-9]+"


def _gnu(kind: str, id: str) -> list[tuple[str, str]]:
    """Header sentences and title of a licence of the GNU family."""
    terms = _GNU.format("", kind, "")
    return [
        (terms + " either version # of the license or at your option any later version", f"{id}_LATER"),
        (terms + " version #", f"{id}_ONLY"),
        (_GNU.format("version # of ", kind, ""), f"{id}_ONLY"),
        (_GNU.format("", kind, " version #"), f"{id}_ONLY"),
        (f"{_IS}licensed under the gnu {kind}general public license version #", f"{id}_NOTICE"),
        (f"gnu {kind}general public license version # {_DATE}", f"{id}_NOTICE"),
    ]


def _creative_commons() -> list[tuple[str, str]]:
    parts = {"BY": "", "BY_SA": " share ?alike", "BY_ND": " no ?deriv(?:ative)?s", "BY_NC": " non ?commercial", "BY_NC_SA": " non ?commercial share ?alike", "BY_NC_ND": " non ?commercial no ?deriv(?:ative)?s"}
    names = [(f"{_IS}licensed under (?:a|the) creative commons attribution{p} # (?:international|unported|generic)", f"CC_{k}") for k, p in parts.items()]
    return names + [(f"{_IS}licensed under cc {k.lower().replace('_', ' ')} #", f"CC_{k}") for k in parts]


#: Names of licences in SPDX tags, as words, and as they are reported; # is a version: fixed values.
SPDX = (
    ("mit", "MIT"), ("isc", "ISC"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("0bsd", "0BSD"), ("apache #", "Apache-+"), ("bsd 2 clause", "BSD-2-Clause"), ("bsd 3 clause", "BSD-3-Clause"),
    ("mpl #", "MPL-+"), ("epl #", "EPL-+"), ("bsl #", "BSL-+"), ("cc0 #", "CC0-+"), ("cc by #", "CC-BY-+"), ("cc by sa #", "CC-BY-SA-+"), ("cc by nc #", "CC-BY-NC-+"), ("cc by nd #", "CC-BY-ND-+"),
    *((f"{k} #{end}", f"{k.upper()}-+{name}") for k in ("gpl", "lgpl", "agpl") for end, name in ((" only", ""), (" or later", "-or-later"), ("(?! only)(?! or later)", ""))),
)


def _spdx() -> list[tuple[str, str]]:
    """Tags and the identifiers SPDX_A, SPDX_B ... of their licences."""
    return [(f"spdx license identifier {words}", f"SPDX_{chr(65 + k)}") for k, (words, _) in enumerate(SPDX)]


#: Sentences of the published texts and headers as patterns of words, and their identifiers; # is a version.
PUBLISHED = [
    (f"{_IS}licensed under the apache license version #", "APACHE_NOTICE"),
    (f"apache license version # {_DATE}", "APACHE_NOTICE"),
    ("you may not use (?:this file|these files|this work) except in compliance with the license", "APACHE_COMPLY"),
    ("you may obtain a copy of the license at", "APACHE_COPY"),
    (f"(?:{_IS}licensed|released) under the mit license", "MIT_NOTICE"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MIT_GRANT"),
    ("the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "MIT_KEEP"),
    ("the software is provided as is without warranty of any kind", "MIT_WARRANTY"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BSD_GRANT"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BSD_SOURCE"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BSD_BINARY"),
    ("neither the names? of (?:[a-z0-9.]+ ){1,20}?nor the names of (?:its|other) contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSD_NAMES"),
    ("the names? of (?:[a-z0-9.]+ ){1,20}?may not be used to endorse or promote products derived from this software without specific prior written permission", "BSD_NAMES"),
    *_gnu("", "GPL"),
    *_gnu("(?:lesser|library) ", "LGPL"),
    *_gnu("affero ", "AGPL"),
    *_creative_commons(),
    ("this source code form is subject to the terms of the mozilla public license v #", "MPL_NOTICE"),
    ("mozilla public license version # 1 definitions", "MPL_NOTICE"),
    ("permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "ISC_GRANT"),
    ("this program is free software", "GPL_FREE"),
    (_GNU.format("", "", "") + "(?! version)(?! either version)", "GPL_TERMS"),
    *_spdx(),
]

#: Rules of the identifiers that only published sentences have.
PUBLISHED_RULES = tuple(((f"{i}_{kind}",), f"{i}-+{end}") for i in ("GPL", "LGPL", "AGPL") for kind, end in (("LATER", "-or-later"), ("ONLY", ""))) + tuple(((i,), name) for (_, i), (_, name) in zip(_spdx(), SPDX))


def _lookup(key: str) -> str:
    """SQL: the identifier of a normalised sentence; both engines read it."""
    return f"CASE {key} " + " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items()) + " END"


def _rule(ids: tuple[str, ...], name: str, group: str) -> tuple[str, str]:
    """Pattern of a run such as <A:1><B:> and what replaces it."""
    first, *rest = ids
    return f"<{first}:([0-9.]*)>" + "".join(f"<{i}:[0-9.]*>" for i in rest), "{" + name.replace("+", group) + "}"


def _sequence() -> str:
    """Spark SQL: identifiers with versions of a row's pieces, in order, as one string."""
    joined = ["element_at(k, i + 1)"] + [f"array_join(slice(k, i + 1, {n}), ' ')" for n in range(2, WINDOW + 1)]
    tries = ", ".join([f"({_lookup(joined[0])})"] + [f"CASE WHEN i + {n} <= size(k) THEN ({_lookup(joined[n - 1])}) END" for n in range(2, WINDOW + 1)])
    return f"transform(k, (x, i) -> CASE WHEN x = '' THEN NULL ELSE coalesce({tries}) END)"


def _pattern(sentence: str) -> str:
    """Regular expression of a sentence in pieces that are joined by |; its number, if any, is group 1."""
    number = "([0-9]+(?:[.][0-9]+)*)"
    return "(?<![a-z0-9.])" + sentence.replace(" ?", "~").replace(" ", "[ |]+").replace("~", "[ |]*").replace("#", number) + "(?![a-z0-9.])"


def _published(pieces: str):
    """Column: the text of each piece after the marks <identifier:version> of the published sentences in it."""
    words = rf"transform({pieces}, x -> trim(regexp_replace(regexp_replace(x, '[^a-z0-9.]+', ' '), '(?<![0-9])[.]+|[.]+(?![0-9])', ' ')))"
    text = F.expr(f"array_join({words}, '|')")
    for sentence, id in PUBLISHED:
        text = F.regexp_replace(text, _pattern(sentence), f"<{id}:{'$1' if '#' in sentence else ''}>$0")
    return F.split(text, "[|]")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, n_licenses, sentence_ids) of every row; lists are joined by semicolons."""
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.lower("text").contains(c)
    pieces = F.split(F.regexp_replace("text", r"([.!?;:])[ \t]+", "$1\n"), "\n")
    df = docs.select("doc_id", F.when(cue, F.transform(pieces, F.lower)).otherwise(F.array().cast("array<string>")).alias("p"))
    df = df.select("doc_id", "p", F.expr(r"transform(p, x -> trim(regexp_replace(regexp_replace(x, '[0-9]+([.][0-9]+)*', '0'), '[^a-z0]+', ' ')))").alias("k"))
    df = df.select("doc_id", "p", F.expr(_sequence()).alias("ids"), _published("p").alias("m"))
    own = "transform(ids, (x, i) -> concat('<', x, ':', regexp_extract(array_join(slice(p, i + 1, 4), ' '), '[0-9]+(?:[.][0-9]+)*', 0), '>'))"
    other = "filter(regexp_extract_all(t, '<[A-Z_]+:[0-9.]*>', 0), y -> o IS NULL OR split_part(y, ':', 1) <> split_part(o, ':', 1))"
    # zip_with: a lambda that picked from m would work m out again for each piece
    df = df.select("doc_id", F.expr(f"flatten(zip_with({own}, m, (o, t) -> concat(filter(array(o), z -> z IS NOT NULL), {other})))").alias("marks"))
    df = df.select("doc_id", F.expr("array_join(marks, '')").alias("seq"), F.expr("array_join(transform(marks, y -> regexp_extract(y, '[A-Z_]+', 0)), ';')").alias("sentence_ids"))
    found = F.coalesce("seq", F.lit(""))
    for ids, name in RULES + PUBLISHED_RULES:
        found = F.regexp_replace(found, *_rule(ids, name, "$1"))
    df = df.select("doc_id", F.regexp_extract_all(found, F.lit(r"\{([^}]*)\}"), 1).alias("found"), F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"))
    return df.select("doc_id", F.array_join("found", ";").alias("licenses"), F.size("found").cast("long").alias("n_licenses"), "sentence_ids")


def _duckdb() -> str:
    """The lookup of whole pieces only, without the published sentences within longer or wrapped ones."""
    joined = ["k[i]"] + [f"array_to_string(k[i:i + {n - 1}], ' ')" for n in range(2, WINDOW + 1)]
    tries = ", ".join([f"({_lookup(joined[0])})"] + [f"CASE WHEN i + {n - 1} <= len(k) THEN ({_lookup(joined[n - 1])}) END" for n in range(2, WINDOW + 1)])
    found = "seq"
    for ids, name in RULES:
        pattern, to = _rule(ids, name, r"\1")
        found = f"regexp_replace({found}, '{pattern}', '{to}', 'g')"
    cue = " OR ".join(f"contains(lower(text), '{c}')" for c in CUES)
    return rf"""
WITH cut AS (
  SELECT doc_id, CASE WHEN {cue} THEN list_transform(string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: lower(x)) ELSE [] END AS p FROM documents
), keyed AS (
  SELECT doc_id, p, list_transform(p, lambda x: trim(regexp_replace(regexp_replace(x, '[0-9]+([.][0-9]+)*', '0', 'g'), '[^a-z0]+', ' ', 'g'))) AS k FROM cut
), named AS (
  SELECT doc_id, p, list_transform(range(1, len(k) + 1), lambda i: CASE WHEN k[i] = '' THEN NULL ELSE coalesce({tries}) END) AS ids FROM keyed
), marked AS (
  SELECT doc_id,
    coalesce(array_to_string(list_filter(list_transform(range(1, len(ids) + 1), lambda i: '<' || ids[i] || ':' || regexp_extract(array_to_string(p[i:i + 3], ' '), '[0-9]+([.][0-9]+)*') || '>'), lambda x: x IS NOT NULL), ''), '') AS seq,
    coalesce(array_to_string(list_filter(ids, lambda x: x IS NOT NULL), ';'), '') AS sentence_ids FROM named
), ruled AS (
  SELECT doc_id, regexp_extract_all({found}, '\{{([^}}]*)\}}', 1) AS found, sentence_ids FROM marked
)
SELECT doc_id, array_to_string(found, ';') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses, sentence_ids FROM ruled
"""


ORACLE = _duckdb()
