"""License scans by sentence rules.

A text is cut at sentence ends and blank lines and normalised; known
licence sentences are found between the cuts, on lines of their own or wrapped, and the sequence of
identifiers found is matched against ordered rules: a rule names identifiers that must follow one another, with
others between them allowed. Of the rules of a licence, and of rules that ask for
what a longer one asks for, the first that matches is reported. Everything happens within a row, as DataFrame functions.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, table

#: Known licence sentences by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-under": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "This project is licensed under the Apache License 2.0.",
    ),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-obtain": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "mit-under": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl3-under": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
    ),
    "gpl-redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    "bsd-redistribute": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "reserved": ("All rights reserved.",),
}

#: Rules in order: licence, rule, identifiers in sequence.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "notice", ("apache-under", "apache-comply", "apache-obtain")),
    ("Apache-2.0", "reference", ("apache-under",)),
    ("MIT", "text", ("mit-grant", "mit-notice")),
    ("MIT", "grant", ("mit-grant",)),
    ("MIT", "reference", ("mit-under",)),
    ("GPL-3.0-or-later", "notice", ("gpl-redistribute", "gpl-warranty")),
    ("GPL-3.0-only", "reference", ("gpl3-under",)),
    ("BSD-3-Clause", "text", ("bsd-redistribute", "bsd-endorse")),
    ("BSD-2-Clause", "text", ("bsd-redistribute",)),
    ("CC-BY-NC-4.0", "reference", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", "reference", ("cc-by-sa",)),
    ("CC-BY-4.0", "reference", ("cc-by",)),
    ("reserved", "reference", ("reserved",)),
)

_FREE = (
    "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License "
    "as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version."
)


def _free(name: str, version: str) -> tuple[str, ...]:
    return tuple(_FREE.format(what=w, a=a, b=b, name=name, version=version) for w in ("program", "library") for a, b in (":,", ";;"))


#: Further sentences and rules, which the SQL does not know.
MORE_SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-obtain": ("You may obtain a copy of the License at",),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "gpl-redistribute": _free("", "3"),
    "gpl2-redistribute": _free("", "2"),
    "lgpl21-redistribute": _free("Lesser ", "2.1"),
    "lgpl3-redistribute": _free("Lesser ", "3"),
    "agpl-redistribute": _free("Affero ", "3"),
    "mpl-subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "isc-grant": tuple(
        f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
        for x in ("and", "and/or")
    ),
    "bsd-warranty": tuple(
        f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {x} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
        for x in ("HOLDERS AND CONTRIBUTORS", "HOLDER AND CONTRIBUTORS", "HOLDERS OR CONTRIBUTORS")
    ),
}
MORE_SENTENCES |= {
    "gpl2-only": tuple(
        f"This program is free software{x} you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
        for x in (";", ":")
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ),
    "domain": ("This work is in the public domain.", "This file is in the public domain.", "This software is in the public domain.", "This code is in the public domain."),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "bsl-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:",
    ),
    "epl-under": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "ofl-under": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "wtfpl-copy": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ),
}

#: Licences by SPDX identifier, and the names by which texts refer to them (licensed, released, ... under the NAME).
NAMES: dict[str, tuple[str, ...]] = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "AFL-3.0": ("Academic Free License 3.0",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "AGPL-3.0-or-later": (),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL"),
    "CDDL-1.1": (),
    "CECILL-2.1": ("CeCILL License, version 2.1",),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.1": ("European Union Public Licence 1.1",),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "GFDL-1.3-or-later": ("GNU Free Documentation License, Version 1.3",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL v2"),
    "GPL-2.0-or-later": (),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL v3"),
    "GPL-3.0-or-later": (),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-2.1-or-later": (),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-3.0-or-later": (),
    "LPPL-1.3c": ("LaTeX Project Public License 1.3c",),
    "MIT": ("MIT License", "MIT license"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, v. 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "MS-RL": ("Microsoft Reciprocal License",),
    "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2", "Mulan PSL v2"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "ODbL-1.0": ("Open Database License 1.0", "Open Database License"),
    "OFL-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    "OSL-3.0": ("Open Software License 3.0",),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License", "PSF License"),
    "UPL-1.0": ("Universal Permissive License v1.0",),
    "Unlicense": ("Unlicense",),
    "Vim": ("Vim License",),
    "W3C": ("W3C Software Notice and License",),
    "WTFPL": ("WTFPL",),
    "X11": ("X11 License",),
    "ZPL-2.1": ("Zope Public License 2.1",),
    "Zlib": ("zlib License",),
}
#: Identifiers of sentences that need no rule: SPDX lines, and references by name.
SPDX, REFERENCE = "spdx-", "ref-"
MORE_SENTENCES |= {f"{SPDX}{k}": (f"SPDX-License-Identifier: {k}",) for k in NAMES}
#: What stands before the name in a reference: up to six words of its line, a verb, and under.
LEAD = r"(?:[a-z0-9]+ ){0,6}?(?:licensed|released|distributed|available|published|provided|redistributed)[ \n]under[ \n](?:the[ \n])?(?:terms[ \n]of[ \n](?:the[ \n])?)?"
MORE_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("GPL-2.0-or-later", "notice", ("gpl2-redistribute",)),
    ("GPL-3.0-or-later", "grant", ("gpl-redistribute",)),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-redistribute",)),
    ("LGPL-3.0-or-later", "notice", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", "notice", ("agpl-redistribute",)),
    ("MPL-2.0", "notice", ("mpl-subject",)),
    ("ISC", "grant", ("isc-grant",)),
    ("GPL-2.0-only", "notice", ("gpl2-only",)),
    ("Unlicense", "text", ("unlicense",)),
    ("CC0-1.0", "text", ("cc0",)),
    ("public-domain", "statement", ("domain",)),
    ("Zlib", "text", ("zlib-warranty", "zlib-grant")),
    ("BSL-1.0", "text", ("bsl-grant",)),
    ("EPL-2.0", "notice", ("epl-under",)),
    ("OFL-1.1", "notice", ("ofl-under",)),
    ("WTFPL", "text", ("wtfpl-copy",)),
)

#: Every known sentence contains one of these; texts without any are not cut up.
MARKS = ("licen", "permission", "redistribut", "reserved", "copyright", "endorse", "warranty", "public domain", "permitted", "under")
END = r"([.!?;:])[\x20\x09-\x0D]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def normalized(sentence: str) -> str:
    """As the column: a-z and 0-9 in lower case, anything else one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known() -> dict[str, str]:
    return {normalized(s): key for key, ss in SENTENCES.items() for s in ss}


def hiding(rules: tuple[tuple[str, str, tuple[str, ...]], ...], i: int) -> list[tuple[str, ...]]:
    """Identifiers of the rules that hide rule i where they match: earlier ones of its licence, or of any that ask for all that it asks for."""
    licence, _, own = rules[i]
    return [ids for other, _, ids in rules[:i] if other == licence or set(own) <= set(ids)]


def rule_pattern(ids: tuple[str, ...]) -> str:
    return "(^|,)" + "(,[^,]+)*,".join(ids) + "(,|$)"


def cut_up(text: str) -> str:
    """As the column's cut: words, | for sentence ends and blank lines, and newlines."""
    low = re.sub(END, "|", text.translate(str.maketrans(UPPER, LOWER)))
    return re.sub(" *([\n|]) *", r"\1", re.sub("[^a-z0-9\n|]+", " ", low)).strip(" ")


def every_known() -> dict[str, str]:
    """Identifier by normalised sentence; ends within a sentence are spaces too."""
    return known() | {normalized(s): key for key, ss in MORE_SENTENCES.items() for s in ss}


def sentence_pattern() -> str:
    """The known sentences, longest first, between ends or line breaks and wrapped anywhere."""
    whole = {cut_up(s) for ss in [*SENTENCES.values(), *MORE_SENTENCES.values()] for s in ss}
    each = sorted(whole, key=lambda s: (-len(s), s))
    loose = lambda s: re.sub("[ |]", lambda m: "[ \n]" if m[0] == " " else "[ \n|]", s)
    names = sorted({cut_up(n) for ns in NAMES.values() for n in ns}, key=lambda s: (-len(s), s))
    return f"(?<![^\n|])({'|'.join(map(loose, each))}|{LEAD}(?:{'|'.join(map(loose, names))}))(?![^\n|])"


def by_name() -> dict[str, str]:
    """Identifier of a reference by the normalised name."""
    return {normalized(n): f"{REFERENCE}{k}" for k, ns in NAMES.items() for n in ns}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a whole text, in order; null and other texts: none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER + "|", LOWER + " ")
    bare = F.regexp_replace(low, "(^|\n)[^a-z0-9\n]+", "$1")  # comment leaders and indents
    cut = F.regexp_replace(F.regexp_replace(bare, END, "|"), "[^a-z0-9\n|]+", " ")
    cut = F.regexp_replace(F.trim(F.regexp_replace(cut, " *([\n|]) *", "$1")), "\n\n+", "|")
    lookup = F.create_map(*[F.lit(x) for pair in every_known().items() for x in pair])

    names = F.create_map(*[F.lit(x) for pair in by_name().items() for x in pair])

    def find(s: Column) -> Column:
        plain = F.regexp_replace(s, "[\n|]+", " ")
        name = F.regexp_replace(plain, f"^{LEAD}".replace("[ \n]", " "), "")
        return F.coalesce(F.try_element_at(lookup, plain), F.try_element_at(names, name))

    marked = low.rlike("|".join(MARKS))
    found = F.transform(F.regexp_extract_all(cut, F.lit(sentence_pattern()), F.lit(1)), find)
    return F.when(marked, found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids (array) and licenses (array of licence:rule, in rule order); _ goes before these names where docs has them.

    A sentence starts and ends at a line's ends, at a blank line, or at
    . ! ? ; : before white space; within, it may be wrapped over lines, each
    with a comment leader. Null,
    empty and unmarked texts have no licence; repeated rows are judged alike;
    sentences repeated in a text count as often. Nothing is shuffled.
    """
    ids_col, licences_col = free_name(docs, "sentence_ids"), free_name(docs, "licenses")
    docs = docs.withColumn(ids_col, sentence_ids(F.col(text_col)))
    joined = F.array_join(ids_col, ",")
    hits = []
    rules = RULES + MORE_RULES
    for i, (licence, rule, ids) in enumerate(rules):
        hit = joined.rlike(rule_pattern(ids))
        for r in hiding(rules, i):
            hit = hit & ~joined.rlike(rule_pattern(r))
        hits.append(F.when(hit, F.lit(f"{licence}:{rule}")))
    # lines and references that name a licence, each once, where no rule has found it
    told = F.filter(F.array_distinct(ids_col), lambda i: i.startswith(SPDX) | i.startswith(REFERENCE))
    told = F.transform(told, lambda i: F.when(i.startswith(SPDX), F.concat(F.substring(i, F.lit(len(SPDX) + 1), F.length(i)), F.lit(":spdx"))).otherwise(F.concat(F.substring(i, F.lit(len(REFERENCE) + 1), F.length(i)), F.lit(":reference"))))
    docs = docs.withColumn(licences_col, F.array_compact(F.array(*hits)))
    licence = lambda x: F.substring_index(x, ":", 1)
    new = F.filter(told, lambda t: ~F.exists(F.col(licences_col), lambda h: licence(h) == licence(t)))
    return docs.withColumn(licences_col, F.concat(licences_col, new))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: licence sentences and licences of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    pairs = ", ".join(f"('{s}', '{k}')" for s, k in known().items())
    cases = []
    for i, (licence, rule, ids) in enumerate(RULES):
        hit = f"regexp_matches(ids, '{rule_pattern(ids)}')"
        hit += "".join(f" AND NOT regexp_matches(ids, '{rule_pattern(r)}')" for r in hiding(RULES, i))
        cases.append(f"CASE WHEN {hit} THEN '{licence}:{rule}' END")
    return f"""
WITH known(sentence, id) AS (VALUES {pairs}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '{END}', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents
), each AS (
  SELECT doc_id, p, trim(regexp_replace(s[p], '[^a-z0-9]+', ' ', 'g'), ' ') AS sentence
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM cut)
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY p) AS ids FROM each JOIN known USING (sentence) GROUP BY doc_id
), all_docs AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(ids, '') AS ids FROM documents d LEFT JOIN found USING (doc_id)
)
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, concat_ws(',', {", ".join(cases)}) AS licenses FROM all_docs
"""


SQL = _sql()
