"""Sentence rules on small texts."""

import pytest

from emberlog.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."


@pytest.fixture
def scan(docs):
    return lambda *texts: [(r.sentence_ids, r.licenses) for r in licenses.scan_licenses(docs(list(enumerate(texts)))).orderBy("doc_id").collect()]


def test_sequences_in_order_with_others_between(scan):
    (ids, found), (_, swapped) = scan(f"Some code.\n{MIT}\n{NOTICE}\nMore.", f"{NOTICE}\n{MIT}")
    assert ids == ["mit-grant", "mit-notice"] and [x.split(":")[0].lower() for x in found] == ["mit"]
    assert swapped != found


def test_case_and_punctuation_do_not_matter(scan):
    a, b = scan("Licensed under the Apache License, Version 2.0.", "LICENSED under the  apache license version 2.0;")
    assert a[0] == b[0] == ["apache-under"]


def test_null_empty_and_plain_texts(scan):
    assert scan(None, "", "the license of a driver is no license at all. Licensed to drive.") == [([], [])] * 3


def test_clashing_names_and_empty_tables(spark, docs):
    df = docs([(1, "Released under the MIT License.")]).selectExpr("*", "1 AS licenses", "2 AS Sentence_ids")
    out = licenses.scan_licenses(df)
    assert out.columns == [*df.columns, "_sentence_ids", "_licenses"]
    assert out.first()._sentence_ids == ["mit-under"] and out.first()._licenses == ["MIT:reference"] and out.first().licenses == 1
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_a_rule_hides_those_that_ask_for_less(scan):
    two, three = (licenses.SENTENCES[k][0] for k in ("bsd-redistribute", "bsd-endorse"))
    assert [x for _, x in scan(f"{two}\n{three}", two, three)] == [["BSD-3-Clause:text"], ["BSD-2-Clause:text"], []]
    assert licenses.hiding((("A", "x", ("p", "q")), ("B", "y", ("p",)), ("C", "z", ("p", "r"))), 1) == [("p", "q")]


def test_wrapped_texts(scan):
    import textwrap

    apache = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
    wrapped = textwrap.fill(MIT, 72) + "\n\n" + textwrap.fill(NOTICE, 72)
    gpl = licenses._free("", "2")[1]
    mpl = licenses.MORE_SENTENCES["mpl-subject"][0]
    texts = [apache, wrapped, "Copyright (c) 2020 Someone\n" + wrapped]
    texts += ["\n".join(lead + x for x in t.split("\n")) for t in (apache, wrapped) for lead in ("# ", " * ", ";; ", "// ")]
    found = [x for _, x in scan(*texts, textwrap.fill(gpl, 60), textwrap.fill(mpl, 40))]
    assert found[1:3] == [["MIT:text"]] * 2 and found[7:11] == [["MIT:text"]] * 4
    assert found[0] == ["Apache-2.0:notice"] and found[3:7] == [["Apache-2.0:notice"]] * 4
    assert found[11:] == [["GPL-2.0-or-later:notice"], ["MPL-2.0:notice"]]


def test_every_known_sentence_is_found_alone_but_not_across_blank_lines(scan):
    pairs = [(k, s) for t in (licenses.SENTENCES, licenses.MORE_SENTENCES) for k, ss in t.items() for s in ss]
    assert [ids for ids, _ in scan(*[s for _, s in pairs])] == [[k] for k, _ in pairs]
    assert scan("All rights\n\nreserved.", "Released under\n\nthe MIT License.") == [([], [])] * 2


def test_spdx_lines_and_references_by_name(scan):
    texts = {
        "// SPDX-License-Identifier: Apache-2.0": ["Apache-2.0:spdx"],
        "# SPDX-License-Identifier: GPL-2.0-only\n# SPDX-License-Identifier: MIT": ["GPL-2.0-only:spdx", "MIT:spdx"],
        "Foo is licensed under the MIT license.": ["MIT:reference"],
        "This font is available under the terms of the SIL Open Font License 1.1.": ["OFL-1.1:reference"],
        "Foo and Bar are\nreleased under the\nMozilla Public\nLicense 2.0.": ["MPL-2.0:reference"],
        "Released under the MIT License.": ["MIT:reference"],
        "This work is in the public domain.": ["public-domain:statement"],
        "We drove under the bridge.": [],
        "It is licensed under the MIT license or so": [],
    }
    assert [x for _, x in scan(*texts)] == list(texts.values())
    assert len(licenses.NAMES) >= 40 and all(licenses.by_name().values())


def test_wrapped_texts_equal_plain_python(scan):
    """Sentences at random, wrapped and led at random, found by plain Python: a sentence is what lies between blank lines here."""
    import random
    import textwrap

    rng = random.Random(12)
    every = [(k, s) for t in (licenses.SENTENCES, licenses.MORE_SENTENCES) for k, ss in t.items() for s in ss]
    last = {licenses.normalized(s): k for k, s in every}
    texts, want = [], []
    for _ in range(60):
        picked = [rng.choice(every)[1] if rng.random() < 0.7 else "Words of no licence at all." for _ in range(rng.randint(0, 6))]
        lead = rng.choice(["", "# ", " * ", "// ", "-- "])
        blocks = [textwrap.fill(p, rng.choice([30, 50, 72, 200]), break_long_words=False, break_on_hyphens=False) for p in picked]
        texts.append("\n".join((lead + x).rstrip() if x else "" for x in "\n\n".join(blocks).split("\n")))
        want.append([last[n] for p in picked if (n := licenses.normalized(p)) in last])
    assert [ids for ids, _ in scan(*texts)] == want


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, licenses.query(spark, sf).collect())) == sorted(con.execute(licenses.SQL).fetchall())


def test_marks_do_not_depend_on_spaces(scan):
    texts = ["All rights  reserved.", "All rights\treserved.", "All rights-reserved."]
    assert scan(*texts) == [(["reserved"], ["reserved:reference"])] * 3
    assert all(any(m in s for m in licenses.MARKS) for s in licenses.every_known())


def test_repeated_rows_and_sentences_and_very_long_texts(docs):
    under = "Released under the MIT License."
    long = "\n".join(["plain words of no licence, and more of them."] * 40_000 + [under] + ["and on it goes"] * 40_000 + [under])
    rows = [(1, under), (1, under), (None, under), (2, "\n".join([under] * 3)), (3, long), (4, "word " * 300_000 + "\n" + under)]
    got = sorted((str(r.doc_id), len(r.sentence_ids), set(r.sentence_ids), len(r.licenses)) for r in licenses.scan_licenses(docs(rows)).collect())
    one = {"mit-under"}
    assert got == [("1", 1, one, 1), ("1", 1, one, 1), ("2", 3, one, 1), ("3", 2, one, 1), ("4", 1, one, 1), ("None", 1, one, 1)]
