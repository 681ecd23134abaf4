import textwrap

import pytest
from pyspark.sql import functions as F

from typetrace.llm import licences


def scan(spark, docs):
    return sorted(map(tuple, licences.scan_licences(docs, licences.known_licences(spark)).collect()), key=repr)


def test_texts_and_notices(spark, docs_of):
    mit = "Copyright (c) 2020 Someone\n\n" + licences.TEXTS["MIT"].replace(" ", "  ").upper() + "\nAll rights reserved."
    rows = [(1, mit), (2, "Text.\nReleased under the MIT Licence!!\nlicensed under CC BY-NC 4.0"), (3, "Released under the MIT License"), (4, "It was released under the MIT License."),
            (5, None), (6, ""), (7, "© 2020"), (8, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"), (9, "word " * 200_000 + "\nISC License"), (9, "ISC License"), (None, "MIT")]
    want = [(1, "MIT", 0, "MIT"), (2, "CC-BY-NC-4.0,MIT", 2, None), (3, "MIT", 1, "MIT"), (4, "", 0, None), (5, "", 0, None), (6, "", 0, None), (7, "", 0, None),
            (8, "MIT", 2, None), (9, "ISC", 2, "ISC"), (9, "ISC", 2, "ISC"), (None, "MIT", 1, "MIT")]
    assert scan(spark, docs_of(rows)) == sorted(want, key=repr)


def test_empty_table(spark, docs_of):
    assert scan(spark, docs_of([(1, "x")]).filter("false")) == []


def test_equivalent_spellings_are_one(spark):
    one, two = (r[0] for r in spark.createDataFrame([("The Licence, for NonCommercial   use",), ("the license for non-commercial use.",)], "t string").select(licences.canonical(F.col("t"))).collect())
    assert one == two == " the license for non commercial use "


@pytest.mark.parametrize("width", [60, 72, 79])
def test_usual_files_wrapped(spark, docs_of, width):
    """Whole files with title, copyright line and wrapped text; wrapping may begin a line with the word copyright."""
    rows, want = [], []
    for i, (name, text) in enumerate(sorted(licences.TEXTS.items())):
        body = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n"))
        for k, title in enumerate(("", *licences.NAMES.get(name, ()), *licences.TITLES.get(name, ()))):
            for j, line in enumerate(("Copyright (c) 2020, Some One", "Copyright 1999-2004 some one. All rights reserved.", "Copyright Some One", "")):
                rows.append((1000 * i + 10 * k + j, f"{title}\n\n{line}\n\n{body}\n"))
                want.append((rows[-1][0], name))
    assert [(r[0], r[3]) for r in sorted(scan(spark, docs_of(rows)))] == want


def test_a_changed_text_is_not_whole(spark, docs_of):
    text = licences.TEXTS["BSD-3-Clause"]
    rows = [(1, text.replace("holder nor", "holder or")), (2, text + "\nOne more condition."), (3, "copyright notice and this permission notice\nMIT License"), (4, "Apache License Version 2.0, January 2004")]
    assert scan(spark, docs_of(rows)) == [(1, "", 0, None), (2, "", 0, None), (3, "MIT", 1, None), (4, "Apache-2.0", 1, "Apache-2.0")]


def test_only_copyright_lines_leave_a_text(spark):
    texts = ["Copyright 2020 X\nabc", "COPYRIGHT HOLDERS BE LIABLE", "copyright notice", "(c) X", "Copyright Jane", "copyright by X", "a copyright 2020"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licences.canonical(F.col("t"))).collect()]
    assert got == [" abc ", " copyright holders be liable ", " copyright notice ", "  ", "  ", "  ", " a copyright 2020 "]
