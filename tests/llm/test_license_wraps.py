"""Licence files in any wrapping, with and without title and holder."""

import random
import textwrap

import pytest

from lodestone.llm import license_scan

BODY = {n: [t for t in ts if len(t) > 400] for n, ts in (license_scan.KNOWN | license_scan.whole_texts()).items()}
HOLDER = ["Copyright (c) 2020 Someone", "Copyright 2019-2021 Acme Inc.", "Copyright Acme", "(c) 2001 X", "© Someone Else", "Copyright: the holder 2020\nAll rights reserved."]


def wrapped(text, width, rnd):
    """The paragraphs of a text set anew, lines of a holder left alone."""
    paragraphs = [p for p in text.split("\n\n") if p.strip()]
    return "\n\n".join(p if "<year>" in p or "[yyyy]" in p or "Copyright (" in p else textwrap.fill(" ".join(p.split()), width + rnd.randint(-9, 9), break_long_words=False, break_on_hyphens=False) for p in paragraphs)


@pytest.mark.parametrize("name", sorted(n for n, ts in BODY.items() if ts))
def test_wrapped_files(spark, name):
    rnd = random.Random(name)
    rows = []
    for text in BODY[name]:
        for _ in range(12):
            own = wrapped(text, rnd.randint(40, 110), rnd)
            rows.append((len(rows), rnd.choice(HOLDER) + "\n\n" + own if rnd.random() < 0.5 else own))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.whole_license for r in got} == {name}


def test_isc_as_it_is_usually_set(spark):
    text = """Copyright (c) 2004-2010 by Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
    rows = [(1, text), (2, text.split("\n\n", 1)[1]), (3, "a\n" + text)]
    got = {r.doc_id: r.whole_license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ISC", 2: "ISC", 3: None}
