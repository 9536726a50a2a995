"""Lines of reserved rights and whole licence files."""

from lodestone.llm import license_scan


def test_reserved_and_files(spark):
    files = license_scan.whole_texts()
    rows = [(0, "Some text.\nAll rights reserved.\nmore"), (1, "All rights reserved."), (2, "Copyright 2020 X. All rights reserved."), (3, "All rights reserved by X, 2020"), (4, "Copyright (c) 2020, X\nAll rights reserved.\n\n" + files["BSD-3-Clause"][0])]
    rows += [(10 + i, files[n][0]) for i, n in enumerate(("Apache-2.0", "GPL-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause"))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(4)] == ["all-rights-reserved", "all-rights-reserved", "", ""]
    assert got[4].whole_license == "BSD-3-Clause"
    assert [got[10 + i].whole_license for i in range(5)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause"]
