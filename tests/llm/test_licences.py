from __future__ import annotations

from gradus.llm import licences


def test_whole_texts_and_lines(spark):
    mit = licences.LICENCES["MIT"]
    texts = [
        None, "", "...", mit, "Copyright (c) 2020 A. Holder\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ;"), mit + " and more",
        "prose\nreleased under the MIT Licence\nmore\nLicensed under CC BY-NC 4.0.\nLicensed under cc by nc 4.0", "x " * 200_000,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, licence string")
    rows = licences.scan_licences(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 2 * len(texts)
    assert [got[i].licence for i in range(len(texts))] == [None, None, None, "MIT", "MIT", None, None, None]
    assert got[0].digest is None and got[1].digest == got[2].digest and got[3].digest == got[4].digest
    assert (got[6].n_notices, got[6].notices) == (3, "CC-BY-NC-4.0-notice,MIT-notice") and got[0].n_notices == 0
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_equal_texts_are_one_licence(spark):
    got = licences.registry(spark, {"b": "Some  text", "a": "some text."}).collect()
    assert [r.licence for r in got] == ["a"]


def test_common_licences(spark):
    known = licences.common()
    assert len(licences._texts(known)) <= 10_000
    texts = [known[k][0] for k in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib")]
    texts += ["BSD 3-Clause License\n\nCopyright (c) 2020, A. Holder\n\n" + licences.LICENCES["BSD-3-Clause"], "ISC License\n\n" + licences.LICENCES["ISC"], "x\nLicensed under CC BY 4.0.\ny\n// SPDX-License-Identifier: Apache-2.0", "Licensed under nothing."]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).collect()}
    assert [got[i].licence for i in range(11)] == ["Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSD-3-Clause", "ISC", None, None]
    assert got[9].notices == "Apache-2.0-notice,CC-BY-4.0-notice" and got[10].n_notices == 0
