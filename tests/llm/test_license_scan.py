"""Licence scan: known texts in other spellings, and what must not match."""

import pytest

from lakeaudit.llm import license_scan as L


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.licenses, r.n_units, r.whole) for r in L.scan(df, L.known_digests(spark)).orderBy("doc_id").collect()]


def test_spellings_of_one_text(spark):
    mit = dict(L.KNOWN)["MIT"] and L.KNOWN[0][1]
    odd = "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence").replace("\n\n", "\n")
    assert found(spark, [mit, odd, "© 2019 X\r\n\r\n" + mit.replace("\n", "\r\n")]) == [("MIT", 1, True), ("MIT", 1, True), ("MIT", 1, True)]


def test_lines_and_paragraphs(spark):
    isc = dict(L.KNOWN)["ISC"]
    assert found(spark, [
        "Some prose.\nLicensed under the Apache Licence, Version 2.0.\nMore.",
        "SPDX-License-Identifier: MIT\ncode\nlicensed under CC BY-NC 4.0!",
        "x\n\nReleased under the MIT License.\n\ny", "Licensed under the Apache License, Version 2.0 or another", "no permission here",
        "prose\n" + isc, None, "", " \n", "Copyright 2020 all rights reserved license"]) == [
        ("Apache-2.0", 1, False), ("CC-BY-NC-4.0,MIT", 2, False), ("MIT", 1, False), ("", 0, False), ("", 0, False),
        ("", 0, False), ("", 0, False), ("", 0, False), ("", 0, False), ("", 0, False)]


def test_every_known_text_is_found(spark):
    got = found(spark, [t for _, t in L.KNOWN])
    assert all(name in licenses.split(",") and whole for (name, _), (licenses, _, whole) in zip(L.KNOWN, got))


def test_known_texts_need_a_marker(spark):
    with pytest.raises(ValueError):
        L.known_digests(spark, [("X", "do what you like")])


def test_large_known_table_is_not_broadcast(spark, edge_docs):
    spark.conf.set("spark.lakeaudit.broadcastMaxRows", "0")
    try:
        assert found(spark, ["Released under the MIT License."]) == [("MIT", 1, True)]
    finally:
        spark.conf.unset("spark.lakeaudit.broadcastMaxRows")


def test_edge_rows(spark, edge_docs, no_docs):
    known = L.known_digests(spark)
    out = L.scan(edge_docs, known)
    assert out.count() == edge_docs.count() and out.where("licenses <> ''").count() == 0
    assert L.scan(no_docs, known).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License"), (None, "z"), (3, "Licensed under CC BY 4.0")], "doc_id long, text string")
    assert sorted(r.licenses for r in L.scan(twice, known).collect()) == ["CC-BY-4.0", "MIT", "MIT"]


def test_published_texts_titles_and_bullets(spark):
    from lakeaudit.llm.license_texts import TEXTS

    isc, bsd = dict(L.KNOWN)["ISC"], next(t for n, t in L.KNOWN if n == "BSD-3-Clause" and "Neither" in t and "copyright holder" in t)
    bullets = "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    texts = dict(TEXTS)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    got = found(spark, [*texts.values(), texts["Apache-2.0"].partition("   APPENDIX")[0], bullets, "The ISC License\n\nCopyright X\n\n" + isc])
    assert [g[0] for g in got] == [*texts, "Apache-2.0", "BSD-3-Clause", "ISC"]
    assert all(whole for _, _, whole in got)
    assert found(spark, [texts["GPL-3.0"].replace("Everyone is permitted", "Nobody is permitted")])[0] == ("", 0, False)


def test_licences_in_comments(spark):
    """Hand-made files: each line behind the signs of a comment, the copyright
    line among them."""
    mit = L.KNOWN[1][1]
    title = ["MIT License", "", "Copyright (c) 2021 Some Body <a@b.c>", ""]
    lines = title + mit.split("\n")
    files = ["\n".join(f"{sign} {x}".rstrip() for x in lines) for sign in ("#", "//", "--", ";;", "%", " *")]
    files.append("/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */")
    files.append("# Copyright 2020 X\n# All rights reserved.\n#\n" + "\n".join("# " + x for x in mit.split("\n")))
    files.append("# Copyright 2020 X\n" + mit)
    assert found(spark, files) == [("MIT", 1, True)] * len(files)
    # a line that says more is not dropped
    assert found(spark, ["Copyrighted material\n" + mit, "see copyright (c) 2020\n" + mit]) == [("", 0, False)] * 2


def test_canonical_forms_by_hand(spark):
    rows = [("# Copyright 2020 X\nSub-License, the  WORK!", "sublicense the work"), ("(C) 2019\nfulfil the licence", "fulfill the license"),
            ("// © Y\n10 per cent & more", "10 percent and more"), ("all rights reserved.", ""), ("a\r\n\r\nb", "a b")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(L.canonical(df.t)).collect()] == [want for _, want in rows]
