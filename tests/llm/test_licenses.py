"""Licence families of varied paragraphs and of ordinary text."""

import textwrap

import pytest

from textscope.llm import licenses

from .samples import EDGES, docs_of, edge_docs

CASES = {
    "Released under the MIT License.": "MIT",
    "Some words first.\nLicensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "licensed under cc by-sa 4.0": "CC-BY-SA",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT",
    "licensed under the GNU Lesser General Public License, version 2.1": "LGPL",
    "She renewed her driver license at the office.": "",
    "No such words here.": "",
}


def test_families(spark):
    rows = list(enumerate(CASES))
    got = {r.doc_id: ",".join(x.family for x in r.licenses) for r in licenses.find(docs_of(spark, rows)).collect()}
    assert {t: got[k] for k, t in rows} == CASES


NOTICES = {
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


@pytest.mark.parametrize("columns", [60, 70, 80])
def test_wrapped_notices_are_found_whole(spark, columns):
    around = ["The river ran slowly past the old mill.", "Nobody had seen the boats that year."]
    rows, want = [], {}
    for k, (family, notice) in enumerate(NOTICES.items()):
        lines = textwrap.wrap(notice, columns)
        for form, t in enumerate(("\n".join(lines), "\n".join(around + [""] + lines + [""] + around), "\n".join(around * 4 + lines + around * 4), "\n".join("# " + x for x in lines), "\n".join(lines + lines))):
            rows.append((10 * k + form, t))
            want[10 * k + form] = [family] * (2 if form == 4 else 1)
    rows.append((90, "Released under the MIT License.\nLicensed under the Eclipse Public License"))
    want[90] = ["MIT", "unknown"]
    got = {r.doc_id: [x.family for x in r.licenses] for r in licenses.find(docs_of(spark, rows)).collect()}
    assert got == want


def test_unlisted_licences_are_unknown(spark):
    rows = [(1, "This file is distributed under the Artistic License."), (2, "Licensed under the Eclipse Public License")]
    found = licenses.find(docs_of(spark, rows)).collect()
    assert [[x.family for x in r.licenses] for r in found] == [["unknown"], ["unknown"]]


def test_sql_grams_equal_the_training_ones(spark):
    texts = ["Version 2.0 of the GPL.", "", "one", "a a a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{licenses.grams_sql('t')} AS g")
    assert {r.t: sorted(r.g) for r in df.collect()} == {t: sorted(licenses.grams(t)) for t in texts}


def test_edges(spark):
    docs = edge_docs(spark)
    assert licenses.find(docs).count() == len(EDGES)
    assert licenses.find(docs.limit(0)).count() == 0
