"""License rules: no prefilter and plain suppression as a twin, and notices that must be found."""

import pytest

from furrow.llm import license_scan


def plain_detect(padded):
    """Every rule over the whole text, then suppression by comparing with all that was taken before."""
    hits = sorted(((-r.priority, m.start() - m.end(), m.start(), r.label, m.end(), r) for r in license_scan.rules() for m in r.pattern.finditer(padded)), key=lambda h: h[:4])
    kept = []
    for _, _, start, label, end, rule in hits:
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, label))
    return kept


def test_detections_equal_plain_loops(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    samples = [t[:20_000] for t in texts if any(w in t.lower() for w in ("licen", "copyright", "rights", "cc", "public"))][:60] + [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "CC BY-NC-SA 4.0, MIT and GPL licenses. " * 20,
    ]
    for t in samples:
        padded = b" " + b" ".join(t.encode().translate(license_scan._CLEAN).split()) + b" "
        assert [(k.start, k.end, k.rule.label) for k in license_scan.detect(padded)] == plain_detect(padded)


@pytest.mark.parametrize(("text", "labels"), [
    ("under the GNU General Public License", {"gpl"}), ("the GNU Lesser General Public License as published by", {"lgpl"}), ("MIT licensed", {"mit"}), ("BSD licensed code", {"bsd"}), ("distributed under the Artistic License", {"artistic"}),
    ("This file is in the public domain", {"public-domain"}), ("CC-BY-SA", {"cc-by-sa"}), ("Apache-2.0 OR MIT", {"apache-2", "mit"}), ("under the MIT and GPL licenses", {"mit", "gpl"}), ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2"}),
    ("GNU General Public License version 2", {"gpl-2.0"}), ("the Mozilla Public License, v. 2.0", {"mpl-2.0"}), ("Unauthorized copying of this file", {"proprietary"}), ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", {"apache-2"}),
])
def test_notices(text, labels):
    found = set(license_scan.scan(text)[5].split(","))
    assert labels <= found and not {x for x in found - labels if x in ("mit", "gpl", "bsd", "lgpl", "apache")}


def test_plain_prose_has_no_label():
    for t in ("She and the mit of snow or the apache plain", "a list of things and the bsd of it", "nothing to see here and there or elsewhere", "he was licensed to drive"):
        assert license_scan.scan(t)[5] == "" and license_scan.scan(t)[6] == 0.0


def test_rules_are_many_and_mostly_by_hand():
    written = {p for _, p, _ in (*license_scan.SENTENCES, *license_scan.NOTICES)}
    assert len(written) == len(license_scan.SENTENCES) + len(license_scan.NOTICES) >= 200


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = "word " * 200_000 + "MIT licensed " + "word " * 10
    df = spark.createDataFrame([(1, "MIT licensed", "x"), (1, "MIT licensed", "y"), (None, long, "z"), (2, None, "w")], "doc_id long, text string, labels string")
    got = sorted(((r.doc_id, r.labels, r.n_words) for r in license_scan.license_scan(df).collect()), key=str)
    assert got == sorted([(1, "mit", 2), (1, "mit", 2), (None, "mit", 200_012), (2, "", 0)], key=str)
