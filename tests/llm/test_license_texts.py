"""Licenses as they stand in files: wrapped, and close to one another."""

import textwrap

import pytest
from strandline.llm import licenses as lic, queries


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    def scanned(*texts):
        path = str(tmp_path_factory.mktemp("documents"))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
        return [set(r.labels.split(",")) - {""} for r in queries.QUERIES["op4_license_scan"](spark, path).orderBy("doc_id").collect()]

    return scanned


def test_wrapped_texts(labels):
    cases = [(name, " * ", 30) for name in lic.TEMPLATES] + [(name, "", 72) for name in lic.TEMPLATES]
    filler = ["", "harbour lamp " * 90 + "\n"]
    texts = [f + textwrap.fill(lic.TEMPLATES[name], width, initial_indent=mark, subsequent_indent=mark) + "\n" + f for name, mark, width in cases for f in filler]
    got = labels(*texts)
    assert all(cases[k // 2][0] in x for k, x in enumerate(got))


def test_every_place_in_a_long_text(labels):
    wrapped = textwrap.fill(lic.TEMPLATES["gpl-terms"], 25)
    got = labels(*("\n".join(["rope"] * k) + "\n" + wrapped for k in range(0, 140, 3)))
    assert all("gpl-terms" in x for x in got)


def test_far_apart_words_do_not_meet(labels):
    text = ("\n" + "rope " * 150 + "\n").join(lic.TEMPLATES["mit-terms"].split())
    assert labels(text) == [set()]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: FITNESS FOR A PARTICULAR PURPOSE"""
REDISTRIBUTE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"


@pytest.mark.parametrize("across", ["lines", "wrapped"])
def test_labels_of_one_license_only(labels, across):
    cases = [
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-notice"}),
        ("Licensed under CC BY-SA 4.0.", {"cc-by", "cc-by-sa-notice"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"cc-by"}),
        ("Released under the Apache License", {"apache"}),
        ("Released under the MIT License", {"mit", "mit-notice"}),
        (REDISTRIBUTE.format(""), {"gpl", "gpl-terms"}),
        (REDISTRIBUTE.format("Affero "), {"agpl-notice"}),
        (REDISTRIBUTE.format("Lesser "), {"lgpl-notice"}),
        ("This work is licensed under the GNU General Public License, version 2", {"gpl"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", set()),
        ("subject to the terms of the Eclipse Public License, v. 2.0", set()),
        (MIT, {"mit-terms"}),
    ]
    texts = [t if across == "lines" else textwrap.fill(t, 30) for t, _ in cases]
    assert labels(*texts) == [want for _, want in cases]


def test_templates_longer_than_a_block(spark):
    words = [f"term{i}" for i in range(200)]
    wrapped = textwrap.fill(" ".join(words), 40)
    docs = spark.createDataFrame([(k, "rope\n" * k + wrapped) for k in range(0, 420, 13)], "doc_id long, text string").coalesce(1)
    got = lic.scan(docs, templates={"terms": " ".join(words)}, contained=1.0, across=True).collect()
    assert {r.labels for r in got} == {"terms"}
