"""License scans against a direct search, suppression rules, odd rows."""

import re
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from twinlens.llm import license_scan

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check(df):
    got = license_scan.scan(df).collect()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(r["text"]), r["text"]
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    return got


def test_sample_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def labels(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = license_scan.scan(df).first()
    return r["labels"], [(d["label"], d["matched"]) for d in r["detections"]]


def test_signatures(spark):
    assert len(license_scan.signatures()) > 200
    assert labels(spark, "Licensed under CC BY-NC 4.0.")[0] == "cc-by-nc"
    assert labels(spark, "SPDX-License-Identifier: Apache-2.0")[0] == "apache-2.0"
    assert labels(spark, "Distributed under the GNU Lesser General Public License v2.1 or later.")[0] == "gpl,lgpl"
    assert labels(spark, "Permission is hereby granted, free of charge, to any person obtaining a copy")[0] == "mit"
    assert labels(spark, "The committee will not permit licenses; emit license-free. ")[0] == ""


@pytest.fixture(scope="module")
def named(spark):
    """label -> names as they stand in texts: each is scanned in every form, gates on and off."""
    names = {"cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "cc0-1.0": ["CC0", "CC Zero", "Creative Commons Zero"],
             "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
             "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution-NonCommercial"],
             "cc-by-nd": ["Creative Commons Attribution-NoDerivatives"],
             "cc-by-nc-sa": ["Creative Commons Attribution-NonCommercial-ShareAlike"],
             "cc-by-nc-nd": ["Creative Commons Attribution-NonCommercial-NoDerivatives"],
             "mit": ["MIT", "Expat"], "bsd": ["BSD", "Berkeley Software Distribution"], "apache-2.0": ["Apache 2.0", "Apache Software"],
             "bsd-3-clause": ["BSD-3-Clause", "New BSD"], "bsd-2-clause": ["FreeBSD"], "wtfpl": ["WTFPL", "Do What The Heck You Want To Public"],
             "gpl": ["GPL-2.0-only", "GPLv3", "GNU GPL", "GNU General\nPublic"], "lgpl": ["LGPL-2.1", "GNU Lesser General Public"],
             "agpl-3.0": ["AGPL-3.0", "GNU Affero General Public"], "mpl": ["MPL-2.0", "Mozilla Public"], "epl": ["EPL-2.0", "Eclipse Public"],
             "ms-pl": ["MS-PL"], "ncsa": ["NCSA", "University of Illinois/NCSA Open Source"], "odbl": ["ODbL-1.0", "Open Data Commons Open Database"],
             "pddl": ["PDDL-1.0", "public\ndomain dedication"], "psf": ["PSF-2.0"], "ofl-1.1": ["OFL-1.1", "SIL Open Font"], "sspl": ["SSPL-1.0"],
             "bsl-1.0": ["BSL-1.0"], "gfdl": ["GFDL-1.3", "GNU Free Documentation"], "cddl": ["CDDL-1.0"], "eupl": ["EUPL-1.2"], "zpl": ["ZPL-2.1"]}
    forms = ["SPDX-License-Identifier: {}", "Licensed under the {}", "re-licenced under {}", "Released under {}", "Distributed\nunder the {}",
             "available under the terms of the {}", "Subject to the {}", "governed by the {}", "{} Licence", "the {}\nLicense"]
    rows = [(label, form.format(name) + ".") for label, all_names in names.items() for name in all_names for form in forms
            if not (re.search(r"\d\.\d", name) and re.search("licen.e$", form, re.I))]     # titles have the version last
    wording = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "put in the public\ndomain", "All rights\nreserved",
               "This software is provided 'as is', without any express or implied warranty. In no event", "free and unencumbered software\nreleased into the public domain",
               "http://www.apache.org/licenses/LICENSE-2.0", "https://creativecommons.org/licenses/by/4.0", "Copyright (c) 2020", "nothing here"]
    names_of = [(None, re.sub(r"\W", " ", label)) for label in license_scan.FAMILIES]
    rows += [(None, t) for t in wording] + [(None, form.format(n)) for form in forms for _, n in names_of]
    return spark.createDataFrame(rows, "label string, text string")


def test_every_name_is_found_in_every_form(named):
    got = license_scan.scan(named.where("label IS NOT NULL")).collect()
    assert [r["text"] for r in got if r["label"] not in r["labels"].split(",")] == []
    assert all(r["score"] >= 0.8 for r in got)


def test_no_gate_hides_a_match(named):
    off = [replace(s, keyword="", anchors=("",)) for s in license_scan.signatures()]
    found = lambda rules: sorted((r["text"], str(r["detections"])) for r in license_scan.scan(named, rules=rules).collect())
    assert found(None) == found(off)


def test_contained_detections_are_suppressed(spark):
    got = labels(spark, "Released under the MIT License.\nAlso: the MIT License. MIT license MIT license")
    assert got[1][0] == ("mit", "released under the mit license")
    assert [m for _, m in got[1]].count("mit license") == 3
    rules = [license_scan.Signature("long", "title", "b", r"a b c", 0.8), license_scan.Signature("short", "title", "b", r"b", 0.8),
             license_scan.Signature("better", "identifier", "b", r"b c", 0.99)]
    df = spark.createDataFrame([(1, "license a b c b")], "doc_id long, text string")
    r = license_scan.scan(df, rules=rules).first()
    assert [(d["label"], d["matched"]) for d in r["detections"]] == [("long", "a b c"), ("better", "b c"), ("short", "b")]


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "MIT license"), (4, "mit\x00license MIT-license mit\n\nLicense"), (4, "MİT License Kit"),
            (5, "general public license " * 300), (6, "é mit license ß"), (7, "x " * 50_000 + "apache license")]
    check(docs_of(rows))
    d = docs_of(rows).withColumnsRenamed({"lang": "_low", "source": "row", "n_chars": "n_words"})
    out = license_scan.scan(d)
    assert out.where(F.col("_low") != "en").count() == 0 and out.count() == len(rows)
    assert license_scan.scan(docs_of([])).collect() == []
