import re

from quern.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    base, labels, base_labels, score = [], set(), set(), 0.0
    for t in licenses.BASE + licenses.NOTICES:
        for s in range(-len(t.words), len(words)):
            if all(0 <= s + o < len(words) and words[s + o] == t.words[o] for o in t.key):
                labels.add(t.label)
                score = max(score, sum(0 <= s + o < len(words) and words[s + o] == w for o, w in enumerate(t.words)) / len(t.words))
                if t.base:
                    base.append(s)
                    base_labels.add(t.label)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Das ist MIT Lizenz, mit license. MIT\nLICENSE!",
    "apache license mit license general public license general public license",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU Affero General Public License",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "apache license version 2 0",
    "the apache license version 2",
    "license mit", "licenseé mit license", "É mit license 日本 license", "Ümit license",
    "Permission is granted, hereby granted, free of charge, to any person obtaining a copy",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    None, "", " ,.; ", "mit license " * 20_000 + "end", "a b c",
]


def test_scan_equals_the_plain_version(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 0), (3, TEXTS[3], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    found = sorted((tuple(r) for r in licenses.license_scan(docs).collect()), key=repr)
    assert found == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert licenses.license_scan(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
