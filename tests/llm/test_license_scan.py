import re
from collections import Counter

from catalith.llm import license_scan as op
from catalith.llm.queries import op2_license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(op.UPPER, op.LOWER)


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for label, p in op.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def notices(text):
    """Labels and the best cover, word by word: the words of the notice that stand together in the text, on diagonals two apart at most."""
    w = WORD.findall((text or "").translate(LOWER))
    labels, best = set(), 0.0
    for label, notice in op.NOTICES:
        t = notice.replace("[", "").replace("]", "").split()
        marked, inside, must = notice.split(), False, set()
        for p, x in enumerate(marked):
            inside = inside or x[0] == "["
            if inside:
                must.add(p)
            inside = inside and x[-1] != "]"
        lines = {}
        for i in range(len(w) - 2):
            for p in range(len(t) - 2):
                if w[i] == t[p] and w[i + 1 : i + 3] == t[p + 1 : p + 3]:
                    lines.setdefault(i - p, set()).add(p)
        groups, before = [], None
        for d in sorted(lines):
            if before is None or d - before > 2:
                groups.append(set())
            groups[-1] |= lines[d]
            before = d
        for g in groups:
            cover = len(g) / (len(t) - 2)
            decided = all(p in g for p in range(len(t) - 2) if {p, p + 1, p + 2} <= must)
            if cover >= 0.6 and decided:
                labels.add(label)
                best = max(best, cover)
    return labels, best


def check(got, rows):
    want = []
    for i, text in rows:
        b, (labels, best) = base(text), notices(text)
        every = sorted(labels | set(filter(None, b[4].split(","))))
        want.append((i, *b, ",".join(every), 1.0 if b[1] else best))
    assert Counter(tuple(r)[:8] for r in got) == Counter(want)


def test_cases(docs, spark, doc_rows):
    check(op.license_scan(docs).collect(), [r[:2] for r in doc_rows])
    texts = [
        "CC-BY-NC cc by nc cc by nc.",
        "cc by ncx under the mit licensed",
        "This  work is LICENSED under the GNU General Public License, version 3.",
        "this work is licensed under the new GNU general public license version 3",
        "permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "é under the mit license é",
        "under the mit license " * 500,
    ]
    rows = [*enumerate(texts), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(op.license_scan(df).collect(), rows)


SIBLINGS = {
    "This work is licensed under the GNU General Public License version 2": "gpl-2",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "this work is licensed under the GNU Lesser General Public License version 3": "lgpl-3",
    "this work is licensed under the new GNU general public license version 3": "gpl-3",
    "Licensed under the Apache License, Version 1.1": "apache-1.1",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "released under the MIT alumni scheme": "",
    "released under the MIT license": "mit",
    "licensed under CC BY-SA 4.0": "cc-by-sa",
    "the general public licensed under version 3": "",
}


def test_siblings(spark):
    rows = list(enumerate(SIBLINGS))
    got = op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == dict(enumerate(SIBLINGS.values()))
    check(got, rows)


def test_one_text_over_a_megabyte(spark):
    text = "word " * 300_000 + "this work is licensed under the gnu general public license version 3"
    got = op.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["n_words"], r["labels"], r["n_base"]) for r in got] == [(300_012, "gpl-3", 0)]


def test_empty(no_docs):
    assert op.license_scan(no_docs).collect() == []


def test_no_python_in_the_plan(docs):
    plan = op.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("EvalPython", "Python").split("Scan")[0])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op2_license_scan(spark, sf).collect(), rows)
