"""License scan against a slow Python version of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from reqscope.llm import licenses, queries

SF = "/root/testdata/sf0.01"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def slow_detections(ws):
    """Every rule at every place; no keyword, no needed word."""
    found = []
    for i in range(len(ws)):
        ahead = " ".join(ws[i: i + licenses.WINDOW]) + " "
        best = None
        for no, (r, pattern) in enumerate(COMPILED):
            if m := pattern.match(ahead):
                now = (licenses.KINDS[r.kind][0], -len(m[0].split(" ")), no, r)
                best = min(best or now, now, key=lambda x: x[:3])
        if best:
            found.append((i, i - best[1] - 1, best[0], best[3].label, licenses.KINDS[best[3].kind][1]))
    return [d for d in found if not any(e[0] < d[0] and e[1] >= d[1] and e[2] <= d[2] for e in found)]


COMPILED = [(r, re.compile(r.pattern + "(?= )")) for r in licenses.rules()]


def slow(text, full=True):
    ws = slow_words(text)
    at = {p: [i for i in range(len(ws)) if ws[i: i + len(p.split())] == p.split()] for p in licenses.BASE}
    places = sorted(i for found in at.values() for i in found)
    base = {licenses.BASE[p] for p, found in at.items() if found}
    out = [len(ws), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base))]
    if full:
        d = slow_detections(ws)
        out += [",".join(sorted(base | {x[3] for x in d})), max((x[4] for x in d), default=0.0)]
    return out


def sample_texts():
    """One text per rule, made from its pattern's first alternatives."""
    out = []
    for r in licenses.rules():
        t = r.pattern
        while "(?:" in t or "[" in t:
            t = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\{1,\d\}|\?)?", r"\1", t)
            t = re.sub(r"\(\?!.*?\)", "", t).replace("[cs]", "s")
            t = re.sub(r"\[.*?\]", "s", t)
        t = t.replace(r"\S+", "someone").replace(r"\d", "9").replace("?", "")
        out.append((r, t))
    return out


TEXTS = [None, "", " \n .,;", "MIT License", "mit\n\tLICENSE, then more; MIT-licence", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "general public license general public license mit license",
         "GNU Lesser General Public License v2.1 or later; GPLv3; gpl 2; LGPL 2.1", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: MIT OR Apache-2.0",
         "the lınk Kelvin MITİ license İ", "Die Katze ist mit der Lizenz. Mit License nothing", "apache license apache license, version 2.0 apache licence 1.1",
         "Copyright (c) 2019 Somebody. All rights reserved. Licensed under the BSD 3-Clause License", "dual licensed under the terms of the MIT license and the Apache License 2.0",
         "🙂mit license🙂 mit🙂license ümit license", "Creative Commons Attribution-ShareAlike 4.0 International License", "license", "mit", "apache", "general public",
         "x\x00mit\x00license\x7fy", "mit license" * 3, "neither the name of the foo bar nor the names of its contributors may be used"]


def test_op13_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: list(r)[1:] for r in queries.QUERIES["op13_license_scans"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert sorted(out) == sorted(r["doc_id"] for r in rows)
    hits = 0
    for r in rows:
        full = re.search("licen|copyright|rights", r["text"] or "", re.I) is not None and len(r["text"]) < 5000
        want = slow(r["text"], full)
        hits += full
        assert out[r["doc_id"]][: len(want)] == want, r["doc_id"]
    assert hits > 20


def test_op13_odd_texts(spark):
    long = "word " * 150_000 + "Released under the MIT License. " + "ünd " * 1000
    hot = "licensed under the apache license version 2 0 " * 3000
    texts = TEXTS + [long, hot] + [t for _, t in sample_texts()][::3] + ["mit license", "mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("words", "places", "found", "base", "n_words", "detections", "labels"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    out = {r["doc_id"]: list(r)[1:] for r in licenses.license_labels(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        if t is long:
            assert out[i] == [151_006 - 1, 1, 150_003, 150_003, "mit", "mit", 0.85]
        elif t is hot:
            assert out[i] == [24_000, 3000, 3, 23_995, "apache", "apache,apache-2.0", 0.95]
        else:
            assert out[i] == slow(t), t
    assert licenses.license_labels(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "mit license")], "doc_id long, text string")
    assert sorted(r["n_base"] for r in licenses.license_labels(nulls).collect()) == [0, 1]


def test_op13_labels_of_known_notices(spark):
    want = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
            "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
            "under LGPL v2.1": "lgpl-2.1", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "plain prose with mit and permission": ""}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    have = {r["doc_id"]: r["labels"] for r in licenses.license_labels(df).collect()}
    assert [have[i] for i in range(len(want))] == list(want.values())


def test_op13_rules_are_sound():
    made = licenses.rules()
    assert len(made) > 300 and len({r.pattern for r in made}) > 300
    assert [licenses.KINDS[r.kind][0] for r in made] == sorted(licenses.KINDS[r.kind][0] for r in made)
    for r, text in sample_texts():  # every rule can match, within the window, at one of its keywords, with its needed word
        m = re.match(r.pattern + "(?= )", text + " ")
        assert m, (r, text)
        assert len(m[0].split()) <= licenses.WINDOW and r.need in m[0]
        assert any((m[0] + " ").startswith(k + " ") for k in r.keys), (r.keys, m[0])


def test_op13_lower_case_keeps_words(spark):
    """Over every code point: the words of the native form are the words by the contract's rule, equal where they are plain."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(k, " ".join("a" + chr(c) + "Zk" for c in points[k: k + 2000])) for k in range(0, len(points), 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, ws in df.select("doc_id", licenses.words(F.col("text")).alias("w")).collect():
        want = slow_words(rows[k // 2000][1])
        assert len(ws) == len(want), k
        assert all(x == y or not (x.isascii() or y.isascii()) for x, y in zip(ws, want)), k


def test_op13_plan_is_native(spark):
    df = licenses.license_labels(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
