"""License scans by ordered signature rules, in DataFrame operations only.

A text becomes words: A-Z in lower case, everything but digits, a-z and
characters beyond ASCII separates. Rules are regexes over the words of a place,
joined by blanks. Hundreds of them are made from the hand-written families,
notices and sentences below. Each rule has one or more keywords, the first one
or two words of whatever it matches:

1. Keyword prefilter: one pass over the words keeps the places whose first word
   begins some keyword (a hash set); only these are looked at again.
2. At such a place the rules of its keywords are looked up, those whose needed
   word is missing in the next ``window`` words are passed over, and the others
   are matched from that place on. Of the rules that match there, the first in
   order counts: smaller priority, then more words, then place in the list.
3. Suppression: a detection whose words all lie inside those of an earlier
   starting one goes, unless its own priority is smaller. No match is longer than
   ``window`` words and each place has one detection, so a detection is compared
   with at most ``window`` before it, however many a text has.

All of this is done in the row of the document: no join, no shuffle, one pass.

Defined results: null and empty texts have no words, no labels and score 0;
rows are independent, so repeated rows give equal results; other columns play
no part; an empty table gives no rows. Without a place, ``first_word`` and
``last_word`` are null and the label lists are empty strings.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 32  #: words from a place on that a rule can match

# FIXED VALUES of the base: phrases and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Hand-written families: label, full names, versions, short names (as in "gplv3").
# "license" in a name also stands for "licence".
FAMILIES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("0bsd", ["zero clause bsd license", "bsd zero clause license", "0 clause bsd license"], [], []),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"], ["afl"]),
    ("agpl", ["gnu affero general public license", "affero general public license"], ["1.0", "3.0"], ["agpl"]),
    ("apache", ["apache license", "apache software license", "apache public license"], ["1.0", "1.1", "2.0"], ["apache", "asl"]),
    ("apsl", ["apple public source license"], ["1.0", "1.1", "1.2", "2.0"], ["apsl"]),
    ("artistic", ["artistic license", "perl artistic license", "clarified artistic license"], ["1.0", "2.0"], []),
    ("beerware", ["beer ware license", "beerware license"], [], []),
    ("bsd-2-clause", ["bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"], [], []),
    ("bsd-3-clause", ["bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"], [], []),
    ("bsd-4-clause", ["bsd 4 clause license", "4 clause bsd license", "original bsd license", "old bsd license", "bsd 4 clause"], [], []),
    ("bsd", ["bsd license", "bsd style license", "berkeley software distribution license"], [], []),
    ("bsl", ["boost software license"], ["1.0"], ["bsl"]),
    ("busl", ["business source license"], ["1.0", "1.1"], ["busl"]),
    ("cc-by", ["creative commons attribution", "cc by"], ["1.0", "2.0", "2.5", "3.0", "4.0"], []),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], ["2.0", "2.5", "3.0", "4.0"], []),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "cc by nc nd"], ["2.0", "2.5", "3.0", "4.0"], []),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike", "cc by nc sa"], ["2.0", "2.5", "3.0", "4.0"], []),
    ("cc-by-nd", ["creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd"], ["2.0", "2.5", "3.0", "4.0"], []),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], ["2.0", "2.5", "3.0", "4.0"], []),
    ("cc0", ["creative commons zero", "creative commons cc0", "cc0 public domain dedication", "cc0 universal", "cc zero"], ["1.0"], ["cc0"]),
    ("cddl", ["common development and distribution license"], ["1.0", "1.1"], ["cddl"]),
    ("cecill", ["cecill free software license agreement", "cecill license"], ["1.0", "1.1", "2.0", "2.1"], ["cecill"]),
    ("cpl", ["common public license"], ["1.0"], ["cpl"]),
    ("ecl", ["educational community license"], ["1.0", "2.0"], ["ecl"]),
    ("epl", ["eclipse public license"], ["1.0", "2.0"], ["epl"]),
    ("eupl", ["european union public license"], ["1.0", "1.1", "1.2"], ["eupl"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["1.1", "1.2", "1.3"], ["gfdl"]),
    ("gpl", ["gnu general public license", "general public license", "gnu public license", "gnu gpl"], ["1.0", "2.0", "3.0"], ["gpl"]),
    ("isc", ["isc license", "internet systems consortium license"], [], []),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl"], ["2.0", "2.1", "3.0"], ["lgpl"]),
    ("lppl", ["latex project public license"], ["1.0", "1.1", "1.2", "1.3"], ["lppl"]),
    ("mit", ["mit license", "mit x11 license", "expat license", "x11 license"], [], []),
    ("mit-0", ["mit no attribution license", "mit no attribution"], [], []),
    ("mpl", ["mozilla public license"], ["1.0", "1.1", "2.0"], ["mpl"]),
    ("ms-pl", ["microsoft public license"], [], []),
    ("ms-rl", ["microsoft reciprocal license"], [], []),
    ("mulan-psl", ["mulan permissive software license"], ["1.0", "2.0"], []),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], [], []),
    ("odbl", ["open database license", "open data commons open database license"], ["1.0"], ["odbl"]),
    ("odc-by", ["open data commons attribution license"], ["1.0"], []),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"], ["ofl"]),
    ("openssl", ["openssl license"], [], []),
    ("osl", ["open software license"], ["1.0", "2.0", "2.1", "3.0"], ["osl"]),
    ("pddl", ["open data commons public domain dedication and license", "public domain dedication and license"], ["1.0"], ["pddl"]),
    ("php", ["php license"], ["3.0"], []),
    ("postgresql", ["postgresql license"], [], []),
    ("psf", ["python software foundation license", "psf license"], ["2.0"], []),
    ("qpl", ["q public license", "qt public license"], ["1.0"], ["qpl"]),
    ("ruby", ["ruby license"], [], []),
    ("sspl", ["server side public license"], ["1.0"], ["sspl"]),
    ("unlicense", ["unlicense"], [], []),
    ("upl", ["universal permissive license"], ["1.0"], ["upl"]),
    ("w3c", ["w3c software notice and license", "w3c license"], [], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["2.0"], []),
    ("zlib", ["zlib license", "zlib libpng license"], [], []),
    ("zpl", ["zope public license"], ["1.1", "2.0", "2.1"], ["zpl"]),
]

# Words that open a notice, before "the" or "the terms of the" and a name.
NOTICES = ["available under", "covered by", "covered under", "distributed under", "governed by", "licence under", "licenced under", "license under", "licensed under",
           "offered under", "provided under", "published under", "redistributed under", "released under", "shared under", "subject to", "usable under"]

# Hand-written sentences of license texts: label, then a pattern that begins with two plain words.
SENTENCES: list[tuple[str, str]] = [
    ("agpl-3.0", r"notwithstanding any other provision of this license if you modify the program your modified version must prominently offer"),
    ("all-rights-reserved", r"all rights reserved"),
    ("all-rights-reserved", r"alle rechte vorbehalten"),
    ("all-rights-reserved", r"tous droits réservés"),
    ("all-rights-reserved", r"todos los derechos reservados"),
    ("apache-2.0", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("beerware", r"you can buy me a beer in return"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", r"neither the names? of (?:the )?(?:\S+ ){1,8}nor the names of (?:its|any|other) contributors may be used"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("cc0-1.0", r"no copyright no rights reserved"),
    ("cc0-1.0", r"to the extent possible under law (?:\S+ ){1,6}(?:has|have) waived all copyright"),
    ("commercial", r"this software is (?:commercial|proprietary)"),
    ("confidential", r"confidential and proprietary"),
    ("confidential", r"unauthorized copying of this file"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", r"copyright © (?:19|20)\d\d"),
    ("epl", r"this program and the accompanying materials are made available under"),
    ("gpl", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", r"you should have received a copy of the gnu (?:general|lesser|affero|library)"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("other-permissive", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("other-restrictive", r"for (?:personal|private|academic|research) use only"),
    ("other-restrictive", r"non commercial use only"),
    ("postgresql", r"in no event shall the university of california be liable"),
    ("public-domain", r"released into the public domain"),
    ("public-domain", r"dedicated to the public domain"),
    ("public-domain", r"this work is in the public domain"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("warranty-disclaimer", r"the software is provided as is without warranty of any kind"),
    ("warranty-disclaimer", r"this software is provided as is without"),
    ("warranty-disclaimer", r"this software is provided by the copyright holders and contributors as is"),
    ("wtfpl", r"do what the fuck you want to"),
    ("zlib", r"the origin of this software must not be misrepresented"),
]

# Priority and weight of each kind of rule.
KINDS = {"identifier": (1, 1.0), "notice+version": (2, 0.95), "sentence": (3, 0.9), "notice": (4, 0.85), "name+version": (5, 0.8), "short": (6, 0.6), "name": (7, 0.5)}


@dataclass(frozen=True)
class Rule:
    keys: tuple[str, ...]  #: first word, or first two, of a match
    need: str  #: a word that every match holds
    pattern: str  #: over words joined by blanks, from the place on
    label: str
    kind: str


def _version(version: str) -> str:
    major, minor = version.split(".")
    number = rf"{major}(?: 0)?(?! \d )" if minor == "0" else f"{major} {minor}"
    return rf"(?: version| ver| v)? v?{number}"


def _names(names: list[str]) -> str:
    return "(?:" + "|".join(re.escape(n).replace(r"\ ", " ").replace("license", "licen[cs]e") for n in sorted(names, key=len, reverse=True)) + ")"


def _first_words(text: str, n: int = 2) -> list[str]:
    """The keyword of a plain text, in both spellings."""
    key = " ".join(text.split(" ")[:n])
    return sorted({key, key.replace("license", "licence")})


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority."""
    out: list[Rule] = []
    gap = r"(?:(?: international| unported| generic)? (?:public )?licen[cs]e)?(?: as published by the free software foundation)?(?: either)?"
    opening = "(?:" + "|".join(NOTICES) + ")(?: the)?(?: terms of(?: the)?| conditions of(?: the)?)?"
    for label, names, versions, shorts in FAMILIES:
        name = _names(names)
        common = set.intersection(*[set(n.replace("license", "").split()) for n in names])
        need = max(common, key=lambda w: (len(w), w)) if common else ""
        name_keys = tuple(sorted({k for n in names for k in _first_words(n)}))
        for v in versions:
            out.append(Rule(("spdx license", "spdx licence"), v.split(".")[0], rf"spdx licen[cs]e identifier {label.replace('-', ' ')} {v.replace('.', ' ')}(?: only| or later)?", f"{label}-{v}", "identifier"))
            out.append(Rule(tuple(NOTICES), need, f"{opening} {name}{gap}{_version(v)}", f"{label}-{v}", "notice+version"))
            out.append(Rule(name_keys, need, f"{name}{gap}{_version(v)}", f"{label}-{v}", "name+version"))
            major, minor = v.split(".")
            for s in shorts:
                keys = (f"{s}v{major}", f"{s}{major}", f"{s} v{major}", f"{s} {major}", f"{s} version")
                tail = r"(?: 0)?(?! \d )" if minor == "0" else f" {minor}"
                short = rf"{s}(?: version)? ?v?{major}{tail}"
                out.append(Rule(keys, s, short, f"{label}-{v}", "short"))
                out.append(Rule(tuple(NOTICES), s, f"{opening} {short}", f"{label}-{v}", "notice+version"))
        if not versions:
            out.append(Rule(("spdx license", "spdx licence"), label.split("-")[0], rf"spdx licen[cs]e identifier {label.replace('-', ' ')}", label, "identifier"))
        out.append(Rule(tuple(NOTICES), need, f"{opening} {name}", label, "notice"))
        out.append(Rule(name_keys, need, name, label, "name"))
        for s in shorts:
            out.append(Rule(tuple(NOTICES), s, f"{opening} {s}", label, "notice"))
    for label, pattern in SENTENCES:
        first = " ".join(pattern.split(" ")[:2])
        if re.search(r"[()\[\]\\?{}|]", first):
            first = pattern.split(" ")[0]
        out.append(Rule((first,), first.split(" ")[0], pattern, label, "sentence"))
    return tuple(sorted(out, key=lambda r: KINDS[r.kind][0]))


SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. ``lower`` changes no boundary, and of the characters beyond ASCII it makes only the
    Kelvin sign a plain letter, so that is exchanged before."""
    lower = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


RULE = "struct<priority:int,no:int,need:string,pattern:string,label:string,weight:double>"


def _rule_table() -> tuple[Column, Column]:
    """Keyword -> numbers of its rules, and the rules by number; literals, read from JSON once per plan."""
    by: dict[str, list[int]] = {}
    for no, r in enumerate(rules()):
        for k in r.keys:
            by.setdefault(k, []).append(no)
    cells = [{"priority": KINDS[r.kind][0], "no": no, "need": r.need, "pattern": f"^{r.pattern}(?= )", "label": r.label, "weight": KINDS[r.kind][1]}
             for no, r in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<int>>"), F.from_json(F.lit(json.dumps(cells)), f"array<{RULE}>")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus ``n_words``, ``base`` (starts per phrase of :data:`BASE`) and ``detections``
    (``first``, ``last`` word, ``priority``, ``label``, ``weight``; after suppression, by first word).

    Columns of these names, ``words``, ``places`` and ``found`` must not be in ``docs``.
    """
    firsts = sorted({k.split(" ")[0] for r in rules() for k in r.keys} | {p.split(" ")[0] for p in BASE})
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, words(F.col(text)).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
    out = out.select(*rest, "words", places.alias("places"))

    def starts(phrase: str) -> Column:
        ws = phrase.split(" ")
        return F.filter("places", lambda i: F.slice("words", i + 1, len(ws)) == F.array(*map(F.lit, ws)))

    table, by_number = _rule_table()

    def spot(i: Column) -> Column:
        here, after = F.get("words", i), F.get("words", i + 1)
        ahead = F.concat(F.array_join(F.slice("words", i + 1, WINDOW), " "), F.lit(" "))
        none = F.array().cast("array<int>")
        own = F.concat(F.coalesce(table[here], none), F.coalesce(table[F.concat(here, F.lit(" "), after)], none))
        return F.struct(i.alias("first"), ahead.alias("ahead"), F.transform(own, lambda n: F.get(by_number, n)).alias("rules"))

    def best(s: Column) -> Column:
        tried = F.filter(s["rules"], lambda r: F.contains(s["ahead"], r["need"]))
        tried = F.transform(tried, lambda r: F.struct(r.alias("rule"), F.call_function("regexp_extract", s["ahead"], r["pattern"], F.lit(0)).alias("hit")))
        sized = F.transform(F.filter(tried, lambda t: t["hit"] != ""), lambda t: F.struct(
            t["rule"]["priority"].alias("priority"), (-F.size(F.split(t["hit"], " "))).alias("minus"), t["rule"]["no"].alias("no"),
            t["rule"]["label"].alias("label"), t["rule"]["weight"].alias("weight")))
        return F.struct(s["first"].alias("first"), F.array_min(sized).alias("best"))

    def detection(d: Column) -> Column:
        return F.struct(d["first"].alias("first"), (d["first"] - d["best"]["minus"] - 1).alias("last"), d["best"]["priority"].alias("priority"),
                        d["best"]["label"].alias("label"), d["best"]["weight"].alias("weight"))

    found = F.filter(F.transform(F.transform("places", spot), best), lambda d: d["best"].isNotNull())
    found = F.transform(found, detection)
    out = out.select(*rest, F.size("words").cast("long").alias("n_words"), F.array(*[starts(p) for p in BASE]).alias("base"), found.alias("found"))

    def inside_another(d: Column, j: Column) -> Column:
        before = F.slice("found", F.greatest(j - WINDOW + 1, F.lit(1)), F.least(j, F.lit(WINDOW)))
        return F.exists(before, lambda e: (e["last"] >= d["last"]) & (e["priority"] <= d["priority"]))

    kept = F.filter(F.transform("found", lambda d, j: F.when(~inside_another(d, j), d)), lambda d: d.isNotNull())
    return out.select(*rest, "n_words", "base", kept.alias("detections"))


def license_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row of ``docs``."""
    out = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = [F.col("base")[k] for k in range(len(BASE))]
    found = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(base, BASE.values())]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.flatten("base")
    return out.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), joined(found).alias("base_labels"),
        joined(F.concat(found, F.col("detections.label"))).alias("labels"),
        F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0)).alias("score"))
