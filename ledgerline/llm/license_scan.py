"""License detection by ordered signature rules.

Several hundred patterns over a text's words: sentences of the license texts themselves, and families of licenses in the forms of
naming them. A text meets only
the rules whose needed words it has; these are derived from the pattern, so each match has them. Overlaps are resolved by
interval containment: a detection inside another of the same or a better priority goes.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._common import NOT_WORD, ascii_lower, row_key, words, written

#: family: label, pattern of its name in words, versions, SPDX stem in words.
FAMILIES = [
    ("mit", "mit", [], "mit"),
    ("mit-0", "mit no attribution", [], "mit 0"),
    ("apache", "apache(?: software)?", ["1 0", "1 1", "2 0"], "apache"),
    ("gpl", "(?:gnu )?gpl", ["1 0", "2 0", "3 0", "2", "3"], "gpl"),
    ("gpl", "(?:gnu )?general public", ["1 0", "2 0", "3 0", "2", "3"], "gnu gpl"),
    ("lgpl", "(?:gnu )?lgpl", ["2 0", "2 1", "3 0", "3"], "lgpl"),
    ("lgpl", "(?:gnu )?lesser general public", ["2 1", "3 0", "3"], "gnu lgpl"),
    ("lgpl", "(?:gnu )?library general public", ["2 0", "2"], "gnu library"),
    ("agpl", "(?:gnu )?agpl", ["1 0", "3 0", "3"], "agpl"),
    ("agpl", "(?:gnu )?affero general public", ["1 0", "3 0", "3"], "gnu agpl"),
    ("gfdl", "(?:gnu )?(?:free documentation|fdl|gfdl)", ["1 1", "1 2", "1 3"], "gfdl"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", [], "bsd 2 clause"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", [], "bsd 3 clause"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", [], "bsd 4 clause"),
    ("0bsd", "(?:0bsd|zero clause bsd)", [], "0bsd"),
    ("bsd", "bsd", [], "bsd"),
    ("mpl", "mozilla public", ["1 0", "1 1", "2 0"], "mozilla mpl"),
    ("mpl", "mpl", ["1 0", "1 1", "2 0"], "mpl"),
    ("epl", "eclipse public", ["1 0", "2 0"], "eclipse epl"),
    ("epl", "epl", ["1 0", "2 0"], "epl"),
    ("eupl", "eupl", ["1 0", "1 1", "1 2"], "eupl"),
    ("eupl", "european union public", ["1 0", "1 1", "1 2"], "eu eupl"),
    ("cddl", "cddl", ["1 0", "1 1"], "cddl"),
    ("cddl", "common development and distribution", ["1 0", "1 1"], "common cddl"),
    ("cpl", "common public", ["0 5", "1 0"], "cpl"),
    ("ipl", "ibm public", ["1 0"], "ipl"),
    ("artistic", "artistic", ["1 0", "2 0"], "artistic"),
    ("cc0", "(?:cc0|creative commons zero)", ["1 0"], "cc0"),
    ("cc-by", "(?:creative commons attribution|cc by)", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by sa"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:s|atives)|cc by nd)", ["2 0", "3 0", "4 0"], "cc by nd"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)", ["2 0", "3 0", "4 0"], "cc by nc"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", ["2 0", "3 0", "4 0"], "cc by nc sa"),
    ("isc", "isc", [], "isc"),
    ("zlib", "zlib(?: libpng)?", [], "zlib"),
    ("boost", "boost software", ["1 0"], "bsl"),
    ("unlicense", "(?:the )?unlicense", [], "unlicense"),
    ("wtfpl", "wtfpl", ["1", "2"], "wtfpl"),
    ("postgresql", "postgresql", [], "postgresql"),
    ("python", "python(?: software foundation)?", ["2 0"], "psf"),
    ("php", "php", ["3 0", "3 01"], "php"),
    ("ruby", "ruby", [], "ruby"),
    ("openssl", "openssl", [], "openssl"),
    ("w3c", "w3c(?: software)?", [], "w3c"),
    ("ofl", "(?:sil open font|(?:sil )?ofl)", ["1 0", "1 1"], "ofl"),
    ("ms-pl", "(?:microsoft public|ms pl)", [], "ms pl"),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", [], "ms rl"),
    ("osl", "open software", ["1 0", "2 0", "3 0"], "osl"),
    ("afl", "(?:academic free|afl)", ["2 0", "2 1", "3 0"], "afl"),
    ("upl", "(?:universal permissive|upl)", ["1 0"], "upl"),
    ("vim", "vim", [], "vim"),
    ("x11", "x11", [], "x11"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", [], "ncsa"),
    ("proprietary", "(?:proprietary|commercial|evaluation)", [], "proprietary"),
]
#: Sentences of license texts and notices, and other single rules: label, pattern, priority, confidence.
SINGLE = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.98),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1, 0.97),
    ("mit", "the software is provided as is without warranty of any kind express or implied", 2, 0.8),
    ("x11", "except as contained in this notice the names? of", 2, 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 1, 0.97),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", 2, 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 1, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.92),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1, 0.95),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 0.95),
    ("apache", "you may not use this file except in compliance with the license", 1, 0.85),
    ("apache", "software distributed under the license is distributed on an as is basis", 1, 0.9),
    ("apache-2.0", "www apache org licenses license 2 0", 1, 0.98),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 2, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1, 0.97),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", 2, 0.85),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 1, 0.95),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", 2, 0.9),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 1, 0.99),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 1, 0.99),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1, 0.97),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 1, 0.95),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 1, 0.99),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 1, 0.99),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", 1, 0.97),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 1, 0.99),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 0.97),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 0.99),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 1, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1, 0.99),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", 1, 0.99),
    ("epl-2.0", "made available under the terms of the eclipse public license (?:v )?2 0", 1, 0.99),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 1, 0.97),
    ("cpl", "made available under the terms of the common public license", 1, 0.97),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", 1, 0.97),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 1, 0.99),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1, 0.99),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1, 0.97),
    ("wtfpl", "do what the fuck you want to public license", 1, 0.99),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.92),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 0.96),
    ("boost-1.0", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1, 0.98),
    ("boost-1.0", "www boost org license 1 0 txt", 1, 0.98),
    ("postgresql", "without fee and without a written agreement is hereby granted", 1, 0.95),
    ("python-2.0", "python software foundation license version 2", 1, 0.98),
    ("python", "psf is making python available to licensee on an as is basis", 1, 0.95),
    ("perl", "under the same terms as perl itself", 2, 0.85),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1, 0.95),
    ("php", "this product includes php software freely available from", 1, 0.9),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1, 0.98),
    ("openssl", "this product includes cryptographic software written by eric young", 1, 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1, 0.99),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 1, 0.9),
    ("eupl", "or as soon they will be approved by the european commission subsequent versions of the eupl", 1, 0.97),
    ("ncsa", "to deal with the software without restriction", 1, 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 1, 0.95),
    ("w3c", "this work is being provided by the copyright holders under the following license", 2, 0.85),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 1, 0.97),
    ("json", "the software shall be used for good not evil", 1, 0.98),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 1, 0.95),
    ("busl-1.1", "business source license 1 1", 1, 0.97),
    ("sspl", "server side public license", 2, 0.95),
    ("elastic-2.0", "elastic license 2 0", 2, 0.95),
    ("commons-clause", "without limiting other conditions in the license the grant of rights under the license will not include", 1, 0.95),
    ("odbl", "open (?:data commons open )?database license", 2, 0.9),
    ("odc-by", "open data commons attribution license", 2, 0.9),
    ("pddl", "public domain dedication and license", 2, 0.85),
    ("ogl", "open government licen[sc]e", 2, 0.9),
    ("ogl", "contains public sector information licensed under the open government licen[sc]e", 1, 0.97),
    ("cecill", "(?:cea cnrs inria logiciel libre|cecill (?:b |c )?licen[sc]e)", 2, 0.9),
    ("mulan", "mulan (?:permissive software license|psl)", 2, 0.9),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 2, 0.9),
    ("public-domain", "this (?:file|work|code|software|document) is in the public domain", 2, 0.9),
    ("public-domain", "no rights reserved", 3, 0.7),
    ("proprietary", "unauthorized (?:copying|use|distribution) of this (?:file|software) via any medium is strictly prohibited", 1, 0.95),
    ("proprietary", "this software is the confidential and proprietary information of", 1, 0.95),
    ("proprietary", "confidential and proprietary", 3, 0.6),
    ("proprietary", "no part of this (?:publication|document|work|book) may be reproduced", 2, 0.85),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", 3, 0.7),
    ("all-rights-reserved", "all rights reserved", 4, 0.6),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 4, 0.3),
]
PRIORITIES = 4
#: phrase: label. These hold always, whatever the rules say.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def rules() -> list[tuple[str, list[list[str]], str, int, float]]:
    """(label, sets of words of each of which a match has one, pattern over words, priority from 1, confidence), best first."""
    out = list(SINGLE)
    word = "licen[sc]e"
    for label, name, versions, spdx in FAMILIES:
        out.append((label, f"spdx {word} identifier {spdx}", 1, 1.0))
        for v in versions:
            out.append((f"{label}-{v.replace(' ', '.')}", f"spdx {word} identifier {spdx} {v}(?: (?:only|or later))?", 1, 1.0))
            out.append((f"{label}-{v.replace(' ', '.')}", f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{name}(?: {word})? (?:version |v )?{v}", 2, 0.95))
            out.append((f"{label}-{v.replace(' ', '.')}", f"{name}(?: {word})? (?:version |v )?{v}", 3, 0.9))
        out.append((label, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{name}(?: {word})?", 2, 0.85))
        out.append((label, f"{name} {word}", 4, 0.7))
        if spdx.startswith("cc "):  # the address of the license's page
            out += [(f"{label}-{v.replace(' ', '.')}", f"creativecommons org licenses {spdx[3:]} {v}", 1, 0.98) for v in versions]
    return sorted(((label, needed(pattern), pattern, priority, sure) for label, pattern, priority, sure in out), key=lambda r: r[3])


#: Words that tell little of a license, taken to gate a rule only where a part of its pattern has no other.
PLAIN = frozenset("the of terms in to or and a v c version license licence software public open free".split())


def expansions(pattern: str) -> list[str]:
    """The texts that a pattern matches; one of literals, groups, alternatives, ``?``, and sets of letters or digits (as ``#``)."""
    at = 0

    def alternatives() -> list[str]:
        nonlocal at
        out, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                out, now, at = out + now, [""], at + 1
                continue
            if c == "(":
                at += 3  # (?:
                part = alternatives()
                at += 1
            elif c == "[":
                end = pattern.index("]", at)
                part = ["#"] if "-" in pattern[at:end] else list(pattern[at + 1 : end])
                at = end + 1
            elif re.match("[a-z0-9 ]", c):
                part, at = [c], at + 1
            else:
                raise ValueError(f"not expanded: {pattern}")
            if many := re.compile(r"\{([0-9]+)\}").match(pattern, at):
                part, at = [x * int(many[1]) for x in part], many.end()
            elif pattern[at : at + 1] == "?":
                part, at = [*part, ""], at + 1
            now = [x + y for x in now for y in part]
        return out + now

    return alternatives()


@cache
def needed(pattern: str) -> list[list[str]]:
    """Sets of words, from each of which any match of the pattern has one: a set for each of its parts between spaces outside groups."""
    parts, depth = [""], 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == " " and not depth and pattern[i + 1 : i + 2] != "?":
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for part in parts:
        left, chosen = [{w for w in x.split() if "#" not in w} for x in expansions(part)], []
        while left and all(left):
            n = Counter(w for x in left for w in x)
            chosen.append(max(n, key=lambda w: (w not in PLAIN, n[w], len(w), w)))
            left = [x for x in left if chosen[-1] not in x]
        if not left:
            out.append(sorted(chosen))
    return out


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _found(text: Column, rule: Column) -> Column:
    """Detections of one rule: the pieces between matches tell how many words stand before each."""
    hits, between = F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at, n = acc["at"] + _spaces(pair["before"]), _spaces(pair["hit"])
        return F.struct((at + n).alias("at"), F.concat(acc["out"], F.array(F.struct((at - 1).alias("start"), (at + n).alias("end")))).alias("out"))

    pairs = F.filter(F.transform(F.arrays_zip(between.alias("before"), hits.alias("hit")), lambda p: F.struct(p["before"].alias("before"), p["hit"].alias("hit"))), lambda p: p["hit"].isNotNull())
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))


def _base(of: Column) -> Column:
    """Places of the base phrases, as structs (start, label); each ends in its last word, which all share."""
    last = {p.split()[-1] for p in BASE}
    ends = F.filter(F.sequence(F.lit(0), F.size(of)), lambda i: F.get(of, i).isin(*last))
    no = F.lit(None).cast("struct<start:int,label:string>")

    def named(i: Column) -> Column:
        out = no
        for phrase, label in BASE.items():
            parts = phrase.split()
            same = F.lit(True)
            for back, word in enumerate(reversed(parts)):
                same = same & F.coalesce(F.get(of, i - back) == word, F.lit(False))
            out = F.when(same, F.struct((i - (len(parts) - 1)).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(ends, named), lambda b: b.isNotNull())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, base (structs start, label), detections (structs start, end, label, priority, confidence), score.

    Starts and ends count words (from 0, ends exclusive). ``detections`` are what suppression leaves, by start; ``score`` is
    their best confidence, 0 without any. A null or empty text has no words. Repeated rows each give a row; null ids stay
    null; other columns are ignored; an empty table gives no rows. Only detections are shuffled.
    """
    table = rules()
    used = Counter(w for r in table for n in r[1] for w in n)
    need = [sorted(r[1], key=lambda n: sum(used[w] for w in n)) for r in table]  # the set that fewest rules share first
    groups: dict[tuple[str, ...], list[str]] = {}  # by the first set, as SQL: built word by word, so large an array takes seconds
    listed = lambda xs: f"array({', '.join(xs)})"
    quoted = lambda xs: listed(f"'{x}'" for x in xs)
    for (label, _, pattern, priority, sure), n in zip(table, need, strict=True):
        rest = listed(map(quoted, n[1:])) if n[1:] else "cast(array() AS array<array<string>>)"
        groups.setdefault(tuple(n[0]), []).append(f"named_struct('label', '{label}', 'need', {rest}, 'pattern', '(?<= )(?:{pattern})(?= )', 'priority', {priority}, 'confidence', {float(sure)}D)")
    literal = F.expr(listed(f"named_struct('first', {quoted(k)}, 'rules', {listed(v)})" for k, v in groups.items()))
    keywords = F.expr(quoted(sorted({w for n in need for x in n for w in x})))
    first = F.expr(quoted(sorted({w for k in groups for w in k} | {p.split()[-1] for p in BASE})))
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), words(ascii_lower(text), NOT_WORD).alias("words"))
    given = given.select("id", "key", "words", F.arrays_overlap("words", first).alias("any"))
    given = given.select("id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("any"), F.col("words")).alias("words"), F.when(F.col("any"), F.array_intersect("words", keywords)).alias("present"))
    near = F.flatten(F.transform(F.filter(literal, lambda g: F.arrays_overlap(g["first"], F.col("present"))), lambda g: g["rules"]))
    met = F.filter(near, lambda r: F.forall(r["need"], lambda n: F.arrays_overlap(n, F.col("present"))))
    given = given.select("id", "key", "n_words", "words", F.when(F.col("present").isNotNull(), met).alias("met"))
    given = given.select("id", "key", "n_words", "words", "met", F.when(F.size("met") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("line"))
    found = F.flatten(F.transform("met", lambda r: _found(F.col("line"), r)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,confidence:double>>")
    scanned = given.select("id", "key", "n_words", F.when(F.col("words").isNotNull(), _base(F.col("words"))).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("base"), F.when(F.col("line").isNotNull(), found).otherwise(none).alias("found"))
    scanned = written(scanned, "license-scan")

    spans = scanned.select("key", F.explode("found").alias("d")).distinct().select("key", "d.*")
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "priority", "label").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(*(F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order)) for p in range(1, PRIORITIES + 1)), F.lit(-1))
    kept = spans.withColumn("covered", best).where(F.col("covered") < F.col("end"))
    kept = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "priority", "confidence"))).alias("detections"), F.max("confidence").alias("score"))
    out = scanned.select("id", "key", "n_words", "base").join(kept, "key", "left")
    empty = F.array().cast("array<struct<start:int,end:int,label:string,priority:int,confidence:double>>")
    return out.select(F.col("id").alias(id_col), "n_words", "base", F.coalesce("detections", empty).alias("detections"), F.coalesce("score", F.lit(0.0)).alias("score"))
