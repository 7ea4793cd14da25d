"""License scans with ordered signature rules.

Hundreds of hand-written regular expressions over the normalised words of a
text (lower case, joined by single spaces).  A rule runs only on texts that
hold its keyword, which is part of everything the rule can match; texts
without any keyword run none.  Detections are
intervals of characters; a detection that lies inside one of a higher
priority class (full notices before names before bare mentions), or inside a
longer one of its own class, is suppressed.  Everything is one projection
over the scan: no shuffle, no Python.

The rules are data: a constant array of (class, label, keyword, expression,
weight), so adding one does not change the plan.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import let

#: Word boundaries of the contract: letters, digits and everything beyond ASCII are words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

NOTICE, NAME, MENTION = 0, 1, 2
_BLOCK = 128  # matches whose places are summed up together
WEIGHTS = {NOTICE: 1.0, NAME: 0.8, MENTION: 0.5}

# Full notices and grants: label, keyword, expression.
_NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files(?: the software)?)?"),
    ("mit", "the software is provided", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit", "copies or substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2.0", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "free software you can redistribute", r"(?:this program|it|this file) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "useful but without any warranty", r"in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu general public license for more details", r"see the gnu general public license for more details"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "general public", r"under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", r"under the terms of the gnu affero general public license"),
    ("mpl", "source code form is subject to", r"this source code form is subject to the terms of the mozilla public license(?: v 2 0)?"),
    ("epl", "eclipse public license", r"made available under the terms of the eclipse public license"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law", r"to the extent possible under law (?:\S+ ){1,12}waived all copyright"),
    ("cc-by", "creative commons attribution", r"licensed under a creative commons attribution"),
    ("wtfpl", "do what the", r"do what the \S+ you want to public license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", "boost software license", r"distributed under the boost software license"),
    ("ofl", "sil open font license", r"this font software is licensed under the sil open font license"),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|material)"),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:or transmitted )?in any form"),
    ("reserved", "no part of this", r"no part of this (?:publication|book|work|site) may be reproduced"),
    ("reserved", "reproduction", r"reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is prohibited"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})*"),
]

# License names: label, keyword, the forms of the name, versions in use (with
# the label's version suffix) or none.  Forms without the keyword have an entry
# of their own.
_NAMES = [
    ("apache", "apache", ["apache license", "apache software license", "apache public license"], ["1 0", "1 1", "2 0"]),
    ("gpl", "general public", ["gnu general public license"], ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", ["gnu gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "general public", ["gnu lesser general public license", "gnu library general public license"], ["2", "2 1", "3", "3 0"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["1", "3", "3 0"]),
    ("fdl", "free documentation", ["gnu free documentation license"], ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1 0", "2 0"]),
    ("edl", "eclipse", ["eclipse distribution license"], ["1 0"]),
    ("cpl", "common public", ["common public license"], ["1 0"]),
    ("cddl", "common development", ["common development and distribution license"], ["1 0", "1 1"]),
    ("cpal", "common public attribution", ["common public attribution license"], ["1 0"]),
    ("eupl", "european union public", ["european union public licence", "european union public license"], ["1 0", "1 1", "1 2"]),
    ("osl", "open software", ["open software license"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", ["academic free license"], ["2 0", "2 1", "3 0"]),
    ("artistic", "artistic", ["artistic license", "clarified artistic license"], ["1 0", "2 0"]),
    ("boost", "boost software", ["boost software license"], ["1 0"]),
    ("zpl", "zope public", ["zope public license"], ["1 1", "2 0", "2 1"]),
    ("ofl", "open font", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("python", "python", ["python software foundation license", "python license"], ["2", "2 0"]),
    ("php", "php license", ["php license"], ["3 0", "3 01"]),
    ("ruby", "ruby license", ["ruby license"], []),
    ("perl", "perl license", ["perl license"], []),
    ("ms-pl", "microsoft public", ["microsoft public license"], []),
    ("ms-rl", "microsoft reciprocal", ["microsoft reciprocal license"], []),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], []),
    ("upl", "universal permissive", ["universal permissive license"], ["1 0"]),
    ("w3c", "w3c", ["w3c software notice and license", "w3c software and document license", "w3c license"], []),
    ("postgresql", "postgresql license", ["postgresql license"], []),
    ("openssl", "openssl license", ["openssl license"], []),
    ("vim", "vim license", ["vim license"], []),
    ("json", "json license", ["json license"], []),
    ("x11", "x11", ["x11 license", "mit x11 license"], []),
    ("x11", "consortium", ["x consortium license"], []),
    ("mit", "mit", ["mit license", "mit licence"], []),
    ("mit", "expat", ["expat license"], []),
    ("mit-0", "no attribution", ["mit no attribution license"], []),
    ("isc", "isc", ["isc license", "isc licence"], []),
    ("isc", "consortium", ["internet systems consortium license"], []),
    ("bsd", "bsd", ["bsd license", "bsd licence", "bsd style license"], []),
    ("bsd", "berkeley", ["berkeley software distribution license"], []),
    ("bsd-2-clause", "bsd", ["2 clause bsd license", "bsd 2 clause license", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", "clause", ["3 clause bsd license", "bsd 3 clause license"], []),
    ("bsd-3-clause", "bsd", ["new or revised bsd license", "revised bsd license", "modified bsd license"], []),
    ("bsd-4-clause", "clause", ["4 clause bsd license", "bsd 4 clause license"], []),
    ("0bsd", "zero clause", ["zero clause bsd license", "bsd zero clause license"], []),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], []),
    ("libpng", "libpng", ["libpng license"], ["2 0"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense license"], []),
    ("wtfpl", "wtfpl", ["wtfpl license", "wtfpl"], ["2"]),
    ("beerware", "beer", ["beerware license", "beer ware license"], []),
    ("bsl", "business source", ["business source license"], ["1 0", "1 1"]),
    ("sspl", "server side public", ["server side public license"], ["1"]),
    ("elastic", "elastic license", ["elastic license"], ["2 0"]),
    ("odbl", "open database", ["open database license", "open data commons open database license"], ["1 0"]),
    ("odc-by", "open data commons", ["open data commons attribution license"], ["1 0"]),
    ("pddl", "public domain dedication", ["open data commons public domain dedication and license", "public domain dedication"], ["1 0"]),
    ("ogl", "open government", ["open government licence", "open government license"], ["1 0", "2 0", "3 0"]),
    ("opl", "open publication", ["open publication license"], ["1 0"]),
    ("cecill", "cecill", ["cecill free software license agreement", "cecill license"], ["1 0", "2 0", "2 1"]),
    ("mulan", "mulan", ["mulan permissive software license", "mulan psl"], ["1", "2"]),
    ("cc-by", "creative commons", ["creative commons attribution"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "creative commons", ["creative commons attribution sharealike", "creative commons attribution share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "creative commons", ["creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nd", "creative commons", ["creative commons attribution noderivatives", "creative commons attribution no derivatives", "creative commons attribution noderivs"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution noncommercial sharealike"], ["3 0", "4 0"]),
    ("cc-by-nc-nd", "creative commons", ["creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"], ["3 0", "4 0"]),
    ("cc0", "creative commons", ["creative commons zero"], ["1 0"]),
    ("cc0", "cc0", ["cc0 public domain dedication"], ["1 0"]),
]

# Short forms, tags and addresses (as words): label, keyword, expression.
_MENTIONS = [
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"), ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"), ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v| version)? ?[123]?(?: 0)?(?: or later| only)?"),
    ("gpl", "gplv", r"gplv[123]"), ("lgpl", "lgpl", r"lgpl ?(?:v ?)?(?:2 1|2 0|3 0|2|3)?(?: or later| only)?"),
    ("lgpl", "lgplv", r"lgplv[23]"), ("agpl", "agpl", r"agpl ?(?:v ?)?3?(?: 0)?(?: or later| only)?"),
    ("apache-2.0", "apache 2", r"apache 2 0"), ("mpl-2.0", "mpl", r"mpl 2 0"), ("mpl-1.1", "mpl", r"mpl 1 1"),
    ("epl-1.0", "epl", r"epl 1 0"), ("epl-2.0", "epl", r"epl 2 0"), ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("ofl-1.1", "ofl", r"ofl 1 1"), ("cddl-1.0", "cddl", r"cddl 1 0"), ("eupl-1.2", "eupl", r"eupl 1 2"),
    ("artistic-2.0", "artistic 2", r"artistic 2 0"), ("bsd-2-clause", "bsd 2", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause"), ("bsd-4-clause", "bsd 4", r"bsd 4 clause"), ("0bsd", "0bsd", r"0bsd"),
    ("mit", "under the mit", r"(?:released|licensed|distributed|available) under the mit"),
    ("mit", "under mit", r"(?:released|licensed|distributed|available) under mit"),
    ("bsd", "under the bsd", r"(?:released|licensed|distributed|available) under the bsd"),
    ("bsd", "under bsd", r"(?:released|licensed|distributed|available) under bsd"),
    ("apache", "under the apache", r"(?:released|licensed|distributed|available) under the apache"),
    ("apache", "under apache", r"(?:released|licensed|distributed|available) under apache"),
    ("spdx", "spdx license identifier", r"spdx license identifier \S+(?: [0-9]+)*"),
    ("mit", "opensource org licenses", r"opensource org licenses mit"),
    ("bsd", "opensource org licenses", r"opensource org licenses bsd \S+"),
    ("apache-2.0", "www apache org licenses", r"www apache org licenses license 2 0"),
    ("gpl", "www gnu org", r"www gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", "www gnu org", r"www gnu org (?:licenses|copyleft) lgpl"),
    ("agpl", "www gnu org", r"www gnu org licenses agpl"),
    ("cc-by", "creativecommons org licenses", r"creativecommons org licenses by(?: [0-9] [0-9])?"),
    ("cc-by-sa", "creativecommons org licenses", r"creativecommons org licenses by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", "creativecommons org licenses", r"creativecommons org licenses by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", "creativecommons org licenses", r"creativecommons org licenses by nd(?: [0-9] [0-9])?"),
    ("cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("reserved", "some rights reserved", r"some rights reserved"),
    ("copyright", "copyright notice", r"copyright notice"), ("copyright", "copyrighted", r"copyrighted (?:material|work|software)"),
    ("proprietary", "trade secret", r"trade secrets? of"), ("proprietary", "license agreement", r"end user license agreement"),
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(class, label, keyword, expression, weight), in order of priority."""
    out = [(NOTICE, label, keyword, e) for label, keyword, e in _NOTICES]
    for label, keyword, forms, versions in _NAMES:
        for form in forms:
            for v in versions:
                out.append((NOTICE, f"{label}-{v.replace(' ', '.')}", keyword,
                            rf"{form} (?:v |version )?{v}(?: or (?:any )?later(?: version)?)?"))
            out.append((NAME, label, keyword, form))
    out += [(MENTION, label, keyword, e) for label, keyword, e in _MENTIONS]
    return [(c, label, keyword, f"(?<= )(?:{e})(?= )", WEIGHTS[c]) for c, label, keyword, e in sorted(
        out, key=lambda r: r[0])]


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("class"), F.lit(label).alias("label"), F.lit(k).alias("keyword"),
                              F.lit(e).alias("regex"), F.lit(w).alias("weight")) for c, label, k, e, w in rules()])


def _detections(text: Column, rule: Column) -> Column:
    """Intervals (start, end) of one rule's matches.

    Every match and the piece before it have a length; a match starts where
    the lengths before it end.  Those sums are taken in blocks: once per block
    over all lengths, then inside the block, so no list grows match by match.
    """
    def from_lengths(lengths: Column) -> Column:
        n = F.size(lengths)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                             lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

        def total(block: Column) -> Column:
            return F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["hit"])

        def spans(block: Column, offset: Column) -> Column:
            return F.transform(block, lambda x, i: F.struct(
                (offset + total(F.slice(block, 1, i)) + x["gap"]).alias("start"),
                (offset + total(F.slice(block, 1, i + 1))).alias("end"),
                rule["class"].alias("class"), rule["label"].alias("label"), rule["weight"].alias("weight")))

        def placed(blocks: Column) -> Column:
            return let(F.transform(blocks, total), lambda totals: F.flatten(F.transform(
                blocks, lambda block, b: let(F.aggregate(F.slice(totals, 1, b), F.lit(0), lambda acc, x: acc + x),
                                             lambda offset: spans(block, offset)))))
        return let(blocks, placed)

    hits = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    # As many pieces as matches and one more, which goes.
    return let(F.filter(F.arrays_zip(
        F.transform(F.split(text, rule["regex"]), lambda x: F.length(x)).alias("gap"),
        F.transform(hits, lambda x: F.length(x)).alias("hit")), lambda x: x["hit"].isNotNull()), lambda lengths: F.when(
            F.size(lengths) == 0, F.array().cast("array<struct<start:int,end:int,class:int,label:string,weight:double>>"))
        .otherwise(from_lengths(lengths)))


def _survivors(found: Column) -> Column:
    """Struct of the distinct labels, the number and the highest weight of the
    detections that no other suppresses.

    Sorted by start, longest first, an interval lies inside an earlier one of
    class c exactly when the furthest end of class c so far reaches its own
    end; so one pass with one running end per class decides.  Equal intervals
    of one class: the first by label stays.
    """
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("back"), x["class"].alias("class"), x["label"].alias("label"),
        x["weight"].alias("weight"))))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        inside = ((acc["e0"] >= end) | ((x["class"] >= NAME) & (acc["e1"] >= end))
                  | ((x["class"] >= MENTION) & (acc["e2"] >= end)))

        def reach(name: str, c: int) -> Column:
            return F.when(x["class"] == c, F.greatest(acc[name], end)).otherwise(acc[name]).alias(name)
        return F.struct(
            reach("e0", NOTICE), reach("e1", NAME), reach("e2", MENTION),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            F.when(inside, acc["weight"]).otherwise(F.greatest(acc["weight"], x["weight"])).alias("weight"))
    start = F.struct(F.lit(-1).alias("e0"), F.lit(-1).alias("e1"), F.lit(-1).alias("e2"),
                     F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0.0).alias("weight"))
    return F.aggregate(ordered, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels,
    n_detections, score: one row per document.

    The base phrases count at every place where their words stand
    consecutively; first_word and last_word are the smallest and the largest
    word number where one starts (null: none).  ``labels`` adds the labels of
    the surviving detections; ``score`` is their highest weight (base phrases
    count as names), 0 without any.  Null text counts as empty.
    """
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    # One space before, between and after the words.
    joined = F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), NOT_WORD, " ")
    thin = docs.select(F.col(id_col).alias("id"), joined.alias("norm"))
    n_words = F.greatest(F.size(F.split("norm", " ")) - 2, F.lit(0)).cast("long")

    def words_in(part: Column) -> Column:  # of a text that starts with a space
        return F.size(F.split(part, " ")) - 1

    def base(norm: Column) -> Column:
        """Places, first and last start of the base phrases, with their labels."""
        hits = [norm.contains(f" {p} ") for p, _ in BASE]
        places = [F.when(h, F.size(F.regexp_extract_all(norm, F.lit(f"(?<= ){p}(?= )"), F.lit(0)))).otherwise(0)
                  for h, (p, _) in zip(hits, BASE)]
        first = [F.when(h, words_in(F.substring_index(norm, f" {p} ", 1))) for h, (p, _) in zip(hits, BASE)]
        last = [F.when(h, words_in(norm) - 1 - words_in(F.concat(F.lit(" "), F.substring_index(norm, f" {p} ", -1)))
                       + 1 - len(p.split())) for h, (p, _) in zip(hits, BASE)]
        return F.struct(sum(places[1:], places[0]).cast("long").alias("n_base"),
                        F.least(*first).cast("long").alias("first_word"),
                        F.greatest(*last).cast("long").alias("last_word"),
                        F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(hits, BASE)]))
                        .alias("labels"))

    keywords = sorted({r[2] for r in rules()})

    def method(norm: Column) -> Column:
        def run(present: Column) -> Column:
            active = F.filter(_rule_table(), lambda r: F.array_contains(present, r["keyword"]))
            return let(F.flatten(F.transform(active, lambda r: _detections(norm, r))), _survivors)
        present = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(norm, k))
        return let(present, run)

    found = thin.select("id", n_words.alias("n_words"), let(F.col("norm"), lambda norm: F.struct(
        base(norm).alias("base"), method(norm).alias("more"))).alias("f"))
    labels = F.array_sort(F.array_union("f.base.labels", "f.more.labels"))
    return found.select(
        F.col("id").alias(id_col), "n_words", "f.base.n_base", "f.base.first_word", "f.base.last_word",
        F.array_join(F.array_sort("f.base.labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.col("f.more.n").cast("long").alias("n_detections"),
        F.greatest("f.more.weight", F.when(F.col("f.base.n_base") > 0, WEIGHTS[NAME]).otherwise(0.0)).alias("score"))
