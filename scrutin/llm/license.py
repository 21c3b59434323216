"""License scans: sparse TF-IDF cosine of statements to templates, inherited
from the nearest ancestor directory.

A text is cut into statements (lines, sentences within a line, blocks of lines
such as a comment header, and sentences across a block's lines). Their words become sparse TF-IDF vectors and are compared with the vectors of the
license templates; inverse document frequencies are those of the template
collection, words outside it weigh most. A file's license is that of its
most similar statement from ``SIMILAR`` on; a file named like a license file
(LICENSE, LICENCE, COPYING, NOTICE, with or without an ending) also counts as
one statement as a whole, and sets the license of its directory. Files
without a license of their own take the license of the nearest directory at
or above theirs that has one. Paths are joined by equality on ancestor
directories; a directory's ancestors are as many as its path has parts.

Only statements that can reach ``SIMILAR`` are exploded to words; the others
are left out inside their row, by exact bounds. First, a statement must hold
one of the ``telling_words``: of each template the commonest words are left out
as long as their squared weights stay below ``SIMILAR`` squared, and by
Cauchy-Schwarz a statement without any other word of it has a cosine below
``SIMILAR``. Then its words are counted: a word that is not common adds at most
its weight times its largest weight in a template to the product, the common
ones together at most their norm times the largest norm that common words have
in a template; and the norm is that of the words inside the collection and at
least that of equally frequent words outside. What is left is bounded once more
with the common words' exact product with each template.

Edge cases: null and empty texts have no license of their own; a null path is
a file without directory (nothing to inherit); of equally similar templates
the first by name counts, of several license files in a directory the most
similar one, then the first by path; repeated rows give repeated results; an
empty table stays empty; added columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without, written

#: Statements by which licenses are recognised: (license, text); the oracle knows these.
ORACLE_TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Further names of licenses: (license, names in running text).
NAMES = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0")),
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("Unlicense",)),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0")),
    ("BSL-1.0", ("Boost Software License, Version 1.0",)),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    *((f"CC-{k}-{v}", (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {words} {v} {area} License"))
      for k, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                       ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, area in (("4.0", "International"), ("3.0", "Unported"))),
)
PHRASES = ("{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.",
           "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
           "This program is licensed under the {}.", "This file is licensed under the {}.", "This software is released under the {}.",
           "License: {}")
#: SPDX identifiers as they stand in SPDX lines.
SPDX = tuple((n, i) for n, _ in NAMES for i in ([n, n + "-only", n + "-or-later", n + "+"] if "GPL" in n else [n]))
_GNU = ("{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
        "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
_GNU_ONLY = ("{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
             "version {} as published by the Free Software Foundation.")
#: Standard headers, headings of license files and permission texts.
HEADERS = (
    *((name, form.format(what, ":", kind, *rest, version))
      for name, kind, version in (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("LGPL-3.0", "Lesser ", "3"),
                                  ("LGPL-2.1", "Lesser ", "2.1"), ("AGPL-3.0", "Affero ", "3"))
      for what in ("This program", "This library", "This file") for form, rest in ((_GNU, (",",)), (_GNU_ONLY, ()))),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
             "it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"), ("GPL", "Licensed under the GNU General Public License."), ("GPL", "Licensed under the GPL."),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE"), ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("LGPL", "Licensed under the LGPL."),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE"), ("AGPL", "Licensed under the GNU Affero General Public License."),
    ("AGPL", "Licensed under the AGPL."),
)
#: Words that name a license alone.
LONE = frozenset("gplv2 gplv3 lgplv2.1 lgplv3 agplv3 gpl lgpl agpl cc0".split())
#: Licenses named only if a file has no other: those without version or clauses.
WEAK = ("AGPL", "BSD", "GPL", "LGPL")
#: Words one of which a statement must hold to be compared by the oracle.
ANCHORS = ("license", "licensed", "licence", "licenced", "spdx", "permission", "cc0", "cc", "mit", "gnu", "bsd", "apache",
           "mozilla", "affero")
#: Words that texts without a license hold as often; the bound of ``telling_words`` leaves them out first.
COMMON = frozenset("a all an and any are as at be by for from in is it no not of on or that the this to with".split())
#: Cosine from which a statement is a license's.
SIMILAR = 0.6
#: Digits kept of a cosine, so sums in any order compare equal.
DIGITS = 6

_WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"
_LICENSE_FILE = r"(?i)(^|/)(license|licence|copying|notice)(\.[^/]*)?$"


def template_weights(templates) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """``(template, word, weight / norm)`` rows, the inverse document frequency
    of template words in ``ORACLE_TEMPLATES`` (phrasings of one license do not
    make its words common), and that of all others."""
    bags = [Counter(re.findall(_WORDS, t.lower())) for _, t in templates]
    base = [set(re.findall(_WORDS, t.lower())) for _, t in ORACLE_TEMPLATES]
    df = Counter(w for b in base for w in b)
    other = math.log(1 + len(base)) + 1
    idf = {w: math.log((1 + len(base)) / (1 + df[w])) + 1 for b in bags for w in b}
    rows = []
    for i, b in enumerate(bags):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items()))
        rows += [(i, w, c * idf[w] / norm) for w, c in sorted(b.items())]
    return rows, idf, other


def _lone(templates) -> set[int]:
    """Templates, but for the oracle's, that a single ordinary word reaches."""
    return {t for t, w, x in template_weights(templates)[0] if x >= SIMILAR and w not in LONE and templates[t] not in ORACLE_TEMPLATES}


def _templates() -> tuple[tuple[str, str], ...]:
    """All templates; of generated ones that a single word reaches, the SPDX lines only."""
    spdx = tuple((n, f"SPDX-License-Identifier: {i}") for n, i in SPDX)
    made = (*HEADERS, *((n, p.format(name)) for n, names in NAMES for name in names for p in PHRASES))
    lone = _lone(made)
    return tuple(dict.fromkeys((*ORACLE_TEMPLATES, *(m for i, m in enumerate(made) if i not in lone), *spdx)))


TEMPLATES = _templates()


def telling_words(templates=TEMPLATES) -> list[str]:
    """Words without any of which no statement reaches ``SIMILAR``."""
    rows, idf, _ = template_weights(templates)
    by_template: dict[int, list[tuple[bool, float, str, float]]] = {}
    for t, w, x in rows:
        by_template.setdefault(t, []).append((w not in COMMON, idf[w], w, x))
    # rounding to DIGITS lifts a cosine by half a digit at most
    bound, telling = (SIMILAR - 10 ** -DIGITS) ** 2, set()
    for words in by_template.values():
        held = 0.0
        for *_, w, x in sorted(words):
            held += x * x
            if held >= bound:
                telling.add(w)
    return sorted(telling)


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _possible(units: Column, templates=TEMPLATES) -> Column:
    """Those of some statements that can reach ``SIMILAR``."""
    rows, idf, other = template_weights(templates)
    least = SIMILAR - 10 ** -DIGITS - 1e-9  # rounding to DIGITS lifts a cosine by half a digit at most
    most: dict[str, float] = {}
    light: dict[int, dict[str, float]] = {}
    for t, w, x in rows:
        most[w] = max(most.get(w, 0.0), x)
        if w in COMMON:
            light.setdefault(t, {})[w] = x * idf[w]
    norm = max((math.sqrt(sum((x / idf[w]) ** 2 for w, x in v.items())) for v in light.values()), default=0.0)
    # templates whose common words weigh no more than another's say nothing new
    vectors = [v for v in {tuple(sorted(v.items())): v for v in light.values()}.values()]
    vectors = [v for v in vectors if not any(
        u is not v and all(u.get(w, 0.0) >= x for w, x in v.items()) for u in vectors)]
    common = sorted({w for v in vectors for w in v})
    inside, telling = sorted(idf), telling_words(templates)
    # of a word inside: its inverse document frequency, and its largest part of a product if it is not common
    known = _literal_map([(w, f) for w, f in sorted(idf.items())])
    heavy = _literal_map([(w, 0.0 if w in COMMON else most[w] * idf[w]) for w in inside])
    shared = _literal_map([(w, 1.0 if w in COMMON else 0.0) for w in inside])

    def flushed(acc: Column, word: Column, n: Column) -> Column:
        seen = acc["w"] != ""
        weight = F.when(seen, acc["n"] * known[acc["w"]]).otherwise(0.0)
        return F.struct(word.alias("w"), n.alias("n"), (acc["k"] + seen.cast("double")).alias("k"),
                        (acc["heavy"] + F.when(seen, acc["n"] * heavy[acc["w"]]).otherwise(0.0)).alias("heavy"),
                        (acc["light"] + F.when(seen, weight * weight * shared[acc["w"]]).otherwise(0.0)).alias("light"),
                        (acc["inner"] + weight * weight).alias("inner"))

    def count(acc: Column, word: Column) -> Column:
        more = F.struct(acc["w"].alias("w"), (acc["n"] + 1).alias("n"), acc["k"].alias("k"), acc["heavy"].alias("heavy"),
                        acc["light"].alias("light"), acc["inner"].alias("inner"))
        return F.when(acc["w"] == word, more).otherwise(flushed(acc, word, F.lit(1.0)))

    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), *[F.lit(0.0).alias(c) for c in ("k", "heavy", "light", "inner")])
    cut = F.transform(units, lambda u: F.struct(u.alias("u"), F.regexp_extract_all(u, F.lit(f"({_WORDS})")).alias("w")))
    told = F.filter(cut, lambda x: F.exists(x["w"], lambda w: w.isin(telling)))
    parted = F.transform(told, lambda x: F.struct(
        x["u"].alias("u"), F.sort_array(F.filter(x["w"], lambda w: w.isin(inside))).alias("i"),
        F.size(x["w"]).cast("double").alias("n"), F.size(F.array_distinct(x["w"])).cast("double").alias("d")))
    summed = F.transform(parted, lambda x: F.struct(
        x["u"].alias("u"), x["i"].alias("i"), (x["n"] - F.size(x["i"])).alias("n"), x["d"].alias("d"),
        F.aggregate(x["i"], start, count, lambda acc: flushed(acc, F.lit(""), F.lit(0.0))).alias("s")))
    # words outside, as evenly frequent as can be
    outer = lambda x: F.when(x["n"] > 0, x["n"] * x["n"] / (x["d"] - x["s"]["k"]) * (other * other)).otherwise(0.0)
    needed = lambda x: F.sqrt(x["s"]["inner"] + outer(x)) * least
    near = F.filter(summed, lambda x: x["s"]["heavy"] + F.sqrt(x["s"]["light"]) * norm >= needed(x))
    if not vectors:
        return F.transform(near, lambda x: x["u"])
    words = F.array(*[F.lit(w) for w in common])
    exact = F.transform(near, lambda x: F.struct(x["u"].alias("u"), (needed(x) - x["s"]["heavy"]).alias("left"), F.transform(
        words, lambda c: F.size(F.filter(x["i"], lambda w: w == c))).alias("tf")))

    def product(tf: Column) -> Column:
        sums = []
        for v in vectors:
            total = F.lit(0.0)
            for w, x in v.items():
                total = total + F.element_at(tf, common.index(w) + 1) * x
            sums.append(total)
        return F.array_max(F.array(*sums))

    return F.transform(F.filter(exact, lambda x: product(x["tf"]) >= x["left"]), lambda x: x["u"])


def statements(text: str) -> Column:
    """The statements of a text: sentences of lines, and blocks (lines up to
    one without a word, such as joined comment lines) and their sentences."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    ends = r"[ \t](?<=[.!?;][ \t])[ \t]*"  # blanks behind the end of a sentence
    blocks = F.filter(F.split(body, r"\n(?:[^a-z0-9\n]*\n)+"), lambda b: b.contains("\n"))
    joined = F.transform(blocks, lambda b: F.regexp_replace(b, r"\n[^a-z0-9\n]*", " "))
    cut = F.concat(F.split(body, rf"\n|{ends}"), joined, F.flatten(F.transform(joined, lambda b: F.split(b, ends))))
    return F.array_distinct(cut)


def own_licenses(df: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``df`` less ``text``, with ``license`` and ``score`` of the file's most
    similar statement (null below ``SIMILAR``)."""
    rows, idf, other = template_weights(templates)
    names = [n for n, _ in templates]
    weights = F.broadcast(df.sparkSession.createDataFrame(rows, "t int, w string, weight double"))
    plain = without(df, "license", "score")
    marked = plain.withColumn("__row", F.monotonically_increasing_id())
    whole = F.when(F.coalesce(F.col(path), F.lit("")).rlike(_LICENSE_FILE),
                   F.array(F.lower(F.coalesce(F.col(text), F.lit("")))))
    units = F.array_union(statements(text), F.coalesce(whole, F.array().cast("array<string>")))
    units = _possible(units, templates)
    # rows are numbered once, in a table, so both uses see the same numbers
    marked = written(marked.withColumn("__units", units).drop(text))
    unit = marked.select("__row", F.explode("__units").alias("__s")).withColumn("__u", F.md5("__s"))
    # a statement is compared once, however many files hold it
    texts = written(unit.groupBy("__u").agg(F.first("__s").alias("__s")))
    word = texts.select("__u", F.explode(F.regexp_extract_all("__s", F.lit(f"({_WORDS})"))).alias("w"))
    bag = word.groupBy("__u", "w").agg(F.count(F.lit(1)).alias("tf"))
    bag = bag.withColumn("x", F.col("tf") * F.coalesce(_literal_map(sorted(idf.items()))[F.col("w")], F.lit(other)))
    norm = bag.groupBy("__u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = bag.join(weights, "w").groupBy("__u", "t").agg(
        F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("hits"))
    lone = _lone(templates)
    if lone:  # a word alone, such as a name in other use, is no statement
        dots = dots.filter((F.col("hits") > 1) | ~F.col("t").isin(sorted(lone)))
    cosine = dots.join(norm, "__u").withColumn("score", F.round(F.col("dot") / F.col("norm"), DIGITS))
    named = cosine.filter(F.col("score") >= SIMILAR).withColumn("license", F.array(*[F.lit(n) for n in names])[F.col("t")])
    # each statement names its most similar template's license, then the file takes the best of them
    by_unit = written(named.groupBy("__u").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("v")))
    best = written(unit.join(by_unit, "__u").groupBy("__row").agg(F.min(F.struct(
        F.col("v.license").isin(*WEAK).alias("weak"), F.col("v.s").alias("s"), F.col("v.license").alias("license"))).alias("b")))
    out = marked.drop("__units").join(best, "__row", "left")
    return out.select(*[F.col(f"`{c}`") for c in plain.columns if c != text], F.col("b.license").alias("license"),
                      (-F.col("b.s")).alias("score"))


def directory(path: str) -> Column:
    """The directory of a path ('' at the top)."""
    return F.regexp_replace(F.col(path), r"/?[^/]*$", "")


def ancestors(folder: str) -> Column:
    """``folder`` and all directories above it, '' last."""
    parts = F.split(F.col(folder), "/")
    return F.concat(F.when(F.col(folder) == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))), F.array(F.lit("")))


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (with ``license`` and ``score``) with ``origin`` ('own',
    'inherited' or null), ``license_path`` (the license file that an inherited
    license comes from); ``license`` is filled in where it is inherited."""
    base = without(files, "origin", "license_path").withColumn("__dir", directory(path))
    source = base.filter(F.col("license").isNotNull() & F.col(path).rlike(_LICENSE_FILE))
    by_dir = written(source.groupBy("__dir").agg(F.min(F.struct(
        (-F.col("score")).alias("s"), F.col(path).alias("p"), F.col("license").alias("l"))).alias("v"))
        .select(F.col("__dir").alias("__up"), F.col("v.p").alias("license_path"), F.col("v.l").alias("__l")))
    # one row per directory and ancestor; the files join their own directory only
    dirs = base.filter("__dir is not null").select("__dir").distinct().select(
        "__dir", F.explode(ancestors("__dir")).alias("__up"))
    near = written(dirs.join(by_dir, "__up").groupBy("__dir").agg(F.max(F.struct(
        F.length("__up").alias("d"), "license_path", "__l")).alias("v")).select(
        F.col("__dir").alias("__at"), "v.license_path", "v.__l"))
    out = base.join(near, F.col("__dir") == F.col("__at"), "left")
    own = F.col("license").isNotNull()
    keep = [F.col(f"`{c}`") for c in files.columns if c.lower() not in ("license", "origin", "license_path")]
    return out.select(
        *keep, F.coalesce("license", "__l").alias("license"),
        F.when(own, "own").when(F.col("__l").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("license_path")).alias("license_path"))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Own and inherited licenses of all files."""
    return inherit(own_licenses(files, path, text, templates), path)


def document_path() -> Column:
    """A document as a file of its source's tree: source/language/thousand;
    every tenth is the license file of its directory."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                       F.floor(F.col("doc_id") / 1000).cast("string"), name)


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licenses of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    return scan(docs).select("doc_id", "path", "license", "score", "origin", "license_path")


def _sql() -> str:
    rows, idf, other = template_weights(ORACLE_TEMPLATES)
    values = ", ".join(f"({t}, '{w}', {x!r}::DOUBLE, '{ORACLE_TEMPLATES[t][0]}')" for t, w, x in rows)
    idfs = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    anchors = "|".join(ANCHORS)
    return rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'),
        CAST(floor(doc_id / 1000) AS BIGINT)::VARCHAR,
        CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path FROM documents),
tw(t, w, weight, license) AS (VALUES {values}),
ti(w, idf) AS (VALUES {idfs}),
cut AS (SELECT r, path, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?;])[ \t]+', '\1' || chr(10), 'g'),
        chr(10))) AS s FROM f),
u AS (SELECT DISTINCT r, s FROM cut WHERE regexp_matches(s, '\b(?:{anchors})\b')
      UNION SELECT r, lower(coalesce(text, '')) FROM f WHERE regexp_matches(path, '(^|/)(license|licence|copying|notice)(\.[^/]*)?$', 'i')),
w AS (SELECT r, s, unnest(regexp_extract_all(s, '{_WORDS}')) AS w FROM u),
bag AS (SELECT r, s, w, count(*) * coalesce(any_value(idf), {other!r}::DOUBLE) AS x FROM w LEFT JOIN ti USING (w) GROUP BY r, s, w),
norm AS (SELECT r, s, sqrt(sum(x * x)) AS norm FROM bag GROUP BY r, s),
dots AS (SELECT r, s, t, license, sum(x * weight) AS dot FROM bag JOIN tw USING (w) GROUP BY r, s, t, license),
c AS (SELECT r, license, round(dot / norm, {DIGITS}) AS score FROM dots JOIN norm USING (r, s)),
own AS (SELECT r, license, score FROM c WHERE score >= {SIMILAR}
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
g AS (SELECT f.r, doc_id, path, license, score, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f LEFT JOIN own USING (r)),
d AS (SELECT dir AS up, path AS license_path, license AS l FROM g
      WHERE license IS NOT NULL AND regexp_matches(path, '(^|/)(license|licence|copying|notice)(\.[^/]*)?$', 'i')
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
near AS (SELECT g.r, d.license_path, d.l FROM g JOIN d ON g.dir = d.up OR starts_with(g.dir, d.up || '/') OR d.up = ''
         QUALIFY row_number() OVER (PARTITION BY g.r ORDER BY length(d.up) DESC) = 1)
SELECT doc_id, path, coalesce(license, l) AS license, score,
    CASE WHEN license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN license IS NULL THEN license_path END AS license_path
FROM g LEFT JOIN near USING (r)
"""


QUERIES = {"op10_license": op10_license}
ORACLE_SQL = {"op10_license": _sql()}
