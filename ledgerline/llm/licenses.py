"""License scans by sentence rules, as one projection of built-in functions.

A text is cut into sentences, each normalised sentence is looked up among known licence sentences, and the sequence
of the identifiers found is matched against ordered rules: a rule that matches takes its identifiers out of the
sequence, so later rules see only what is left.  Lines that a paragraph was wrapped into are joined first, without the
marks of comments before them; as a notice may also be a line without a full stop, single lines are looked up too.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_or_empty


class Rule(NamedTuple):
    licence: str
    sentences: tuple[str, ...]


#: Sentences of public licence texts and notices.
SENTENCES = {
    "apache2_grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2_use": "you may not use this file except in compliance with the License.",
    "apache2_copy": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache2_copy_line": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl_free": "This program is free software:",
    "gpl_free_2": "This program is free software;",
    "gpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2_either": "either version 2 of the License, or (at your option) any later version.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21_library": "This library is free software;",
    "lgpl21_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21_either": "either version 2.1 of the License, or (at your option) any later version.",
    "agpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl2_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "wtfpl_terms": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "mit0_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public_domain": "This work is released into the public domain.",
}

#: Names that notices give to licences, and the identifiers that mark them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache-2.0"),
    "MIT": ("MIT License", "MIT license", "MIT"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3 or later", "GPL version 3 or later"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2 or later", "GPL version 2 or later"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later", "LGPL version 3 or later"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later", "LGPL version 2.1 or later"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later", "AGPL version 3 or later"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"),
    "AFL-3.0": ("Academic Free License 3.0", "Academic Free License v3.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0",),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CDDL-1.0": ("CDDL 1.0", "CDDL version 1.0"),
    "ECL-2.0": ("Educational Community License 2.0", "Educational Community License, Version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2", "EUPL v1.2"),
    "GFDL-1.3-only": ("GNU Free Documentation License, version 1.3", "GNU Free Documentation License 1.3"),
    "LPPL-1.3c": ("LaTeX Project Public License 1.3c", "LaTeX Project Public License, version 1.3c"),
    "MIT-0": ("MIT No Attribution License",),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1"),
    "MS-PL": ("Microsoft Public License", "Ms-PL"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA Open Source License"),
    "ODbL-1.0": ("Open Database License 1.0", "Open Database License v1.0"),
    "OFL-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python License 2.0", "Python Software Foundation License Version 2"),
    "WTFPL": ("WTFPL License", "WTFPL"),
    "X11": ("X11 License",),
    "ZPL-2.1": ("Zope Public License 2.1", "Zope Public License, Version 2.1"),
}
#: Exceptions that stand behind WITH in marked lines.
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception")
#: What stands before the name in a notice, in normalised words; all that counts of it is "under".
FORM = "^(?:(?:this|the) (?:work|project|software|program|library|file|code|document|material) is )?(?:licensed|released|distributed|published|made available|available|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?"
#: A sentence that only says that something is licensed so, and what joins the names of several licences in a notice.
LICENSED, JOINED = "^(?:this|the) (?:work|project|software|program|library|file|code|document|material) is (.+) licensed$", " (?:and the|and|or the) "
SPDX = "SPDX-License-Identifier:"
#: Marked lines hold expressions: an operator opens a marked line of its own, so many times, and "+" is a later version.
OPERATOR, LATER, OPERATORS = f"({SPDX}[^\\n]*?)[ \\t]+(?:OR|AND|WITH|or|and|with)[ \\t]+", f"({SPDX}[ \\t(]*[A-Za-z0-9.-]+)[+]", 8


def _notices() -> dict[str, tuple[str, ...]]:
    """The known sentences, the notices of each name, and the identifiers of a marked line."""
    lines = {f"line_{k}": tuple(f"Licensed under {name}" for name in names) for k, names in NAMES.items()}
    return {**{k: (s,) for k, s in SENTENCES.items()}, **lines, "spdx": (SPDX,), **{f"id_{k}": (k,) for k in (*NAMES, *EXCEPTIONS)}}


#: In the order in which they are tried: a longer rule stands before a rule that is a part of it.
RULES = (
    Rule("Apache-2.0", ("apache2_grant", "apache2_use", "apache2_copy")),
    Rule("Apache-2.0", ("apache2_grant", "apache2_use", "apache2_copy_line")),
    Rule("Apache-2.0", ("apache2_grant", "apache2_use")),
    Rule("MIT", ("mit_grant", "mit_notice")),
    Rule("MIT-0", ("mit0_grant",)),
    Rule("AGPL-3.0-or-later", ("gpl_free", "agpl3_terms")),
    Rule("LGPL-3.0-or-later", ("gpl_free", "lgpl3_terms")),
    Rule("LGPL-2.1-or-later", ("lgpl21_library", "lgpl21_terms", "lgpl21_either")),
    Rule("GPL-3.0-or-later", ("gpl_free", "gpl3_terms")),
    Rule("GPL-2.0-or-later", ("gpl_free_2", "gpl2_terms", "gpl2_either")),
    Rule("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    Rule("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    Rule("Unlicense", ("unlicense_free", "unlicense_anyone")),
    Rule("Unlicense", ("unlicense_free",)),
    Rule("ISC", ("isc_grant",)),
    Rule("MPL-2.0", ("mpl2_form",)),
    Rule("EPL-2.0", ("epl2_terms",)),
    Rule("Zlib", ("zlib_grant",)),
    Rule("WTFPL", ("wtfpl_terms",)),
    *(Rule(k, ("spdx", f"id_{k}")) for k in (*NAMES, *EXCEPTIONS)),
    *(Rule(k, (f"line_{k}",)) for k in NAMES),
    Rule("public-domain", ("public_domain",)),
)

#: Marks at the head of a line, ends of paragraphs, ends of sentences; what is not of a word.  Both engines read them alike.
_HEAD, _GAP, _BREAK, _OTHER = "\n[^a-zA-Z0-9\n]+", "\n\n+", r"([.!?;:])[ \t\r]+", "[^a-z0-9]+"
_CUT = "\x1e"


def normalised(sentence: Column) -> Column:
    """Lower case, with every run of other than letters and digits as one blank, and a notice's head as "under"."""
    words = F.trim(F.regexp_replace(F.lower(sentence), _OTHER, " "))
    words = F.when(words.contains(" under "), F.regexp_replace(words, FORM, "under ")).otherwise(words)
    return F.when(words.endswith(" licensed"), F.regexp_replace(words, LICENSED, "under $1 license")).otherwise(words)


def apart(words: Column) -> Column:
    """A notice of several licences as one of each; any other sentence by itself."""
    several = words.startswith("under ") & words.rlike(JOINED)
    return F.when(several, F.split(F.regexp_replace(words, JOINED, f"{_CUT}under "), _CUT)).otherwise(F.array(words))


def expanded(text: Column) -> Column:
    """The text with the expressions of marked lines written as a marked line for each of their terms."""
    out = text
    for _ in range(OPERATORS):
        out = F.regexp_replace(out, OPERATOR, f"$1\n\n{SPDX} ")
    return F.when(F.contains(text, F.lit(SPDX)), F.regexp_replace(out, LATER, "$1-or-later")).otherwise(text)


def bare(text: Column) -> Column:
    """The text with a line end before it, and no marks at the head of its lines."""
    return F.regexp_replace(F.concat(F.lit("\n"), text), _HEAD, "\n")


def sentences(lines: Column, joined: bool) -> Column:
    """The sentences of a bare text: cut at empty lines (joined) or at every line end, and at blanks after a mark."""
    if joined:
        lines = F.replace(F.regexp_replace(lines, _GAP, _CUT), F.lit("\n"), F.lit(" "))
    else:
        lines = F.replace(lines, F.lit("\n"), F.lit(_CUT))
    cut = F.transform(F.split(F.regexp_replace(lines, _BREAK, f"$1{_CUT}"), _CUT), normalised)
    return F.flatten(F.transform(F.filter(cut, lambda s: F.length(s) > 0), apart))


def _plain(sentence: str) -> list[str]:
    words = re.sub(LICENSED, r"under \1 license", re.sub(FORM, "under ", re.sub(_OTHER, " ", sentence.lower()).strip()))
    return re.sub(JOINED, f"{_CUT}under ", words).split(_CUT) if words.startswith("under ") else [words]


class Catalogue(NamedTuple):
    names: dict[str, str]  # by normalised sentence
    patterns: list[tuple[str, str]]  # licence and the identifiers of its rule, wrapped in commas


def catalogue(known: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> Catalogue:
    """The known sentences, cut as texts are: one that falls into several parts has an identifier for each."""
    names, parts = {}, {}
    for name, variants in (known or _notices()).items():
        for variant in variants:
            cut = [p for x in re.sub(_BREAK, rf"\1{_CUT}", re.sub(_GAP, _CUT, variant).replace("\n", " ")).split(_CUT) for p in _plain(x) if p]
            ids = [f"{name}.{i + 1}" if len(cut) > 1 else name for i in range(len(cut))]
            if parts.setdefault(name, ids) != ids:
                raise ValueError(f"the variants of {name} fall into unlike parts")
            for part, i in zip(cut, ids, strict=True):
                if names.setdefault(part, i) != i:  # the same part of another sentence
                    parts[name] = [names[part] if x == i else x for x in parts[name]]
    return Catalogue(names, [(r.licence, "".join(f",{i}," for s in r.sentences for i in parts[s])) for r in rules])


def scan(docs: DataFrame, known: Catalogue | None = None) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids (known sentences in order) and licences (in order of the rules).

    Both lists are comma-joined strings: first the sentences of the joined lines, then those that only single lines
    give.  Expressions of marked lines (up to nine terms) count term by term, exceptions too; a notice of several licences
    counts for each.  Unknown sentences between known ones do not break a sequence.  A null or empty text has no sentence.  Nothing
    is shuffled; the known sentences and rules are constants of the plan.
    """
    names, patterns = known or catalogue()
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kept = docs.select("doc_id", bare(expanded(text_or_empty())).alias("bare"))
    kept = kept.select("doc_id", sentences(F.col("bare"), True).alias("joined"), sentences(F.col("bare"), False).alias("single"))

    def ids(some: str) -> Column:
        return F.transform(F.filter(some, lambda s: s.isin(*names)), lambda s: table[s])

    kept = kept.select("doc_id", F.size("joined").cast("long").alias("n_sentences"), ids("joined").alias("ids"), ids("single").alias("more"))
    kept = kept.select("doc_id", "n_sentences", F.concat("ids", F.filter("more", lambda x: ~F.array_contains("ids", x))).alias("ids"))
    listed = F.array(*[F.struct(F.lit(x).alias("licence"), F.lit(p).alias("pattern")) for x, p in patterns])
    start = F.struct(F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(",")))).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["left"], rule["pattern"], F.concat(F.lit(";"), rule["licence"], F.lit(";")))
        return F.when(F.contains(state["left"], rule["pattern"]), F.struct(left.alias("left"), F.array_append(state["found"], rule["licence"]).alias("found"))).otherwise(state)

    found = F.when(F.size("ids") > 0, F.aggregate(listed, start, step, lambda s: F.array_distinct(s["found"]))).otherwise(F.array().cast("array<string>"))
    return kept.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licences"))


def scan_sql(known: Catalogue | None = None) -> str:
    """The same in DuckDB's SQL."""
    names, patterns = known or catalogue()
    values = ", ".join(f"('{i}', '{s}')" for s, i in names.items())
    cut, end = f"chr({ord(_CUT)})", "chr(10)"
    text = "coalesce(text, '')"
    for _ in range(OPERATORS):
        text = f"regexp_replace({text}, '{OPERATOR}', '\\1' || {end} || {end} || '{SPDX} ', 'g')"
    text = f"regexp_replace({text}, '{LATER}', '\\1-or-later', 'g')"
    bare_ = f"regexp_replace({end} || {text}, {end} || '[^a-zA-Z0-9' || {end} || ']+', {end}, 'g')"

    def split(lines: str) -> str:
        cut_ = f"list_filter(list_transform(string_split(regexp_replace({lines}, '([.!?;:])[ ' || chr(9) || chr(13) || ']+', '\\1' || {cut}, 'g'), {cut}), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(lower(x), '{_OTHER}', ' ', 'g')), '{FORM}', 'under '), '{LICENSED}', 'under \\1 license')), lambda x: length(x) > 0)"
        return f"flatten(list_transform({cut_}, lambda x: CASE WHEN starts_with(x, 'under ') THEN string_split(regexp_replace(x, '{JOINED}', {cut} || 'under ', 'g'), {cut}) ELSE [x] END))"

    joined = split(f"replace(regexp_replace(bare, {end} || {end} || '+', {cut}, 'g'), {end}, ' ')")
    single = split(f"replace(bare, {end}, {cut})")
    steps, left = [], "left_0"
    for k, (licence, pattern) in enumerate(patterns):
        steps.append(f"step_{k + 1} AS (SELECT r, CASE WHEN contains({left}, '{pattern}') THEN list_append(found_{k}, '{licence}') ELSE found_{k} END AS found_{k + 1}, replace({left}, '{pattern}', ';{licence};') AS left_{k + 1} FROM step_{k})")
        left = f"left_{k + 1}"
    last = len(patterns)
    return f"""
WITH known(name, plain) AS (VALUES {values}),
rows AS (SELECT row_number() OVER () AS r, doc_id, {bare_} AS bare FROM documents),
cuts AS (SELECT r, doc_id, {joined} AS joined, {single} AS single FROM rows),
each AS (SELECT r, 0 AS way, unnest(joined) AS one, generate_subscripts(joined, 1) AS i FROM cuts UNION ALL SELECT r, 1, unnest(single), generate_subscripts(single, 1) FROM cuts),
named AS (SELECT e.r, e.way, e.i, k.name FROM each e JOIN known k ON e.one = k.plain),
ids AS (SELECT * FROM named WHERE way = 0 UNION ALL SELECT n.* FROM named n WHERE n.way = 1 AND NOT EXISTS (SELECT 1 FROM named m WHERE m.way = 0 AND m.r = n.r AND m.name = n.name)),
hits AS (SELECT r, string_agg(name, ',' ORDER BY way, i) AS ids, string_agg(',' || name || ',', '' ORDER BY way, i) AS left_0 FROM ids GROUP BY r),
step_0 AS (SELECT r, left_0, []::VARCHAR[] AS found_0 FROM hits),
{', '.join(steps)},
found AS (SELECT r, string_agg(x, ',' ORDER BY i) AS licences FROM (SELECT r, x, min(i) AS i FROM (SELECT r, unnest(found_{last}) AS x, generate_subscripts(found_{last}, 1) AS i FROM step_{last}) GROUP BY r, x) GROUP BY r)
SELECT c.doc_id, len(c.joined) AS n_sentences, coalesce(h.ids, '') AS sentence_ids, coalesce(f.licences, '') AS licences FROM cuts c LEFT JOIN hits h ON c.r = h.r LEFT JOIN found f ON c.r = f.r"""
