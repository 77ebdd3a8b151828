"""Licences by known sentences and ordered rules.

A text is cut into sentences at line ends, and after stops unless a number follows; a sentence is normalised to lower-case words and numbers. A known
sentence may go over single line ends, with comment leaders, but not over a blank line. Known sentences
have identifiers (all lines of copyright share one). A rule is a sequence of identifiers; it fits where the known sentences of a
text hold that sequence without another known sentence between. A rule that contains another one replaces it.

A known sentence may have slots for names (``{}``): one at its start or end lies within a line, one inside may go over line ends and over
the stop of an abbreviation. An item of a list that is no known sentence has the identifier ``list-item`` where it directly follows one of ``GUARDED``,
so that a rule can tell a longer list from a whole one. Items marked by numbers, letters, ``-`` or a bullet count; ``*`` is taken for a comment leader.
Tags joined by ``or`` and ``and`` are a sentence each.

Every known sentence has one of the ``triggers`` of its table, so texts without any need no cutting; that leaves out no sentence. All happens
within the row: no shuffle, no group. Null and empty texts, and texts without known sentences, have no licence. An empty table
gives an empty result; texts of any length are read whole. Repeated rows stay repeated; ties between rules of one name leave one licence; other columns pass through, except those named like the output's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, as they are written (fixed values of public licences and usual notices).
SENTENCES = {
    "apache-2-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2-use": "you may not use this file except in compliance with the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Released under the CC0 1.0 Universal Public Domain Dedication License.",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "all-rights": "All rights reserved under copyright.",
}
COPYRIGHT = "copyright"

#: Licence and the sequence of sentences that shows it.
RULES = [
    ("Apache-2.0", ["apache-2-short"]), ("Apache-2.0", ["apache-2-notice"]), ("Apache-2.0", ["apache-2-notice", "apache-2-use"]), ("Apache-2.0", ["spdx-apache-2"]),
    ("MIT", ["mit-short"]), ("MIT", ["mit-licensed"]), ("MIT", ["spdx-mit"]),
    ("GPL-3.0", ["gpl-3-short"]), ("GPL-3.0", ["gpl-3-short", "gpl-hope"]), ("GPL-3.0", ["spdx-gpl-3"]),
    ("GPL-2.0", ["gpl-2-short"]), ("GPL-2.0", ["gpl-2-short", "gpl-hope"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]), ("CC-BY-4.0", ["cc-by-4"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]), ("CC0-1.0", ["cc0"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-name"]), ("BSD-3-Clause", ["spdx-bsd-3"]),
    ("MPL-2.0", ["mpl-2"]), ("proprietary", ["copyright", "all-rights"]),
]

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_FREE = [
    (f"{name}-{what}", f"This {what} is free software; " + _GNU.format(full, version))
    for name, full, version in [
        ("gpl-2-later", "General Public License", "2"), ("gpl-3-later", "General Public License", "3"), ("lgpl-2-later", "Library General Public License", "2"),
        ("lgpl-2-1-later", "Lesser General Public License", "2.1"), ("lgpl-3-later", "Lesser General Public License", "3"), ("agpl-3-later", "Affero General Public License", "3"),
    ]
    for what in ("program", "library", "software")
]
_NAMES = {"gpl-2-later": "GPL-2.0", "gpl-3-later": "GPL-3.0", "lgpl-2-later": "LGPL-2.0", "lgpl-2-1-later": "LGPL-2.1", "lgpl-3-later": "LGPL-3.0", "agpl-3-later": "AGPL-3.0"}
_TAGS = {
    "Apache-2.0": [], "MIT": [], "ISC": ["ISC"], "0BSD": ["0BSD"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-or-later", "GPL-3.0+"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD-2-Clause": ["BSD-2-Clause"], "MPL-2.0": ["MPL-2.0"], "EPL-1.0": ["EPL-1.0"], "EPL-2.0": ["EPL-2.0"],
    "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
}
#: Licence and sentence of the bodies, headers and titles of usual licences, each a rule by itself.
_USUAL = {
    "mit-grant": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    "isc-grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "isc-grant-and": ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "apache-2-title": ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    "gpl-2-title": ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    "gpl-3-title": ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    "lgpl-2-1-title": ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    "lgpl-3-title": ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "agpl-3-title": ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    "mpl-2-title": ("MPL-2.0", "Mozilla Public License Version 2.0"),
    "epl-2-title": ("EPL-2.0", "Eclipse Public License - v 2.0"),
    "epl-2-made": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "epl-2-made-v": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    "epl-1-made": ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    **{key: (_NAMES[key.rsplit("-", 1)[0]], sentence) for key, sentence in _FREE},
    **{f"spdx-tag-{tag.lower()}": (name, f"SPDX-License-Identifier: {tag}") for name, tags in _TAGS.items() for tag in tags},
}
#: Sentences that only mean something together with others.
_CLAUSES = {
    "bsd-name-of": "Neither the name of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-not": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-not": "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-thanks": "This product includes software developed by {}",
    "bsd-disclaimer": 'This software is provided by {} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
}
_USUAL |= {
    "zlib-grant": ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "boost-grant": ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    "boost-title": ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "boost-short": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    "mit-title": ("MIT", "MIT License"), "mit-title-the": ("MIT", "The MIT License"), "mit-title-twice": ("MIT", "The MIT License (MIT)"),
    "bsd-2-title": ("BSD-2-Clause", "BSD 2-Clause License"), "bsd-3-title": ("BSD-3-Clause", "BSD 3-Clause License"),
    "gpl-2-only": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    "gpl-2-only-version": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation."),
    "gpl-2-only-as": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    **{f"{key.removesuffix('-program')}-named": (_NAMES[key.removesuffix("-program")], sentence.replace("This program", "{}")) for key, sentence in _FREE if key.endswith("-program")},
    **{
        f"{verb}-{place}-{name.lower()}": (name, f"{{}} is {verb} under the {phrase}")
        for name, phrases in {
            "MIT": ["MIT License", "terms of the MIT License"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
            "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
            "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2"], "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3"],
            "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
        }.items()
        for place, phrase in enumerate(phrases)
        for verb in ("licensed", "released", "distributed")
    },
    **{f"spdx-tag-{tag.lower()}": (tag, f"SPDX-License-Identifier: {tag}") for tag in ("Zlib", "BSL-1.0")},
}
ITEM = "list-item"
#: Last sentences of lists that other licences go on with.
GUARDED = ["bsd-binary"]
_BSD = ["bsd-head", "bsd-source", "bsd-binary"]
_CLAUSE_RULES = [
    *(("BSD-3-Clause", [*_BSD, name]) for name in ("bsd-name-of", "bsd-name-not", "bsd-names-not")),
    ("BSD-4-Clause", [*_BSD, "bsd-advert"]), ("BSD-other", [*_BSD, ITEM]),
]
TRIGGERS = ["licen", "copyright", "redistribut", "warranty"]


def normal_sentence(sentence: str) -> str:
    """As ``normal`` below, for the known sentences; they are plain ASCII."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def usual_sentences() -> dict[str, str]:
    """``SENTENCES`` and those of the usual licences; one identifier for each normal form."""
    have = {normal_sentence(x) for x in SENTENCES.values()}
    more: dict[str, str] = {}
    for key, sentence in [*((key, sentence) for key, (_, sentence) in _USUAL.items()), *_CLAUSES.items()]:
        if (norm := str(parts_of(sentence))) not in have and normal_sentence(sentence) not in have:
            have.add(norm if "{}" in sentence else normal_sentence(sentence))
            more[key] = sentence
    return SENTENCES | more


def usual_rules() -> list[tuple[str, list[str]]]:
    single = [(_USUAL[key][0], [key]) for key in usual_sentences() if key in _USUAL and key not in SENTENCES]
    return [*RULES, *_CLAUSE_RULES, *single]


def parts_of(sentence: str) -> list[str]:
    """Normal forms around the slots of a sentence."""
    return [normal_sentence(part) for part in sentence.split("{}")]


def triggers(sentences: dict[str, str]) -> list[str]:
    """Words of which every sentence of the table, and every line of copyright, has one."""
    out = list(TRIGGERS)
    for sentence in (" ".join(parts_of(s)) for s in sentences.values()):
        if sentence.strip() and not any(t in word for t in out for word in sentence.split()):
            out.append(max(sentence.split(), key=len))
    return out


_SPACE = r" \t\n\x0b\f\r"
_STOP = f"([.;!?])[{_SPACE}]+([^0-9{_SPACE}])"
#: Steps from a lower-case text to words with one space between, where line ends stay as such, other cuts become \x01 and list items begin with
#: \x02. Patterns and replacements; none looks ahead or back, so other engines read them too.
STEPS = [
    (r"(?dm)^[ \t]*(?:<!--|//+|/\*+|\*+/?|#+|;+|--+|%+|>+|!+|(?:dnl|rem)[ \t])", " "),
    (r"(?dm)^[ \t]*\(?(?:[0-9]{1,2}|[a-z])\)[ \t]+", "\x01\x02\x01"),
    # numbers with a stop, and bullets, only after a line that ends a sentence or is blank
    (r"([.;:,!?][ \t]*\n(?:[ \t]*\n)*|\n[ \t]*\n)[ \t]*(?:[0-9]{1,2}\.|[-•·])[ \t]+", "$1\x01\x02\x01"),
    (_STOP, "$1\x01$2"), (_STOP, "$1\x01$2"), (r"\n(?:[^a-z0-9\n]*\n)+", "\x01"), (r"[^a-z0-9\n\x01\x02]+", " "), (r" ?([\n\x01\x02]) ?", "$1"),
]
_TAG = "spdx license identifier "


def tag_chain(table: dict[str, str]) -> str:
    """Pattern of a tag of the table that another one goes before; it matches none if there are no tags."""
    tags = sorted({n.removeprefix(_TAG) for n in map(normal_sentence, table.values()) if n.startswith(_TAG)}, key=lambda t: (-len(t), t))
    return f" (?:or|and) ({'|'.join(tags)})" if tags else " (?:or|and) ($^)"


def _pattern(sentence: str, line: str = r"\n", cut: str = r"\x01") -> str:
    """Pattern of a sentence in a text made by ``STEPS``; ``line`` and ``cut`` are a line end and another cut there."""
    between = f"(?: |{line}|{cut})" if re.search(f"[.;!?][{_SPACE}]+[^0-9{_SPACE}]", sentence) else f"(?: |{line})"
    first, *rest = [between.join(part.split()) for part in parts_of(sentence)]
    # char classes and not groups carry the length of a slot, so no matter how long a text is, matching needs no deep stack
    slot = rf"[a-z0-9 \n]+?(?:\b(?:inc|co|corp|ltd|llc|[a-z]){cut}[a-z0-9 \n]*?){{0,2}}?\b"
    out = first
    for k, part in enumerate(rest):
        out += (between if out else "") + (slot if part and out else "[a-z0-9][a-z0-9 ]*?" + (" " if part else "")) + part
    return out


def known_pattern(table: dict[str, str], line: str = r"\n", cut: str = r"\x01") -> str:
    """All sentences of a table, and lines of copyright: whole ones before those with slots, long ones before short ones."""
    written = sorted((x for x in table.values() if any(parts_of(x))), key=lambda x: len("".join(parts_of(x))), reverse=True)
    whole = [_pattern(x, line, cut) for x in written if "{}" not in x]
    inner = [_pattern(x, line, cut) for x in written if "{}" in x and not x.startswith("{}")]
    lead = [_pattern(x[2:], line, cut) for x in written if x.startswith("{}")]
    chain = tag_chain(table)
    tags = f"{_TAG}{chain.removeprefix(' (?:or|and) ')}(?:{chain})+"
    return "|".join([tags, *whole, "copyright [0-9c][a-z0-9 ]*", *inner, *(["[a-z0-9][a-z0-9 ]*? (?:" + "|".join(lead) + ")"] if lead else [])])


def slot_patterns(table: dict[str, str]) -> list[tuple[str, str]]:
    """Identifier and pattern (words with one space between) of each sentence with slots, long ones first."""
    slotted = sorted(((name, parts_of(x)) for name, x in table.items() if "{}" in x), key=lambda x: len("".join(x[1])), reverse=True)
    return [(name, "^" + " .+ ".join(parts).strip() + "$") for name, parts in slotted]


def known_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = usual_sentences() if sentences is None else sentences
    norms = {norm: name for name, s in table.items() if "{}" not in s and (norm := normal_sentence(s))}
    lookup = F.create_map(*[F.lit(x) for pair in norms.items() for x in pair]) if norms else F.create_map(F.lit(""), F.lit(""))
    low = F.lower(text)
    marked = F.translate(low, "\x01\x02", "  ")
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    pattern = rf"(?:^|(?<=[\n\x01])|\x02\x01)(?:{known_pattern(table)})(?=[\n\x01]|\z)|\x02"

    def name(s: Column) -> Column:
        found = F.when(s == "", F.lit(ITEM)).when(s.rlike("^copyright [0-9c]"), F.lit(COPYRIGHT)).when(F.try_element_at(lookup, s).isNotNull(), F.try_element_at(lookup, s))
        for one, shape in slot_patterns(table):
            found = found.when(s.rlike(shape), F.lit(one))
        return found

    def words(s: Column) -> Column:
        clean = F.trim(F.translate(s, "\n\x01\x02", "   "))
        return F.split(F.when(F.startswith(clean, F.lit(_TAG)), F.regexp_replace(clean, tag_chain(table), f"\x01{_TAG}$1")).otherwise(clean), "\x01")

    found = F.transform(F.flatten(F.transform(F.regexp_extract_all(F.trim(marked), F.lit(pattern), F.lit(0)), words)), name)
    line = F.concat(F.lit("|"), F.array_join(F.filter(found, lambda x: x.isNotNull()), "|"))
    for guard in GUARDED:
        line = F.replace(line, F.lit(f"|{guard}|{ITEM}"), F.lit(f"|{guard}|+"))
    line = F.replace(F.replace(line, F.lit(f"|{ITEM}"), F.lit("")), F.lit("|+"), F.lit(f"|{ITEM}"))
    ids = F.filter(F.split(line, r"\|"), lambda x: x != "")
    return F.when(low.rlike("|".join(triggers(table))), ids).otherwise(F.array().cast("array<string>"))


def recognise(df: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """``df`` with ``sentence_ids`` (known sentences in order) and ``licences`` (sorted, without repeats)."""
    kept = [c for c in df.columns if c == text_col or c.lower() not in ("sentence_ids", "licences")]
    listed = [(name, "|" + "|".join(ids) + "|") for name, ids in (usual_rules() if rules is None else rules)]
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("ids")) for n, s in listed])
    ids = df.select(*[F.col(f"`{c}`") for c in kept], known_ids(F.coalesce(F.col(text_col), F.lit("")), sentences).alias("sentence_ids"))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    fit = F.filter(table, lambda r: F.contains(line, r["ids"]))
    widest = F.filter(fit, lambda r: ~F.exists(fit, lambda o: (o["ids"] != r["ids"]) & F.contains(o["ids"], r["ids"])))
    names = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.transform(widest, lambda r: r["name"])))).otherwise(F.array().cast("array<string>"))
    return ids.select(*[F.col(f"`{c}`") for c in kept], "sentence_ids", names.alias("licences"))
