"""Licence rules against a plain reading."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stampcard.llm import licences
from stampcard.llm.common import table
from tests.conftest import SF_SMALL


def plain(text):
    """Only sentences of one line without slots."""
    ids = []
    known = {licences.normal_sentence(s): name for name, s in licences.usual_sentences().items() if "{}" not in s}
    for s in re.split(r"\n+|(?<=[.;!?])\s+(?=[^0-9\s])", text or "", flags=re.A):
        norm = licences.normal_sentence(s)
        name = "copyright" if re.match("copyright [0-9c]", norm) else known.get(norm)
        ids += [name] if name else []
    fit = [(n, s) for n, s in licences.usual_rules() if any(ids[k : k + len(s)] == s for k in range(len(ids)))]
    inside = lambda a, b: a != b and any(b[k : k + len(a)] == a for k in range(len(b)))
    return ids, sorted({n for n, s in fit if not any(inside(s, o) for _, o in fit)})


def test_every_known_sentence_is_found_and_has_a_trigger(docs):
    rows = list(enumerate(licences.SENTENCES.values()))
    found = {r.doc_id: r.sentence_ids for r in licences.recognise(docs(rows)).collect()}
    assert found == {k: [name] for k, name in enumerate(licences.SENTENCES)}
    assert all(re.search("|".join(licences.TRIGGERS), s.lower()) for s in licences.SENTENCES.values())


def test_all_documents(spark):
    rows = licences.recognise(table(spark, SF_SMALL, "documents")).collect()
    assert all((r.sentence_ids, r.licences) == plain(r.text) for r in rows) and any(r.licences for r in rows)


def test_sequences(docs, odd_rows):
    s = licences.SENTENCES
    two = "\n".join([s["bsd-head"], "* " + s["bsd-source"], "* " + s["bsd-binary"]])
    texts = [
        two, two + "\n" + s["bsd-name"], s["bsd-source"] + "\n" + s["bsd-head"], s["mit-short"].upper() + " Some words. " + s["gpl-3-short"],
        "Copyright (c) 2020 Someone.\nAll rights reserved under copyright.", "MIT license", s["gpl-3-short"] + " " + s["gpl-hope"], s["mit-short"] * 3,
    ]
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(texts))]
    df = docs(rows).withColumn("licences", F.lit("x")).withColumn("sentence_ids", F.lit("x"))
    found = licences.recognise(df).collect()
    assert len(found) == len(rows) and all((r.sentence_ids, r.licences) == plain(r.text) for r in found)
    by = {r.doc_id: r.licences for r in found}
    assert [by[100 + k] for k in range(6)] == [["BSD-2-Clause"], ["BSD-3-Clause"], [], ["GPL-3.0", "MIT"], ["proprietary"], ["MIT"]]
    assert licences.recognise(docs([])).count() == 0


def test_wrapped_sentences_and_usual_licences(docs):
    import textwrap

    s = licences.usual_sentences()
    wrap = lambda *names, lead="": "\n".join(textwrap.fill(s[n], 60, initial_indent=lead, subsequent_indent=lead) for n in names)
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + wrap("bsd-head") + "\n\n1. " + wrap("bsd-source") + "\n\n2. " + wrap("bsd-binary")
    texts = [
        (bsd, ["BSD-2-Clause"]), (bsd + "\n\n3. " + wrap("bsd-name"), ["BSD-3-Clause"]), (wrap("mpl-2", lead=" * "), ["MPL-2.0"]), (wrap("mit-grant"), ["MIT"]),
        (wrap("mit-grant", lead="# "), ["MIT"]), (wrap("isc-grant", lead="// "), ["ISC"]), (wrap("gpl-2-later-program", lead=";; "), ["GPL-2.0"]),
        (wrap("gpl-3-later-program").replace("software;", "software:").replace("Foundation;", "Foundation,"), ["GPL-3.0"]), (wrap("lgpl-2-1-later-library"), ["LGPL-2.1"]), (wrap("agpl-3-later-program"), ["AGPL-3.0"]),
        (wrap("epl-2-made"), ["EPL-2.0"]), (wrap("unlicense"), ["Unlicense"]), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n", ["GPL-3.0"]),
        ("Licensed under CC\n\nBY-NC 4.0.", []), ("Licensed under the\n\nMIT License.", ["MIT"]),  # the second half is a title
    ]
    found = {r.doc_id: r.licences for r in licences.recognise(docs([(k, t) for k, (t, _) in enumerate(texts)])).collect()}
    assert found == {k: names for k, (_, names) in enumerate(texts)}
    rows = [(k, x.replace("{}", "Foo Bar")) for k, x in enumerate(s.values())]
    assert {r.doc_id: r.sentence_ids for r in licences.recognise(docs(rows)).collect()} == {k: [n] for k, n in enumerate(s)}


def test_own_sentences_need_no_trigger(docs):
    got = licences.recognise(docs([(1, "Take it, it is\nyours.")]), sentences={"own": "Take it, it is yours."}, rules=[("Own", ["own"])]).first()
    assert got.sentence_ids == ["own"] and got.licences == ["Own"]


def slotted_texts():
    s = licences.usual_sentences()
    bsd = f"{s['bsd-head']}\n\n1. {s['bsd-source']}\n2. {s['bsd-binary']}\n"
    end = "\n\n" + s["bsd-disclaimer"].format("THE AUTHOR AND CONTRIBUTORS") + "\n\n1. Build it.\n2. Run it.\n"
    wrapped = "3. Neither the name of Foo Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    named = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    return [
        (bsd + wrapped + end, ["BSD-3-Clause"]), (bsd + end, ["BSD-2-Clause"]), (bsd + "3. Nobody may tell.\n" + end, ["BSD-other"]),
        (bsd.replace("1.", "(a)").replace("2.", "(b)") + "(c) Nobody may tell." + end, ["BSD-other"]),
        (bsd + "3. " + s["bsd-advert"] + "\n" + s["bsd-thanks"].format("Foo") + "\n4. " + s["bsd-name-not"].format("Foo") + end, ["BSD-4-Clause"]),
        (bsd + "3. " + s["bsd-name-not"].format("the author"), ["BSD-3-Clause"]),
        ("MIT License\n\nCopyright (c) 2020 Foo", ["MIT"]), ("This project is licensed under the MIT License.", ["MIT"]), ("This project is not licensed under the MIT License.", []),
        (named.format("Foo"), ["GPL-3.0"]), (s["gpl-2-only"], ["GPL-2.0"]), ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND BSD-3-Clause", ["BSD-3-Clause", "GPL-2.0", "MIT"]), (s["zlib-as-is"] + "\n\n" + s["zlib-grant"], ["Zlib"]),
        ("SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC", "0BSD", "Zlib", "Unlicense", "GPL-2.0-or-later", "Apache-2.0"]), ["0BSD", "Apache-2.0", "GPL-2.0", "ISC", "MIT", "Unlicense", "Zlib"]),
        (s["boost-title"], ["BSL-1.0"]), ("This work is licensed under the GNU General Public License, version\n3. See it.", ["GPL-3.0"]),
        ("Neither the name of " + "word " * 30_000 + "license", []),
    ]


def test_slots_and_longer_lists(docs):
    texts = slotted_texts()
    found = {r.doc_id: r.licences for r in licences.recognise(docs([(k, t) for k, (t, _) in enumerate(texts)])).collect()}
    assert found == {k: names for k, (_, names) in enumerate(texts)}


def test_statement_over_every_sentence_and_rule(docs):
    """The SQL of the query on texts that show each sentence, each rule, and those above."""
    import textwrap

    import duckdb

    from stampcard.llm import queries

    s = {name: x.replace("{}", "Foo Inc.") for name, x in licences.usual_sentences().items()} | {"copyright": "Copyright (c) 2020 Foo", "list-item": "- Some more words."}
    texts = [*s.values(), *("\n\n".join(s[i] for i in ids) for _, ids in licences.usual_rules()), *(t for t, _ in slotted_texts())]
    texts += ["\n".join(textwrap.wrap(t, 50)) for t in texts] + ["\n".join("# " + line for line in textwrap.wrap(t, 40)) for t in texts[:80]] + [None, ""]
    rows = list(enumerate(texts))
    found = {r.doc_id: ("|".join(r.sentence_ids), ",".join(r.licences)) for r in licences.recognise(docs(rows)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    wanted = {k: (ids, names) for k, ids, names in con.execute(queries.SQL["op7_licence_scan"]).fetchall()}
    assert [(texts[k], found[k], wanted[k]) for k in wanted if found[k] != wanted[k]] == []
    assert len(found) == len(rows) and {n for _, names in found.values() for n in names.split(",")} >= {n for n, _ in licences.usual_rules()}
