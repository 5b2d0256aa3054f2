import re
import textwrap

from rheospark.llm import licenses as lic

LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
}


def test_finds_planted_lines_only(spark, sf, texts):
    for r in lic.op7_license_scan(spark, sf).collect():
        want = {v for k, v in LINES.items() if k in texts[r.doc_id].split("\n")}
        assert set(r.families.split(",")) - {""} == want and (r.family in want or r.family == "none" and not want)


def test_edges(spark, weird, empty):
    docs = weird.unionByName(spark.createDataFrame([(9, "Some words.\nreleased under the MIT license"), (10, "a driver's license and general rights")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in lic.scan(docs.selectExpr("*", "1 AS line", "2 AS P")).collect()}
    assert rows[9].family == "mit" and rows[10].family == "none" and rows[1].n_paragraphs == 0 and rows[4].n_paragraphs == 0
    assert None in rows
    assert lic.scan(empty).collect() == []


def test_windows_without_an_anchor_confirm_nothing():
    hit = re.compile(r"\b(?:" + "|".join(lic.ANCHORS) + ")")
    for texts in lic.TEMPLATES.values():
        for text in texts:
            words = re.findall(r"[^\W_]+(?:[.+'-][^\W_]+)*", text.lower())
            pairs = set(zip(words, words[1:]))
            assert sum(bool(hit.search(" ".join(p))) for p in pairs) > (1 - lic.CONFIRMED) * len(pairs), text


def test_wrapped_notices_among_other_lines(spark):
    prose = "The mill stands by the river and grinds corn for the village all year round."
    wrapped = lambda family, i: "\n".join(textwrap.wrap(lic.TEMPLATES[family][i], 72))
    docs = [
        (1, f"{prose}\n{prose}\n\n{wrapped('gpl', 1)}\n\n{wrapped('gpl', 2)}\n\n{prose}"), (2, f"{prose}\n{wrapped('mit', 2)}\n{prose}"), (3, f"{wrapped('bsd', 1)}\n\n{wrapped('bsd', 2)}\n{prose}"),
        (4, "\n".join([prose] * 20 + [wrapped("apache", 1)] + [prose] * 20)), (5, wrapped("isc", 0)), (6, wrapped("lgpl", 1)), (7, wrapped("agpl", 1)), (8, prose + " The software permits every reader to buy a licence."),
        (9, "Distributed under the Frobnicate Public Covenant, which permits nothing at all."),
    ]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r.families for i, r in rows.items()} == {1: "gpl", 2: "mit", 3: "bsd", 4: "apache", 5: "isc", 6: "lgpl", 7: "agpl", 8: "", 9: ""}
    assert rows[1].n_licences == 2 and rows[1].probability >= lic.LEAST


def test_windows_hold_every_template_whole():
    assert max(len(t.split()) for ts in lic.TEMPLATES.values() for t in ts) <= lic.WINDOW // 2


def brute(text):
    """Families of which a window of words has enough word pairs of a template, whatever a classifier says."""
    found = set()
    for block in re.split(r"\n[ \t]*\n", text or ""):
        words = re.findall(r"[^ \t-\r]+", block)
        for at in range(0, max(1, len(words)), 20):
            part = " ".join(words[at : at + lic.WINDOW // 2])
            own = re.findall(r"[^\W_]+(?:[.+'-][^\W_]+)*", part.lower())
            pairs = set(zip(own, own[1:]))
            for family, templates in lic.TEMPLATES.items():
                for t in templates:
                    w = re.findall(r"[^\W_]+(?:[.+'-][^\W_]+)*", t.lower())
                    need = set(zip(w, w[1:]))
                    alone = t not in lic.SENTENCES or re.search(t.rstrip(".") + r"\s*(?:[.!;)*]|\n|$)", block, re.I)
                    if alone and len(need & pairs) >= lic.CONFIRMED * len(need):
                        found.add(family)
    return found


def test_long_lines_short_templates_and_unknown_licences(spark):
    prose = "The mill stands by the river and grinds corn for the village all year round. "
    docs = [
        (1, prose * 340 + "Licensed under the Apache License, Version 2.0. " + prose * 340), (2, prose * 700 + lic.TEMPLATES["mit"][2]), (3, prose + "with all rights reserved to the reader and his heirs forever"),
        (4, prose + "\nCopyright 2020 The Mill. All rights reserved.\n" + prose), (5, prose + "All rights reserved"),
        (6, "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software."),
        (7, prose * 9), (8, None), (9, prose + "\n" + lic.TEMPLATES["epl"][0] + "\n\n" + prose * 30 + lic.TEMPLATES["mpl"][0] + " " + prose * 30),
    ]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert set(rows[i].families.split(",")) - {""} == brute(text), i
    assert {i: r.family for i, r in rows.items() if i in (1, 2, 3, 4, 5, 6, 7, 8)} == {1: "apache", 2: "mit", 3: "none", 4: "proprietary", 5: "proprietary", 6: "unknown", 7: "none", 8: "none"}
    assert rows[6].n_unknown == 1 and rows[1].n_unknown == 0


def test_whole_table_as_brute_force(spark, sf, texts):
    for r in lic.op7_license_scan(spark, sf).collect():
        assert set(r.families.split(",")) - {""} == brute(texts[r.doc_id]), r.doc_id
        assert r.family != "unknown"
