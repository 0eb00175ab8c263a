"""Licence rules: order, gaps, longest match, wrapped sentences, odd rows."""

from admitlens.llm import licenses

S = licenses.SENTENCES


def test_rules_and_odd_rows(spark):
    mit = "\n".join([S["mit-grant"].replace(", to deal", ",\nto deal"), S["mit-keep"], S["mit-warranty"]])
    bsd = " ".join([S["bsd-grant"], S["bsd-source"], S["bsd-binary"]])
    rows = {
        1: (mit, ["MIT"], 1), 2: (f"MIT License\n\n{mit}", ["MIT"], 1), 3: (bsd, ["BSD-2-Clause"], 1), 4: (f"{bsd} {S['bsd-names']}", ["BSD-3-Clause"], 1),
        5: ("\n".join([S["mit-keep"], S["mit-grant"], S["mit-warranty"]]), [], 0),  # out of order
        6: ("no full stop\nreleased under THE mit   license", ["MIT"], 1), 7: (f"a. {S['gpl3-notice']} b? {S['mit-notice']}\n{S['gpl3-notice']}", ["GPL-3.0", "MIT"], 3),
        8: (f"{S['apache-header']} one. two. three. {S['apache-comply']}", [], 0), 9: (f"{S['apache-header']} one. two. {S['apache-comply']}", ["Apache-2.0"], 1),
        10: (None, [], 0), 11: ("", [], 0), 12: ("Unreleased under the MIT License.", [], 0), 13: ("word " * 50000 + "\n" + S["cc-by-nc-notice"], ["CC-BY-NC-4.0"], 1),
        14: ("// SPDX-License-Identifier: GPL-2.0-only\nint main;", ["GPL-2.0-only"], 1), 15: ("SPDX-License-Identifier: MIT", ["MIT"], 1), 16: ("MIT", [], 0),
        17: (f"{S['gpl-free']} {S['gpl-terms']} {S['v2-later']}", ["GPL-2.0-or-later"], 1), 18: (f"{S['lgpl-free']} {S['lgpl-terms']} {S['v21-later']}", ["LGPL-2.1-or-later"], 1),
        19: (f"{S['gpl-free']} {S['agpl3-terms']}", ["AGPL-3.0-or-later"], 1), 20: (f"{S['mpl-form']} 2.0. {S['mpl-copy']}", ["MPL-2.0"], 1), 21: (S["unlicense"] + "\n" + S["isc-grant"], ["Unlicense", "ISC"], 2),
        22: ("This project is licensed under the BSD 3-Clause License.", ["BSD-3-Clause"], 1), 23: ("Licensed under CC0 1.0 Universal.", ["CC0-1.0"], 1),
    }
    data = [(i, t, "q", 0) for i, (t, *_) in rows.items()] + [(7, rows[7][0], "q", 0), (None, S["mit-notice"], "q", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, license string, t int").repartition(3)
    got = licenses.licenses_of(docs, licenses.sentence_table(spark), licenses.rule_table(spark)).collect()
    assert len(got) == len(data)
    for r in got:
        want = (["MIT"], 1) if r.doc_id is None else rows[r.doc_id][1:]
        assert (r.licenses, r.n_matches) == want, r
    assert licenses.licenses_of(docs.limit(0), licenses.sentence_table(spark), licenses.rule_table(spark)).count() == 0


def test_a_sentence_has_one_identifier(spark):
    rows = licenses.sentence_table(spark).collect()
    assert len(rows) == len({r.sentence for r in rows}) == len(licenses.ALL_SENTENCES)
    used = {i for _, ids in licenses.ALL_RULES for i in ids}
    assert used - {r.known for r in rows} == set()
