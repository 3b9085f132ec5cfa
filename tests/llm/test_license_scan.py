import textwrap

from seriesframe.llm import license_scan as L

DOCS = "doc_id long, text string, license int"


def test_notices(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "released under the mit licence": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 4.": None, "This driving license expires in May.": None,
        "// This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0"}
    filler = "some words of prose that fill the line. " * 20
    rows = []
    for i, t in enumerate(lines):
        rows += [(i, t), (i, f"first line\n{t}\nlast line"), (i, filler + t + " " + filler)]
    rows += [(None, None), (99, ""), (99, "no such thing"), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], DOCS).repartition(3)
    got = L.scan(docs).collect()
    assert len(got) == 3 * len(lines) + 1
    want = list(lines.values())
    for r in got:
        assert r.license == (want[r.doc_id] if r.doc_id is not None else "MIT"), r
    text = {i: t for i, t in enumerate(lines)}
    assert any(rows[3 * r.doc_id][1][r.start:r.end] == text[r.doc_id] for r in got if r.doc_id == 3 and r.start == 0)
    assert L.scan(docs.limit(0)).count() == 0


def test_ranking_prefers_the_right_template():
    s = L.Scanner()
    for name, (notices, _) in L.TEMPLATES.items():
        for n in notices:
            ranked = [r[1] for r in s.rank(n)]
            assert name in ranked[:L.CONFIRM] and s.judge(n)[0] == name


def test_blocks_join_lines_and_cut_sentences():
    text = "a\nCopyright X\nLicensed to all\nb\n" + "word " * 100 + ". The license. " + "word " * 50
    assert [text[a:b] for a, b in L.blocks(text)] == ["Copyright X\nLicensed to all", "The license."]


def test_notices_hard_wrapped_and_commented():
    s = L.Scanner()
    for name, (notices, _) in L.TEMPLATES.items():
        for n in notices:
            for width in (24, 72, 80):
                for mark in ("", "# ", "// ", " * "):
                    body = "\n".join(mark + x for x in textwrap.wrap(n, width))
                    text = f"{mark}some file of ours\n{mark.rstrip()}\n{body}\n{mark}and what stands after it\n"
                    got = [r for r in s.rows(text) if r[2]]
                    assert [r[2] for r in got] == [name], (text, got)
                    assert L.WORDS(n) == [w for line in text[got[0][0]:got[0][1]].split("\n") for w in L.WORDS(line)]


def test_every_license_of_a_text(spark):
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = {
        f"{mit}\n{apache}": ["MIT", "Apache-2.0"], f"Either: {mit} Or: {apache}": ["MIT", "Apache-2.0"], f"{apache}\n\n{mit} {mit}": ["Apache-2.0", "MIT", "MIT"],
        "// SPDX-License-Identifier: MIT": ["MIT"], "/* SPDX-License-Identifier: Apache-2.0 */": ["Apache-2.0"],
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0\nx = 1": ["MIT", "Apache-2.0", "GPL-2.0"],
        "SPDX-License-Identifier: MIT-0": [None], "Licensed under CC BY-NC-SA 4.0.": [None],
        "\n".join(n for notices, _ in L.TEMPLATES.values() for n in notices): [name for name, (notices, _) in L.TEMPLATES.items() for _ in notices]}
    texts |= {f"SPDX-License-Identifier: {name}": [name] for name in L.TEMPLATES}
    got = L.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)).collect()
    for i, (text, want) in enumerate(texts.items()):
        rows = sorted((r.start, r.end, r.license) for r in got if r.doc_id == i)
        assert [r[2] for r in rows] == want, (text, rows)
        assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
