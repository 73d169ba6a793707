import re

import numpy as np

from shelfloom.llm import license_scan as S
from shelfloom.llm.words import WordHashes
from tests.llm.helpers import documents, edited, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_winnowing_keeps_one_of_every_window():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    places = set(S.winnow(h, 4).tolist())
    assert all(places & set(range(i, i + 4)) for i in range(297)) and S.winnow(h[:2], 4).size == 1 and S.winnow(h[:0], 4).size == 0


def test_alignment_is_the_longest_common_subsequence():
    for seed in range(30):
        t = words(seed, 40, 30)
        b = edited(t, seed, 6)
        del b[seed % 10]
        n, first, last = S.align(t, [""] * 5 + b, 5)
        assert n <= lcs(t, b) and n >= lcs(t, b) - 1
        assert b[first - 5] in t and b[last - 5] in t


def test_finds_edited_licenses_and_their_spans(spark):
    mit = S.TEMPLATES["mit"]
    broken = " ".join(edited(mit.split(), 3, 12))
    rows = [(1, "Hello. Released under the MIT License. Bye"), (2, None), (3, ""), (4, " ".join(words(1, 500)) + " " + broken + " " + " ".join(words(2, 500))), (5, " ".join(mit.split()[:60])), (6, "LICENSED under the apache license version 2.0 İ"), (1, "Hello. Released under the MIT License. Bye"), (7, "nothing")]
    got = S.scan_licenses(documents(spark, rows)).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert found == {(1, "mit-notice"), (4, "mit"), (6, "apache-2.0-notice")}, found
    assert sum(r.doc_id == 1 for r in got) == 2
    one = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][one.start : one.end] == "Released under the MIT License" and one.coverage == 1.0
    four = next(r for r in got if r.doc_id == 4)
    assert four.coverage == lcs(S._WORD.findall(mit.lower()), S._WORD.findall(rows[3][1].lower())) / four.words
    assert S.scan_licenses(documents(spark, [])).count() == 0


def test_twice_in_one_text():
    index = S.Index(S.TEMPLATES)
    text = "Licensed under CC BY-NC 4.0. " + "x " * 30 + "Licensed under CC BY-NC 4.0."
    assert [f[0] for f in index.scan(text, WordHashes())] == ["cc-by-nc-4.0-notice"] * 2


def test_every_license_line_of_the_documents(spark):
    """Each kind of line that names a license is found in each document that has it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lower(text) rlike 'licen[sc]e'")
    found = {(r.doc_id, r.start, r.end) for r in S.scan_licenses(docs).collect()}
    named, lines = 0, set()
    for r in docs.select("doc_id", "text").collect():
        for m in re.finditer(r"(?im)^.*licen[sc]e.*$", r.text):
            named += 1
            lines.add(m.group())
            assert any(d == r.doc_id and m.start() <= a and b <= m.end() for d, a, b in found), m.group()
    assert named > 250 and "This work is licensed under the GNU General Public License, version 3." in lines


def test_whole_texts_of_common_licenses():
    index, hashes = S.Index(S.TEMPLATES), WordHashes()
    around = " ".join(words(3, 400))
    for name in ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0", "bsd-3-clause", "bsd-2-clause", "isc"):
        text = " ".join(edited(S.TEMPLATES[name].split(), 4, len(S.TEMPLATES[name].split()) // 25))
        assert name in {f[0] for f in index.scan(f"{around} {text} {around}", hashes)}, name


def test_parts_of_a_license_that_stand_alone():
    index, hashes = S.Index(S.TEMPLATES), WordHashes()
    bsd = S.TEMPLATES["bsd-3-clause"]
    at = bsd.index("THIS SOFTWARE IS")
    assert [[f[0] for f in index.scan(x, hashes)] for x in (bsd[at:], bsd[: bsd.index("Neither")])] == [["bsd-disclaimer"], ["bsd-conditions"]]


def test_spans_are_those_of_the_text_itself():
    """Lower case makes these words longer, or two of one; offsets and words don't move."""
    index, hashes = S.Index(S.TEMPLATES), WordHashes()
    for before in ("İstanbul " * 5, "ﬀ İ̇ ß ", "ΑΣ Ⱥ "):
        text = before + "Released under the MIT License. İİ"
        assert [text[f[3] : f[4]] for f in index.scan(text, hashes)] == ["Released under the MIT License"]


def test_short_notices_match_as_a_whole():
    index, hashes = S.Index(S.TEMPLATES), WordHashes()
    assert index.scan("it is licensed under the MIT license", hashes) == [] and len(index.scan("it is released under the MIT license", hashes)) == 1


def test_against_brute_force(spark):
    """Random documents around edited templates: found are those templates that some stretch of the document aligns with well enough."""
    templates = {f"t{i}": " ".join(words(700 + i, n, 400)) for i, n in enumerate((12, 25, 40, 70))}
    rows = []
    for i in range(40):
        name = f"t{i % 4}"
        size = len(templates[name].split())
        inside = edited(templates[name].split(), i, (i % 5) * size // 12)
        if i % 3 == 0:
            del inside[size // 2]
        rows.append((i, " ".join(words(i, 50, 400) + inside + words(900 + i, 30, 400))))
    want = set()
    for d, text in rows:
        ws = text.split()
        for name, t in templates.items():
            t = t.split()
            if max(lcs(t, ws[at : at + len(t) + 2]) for at in range(len(ws))) * 100 >= 80 * len(t):
                want.add((d, name))
    got = S.scan_licenses(documents(spark, rows), templates).collect()
    assert {(r.doc_id, r.template) for r in got} == want and 15 < len(want) < 40
    for r in got:
        ws, t = S._WORD.findall(rows[r.doc_id][1][r.start : r.end]), templates[r.template].split()
        assert lcs(t, ws) >= r.matched and 100 * r.matched >= 80 * r.words and ws[0] in t and ws[-1] in t
