import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from shelfloom.llm import substring_dedup as S
from tests.llm.helpers import documents, words


def sentences(seed, n, size=9):
    return [" ".join(words(seed * 1000 + i, size)).capitalize() + "." for i in range(n)]


def brute(rows, min_words=25, unit_words=4):
    """Removed spans by document, from a table of all units."""
    units, first = {}, {}
    for d, text in sorted({r for r in rows if r[1] is not None and r[0] is not None}):
        found, at = [], 0
        for line in text.split("\n"):
            start, end, said = None, at, ""
            for sentence in re.findall(r"[^.!?]+[.!?]*|^[.!?]+", line):
                place = at + line.index(sentence, end - at)
                end = place + len(sentence)
                if re.match(r"[.!?]", sentence):
                    continue
                start = place if start is None else start
                said += " " + sentence.rstrip(".!?")
                if len(said.split()) >= unit_words:
                    found.append((start, end, len(said.split()), " ".join(said.lower().split())))
                    start, said = None, ""
            at += len(line) + 1
        units[d, text] = found
        for *_, u in found:
            first.setdefault(u, d)
    out = {}
    for (d, text), found in units.items():
        seen, spans, run = set(), [], []
        for i, (a, b, n, u) in enumerate([*found, (0, 0, 0, None)]):
            again = u is not None and (first[u] != d or u in seen)
            seen.add(u)
            if again:
                run.append(i)
                continue
            if run and sum(found[j][2] for j in run) >= min_words:
                spans.append((found[run[0]][0], found[run[-1]][1]))
            run = []
        out[d, text] = spans
    return out


def test_against_brute_force(spark):
    passage = sentences(1, 7)
    rows = []
    for i in range(8):
        own = sentences(10 + i, 6)
        rows.append((i, " ".join(own[:3]) + " and so " + " ".join(passage) + "\n" + " ".join(own[3:]) if i % 2 else "\n".join(own)))
    rows += [(20, " ".join(sentences(50, 5)) + " Yes. " + " ".join(sentences(50, 5))), (21, None), (22, ""), (23, "The. The. The."), (24, passage[0]), (25, " ".join(sentences(10, 6)[:2])), (None, " ".join(passage)), (3, rows[3][1])]
    df = documents(spark, rows)
    got = S.drop_repeats(df, least={"sentence": 25}).collect()
    want = brute(rows)
    assert len(got) == len(rows) and set(got[0].__fields__) == set(df.columns)
    original = defaultdict(list)
    for d, t in rows:
        original[d].append(t)
    some = 0
    for r in got:
        text = original[r.doc_id][0]
        spans = want.get((r.doc_id, text), [])
        assert [(s.start, s.end) for s in r.removed] == spans, r.doc_id
        some += len(spans)
        assert r.text == ("".join(text[k.start : k.end] for k in r.kept) if text else text)
    assert some >= 5
    assert all(not r.removed for r in got if r.doc_id in (1, 24, 25, None))


def test_every_repeated_line_goes(spark):
    """Short ones, too; of each the earliest occurrence stays, and what stays has its offsets in the original."""
    rows = [(3, "Hello  World\nown three"), (1, "x\nhello world\n\nx"), (2, "hello world"), (2, "a\nhello WORLD\nb"), (4, "a\n\nc"), (5, "b"), (6, " \n"), (7, "x\nx")]
    got = sorted((r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in S.drop_repeats(documents(spark, rows)).collect())
    want = [
        (1, "x\nhello world\n\n", [(15, 16)]), (2, "", [(0, 11)]), (2, "a\n\nb", [(2, 13)]), (3, "\nown three", [(0, 12)]),
        (4, "\n\nc", [(0, 1)]), (5, "", [(0, 1)]), (6, " \n", []), (7, "", [(0, 3)]),
    ]
    assert got == sorted(want)


def test_ties_of_rank(spark):
    """Two documents of one rank share a line: it stays in one of them. Rows that are the same stay the same."""
    line = " ".join(words(1, 40))
    got = [r.text for r in S.drop_repeats(documents(spark, [(1, f"a\n{line}"), (1, f"b\n{line}"), (5, line), (5, line)])).collect()]
    assert sorted(t for t in got if t[:2] in ("a\n", "b\n")) in ([f"a\n{line}", "b\n"], ["a\n", f"b\n{line}"]) and got.count("") == 2
    got = [r.text for r in S.drop_repeats(documents(spark, [(5, line), (5, line)])).collect()]
    assert got == [line, line]


def test_empty_table_and_other_units(spark):
    assert S.drop_repeats(documents(spark, [])).count() == 0
    line = " ".join(words(1, 40))
    block = line + "\n" + line[::-1]
    got = {r.doc_id: r.text for r in S.drop_repeats(documents(spark, [(1, block), (2, f"x y\n\n{block}\n\nz")]), least={"paragraph": 1}).collect()}
    assert got[1] == block and line not in got[2] and got[2].startswith("x y")


def test_lines_and_sentences_together(spark):
    """A line that repeats goes with its short end; a passage inside another line goes too, and spans that overlap are one."""
    said = sentences(1, 4)
    line = " ".join(said) + " So."
    rows = [(1, line), (2, f"first\n{line}\nlast"), (3, "Before this one here. " + " ".join(said) + " After.")]
    got = {r.doc_id: (r.text, len(r.removed)) for r in S.drop_repeats(documents(spark, rows), least={"line": 15, "sentence": 25}).collect()}
    assert got == {1: (line, 0), 2: ("first\n\nlast", 1), 3: ("Before this one here. After.", 1)}


@given(st.integers(0, 50), st.lists(st.tuples(st.integers(0, 50), st.integers(1, 5)), max_size=4))
def test_kept_is_what_was_not_removed(n, parts):
    spans, at = [], 0
    for gap, size in parts:
        if at + gap + size <= n:
            spans.append((at + gap, at + gap + size))
            at += gap + size
    kept = S.kept_spans(n, spans)
    covered = sorted(i for a, b in spans + kept for i in range(a, b))
    assert covered == list(range(n))
