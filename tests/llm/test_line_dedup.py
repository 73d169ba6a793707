import re
from collections import defaultdict

import pytest

from shelfloom.llm import line_dedup as L
from shelfloom.llm import scratch
from tests.llm.helpers import documents, words


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if normal(line) and site is not None:
                sites[normal(line)].add(site)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for d, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if normal(x) not in bad]
        some = any(normal(x) for x in kept)
        if text is not None and some:
            out.append((d, "\n".join(kept), len(lines) - len(kept), False))
        else:
            out.append((d, text, 0, len(kept) < len(lines)))
    return sorted(out, key=str)


def rows_for(sites):
    rows = []
    for i in range(sites):
        for j in range(3):
            lines = [" ".join(words(i * 10 + j, 20)), "All  Rights reserved" if j == 0 else "All rights RESERVED"]
            if i < 9:
                lines.append("share this page now")
            if i < 10:
                lines.append("follow us everywhere today")
            rows.append((i * 10 + j, "\n".join(lines), f"site{i}"))
    rows += [(900, None, "x"), (901, "", None), (902, "All rights reserved", "y"), (903, "all rights reserved\n" + " ".join(words(5, 30)), None), (904, "two words\ntwo words", "z"), (0, rows[0][1], "site0")]
    rows += [(None, "follow us everywhere today\nmine alone", "site0"), (None, "ok\nmine too", "site0"), (950, "OK\nthe  the\n\nof my own", "q")]
    return rows + [(905 + i, "the the\nok", f"site{i}") for i in range(12)]


@pytest.mark.parametrize("lg_k", [4, 10])
def test_against_brute_force(spark, lg_k):
    """Lines on 9, 10 and 30 sites around a threshold of 10, with a coarse and a fine sketch."""
    rows = rows_for(30)
    df = documents(spark, rows)
    out = L.remove_boilerplate(df, min_sites=10, lg_k=lg_k)
    assert set(out.columns) == {*df.columns, "all_boilerplate"}
    got = sorted(((r.doc_id, r.text, r.n_lines_removed, r.all_boilerplate) for r in out.collect()), key=str)
    assert got == brute(rows, 10)


def test_sketch_is_exact_near_the_threshold(spark):
    """Many sites and the smallest sketch: the estimate alone would be wrong."""
    rows = [(s * 1000 + i, f"line number {s} is here\n" + " ".join(words(s * 1000 + i, 9)), f"site{i}") for s, n in enumerate((95, 99, 100, 101, 108)) for i in range(n)]
    hashes = L.line_hashes(documents(spark, rows), "doc_id", "source")
    assert L.boilerplate(hashes, 100, 4).count() == 3


def test_empty_table(spark):
    assert L.remove_boilerplate(documents(spark, [])).count() == 0
    assert scratch.root(spark)
