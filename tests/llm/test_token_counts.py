import json
import random

import public_tokenizers

from shelfloom.llm.token_counts import Automaton, Counts, count_pieces
from tests.llm.helpers import documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, initial, continuing):
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def ended(word, inner, final):
    """Greedy pieces of a word and its end; the end alone, after a piece that isn't final, counts nothing."""
    at, n = 0, 0
    while at < len(word):
        if word[at:] in final:
            return n + 1
        end = next((e for e in range(len(word), at, -1) if word[at:e] in inner), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_random_final_pieces():
    r = random.Random(3)
    piece = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    for _ in range(150):
        inner, final = {piece() for _ in range(r.randrange(1, 10))}, {piece() for _ in range(r.randrange(1, 10))}
        automaton = Automaton(inner | {p + "$" for p in final} | {"$"}, free=frozenset("$"))
        for _ in range(60):
            w = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
            assert automaton.count(w + "$") == ended(w, inner, final), (w, inner, final)


def test_random_vocabularies():
    r = random.Random(0)
    for _ in range(150):
        piece = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
        one, two = {piece() for _ in range(r.randrange(1, 12))}, {piece() for _ in range(r.randrange(1, 12))}
        same, split = Automaton(one), Automaton(one, two)
        for _ in range(60):
            w = "".join(r.choice("abcd"[: r.choice((3, 3, 4))]) for _ in range(r.randrange(0, 12)))
            assert same.count(w) == greedy(w, one, one), (w, one)
            assert split.count(w) == greedy(w, one, two), (w, one, two)


def test_query_on_a_fixture(spark):
    rows = [(1, "The QUICK brown-fox's 123 jumps!!"), (2, None), (3, ""), (4, "née Ærø 東京 _x_"), (4, "née Ærø 東京 _x_"), (5, "x" * 20_000 + " " + " ".join(words(1, 2000)))]
    with open(PATH, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    inner, final = {p for p in pieces if not p.endswith("</w>")}, {p.removesuffix("</w>") for p in pieces if p.endswith("</w>")}
    counts = Counts.of(PATH)
    want = []
    for d, t in rows:
        ws = __import__("re").findall(r"[^\W\d_]+|\d|[^\w\s]+|_+", (t or "").lower())
        want.append((d, len(ws), sum(ended("".join(counts.bytes_as[b] for b in w.encode()), inner, final) if len(w) < 1000 else counts.word(w) for w in ws)))
    got = [tuple(r) for r in count_pieces(documents(spark, rows), PATH).collect()]
    assert sorted(got) == sorted(want)
    assert count_pieces(documents(spark, []), PATH).count() == 0
