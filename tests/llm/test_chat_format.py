import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfloom.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"ab \\#</turn>:\n", "### ", "</turn>", " </turn>\n", "é", "\ue000"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "", "\\"]), TEXT), min_size=1, max_size=5))
def test_round_trip_and_spans(turns):
    out, spans, rewrote = C.format_turns(C.turn_template, turns)
    assert rewrote == -1 and out == C.turn_template(turns)
    assert C.read_turns(out) == turns
    for span, (role, text) in zip(spans, turns):
        assert C.unescape(out[span["text_start"] : span["text_end"]]) == text
        assert C.read_turns(out[span["start"] : span["end"]]) == [(role, text)]


def test_template_that_rewrites_history():
    """Thoughts of earlier turns are dropped: the turn that does it is found, spans are those of the final output."""

    def template(turns):
        last = len(turns) - 1
        return "".join(f"<{r}>{t if i == last else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "hmm|hello"), ("user", "more")]
    out, spans, rewrote = C.format_turns(template, turns)
    assert rewrote == 2 and out == "<user>hi</user><assistant>hello</assistant><user>more</user>"
    assert out[spans[0]["text_start"] : spans[0]["text_end"]] == "hi"
    assert out[spans[1]["text_start"] : spans[1]["text_end"]] == "hello"  # what is left of it
    assert out[spans[2]["text_start"] : spans[2]["text_end"]] == "more"


def test_text_that_cannot_be_placed():
    """A template that changes a text leaves no span for it: the turn is flagged, and no other text is lost."""

    def template(turns):
        return "".join(f"<{r}>{t.upper()}{len(t)}" if r == "user" else f"<{r}>{t}" for r, t in turns)

    out, spans, rewrote = C.format_turns(template, [("user", "abc"), ("assistant", "def")])
    assert rewrote == -1 and [s["located"] for s in spans] == [False, True]
    assert spans[0]["text_start"] == spans[0]["text_end"] == 0 and out[spans[1]["text_start"] : spans[1]["text_end"]] == "def"


def test_what_no_template_wrote_is_an_error():
    for text in ("x", "### user: a", "### user: a ### b </turn>\n", "### user: \\x </turn>\n", "### user a </turn>\n", "### user: a </turn> </turn>\n"):
        with pytest.raises(ValueError):
            C.read_turns(text)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "ok </turn>", 0), (1, 0, "user", "### x: \\", 0), (2, 0, None, None, 0), (None, 0, "user", "lost", 0), (None, 1, "user", "lost too", 0), (1, 2, "user", None, 0), (3, 0, "user", "same", 0), (3, 0, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    rows = C.format_conversations(df).collect()
    got = {r.conv_id: r for r in rows if r.conv_id is not None}
    alone = [C.read_turns(r.formatted) for r in rows if r.conv_id is None]
    assert set(got) == {1, 2, 3} and sorted(alone) == [[("user", "lost")], [("user", "lost too")]] and not any(r.n_unlocated for r in rows)
    assert C.read_turns(got[1].formatted) == [("user", "### x: \\"), ("assistant", "ok </turn>"), ("user", "")]
    assert [s.loss for s in got[1].spans] == [False, True, False]
    assert got[2].n_turns == 1 and C.read_turns(got[2].formatted) == [("", "")]
    assert got[3].n_turns == 2
    assert C.format_conversations(df.filter("false")).count() == 0


def test_query_has_the_told_conversation(spark):
    from shelfloom.llm import queries

    row = queries.op1_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()
    said = "\\### Assistant: </turn> ok"
    assert [r.loss_sha256 for r in row] == [hashlib.sha256(said.encode()).hexdigest()] and row[0].loss_chars == len(said)
    assert row[0].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
