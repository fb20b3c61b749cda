import hashlib

from hypothesis import given
from hypothesis import strategies as st

from strandline.llm import chat
from strandline.llm.queries import FORGED

ROW = "conv_id long, turn long, role string, text string, seq string, output string"


def want(rows):
    """Digests of (role, text) rows."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def test_round_trip(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, 1, "ro>\nle\\<", "</turn>\n<turn user>\n"), (None, 0, "user", "x" * 200_000), (3, 0, "assistant", "é" * 3), (3, 0, "assistant", "é" * 3)]
    forged = [(c, t, r, x) for c, t, r, x in FORGED]
    data = spark.createDataFrame([(*r, "s", "o") for r in rows + forged], ROW)
    got = {r.conv_id: r for r in chat.round_trip(data).collect()}
    expected = {
        1: [(None, None), ("user", "a"), ("assistant", "b")], 2: [("assistant", None), ("assistant", "tie"), ("ro>\nle\\<", "</turn>\n<turn user>\n")],
        None: [("user", "x" * 200_000)], 3: [("assistant", "é" * 3)] * 2, -7: [(r, x) for _, _, r, x in forged],
    }
    assert set(got) == set(expected)
    for k, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(expected[k])
    assert got[3].formatted_chars == 2 * len("<turn assistant>\nééé</turn>\n")
    assert chat.round_trip(data.limit(0)).collect() == []


@given(st.lists(st.tuples(st.text(), st.text()), max_size=4))
def test_any_text_reads_back(turns):
    visitor = chat.PartVisitor()
    output = "".join(visitor.turn(r, [{"type": "text", "text": t}])[0] for r, t in turns)
    assert [(r, "".join(p[1] for p in parts)) for r, parts in chat.parsed(output)] == turns


def test_typed_parts(spark):
    parts = [("text", "see <image 0>", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "ok", None, None, None, None, None)]
    data = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", [("image", None, "j.png", None, None, None, None)]), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = chat.formatted(data).orderBy("seq").collect()
    first = rows[0]
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 50), (2, "document", "d.pdf", 1536)]
    assert all(first.output[a.offset :].startswith(f"<{a.type} {a.ordinal}>") for a in first.attachments) and first.expanded_tokens == 1590
    assert [chat.unescape(first.output[s.start : s.start + s.length]) for s in first.loss] == ["see <image 0>", "ok"]
    assert [a.ordinal for a in rows[1].attachments] == [3] and rows[1].loss == []
    assert list(chat.parsed(first.output)) == [("assistant", [("text", "see <image 0>"), ("image", 0), ("audio", 1), ("document", 2), ("text", "ok")])]


def test_bad_parts_are_noted_and_end_nothing(spark):
    nan, inf = float("nan"), float("inf")
    parts = [("video", "x", "v", None, None, None, None), None, ("audio", None, None, None, None, nan, None), ("audio", None, None, None, None, inf, None), ("audio", None, None, None, None, -2.0, None), ("audio", None, None, None, None, 1e300, None), ("image", None, None, -28, 56, None, None), ("document", None, None, None, None, None, -3), (None, "t", None, None, None, None, None)]
    data = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    bad, none = chat.formatted(data).orderBy("seq").collect()
    assert bad.errors == ["unknown content part: video"] and none.errors == [] and none.attachments == []
    assert [a.tokens for a in bad.attachments] == [1, 1, 1, round(chat.LONGEST * 25), chat.IMAGE_TOKENS, chat.PAGE_TOKENS]
    assert [p for _, p in chat.parsed(bad.output)][0][-1] == ("text", "t")
