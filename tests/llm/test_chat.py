import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s>[ROLE]x[/ROLE]", "[SEP]", r"[\SEP]", "<", "[", "/s>", "", None, "é\n\t😀", "[[SEP]]<<s>>", "\\", "a" * 50000]


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_chats(chat.format_chats(df)).collect()
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = [t[1:] for t in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert list(r.loss_texts) == [t for role, t in turns if role == "assistant"]
        merged = sum(1 for i, t in enumerate(turns) if i == 0 or turns[i - 1][0] != t[0])
        assert r.formatted.count(chat.CLOSE) == merged == r.formatted.count(chat.OPEN)


def test_reversible(spark):
    rows = [(i, t, r, x) for i, x in enumerate(HARD) for t, r in enumerate(["system", "user", "assistant", "assistant", "user"])]
    rows += [(100 + i, i, x, "t") for i, x in enumerate(HARD)] + [(None, None, None, None), (None, 1, "assistant", "<"), (None, 2, "assistant", "s>"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    check(spark, rows)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet=list("<[\\/s>SEPINT] "), max_size=12)), min_size=1, max_size=30))
def test_any_text(spark, turns):
    check(spark, [(i % 3, i, r, x) for i, (r, x) in enumerate(turns)])


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op7_chat_format(spark, sf_dir).collect()}
    said = "user\n" + chat.HOSTILE + "\nassistant\n" + chat.HOSTILE + "\n"
    assert got[-1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].n_turns == 2
    assert (got[-1].loss_chars, got[-1].loss_sha256) == (len(chat.HOSTILE), hashlib.sha256(chat.HOSTILE.encode()).hexdigest())
