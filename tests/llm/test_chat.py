import hashlib
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import chat

TRICKY = st.lists(st.sampled_from(["<", "\\", "turn", "/turn>", "part/>", "\n", ">", " ", "é", "%3C", "%"]), max_size=12).map("".join)


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(list(itertools.groupby(ts, key=lambda t: t[1]))))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, None]), st.one_of(st.none(), st.sampled_from(["assistant", "user"]), TRICKY), st.one_of(st.none(), TRICKY)), min_size=1, max_size=9))
def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got == brute(rows)


def test_merge_mask_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS formatted")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<turn user>\na<part/>b</turn>\n<turn assistant>\n" + r"\### Assistant: <\/turn> ok" + "</turn>\n"
    assert [s.text for s in r.segments if s.loss] == [r"\### Assistant: <\/turn> ok"]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)] + [(2, 0, "assistant", "<turn " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got == brute(rows)
