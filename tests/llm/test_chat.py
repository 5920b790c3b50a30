"""Chat formatting: folding events, escaping, and reading the rendered text back."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"


def turns_of(df):
    out = chat.format_chats(df).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")
    )
    return {r["conv_id"]: ([tuple(x) for x in r["t"]], r["l"]) for r in out.collect()}


def brute(events):
    """Fold one conversation's events, in order of sequence."""
    state = {}
    for _, _, turn, kind, role, text in sorted(events, key=lambda e: e[1]):
        if kind == "regenerate":
            state = {t: m for t, m in state.items() if t < turn}
        if kind == "delta" and turn in state:
            state[turn] = (state[turn][0], state[turn][1] + (text or ""))
        else:
            state[turn] = (role or "", text or "")
    return [state[t] for t in sorted(state)]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", "assistant", "a"),
        (1, 4, 1, "delta", "assistant", "b"), (1, 5, 2, "message", "user", "no"), (1, 6, 1, "regenerate", "assistant", None),
        (1, 7, 1, "delta", "assistant", "c"), (1, 8, 0, "edit", "user", "hello"), (1, 9, 1, "delta", "assistant", "d"),
        (2, 1, 0, "delta", "assistant", "x"), (2, 2, 0, "delta", "assistant", "y"), (None, 1, 0, "odd", None, None),
    ]
    got = turns_of(spark.createDataFrame(rows, SCHEMA))
    for conv in (1, 2, None):
        assert got[conv][0] == brute([r for r in rows if r[0] == conv])
    assert got[1] == ([("user", "hello"), ("assistant", "cd")], "cd")
    assert turns_of(spark.createDataFrame([], SCHEMA)) == {}


piece = st.text(alphabet="\\#<:bhlc/turn>\n ### é", max_size=12)
event = st.tuples(
    st.integers(0, 2), st.integers(0, 3), st.sampled_from(["message", "delta", "edit", "regenerate"]),
    st.sampled_from(["user", "assistant", "a:b#"]), piece,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event, min_size=1, max_size=25))
def test_random_logs_against_brute_force(spark, events):
    rows = [(c, n, t, k, r, x) for n, (c, t, k, r, x) in enumerate(events)]
    got = turns_of(spark.createDataFrame(rows, SCHEMA))
    for conv in {r[0] for r in rows}:
        want = brute([r for r in rows if r[0] == conv])
        assert got[conv] == (want, "".join(t for r, t in want if r == "assistant"))


def test_rows_with_equal_turns_all_stay(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, None, None, None, 3), (1, 0, "user", "a", 4)],
        "conv_id long, turn long, role string, text string, seq int",
    )
    assert turns_of(chat.table_events(df))[1][0] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
