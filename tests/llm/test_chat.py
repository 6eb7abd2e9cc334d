import hashlib

from countloom.llm import chat

TURNS = "conv_id long, turn int, role string, text string, formatted string"
ROWS = [
    (1, 1, "assistant", "b <|im_end|>", "x"),
    (1, 0, "user", "a \\ \\| <\\| <| <<|im_sep|>\n", "x"),
    (1, 2, "assistant", "", "x"),
    (1, 3, "user", None, "x"),
    (1, 4, None, "no role", "x"),
    (2, None, "assistant", "first", "x"),
    (2, 0, "assistant", "é𝄞", "x"),
    (2, 0, "assistant", "é𝄞", "x"),
    (None, 0, "user\n", "x\\", "x"),
]


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame(ROWS, TURNS).repartition(3)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in ROWS if c == conv))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(texts[conv].formatted)
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert texts[conv].formatted.count(chat.START) == blocks == texts[conv].formatted.count(chat.END)


def test_empty(spark):
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_long_conversation_and_long_text(spark):
    turns = 5000
    rows = [(7, i, "assistant" if i % 3 else "user", f"t{i} <|im_end|>") for i in range(turns)] + [(8, 0, "assistant", "é" * 2_000_000)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    loss = {c: "".join(x for conv, _, role, x in rows if conv == c and role == "assistant") for c in (7, 8)}
    for r in formatted.collect():
        spans = [(s.start, s.length) for s in r.loss_spans]
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        said = "".join(r.formatted[a : a + n] for a, n in spans)
        assert said.replace("<\\|", "<|") == loss[r.conv_id]
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    assert got[7].n_turns == turns and got[8].loss_chars == 2_000_000
    assert all(got[c].loss_sha256 == hashlib.sha256(t.encode()).hexdigest() for c, t in loss.items())


def test_running_sums(spark):
    for values in ([], [3], [1, 2, 3, 4, 5], list(range(100))):
        df = spark.createDataFrame([(values,)], "v array<int>")
        want = [sum(values[: i + 1]) for i in range(len(values))]
        assert df.select(chat.running_sums(df.v).alias("s")).first().s == want
