from lotlens.llm import chat

END = "<|end|>\n"


def one(role, text):
    return f"<|{role or ''}|>\n{text or ''}{END}"


def brute(chosen, rejected):
    clean = [[(r or "", t or "") for r, t in x or []] for x in (chosen, rejected)]
    at = 0
    while at < min(map(len, clean)) and clean[0][at] == clean[1][at]:
        at += 1
    out = [at, "".join(one(*t) for t in clean[0][:at])]
    for turns in clean:
        text, spans = "", []
        for role, t in turns[at:]:
            if role == "assistant":
                a = len(text) + len(f"<|{role}|>\n")
                spans.append((a, a + len(t) + len("<|end|>")))
            text += one(role, t)
        out += [text, spans]
    return [*out, clean[0] == clean[1]]


def test_pairs_equal_brute_force(spark):
    u, a, b = ("user", "hi é😀"), ("assistant", "yes"), ("assistant", "no " * 20_000)
    pairs = [([u, a], [u, b]), ([u, a, u, a], [u, a, u, b, u]), ([u, a], [u, a]), ([], [u, a]), (None, None), ([u, a], None), ([u], [u, a]),
             ([("user", None), (None, "x"), a], [("user", ""), ("", "x"), b]), ([a], [b])] * 2
    rows = [(i, c, r, "kept") for i, (c, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"pair long, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>, prompt_note string")
    got = chat.format_preferences(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r.prompt_turns, r.prompt, r.chosen_text, [tuple(s) for s in r.chosen_spans], r.rejected_text, [tuple(s) for s in r.rejected_spans], r.tie] == brute(*pairs[r.pair])
        for s in r.chosen_spans:
            assert r.chosen_text[s.start:s.end].endswith("<|end|>")
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_conversations_and_replies(spark):
    rows = [(0, 1, "assistant", "A"), (0, 0, "user", "Q"), (0, 0, "user", "Q"), (0, 2, "user", "later"), (1, 0, "user", "P"), (1, 1, "assistant", "B"), (2, 0, "user", "only"),
            (4, 0, "assistant", None), (None, 0, "user", "lost"), (5, None, "user", "lost"), (7, 0, "system", "s"), (7, 0, "assistant", "r")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.mismatched_replies(df).collect()}
    assert got == {0: ([("user", "Q"), ("assistant", "A")], [("user", "Q"), ("assistant", "B")]), 1: ([("user", "P"), ("assistant", "B")], [("user", "P"), ("assistant", "A")]),
                   4: ([("assistant", "")], []), 7: ([("assistant", "r")], [])}
    assert chat.mismatched_replies(df.limit(0)).count() == 0


def test_repeated_turns_leave_before_the_exchange(spark):
    text = "".join(chr(33 + i * i * 7919 % 90) for i in range(2000))
    rows = spark.range(20_000, numPartitions=2).selectExpr("1L as conv_id", "id % 2 as turn", "'user' as role", f"concat(hash(id % 2), '{text.translate(str.maketrans("", "", chr(39) + chr(92)))}') as text")
    spark.sparkContext.setJobGroup("repeats", "")
    got = chat.conversations(rows).collect()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("repeats") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert [len(r.turns) for r in got] == [2]
    assert 0 < sum(x.shuffleWriteBytes() for s in stages for x in [store.lastStageAttempt(s)]) < 30_000
