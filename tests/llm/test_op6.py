from cairn.llm import op6_preference as P

SCHEMA = "conv_id long, turn long, role string, text string, side string"


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_prefix_is_rendered_once_and_spans_cover_assistant_turns(spark):
    rows = [(0, 0, "user", "hi", "x"), (0, 1, "assistant", "yes", "x"), (0, 2, "user", "and?", "x"), (0, 3, "assistant", "good", "x")]
    rows += [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (1, 2, "user", "so?", "x"), (1, 3, "assistant", "bad one", "x"), (1, 4, "assistant", "", "x")]
    (r,) = P.preferences(P.by_neighbours(spark.createDataFrame(rows, SCHEMA))).collect()
    assert r.n_prefix == 2 and r.prompt == turn("user", "hi") + turn("assistant", "yes")
    assert r.chosen == turn("user", "and?") + turn("assistant", "good")
    assert [r.chosen[s.start : s.end] for s in r.chosen_learn] == ["good<|im_end|>"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_learn] == ["bad one<|im_end|>", "<|im_end|>"]
    assert r.usable


def test_edges(spark):
    rows = [(None, 0, "user", "lost", "x"), (2, 0, None, None, "x"), (2, None, "user", "first", "x"), (4, 0, "user", "a", "x"), (5, 0, "user", "a", "x")]
    rows += [(7, 0, "assistant", "ü😀", "x"), (7, 0, "assistant", "ü😀", "x")]
    out = {r.pair_id: r for r in P.preferences(P.by_neighbours(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].rejected is None and out[1].chosen == turn("user", "first") + turn("", "") and not out[1].usable
    assert out[2].n_prefix == 1 and out[2].chosen == out[2].rejected == "" and not out[2].usable
    assert out[3].chosen is None and [out[3].rejected[s.start : s.end] for s in out[3].rejected_learn] == ["ü😀<|im_end|>"] * 2
    assert P.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_by_table(spark):
    rows = [(1, 0, "user", "a", ""), (2, 0, "user", "a", ""), (3, 0, "user", "b", "")]
    pairs = spark.createDataFrame([(9, 1, 2), (8, 1, 3)], "pair_id long, chosen_id long, rejected_id long")
    out = {r.pair_id: r.n_prefix for r in P.preferences(P.by_table(spark.createDataFrame(rows, SCHEMA).drop("side"), pairs)).collect()}
    assert out == {9: 1, 8: 0}
