"""Chat records that lack fields, or hold more than one layout."""

from __future__ import annotations

from citelake.llm import chat_format

SCHEMA = "conv_id int, messages array<struct<role:string,content:string>>, prompt string, response string"


def test_no_turn_is_invented_and_none_is_lost(spark):
    rows = [
        (1, [], "p", None),
        (2, None, None, "r"),
        (3, [(None, None)], None, None),
        (4, [("user", "a"), ("assistant", "b")], "PPP", "RRR"),
        (5, [], None, None),
        (6, None, "", ""),
        (7, [None], None, None),
    ]
    got = {r["conv_id"]: r for r in chat_format.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    back = spark.createDataFrame([(k, r["formatted"]) for k, r in got.items()], "k int, f string")
    turns = {r["k"]: [tuple(t) for t in r["t"]] for r in back.select("k", chat_format.read_back(back["f"]).alias("t")).collect()}
    assert turns[1] == [("user", "p")] and not got[1]["loss_mask"]
    assert turns[2] == [("assistant", "r")] and len(got[2]["loss_mask"]) == 1
    assert turns[3] == [("", "")] and got[3]["layout"] == "messages"
    assert turns[4] == [("user", "a"), ("assistant", "b")]
    assert got[5]["formatted"] == "" and got[5]["layout"] is None
    assert turns[6] == [("user", ""), ("assistant", "")]
    assert turns[7] == [("", "")]
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0, 6: 2, 7: 1}
