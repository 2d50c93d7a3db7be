"""The role machine's outcome for whole conversations, by the registered query."""

from scriptorium.llm import queries

STEPS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}


def test_turn_order_of_every_conversation(spark, tmp_path):
    talks = {1: ["user", "assistant"], 2: ["system", "user", "assistant"], 3: ["assistant", "user"], 4: ["user"], 5: ["user", "assistant"] * 70, 6: ["user", "assistant"] * 40 + ["assistant"], 7: ["user", None], 8: ["system", "system", "user", "assistant"]}
    rows = [(c, n, role, f"{role} {n}") for c, roles in talks.items() for n, role in enumerate(roles)]
    spark.createDataFrame(rows[::-1], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def valid(roles):
        state = "start"
        for role in roles:
            state = STEPS.get((state, role), "error")
        return state == "assistant"

    found = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in queries.QUERIES["op6_chat_format"](spark, str(tmp_path)).where("conv_id > 0").collect()}
    assert found == {c: (len(roles), valid(roles)) for c, roles in talks.items()}
