"""Chat formatting of preferences: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.shaping import cell

TURN = "struct<role:string,text:string>"
#: What a turn is rendered between; the end belongs to what is learned.
HEAD, HEAD_END, END = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turns): the turns of each conversation in order, as an array of (role, text).

    Turns with one number are ordered by role and text. A row without an id is a
    conversation by itself, so no such rows are gathered; a null role or text is empty.
    """
    text = lambda name: F.coalesce(cell(name).cast("string"), F.lit(""))
    turn = F.struct(cell(turn_col).alias("at"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = turns.select(cell(id_col).alias("id"), turn.alias("turn"))
    gathered = (
        rows.where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .unionByName(rows.where("id IS NULL").select("id", F.array("turn").alias("turns")))
    )
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return gathered.select("id", plain.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def rendered(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(HEAD_END), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def learned_spans(turns: Column, role: str) -> Column:
    """(start, end) in code points of what is learned of the rendered turns: the texts of
    the given role with their ends; all else is masked."""

    def add(so_far, t):
        start = so_far["at"] + len(HEAD) + F.length(t["role"]) + len(HEAD_END)
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == role, F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda x: x["spans"])


def format_preferences(
    pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", role: str = "assistant"
) -> DataFrame:
    """The pairs with `prompt_turns`, `prompt`, and per side `.._text` and `.._learned`.

    `chosen_col` and `rejected_col` are arrays of (role, text). The longest common prefix of
    turns is rendered once, as `prompt`; what follows it in either conversation is that
    side's completion, with the spans of `role`'s texts that are learned.

    Edge cases: a null conversation is empty; a null turn, role or text is an empty one;
    equal conversations, or one that begins the other, leave an empty completion without
    spans; repeated pairs are rendered each; an empty table gives an empty result. Texts
    are not escaped: spans are positions, and do not depend on what a text contains.

    Every pair is rendered where it is: no shuffle. The columns added replace columns of
    these names; all others stay.
    """

    def side(name):
        given = F.coalesce(cell(name), F.array().cast(f"array<{TURN}>"))
        return F.transform(
            given,
            lambda t: F.struct(
                F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
            ),
        )

    both = pairs.withColumns({"__chosen": side(chosen_col), "__rejected": side(rejected_col)})
    both = both.withColumn("prompt_turns", common_prefix(F.col("__chosen"), F.col("__rejected")))
    shared = F.slice("__chosen", 1, F.col("prompt_turns"))
    rest = {
        name: F.slice(f"__{name}", F.col("prompt_turns") + 1, F.size(f"__{name}"))
        for name in ("chosen", "rejected")
    }
    both = both.withColumns({"prompt": rendered(shared), "__chosen_rest": rest["chosen"], "__rejected_rest": rest["rejected"]})
    added = {}
    for name in rest:
        added[f"{name}_text"] = rendered(F.col(f"__{name}_rest"))
        added[f"{name}_learned"] = learned_spans(F.col(f"__{name}_rest"), role)
    return both.withColumns(added).drop("__chosen", "__rejected", "__chosen_rest", "__rejected_rest")


def echo_pairs(talks: DataFrame, role: str = "assistant") -> DataFrame:
    """(id, chosen, rejected) of conversations: preferred is the conversation, dispreferred
    the same with every answer by `role` an echo of the turn before it.

    Both sides go on to the end, so all turns are rendered and every answer that differs
    from its echo is learned against it; a pair per answer would render a conversation as
    often as it has answers. The sides part at the first answer that is not its own echo.

    Edge cases: an answer without a turn before it, or after a null text, echoes the empty
    text; a conversation without an answer has equal sides, as has one without turns;
    repeated conversations make a pair each; an empty table gives an empty result.
    """

    def echo(t, i):
        before = F.get("turns", i - 1)["text"]
        said = F.when(t["role"] == role, F.coalesce(before, F.lit(""))).otherwise(t["text"])
        return F.struct(t["role"].alias("role"), said.alias("text"))

    return talks.select("id", F.col("turns").alias("chosen"), F.transform("turns", echo).alias("rejected"))
