"""Conversations and prompts: building, rendering and checking them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.probs import confidence, default_soft
from textmill.schemas import LABEL_NAMES, THOUGHT_CLOSE, THOUGHT_OPEN

#: Templates of the caller's prompts: system text and user text with ``{text}`` for each language.
SYSTEM = {
    "en": "Classify the sentiment of the review: negative(0), neutral(1) or positive(2). Reply in JSON.",
    "zh": "请判断评论的情感：负面(0)、中性(1)或正面(2)，以 JSON 回复。",
    "ru": "Определите тональность отзыва: негативная(0), нейтральная(1) или позитивная(2). Ответьте в JSON.",
}
USER = {"en": 'Review: "{text}"', "zh": '评论："{text}"', "ru": 'Отзыв: "{text}"'}
EXAMPLES = {
    "en": (("Great quality and fast shipping.", 2), ("Okay, as expected.", 1), ("Waste of money.", 0)),
    "zh": (("质量非常好，很满意！", 2), ("一般般，可以接受。", 1), ("质量太差，退货！", 0)),
    "ru": (("Отличное качество!", 2), ("Нормально, сойдёт.", 1), ("Ужасное качество.", 0)),
}


def _lookup(table: dict[str, str], language: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(language == key, value).otherwise(out)
    return out


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def system_prompt(language: Column) -> Column:
    """Null for a language without a template; see ``require_language`` for an error instead."""
    return _lookup(SYSTEM, language)


def require_language(language: Column) -> Column:
    """The language, or an error at run time if it has no template."""
    known = language.isin(*SYSTEM)
    return F.when(F.coalesce(known, F.lit(False)), language).otherwise(F.raise_error(F.concat(F.lit("no template for language "), F.coalesce(language, F.lit("null")))).cast("string"))


def user_prompt(text: Column, language: Column) -> Column:
    return F.replace(_lookup(USER, language), F.lit("{text}"), text)


def label_name(label: Column, language: Column) -> Column:
    names = F.lit(None).cast("string")
    for lang, values in LABEL_NAMES.items():
        for i, value in enumerate(values):
            names = F.when((language == lang) & (label == i), value).otherwise(names)
    return names


def few_shot(language: Column, n: int = 3) -> Column:
    """The first ``n`` examples of the language as ``array<struct<input, output>>``; empty for another."""
    empty = F.array().cast("array<struct<input:string,output:string>>")
    out = empty
    for lang, rows in EXAMPLES.items():
        made = F.array(*(F.struct(F.lit(t).alias("input"), F.lit(f'{{"sentiment": {k}}}').alias("output")) for t, k in rows[:n]))
        out = F.when(language == lang, made).otherwise(out)
    return out


def chat_messages(text: Column, language: Column, examples: Column) -> Column:
    """System turn, a user and an assistant turn per example, then the question."""
    shots = F.flatten(F.transform(examples, lambda e: F.array(turn("user", user_prompt(e["input"], language)), turn("assistant", e["output"]))))
    return F.concat(F.array(turn("system", system_prompt(language))), shots, F.array(turn("user", user_prompt(text, language))))


def chatml(messages: Column, generate: bool = True) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>\\n`` per turn, and the opening of the next."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def render_history(messages: Column, generate: bool = False) -> Column:
    """ChatML where assistant turns before the last user turn lose their thoughts, and later ones keep them."""
    places = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    last_user = F.coalesce(F.array_max(places), F.lit(-1))
    lead = lambda c: F.regexp_replace(c, r"^\n+", "")
    ends = lambda c: F.regexp_replace(c, r"^\n+|\n+$", "")

    def one(m: Column, i: Column) -> Column:
        content = m["content"]
        has = content.contains("</think>")
        answer = F.when(has, lead(F.substring_index(content, "</think>", -1))).otherwise(content)
        thought = F.when(has, ends(F.substring_index(F.substring_index(content, "</think>", 1), "<think>", -1))).otherwise("")
        keep = (i > last_user) & ((i == F.size(messages) - 1) | (F.length(thought) > 0))
        said = F.when(keep, F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), lead(answer))).otherwise(answer)
        return F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.when(m["role"] == "assistant", said).otherwise(content), F.lit("<|im_end|>\n"))

    body = F.array_join(F.transform(messages, one), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def to_conversations(df: DataFrame, instruction: str = SYSTEM["en"]) -> DataFrame:
    """``conversations, text, label, soft_labels, category`` of training rows; the reasoning stands in the thought block.

    The JSON is put together by hand, as its blanks after ``:`` and ``,`` are part of the format.
    """
    cot = F.coalesce("cot", F.lit(""))
    quoted = F.expr("to_json(named_struct('x', coalesce(cot, '')))")
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    sure = F.coalesce("confidence", confidence(F.col("soft_labels"))).cast("string")
    reply = F.concat(
        F.lit(f"{THOUGHT_OPEN}\n"), cot, F.lit(f"{THOUGHT_CLOSE}\n"), F.lit('{"sentiment": '), F.col("label").cast("string"),
        F.lit(', "confidence": '), sure, F.lit(', "rationale": '), quoted, F.lit("}"),
    )
    turns = F.array(turn("system", F.lit(instruction)), turn("user", F.concat(F.lit("Review: "), F.coalesce("text", F.lit("")))), turn("assistant", reply))
    return df.select("id", turns.alias("conversations"), "text", "label", default_soft(F.col("soft_labels")).alias("soft_labels"), F.coalesce("category", F.lit("unknown")).alias("category"))


def split_conversations(parts: dict[str, DataFrame], instruction: str = SYSTEM["en"]) -> DataFrame:
    """The conversations of several splits as one frame with ``split``."""
    made = [to_conversations(df, instruction).withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, made)


def to_instructions(df: DataFrame, instruction: str = SYSTEM["en"]) -> DataFrame:
    return df.select(F.lit(instruction).alias("instruction"), F.col("text").alias("input"), F.col("hard_label").cast("string").alias("output"), F.col("soft_labels"), "confidence")


def format_violations(df: DataFrame) -> DataFrame:
    """``id, violation`` for conversations that lack a turn, a role, a marker or a sentiment in the JSON.

    Null conversations count as having no turns.
    """
    turns = F.coalesce("conversations", F.array().cast("array<struct<role:string,content:string>>"))
    role = lambda i: F.get(turns, F.lit(i))["role"]
    reply = F.coalesce(F.try_element_at(F.filter(turns, lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))
    tests = {
        "turns": F.size(turns) != 3,
        "system": F.coalesce(role(0), F.lit("")) != "system",
        "user": F.coalesce(role(1), F.lit("")) != "user",
        "assistant": F.coalesce(role(2), F.lit("")) != "assistant",
        "thought_open": ~reply.contains(THOUGHT_OPEN),
        "thought_close": ~reply.contains(THOUGHT_CLOSE),
        "sentiment": ~F.substring_index(reply, THOUGHT_CLOSE, -1).contains('"sentiment"'),
    }
    found = F.filter(F.array(*(F.when(test, name) for name, test in tests.items())), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("violation"))


def train_prompt(text: Column) -> Column:
    return F.concat(F.lit("Sentiment (0=neg,1=neu,2=pos):\n"), F.coalesce(text, F.lit("")), F.lit("\nAnswer:"))


def fill_template(template: str, text: Column) -> Column:
    """Puts the text in place of ``{text}``; other braces of the template stay as they are."""
    return F.replace(F.lit(template), F.lit("{text}"), F.coalesce(text, F.lit("")))
