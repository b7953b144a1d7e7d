"""Reading labels, reasons and probabilities out of model output, as column expressions.

Each reader is a ladder of rungs; a rung that finds nothing leaves the next its turn.
``regexp_extract`` gives an empty text where nothing matches, so every rung maps that to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.bind import bind
from textmill.functions.probs import argmax
from textmill.functions.text import after_first, before_first, strip
from textmill.schemas import THOUGHT_CLOSE, THOUGHT_OPEN, TURN_END

FLAT_JSON = r"(?s)\{[^{}]*\}"
SENTIMENT = r'"sentiment":\s*([0-2])'


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _sentiment(text: Column) -> Column:
    return _match(text, SENTIMENT)


def _first_int(*rungs: Column) -> Column:
    return F.coalesce(*rungs, F.lit("-1")).cast("int")


def _last_piece(text: Column, marker: str) -> Column:
    return F.when(text.contains(marker), F.substring_index(text, marker, -1))


def sentiment_channel(text: Column) -> Column:
    """Channel format: after the thought's end, else after its start, else before the turn's end, else anywhere."""

    def read(text: Column) -> Column:
        inner = after_first(text, THOUGHT_OPEN)
        return _first_int(_sentiment(after_first(inner, THOUGHT_CLOSE)), _sentiment(inner), _sentiment(before_first(text, TURN_END)), _sentiment(text))

    return bind(text, read)


def sentiment_thinking(text: Column) -> Column:
    """Thinking format: after ``</thinking>``, else in the last ``und_b8`` piece, else anywhere."""

    def read(text: Column) -> Column:
        return _first_int(_sentiment(after_first(text, "</thinking>")), _sentiment(_last_piece(text, "und_b8")), _sentiment(text))

    return bind(text, read)


def sentiment_plain(text: Column) -> Column:
    """``Answer: n``, else ``sentiment: n``, else the last digit 0, 1 or 2 of the text."""

    def read(text: Column) -> Column:
        last = F.try_element_at(F.regexp_extract_all(text, F.lit("([0-2])"), F.lit(1)), F.lit(-1))
        return _first_int(_match(text, r"Answer:\s*([0-2])"), _match(text, r"sentiment[:\s]+([0-2])"), last)

    return bind(text, read)


def sentiment_any(text: Column) -> Column:
    """``struct(label, format)``; the channel reader's last rung already takes all that the thinking reader can."""

    def pick(three: Column) -> Column:
        a, b, c = three["a"], three["b"], three["c"]
        label = F.when(a != -1, a).when(b != -1, b).otherwise(c)
        kind = F.when(a != -1, "gemma4").when(b != -1, "qwen3").when(c != -1, "simple").otherwise("unknown")
        return F.struct(label.alias("label"), kind.alias("format"))

    read = lambda t: F.struct(sentiment_channel(t).alias("a"), sentiment_thinking(t).alias("b"), sentiment_plain(t).alias("c"))
    return bind(text, lambda t: bind(read(t), pick))


def stated_json(text: Column) -> Column:
    """The object behind the thought block, if that block's reading gives the label and the object can be parsed; else null."""

    def read(rest: Column) -> Column:
        return F.when(_sentiment(rest).isNotNull(), bind(_match(rest, FLAT_JSON, 0), lambda body: F.when(F.try_parse_json(body).isNotNull(), body)))

    return bind(after_first(after_first(text, THOUGHT_OPEN), THOUGHT_CLOSE), read)


def sentiment_model(text: Column) -> Column:
    """After ``</think>``, after ``</thinking>``, anywhere."""

    def read(text: Column) -> Column:
        return _first_int(_sentiment(after_first(text, "</think>")), _sentiment(after_first(text, "</thinking>")), _sentiment(text))

    return bind(text, read)


def sentiment_batch(text: Column) -> Column:
    """Channel format, then as ``sentiment_model``."""

    def read(text: Column) -> Column:
        inner = after_first(text, THOUGHT_OPEN)
        return _first_int(
            _sentiment(after_first(inner, THOUGHT_CLOSE)), _sentiment(after_first(text, "</think>")), _sentiment(after_first(text, "</thinking>")), _sentiment(text)
        )

    return bind(text, read)


def first_json(text: Column, greedy: bool = True) -> Column:
    """First flat object of the text, else (``greedy``) from the first brace to the last; null if there is none."""
    flat = _match(text, FLAT_JSON, 0)
    return F.coalesce(flat, _match(text, r"(?s)\{.*\}", 0)) if greedy else flat


def rationale(text: Column) -> Column:
    """Reasoning: the thought block, the thinking block or second marker piece, else the JSON's rationale or reasoning."""
    kind = sentiment_any(text)["format"]
    inner = after_first(text, THOUGHT_OPEN)
    thought = F.when(inner.contains(THOUGHT_CLOSE), F.trim(F.regexp_replace(before_first(inner, THOUGHT_CLOSE), r"^\s+|\s+$", "")))
    block = F.when(text.contains("<thinking>") & text.contains("</thinking>"), _strip(F.regexp_extract(text, r"(?s)<thinking>(.*?)</thinking>", 1)))
    piece = F.when(text.contains("und_b8"), _strip(F.split_part(text, F.lit("und_b8"), F.lit(2))))
    body = first_json(text, greedy=False)
    stated = F.coalesce(F.nullif(F.get_json_object(body, "$.rationale"), F.lit("")), F.get_json_object(body, "$.reasoning"))
    return F.coalesce(F.when(kind == "gemma4", thought), F.when(kind == "qwen3", F.coalesce(block, piece)), stated)


def _strip(text: Column) -> Column:
    return strip(text)


def stated_confidence(text: Column) -> Column:
    """The JSON's confidence if it is a number in 0..1, else the number after the word, else null."""
    inside = lambda c: F.when(c.between(0, 1), c)
    from_json = F.get_json_object(first_json(text, greedy=False), "$.confidence").try_cast("double")
    from_text = _match(text, r"confidence[:\s]+([0-9.]+)").try_cast("double")
    return F.coalesce(inside(from_json), inside(from_text))


def strip_thinking(text: Column) -> Column:
    """``struct(answer, thinking)``: the first thought block, and the text without all of them and solution tags."""
    either = r"(?s)<\|begin_of_thought\|>(.*?)<\|end_of_thought\|>|<think>(.*?)</think>"
    first = F.coalesce(_match(text, either, 1), _match(text, either, 2))
    rest = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    rest = F.regexp_replace(rest, r"(?s)<\|begin_of_thought\|>.*?<\|end_of_thought\|>", "")
    rest = F.regexp_replace(rest, r"<\|(?:begin|end)_of_solution\|>", "")
    return F.struct(_strip(rest).alias("answer"), _strip(first).alias("thinking"))


_NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def _number(body: Column, key: str, default: Column, from_text: bool) -> Column:
    """Number under a key of a parsed object, ``default`` where the key is missing, null where it holds none.

    Truth values count as 0 and 1; a number written as text counts only ``from_text``.
    """

    def read(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        number = F.when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double")).when(kind == "BOOLEAN", (text == "true").cast("double"))
        if from_text:
            number = number.when((kind == "STRING") & text.rlike(_NUMBER), text.try_cast("double"))
        return F.when(kind.isNull(), default).otherwise(number)

    return bind(F.try_variant_get(body, f"$.{key}", "variant"), read)


def _probabilities(body: Column, from_text: bool) -> Column:
    """Three shares of a parsed object in the order of the labels; null if any of them is no number."""

    def scale(raw: Column) -> Column:
        total = raw[0] + raw[1] + raw[2]
        fixed = F.array(F.lit(0.33), F.lit(0.33), F.lit(0.34))
        return F.when(total > 0, F.transform(raw, lambda x: x / total)).when(total.isNotNull(), fixed)

    return bind(F.array(*(_number(body, k, F.lit(0.33), from_text) for k in ("negative", "neutral", "positive"))), scale)


def _is_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))


def annotation(text: Column) -> Column:
    """``struct(probabilities, hard_label, confidence, thinking_preview)`` of an annotator's reply.

    Null where no object can be read, or where a share or the confidence is there but is no number;
    a missing share is 0.33 and a missing confidence the largest share.
    """

    def of_parts(parts: Column) -> Column:
        preview = F.coalesce(F.substring(parts["thinking"], 1, 200), F.lit(""))

        def of_body(body: Column) -> Column:
            def of_probs(p: Column) -> Column:
                return bind(
                    _number(body, "confidence", F.array_max(p), True),
                    lambda c: F.when(c.isNotNull(), F.struct(p.alias("probabilities"), argmax(p).alias("hard_label"), c.alias("confidence"), preview.alias("thinking_preview"))),
                )

            return F.when(_is_object(body), bind(_probabilities(body, True), lambda p: F.when(p.isNotNull(), of_probs(p))))

        return bind(F.try_parse_json(first_json(parts["answer"])), of_body)

    return bind(strip_thinking(text), of_parts)


def annotation_batch(text: Column) -> Column:
    """``struct(probabilities, hard_label, confidence, reasoning, raw_response)`` of a batch annotator's reply.

    The first flat object is read, else the whole reply; shares must be numbers, not texts. Null where that fails.
    """

    def of_reply(text: Column) -> Column:
        def of_body(body: Column) -> Column:
            get = lambda k: F.try_variant_get(body, f"$.{k}", "string")
            confidence = lambda p: _number(body, "confidence", F.array_max(p), False)
            reasoning = F.when(F.try_variant_get(body, "$.reasoning", "variant").isNull(), F.lit("")).otherwise(get("reasoning"))
            of_probs = lambda p: F.struct(p.alias("probabilities"), argmax(p).alias("hard_label"), confidence(p).alias("confidence"), reasoning.alias("reasoning"), text.alias("raw_response"))
            return F.when(_is_object(body), bind(_probabilities(body, False), lambda p: F.when(p.isNotNull(), of_probs(p))))

        return bind(F.try_parse_json(F.coalesce(first_json(text, greedy=False), text)), of_body)

    return bind(text, of_reply)


def review_of_prompt(text: Column) -> Column:
    """Text after ``Review: `` up to the end mark, without white space around it, else what follows to the end.

    An empty review before an end mark is an empty text; null if nothing follows.
    """
    return bind(after_first(text, "Review: "), lambda tail: strip(F.coalesce(before_first(tail, "<|im_end|>"), F.nullif(tail, F.lit("")))))
