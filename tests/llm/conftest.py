import datetime as dt

import pytest

RAW = "id string, language string, source string, original_text string, sentiment_label int, rating int, product_id string, category string, created_at timestamp, t string, fp string, cls long, text string, label int, n int"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, doc_type string, product_id string, category string, created_at timestamp, raw string, form string, id string"
TRAIN = "id string, text string, label int, hard_label int, soft_labels array<double>, cot string, rating int, confidence double, category string, answer string"
CHATS = "id string, conversations array<struct<role:string,content:string>>, text string, label int, soft_labels array<double>, category string, question string"
SOFT = "id string, split string, text string, probabilities array<double>, hard_label int, confidence double, model string, cls long, train boolean"

NOW = dt.datetime(2024, 1, 1)


def raw(i, text, language="en", source="amazon_hf", product=None, category=None):
    # the columns after created_at are extra ones whose names clash with names the operators use
    return (i, language, source, text, 1, 3, product, category, NOW, "x", "x", 1, "x", 1, 1)


def doc(i, text, lang="en", source="amazon_hf"):
    return (i, text, lang, source, len(text or ""), "review", None, None, NOW, "x", "x", "x")


def train_row(i, text, cot):
    return (i, text, 1, 1, [0.2, 0.6, 0.2], cot, 3, 0.9, None, "x")


def chat_row(i, review, reply):
    turns = [("system", "s"), ("user", f"Review: {review}")] + ([("assistant", reply)] if reply != "absent" else [])
    return (i, turns, review, 1, None, None, "x")


@pytest.fixture()
def tables(save):
    """Folder with all tables; those not given are empty."""

    def put(raw_records=(), documents=(), train=(), conversation_rows=(), soft_labels_reviewed=(), processed_records=()):
        save("raw_records", list(raw_records), RAW)
        save("documents", list(documents), DOCS)
        save("train", list(train), TRAIN)
        save("conversation_rows", list(conversation_rows), CHATS)
        save("soft_labels_reviewed", list(soft_labels_reviewed), SOFT)
        save("processed_records", list(processed_records), "id string, text_for_llm string")
        save("split_targets", [("default", "train", 0.8), ("default", "val", 0.1), ("default", "test", 0.1)], "scheme string, split string, share double")
        save("pack_capacities", [("tiny", 16), ("base", 64)], "capacity_name string, capacity_tokens int")
        return save("mix_targets", [("m", "a", 0.5, 2), ("m", "b", 0.5, 3), ("m", "gone", 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")

    return put
