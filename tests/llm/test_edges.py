"""Every query on empty tables and on rows of nulls, blanks, repeats and very long texts."""

import pytest

from textmill.llm import queries

from .conftest import chat_row, doc, raw, train_row

NAMES = sorted(queries.queries())
LONG = ("The lid works well in the garage. " * 4000) + " " * 20000 + "a" * 30000 + "1" * 3000


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tables, name):
    folder = tables()
    assert queries.queries()[name](spark, folder).collect() is not None


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, tables, name):
    texts = [None, "", "   ", "​", "😡", "-", "...", "a", LONG, LONG]
    raws = [raw(f"r{i}", t, product=t if t and len(t) < 9 else None) for i, t in enumerate(texts)]
    raws += [raw(None, "x"), raws[-1], (None,) * len(raws[0])]
    docs = [doc(i, t) for i, t in enumerate(texts)] + [doc(8, LONG), (None,) * 12]
    trains = [train_row(f"t{i}", t, t) for i, t in enumerate(texts)] + [(None,) * 10, train_row("t1", "", "")]
    chats = [chat_row(f"c{i}", t, t) for i, t in enumerate(texts)] + [chat_row("c99", "x", "absent"), (None,) * 7, ("c98", [], None, None, None, None, None)]
    soft = [(f"s{i}", s, t, None, 1, 0.9, "m", 1, True) for i, t in enumerate(texts) for s in ("train", "dev", None)] + [(None,) * 9]
    folder = tables(raws, docs, trains, chats, soft, [("p1", None), ("p2", LONG), (None, "x")])
    rows = queries.queries()[name](spark, folder).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
        assert all(v is not None for r in rows for v in r)
