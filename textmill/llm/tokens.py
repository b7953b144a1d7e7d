"""Token counts of texts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns and ``n_tokens``; null texts are left out, an empty text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(x)) for x in batch.column("_text").to_pylist()]
            columns = [batch.column(name) for name in keep] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    rows = df.select(*keep, F.col(text).alias("_text")).where("_text IS NOT NULL")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{types}, {out} long")
