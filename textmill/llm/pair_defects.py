"""Problem 3: question-answer pairs whose answer is unusable, with the kind of defect.

The answer is split into clauses. A linear-chain conditional random field tags each clause as
answer, refusal, echo, foreign or unfinished from its overlap with the question, the language
models' verdict, learned cues of refusal (see ``refusals``), its place and the terminality of the
last clause. The share of the answer's words under each tag decides the pair's defect. The field is
trained on a bounded sample of the pairs themselves, with defects made in it (refusals put together
from parts, copied questions, answers from other languages, cut answers), and is then frozen; a
fitted model can be saved and used again. Of a conversation, each user turn and the assistant turn
that answers it are a pair.

Results for special input: a null or blank answer, a placeholder, a missing assistant turn or a
thought block without words is ``empty``; a null question has no words to copy and no language,
so only ``empty``, ``refusal`` and ``truncated`` can come out; of several defects the first of
empty, refusal, copy, language, truncated is given; repeated rows count once.
"""

from __future__ import annotations

import json
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import language, refusals, terminality
from textmill.llm.crf import LinearChain
from textmill.llm.ppm import WORD

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Bound of the sample that the field and the terminality model are fitted on.
SAMPLE_PAIRS = 8000
TRAIN_PAIRS = 1200
#: Clauses of an answer that the field is trained on at most; longer ones are tagged in full all the same.
MOST_TRAINED = 24

#: What may stand before a copied question.
LEAD_INS = ("The text reads: ", "Here it is: ", "Quote: ", "原文：", "原话如下：", "Текст: ", "Вот текст: ")
_PLACEHOLDER = re.compile(r"^[\W_]*(?:null|none|n/?a|nil|nan|tbd|todo|empty|undefined|no answer|нет|пусто|无|空|暂无)?[\W_]*$", re.I)
_CLAUSE = re.compile(r"[^.!?。！？…\n]+[.!?。！？…\n]*")
_THOUGHT = re.compile(r"^\s*<\|channel>\s*thought\s*\n?")
_HAN = re.compile(r"[一-鿿]")


def answer_body(text: str | None, chat: bool) -> tuple[str, bool]:
    """Reasoning of an answer, and whether its frame breaks off before its end."""
    text = text or ""
    if not chat:
        return text, False
    opened = _THOUGHT.match(text)
    if not opened:
        return text, False
    body, closed, rest = text[opened.end() :].partition("<channel|>")
    rest = rest.partition("<turn|>")[0].strip()
    parsed = None
    try:
        parsed = json.loads(rest) if rest else None
    except ValueError:
        pass
    if not body.strip() and isinstance(parsed, dict):
        body = str(parsed.get("rationale") or "")
    return body, not closed or parsed is None


def _grams(tokens: list[str], k: int) -> set:
    return set(zip(*[tokens[i:] for i in range(k)])) if len(tokens) >= k else set()


class Featurizer:
    """Clauses of a pair and their features."""

    NAMES = 16

    def __init__(self, scorer, terminal, cues):
        self.scorer, self.terminal, self.cues = scorer, terminal, cues

    def question(self, text: str | None):
        tokens = WORD.findall((text or "").lower())
        by = self.scorer.best(tokens)[2] if len(tokens) >= 3 else None
        return f" {' '.join(tokens)} ", _grams(tokens, 3), _grams(tokens, 6), by

    def clauses(self, question, answer: str, broken: bool):
        """``rows of features, words per clause``; empty if the answer has no words."""
        joined, three, six, q_bits = question
        parts = [(m[0], WORD.findall(m[0].lower())) for m in _CLAUSE.finditer(answer)]
        parts = [p for p in parts if p[1]]
        if not parts:
            return [], []
        q_lang = min(q_bits, key=q_bits.get) if q_bits else None
        cut = terminality.judge(self.terminal, answer)[0]
        rows, sizes = [], []
        for i, (text, tokens) in enumerate(parts):
            n = len(tokens)
            han = bool(_HAN.search(text))
            k, grams = (6, six) if han else (3, three)
            hits = [False] * n
            if grams and n >= k:
                for at, gram in enumerate(zip(*[tokens[j:] for j in range(k)])):
                    if gram in grams:
                        hits[at : at + k] = [True] * k
            elif n < k and f" {' '.join(tokens)} " in joined:  # too short for a gram: copied if it stands there as a whole
                hits = [True] * n
            cover = sum(hits) / n
            lead = 0.0
            if q_lang:
                lang, _, bits = self.scorer.best(tokens)
                lead = bits[q_lang] - bits[lang]
            last = i == len(parts) - 1
            cue = self.cues.score(tokens)
            rows.append([
                1.0, cue > 0, cue > 1, cue > 2.5, cue < -1, cover >= 0.85, cover >= 0.5, cover < 0.2, lead > 15, lead > 60 or lead > 8 * n, lead <= 4,
                last, last and cut, last and broken, n < 4, i == 0,
            ])
            sizes.append(n)
        return rows, sizes


def _pad(sequences: list[list]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, sequences))
    x = np.zeros((len(sequences), length, Featurizer.NAMES))
    mask = np.zeros((len(sequences), length), bool)
    for i, rows in enumerate(sequences):
        x[i, : len(rows)] = rows
        mask[i, : len(rows)] = True
    return x, mask


def train(pairs: list[tuple[str, str]], featurizer: Featurizer, seed: int = 3) -> LinearChain:
    """Field fitted on clean pairs and on defects made from them."""
    rng = random.Random(seed)
    field = LinearChain(len(TAGS), Featurizer.NAMES)
    by_lang: dict[str, list[str]] = {}
    known = []
    for q, a in pairs:
        question = featurizer.question(q)
        if not question[3] or len(WORD.findall(a)) < 3:
            continue
        lang = min(question[3], key=question[3].get)
        if min(b := featurizer.scorer.best(WORD.findall(a.lower()))[2], key=b.get) == lang:
            known.append((q, a, question, lang))
            by_lang.setdefault(lang, []).append(a)
    rows, labels = [], []

    def add(question, answer, tag, last=None):
        feats, _ = featurizer.clauses(question, answer, False)
        if 0 < len(feats) <= MOST_TRAINED:
            rows.append(feats)
            labels.append([tag] * (len(feats) - 1) + [tag if last is None else last])

    for q, a, question, lang in known:
        feats, sizes = featurizer.clauses(question, a, False)
        if any(f[2] for f in feats) or sum(n for f, n in zip(feats, sizes) if f[6]) > 0.5 * sum(sizes):
            continue  # a defect of the sample itself, not a sound answer
        add(question, a, ANSWER)
        kinds = rng.sample(range(4), 2)
        if 0 in kinds:
            # a refusal is one in whatever language it is given
            add(question, refusals.made(lang if rng.random() < 0.6 else rng.choice(list(refusals.PARTS)), rng), REFUSAL)
        if 1 in kinds:
            add(question, q, ECHO)
            add(question, rng.choice(LEAD_INS) + q, ECHO)
        others = [x for x in by_lang if x != lang]
        if 2 in kinds and others:
            add(question, rng.choice(by_lang[rng.choice(others)]), FOREIGN)
        if 3 in kinds and len(a) > 12:
            part = a[: rng.randrange(6, len(a) - 1)]
            if terminality.judge(featurizer.terminal, part)[0]:
                add(question, part, ANSWER, UNFINISHED)
    # the chat frame's broken end has no other trace in the sample
    for q, a, question, _ in known[:100]:
        feats, _ = featurizer.clauses(question, a, True)
        if 0 < len(feats) <= MOST_TRAINED:
            rows.append(feats), labels.append([ANSWER] * (len(feats) - 1) + [UNFINISHED])
    for lang in refusals.PARTS:
        for _ in range(20):
            add(("", set(), set(), None), refusals.made(lang, rng), REFUSAL)
    x, mask = _pad(rows)
    y = np.zeros(mask.shape, int)
    for i, tags in enumerate(labels):
        y[i, : len(tags)] = tags
    field.fit(x, mask, y)
    return field


def defect(tags: list[int], sizes: list[int], answer: str) -> str | None:
    """Defect of a pair from the share of its answer's words under each tag."""
    whole = sum(sizes)
    if not whole or _PLACEHOLDER.match(answer):
        return "empty"
    share = [sum(n for t, n in zip(tags, sizes) if t == k) / whole for k in range(len(TAGS))]
    if share[REFUSAL] >= 0.3:
        return "refusal"
    if share[ECHO] >= 0.6:
        return "copy"
    if share[FOREIGN] >= 0.5:
        return "language"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_name, id, turn, question, answer``: every user turn of a conversation with the last assistant turn before the next user turn.

    A conversation without a user turn is one pair of its ``text`` and its last assistant turn; ``turn`` counts from 0.
    """
    train_rows = spark.read.parquet(f"{sf_dir}/train.parquet").select(F.lit("train").alias("table_name"), "id", F.lit(0).alias("turn"), F.col("text").alias("question"), F.col("cot").alias("answer"))
    chats = spark.read.parquet(f"{sf_dir}/conversation_rows.parquet").select("id", "text", F.coalesce("conversations", F.array()).alias("c"))
    users = chats.withColumn("u", F.expr("filter(transform(c, (x, i) -> if(x.role = 'user', i, null)), i -> i IS NOT NULL)"))
    users = users.withColumn("u", F.when(F.size("u") > 0, F.col("u")).otherwise(F.array(F.lit(-1))))
    asked = users.select("id", "text", "c", F.posexplode("u").alias("turn", "at"), F.expr("array_append(u, size(c))").alias("u"))
    answered = asked.withColumn("a", F.expr("try_element_at(filter(slice(c, at + 2, greatest(u[turn + 1] - at - 1, 0)), x -> x.role = 'assistant'), -1).content"))
    question = F.coalesce(F.regexp_replace(F.expr("try_element_at(c, at + 1).content").alias("q"), r"^\s*Review:\s*", ""), F.col("text"))
    chats = answered.select(F.lit("conversation_rows").alias("table_name"), "id", "turn", F.when(F.col("at") >= 0, question).otherwise(F.col("text")).alias("question"), F.col("a").alias("answer"))
    return train_rows.unionByName(chats).where("id IS NOT NULL")


class PairModel:
    """All that is fitted: word counts of the languages, terminality, cues of refusal and the field."""

    def __init__(self, key: int, counts: dict, terminal, cues, field: LinearChain):
        self.key, self.counts, self.terminal, self.cues, self.field = key, counts, terminal, cues, field

    def featurizer(self) -> Featurizer:
        return Featurizer(language.worker_scorer(self.key, self.counts), self.terminal, self.cues)

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            pickle.dump(self, out)

    @staticmethod
    def load(path: str) -> PairModel:
        """A model that ``save`` wrote; only load files of your own."""
        with open(path, "rb") as file:
            return pickle.load(file)


def fit(spark: SparkSession, sf_dir: str) -> PairModel:
    """The models of a folder's tables, from bounded samples spread over them by hash."""
    key, counts = language.fit(spark, sf_dir).value
    filled = pairs_of(spark, sf_dir).where("question IS NOT NULL AND answer IS NOT NULL")
    every = max(1, filled.count() // SAMPLE_PAIRS)
    rows = filled.where(F.pmod(F.xxhash64("table_name", "id"), F.lit(every)) == 0).select("table_name", "question", "answer").limit(2 * SAMPLE_PAIRS).collect()
    sample = sorted((r["question"], answer_body(r["answer"], r["table_name"] != "train")[0]) for r in rows)
    terminal = terminality.fit([a for _, a in sample])
    random.Random(9).shuffle(sample)
    cues = refusals.fit([WORD.findall(m.lower()) for pair in sample[: 2 * TRAIN_PAIRS] for text in pair for m in _CLAUSE.findall(text)])
    field = train(sample[:TRAIN_PAIRS], Featurizer(language.worker_scorer(key, counts), terminal, cues))
    return PairModel(key, counts, terminal, cues, field)


def decode(field: LinearChain, seqs: list[list], batch: int = 256) -> list[list[int]]:
    """Tags of each sequence; sequences of like length are padded and decoded together, so a long one costs the others nothing."""
    tags: list[list[int]] = [[] for _ in seqs]
    order = sorted((i for i, rows in enumerate(seqs) if rows), key=lambda i: len(seqs[i]))
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        if len(seqs[part[-1]]) > 64:  # very long ones by themselves
            for i in part:
                tags[i] = field.decode(*_pad([seqs[i]]))[0].tolist()
            continue
        for i, row in zip(part, field.decode(*_pad([seqs[i] for i in part]))):
            tags[i] = row[: len(seqs[i])].tolist()
    return tags


def tag_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """``table_name, id, turn, defect`` (null for a sound pair) and the word share of each tag."""
    fitted = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer, field = fitted.value.featurizer(), fitted.value.field
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, ids, turns, questions, answers = (c.to_pylist() for c in part.columns)
                seqs, sizes, bodies = [], [], []
                for name, q, a in zip(names, questions, answers):
                    body, broken = answer_body(a, name != "train")
                    rows, n = ([], []) if _PLACEHOLDER.match(body) else featurizer.clauses(featurizer.question(q), body, broken)
                    seqs.append(rows), sizes.append(n), bodies.append(body)
                tags = decode(field, seqs)
                found = [defect(t, n, b) for t, n, b in zip(tags, sizes, bodies)]
                shares = [[sum(n for t, n in zip(tg, sz) if t == k) / sum(sz) if sz else 0.0 for tg, sz in zip(tags, sizes)] for k in range(len(TAGS))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(turns, pa.int32()), pa.array(found, pa.string()), *(pa.array(s, pa.float64()) for s in shares)],
                    names=["table_name", "id", "turn", "defect", *TAGS],
                )

    return pairs.mapInArrow(run, "table_name string, id string, turn int, defect string, " + ", ".join(f"{t} double" for t in TAGS))


def p3_found(spark: SparkSession, sf_dir: str, model: PairModel | None = None) -> DataFrame:
    """Defective pairs; give the model of an earlier ``fit`` to use it again."""
    found = tag_pairs(pairs_of(spark, sf_dir), model or fit(spark, sf_dir))
    return found.where("defect IS NOT NULL").select("table_name", "id", "defect").distinct()


def p3_pair_coverage(spark: SparkSession, sf_dir: str, model: PairModel | None = None) -> DataFrame:
    """Share of the answer's words under each tag, and the defect, for every pair."""
    return tag_pairs(pairs_of(spark, sf_dir), model or fit(spark, sf_dir)).distinct()
