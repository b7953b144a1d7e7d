"""Look-alikes, personal data, languages, truncation, pair defects and overlaps on known cases."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.llm import language, lookalikes, overlap, pair_defects, pii, refusals, terminality, truncation
from textmill.llm.crf import LinearChain
from textmill.llm.ppm import LANGUAGES, SEEDS, Model, Scorer, romanize, words

from .conftest import chat_row, doc, raw, train_row


# ---- look-alikes -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Ｆｕｌｌ ｗｉｄｔｈ", "Full width", True), ("café", "café", True), ("so­ft​", "soft", True), ("a b", "a b", True), ("сосо", "coco", True), ("ﬁne", "fine", True),
        ("⼈⾏", "人行", True), ("non‑stop", "non-stop", True), ("мёд", "мëд", True), ("Case", "case", False), ("cafe", "café", False), ("a1", "al", False), ("a b", "a  b", False), ("№1", "No1", False),
    ],
)
def test_forms(spark, a, b, same):
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    forms = {r["id"]: r["form"] for r in lookalikes.normalize_texts(df).collect()}
    assert (forms[1] == forms[2]) is same


def test_russian_text_stays_cyrillic(spark):
    df = spark.createDataFrame([(1, "Хорошо сидит, a сон как дома")], "doc_id long, text string")
    assert lookalikes.normalize_texts(df).head()["form"] == "Хорошо сидит, а сон как дома"


def test_forms_are_stable(spark, sf_dir):
    once = lookalikes.normalize_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    twice = lookalikes.normalize_texts(once.select(F.col("id").alias("doc_id"), F.col("form").alias("text")))
    assert twice.where("raw <> form").count() == 0


def test_found_pairs(spark, tables):
    folder = tables(documents=[doc(1, "cat"), doc(2, "cаt"), doc(3, "cat"), doc(4, "Cat"), doc(4, "Cat"), doc(5, None)])
    assert {tuple(r) for r in lookalikes.p10_found(spark, folder).collect()} == {(1, 2), (2, 3)}


# ---- personal data ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Write to ann.lee@mail.example now.", {"email"}), ("write to ann at mail dot example", {"email"}), ("ann_lee [at] mail.example", {"email"}), ("ann ＠ mail . example", {"email"}),
        ("Call me on (555) 555-0173 after six.", {"phone"}), ("Звоните 8-900-000-63-64 после шести.", {"phone"}), ("有事打 199.0000.8689 找我。", {"phone"}), ("加我微信同号 ０１０－０００92684", {"phone"}),
        ("My SSN 927-87-3591 was asked", {"id_number"}), ("паспорт 0015 № 568530", {"id_number"}), ("证件号码 994194 19790209 4553 都交了", {"id_number"}), ("passport no. X56506041", {"id_number"}),
        ("I live at 247 penhallow ave and nobody rang.", {"address"}), ("мой адрес: ул. Лозовая, д. 12, кв. 145", {"address"}), ("送到了云汀街35弄14号，不是我家", {"address"}),
        ("Support agent Corvin Quenby was no help.", {"person"}), ("С уважением, В. Крутоярцева", {"person"}), ("我叫郗予棠，已经买第三次了。", {"person"}), ("regards, dr. harkin toldrick", {"person"}),
        ("Order no. 4402-673-5592 took a while.", set()), ("Tracking 1Z7953962795 never moved.", set()), ("Paid 59.90 on 2024-02-12.", set()), ("Model QX-7575957 fits size 52.", set()),
        ("The shop handle is @veloraworks2 there.", set()), ("Lot HZ-576081.", set()), ("客服一直没有回复。", set()), ("订单号4402-969-7235等了很久。", set()), ("Заплатила 1 594 руб.", set()), ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for _, _, k in pii.spans(text)} == kinds


def test_redaction_keeps_the_rest():
    text = "Hi <b>there</b>&nbsp;— call me on +1 212 555 01<wbr>15 after six; ann@mail.example."
    assert pii.redact(text) == "Hi <b>there</b>&nbsp;— call me on [PHONE] after six; [EMAIL]."
    assert pii.redact(None) is None and pii.redact("plain  text ") == "plain  text "
    assert pii.spans(pii.redact(text)) == []


@pytest.mark.parametrize(
    "text,found",
    [
        ("Refund to GB82 WEST 1234 5698 7654 32 please.", [("GB82 WEST 1234 5698 7654 32", "bank_account")]), ("Refund to GB82 WEST 1234 5698 7654 33 please.", []),
        ("They kept my card 4539 5787 6362 1486 on file.", [("4539 5787 6362 1486", "card")]), ("They kept my card 4539 5787 6362 1487 on file.", []), ("Order no. 4539578763621486.", []),
        ("order 1234567 - 212-555-0101 call me", [("212-555-0101", "phone")]), ("Call 212-555-0101 - 212-555-0102.", [("212-555-0101", "phone"), ("212-555-0102", "phone")]),
    ],
)
def test_checksums_decide_and_runs_are_read_to_their_end(text, found):
    assert [(text[a:b], k) for a, b, k in pii.spans(text)] == found


#: Frames that the test tables do not hold.
UNSEEN = (
    ("I was helped by Marta Kowalczyk at the desk.", "person"), ("Pedro Alvarez told me it was lost.", "person"), ("Our neighbour Tomas Lindqvist has one too.", "person"), ("The driver, Mark Olsen, left it outside.", "person"),
    ("It was a gift from my friend Janet Brown.", "person"), ("The parcel went to Elena Petrova by mistake.", "person"), ("Водитель Пётр Зимин нахамил по телефону.", "person"), ("Ольга Руднева ответила через час.", "person"),
    ("My sister Ingrid Solberg loved the colour.", "person"), ("Please send it to 12 Harbour Lane, flat 4.", "address"), ("We moved to 880 West Maple Avenue in spring.", "address"), ("Курьер ждал у дома: проспект Мира, д. 5, кв. 17.", "address"),
    ("Wir wohnen in der Lindenallee 14b.", "address"), ("快递送到幸福路128号3单元502室。", "address"), ("Vivo en calle Mayor 23, segundo piso.", "address"), ("It reached me at j.doe+shop@mail.example.org quickly.", "email"),
    ("Напишите мне: ivan собака почта точка рф", "email"), ("My cell is 1-212-555-0142 after work.", "phone"), ("Meine Handynummer ist +49 151 2345678.", "phone"), ("Паспорт 4510 123456 просили дважды.", "id_number"),
)


def test_unseen_frames():
    found = [t for t, kind in UNSEEN if kind in {k for _, _, k in pii.spans(t)}]
    assert len(found) >= 0.85 * len(UNSEEN), {t for t, _ in UNSEEN} - set(found)
    quiet = ("Customer Service told me nothing.", "Для Меня Замок Ни Плохой, Ни Хороший, Сестра Осталась Довольна.", "The Black Friday sale was called off.", "I said Prime Video is fine.", "When Monday Morning came it asked for a charge.")
    assert not any(pii.spans(t) for t in quiet)


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.citizen_18("11010519491231002X") and not pii.citizen_18("110105194912310021")
    assert pii.insurance_11("11223344595") and not pii.insurance_11("11223344596")
    assert pii.tax_12("500100732259") and not pii.tax_12("500100732258")


# ---- language --------------------------------------------------------------------------------


def test_code_length_is_that_of_the_counts():
    model = Model({"ab": 1}, order=1)
    # 'a' after the blank: one of one seen, one distinct: probability 1/2; so are 'b' after 'a' and the blank after 'b'
    assert model.cost("ab") == pytest.approx(3.0)


def test_held_out_sentences(sf_dir, spark):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) > 40")
    counts = language.fit_counts(docs.where("doc_id % 4 <> 0"))
    scorer = Scorer(counts)
    rows = docs.where("doc_id % 4 = 0").select("lang", "text").collect()
    right = sum(scorer.best(words(r["text"]))[0] == r["lang"] for r in rows)
    assert right / len(rows) > 0.97


def test_held_out_mixtures(sf_dir, spark):
    """Models of three quarters of the documents find a sentence of another language in the rest, and none where there is none."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) BETWEEN 40 AND 3000")
    scorer = Scorer(language.fit_counts(docs.where("doc_id % 4 <> 0")))
    rows = sorted((r["lang"], r["text"]) for r in docs.where("doc_id % 4 = 0").select("lang", "text").collect())
    held = lambda text: {s[2] for s in language.segments(scorer, text)}
    alone = [(lang, text) for lang, text in rows if held(text) == {lang}]
    assert len(alone) >= 0.97 * len(rows)
    rng = random.Random(3)
    sentences = {}
    for lang, text in alone:
        sentences.setdefault(lang, []).extend(p for p in text.replace("。", "。\n").replace(". ", ".\n").split("\n") if len(words(p)) >= 4 and p[-1] in ".。")
    tried = found = 0
    for lang, text in alone:
        other = rng.choice([x for x in sentences if x != lang and sentences[x]])
        tried += 1
        found += held(f"{text}. {rng.choice(sentences[other])}") >= {lang, other}
    assert found >= 0.95 * tried
    en = "The handle works well and my sister wants one too. "
    assert all(held(en + t) == {"en", lang} for t, lang in (("Sehr gut.", "de"), ("非常好。", "zh"), ("Ich bin sehr zufrieden.", "de"), ("Очень хорошо.", "ru")))


def test_an_address_spelt_out_is_no_language():
    scorer = Scorer({})
    zh = "这个东西用起来不错但不是我想要的。卖家请回复 Thessaly.TARNHELM at mailbox dot test 谢谢。"
    assert {s[2] for s in language.segments(scorer, zh)} == {"zh"}


def test_a_model_is_keyed_by_its_content():
    a, b = {"en": {"cat": 1, "dog": 2}}, {"en": {"cat": 2, "dog": 1}}
    assert language.content_key(a) != language.content_key(b) and language.content_key(a) == language.content_key({"en": {"dog": 2, "cat": 1}})


def test_seeds_alone_tell_languages_apart():
    scorer = Scorer({})
    for lang in LANGUAGES:
        half = words(SEEDS[lang])
        assert scorer.best(half[::3])[0] == lang
    assert scorer.best([romanize(w) for w in words("для меня кнопка работает отлично после стирки")])[0] == "ru"


def test_issues(spark, tables, sf_dir):
    de = "Wir haben es nach zwei Wochen benutzt, und alle waren sehr zufrieden damit."
    en = "The handle works well and my sister wants one too."
    rows = [
        raw("1", en, "en-US"), raw("2", en, None), raw("3", en, "zh"), raw("4", f"{en} {de}", "English"), raw("5", f"{en} {de}", "n/a"), raw("6", "Кнопка работает отлично после стирки, и сестра тоже хочет.", "RU"),
        raw("7", "", None), raw("8", None, "en"), raw("3", en, "zh"), raw("9", "Knopka rabotaet otlichno posle stirki, i sestra tozhe khochet takuyu.", "en"),
    ]
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    folder = tables(rows, [doc(r["doc_id"], r["text"], r["lang"]) for r in docs])
    got = {tuple(r) for r in language.p5_found(spark, folder).collect()}
    assert got == {("2", "missing", "en"), ("3", "wrong", "en"), ("4", "mixed", "en"), ("4", "mixed", "de"), ("5", "missing", "en"), ("5", "missing", "de"), ("5", "mixed", "en"), ("5", "mixed", "de"), ("9", "wrong", "ru")}


# ---- truncation ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/../sf0.01/raw_records.parquet").where("original_text IS NOT NULL").select("original_text").collect()
    return terminality.fit([r[0] for r in rows])


def test_held_out_cuts(spark, sf_dir, model):
    """Sentences of other rows, whole and cut at random places, are told apart."""
    rng = random.Random(2)
    rows = spark.read.parquet(f"{sf_dir}/raw_records.parquet").where("original_text IS NOT NULL").select("original_text").collect()
    whole = [r[0] for r in rows if r[0].endswith(".") and "\n" not in r[0] and len(r[0]) > 60][:80]
    cut = [t[: rng.randrange(len(t) // 2, len(t) - 12)] for t in whole]
    wrong = sum(terminality.judge(model, t)[0] for t in whole)
    found = sum(terminality.judge(model, t)[0] for t in cut)
    assert wrong <= 2 and found / len(cut) > 0.85


@pytest.mark.parametrize("tail", ["Regards, Dr. Torvin Ashgrove", "Thanks!", "Спасибо!", "Ordered as YZ-732801. 🤷", "…", "", "-"])
def test_odd_ends_are_whole(model, tail):
    text = f"The lid holds up beautifully in the garage, and I would order again. {tail}" if len(tail) > 1 else tail
    assert not terminality.judge(model, text)[0]


def test_alignment():
    full = "The lid holds up well, and I would order it again soon. Nothing more to say about it."
    assert truncation.stops_inside("The lid holds up well, and I would ord", full) is True
    assert truncation.stops_inside("The lid holds up well, and I would", full) is True
    assert truncation.stops_inside("The lid holds up well, and I would order it again soon.", full) is False
    assert truncation.stops_inside("The lid holds up well, and I would order it again soon", "The lid holds up well, and I would order it again soon Thanks!") is None
    assert truncation.stops_inside("The lid holds up well, and I would order it again", "THE LID HOLDS UP WELL, AND I WOULD ORDER IT AGAIN SOON. SO IT IS.") is True
    assert truncation.stops_inside("A scent that nobody liked at all here", full) is None


def test_banding_recall():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    found = 0
    for _ in range(200):
        a = [rng.choice(vocab) for _ in range(80)]
        b = a[:72]  # shares 68 of 76 shingles
        keys = truncation.band_keys([a, b])
        found += bool(set(keys[0]) & set(keys[1]))
    assert found / 200 > 0.97


def test_source_report(spark, tables, sf_dir):
    base = [r for r in spark.read.parquet(f"{sf_dir}/raw_records.parquet").select("id", "original_text").dropDuplicates(["id"]).collect()]
    folder = tables([raw(r["id"], r["original_text"]) for r in base], train=[train_row(base[0]["id"], "x", "A good reason. So it is."), train_row("absent", "x", None)])
    rows = {(r["table_name"], r["source"]): r for r in truncation.p1_source_report(spark, folder).collect()}
    assert rows[("raw_records", "amazon_hf")]["records"] == len(base) and rows[("train", None)]["cut_records"] == 0


def test_every_longer_copy_of_a_bucket_is_met(spark, tables, sf_dir):
    """A longer near-copy with a long lead-in stands in the same buckets; equal word counts and texts that could end there are aligned."""
    base = spark.read.parquet(f"{sf_dir}/raw_records.parquet").where("original_text IS NOT NULL").select("id", "original_text").dropDuplicates(["id"]).collect()
    full = "We took the grey kettle along on every trip this summer and used it daily in the van, my brother said that the battery works great for hours and then dies."
    lead = "UPD after two long weeks of use at home: "
    cases = {"full": full, "lead": lead + full + " So it goes with all of them.", "cut": full[: full.index(" for hours")], "word": full[:-3]}
    folder = tables([raw(r["id"], r["original_text"]) for r in base] + [raw(f"case-{k}", v) for k, v in cases.items()])
    got = {r["id"] for r in truncation.p1_found(spark, folder).collect()}
    assert {f"case-{k}" for k in cases} & got == {"case-cut", "case-word"}


@pytest.mark.parametrize("block", [1500, 3])
def test_buckets_are_met_in_full_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(truncation, "BLOCK", block)
    text = "the lid holds up well and the hinge is still tight after a year of use in the garage so I would order it again soon."
    rows = [("a", str(i), text[: len(text) - i]) for i in range(12)]
    texts = spark.createDataFrame(rows, "table_name string, id string, t string").select(F.col("id").cast("long").alias("cls"), "t")
    judged = texts.select("cls", F.lit(True).alias("open"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("bands"))
    got = {r["cls"]: r["inside"] for r in truncation.aligned(judged, texts).collect()}
    assert got == {i: True for i in range(2, 12)}


def test_records_are_decided_by_alignment(spark, sf_dir):
    """Copies decide some records of the tables, and every pair that shares four fifths of its words is among those met."""
    got = truncation.verdicts(truncation._sources(spark, f"{sf_dir}/../sf0.01")).groupBy("inside").count().collect()
    counts = {r["inside"]: r["count"] for r in got}
    assert counts.get(True, 0) + counts.get(False, 0) > 0 and counts[None] > 0


def test_recall_of_aligned_pairs(spark):
    """Of records cut at 80 to 97 % of a longer copy, a word in twenty of which differs, nine in ten are found by alignment."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts, want = [], set()
    for i in range(120):
        full = [rng.choice(vocab) for _ in range(rng.randrange(50, 120))]
        at = int(len(full) * rng.uniform(0.82, 0.97))
        copy = [w if rng.random() > 0.02 or k >= at - 3 else rng.choice(vocab) for k, w in enumerate(full)]
        texts += [(2 * i, " ".join(full) + "."), (2 * i + 1, " ".join(copy[:at]))]
        want.add(2 * i + 1)
    df = spark.createDataFrame(texts, "cls long, t string")
    keys = truncation.band_keys([truncation.text_words(t) for _, t in texts])
    judged = spark.createDataFrame([(i, True, keys[k].tolist()) for k, (i, _) in enumerate(texts)], "cls long, open boolean, bands array<long>")
    got = {r["cls"] for r in truncation.aligned(judged, df).where("inside").collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


# ---- pair defects ----------------------------------------------------------------------------


def test_field_learns_a_chain():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.zeros((200, 6, 3))
    y = np.zeros((200, 6), int)
    for i in range(200):
        y[i] = np.cumsum(rng.random(6) < 0.3) % 2
        x[i, np.arange(6), y[i]] = rng.random(6) + 0.2
        x[i, :, 2] = 1
    mask = np.ones((200, 6), bool)
    mask[::3, 4:] = False
    field = LinearChain(2, 3)
    field.fit(x[:100], mask[:100], y[:100])
    assert ((field.decode(x[100:], mask[100:]) == y[100:]) | ~mask[100:]).mean() > 0.97


def test_defects(spark, tables, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/../sf0.01/train.parquet").select("id", "text", "cot").where("text IS NOT NULL AND cot IS NOT NULL").dropDuplicates(["id"]).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    review = "The lid looks plain but acceptable next to the sofa, and I would order again. My sister could not tell the difference after the update."
    good = "Signals: the wording 'plain but' points one way. A rating of 3 out of 5 agrees with that reading. So the verdict is neutral."
    zh = "先看到的关键词是“但是”。评分3星与文字一致。语气强烈，室友只是顺带提到。所以结论是中性。"
    cases = {"good": good, "empty": " ", "nil": "N/A", "refusal": "I'm sorry, but I can't help with that request. Is there anything else?", "copy": f"The review says: {review}", "language": zh, "truncated": good[:-25]}
    trains = [train_row(r["id"], r["text"], r["cot"]) for r in base] + [train_row(f"case-{k}", review, v) for k, v in cases.items()]
    frame = lambda body, tail='{"sentiment": 1}': f"<|channel>thought\n{body}<channel|>\n{tail}"
    chats = [chat_row("c-good", review, frame(good)), chat_row("c-open", review, f"<|channel>thought\n{good[:70]}"), chat_row("c-json", review, frame(good, '{"sentiment": 1, "rat')), chat_row("c-none", review, "absent"), chat_row("c-void", review, frame(""))]
    folder = tables(documents=[doc(r["doc_id"], r["text"], r["lang"]) for r in docs], train=trains, conversation_rows=chats)
    got = {r["id"]: r["defect"] for r in pair_defects.p3_found(spark, folder).collect() if r["id"].startswith(("case-", "c-"))}
    assert got == {"case-empty": "empty", "case-nil": "empty", "case-refusal": "refusal", "case-copy": "copy", "case-language": "language", "case-truncated": "truncated", "c-open": "truncated", "c-json": "truncated", "c-none": "empty", "c-void": "empty"}


#: Refusals in wording that the operator's parts do not hold.
HELD_OUT = (
    "I'm not comfortable judging what this customer wrote.", "Sadly this is something that I can't do for you.", "I won't take a position on the feedback above.", "It isn't possible for me to say whether this is good or bad.", "My policy prevents me from scoring such opinions.",
    "I must respectfully decline to weigh in here.", "Providing a sentiment for this is not something I'm able to do.", "I am sorry, this falls outside of what I may answer.", "Apologies, I can't go along with that.", "As an AI, I don't do evaluations like this one.",
    "很抱歉，这类内容我没法给出看法。", "对此我不能发表任何意见。", "不好意思，我无法对用户的话下结论。", "根据规定，我不可以评论这些文字。", "我没有办法继续这个任务。",
    "Прошу прощения, но тут я помочь не смогу.", "Я не стану судить о чужом мнении.", "Увы, такой вопрос я обсуждать не могу.", "Мои правила запрещают оценивать подобное.", "Как ИИ я не могу давать таких оценок.",
)
ECHOED = ("Quoting the customer: {}", "{}", "Original: {}", "顾客说：{}", "Вот что написано: {}")


@pytest.fixture(scope="module")
def pair_model(spark, sf_dir):
    return pair_defects.fit(spark, f"{sf_dir}/../sf0.01")


def test_held_out_refusals_and_echoes(pair_model):
    featurizer = pair_model.featurizer()
    known = " ".join(" ".join(p) for parts in refusals.PARTS.values() for p in parts).lower()
    assert not any(t.lower() in known for t in HELD_OUT)
    review = "The lid looks plain but acceptable next to the sofa, and I would order again. My sister could not tell the difference after the update."

    def verdict(answer):
        rows, sizes = featurizer.clauses(featurizer.question(review), answer, False)
        return pair_defects.defect(pair_defects.decode(pair_model.field, [rows])[0], sizes, answer)

    found = [t for t in HELD_OUT if verdict(t) == "refusal"]
    assert len(found) >= 0.9 * len(HELD_OUT), set(HELD_OUT) - set(found)
    assert all(verdict(e.format(review)) == "copy" for e in ECHOED)
    for sound in ("The phrase 'I cannot recommend it' is harsh, so the verdict is negative.", "He says sorry for the late post; the tone is mild and positive overall."):
        assert verdict(sound) is None


def test_field_meets_every_clause(pair_model):
    featurizer = pair_model.featurizer()
    review = "The lid looks plain but acceptable next to the sofa, and I would order again."
    long = "The wording points one way and the rating agrees with it. " * 300
    rows, sizes = featurizer.clauses(featurizer.question(review), long + refusals.made("en", random.Random(1)), False)
    assert len(rows) >= 301 and sum(sizes) > 3000
    alone = [pair_defects.decode(pair_model.field, [rows[:k]])[0] for k in (1, 40, 301)]
    assert pair_defects.decode(pair_model.field, [rows[:1], rows[:40], rows[:301], []]) == [*alone, []]


def test_model_is_saved_and_used_again(spark, sf_dir, pair_model, tmp_path):
    pair_model.save(str(tmp_path / "pairs.model"))
    again = pair_defects.PairModel.load(str(tmp_path / "pairs.model"))
    first, second = (set(map(tuple, pair_defects.p3_found(spark, sf_dir, m).collect())) for m in (pair_model, again))
    assert first == second and first


def test_every_turn_of_a_conversation_is_a_pair(spark, tables):
    turns = lambda *xs: [(r, c) for r, c in xs]
    chats = [
        ("m", turns(("system", "s"), ("user", "Review: one"), ("assistant", "a"), ("assistant", "b"), ("user", "two"), ("user", "three"), ("assistant", None)), "t", 1, None, None, "x"),
        ("n", turns(("assistant", "only")), "t", 1, None, None, "x"), ("o", None, "t", 1, None, None, "x"),
    ]
    got = {(r["id"], r["turn"], r["question"], r["answer"]) for r in pair_defects.pairs_of(spark, tables(conversation_rows=chats)).collect()}
    assert got == {("m", 0, "one", "b"), ("m", 1, "two", None), ("m", 2, "three", None), ("n", 0, "t", "only"), ("o", 0, "t", None)}


# ---- overlap ---------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_close_is_the_edit_distance(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = [rng.choice("abcde") for _ in range(rng.randrange(1, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.choice("abcde")] * rng.randrange(3)
        assert overlap.close(a, b) is (distance(a, b) <= int(overlap.CHANGED * max(len(a), len(b))))


def test_overlap_recall_against_brute_force(spark, tables):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(300)]
    rows, want = [], set()
    for i in range(150):
        a = [rng.choice(vocab) for _ in range(rng.randrange(50, 120))]
        rows.append((f"t{i}", "train", " ".join(a)))
        share = rng.choice([0.0, 0.08, 0.15, 0.5])
        b = [x if rng.random() > share else rng.choice(vocab) for x in a]
        rows.append((f"e{i}", rng.choice(["dev", "TEST "]), " ".join(b).upper()))
        if distance(a, b) <= 0.2 * len(a):
            want.add((f"e{i}", f"t{i}"))
    # a third of all rows is one text, in training and evaluation
    rows += [(f"h{i:03}", "train" if i % 2 else "val", "one text that stands very often in all of the splits") for i in range(40)]
    want |= {tuple(sorted((f"h{i:03}", f"h{j:03}"))) for i in range(0, 40, 2) for j in range(1, 40, 2)}
    rows += [("n1", None, rows[0][2]), ("n2", "??", rows[0][2]), ("n3", "val", None)]
    folder = tables(soft_labels_reviewed=[(*r, None, 1, 0.9, "m", 1, True) for r in rows])
    got = {tuple(r) for r in overlap.p7_found(spark, folder).collect()}
    assert len(got & want) / len(want) >= 0.98 and len(got - want) <= 2
    report = overlap.p7_report(spark, folder).agg(F.sum("records").alias("r"), F.sum("pairs").alias("p")).head()
    assert report["r"] == 170 and abs(report["p"] - len(want)) <= 3


@pytest.mark.parametrize("block", [1500, 20])
def test_crowds_of_near_copies_are_compared_in_full(spark, tables, monkeypatch, block):
    """Far more variants of one text than a digest may have holders, beside texts that share only a long opening."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(13)
    vocab = [f"word{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(80), 3):
            text[at] = rng.choice(vocab)
        rows.append((f"v{i:03}", "train" if i % 3 else "val", " ".join(text)))
    for i in range(80):
        rows.append((f"o{i:03}", "train" if i % 2 else "test", " ".join(base[:40] + [rng.choice(vocab) for _ in range(40)])))
    folder = tables(soft_labels_reviewed=[(*r, None, 1, 0.9, "m", 1, True) for r in rows])
    got = {tuple(r) for r in overlap.p7_found(spark, folder).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a in rows[:150] for b in rows[:150] if a[1] == "train" and b[1] == "val"}
    assert len(want & got) >= 0.99 * len(want) and not any(x.startswith("o") for pair in got for x in pair)


@pytest.mark.parametrize("block", [30_000, 40])
def test_every_close_pair_is_met(spark, tables, monkeypatch, block):
    """Crowds about the limit of edits whose chunks nearly all have many holders, of a few words to some thousand; nothing is lost."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(17)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for size, count, least, most in ((30, 330, 2, 4), (5, 60, 0, 1), (1, 6, 0, 1), (130, 60, 8, 18), (1500, 12, 100, 220)):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(count):
            text = list(base)
            for _ in range(rng.randint(least, most)):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([1, 1, 1, 0, 2])] = [rng.choice(vocab)] * rng.choice([1, 1, 1, 2])
            rows.append((f"c{len(rows):04}", rng.choice(["train", "train", "train", "val"]), " ".join(text)))
    folder = tables(soft_labels_reviewed=[(*r, None, 1, 0.9, "m", 1, True) for r in rows])
    parts = [(i, split == "train", text.split()) for i, split, text in rows]
    want = {tuple(sorted((i, j))) for i, t, a in parts if t for j, u, b in parts if not u and overlap.close(a, b)}
    got = {tuple(r) for r in overlap.p7_found(spark, folder).collect()}
    assert got == want and len(want) > 5000


@pytest.mark.parametrize("count,size,edits", [(400, 20, 1), (150, 80, 8), (400, 50, 5)])
def test_crowds_of_short_texts_and_of_spread_edits_lose_no_pair(spark, tables, count, size, edits):
    rng = random.Random(13)
    vocab = [f"word{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(size)]
    rows = []
    for i in range(count):
        text = list(base)
        for at in rng.sample(range(size), edits):
            text[at] = rng.choice(vocab)
        rows.append((f"v{i:03}", "val" if i % 10 == 0 else "train", " ".join(text)))
    folder = tables(soft_labels_reviewed=[(*r, None, 1, 0.9, "m", 1, True) for r in rows])
    got = {tuple(r) for r in overlap.p7_found(spark, folder).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[1] == "train" and b[1] == "val"}
    assert len(want & got) >= 0.99 * len(want)
