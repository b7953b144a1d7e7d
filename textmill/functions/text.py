"""Cleaning and tokenizing as column expressions; Arrow only where the JVM has no such function."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.bind import bind
from textmill.schemas import CLASSIFIER_STOPWORDS_ZH, STOPWORDS

#: The patterns decide what is removed.
URL = r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"
EMAIL = r"\S+@\S+\.\S+"
TAG = r"<[^>]+>"


#: White space as the data's producers see it, for classes of Java patterns in Unicode mode.
WHITE = r"\s\x1c-\x1f"


def strip(text: Column) -> Column:
    """White space of any kind cut from both ends; a run inside the text is looked at once."""
    return F.regexp_replace(text, rf"(?U)^[{WHITE}]++|(?<![{WHITE}])[{WHITE}]++\z", "")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    """All entities of HTML 5 in one pass; only rows that hold ``&`` take part in it."""
    return F.when(text.contains("&"), _unescape(F.when(text.contains("&"), text))).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Links, e-mail addresses and tags become a blank; runs of white space one blank; ends trimmed."""

    def where(sign: str, pattern: str, value: Column) -> Column:
        """The pattern runs only over texts that hold the sign every match needs."""
        return bind(value, lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, " ")).otherwise(t))

    out = where("://", f"(?iU){URL}", text)
    out = where("@", f"(?U){EMAIL}", out)
    out = where("<", TAG, out)
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_for_llm(text: Column) -> Column:
    """Entities first, so that an escaped tag is removed as a tag; null gives an empty text."""
    return strip_markup(html_unescape(F.coalesce(text, F.lit(""))))


def tokens_english(text: Column) -> Column:
    """Lower-case runs of a-z that stand as whole words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]+$"))


def tokens_chinese(text: Column) -> Column:
    """Single ideographs, as without a segmenter."""
    return F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1))


def tokens_russian(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(r"^[Ѐ-ӿ]+$"))


def tokens_blank(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: F.length(x) > 0)


def tokens_by_language(text: Column, language: Column) -> Column:
    return (
        F.when(language == "zh", tokens_chinese(text)).when(language == "en", tokens_english(text))
        .when(language == "ru", tokens_russian(text)).otherwise(tokens_blank(text))
    )


def stopwords(language: Column) -> Column:
    lists = {k: F.array(*map(F.lit, dict.fromkeys(v))) for k, v in STOPWORDS.items()}
    return F.when(language == "zh", lists["zh"]).when(language == "en", lists["en"]).when(language == "ru", lists["ru"]).otherwise(F.array().cast("array<string>"))


def clean_tokens(text: Column, language: Column, least: int = 2, remove_stopwords: bool = True) -> Column:
    """Tokens of ``least`` signs and more, without the language's stopwords."""
    found = F.filter(tokens_by_language(text, language), lambda x: F.length(x) >= least)
    return bind(stopwords(language), lambda stop: _without(found, stop)) if remove_stopwords else found


def _without(found: Column, stop: Column) -> Column:
    return F.filter(found, lambda x: ~F.array_contains(stop, x))


def clean_for_nlp(text: Column, language: Column, remove_stopwords: bool = True) -> Column:
    return F.array_join(clean_tokens(clean_for_llm(text), language, 2, remove_stopwords), " ")


def tokens_topic(text: Column, least: int = 3) -> Column:
    """Tokens for topic models: letters only (other signs vanish and join words), stopwords and short words out."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)[^a-z{WHITE}]", "")
    words = F.filter(F.split(flat, rf"(?U)[{WHITE}]+"), lambda x: F.length(x) >= least)
    return _without(words, F.array(*map(F.lit, dict.fromkeys(STOPWORDS["en"]))))


def processed(text: Column, language: Column) -> Column:
    """``struct(text_for_llm, text_for_nlp, word_count, char_count)``, each part computed once."""

    def of_clean(clean: Column) -> Column:
        of_tokens = lambda t: F.struct(F.array_join(t, " ").alias("nlp"), F.size(t).alias("n"))
        of_parts = lambda x: F.struct(clean.alias("text_for_llm"), x["nlp"].alias("text_for_nlp"), x["n"].alias("word_count"), F.length(clean).alias("char_count"))
        return bind(bind(clean_tokens(clean, language), of_tokens), of_parts)

    return bind(clean_for_llm(text), of_clean)


def tokens_classifier(text: Column, language: Column) -> Column:
    """Tokens for linear models: English without stopwords and short words, Chinese signs, other languages lower-cased words."""
    english = bind(stopwords(F.lit("en")), lambda stop: F.filter(tokens_english(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))
    return F.when(language == "en", english).when(language == "zh", tokens_chinese(text)).otherwise(tokens_blank(text))


def library_tokens(text: Column, language: str, stem: bool = False, lemma: bool = True) -> Column:
    """Tokens by the language's usual library where a worker has it, else by the fall-backs above.

    The library is loaded once per worker. English words can be stemmed, Russian ones reduced to
    their lemma; Chinese words of one sign are left out, as the segmenter's callers do.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = _library(language, stem, lemma)
        for batch in batches:
            yield batch.map(lambda t: cut(t) if t else [])

    return run(text)


def _library(language: str, stem: bool, lemma: bool):
    """A function from text to tokens; modules that are not installed are replaced by patterns."""
    if language == "zh":
        try:
            import jieba
        except ImportError:
            return re.compile("[一-鿿]").findall
        return lambda t: [w.strip() for w in jieba.cut(t) if len(w.strip()) > 1]
    if language == "en":
        try:
            from nltk.stem import PorterStemmer
            from nltk.tokenize import word_tokenize
        except ImportError:
            word = re.compile(r"(?<!\w)[a-z]+(?!\w)")
            return lambda t: word.findall(t.lower())
        reduce_word = PorterStemmer().stem if stem else str
        return lambda t: [reduce_word(w) for w in word_tokenize(t.lower()) if w.isalpha()]
    if language == "ru":
        whole = re.compile("[Ѐ-ӿ]+")
        try:
            import natasha
        except ImportError:
            return lambda t: [w for w in re.findall(r"\w+", t.lower()) if whole.fullmatch(w)]
        segmenter, vocab, tagger = natasha.Segmenter(), natasha.MorphVocab(), natasha.NewsMorphTagger(natasha.NewsEmbedding())

        def russian(t: str) -> list[str]:
            doc = natasha.Doc(t)
            doc.segment(segmenter)
            if lemma:
                doc.tag_morph(tagger)
            out = []
            for token in doc.tokens:
                if whole.fullmatch(token.text):
                    if lemma:
                        token.lemmatize(vocab)
                    out.append(token.lemma if lemma and token.lemma else token.text.lower())
            return out

        return russian
    return lambda t: t.lower().split()


def classifier_text(text: Column, language: Column) -> Column:
    """Text for linear classifiers: English words and Chinese signs without stopwords, joined by blanks; any other language as it is, in lower case.

    Null gives an empty text. Words keep their form, as no lemmatizer is at hand in the JVM.
    """

    def of_flat(flat: Column) -> Column:
        english = bind(stopwords(F.lit("en")), lambda stop: F.filter(tokens_english(flat), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))
        chinese = _without(tokens_chinese(flat), F.array(*map(F.lit, CLASSIFIER_STOPWORDS_ZH)))
        return F.when(language == "en", F.array_join(english, " ")).when(language == "zh", F.array_join(chinese, " ")).otherwise(flat)

    return bind(strip(F.lower(F.coalesce(text, F.lit("")))), of_flat)


def topic_list(text: Column, language: Column) -> Column:
    """Words for topic models: English as for classifiers; of Chinese words of two signs and more, so none without a segmenter; other languages split at white space."""

    def of_flat(flat: Column) -> Column:
        words = F.filter(F.split(flat, rf"(?U)[{WHITE}]+"), lambda w: F.length(w) > 0)
        english = bind(stopwords(F.lit("en")), lambda stop: F.filter(tokens_english(flat), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))
        return F.when(language == "en", english).when(language == "zh", F.array().cast("array<string>")).otherwise(words)

    return bind(strip(F.lower(F.coalesce(text, F.lit("")))), of_flat)


def word_count(tokens_text: Column) -> Column:
    return F.when(F.length(tokens_text) == 0, 0).otherwise(F.size(F.split(tokens_text, " ")))


def last_position(text: Column, needle: str) -> Column:
    """Place (from 0) of the last occurrence of ``needle``, -1 if there is none."""
    at = F.length(text) - F.length(F.substring_index(text, needle, -1)) - len(needle)
    return F.when(text.contains(needle), at).otherwise(F.lit(-1))


def after_first(text: Column, marker: str) -> Column:
    """What follows the first ``marker``; null if there is none."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))


def before_first(text: Column, marker: str) -> Column:
    return F.when(text.contains(marker), F.substring_index(text, marker, 1))


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value)
