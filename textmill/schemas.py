"""Explicit schemas and fixed values of the record model."""

from __future__ import annotations

from pyspark.sql import types as T

_raw = [
    T.StructField("id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("sentiment_label", T.IntegerType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
]
RAW_RECORD = T.StructType(_raw)
PROCESSED_RECORD = T.StructType(
    _raw
    + [
        T.StructField("text_for_nlp", T.StringType()),
        T.StructField("text_for_llm", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("length_category", T.StringType()),
        T.StructField("soft_label", T.ArrayType(T.DoubleType())),
        T.StructField("rationale", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("preprocessor_version", T.StringType()),
    ]
)
TRAINING_ROW = (
    "id string, text string, label int, hard_label int, soft_labels array<double>, cot string, rating int, confidence double, category string"
)
CONVERSATION_ROW = (
    "conversations array<struct<role:string,content:string>>, text string, label int, soft_labels array<double>, category string"
)
ANNOTATION_ROW = (
    "id string, split string, text string, probabilities array<double>, hard_label int, confidence double, model string"
)
INSTRUCTION_ROW = ("instruction string, input string, output string, soft_labels array<double>, confidence double")
PREDICTION_ROW = ("id string, predicted_label int, ground_truth_label int")

# ---- fixed values: they must equal those of the data's producers -----------------------------

LANGUAGES = ("zh", "en", "ru")
SOURCES = ("amazon_hf", "yelp_hf", "amazon_mcauley", "ozon_local", "mock_data")
DEFAULT_SOFT = (0.33, 0.33, 0.34)
CLASS_NAMES = ("Negative", "Neutral", "Positive")
LABEL_NAMES = {
    "zh": ("负面", "中性", "正面"),
    "en": ("negative", "neutral", "positive"),
    "ru": ("негативный", "нейтральный", "позитивный"),
}
THOUGHT_OPEN, THOUGHT_CLOSE, TURN_END = "<|channel>thought", "<channel|>", "<turn|>"

STOPWORDS_ZH = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "那", "这个", "那个", "这些", "那些", "之", "与", "及", "等", "可以", "就是", "但是", "如果", "因为", "所以", "然而", "商品", "产品", "卖家", "买家", "快递", "物流", "包装", "已经", "非常",
    "真的", "感觉", "觉得", "东西",
)
STOPWORDS_EN = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me",
    "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "what", "which", "who", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just",
    "product", "item", "seller", "shipping", "package", "order",
)
STOPWORDS_RU = (
    "и", "в", "не", "на", "я", "быть", "он", "с", "что", "а", "по", "это", "она", "к", "но", "мы", "как", "из", "у", "то", "за", "свой", "ее", "так",
    "который", "весь", "год", "от", "такой", "для", "ты", "же", "все", "тот", "мочь", "вы", "человек", "его", "сказать", "этот", "продукт", "товар",
    "продавец", "доставка", "упаковка", "заказ", "магазин", "покупка",
)
#: Chinese words that the linear classifiers leave out.
CLASSIFIER_STOPWORDS_ZH = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
)
STOPWORDS = {"zh": STOPWORDS_ZH, "en": STOPWORDS_EN, "ru": STOPWORDS_RU}

SEEDS_NEGATIVE = (
    "bad", "terrible", "awful", "worst", "horrible", "hate", "disappointed", "poor", "waste", "useless", "broken", "defective", "return", "refund",
    "problem", "issue", "fail", "error", "cheap", "flimsy", "junk",
)
SEEDS_NEUTRAL = (
    "okay", "average", "fine", "acceptable", "standard", "normal", "decent", "moderate", "regular", "usual", "typical", "common", "neither", "nor",
    "however", "but", "although", "while",
)
SEEDS_POSITIVE = (
    "good", "great", "excellent", "amazing", "love", "perfect", "best", "awesome", "fantastic", "wonderful", "happy", "satisfied", "recommend",
    "quality", "nice", "beautiful", "comfortable", "easy", "fast", "quick",
)
