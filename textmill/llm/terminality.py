"""How likely a text's closing words end a sentence.

A logistic model over the closing words (one to six, and together with the words that open the
sentence) is fitted on a bounded sample of the corpus itself: sentences closed by an end mark are
complete, the same sentences cut at random places are not. The fitted model is frozen and scores
the last sentence of every text, whatever sign stands at its end.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

#: Bound of the fitting sample: texts, and sentences taken from them.
SAMPLE_TEXTS = 9000
SAMPLE_SENTENCES = 36_000
BITS = 18
#: Log-odds under which a tail counts as cut: after an end mark, after dots, and with neither.
END_LIMIT, DOTS_LIMIT, OPEN_LIMIT = -4.5, -2.5, -1.5

TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:[-'’][^\W_一-鿿]+)*|[,:;，：；、]")
_SPLIT = re.compile(r"(?<=[.!?。！？…])(?:\s+|(?<=[。！？]))|\s\|\s|[\"”»]\s*[,}]|;\s+(?=[^\W\d_]{2,16}\s?[-–—:：]\s)")
#: a field's name before its value; the value is what may be cut
_FIELD = re.compile(r"\s*[^\W\d_]{2,16}\s?[-–—:：]\s+(?=\S+\s+\S+\s+\S)")
#: Notes that a page puts where it cut a text.
_MORE = re.compile(r"[\s.…]*[\[(<]?\s*(?:read more|see more|show more|more|truncated|cut|continued?|ещё|еще|далее|читать далее|подробнее|обрезано|展开|全文|更多|查看更多|阅读全文|未完|截断)\s*[.…]*[\])>]\s*$|[\s.…]+(?:read more|see more|show more|читать далее|查看更多|阅读全文|展开全文)\s*[.…»>]*\s*$|(?:\.\.\.|…)\s*[\[(](?:\.\.\.|…)[\])]\s*$|\s\(more\s*$|\[(?:\.\.\.|…)\]\s*$", re.I)
_TAG = re.compile(r"<[^<>]{0,200}>")
#: signs that may follow a finished sentence: quotes, brackets, stars, pictographs and blanks
_CLOSER = re.compile(r"[\s\"'”’»«“„\]\[)(}{*~_#>|🀀-🫿☀-➿️‍–—]")
_ENDS = ".!?。！？…"
_ANY_END = re.compile(r"[.!?。！？…]")
#: Words of a text without end marks that may still be one sentence.
UNMARKED = 14
_BROKEN = re.compile(r"(?:�+|<[a-zA-Z/][^<>]{0,60}|&[a-zA-Z#]\w{0,6})$")


def _norm(token: str) -> str:
    if any(map(str.isdigit, token)):
        return "".join("0" if c.isdigit() else "a" for c in token if c.isalnum())
    return token.casefold()


def tokens(sentence: str) -> list[str]:
    return [_norm(x) for x in TOKEN.findall(sentence)]


def flatten(text: str) -> str:
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "http" in text:
        text = _URL.sub("", text)
    return text


#: Words that stand for no text; they are not the rest of one.
PLACEHOLDERS = frozenset(("n/a", "na", "null", "none", "nil", "nan", "tbd", "todo", "empty", "undefined", "нет", "пусто", "无", "空", "暂无"))
_URL = re.compile(r"https?://[!-~]+")
#: Words before a signature, which ends a text without an end mark.
_SIGNED = re.compile(r"(?:(?:regards|sincerely|yours|cheers|best|thanks|с уважением|ваша?|saludos|grüße|grüßen|з повагою)\s*,\s*|(?:——|—|--)\s*)(?:(?:mrs?|ms|dr|prof)\b\.?\s*)?[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){0,3}\s*$", re.I)


def _without_closers(text: str) -> str:
    """Walks back from the end, so a long run of blanks inside a text costs nothing."""
    at = len(text)
    while at and _CLOSER.match(text, at - 1):
        at -= 1
    return text[:at]


class Tail:
    """Last sentence of a text and the signs after it."""

    __slots__ = ("sentence", "mark", "broken", "more", "dash", "signed")

    def __init__(self, text: str):
        flat = flatten(text)
        flat = flat.rstrip()
        note = _MORE.search(flat, max(0, len(flat) - 40))
        self.more = note is not None
        if note:
            flat = flat[: note.start()]
        torn = _BROKEN.search(flat, max(0, len(flat) - 80))
        self.broken = torn is not None
        if torn:
            flat = flat[: torn.start()]
        body = _without_closers(flat)
        self.signed = bool(_SIGNED.search(body[-90:]))
        self.dash = body.endswith("-")
        body = body.rstrip("-")
        bare = body.rstrip(_ENDS)
        self.mark = body[len(bare) :]
        body = bare.rstrip()
        # the last sentence lies within the last signs unless no sentence ends there
        parts = [x for x in _SPLIT.split(body[-500:]) if x and x.strip()]
        if len(parts) < 2 and len(body) > 500:
            parts = [x for x in _SPLIT.split(body) if x and x.strip()]
        last = parts[-1] if parts else ""
        field = _FIELD.match(last)
        self.sentence = last[field.end() :] if field else last


class Terminality:
    """Frozen logistic model; ``weights`` has ``2**BITS`` entries whatever the corpus."""

    def __init__(self, known: frozenset, prefixes: frozenset, weights: np.ndarray, bias: float):
        self.known, self.prefixes, self.weights, self.bias = known, prefixes, weights, bias

    def features(self, words: list[str]) -> list[int]:
        last = words[-1]
        known = last in self.known
        piece = not known and last in self.prefixes
        w = [x if x in self.known else "<frag>" if i == len(words) - 1 and piece else "<new>" for i, x in enumerate(words[-6:], len(words) - len(words[-6:]))]
        a = words[0] if words[0] in self.known else "<new>"
        b = (words[1] if words[1] in self.known else "<new>") if len(words) > 1 else "<none>"
        commas = sum(x in ",，、" for x in words)
        two = " ".join(w[-2:])
        keys = [f"1 {w[-1]}", f"2 {two}", f"3 {' '.join(w[-3:])}", f"4 {' '.join(w[-4:])}", f"5 {' '.join(w[-5:])}", f"6 {' '.join(w)}",
                f"o {a} {b}|{w[-1]}", f"p {a} {b}|{two}", f"q {a}|{two}|{min(commas, 3)}", f"c {a} {b} {min(commas, 3)}", f"l {a} {b}|{min(len(words), 24)}", f"f {piece} {known}"]
        return [crc32(k.encode()) & ((1 << BITS) - 1) for k in keys]

    def score(self, words: list[str], opened: bool = True) -> float:
        """Log-odds that the words are a complete sentence; only the closing ones are looked at if it is not known where it ``opened``."""
        if not words:
            return 0.0
        keys = self.features(words)
        return float(self.weights[keys if opened else keys[:6] + keys[-1:]].sum() + self.bias)


def fit(texts: list[str], seed: int = 1, epochs: int = 4) -> Terminality:
    """Model from a sample of texts; an empty sample gives a model that calls everything complete."""
    rng = random.Random(seed)
    sentences: list[str] = []
    for text in texts:
        flat = flatten(text)
        parts = re.split(r"(?<=[.!?])(?=\s)|(?<=[。！？])|\n|\s\|\s", flat)
        sentences.extend(p.strip() for p in parts if p and p.strip() and p.strip()[-1] in _ENDS and not p.strip().endswith(("...", "…")))
    rng.shuffle(sentences)
    sentences = sentences[:SAMPLE_SENTENCES]
    counts = Counter(w for s in sentences for w in set(tokens(s)))
    least = 3 if len(sentences) > 3000 else 2
    known = frozenset(w for w, n in counts.items() if n >= least)
    prefixes = frozenset(w[:k] for w in known for k in range(1, len(w)) if not ("一" <= w[0] <= "鿿"))
    model = Terminality(known, prefixes, np.zeros(1 << BITS, np.float32), 0.0)
    rows, labels = [], []
    for s in sentences:
        body = s.rstrip(_ENDS).strip()
        whole = tokens(body)
        if len(whole) < 2:
            continue
        rows.append(model.features(whole)), labels.append(1.0)
        for _ in range(2):
            part = body[: rng.randrange(1, len(body))].rstrip()
            cut = tokens(part)
            if cut and cut != whole:
                rows.append(model.features(cut)), labels.append(0.0)
    if not rows:
        model.bias = 5.0
        return model
    x, y = np.array(rows, np.int64), np.array(labels, np.float32)
    share = y.mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    w, g2, order = model.weights, np.full(1 << BITS, 1e-3, np.float32), np.random.default_rng(seed)
    for _ in range(epochs):
        perm = order.permutation(len(y))
        for at in range(0, len(perm), 512):
            i = perm[at : at + 512]
            p = 1 / (1 + np.exp(-np.clip(w[x[i]].sum(1), -30, 30)))
            grad = np.repeat(((p - y[i]) * cost[i])[:, None], x.shape[1], 1).ravel()
            flat = x[i].ravel()
            np.add.at(g2, flat, grad * grad)
            np.add.at(w, flat, -0.3 * grad / np.sqrt(g2[flat]))
    return model


def judge(model: Terminality, text: str) -> tuple[bool, float]:
    """Whether the text is cut, and the log-odds that it is complete."""
    if not text.strip() or text.strip().casefold() in PLACEHOLDERS:
        return False, 0.0
    tail = Tail(text)
    words = tokens(tail.sentence)
    while words and words[-1] in ",:;，：；、":
        words = words[:-1] if tail.mark else words + ["<end>"]
        if words[-1] == "<end>":
            break
    # a text without any end mark does not show where its last sentence began
    score = model.score(words, len(words) <= UNMARKED or bool(_ANY_END.search(text))) if words else 0.0
    if not words:
        return False, score
    if tail.broken or tail.more and score < 3:
        return True, min(score, -5.0)
    if text.lstrip().startswith('{"') and not text.rstrip().endswith("}"):
        return True, min(score, -5.0)
    if len(words) < 2 and tail.mark and tail.mark[0] in "!?！？" and not words[-1].endswith("<end>"):
        return False, max(score, 0.0)  # a word called out by itself
    if len(words) < 2 and not tail.mark and words and words[-1] in model.known:
        score += 2  # one whole word by itself is a short text more often than a cut one
    if tail.signed:
        return False, max(score, 0.0)
    # an end mark speaks for a whole sentence, dots speak less, a dangling hyphen speaks against
    if tail.mark and tail.mark[0] in ".!?。！？" and len(set(tail.mark)) == 1 and tail.mark.strip(".") + "." * (len(tail.mark) == 1) != "":
        limit = END_LIMIT
    elif tail.mark:
        limit = DOTS_LIMIT
    else:
        limit = 2.0 if tail.dash else OPEN_LIMIT
    return score < limit, score
