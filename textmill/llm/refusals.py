"""Cues of refusal, learned from phrases built of parts.

A logistic model over the words, word pairs and word stems of a clause tells refusals from the
clauses of reviews and of answers in the corpus. Its positive side is made of parts (an opening, an
inability, an act, an object), so no whole sentence stands here; its negative side is a bounded
sample of the corpus, less the clauses that models of the other half of it take for refusals.
"""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np

from textmill.llm.ppm import WORD

BITS = 17
#: Refusals made for each language, and clauses of the corpus that they are told from; log-odds above which one of these is left out.
MADE, SAMPLE_CLAUSES, DOUBT = 500, 24_000, 1.0

#: Parts of refusals by language: openings, inabilities, acts, objects, whole remarks, offers.
PARTS = {
    "en": (
        ("", "Sorry, ", "I apologise, but ", "Regrettably, ", "I am afraid ", "Unfortunately, ", "My apologies: ", "As an AI assistant, ", "Being only a language model, ", "I regret that "),
        ("I can't ", "I cannot ", "I am unable to ", "I'm not able to ", "I will not ", "I won't ", "I refuse to ", "I decline to ", "I have to decline to ", "I am not allowed to ", "we cannot ", "I would rather not ", "I am not in a position to ", "I do not feel able to ", "it is impossible for me to "),
        ("give an opinion on ", "review ", "assess ", "evaluate ", "comment on ", "rate ", "classify ", "label ", "help you with ", "assist with ", "answer ", "discuss ", "process ", "judge ", "analyse ", "provide a verdict on ", "continue with ", "comply with ", "respond to "),
        ("this.", "this text.", "that question.", "such content.", "your request.", "this task.", "this message.", "what you asked.", "material of this kind.", "the review above."),
        ("That is against the rules I follow.", "It would violate my policy to answer.", "No answer can be given here.", "There will be no judgement from me.", "My guidelines do not permit a reply.", "I must refuse.", "This request is not something I can help with.", "I can offer no assessment of it."),
        ("Please try another question.", "Do you need anything else?", "Let me know if I can help with something different.", "Feel free to ask me about other things."),
    ),
    "zh": (
        ("", "抱歉，", "对不起，", "很遗憾，", "不好意思，", "作为一个人工智能助手，", "作为语言模型，", "非常抱歉，"),
        ("我无法", "我不能", "我没有办法", "我不便", "我拒绝", "我不可以", "我不会", "我没办法", "恕我不能", "我不方便"),
        ("协助", "评价", "判断", "分析", "回答", "评估", "处理", "讨论", "提供意见给", "完成", "标注", "给出看法于"),
        ("这个问题。", "这段内容。", "您的要求。", "这样的文字。", "此类请求。", "这项任务。", "这条信息。", "上面的评论。"),
        ("这违反了我的使用准则。", "这不符合规定，所以没有答案。", "恕难从命。", "这里不能给出任何评估。", "我只能拒绝。"),
        ("请换一个问题。", "您还需要其他帮助吗？", "还可以帮您做点别的吗？", "有其他需要请告诉我。"),
    ),
    "ru": (
        ("", "Простите, ", "Извините, но ", "К сожалению, ", "Увы, ", "Приношу извинения, ", "Как искусственный интеллект, ", "Будучи языковой моделью, ", "Сожалею, но "),
        ("я не могу ", "я не в состоянии ", "я не вправе ", "я не буду ", "я отказываюсь ", "мне нельзя ", "я вынужден отказаться ", "я вынуждена отказаться ", "мы не можем ", "у меня нет возможности ", "я не готов "),
        ("помогать с ", "оценить ", "оценивать ", "давать оценку ", "анализировать ", "комментировать ", "отвечать на ", "помочь с ", "обсуждать ", "выполнить ", "выполнять ", "судить про ", "классифицировать "),
        ("это.", "этот запрос.", "этим запросом.", "такой текст.", "такому содержанию.", "ваш вопрос.", "данную задачу.", "подобное сообщение.", "этот отзыв.", "от анализа."),
        ("Это противоречит моим правилам.", "Ответа не будет.", "Оценка здесь невозможна.", "Мои правила этого не разрешают.", "Вынужден отказать.", "Никакого вывода я дать не могу."),
        ("Задайте, пожалуйста, другой вопрос.", "Чем-нибудь ещё помочь?", "Могу помочь с чем-то другим?", "Если нужно что-то ещё, напишите."),
    ),
    "de": (
        ("", "Leider ", "Entschuldigung, aber ", "Als Sprachmodell "),
        ("kann ich nicht ", "darf ich nicht ", "bin ich nicht in der Lage ", "möchte ich nicht "),
        ("helfen bei ", "bewerten: ", "beurteilen: ", "antworten auf ", "analysieren: "),
        ("diese Anfrage.", "diesen Text.", "solche Inhalte.", "die Frage."),
        ("Das verstößt gegen meine Richtlinien.", "Dazu gibt es von mir keine Einschätzung."),
        ("Kann ich sonst noch helfen?", "Bitte stellen Sie eine andere Frage."),
    ),
    "es": (
        ("", "Lo siento, ", "Lamentablemente ", "Como modelo de lenguaje, "),
        ("no puedo ", "no me es posible ", "debo negarme a ", "no estoy autorizado a "),
        ("ayudar con ", "evaluar ", "valorar ", "responder a ", "analizar "),
        ("esta solicitud.", "este texto.", "ese contenido.", "la pregunta."),
        ("Eso va contra mis normas.", "No daré ninguna valoración."),
        ("¿Puedo ayudar en otra cosa?", "Haga otra pregunta, por favor."),
    ),
    "uk": (
        ("", "Вибачте, ", "На жаль, ", "Як мовна модель, "),
        ("я не можу ", "я не маю права ", "я відмовляюся ", "я не буду "),
        ("допомогти з ", "оцінити ", "оцінювати ", "відповідати на ", "аналізувати "),
        ("цей запит.", "такий текст.", "цей вміст.", "ваше питання."),
        ("Це суперечить моїм правилам.", "Оцінки не буде."),
        ("Чим ще допомогти?", "Поставте, будь ласка, інше питання."),
    ),
}


def made(lang: str, rng: random.Random) -> str:
    """A refusal put together from the parts of a language, at times followed by a remark or an offer."""
    openings, inabilities, acts, objects, remarks, offers = PARTS.get(lang, PARTS["en"])
    if rng.random() < 0.25:
        text = rng.choice(openings) + rng.choice(remarks) if rng.random() < 0.3 else rng.choice(remarks)
    else:
        text = rng.choice(openings) + rng.choice(inabilities) + rng.choice(acts) + rng.choice(objects)
    if rng.random() < 0.3:
        text += " " + rng.choice(offers)
    return text[0].upper() + text[1:]


def _keys(tokens: list[str]) -> list[int]:
    stems = [t[:5] for t in tokens]
    out = {f"1{t}" for t in stems} | {f"2{a} {b}" for a, b in zip(stems, stems[1:])} | {f"3{a} {b}" for a, b in zip(stems, stems[2:])}
    return [crc32(k.encode()) & ((1 << BITS) - 1) for k in out]


class Cues:
    """Frozen log-odds that a clause refuses."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, tokens: list[str]) -> float:
        keys = _keys(tokens)
        return float(self.weights[keys].sum() / max(len(keys), 1) ** 0.5 + self.bias) if keys else 0.0


def _logistic(rows: list[list[int]], labels: list[float], rounds: int = 6, seed: int = 5) -> Cues:
    weights, g2, bias = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-2, np.float32), 0.0
    y = np.array(labels)
    cost = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    order = np.random.default_rng(seed)
    sizes = np.array([max(len(r), 1) for r in rows]) ** -0.5
    for _ in range(rounds):
        perm = order.permutation(len(rows))
        for at in range(0, len(perm), 256):
            part = perm[at : at + 256]
            flat = np.concatenate([rows[i] for i in part]).astype(np.int64)
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = np.bincount(owner, weights[flat], len(part)) * sizes[part] + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * cost[part]
            grad = (error * sizes[part])[owner].astype(np.float32)
            np.add.at(g2, flat, grad * grad)
            np.add.at(weights, flat, -0.4 * grad / np.sqrt(g2[flat]))
            bias -= 0.02 * float(error.mean())
    return Cues(weights, bias)


def fit(clauses: list[list[str]], seed: int = 4) -> Cues:
    """Model from the words of at most ``SAMPLE_CLAUSES`` clauses of the corpus and the refusals made."""
    rng = random.Random(seed)
    positive = [_keys(WORD.findall(part.lower())) for lang in PARTS for _ in range(MADE) for part in _clauses(made(lang, rng))]
    negative = list(dict.fromkeys(map(tuple, clauses)))
    rng.shuffle(negative)
    negative = [_keys(list(c)) for c in negative[:SAMPLE_CLAUSES] if c]
    positive = [r for r in positive if r]
    halves = negative[::2], negative[1::2]
    clean: list[list[int]] = []
    for seen, other in (halves, halves[::-1]):
        # clauses of the corpus that refuse themselves are no negative cases: each half is judged by a model of the other
        judge = _logistic(positive + seen, [1.0] * len(positive) + [0.0] * len(seen), 3)
        clean.extend(r for r in other if judge.weights[r].sum() / len(r) ** 0.5 + judge.bias < DOUBT)
    return _logistic(positive + clean, [1.0] * len(positive) + [0.0] * len(clean))


def _clauses(text: str) -> list[str]:
    return [p for p in text.replace("?", ".").replace("。", ".").replace("？", ".").split(".") if p.strip()]
