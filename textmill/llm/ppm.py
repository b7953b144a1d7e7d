"""Prediction by partial matching over bytes with frozen statistics.

A model is a context tree of variable order: for each context of up to ``order`` bytes the counts
of the next byte. The probability of a byte is its count over the context's total plus distinct
signs, or the escape probability times that of the shorter context (method C), and 1/256 at last.
Contexts reach back to the start of the word, so a word's exact code length does not depend on
its neighbours and is computed once per distinct word and worker.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")
ORDER = 5

#: Languages of the models; the _latn ones are Cyrillic languages written in Latin letters.
LANGUAGES = ("en", "zh", "ru", "de", "es", "uk")

#: Seed texts, so that a language with few labelled documents still has a model.
SEEDS = {
    "en": "The weather was fine this morning and we walked to the station before the train left. She said that nothing had changed since they moved into the house, although the windows would not close and the kitchen was too small for all of us. I have been there many times with my friends, because people are kind and the food is good. Would you please tell him what happened when the old man opened the door? There are things which should never be forgotten. It works well, but it is not what I wanted, so I will send it back and ask for the money. The garden lies behind the station, and in autumn the children gather leaves there while their parents sit on the bench and read the paper.",
    "zh": "今天早上天气很好我们走到车站的时候火车还没有开。她说自从搬家以后什么都没有变虽然窗户关不上厨房也太小了。我和朋友去过很多次因为那里的人很好饭菜也好吃。请你告诉他老人开门的时候发生了什么事情。这个东西用起来不错但不是我想要的所以我要退货。花园在车站后面秋天孩子们在那里捡叶子父母坐在长椅上看报纸。",
    "ru": "Сегодня утром погода была хорошая, и мы пошли на вокзал раньше, чем ушёл поезд. Она сказала, что ничего не изменилось с тех пор, как они переехали в новый дом, хотя окна не закрываются и кухня слишком маленькая для всех нас. Я был там много раз со своими друзьями, потому что люди добрые и еда вкусная. Скажите ему, пожалуйста, что случилось, когда старик открыл дверь? Есть вещи, которые нельзя забывать. Работает хорошо, но это не то, что я хотела, поэтому верну и попрошу деньги. Сад лежит за вокзалом, и осенью дети собирают там листья, пока их родители сидят на скамейке и читают газету.",
    "de": "Heute Morgen war das Wetter schön, und wir gingen zum Bahnhof, bevor der Zug abfuhr. Sie sagte, dass sich nichts geändert habe, seit sie in das neue Haus gezogen sind, obwohl die Fenster nicht schließen und die Küche für uns alle zu klein ist. Ich war schon oft mit meinen Freunden dort, weil die Leute freundlich sind und das Essen gut schmeckt. Würden Sie ihm bitte sagen, was geschehen ist, als der alte Mann die Tür öffnete? Es gibt Dinge, die man nie vergessen darf. Es funktioniert gut, aber ich wollte etwas anderes und schicke es zurück. Der Garten liegt hinter dem Bahnhof, und im Herbst sammeln die Kinder dort Blätter, während ihre Eltern auf der Bank sitzen und Zeitung lesen.",
    "es": "Esta mañana hacía buen tiempo y fuimos andando a la estación antes de que saliera el tren. Ella dijo que nada había cambiado desde que se mudaron a la casa nueva, aunque las ventanas no cierran y la cocina es demasiado pequeña para todos nosotros. He estado allí muchas veces con mis amigos, porque la gente es amable y la comida está rica. ¿Puede decirle qué pasó cuando el viejo abrió la puerta? Hay cosas que nunca se deben olvidar. Funciona bien, pero no es lo que yo quería, así que lo devuelvo y pido el dinero. El jardín está detrás de la estación, y en otoño los niños recogen hojas mientras sus padres se sientan en el banco a leer el periódico.",
    "uk": "Сьогодні вранці погода була гарна, і ми пішли на вокзал раніше, ніж рушив потяг. Вона сказала, що нічого не змінилося відтоді, як вони переїхали до нового будинку, хоча вікна не зачиняються і кухня замала для всіх нас. Я був там багато разів зі своїми друзями, тому що люди добрі й їжа смачна. Скажіть йому, будь ласка, що сталося, коли старий відчинив двері? Є речі, яких не можна забувати. Працює добре, але це не те, чого я хотіла, тому поверну і попрошу гроші. Сад лежить за вокзалом, і восени діти збирають там листя, поки їхні батьки сидять на лавці та читають газету.",
}

#: Common transliteration of Russian and Ukrainian letters.
_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
}


def romanize(word: str, ukrainian: bool = False) -> str:
    out = []
    for i, sign in enumerate(word):
        if sign == "е" and not ukrainian and (i == 0 or word[i - 1] in "аеёиоуыэюяъь"):
            out.append("ye")
        elif ukrainian and sign == "г":
            out.append("h")
        elif ukrainian and sign == "и":
            out.append("y")
        else:
            out.append(_LATIN.get(sign, sign))
    return "".join(out)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    """Frozen context tree of one language."""

    def __init__(self, counts: Counter, order: int = ORDER):
        tree: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for word, n in counts.items():
            weight = 1 + int(math.log2(n))
            raw = b" " + word.encode() + b" "
            for i in range(1, len(raw)):
                for k in range(min(order, i) + 1):
                    tree[raw[i - k : i]][raw[i]] += weight
        self.order = order
        self.bits: dict[bytes, tuple[dict[int, float], float]] = {}
        for context, nexts in tree.items():
            whole = sum(nexts.values()) + len(nexts)
            self.bits[context] = ({sign: math.log2(whole / n) for sign, n in nexts.items()}, math.log2(whole / len(nexts)))

    def cost(self, word: str) -> float:
        raw = b" " + word.encode() + b" "
        total = 0.0
        for i in range(1, len(raw)):
            for k in range(min(self.order, i), -1, -1):
                known = self.bits.get(raw[i - k : i])
                if known is None:
                    continue
                bits = known[0].get(raw[i])
                if bits is not None:
                    total += bits
                    break
                total += known[1]
            else:
                total += 8.0
        return total


class Scorer:
    """Code lengths of words under all models, kept per worker."""

    def __init__(self, word_counts: dict[str, dict[str, int]]):
        self.names, self.models = [], []
        for lang in LANGUAGES:
            counts = Counter(word_counts.get(lang, {}))
            for word in words(SEEDS[lang]):
                counts[word] += 1
            self.names.append(lang)
            self.models.append(Model(counts))
            if lang in ("ru", "uk"):
                latin: Counter = Counter()
                for word, n in counts.items():
                    latin[romanize(word, lang == "uk")] += n
                self.names.append(lang)
                self.models.append(Model(latin))
        self.cache: dict[str, tuple[float, ...]] = {}

    def word_costs(self, word: str) -> tuple[float, ...]:
        costs = self.cache.get(word)
        if costs is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            costs = self.cache[word] = tuple(m.cost(word) for m in self.models)
        return costs

    def text_costs(self, tokens: list[str]) -> list[float]:
        """Bits per model for the tokens."""
        known = self.cache
        return [sum(x) for x in zip(*[known.get(w) or self.word_costs(w) for w in tokens])] or [0.0] * len(self.models)

    def best(self, tokens: list[str]) -> tuple[str, float, dict[str, float]]:
        """Language, its lead in bits over the next language, and the least bits by language."""
        by: dict[str, float] = {}
        for name, bits in zip(self.names, self.text_costs(tokens)):
            if bits < by.get(name, 1e18):
                by[name] = bits
        order = sorted(by, key=by.get)
        return order[0], by[order[1]] - by[order[0]], by
