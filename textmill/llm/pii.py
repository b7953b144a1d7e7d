"""Problem 4: personal data in free text, found and replaced by typed placeholders.

Patterns propose spans; checksums confirm or rule them out (Luhn decides on payment cards, mod-97
on bank accounts; citizen, insurance and tax numbers gain by theirs); words near a span raise or
lower its score. A span whose score reaches
``ACCEPT`` is taken; of overlapping spans the better one stays. Tags and entities inside a value
do not hide it: the patterns read a flattened text whose every sign remembers its place.

Results for special input: null and empty texts hold nothing and stay as they are; equal rows
give one row. Order, tracking, lot and model numbers, dates, prices and shop handles are ruled
out by their words and shapes. The rest of a text is kept to the sign.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of the report; cards and bank accounts are replaced as well, but are no identity numbers.
KINDS = ("email", "phone", "id_number", "address", "person")
MONEY_KINDS = ("card", "bank_account")
ACCEPT = 1.0

_MARK = re.compile(r"<[^<>]{0,200}>|&#?[0-9A-Za-z]{1,8};|[​-‏⁠﻿­]")
_WIDE = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2007: 0x20, 0x2009: 0x20, 0x202F: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}
_ODD = re.compile("[<&​-‏⁠﻿­]")
_NEEDS_FOLD = re.compile("[！-～　\xa0   ‐-–−]")


def flatten(text: str) -> tuple[str, list[int] | None]:
    """Text without tags, invisible signs and entities, and the place of each sign (None: unchanged)."""
    places = None
    if _ODD.search(text):
        out, places, at = [], [], 0
        for m in _MARK.finditer(text):
            out.append(text[at : m.start()])
            places.extend(range(at, m.start()))
            if m[0][0] == "&":
                sign = html.unescape(m[0])
                if len(sign) == 1:
                    out.append(sign)
                    places.append(m.start())
                else:
                    out.append(m[0])
                    places.extend(range(m.start(), m.end()))
            at = m.end()
        out.append(text[at:])
        places.extend(range(at, len(text)))
        text = "".join(out)
    if _NEEDS_FOLD.search(text):
        text = text.translate(_WIDE)
    return text, places


# ---- checksums -------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return len(digits) >= 12 and total % 10 == 0


def mod97(code: str) -> bool:
    """International bank account number: moved and spelt as digits it leaves 1."""
    moved = code[4:] + code[:4]
    return len(code) >= 15 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def citizen_18(code: str) -> bool:
    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
    return "10X98765432"[sum(int(c) * w for c, w in zip(code, weights)) % 11] == code[17].upper()


def insurance_11(digits: str) -> bool:
    rest = sum(int(c) * (9 - i) for i, c in enumerate(digits[:9])) % 101 % 100
    return rest == int(digits[9:])


def tax_12(digits: str) -> bool:
    a = sum(int(c) * w for c, w in zip(digits, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    b = sum(int(c) * w for c, w in zip(digits, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    return int(digits[10]) == a and int(digits[11]) == b


# ---- e-mail ----------------------------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\s?\.\s?|\s?[\[(]\s?dot\s?[\])]\s?)"
_EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+'-]{{0,63}}{_AT}[a-z0-9][a-z0-9-]{{0,62}}(?:{_DOT}[a-z0-9][a-z0-9-]{{0,62}}){{0,6}}?{_DOT}[a-z]{{2,12}}(?![a-z0-9@])", re.I)
_SPELT = re.compile(r"[a-z0-9][a-z0-9._%+'-]{0,63}\s(?:at|собака|эт)\s[a-z0-9][a-z0-9-]{0,62}(?:\s(?:dot|точка)\s[a-z0-9-]{1,63}){0,6}\s(?:dot|точка)\s[a-z]{2,12}(?![a-z0-9])", re.I)

# ---- numbers ---------------------------------------------------------------------------------

#: country, check digits and up to thirty signs, at times in groups of four
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD_WORD = re.compile(r"\bcard\b|\bvisa\b|mastercard|\bamex\b|карт[аыуе]|银行卡|信用卡|卡号|karte|tarjeta|картк", re.I)
#: number-like runs with the letters and signs of identity numbers
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9@/#_-])(?:\+ ?)?(?:\(?\d(?:[ .()-]{0,2}\d){5,19}[Xx]?(?![A-Za-z0-9_])|\d{2,4}[ -]?\d{0,4} ?№ ?\d{4,8}(?!\d)|[A-Z]{2}(?: \d\d){3} [A-Z](?![A-Za-z0-9_-])|[A-Z]{2}\d{6}[A-Z](?![A-Za-z0-9_-])|[A-Z]{1,2}\d{6,9}(?![A-Za-z0-9_-]))", re.I
)
_ID_WORD = re.compile(
    r"passport|licen[cs]e|driv(?:er|ing)|\bssn\b|social security|insurance (?:no|num)|national (?:insurance|id)|\btax(?:payer)? ?(?:id|no|num|ident)|\bnin\b|\bnino\b|\btin\b|\bitin\b|identity (?:card|num|no)|\bid (?:card|number|no)\b|citizen|"
    r"паспорт|снилс|\bинн\b|удостоверен|удостоверяющ|водительск|полис|страхов|\bправа\b|загран|"
    r"身份证(?:号码?)?|证件(?:号码?)?|护照(?:号码?)?|驾照|驾驶证|社保|税号|居民证|"
    r"ausweis|reisepass|führerschein|steuer|sozialversicherung|pasaporte|licencia de conducir|seguro social|\bdni\b|\bnie\b|паспорта", re.I
)
_PHONE_WORD = re.compile(
    r"\bcall\b|\btext\b|phone|reach me|\bring\b|mobile|\bcell\b|whatsapp|contact|\btel\b|\bfax\b|dial|sms|"
    r"звон|номер|\bтел\b|тел\.|телефон|контакт|моб|ватсап|телеграм|"
    r"电话|手机|微信|联系|有事打|致电|拨打|短信|同号|"
    r"anruf|telefon|handy|llam|teléfono|móvil|дзвон", re.I
)
_NOT_PERSONAL = re.compile(
    r"\border(?:ed)?\b|\btrack|\bparcel no|invoice|\blot\b|batch|\bmodel\b|\bserial|\bsku\b|\bcode\b|\bunit\b|\bpaid\b|\bprice|\bref(?:erence)?\b|article|receipt|"
    r"заказ|трек|отправлени|артикул|партия|код |модель|накладн|чек|накладная|заплат|"
    r"订单|快递单|运单|单号|批号|编号|型号|付款|发票|条码|货号|"
    r"bestell|sendung|charge|pedido|seguimiento|lote|замовлення", re.I
)
_BREAK = re.compile(r"(?<!\bno)[.!?]\s|[。！？\n]", re.I)
_AMOUNT = re.compile(r"\s?(?:%|[$€£¥₽]|руб|元|usd\b|eur\b|штук|шт\b|pcs\b|cm\b|mm\b|кг\b|kg\b)", re.I)
_CURRENCY = ("$", "€", "£", "¥")
#: a run of digits that may be a number of interest; most texts' codes are ruled out here
_RUN = re.compile(r"\d(?:[ .()№-]{0,3}\d)+")
_DATE = re.compile(r"^(?:19|20)\d\d[-. /]\d{1,2}[-. /]\d{1,2}$|^\d{1,2}[-. /]\d{1,2}[-. /](?:19|20)\d\d$")


def _number_score(raw: str, digits: str, before: str, after: str) -> tuple[str | None, float]:
    """Kind and score of a run of digits by its shape, checksums and the words next to it."""
    n = len(digits)
    compact = re.sub(r"[ .()-]", "", raw)
    letters = re.sub(r"[^A-Za-z]", "", raw)
    if _DATE.match(raw):
        return None, 0.0
    near = before[-36:]
    id_near = [m.end() for m in _ID_WORD.finditer(near)]
    phone_near = [m.end() for m in _PHONE_WORD.finditer(near)]
    breaks = [m.end() for m in _BREAK.finditer(near)]
    not_near = [m.end() for m in _NOT_PERSONAL.finditer(near, breaks[-1] if breaks else 0)]
    id_at, phone_at, not_at = (x[-1] if x else -1 for x in (id_near, phone_near, not_near))
    if phone_at < 0 and id_at < 0 and _PHONE_WORD.search(after):
        phone_at = len(near)
    # shapes
    phone = ident = 0.0
    if not letters and "№" not in raw:
        if raw.startswith("+") and 9 <= n <= 15:
            phone = 1.2
        elif re.fullmatch(r"00\d{1,3}[ .-]?\d[\d .()-]{7,14}", raw) and 11 <= n <= 16:
            phone = 0.8
        elif re.fullmatch(r"8[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}", raw):
            phone = 0.7
        elif re.fullmatch(r"1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", raw):
            phone = 0.9
        elif re.fullmatch(r"\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[.]\d{3}[.]\d{4}", raw):
            phone = 1.0
        elif re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]?\d{4}", raw):
            phone = 0.6
        elif re.fullmatch(r"0\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,4}", raw):
            phone = 0.6
        elif re.fullmatch(r"1[3-9]\d[ .-]?\d{4}[ .-]?\d{4}", raw):
            phone = 0.8
        elif re.fullmatch(r"555-?\d{4}", raw):
            phone = 0.6
        elif re.fullmatch(r"\d{3}-\d{4}", raw):
            phone = 0.3
        elif 7 <= n <= 13:
            phone = 0.1
        if re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}", raw):
            ident = 0.9
        elif re.fullmatch(r"\d{3}[ -]\d{3}[ -]\d{3}[ -]\d{2}", raw):
            ident = 0.8 + 0.3 * insurance_11(digits)
        elif n == 18 and re.fullmatch(r"\d{6} ?\d{8} ?\d{4}", raw):
            ident = 1.0 + 0.3 * citizen_18(digits)
        elif n == 12 and compact == digits and len(raw) == 12:
            ident = 0.3 + 0.6 * tax_12(digits)
        elif re.fullmatch(r"\d{2} \d{2} \d{6}|\d{4} \d{6}", raw):
            ident = 0.6
        elif 7 <= n <= 12:
            ident = 0.2
    elif re.fullmatch(r"\d{17}[Xx]|\d{6} \d{8} \d{3}[Xx]", raw):
        ident = 1.0 + 0.3 * citizen_18(digits + "X")
    elif "№" in raw and 8 <= n <= 12:
        ident = 0.7
    elif re.fullmatch(r"[A-Za-z]{2}(?: ?\d\d){3} ?[A-Za-z]", raw):
        ident = 1.0
    elif re.fullmatch(r"[A-Za-z]\d{8}", raw):
        ident = 0.6
    elif re.fullmatch(r"[A-Za-z]{1,2} ?\d{6,9}", raw):
        ident = 0.3
    else:
        return None, 0.0
    # words
    if phone_at >= 0:
        phone += 0.8
    if id_at >= 0:
        ident += 0.9
    if id_at > phone_at >= 0:
        phone -= 0.6
    elif phone_at > id_at >= 0:
        ident -= 0.6
    if not_at > max(id_at, phone_at):
        phone -= 1.5
        ident -= 1.5
    if _AMOUNT.match(after) or before[-2:].rstrip()[-1:] in _CURRENCY:
        phone -= 1.5
        ident -= 1.5
    if compact.isdigit() and 13 <= n <= 19 and luhn(digits) and id_at < 0 and phone_at < 0:
        grouped = re.fullmatch(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}", raw) is not None
        card = 0.5 + 0.3 * (grouped and not raw.isdigit()) + 0.4 * (digits[0] in "23456") + 0.8 * (_CARD_WORD.search(near) is not None) - 1.5 * (not_at >= 0)
        if card >= ACCEPT:
            return "card", card
        phone -= 1.0
    return ("id_number", ident) if ident >= phone else ("phone", phone)


# ---- addresses -------------------------------------------------------------------------------

_STREET_EN = r"(?:street|str|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr|court|ct|place|pl|square|sq|terrace|way|close|crescent|parkway|pkwy|row|hill|grove|gardens)"
_ADDRESS_LATIN = re.compile(
    rf"(?:(?:flat|apt\.?|apartment|unit|suite)\s?\d+\w?,?\s)?(?<![\w-])\d{{1,5}}[a-z]?,?\s(?:(?:north|south|east|west|n\.|s\.|e\.|w\.)\s)?[a-z][\w'’-]{{0,40}}(?:\s[a-z][\w'’-]{{0,40}}){{0,2}}?\s{_STREET_EN}\b\.?(?:,?\s(?:apt\.?|apartment|unit|suite|flat|floor|#)\s?\d+\w?)?"
    r"|\b[A-ZÄÖÜ][\wäöüß-]{0,40}(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer)\s\d{1,4}[a-z]?\b"
    r"|\b(?:calle|avenida|avda\.|paseo|plaza|camino)\s(?:de\s(?:la\s|los\s|las\s)?)?[\wáéíóúñ]+(?:\s[\wáéíóúñ]+)?,?\s(?:n[ºo.]\s?)?\d{1,4}\b",
    re.I,
)
_ACCOUNT_HINT = re.compile(r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}")
_HOUSE = re.compile(r"\d[A-Za-z]?,? [A-Za-z]")
_STREETS = (" st", " av", " road", " rd", " lane", " ln", " bo", " bl", " dr", " c", " pl", " sq", " terrace", " way", " p", " row", " hill", " g")
_EURO_STREETS = ("straße", "strasse", "str.", "weg ", "gasse", "allee", "platz", "ufer", "calle ", "avenida ", "avda", "paseo ", "plaza ", "camino ")
_ADDRESS_CYRILLIC = re.compile(
    r"(?:\bул(?:ица|\.)?|\bулице|\bпер(?:еулок|\.)?|\bпр(?:оспект|осп\.|-т)?\.?|\bпроспекте|\bбульвар|\bб-р|\bшоссе|\bнабережная|\bнаб\.|\bплощадь|\bпл\.|\bпроезд|\bтупик|\bвулиця|\bвул\.)\s[\w.-]+(?:\s[\w-]+)?,?\s(?:д(?:ом)?\.?\s?)?\d+\w?(?:[-/]\d+)?(?:,?\s(?:корп(?:ус)?\.?|стр\.?|к\.)\s?\d+)?(?:,?\s(?:кв(?:артира)?\.?|оф\.?)\s?\d+)?",
    re.I,
)
_CYRILLIC_STREETS = ("ул.", "ул ", "улиц", "пер.", "пер ", "переул", "просп", "пр.", "пр-т", "пр ", "бульвар", "б-р", "шоссе", "наб.", "набереж", "пл.", "площад", "проезд", "тупик", "вул.", "вулиц")
_ADDRESS_HAN = re.compile(
    r"[一-鿿]{1,8}?(?:路|街|大道|巷|胡同|道)\s?\d+\s?(?:弄|号|號)(?:院)?(?:\s?\d+\s?(?:号|號|栋|幢|弄))?(?:\s?\d+\s?(?:单元|栋|幢))?(?:\s?\d+\s?(?:室|房|号|楼))?"
    r"|[一-鿿]{1,8}?(?:小区|花园|公寓|家园|新村|苑)\s?\d+\s?(?:单元|栋|幢|号楼|号)(?:\s?\d+\s?单元)?(?:\s?\d+\s?(?:室|房)?)?"
)
_HAN_HINT = re.compile(r"(?:[路街道巷区苑园寓村]|胡同)\s?\d")
_NOT_STREET = re.compile(r"\b(?:in|on|by|after|for|the|and|of|within|it|is|was|at|to|my|days?|weeks?|months?|minutes|hours?|times)\b", re.I)

# ---- persons ---------------------------------------------------------------------------------

_STOP = r"(?:was|were|is|are|has|had|and|by|at|for|of|on|in|the|a|an|to|or|who|with|from|no|my|this|that|it|if|but|so|as|we|you|they|he|she|i|not|after|before|did|does|will|would|said|told|here|there|about|please|thanks?)"
_NAME_EN = rf"(?:(?:mr|mrs|ms|miss|dr|prof)\b\.?\s+)?(?!{_STOP}\b)[a-z][\w'’-]+(?:\s+[a-z]\.)?(?:\s+(?!{_STOP}\b)[a-z][\w'’-]+){{0,2}}"
_TITLED = r"(?:mr|mrs|ms|miss|dr|prof)\b\.?\s+"
_PERSON_EN = re.compile(
    rf"\b(?:support agent|agent|my name is|name['’]?s|ask for|(?:was )?addressed to|regards,|sincerely,|yours,|cheers,|best,|signed,?|spoke (?:to|with)|talked to|courier named|seller named|manager|attn:?|contact person:?|recipient:?|i am called|deliver(?:ed)? to mr|on behalf of|signed by|thanks to|contact)\s+(?P<n>{_NAME_EN})"
    rf"|\b(?P<t>{_TITLED}(?:[a-z]\.\s+)?[a-z][\w'’-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][\w'’-]+)?)",
    re.I,
)
_NAME_RU = r"(?:[а-яё]\.\s?(?:[а-яё]\.\s?)?[а-яё][а-яё-]+|[а-яё][а-яё-]+\s[а-яё]\.(?:\s?[а-яё]\.)?|[а-яё][а-яё-]+(?:\s(?!(?:и|на|не|ничем|была?|которая|который|сказала?|я|от|по|из|за|до|с)\b)[а-яё][а-яё-]+){0,2})"
_PERSON_RU = re.compile(
    rf"(?:с уважением,|меня зовут|зовут меня|менеджер(?:а|у|ом)?|получател[ья](?:ница)?:?|курьер по имени|спросите|на имя|консультант|оператор|продавец по имени|ваша?,|подпись:|фио:?|имя:?)\s+(?P<n>{_NAME_RU})", re.I
)
_PERSON_ZH = re.compile(
    r"收件人(?:是|：|:)?\s?(?P<a>[一-鿿]{2,4}?)(?=那天|不在|，|。|,|\s|没|的|电话|$)"
    r"|我(?:叫|的名字(?:是|叫)|是收件人)\s?(?P<b>[一-鿿]{2,4}?)(?=，|。|,|\.|\s|、|！|!|已|$)"
    r"|(?:——|--|—)\s?(?P<c>[一-鿿]{2,4})(?=\s*(?:$|\n|[。！!.\"”»)*]))"
    r"|客服(?:人员|小姐|专员|是|叫)?\s?(?P<d>(?!一直|让我|没有|回复|态度|电话|说|很|也|都|不|太|真|给|的|告诉|问|发|人员|小姐|专员)[一-鿿]{2,3}?)(?=态度|说|，|。|的|很|回复|$)"
    r"|(?:联系人|姓名|签收人|寄件人|署名)(?:是|：|:)?\s?(?P<e>[一-鿿]{2,4}?)(?=，|。|,|\s|的|$)"
    r"|(?P<f>[一-鿿]{1,3})(?:先生|女士)(?=，|。|态度|说|,|\s|不在|那天|收)"
)
_TWO_NAMES_EN = r"[A-Z][a-z][\w'’-]*(?: [A-Z]\.)? [A-Z][a-z][\w'’-]*"
_TWO_NAMES_RU = r"[А-ЯЁ][а-яё-]+ [А-ЯЁ][а-яё-]+"
#: two capitalised words beside what only a person is or does, in texts that are not all capitals
_ROLE_EN = re.compile(
    rf"\b(?:neighbou?rs?|drivers?|doctor|nurse|colleague|cashier|clerk|technician|plumber|electrician|friend|brother|sister|cousin|uncle|aunt|husband|wife|landlord|boss|teacher|courier|postman|assistant|representative|operator|receptionist|(?:helped|written|served|assisted|reviewed|delivered|answered|packed|signed for) by|(?:handed|given|sent|went|belongs) to|met with|met|named|called)(?:,|\s(?:is|was))?\s(?P<n>{_TWO_NAMES_EN})"
    rf"|(?P<v>{_TWO_NAMES_EN})\s(?:said|says|told|asked|replied|answered|promised|refused|helped|wrote|phoned|signed|apologi[sz]ed|hung up|insisted|came by|rang)\b"
)
_ROLE_RU = re.compile(
    rf"(?:сосед(?:ка|у|ке)?|водител[ьюя]|врач[уа]?|коллег[аеи]|кассир(?:у|ша)?|мастер(?:у|а)?|друг[ау]?|подруг[ае]|брат[ау]?|сестр[ае]|курьер(?:у|а)?|сотрудни(?:к|ца|цей|ком)|техник|учител[ьюя]|продавец|продавцу)\s(?P<n>{_TWO_NAMES_RU})"
    rf"|(?P<v>{_TWO_NAMES_RU})\s(?:сказал|ответил|пообещал|обещал|написал|позвонил|прин[её]с|помог|отказал|нахамил|заверил|расписал)\w*"
)
_CAPITALS = re.compile(r"[A-ZА-ЯЁ][a-zа-яё'’-]+\s(?:[A-Z]\.\s)?[A-ZА-ЯЁ][a-zа-яё]")
#: words that open a sentence or name a shop, a month or a day before a capitalised one
_COMMON = re.compile(r"\b(?:the|this|that|it|we|they|she|he|you|verdict|pros|cons|comment|liked|disliked|customer|support|service|prime|store|shop|company|team|amazon|google|apple|black|new|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|june|july|august|september|october|november|december|when|then|after|but|and|our|my|his|her|even|служба|магазин|компания|итог|плюсы|минусы|комментарий|но|а|когда|потом|озон)\b", re.I)
_NOT_NAME = re.compile(
    r"^(?:the|a|an|my|our|your|this|that|it|me|you|us|them|him|her|someone|anyone|support|help|customer|service|seller|shop|store|refund|replacement|manager|agent|delivery|courier|info|details|pictures|"
    r"хозяйку|хозяина|меня|нас|вас|вам|их|магазин\w*|заказа?|заказ\w*|товара?|посылк\w*|сам\w*|не|так|уже|ничем|сказал\w*|обещал\w*|помог\w*|ответил\w*|отказал\w*|молчит|нахамил\w*)\b", re.I
)
#: words one of which every pattern above needs
_EN_WORDS = ("agent", "name", "ask for", "addressed", "regards", "sincerely", "yours,", "cheers", "best,", "signed", "spoke", "talked", "manager", "attn", "contact", "recipient", "i am called", "mr", "behalf", "thanks to", "ms. ", "ms ", "miss ", "dr. ", "dr ", "prof")
_RU_WORDS = ("уважением", "зовут", "менеджер", "получател", "имени", "спросите", "на имя", "консультант", "оператор", "ваш", "подпись", "фио", "имя")
_ZH_WORDS = ("收件人", "我叫", "名字", "—", "--", "客服", "联系人", "姓名", "签收人", "寄件人", "署名", "先生", "女士")


def _any(words: tuple[str, ...], text: str) -> bool:
    return any(w in text for w in words)


def _person_spans(text: str, lower: str) -> list[tuple[int, int, float]]:
    out = []
    if _any(_EN_WORDS, lower):
        for m in _PERSON_EN.finditer(text):
            key = "n" if m["n"] else "t"
            s, e = m.span(key)
            name = m[key]
            words = [w for w in re.findall(r"[\w'’-]+", name) if w.lower() not in ("mr", "mrs", "ms", "miss", "dr", "prof")]
            if not words or _NOT_NAME.match(name):
                continue
            titled = re.match(_TITLED, name, re.I) is not None
            upper = sum(w[0].isupper() for w in words)
            folded = not any(c.isupper() for c in text) or text.upper() == text
            loud = re.match(r"(?:support agent|my name is|regards|sincerely|addressed|was addressed|ask for)", m[0], re.I) is not None
            score = 0.2 + 0.6 * titled + 0.5 * (len(words) >= 2) + 0.4 * loud + (0.4 if upper == len(words) else 0.3 if folded else -0.8)
            if len(words) == 1 and not titled:
                score -= 0.5
            out.append((s, e, score))
    if _any(_RU_WORDS, lower):
        for m in _PERSON_RU.finditer(text):
            name = m["n"]
            if _NOT_NAME.match(name):
                continue
            words = re.findall(r"[\w-]+", name)
            folded = not any(c.isupper() for c in text) or text.upper() == text
            upper = sum(w[0].isupper() for w in words)
            if not folded:
                while words and not words[-1][0].isupper():
                    name = name[: name.rfind(words.pop())].rstrip()
                if not words:
                    continue
                upper = sum(w[0].isupper() for w in words)
            score = 0.2 + 0.5 * (len(words) >= 2) + (0.6 if upper == len(words) else 0.4 if folded else -0.6) + (0.2 if re.match(r"с уваж|меня зовут|получ", m[0], re.I) else 0.0)
            out.append((m.start("n"), m.start("n") + len(name), score))
    if _CAPITALS.search(text) and 2 * len(re.findall(r"(?<!\w)[A-ZА-ЯЁ]", text)) < len(re.findall(r"\w+", text)) + 4:
        for role in (_ROLE_EN, _ROLE_RU):
            for m in role.finditer(text):
                key = "n" if m["n"] else "v"
                if not _NOT_NAME.match(m[key]) and not _COMMON.search(m[key]):
                    out.append((*m.span(key), 1.05))
    if _any(_ZH_WORDS, text):
        for m in _PERSON_ZH.finditer(text):
            key = m.lastgroup
            if key:
                out.append((*m.span(key), 1.1))
    return out


# ---- all kinds -------------------------------------------------------------------------------

def spans(text: str) -> list[tuple[int, int, str]]:
    """Accepted spans ``(start, end, kind)`` of the text, in order and without overlap."""
    flat, places = flatten(text)
    found: list[tuple[float, int, int, str]] = []
    lower = flat.lower()
    if "@" in flat or "at)" in lower or "at]" in lower:
        found.extend((1.5, *m.span(), "email") for m in _EMAIL.finditer(flat))
    if " dot " in lower or " точка " in lower:
        found.extend((1.5, *m.span(), "email") for m in _SPELT.finditer(flat))
    if _ACCOUNT_HINT.search(flat):
        found.extend((2.0, *m.span(), "bank_account") for m in _ACCOUNT.finditer(flat) if mod97(m[0].replace(" ", "")))
    end = 0
    for run in _RUN.finditer(flat):
        first = run.start()
        if run.end() - first < 7 and not (first and flat[first - 1].isalpha()) or first and flat[first - 1] in "-/@#_" or run.end() <= end:
            continue
        m = _NUMBER.search(flat, max(end, first - 6), run.end() + 3)
        if m is not None and m.start() > first:
            continue
        while m is not None:  # a run may hold several numbers, one behind the other
            end = m.end()
            raw = m[0].rstrip(" .-(")
            at = m.start() + len(raw)
            kind, score = _number_score(raw, re.sub(r"\D", "", raw), flat[max(0, m.start() - 48) : m.start()], flat[at : at + 22])
            if kind and score >= ACCEPT:
                found.append((score, m.start(), at, kind))
            m = _NUMBER.search(flat, end, run.end() + 3) if end < run.end() else None
    if _HOUSE.search(flat) and _any(_STREETS, lower) or _any(_EURO_STREETS, lower):
        found.extend((1.4, *m.span(), "address") for m in _ADDRESS_LATIN.finditer(flat) if not _NOT_STREET.search(m[0]))
    if _any(_CYRILLIC_STREETS, lower):
        found.extend((1.4, *m.span(), "address") for m in _ADDRESS_CYRILLIC.finditer(flat))
    if _HAN_HINT.search(flat):
        found.extend((1.4, *m.span(), "address") for m in _ADDRESS_HAN.finditer(flat))
    for s, e, score in _person_spans(flat, lower):
        if score >= ACCEPT:
            found.append((score - 0.2, s, e, "person"))
    found.sort(key=lambda x: (-x[0], x[1]))
    taken: list[tuple[int, int, str]] = []
    for _, s, e, kind in found:
        if all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, kind))
    taken.sort()
    if places is not None:
        taken = [(places[s], places[e - 1] + 1, kind) for s, e, kind in taken]
    return taken


def redact(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """Text with each span replaced by ``[KIND]``."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in spans(text) if found is None else found:
        out.append(text[at:s])
        out.append(f"[{kind.upper()}]")
        at = e
    out.append(text[at:])
    return "".join(out)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("raw_records", "original_text"), ("processed_records", "text_for_llm")]
    frames = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "id", F.col(c).alias("text")).where("id IS NOT NULL AND text IS NOT NULL") for t, c in parts]
    return reduce(DataFrame.unionByName, frames)


def record_kinds(texts: DataFrame) -> DataFrame:
    """``table_name, id, kind`` for rows with ``table_name, id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, rid, text in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend((name, rid, kind) for kind in {s[2] for s in spans(text)} if kind in KINDS)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["table_name", "id", "kind"])

    return texts.select("table_name", "id", "text").mapInArrow(run, "table_name string, id string, kind string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_kinds(_texts(spark, sf_dir)).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders, and the number of spans replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t) for t in texts]
            done = [redact(t, f) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("table_name"), batch.column("id"), pa.array(done, pa.string()), pa.array([len(f) for f in found], pa.int32())],
                names=["table_name", "id", "text", "replaced"],
            )

    return _texts(spark, sf_dir).mapInArrow(run, "table_name string, id string, text string, replaced int").distinct()
