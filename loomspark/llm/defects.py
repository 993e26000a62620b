"""Defective answers of question and answer pairs, with one of five labels each.

* ``empty``: nothing but white space, invisible characters, markers of turns and fences or an empty object;
* ``refusal``: dictionaries of refusing phrases and of stems (who declines, what isn't done) in eleven languages, held against
  what the answer mainly says;
* ``copy``: the answer costs a zstandard compressor that has its question as dictionary next to nothing;
* ``truncated``: the terminal-context model of :mod:`loomspark.llm.truncation`;
* ``wrong_language``: the language model of :mod:`loomspark.llm.lang` on both sides, and no request for that language.

The first label that fits, in this order, is the answer's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from loomspark.llm.lang import LanguageModel

# Words and phrases by language.
MARKER = re.compile(r"<\|?/?[a-z_]+\|?>(?:(?:thought|user|model|assistant|system)\b)?")
FENCE = re.compile(r"```[a-z]*|~~~")
INVISIBLE = re.compile(r"[\s­​-‏‪-‮⁠-⁤﻿ㅤ]+")
_BLANK = INVISIBLE.pattern.removesuffix("+")
NOTHING = re.compile(rf'(?:{_BLANK}|\{{{_BLANK}*\}}|\[{_BLANK}*\]|"")*')

REFUSALS = {
    "en": [
        r"\bi(?:'m| am)? (?:can(?:'|no)?t|cannot|am not able to|am unable to|unable to|won't|will not) (?:help|assist|comply|provide|give|answer|do|write|create|fulfil|discuss|support|share|make|offer|respond|continue)",
        r"\bi (?:have to|must|need to) (?:decline|refuse)", r"\bi(?:'d| would) rather not\b", r"\b(?:isn't|is not|not) possible for me to\b",
        r"\bno (?:entry|profile|answer|assessment) (?:will|can) be (?:written|given|made|provided)", r"\bis not something i (?:do|can)\b",
        r"\bbeyond what i(?:'m| am) (?:allowed|able|permitted)", r"\bmy (?:rules|guidelines|policies|policy) (?:keep|prevent|forbid|do(?:n't| not) allow|stop)",
        r"\bi(?:'m| am) not (?:allowed|permitted|comfortable|in a position)\b", r"\bi (?:decline|refuse) to\b", r"\bagainst my (?:rules|guidelines|policies|policy)",
    ],
    "de": [
        r"\bkann ich (?:leider |hier |dir |ihnen )*nicht (?:helfen|beantworten|schreiben|dienen|sagen|geben|leisten|erfüllen)", r"\bich kann (?:\w+ ){0,4}nicht (?:helfen|beantworten|weiterhelfen|erfüllen)",
        r"\bmuss ich (?:\w+ )?ablehnen", r"\bich (?:lehne|muss) (?:\w+ ){0,4}ab(?:lehnen)?\b", r"\bmöchte ich mich (?:\w+ )?nicht (?:äußern|äussern)",
        r"\bwerde ich (?:\w+ )?nicht (?:schreiben|erstellen|beantworten|geben|verfassen)", r"\bdarf ich (?:\w+ )?(?:nichts|nicht|keine\w*)\b", r"\btreffe ich (?:\w+ )?nicht",
        r"\bnicht möglich, (?:diese|dieser|ihnen|dir|das)", r"\bist mir (?:leider )?(?:nicht (?:möglich|erlaubt|gestattet)|untersagt)", r"\bwiderspr(?:äche|icht) meinen richtlinien",
    ],
    "fr": [
        r"\bje ne (?:peux|puis|suis pas en mesure|saurais|suis pas autorisée?)\b(?: pas)?", r"\bil m'est impossible\b", r"\bm'est (?:pas )?(?:permis|impossible|interdit)", r"\bdépasse ce qui m'est permis",
        r"\bje (?:n'écrirai|ne rédigerai|ne répondrai|ne donnerai|ne ferai) pas\b", r"\bje préfère ne pas\b", r"\bje (?:dois|me vois contraint de) (?:refuser|décliner)", r"\bje (?:refuse|décline)\b",
        r"\bje n'ai pas le droit\b", r"\bmes (?:règles|directives|consignes) (?:\w+ )?(?:l'|m'|me |le )?(?:interdi|empêch)",
    ],
    "es": [
        r"\bno puedo (?:ayudar|responder|atender|escribir|dar|ofrecer|hacer|cumplir|decir|proporcionar|opinar)", r"\bno (?:escribiré|redactaré|responderé|haré|daré)\b", r"\bno me (?:está|es) (?:permitido|posible)",
        r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme)", r"\bprefiero no\b", r"\bme niego a\b", r"\bno estoy (?:autorizad|en condiciones)", r"\bme es imposible\b", r"\bmis (?:normas|reglas|directrices) (?:me )?lo (?:impiden|prohíben)",
        r"\bsupera lo que (?:me está permitido|puedo)", r"\bno voy a (?:valorar|responder|escribir|opinar|hacer|dar)\b",
    ],
    "ja": [
        r"お手伝い(?:は|が)?(?:でき|いたしかね|致しかね|しかね)", r"(?:回答|お答え|対応|応じること|作成)(?:は|が|に|を)*(?:でき(?:ません|かね)|いたしません|致しません|いたしかね|しかねます|控え|差し控え)", r"お断り(?:し|いた|致)", r"差し控え(?:ます|させ)",
        r"許可されていません", r"許されていません", r"ご要望には(?:沿|応)", r"できかねます", r"申し上げられません", r"作成(?:は)?いたしません",
    ],
}
#: Stems: who declines, what isn't done, and what the answer would have been; by language, for sentences in lower case.
_N = r"[^.!?。！？\n]"  # within a sentence
_TASKS = {
    "en": "help|assist|process|provide|answer|comply|fulfil|do (?:this|that|it|so)|write|create|generate|produce|complete|give|share|discuss|support|respond|continue|offer|carry|handle|engage|take part|participate|accept|honou?r|accommodate|perform|draft|compose|advise|go (?:along|ahead|further)|make (?:this|that|such)|oblige",
    "de": r"helfen|weiterhelfen|behilflich|unterstützen|beantworten|antworten|schreiben|verfassen|erstellen|dienen|geben|leisten|erfüllen|bearbeiten|nachkommen|ausführen|durchführen|liefern|übernehmen|äu(?:ß|ss)ern|entsprechen|anbieten|mitwirken|eingehen|machen",
    "fr": "aider|répondre|traiter|fournir|donner|rédiger|écrire|satisfaire|accéder|faire|assister|accomplir|effectuer|produire|offrir|proposer|réaliser|continuer|participer",
    "es": "ayudar|responder|procesar|proporcionar|atender|escribir|dar|ofrecer|hacer|cumplir|opinar|realizar|completar|generar|redactar|asistir|acceder|contestar|colaborar",
    "it": "aiutar|rispond|fornir|elabor|soddisf|scriver|dar|far|esegu|complet|assister|redig|procedere",
    "pt": "ajud|respond|process|fornec|atend|escrev|dar|faz|cumpr|realiz|ger|complet|redig",
    "nl": "helpen|beantwoorden|antwoorden|verwerken|geven|schrijven|doen|voldoen|uitvoeren|leveren|ingaan|meewerken",
    "ru": "помоч|ответ|предостав|выполн|обработ|напис|сдела|дать",
}
STEMS = {
    "en": [
        rf"\bi (?:\w+ )?(?:can(?:no|')?t|can not|couldn't|could not|won't|will not|shall not|(?:do not|don't) (?:wish|want|feel able) to) (?:\w+ ){{0,3}}?(?:{_TASKS['en']})",
        rf"\bi(?:'m| am) (?:\w+ )?(?:unable|not (?:able|willing|going|prepared|in a position)) to (?:\w+ ){{0,2}}?(?:{_TASKS['en']})",
        r"\bi (?:\w+ )?(?:must|have to|need to|will|'ll|shall)? ?(?:\w+ )?(?:decline|refuse|abstain|refrain)\b", r"\bi(?:'d| would)? (?:rather|prefer) not\b|\bi(?:'d| would) prefer not\b",
        r"\bi(?:'m| am) (?:\w+ )?(?:not (?:allowed|permitted|authori[sz]ed|comfortable)|forbidden|prohibited)\b",
        rf"\b(?:request|question|task|query|instruction|prompt|this|that)s? (?:cannot|can't|can not|will not|won't|may not) be (?:answered|fulfilled|processed|completed|done|granted|met|honou?red|handled)",
        rf"\b(?:beyond|outside|exceeds|against|violates?|contrary to|not within) (?:of )?(?:what i\b|(?:my|our) (?:\w+ )?(?:rules?|guidelines?|polic|scope|remit|authority|abilit|capabilit|permission|instruction|principle))",
        r"\b(?:my|our) (?:\w+ )?(?:rules|guidelines|policies|policy|instructions|principles) (?:keep|prevent|forbid|stop|prohibit|do(?:es)?(?:n't| not) (?:allow|let|permit))", r"\bimpossible for me to\b|\b(?:is not|isn't) something i (?:can|do|will|am)\b",
    ],
    "de": [
        rf"\b(?:ich (?:\w+ )?(?:kann|könnte|werde|darf|möchte|will)|(?:kann|werde|darf|möchte|will) ich)\b{_N}{{0,60}}?\b(?:nicht|nichts|keine\w*)\b{_N}{{0,40}}?\b(?:{_TASKS['de']})\b",
        rf"\b(?:muss ich|müssen wir|ich muss|wir müssen|möchte ich|werde ich)\b{_N}{{0,60}}\b(?:ablehnen|verweigern|enthalten|absehen|zurückweisen|passen)\b", r"\bich (?:lehne|verweigere|enthalte mich|verzichte)\b|\benthalte ich mich\b|\bsehe ich (?:\w+ )?ab\b",
        rf"\b(?:übersteigt|überschreitet|widerspricht|verstößt gegen|liegt außerhalb)\b{_N}{{0,30}}\b(?:meine?\w*|unsere?\w*)\b", r"\b(?:bin|sind) (?:ich |wir )?(?:\w+ ){0,2}(?:nicht (?:befugt|berechtigt|in der lage|imstande|ermächtigt|bereit)|außerstande)",
        r"\bist (?:es )?(?:mir|uns) (?:\w+ )?(?:nicht (?:möglich|erlaubt|gestattet)|untersagt|verboten|unmöglich)", rf"\b(?:anfrage|frage|bitte|aufgabe|wunsch)\b{_N}{{0,30}}\b(?:kann|wird|darf)\b{_N}{{0,20}}\bnicht (?:beantwortet|erfüllt|bearbeitet|ausgeführt|entsprochen)",
    ],
    "fr": [
        rf"\bje (?:ne |n')(?:peux|puis|pourrai|pourrais|saurais|veux|souhaite|vais|désire)\b{_N}{{0,40}}?(?:{_TASKS['fr']})", r"\bje ne suis pas (?:\w+ )?(?:en mesure|autorisée?|habilitée?|capable|disposée?)",
        r"\bje (?:\w+ )?(?:m'abstiens|m'abstiendrai|refuse|décline|me refuse|préfère ne|préférerais ne|dois (?:\w+ )?(?:refuser|décliner|m'abstenir))", r"\bm'est (?:\w+ )?(?:impossible|interdit|défendu)|\bne m'est pas (?:permis|possible)",
        rf"\b(?:dépasse|outrepasse|excède|sort d|contraire à|contrevient à|viole)\w*{_N}{{0,20}}\b(?:mes|mon|ma|m')", rf"\b(?:demande|question|requête)\b{_N}{{0,20}}\bne (?:peut|sera|pourra)\b{_N}{{0,12}}(?:pas|être)",
    ],
    "es": [
        rf"\bno (?:puedo|podré|podría|voy a|quiero|deseo|debo)\b{_N}{{0,30}}?\b(?:{_TASKS['es']})\w*", r"\bno me (?:es|está|resulta|siento) (?:\w+ )?(?:posible|permitid[oa]|cómod[oa])", r"\b(?:me abstengo|me abstendré|me niego|rechazo|declino|prefiero no|preferiría no|rehúso)\b",
        r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme|abstenerme)", rf"\b(?:supera|excede|sobrepasa|infringe|viola|va (?:en )?contra|(?:está|queda) fuera)\b{_N}{{0,20}}\b(?:mis?|puedo|me)\b", r"\bno (?:estoy|me encuentro) (?:\w+ )?(?:autorizad|en condiciones|capacitad|facultad|dispuest)",
        rf"\b(?:solicitud|petición|pregunta)\b{_N}{{0,20}}\bno (?:puede|podrá|será)\b",
    ],
    "it": [rf"\bnon (?:posso|potrò|potrei|voglio|intendo)\b{_N}{{0,30}}?\b(?:{_TASKS['it']})\w*", r"\bnon (?:sono (?:in grado|autorizzat|dispost|abilitat)|mi è (?:possibile|permesso|consentito))", r"\b(?:mi rifiuto|mi astengo|declino|preferisco non|preferirei non|devo (?:rifiutare|declinare|astenermi))"],
    "pt": [rf"\bnão (?:posso|poderei|poderia|consigo|vou|quero)\b{_N}{{0,30}}?\b(?:{_TASKS['pt']})\w*", r"\bnão (?:estou (?:autorizad|em condições|apt)|me é (?:possível|permitido))", r"\b(?:recuso|me recuso|recuso-me|abstenho-me|prefiro não|devo (?:recusar|declinar))\b"],
    "nl": [rf"\b(?:ik (?:kan|mag|wil|zal)|(?:kan|mag|wil|zal) ik)\b{_N}{{0,50}}?\b(?:niet|geen)\b{_N}{{0,30}}?\b(?:{_TASKS['nl']})\b", r"\bik (?:weiger|onthoud mij|onthoud me)\b|\bmoet ik (?:\w+ )?(?:weigeren|afwijzen)\b|\bben (?:ik )?niet (?:bevoegd|in staat|gemachtigd)"],
    "ru": [rf"\bне (?:могу|буду|смогу|вправе|хочу)\b{_N}{{0,30}}?(?:{_TASKS['ru']})", r"\bя (?:отказываюсь|вынужден\w* отказать|воздерж)"],
    "ja": [
        r"お役に立て(?:ません|ず)", r"対応(?:し|いた)?(?:かね|できません|できない)", r"応じ(?:かね|られません|られない|ることはできません)", r"(?:回答|返答)(?:を|は)?(?:控え|拒否|差し控)", r"お(?:答え|受け|引き受け)(?:することは)?でき(?:ません|かね)", r"提供(?:すること)?(?:は|が)?(?:でき(?:ません|かね)|いたしかね)",
        r"ご?遠慮(?:いたし|させて|し)ます?", r"辞退", r"(?:権限|範囲)(?:を超え|がありません|外です)",
    ],
    "zh": [r"(?:我|恕)(?:无法|不能|不会|拒绝|不便|难以|难)[^。！？\n]{0,12}(?:帮助|帮忙|帮|协助|回答|提供|处理|完成|满足|回应|撰写|生成|从命|这样做)"],
    "ko": [r"(?:도와드릴|도울|답변(?:해 ?드릴|할|드릴)|제공(?:해 ?드릴|할)|처리(?:해 ?드릴|할)|작성(?:해 ?드릴|할)|응할|답할) 수 (?:가 )?없", r"거절(?:합니다|하겠)"],
}
#: One of its language's stands in every refusal that the patterns know; the automaton of them rules most answers out.
TRIGGERS = {
    "en": "i can|i am |i'm |i won't|i will|i have to|i must|i need to|i shall|i'll |i do not|i don't|i could|i simply|i really|i unfortunately|i regret|i respectfully|i therefore|i would|i'd |i prefer|i decline|i refuse|i abstain|i refrain|possible for me|no entry|no profile|no answer|no assessment|something i | be answered| be fulfilled| be processed| be completed| be done| be granted| be met| be honor| be honour| be handled|what i |my rule|our rule|guideline|polic|instruction|principle|remit|my scope|our scope|authority|my abilit|capabilit|permission",
    "de": "kann ich|ich kann|ich könnte|ich werde|werde ich|ich darf|darf ich|ich möchte|möchte ich|ich will|will ich|muss ich|ich muss|müssen wir|wir müssen|ich lehne|ich verweig|ich enthalte|enthalte ich|ich verzichte|sehe ich|treffe ich|nicht möglich|ist mir|ist uns|ist es mir|ist es uns|übersteigt|überschreitet|widersp|verstößt|außerhalb|bin ich|ich bin|wir sind|sind wir|nicht beantwortet|nicht erfüllt|nicht bearbeitet|nicht ausgeführt|nicht entsprochen|meinen richtlinien",
    "fr": "je ne |je n'|je m'|je refuse|je décline|je me |je préfère|je préférerais|je dois|m'est |dépasse|outrepasse|excède|sort d|contraire à|contrevient|viole|ne peut|ne sera|ne pourra|mes règles|mes directives|mes consignes",
    "es": "no puedo|no podr|no voy|no quiero|no deseo|no debo|no escribiré|no redactaré|no responderé|no haré|no daré|no me |debo |tengo que|prefiero no|preferiría no|me niego|me abst|rechazo|declino|rehúso|no estoy|me encuentro|me es imposible|mis normas|mis reglas|mis directrices|supera|excede|sobrepasa|infringe|viola|contra|fuera|no puede|no será",
    "it": "non posso|non pot|non voglio|non intendo|non sono|non mi è|mi rifiuto|mi astengo|declino|preferisco non|preferirei non|devo ",
    "pt": "não posso|não poder|não consigo|não vou|não quero|não estou|não me é|recuso|abstenho|prefiro não|devo ",
    "nl": "ik kan|kan ik|ik mag|mag ik|ik wil|wil ik|ik zal|zal ik|ik weiger|ik onthoud|moet ik|ben ik|ben niet|ik ben",
    "ru": "не могу|не буду|не смогу|не вправе|не хочу|я отказ|я вынужд|я воздерж",
    "ja": "手伝い|ません|かね|控え|断り|ご要望|役に立|できない|られない|拒否|遠慮|辞退|権限|範囲",
    "zh": "无法|不能|不会|拒绝|不便|难",
    "ko": "수 없|수가 없|거절",
}
_REFUSAL = {k: re.compile("|".join([*REFUSALS.get(k, []), *STEMS.get(k, [])]), re.I) for k in TRIGGERS}
#: A refusing sentence that begins in the opening, or refusing sentences that take up this share of the text, make a refusal.
REFUSAL_OPENING, REFUSAL_SHARE = 160, 0.1
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
_QUOTED = re.compile(r"(?m)^\s*>.*$|“[^”]*”|„[^“”]*[“”]|«[^»]*»")

LANGUAGE_NAMES = {
    "en": "english|englisch\\w*|anglais|inglés|ingles|英語",
    "de": "german|deutsch\\w*|allemand|alemán|aleman|ドイツ語|独語",
    "fr": "french|französisch\\w*|français|francais|francés|frances|フランス語|仏語",
    "es": "spanish|spanisch\\w*|espagnol|español|espanol|castellano|スペイン語|西語",
    "ja": "japanese|japanisch\\w*|japonais|japonés|japones|日本語",
}
_ASKED = {k: re.compile(rf"(?:\b(?:in|into|to|auf|ins|en|al)\s+(?:the\s+)?(?:{v})\b|(?:{v})で|(?:{v})に(?:訳|翻訳))", re.I) for k, v in LANGUAGE_NAMES.items()}
#: Away from the ends of a question a language is asked for where its sentence requests something; elsewhere it is data.
_REQUEST = re.compile(
    r"\b(?:please|write|answer|reply|respond|translate|give|provide|return|output|summari[sz]e|bitte|schreib\w*|antwort\w*|übersetz\w*|verfass\w*|gib|formulier\w*"
    r"|veuillez|répond\w*|écri\w*|rédige\w*|tradui\w*|donne\w*|por favor|respond\w*|contest\w*|escrib\w*|redact\w*|traduc\w*|traduzc\w*)\b|ください|下さい|答え|書い|訳し",
    re.I,
)
_KEYS = re.compile(r'"[A-Za-z_]+"\s*:')

#: Share of an answer's bytes that a compressor may need beyond a frame's own when it knows the question.
COPY_SHARE = 0.28
COPY_OVERHEAD = 10
COPY_LEVEL = 3
#: … and of what a compressor needs that doesn't: an answer that repeats itself is no copy.
COPY_GAIN = 0.5
#: Share of the question that may be missing from a copy: of the bytes that a compressor needs, those that it needs knowing the answer.
COPY_LACKS = 0.5
#: Bytes of an introduction to a short question.
INTRODUCTION = 80


def bare(text: str) -> str:
    """Without markers and fences, and without white space at its ends."""
    return INVISIBLE.sub(" ", FENCE.sub(" ", MARKER.sub(" ", text))).strip()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if "<" in answer:
        answer = MARKER.sub(" ", answer)
    if "`" in answer or "~" in answer:
        answer = FENCE.sub(" ", answer)
    return bool(NOTHING.fullmatch(answer))


_AUTOMATON: list = []


def _languages(low: str) -> list[str]:
    """Languages of which a trigger stands in a text in lower case."""
    if not _AUTOMATON:
        a, of = ahocorasick.Automaton(), {}
        for lang, words in TRIGGERS.items():
            for w in words.split("|"):
                of.setdefault(w, []).append(lang)
        for w, langs in of.items():
            a.add_word(w, langs)
        a.make_automaton()
        _AUTOMATON.append(a)
    return sorted({lang for _, langs in _AUTOMATON[0].iter(low) for lang in langs})


def is_refusal(answer: str) -> bool:
    answer = answer.replace("’", "'")
    patterns = [_REFUSAL[k] for k in _languages(answer.lower())]
    if not any(p.search(answer) for p in patterns):
        return False
    t = bare(answer)
    if not t:
        return False
    if t[0] in "{[":  # the values of an object are texts of their own
        return any(_mainly_refuses(v, patterns) for v in _STRING.findall(t)) or not _STRING.search(t) and _mainly_refuses(t, patterns)
    # What an answer quotes is not its own; quoted lines are only told before white space is joined.
    return _mainly_refuses(bare(_QUOTED.sub(" ", answer)), patterns)


def _mainly_refuses(text: str, patterns: list[re.Pattern]) -> bool:
    """By the position and the share of the refusing sentences of the whole text."""
    refusing = 0
    for m in _SENTENCE.finditer(text):
        at = min((r.start() for p in patterns if (r := p.search(m.group()))), default=-1)
        if at >= 0:
            if m.start() + at < REFUSAL_OPENING:
                return True
            refusing += len(m.group())
    return refusing >= REFUSAL_SHARE * len(text) and refusing > 0


def _needed(data: bytes, known: bytes) -> int:
    """Bytes that a compressor needs for ``data`` which has ``known`` as its dictionary, beyond a frame's own."""
    held = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return max(len(zstandard.ZstdCompressor(level=COPY_LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress(data)) - COPY_OVERHEAD, 0)


def copied_share(question: str, answer: str) -> float:
    """Bytes per byte of the answer that a compressor needs which knows the question; 1 for one that gives back little of it.

    An introduction may come before the question: the answer's part of the question's length at its end counts alone, too,
    where it is most of the answer or the rest is a sentence's worth.
    """
    a, q = bare(answer).casefold().encode(), bare(question).casefold().encode()
    if not a or not q:
        return 1.0
    if len(a) < 2 * COPY_OVERHEAD:  # too short to be compressed
        return 0.0 if a in q and 2 * len(a) >= len(q) else 1.0

    def share(part: bytes) -> float:
        needed = _needed(part, q)
        if needed > COPY_SHARE * len(part):
            return needed / len(part)
        if needed > COPY_GAIN * len(_alone().compress(part)):
            return 1.0
        return needed / len(part) if _needed(q, part) <= COPY_LACKS * len(_alone().compress(q)) else 1.0

    whole = share(a)
    if whole > COPY_SHARE and len(q) < len(a) <= len(q) + INTRODUCTION:
        return min(whole, share(a[-len(q) :]))
    return whole


_ALONE: list = []


def _alone():
    if not _ALONE:
        _ALONE.append(zstandard.ZstdCompressor(level=COPY_LEVEL, write_content_size=False))
    return _ALONE[0]


def asked_languages(question: str) -> set[str]:
    """Languages asked for: named near either end, or anywhere in a sentence that requests something."""
    tail = question[-160:] + "\n" + question[:160]
    asked = {k for k, p in _ASKED.items() if p.search(tail)}
    if any(p.search(question) for p in _ASKED.values()):
        requests = [s for s in _SENTENCE.findall(question) if _REQUEST.search(s)]
        asked |= {k for k, p in _ASKED.items() if any(map(p.search, requests))}
    return asked


def language_text(text: str) -> str:
    if "<" in text or "`" in text:
        text = bare(text)
    return _KEYS.sub(" ", text) if '":' in text else text


def label_pairs(pairs: DataFrame, model: LanguageModel, copy_share: float = COPY_SHARE, margin: float = 6.0) -> DataFrame:
    """``pairs(regen_id BIGINT, msg_pos INT, question, answer, cut BOOLEAN)`` -> ``(regen_id, msg_pos, defect)``.

    ``defect`` is null for a sound answer. A null question can neither be copied nor have a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            questions, answers, cuts = (batch.column(i).to_pylist() for i in (2, 3, 4))
            labels: list[str | None] = []
            ask, of = [], []
            for i, (q, a, cut) in enumerate(zip(questions, answers, cuts)):
                label = None
                if is_empty(a):
                    label = "empty"
                elif is_refusal(a):
                    label = "refusal"
                elif q and copied_share(q, a) <= copy_share:
                    label = "copy"
                elif cut:
                    label = "truncated"
                elif q:
                    ask.append(i)
                labels.append(label)
            if ask:
                lq, sq = model.detect([language_text(questions[i]) for i in ask], margin)
                la, sa = model.detect([language_text(answers[i]) for i in ask], margin)
                for k, i in enumerate(ask):
                    if lq[k] and la[k] and lq[k] != la[k] and la[k] not in asked_languages(questions[i]):
                        labels[i] = "wrong_language"
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(labels, pa.string())], names=["regen_id", "msg_pos", "defect"])

    return pairs.select("regen_id", "msg_pos", "question", "answer", "cut").mapInArrow(run, "regen_id long, msg_pos int, defect string")


def question_answer_pairs(conversations: DataFrame, row: str, messages: str) -> DataFrame:
    """``(row, msg_pos, question, answer)`` for each assistant message right after a user message."""
    m = F.col(messages)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.struct(i.cast("int").alias("msg_pos"), F.get(m, i - 1).alias("q"), F.get(m, i).alias("a"))),
        lambda p: (p["q"]["role"] == "user") & (p["a"]["role"] == "assistant"),
    )
    exploded = conversations.where(F.size(m) >= 2).select(row, F.explode(pairs).alias("p"))
    return exploded.select(row, F.col("p.msg_pos").alias("msg_pos"), F.col("p.q.content").alias("question"), F.col("p.a.content").alias("answer"))
