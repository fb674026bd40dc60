"""Defective prompt and response pairs (problem 7).

One label a pair, the first that holds:

* ``vazia``: no real content (as in ``truncation``);
* ``copia``: the response, normalised, is the prompt, or compressed with the prompt as the
  zstandard dictionary takes at most the share ``copy_limit`` of its size compressed alone; of
  an answer with keys, each text value at least half as long as the prompt's longest passage
  is held against the prompt instead (shorter ones are what was asked for);
* ``recusa``: an answer without any structure has a refusal phrase of some language in one of
  its first two sentences, or anywhere later in a sentence of its own that isn't quoted or
  taken from the prompt and in which the phrase declines a task in the first person;
* ``outro_idioma``: the answer's own words (without quoted terms, names, numbers, addresses
  and the known keys) are of another script, or function words of another language
  outweigh the Portuguese ones;
* ``truncada``: the terminal-context model of ``truncation`` says that it was cut.

A null prompt can't be copied; everything else works on the response alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.llm import truncation
from velatura.session import stage

# Phrases that decline a task, by language
REFUSALS = {
    "pt": r"n[ãa]o (?:posso|consigo|vou|devo|poderei|me é possível|é possível) (?:\w+ ){0,3}?(?:ajudar|atender|processar|realizar|fornecer|listar|extrair|cumprir|responder|fazer|auxiliar|prosseguir|colaborar|tratar|compartilhar|identificar|continuar|executar|concluir)|recuso(?:-me)?\b|me recuso|prefiro n[ãa]o|impedid[oa] de|n[ãa]o (?:será|sera) processad|envolve informa[çc][ãa]o sens[íi]vel|n[ãa]o estou autorizad|n[ãa]o tenho (?:permiss|autoriza)",
    "en": r"\b(?:can(?:no|')t|can not|won't|will not|unable to|not able to|not allowed to|must decline|have to decline|decline to|refuse to) ?(?:\w+ ){0,4}?(?:help|assist|comply|process|provide|extract|fulfil|fulfill|do|share|list|answer|this|complete|continue|to|with)?|i(?:'m| am) sorry",
    "es": r"\bno (?:puedo|podr[ée]|debo|voy a|me es posible) \w+|me niego|prefiero no|lo siento",
    "fr": r"\bje (?:ne peux|ne puis|refuse|regrette|suis désolé)|désolé",
    "de": r"\b(?:kann|darf) ich (?:\w+ )*nicht|ich (?:kann|darf|werde) (?:\w+ )*nicht|tut mir leid|leider kann",
    "it": r"\bnon posso \w+|mi dispiace|mi rifiuto",
    "zh": "抱歉|对不起|對不起|无法|無法|不能(?:提供|帮助|协助|处理)|拒绝",
    "ja": "申し訳|できません|お断り",
    "ko": "죄송|(?:할|드릴|될) ?수(?:가|는)? ?없(?:습니다|어요|음)|거절합니다|거부합니다",
    "ru": r"\b(?:я )?не (?:могу|смогу|буду|имею права) \w+|отказываюсь|вынужден\w* отказать|извините|сожалею",
    "ar": "لا أستطيع|لا يمكنني|لن أتمكن|لن أقوم|غير قادر على|أعتذر|عذر[اًا]|آسف|أرفض",
    "hi": "क्षमा करें|माफ़? ?कीजिए|माफ़ करें|नहीं कर सक(?:ता|ती|ते)|असमर्थ हूँ|मना करता हूँ|(?:मदद|सहायता) नहीं कर",
    "th": "ขออภัย|ขอโทษ|ไม่สามารถ(?:ช่วย|ให้|ดำเนินการ|ทำ|ประมวลผล|ตอบ)|ขอปฏิเสธ",
    "nl": r"\bik (?:kan|mag|zal) (?:\w+ ){0,4}?niet|het spijt me|ik weiger",
    "pl": r"\bnie mogę \w+|przykro mi|odmawiam",
    "tr": r"üzgünüm|yardımcı olamam|reddediyorum",
    "vi": r"xin lỗi|tôi không thể",
}
# What declines a task wherever it stands; shorter phrases count in an opening only
_TASK = r"(?:help|assist|comply|process|provide|extract|fulfil|fulfill|share|list|answer|complete|continue)"
ANYWHERE = REFUSALS | {
    "pt": REFUSALS["pt"].split("|recuso", 1)[0] + r"|\b(?:eu )?me recuso\b|\brecuso-me\b|(?:estou|sou|fui) impedid[oa] de|n[ãa]o estou autorizad[oa] a|n[ãa]o tenho (?:permiss|autoriza)",
    "en": rf"\bI(?:'m| am)? (?:can(?:no|')t|can not|won't|will not|unable to|not able to|not allowed to|must decline|have to decline|decline to|refuse to) (?:\w+ ){{0,4}}?{_TASK}\b|\bI(?:'m| am) sorry,? but",
    "es": r"\bno (?:puedo|podr[ée]) (?:\w+ ){0,2}?(?:ayudar|atender|procesar|realizar|proporcionar|extraer|cumplir|responder|continuar|compartir)\w*|me niego a",
    "fr": r"\bje (?:ne peux|ne puis) (?:pas )?(?:\w+ ){0,2}?(?:aider|traiter|fournir|extraire|répondre|continuer|partager)|je refuse de",
    "de": r"\b(?:kann|darf|werde) ich (?:\w+ )*nicht (?:\w+ )*(?:helfen|bearbeiten|bereitstellen|verarbeiten|extrahieren|beantworten|erfüllen)|\bich (?:kann|darf|werde) (?:\w+ )*nicht (?:\w+ )*(?:helfen|bearbeiten|bereitstellen|verarbeiten|extrahieren|beantworten|erfüllen)",
    "it": r"\bnon posso (?:\w+ )?(?:aiutar|fornir|elaborar|estrarr|risponder|continuar)\w*|mi rifiuto di",
    "zh": "(?:我|抱歉|对不起|對不起)[^。!?]{0,12}(?:无法|無法|不能)(?:提供|帮助|协助|处理|完成|回答)|(?:我|必须)拒绝",
    "ja": "(?:ご要望|お手伝い|対応|提供|お答え|抽出)[^。]{0,8}できません|お断り(?:し|いた)",
}
# Closed-class words (articles, prepositions, pronouns, conjunctions, auxiliaries, adverbs)
FUNCTION_WORDS = {
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas num numa por pelo pela pelos pelas para com sem sob sobre entre até desde após ao aos à às e ou mas nem que se como quando porque pois porém embora conforme segundo eu ele ela eles elas nós você vocês me lhe lhes seu sua seus suas meu minha este esta estes estas isto esse essa esses essas isso aquele aquela aquilo qual quais quem cujo cuja todo toda todos todas outro outra outros outras algum alguma alguns algumas nenhum nenhuma cada mesmo mesma demais é são foi foram ser era eram está estão estava estar há houve ter tem têm tinha haver pode podem posso deve devem não sim já ainda também só apenas mais menos muito muita bem aqui ali abaixo acima depois antes hoje além onde".split(),
    "es": "el la los las un una unos unas de del en por para con sin sobre entre hasta desde tras al a y e o u pero ni que si como cuando porque pues aunque según yo él ella ellos ellas nosotros usted ustedes me le les lo su sus mi mis este esta estos estas esto ese esa esos esas eso aquel aquella cual cuales quien cuyo todo toda todos todas otro otra otros otras algún alguna algunos algunas ningún ninguna cada mismo misma demás es son fue fueron ser era eran está están estaba estar hay hubo haber ha han tiene tienen puede pueden puedo debe deben hace no sí ya aún también sólo solo más menos muy mucho bien aquí allí abajo arriba después antes hoy además donde siguientes se".split(),
    "en": "the a an of in on at by for with without from to into over under between after before about through and or but nor that if as when while because than so not i you he she it we they me him her us them my your his its our their this these those who whom which whose all any each every some other others no only own same is are was were be been being am do does did has have had having can could may might must shall should will would there here what where how very also just more most such then yes sure now".split(),
    "fr": "le la les un une des de du en dans par pour avec sans sous sur entre vers chez à au aux et ou mais ni que qui dont où si comme quand lorsque car je tu il elle nous vous ils elles on me te se lui leur leurs mon ma mes ton ta son sa ses notre votre ce cet cette ces cela ceci tout toute tous toutes autre autres quelque aucun aucune chaque même est sont était étaient être été a ont avait avoir peut peuvent doit doivent ne pas plus moins très aussi bien ici là voici voilà après avant".split(),
    "de": "der die das den dem des ein eine einen einem einer eines in im an am auf aus bei mit nach von vom zu zum zur für über unter durch um ohne und oder aber denn dass wenn als wie weil ob ich du er sie es wir ihr mich mir dich ihm ihn uns euch mein sein ihre ihren dieser diese dieses diesem diesen jener welche alle alles andere anderen kein keine jeder jede selbst ist sind war waren sein bin hat haben hatte kann können darf muss soll wird werden worden nicht auch nur noch schon sehr mehr hier dort da so dann danach".split(),
    "it": "il lo la i gli le un uno una di del dello della dei degli delle in nel nello nella nei negli nelle da dal dalla a al allo alla ai agli alle con su sul sulla per tra fra senza e ed o ma né che se come quando perché mentre io tu lui lei noi voi loro mi ti si ci vi suo sua suoi sue mio questo questa questi queste quello quella quale quali chi cui tutto tutta tutti tutte altro altra altri altre alcuni alcune nessun nessuna ogni stesso è sono era erano essere stato ha hanno aveva avere può possono deve devono non più meno molto anche solo qui lì dopo prima sotto sopra".split(),
}
_WORDS_OF = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _WORDS_OF.setdefault(_w, set()).add(_l)

_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS.values()), re.I)
_REFUSAL_ANYWHERE = re.compile("|".join(f"(?:{x})" for x in ANYWHERE.values()), re.I)
_SENTENCE = re.compile(r"[^.!?…。！？।॥؟\n]+")
_KEYS = re.compile(r'"(?:map_\w+|duvidas_pendentes|classificacao)"\s*:')
_OTHER_KEY = re.compile(r'"(\w+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)")?')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|“[^”]*”|«[^»]*»|\[ [A-Z]+ \d+ \]')
_NAMELIKE = re.compile(r"\S*[@＠\d_]\S*|\b[A-ZÀ-Þ][\w'’.-]*(?:[ ]+(?:d[aeo]s?|e|[A-ZÀ-Þ][\w'’.-]*))+")
_WORD = re.compile(r"[^\W\d_]+")
_NON_LATIN = re.compile(r"[\u0370-\u1cff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_FLAT = re.compile(r"[\W_]+")


def own_words(answer: str) -> str:
    """The answer without quoted terms and the known keys; other keys and their texts stay."""
    if '"' in answer:
        extra = " . ".join(f"{k.replace('_', ' ')} {v}" for k, v in _OTHER_KEY.findall(answer) if not (k.startswith("map_") or k in ("duvidas_pendentes", "classificacao")))
        answer = _QUOTED.sub(" ", _KEYS.sub(" ", answer)) + " " + extra
    return answer


def refuses(prompt: str | None, answer: str) -> bool:
    """The answer declines the task, in its opening or later in its own words."""
    if any(_REFUSAL.search(m.group()) for m in islice(_SENTENCE.finditer(answer), 2)):
        return True
    if not _REFUSAL_ANYWHERE.search(answer):
        return False
    given = f" {_flat(prompt or '')} "
    own = (m.group() for m in _SENTENCE.finditer(_QUOTED.sub(" ", answer)))
    return any(_REFUSAL_ANYWHERE.search(s) and f" {_flat(s)} " not in given for s in own)


def foreign(answer: str) -> bool:
    own = own_words(answer)
    if "```" in own:
        own = own.replace("```json", " ")
    if not _WORD.search(own):
        return False
    odd = len(_NON_LATIN.findall(own))
    if odd >= 4 and odd >= 0.2 * sum(map(len, _WORD.findall(_NAMELIKE.sub(" ", own)))):
        return True
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    words = _WORD.findall(own.casefold())
    for w in words:
        ls = _WORDS_OF.get(w)
        if ls:
            for l in ls:  # noqa: E741
                score[l] += 1 / len(ls)
    best = max(score, key=score.get)
    return best != "pt" and score[best] >= 2 and score[best] > 1.4 * score["pt"]


class _Marks(dict):
    """Deletes combining marks in ``str.translate``; each character is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.combining(chr(code)) else code
        return self[code]


_PLAIN = _Marks()


def _flat(text: str) -> str:
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_PLAIN)
    return _FLAT.sub(" ", text).strip()


def copy_rate(prompt: str | None, answer: str) -> float:
    """Compressed size with the prompt as dictionary over the size without; 0 if equal, 9 if either is empty."""
    p, a = _flat(prompt or "").encode(), _flat(answer).encode()
    if not a or not p:
        return 9.0
    if a == p:
        return 0.0
    alone = len(zstandard.ZstdCompressor(level=3).compress(a)) - 9
    given = len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(a)) - 9
    return max(0, given) / max(1, alone)


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)')
_PASSAGE = re.compile(r'\n\s*\n|"{3,}|`{3,}')


def copied_value(prompt: str | None, answer: str, copy_limit: float) -> bool:
    """A text value of an answer with keys gives back a passage of the prompt."""
    longest = max(map(len, _PASSAGE.split(prompt or "")), default=0)
    return longest > 0 and any(2 * len(v) >= longest and copy_rate(prompt, v.replace("\\n", "\n")) <= copy_limit for v, key in _STRING.findall(answer) if not key)


def defect(prompt: str | None, answer: str | None, copy_limit: float) -> tuple[str | None, str | None, str | None]:
    """(defect but for the cut ones, state, folded last line)."""
    st, tail = truncation.state(answer)
    if st == "vazio":
        return "vazia", st, tail
    structured = '"' in answer and "{" in answer
    keyed = structured and ("map_" in answer or "classificacao" in answer)
    if copied_value(prompt, answer, copy_limit) if keyed else copy_rate(prompt, answer) <= copy_limit:
        return "copia", st, tail
    if not structured and refuses(prompt, answer):
        return "recusa", st, tail
    if foreign(answer):
        return "outro_idioma", st, tail
    return None, st, tail


def _judge(copy_limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [defect(p, a, copy_limit) for p, a in zip(b["prompt"], b["answer"])]
            out = pd.DataFrame(got, columns=["defeito", "estado", "fim"])
            out.insert(0, "id", b["id"].to_numpy())
            out.insert(1, "source", b["source"].to_numpy())
            yield pd.concat([out, truncation.marks(b["answer"])], axis=1)

    return run


def defective(pairs: DataFrame, copy_limit: float = 0.3, makers: DataFrame | None = None) -> DataFrame:
    """(source, id, defeito) of pairs (source, id, prompt, answer).

    ``makers`` (source, id, maker) says which model gave an answer; endings are natural per source and maker.
    """
    judged = pairs.select("id", "source", "prompt", "answer").mapInPandas(_judge(copy_limit), "id long, source string, defeito string, estado string, fim string, marca long, curto boolean")
    judged = stage(judged.select("id", "source", "defeito", F.struct("estado", "fim", "marca", "curto").alias("s")), "pairs")
    group = ["source"]
    if makers is not None:
        judged, group = judged.join(makers, ["source", "id"], "left"), ["source", "maker"]
    return truncation.cut(judged, group).select("source", "id", F.coalesce("defeito", F.when(F.col("cortado"), F.lit("truncada"))).alias("defeito")).where("defeito IS NOT NULL")
