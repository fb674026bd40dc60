"""Personal information inside free text (problem 5).

Weak supervision in three steps:

1. ``candidates`` reads each text once and yields every span that could be of a kind (EMAIL,
   PHONE, IDNUM, ADDRESS, NAME) with the votes of that kind's labelers (+1, 0, -1) and a few
   features of the span itself. The labelers are patterns, gazetteers (first and last names and
   places of the knowledge table), word lists and the words around the span. None of them drops
   a span: what speaks against one is a vote.
2. Votes are counted over the whole corpus, and expectation-maximisation estimates each
   labeler's reliability from these counts; the beliefs it starts from weigh ``STRENGTH`` rows
   in all, however many spans there are. ``reliabilities`` reports the estimates.
3. A logistic span classifier is trained on the posteriors, with pairs of votes and the span's
   features; it decides every pattern of votes and features, and so every span.

``redact`` puts a typed placeholder in the place of each accepted span. Spans of one text
don't overlap; an earlier kind of KINDS wins. Null and empty texts have no spans. Places
count code points.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.session import stage

KINDS = ["EMAIL", "ADDRESS", "IDNUM", "PHONE", "NAME"]
GAZETTEER_LIMIT = 200_000
#: Rows that the first beliefs weigh, and rows added to each vote, so that a rare one tells little.
STRENGTH = 20.0
SMOOTH = 2.0
# The labelers of each kind with the first belief in them
LABELERS = {
    "EMAIL": {"shape": 0.95, "sign": 0.6, "ending": 0.9, "before": 0.7},
    "ADDRESS": {"number": 0.95, "separator": 0.7, "before": 0.7, "other_number": 0.95, "one_paragraph": 0.6, "kind": 0.7},
    "IDNUM": {"label": 0.95, "shape": 0.9, "other_number": 0.95, "date": 0.98, "phone_word": 0.9},
    "PHONE": {"word_before": 0.9, "word_near": 0.8, "style": 0.85, "digits": 0.7, "after": 0.7, "other_number": 0.98, "other_shape": 0.95},
    "NAME": {"title": 0.95, "lead": 0.85, "after": 0.85, "first_name": 0.85, "last_name": 0.85, "against": 0.98, "crowded": 0.98, "common_word": 0.98, "place_or_start": 0.9},
}

_L = r"[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ]"
_CAP = r"[A-ZÀ-ÖØ-Þ](?:[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ'’-]*[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ])?"
_GAP = r"(?:[ \t ]{1,6}|[ \t ]*\r?\n(?=[a-z]))"
_LINK = r"(?:(?:d[aeo]s?|e|D[AEO]S?|DE|E)" + _GAP + ")?"

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*\s{0,2}(?:@|＠|\[ ?arroba ?\]|\( ?arroba ?\)|\[ ?at ?\]|\( ?at ?\)|(?<=\s)arroba(?=\s))\s{0,2}(?:[a-z0-9-]+(?:(?:\.| ?\[(?:ponto|dot)\] ?| ?\((?:ponto|dot)\) ?)[a-z0-9-]+)+|[A-Z0-9-]+(?:\.[A-Z0-9-]+)+)")
_EMAIL_LEFT = re.compile(r"(?:escrever a|mail\w*|correo|enviado para|ficou em|para|write to|邮箱|メールは)\s*$")
_SIGN = re.compile(r"[@＠]")
_SIGNED = re.compile(r"[A-Za-z0-9._%+-]{0,64}[@＠][A-Za-z0-9._-]+")
_STREET = re.compile(r"\s+" + _L + r"+(?:\s" + _L + "+)?")
_HOUSE = re.compile(r"[,–-]\s*(?:n|s/n|\d)|(?:n[ºo°.]|mero|s/n)")
_NO_PHONE = re.compile(r"\d{3}\.\d{3}\.\d{3}(?:-\d\d)?|\d{4}\.\d{4}-\d|\d{1,3}(?:\.\d{1,3}){3}")
_INSIDE = re.compile(r" de ovo|-d[ae]-", re.I)
# Capitalised words that may stand before a name
_NO_CROWD = {"hoje", "paciente", "sra", "sr", "dr", "dra", "enf", "nurse", "tecnico", "tecnica", "prof", "profa", "mas", "mrs", "entre"}
_EMAIL_HINT = re.compile(r"[@＠]|arroba|\( ?at ?\)|\[ ?at ?\]", re.I)
_KIND = re.compile(
    r"(?:[Rr](?:ua|UA|od(?:ovia)?|OD(?:OVIA)?)?|[Aa](?:v(?:enida)?|V(?:ENIDA)?|l(?:ameda)?|L(?:AMEDA)?)|[Tt](?:rav(?:essa)?|RAV(?:ESSA)?|v|V)|[Pp](?:ra[cç]̧?a|RA[CÇ]̧?A|[cç]̧?a|[CÇ]̧?A)|[Ll](?:ad(?:eira)?|AD(?:EIRA)?|argo|ARGO)|[Bb](?:eco|ECO)|[Ee](?:str(?:ada)?|STR(?:ADA)?)|[Vv](?:ila|ILA|iela|IELA)|[Cc](?:alle|ALLE)|[Qq](?:uadra|UADRA))\.?(?=\s)"
)
_ADDRESS = re.compile(
    r"\s+(?:(?:d[aeo]s?|D[AEO]S?)\s+)?" + _CAP + r"(?:\s+(?:(?:d[aeo]s?|e|D[AEO]S?|E)\s+)?" + _CAP + r"){0,4}?\.?"
    r"(?:\s*,\s*|\s+[-–]\s*|\s+)(?:(?:[nN][ºo°]?\.?|[nN](?:[úu]́?mero|[ÚU]́?MERO)|[nN]\.º)\s*)?(?:\d{1,5}(?:\s?-\s?[A-Z](?![A-Za-z]))?|[sS]/[nN][ºo°]?(?:\.(?=,))?)(?![\w/]|[.,]\d)"
)
_ADDRESS_LEFT = re.compile(r"(?:resident\w*|mora\w*|endere[cç][̧]?o(?: atual)?|entregue|mudou-se|domicili\w*|reside)[\s:]*(?:em|na|no|da|do|para|à|a)?\s*$", re.I)
_NUMBER = re.compile(r"[+(]?\(?\d[\d().\-  ]{4,24}[\dXx](?![A-Za-z0-9_]|[.,/-]\d)")
_GLUED = re.compile(r"[A-Za-z0-9_.,/-]\Z")
_ID_LEFT = re.compile(r"(?:c\.? ?p\.? ?f\.?|\bc\.? ?n\.? ?s\.?|cart[ãa]̃?o (?:do )?(?:sus|nacional(?: de sa[úu]́?de)?)|\br\.? ?g\.?|identidade|cadastro|c[ée]́?dula|pasaporte|passaporte|passport(?: number)?|travel document|identity card|id card|\bdni|\bsus|身份证号?|護照|护照|パスポート|旅券番号?|पासपोर्ट|جواز السفر|جواز|บัตรประชาชน)\s*(?:n[ºo°]?\.?|n[úu]́?mero|no\.|number)?\s*[:：]?\s*(?:n[ºo°]\.?)?\s*$", re.I)
_PHONE_LEFT = re.compile(r"(?:contato(?: de emerg[êe]̂?ncia)?|emerg[êe]̂?ncia|telefone|tel[ée]́?fono|fone|tel\.?|cel(?:ular)?\.?|ligar para|whatsapp|zap|call|phone|mobile|联系电话|電話|电话|連絡先は?|संपर्क|फ़ोन|الاتصال على|هاتف|โทร\.?|ติดต่อ)\s*[:：]?\s*$", re.I)
_PHONE_WIDE = re.compile(r"contato|telefone|tel[ée]fono|fone|ligar|cuidados de|call|phone|联系|連絡|संपर्क|الاتصال|โทร|ติดต่อ", re.I)
_NOT_PERSONAL = re.compile(r"(?:nota fiscal|s[ée]́?rie|lote|protocolo|ramal|sequ[êe]̂?ncia|arm[áa]́?rio|prontu[áa]́?rio|registro|marcador|item|sala|pedido|guia|vers[ãa]̃?o)\s*(?:n[ºo°]?\.?)?\s*[:：]?\s*$", re.I)
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
_CPF = re.compile(r"\d{3}([. ]?)\d{3}\1\d{3}(?: ?- ?|[. ]?)\d{2}")
_CNS = re.compile(r"\d{3}([. ]?)\d{4}\1\d{4}\1\d{4}")
_RG = re.compile(r"\d{1,2}(\.?)\d{3}\1\d{3}(?:-?[\dXx])?")
_PASSPORT = re.compile(r"[A-Z]{2}\d{6,8}")
_PHONE = re.compile(r"(?:\+?\d{1,3}[ .-]?)?(?:\(0?\d{2,3}\)|0?\d{2,3})?[ .-]?\d{3,5}[ .-]?\d{4}")

_TOKEN = re.compile(_CAP)
_NEXT = re.compile(_GAP + _LINK + r"(?:[A-ZÀ-Þ]\.(?=" + _GAP + _LINK + r"[A-ZÀ-Þ])|(" + _CAP + r")(?!\.[A-Za-z]))")
# Words right before a name
TITLES = set("dr. dra. drs. dras. sr. sra. srta. prof. profa. prof.ª enf. enfª. téc. mr. mrs. ms. dona seu enfermeiro enfermeira tecnico tecnica técnico técnica medico medica doutor doutora senhor senhora nurse doctor fisioterapeuta nutricionista psicologo psicologa".split())
LEADS = set("paciente chamada chamado assinado: assinatura: técnico: tecnico: hoje mas acompanhante responsavel: responsável: nome: ass.: atenciosamente, mãe mãe, pai pai, tia tia, tio tio, irmão irmão, irmã irmã, filha filha, filho filho, esposa esposa, esposo esposo, vizinha vizinha, vizinho vizinho, sobrinho sobrinho, sobrinha sobrinha, cuidadora cuidadora, cuidador cuidador, cunhada cunhada, neto neto, neta neta, avó avó, avô avô, prima prima, marido marido,".split())
PHRASES = {tuple(x.split()) for x in ("nome de", "filho de", "filha de", "criança foi", "crianca foi", "falar com", "cuidados de", "pedido de", "presença de", "presenca de", "assinado por", "digitado por", "registrada por", "registrado por", "conversado com", "atendido por", "atendida por", "avaliado por", "avaliada por", "paciente sr", "paciente sra")}
_ENDS = {w[-1] for w in PHRASES}
_RIGHT = re.compile(
    r"^\s*(?:,?\s*(?:que (?:confirma|pediu)|nascid[oa]|moradora?|tia\b|m[ãa]e\b|pai\b|irm|filh|espos|sobrinh|vizinh|cunhad|net[oa]\b|cuidador|av[óô]|cpf|c\.p\.f|cns|rg\b|r\.g|cadastro|identidade|cart[ãa]o|resp\.)|\(r\.n|"
    r"(?:trouxe|percebeu|respondeu|assinou|relat\w+|n[ãa]o quis|insistiu|assume|reviu|discutiram|refiere|denies|advised|indic[óo]|recebeu|por engano|depois das|na presen[cç]a|e a dra?\b|com a prof|at noon|quando|contou|informou|referiu|told|said)\b|[.;]?\s*$|\.\s*\n|\n)",
    re.I,
)
_NEGATIVE = re.compile(
    r"(?:sinal de|manobra de|escala de|teste de|s[íi]ndrome de|doen[cç]a de|hospital(?: \w+)? (?:de|do|da)?|cl[íi]nica|maternidade|upa|ubs|psf|caps|santa casa de|mudan[cç]a para|resid[eo] em|transferid[oa] de|encaminhad[oa] (?:ao|à)|estande do|campanha|bairro|rua|munic[íi]pio de|cidade de|outubro|setembro|novembro|clara de ovo e|lote|urina)\s*$",
    re.I,
)
# Words that never belong to a name, to end one where capitals are used throughout
STOP = set(
    "a o as os e é em no na nos nas com por para sem sob sobre que não nao quis mas foi ser de do da dos das ao à às um uma uns sua seu se já ja mais após apos antes durante hoje ontem depois quando onde como bem trouxe percebeu respondeu assinou relata assume reviu insistiu funcionou pediu orientou confirma nascido nascida moradora morador residente tia tio mãe mae pai irmão irmao irmã filha filho esposa esposo sobrinho sobrinha vizinha vizinho cunhada cunhado neto neta cuidadora cuidador cpf cns rg cadastro identidade cartão cartao telefone contato engano corrigido presença presenca nas pelo pela recebeu alta discutiram refiere denies advised the and indicó at noon los las del el la y resp legal".split()
)


def fold(word: str) -> str:
    """Lower case without accents."""
    w = word.lower()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


class Gazetteer:
    def __init__(self, first: set[str], last: set[str], places: set[str]):
        self.first, self.last, self.places = first, last, places


def gazetteer(knowledge: DataFrame, kind_col: str = "tipo", term_col: str = "texto_original", name: str = "nome", place: str = "endereco") -> Gazetteer:
    """First and last names and places of a knowledge table of at most GAZETTEER_LIMIT terms."""
    rows = knowledge.where(F.col(kind_col).isin(name, place) & F.col(term_col).isNotNull()).select(kind_col, term_col).distinct().limit(GAZETTEER_LIMIT + 1).collect()
    if len(rows) > GAZETTEER_LIMIT:
        raise ValueError(f"more than {GAZETTEER_LIMIT} terms: too many for a gazetteer that every task holds")
    first, last, places = set(), set(), set()
    for k, t in rows:
        ws = [fold(w) for w in t.split()]
        if k == name and ws:
            first.add(ws[0])
            last.update(w for w in ws[1:] if len(w) > 3)
        elif k == place:
            places.update(w for w in ws if len(w) > 3)
    return Gazetteer(first - {"xxxx"}, last, places)


def _email_before(text: str, s: int) -> int:
    return 1 if _EMAIL_LEFT.search(text, max(0, s - 24), s) else 0


class _Taken:
    """Sorted spans of a text that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k == 0 or self.ends[k - 1] <= s

    def add(self, s: int, e: int) -> None:
        k = bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


Span = tuple[str, int, int, tuple[int, ...], str]


def candidates(text: str | None, known: Gazetteer) -> list[Span]:
    """(kind, start, end, votes, features) of the spans of a text, none overlapping."""
    if not text:
        return []
    out: list[Span] = []
    taken = _Taken()

    def add(span: Span) -> None:
        out.append(span)
        taken.add(span[1], span[2])

    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            s, e = m.span()
            add(("EMAIL", s, e, (1, 1 if _SIGN.search(m.group()) else 0, 1 if m.group().rsplit(".", 1)[-1].isalpha() else -1, _email_before(text, s)), ""))
        for m in _SIGNED.finditer(text):  # handles, and addresses without a domain
            s, e = m.span()
            if taken.free(s, e):
                add(("EMAIL", s, e, (-1, 1, -1, _email_before(text, s)), ""))
    for k in _KIND.finditer(text):
        s = k.start()
        if s and (text[s - 1].isalnum() or text[s - 1] in "._"):
            continue
        m = _ADDRESS.match(text, k.end())
        house = m is not None
        m = m or _STREET.match(text, k.end())
        if not m or not taken.free(s, m.end()):
            continue
        short = len(k.group()) < 3 and k.group()[-1] != "."
        votes = (1 if house else -1, 1 if house and _HOUSE.search(m.group()) else 0, 1 if _ADDRESS_LEFT.search(text, max(0, s - 30), s) else 0, -1 if _NOT_PERSONAL.search(text, max(0, s - 24), s) else 0, 1 if "\n\n" not in m.group() else -1, -1 if short else 1)
        span = ("ADDRESS", s, m.end(), votes, "")
        if house:
            add(span)
        else:  # a street without a house number takes no place from other kinds
            out.append(span)
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        if e - s < 7:
            continue
        pair = text[max(0, s - 2) : s]
        if len(pair) == 2 and pair.isalpha() and pair.isascii() and pair.isupper() and m.group().isdigit():
            s -= 2
        if not _GLUED.search(text, max(0, s - 1), s):
            span = _number(text, s, e)
            if span and taken.free(span[1], span[2]):
                add(span)
    return out + _names(text, known, taken)


def _number(text: str, s: int, e: int) -> Span | None:
    """The number from ``s`` on as a PHONE or an IDNUM, if it has at least seven digits."""
    raw = text[s:e]
    while raw.count(")") > raw.count("("):
        e = s + raw.rindex(")")
        raw = text[s:e].rstrip(" .-")
        e = s + len(raw)
    digits = sum(c.isdigit() for c in raw)
    if digits < 7:
        return None
    left = text[max(0, s - 40) : s]
    other = -1 if _NOT_PERSONAL.search(left) else 0
    label = _ID_LEFT.search(left)
    near = _PHONE_LEFT.search(left)
    date = -1 if _DATE.match(raw) else 0
    for shape in (_PASSPORT, _CNS, _CPF, _RG):
        m = shape.match(text, s)
        if m and m.end() <= e + 1 and not text[m.end() : m.end() + 1].isdigit():
            break
    else:
        shape = m = None
    phone = _PHONE.match(text, s)
    if label or shape is _PASSPORT or not (phone and phone.end() >= e - 1):
        strict = 0 if m is None else 1 if shape is _PASSPORT else 1 if shape is _CPF and m.group().count(".") == 2 and "-" in m.group() else 1 if shape is _CNS else 1 if label else -1
        end = m.end() if m and label else e
        return ("IDNUM", s, end, (1 if label else 0, strict if m else -1, other, date, -1 if near else 0), _digits_of(digits))
    e = phone.end()
    raw = text[s:e]
    dotted = _NO_PHONE.fullmatch(raw)
    if (dotted or date) and not near:
        strict = 1 if _CPF.fullmatch(raw) and raw.count(".") == 2 and "-" in raw else -1
        return ("IDNUM", s, e, (0, strict, other, date, 0), _digits_of(digits))
    style = 1 if re.match(r"\+|\(", raw) or re.fullmatch(r"0?\d{2}[ .]\d{4,5}[ .-]\d{4}", raw) else 0
    wide = 1 if _PHONE_WIDE.search(text, max(0, s - 90), s) else -1
    after = 1 if re.match(r"\s*[,.;]|\s*(?:ou|o |al |पर|عند|para)", text[e : e + 8]) or e == len(text) else 0
    return ("PHONE", s, e, (1 if near else 0, wide, style, 1 if digits in (8, 10, 11, 12, 13) else 0, after, other, -1 if dotted or date else 0), _digits_of(digits))


def _digits_of(n: int) -> str:
    return str(min(n, 16))


def _names(text: str, known: Gazetteer, taken: _Taken) -> list[Span]:
    """Runs of capitalised words that begin with a known first name or stand after a title or lead."""
    out: list[Span] = []
    at = 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        if s < at:
            continue
        token = m.group()
        word = fold(token)
        first = word in known.first
        titled, lead = _led(text, s) if s else (False, False)
        if not (first or titled or lead) or e - s < (1 if first else 3):
            continue
        if s and (text[s - 1].isalnum() or text[s - 1] in "-_@＠/") and first:
            continue  # a part of a longer token
        if text[e : e + 1] in "-_@＠" and text[e + 1 : e + 2].isalnum():
            continue
        common = not first and (word in STOP or word in _STARTERS or set(word) == {"x"} or word in TITLES or text[e : e + 1] == "." and word + "." in TITLES)
        # a common word begins no run: the words after it are looked at by themselves
        end = e if common else _extend(text, e, token.isupper() and e - s > 2, known)
        if not taken.free(s, end):
            continue
        at = end
        start = not first and not titled and (word in known.places or word not in known.last and (token.isupper() or bool(_SENTENCE_START.search(text, max(0, s - 4), s))))
        out.append(_name_votes(text, s, end, first, titled, lead, common, start, known))
    return out


_STARTERS = set("chamada chamado o a os as um uma em no na ao hoje paciente protocolo lote nota sem nega usa mora conta trouxe solicito escala sinal equipe conduta leito alta reside hospital clinica unidade".split())
_SENTENCE_START = re.compile(r"[.!?:]\s+$|\n\s*$")


def _extend(text: str, e: int, capitals: bool, known: Gazetteer) -> int:
    parts = 1
    while parts < 6:
        m = _NEXT.match(text, e)
        if not m:
            return e
        if m.group(1) is None:  # an initial
            e = m.end()
            continue
        if len(m.group(1)) == 1:
            return e
        w = fold(m.group(1))
        if capitals and (w in STOP or not m.group(1).isupper()):
            return e
        if capitals and w not in known.last and len(w) < 4:
            return e
        if not capitals and (w in _STARTERS or m.group(1).isupper() and len(w) <= 4 and len(w) > 1):
            return e
        e = m.end()
        parts += 1
    return e


def _led(text: str, s: int) -> tuple[bool, bool]:
    """(a title stands before, a lead stands before)."""
    near = text[max(0, s - 30) : s]
    if near[-1] not in " \t\n\r ":
        return False, False
    line = near.rsplit("\n", 1)[-1]
    ws = line.split()
    if not ws:
        ws = near.split()[-2:]
        if not ws or not ws[-1].islower():
            return False, False
    w = ws[-1].lower()
    if w in TITLES:
        return True, False
    if w in LEADS:
        return False, True
    return False, len(ws) > 1 and w in _ENDS and (ws[-2].lower(), w) in PHRASES


def _name_votes(text: str, s: int, e: int, first: bool, titled: bool, lead: bool, common: bool, start: bool, known: Gazetteer) -> Span:
    left, right = text[max(0, s - 40) : s], text[e : e + 24]
    words = [fold(w) for w in re.findall(_L + "+", text[s:e])]
    last = 1 if len(words) > 1 and words[-1] in known.last else -1 if words and words[-1] in known.places and not first else 0
    before = re.search(r"(\S+)[ \t\u00a0]+$", left)
    crowded = before is not None and before.group(1)[:1].isupper() and before.group(1)[-1].isalpha() and not text[s:e].isupper() and fold(before.group(1)) not in _NO_CROWD
    votes = (int(titled), int(lead), 1 if _RIGHT.match(right) else 0, 1 if first else -1, last, -1 if _NEGATIVE.search(left) or _INSIDE.match(right) else 0, -1 if crowded else 0, -1 if common else 0, -1 if start else 0)
    return ("NAME", s, e, votes, f"{min(len(words), 4)}{'A' if text[s:e].isupper() else 'a'}")


def reliabilities(counts: dict[tuple[int, ...], float], beliefs: list[float], rounds: int = 300, strength: float = STRENGTH) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """(posterior of each vote pattern, reliability of each labeler), by expectation-maximisation.

    For each labeler the chances of its three votes (for, none, against) are estimated for
    spans that are personal and for spans that aren't. The beliefs give the first posteriors
    and ``strength`` rows of votes for each; all else comes from the counts. A labeler's
    reliability is the share of its votes that the posteriors bear out.
    """
    pats = np.array(list(counts), dtype=int)
    n = np.array([counts[p] for p in counts], dtype=float)
    trust = np.array(beliefs)
    said = np.stack([pats == v for v in (-1, 0, 1)]).astype(float)  # vote, pattern, labeler
    rate = np.einsum("vpl,p->vl", said, n) / n.sum()
    lean = np.stack([1 - trust, np.full(len(trust), 0.5), trust])  # of a personal span
    prior = [rate * x / np.maximum((rate * x).sum(0), 1e-12) for x in (lean[::-1], lean)]
    post = 1 / (1 + np.exp(-np.clip(pats @ np.log(trust / (1 - trust)), -50, 50)))
    for _ in range(rounds):
        share = (post @ n + 0.5 * strength) / (n.sum() + strength)
        odds = np.full(len(n), np.log(share / (1 - share)))
        for sign, weight, first in ((-1, 1 - post, prior[0]), (1, post, prior[1])):
            chance = (np.einsum("vpl,p->vl", said, n * weight) + strength * first + SMOOTH) / ((n * weight).sum() + strength + 3 * SMOOTH)
            odds += sign * np.einsum("vpl,vl->p", said, np.log(np.maximum(chance, 1e-9)))
        before, post = post, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(post - before).max() < 1e-9:
            break
    voted = ((pats != 0) * n[:, None]).sum(0)
    borne_out = (np.where(pats > 0, post[:, None], np.where(pats < 0, 1 - post[:, None], 0.0)) * n[:, None]).sum(0)
    return dict(zip(counts, post.tolist())), np.where(voted > 0, borne_out / np.maximum(voted, 1e-12), trust).tolist()


def _features(votes: tuple[int, ...]) -> list[float]:
    single = [float(v > 0) for v in votes] + [float(v < 0) for v in votes]
    return [1.0, *single, *(float(a > 0 and b > 0) for a, b in itertools.combinations(votes, 2)), *(float(a > 0 and b < 0) for a, b in itertools.permutations(votes, 2))]


Pattern = tuple[tuple[int, ...], str]


def classifier(counts: dict[Pattern, float], target: dict[tuple[int, ...], float], rounds: int = 400, ridge: float = 1e-2) -> dict[Pattern, float]:
    """Logistic regression on the posteriors, applied to every pattern of votes and features seen."""
    kinds = sorted({f for _, f in counts})
    x = np.array([[*_features(v), *(float(f == k) for k in kinds)] for v, f in counts])
    y = np.array([target[v] for v, _ in counts])
    n = np.array(list(counts.values()))
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * 1e-1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + ridge * 1e-1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(counts, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def vote_counts(spans: DataFrame) -> dict[str, dict[Pattern, float]]:
    """kind -> (votes, features) -> number of spans: at most 3 ** 9 times eight rows a kind, whatever the corpus."""
    out: dict[str, dict] = {}
    for r in spans.groupBy("tipo", "votos", "traco").agg(F.count("*").alias("n")).collect():
        out.setdefault(r.tipo, {})[tuple(int(v) - 1 for v in r.votos), r.traco] = float(r.n)
    return out


def labeler_report(counts: dict[str, dict[Pattern, float]]) -> list[tuple[str, str, int, float]]:
    """(kind, labeler, spans it voted on, estimated reliability)."""
    out = []
    for kind, pats in sorted(counts.items()):
        by = _by_votes(pats)
        right = reliabilities(by, list(LABELERS[kind].values()))[1]
        out += [(kind, name, int(sum(n for v, n in by.items() if v[i])), right[i]) for i, name in enumerate(LABELERS[kind])]
    return out


def _by_votes(pats: dict[Pattern, float]) -> dict[tuple[int, ...], float]:
    by: dict[tuple[int, ...], float] = {}
    for (v, _), n in pats.items():
        by[v] = by.get(v, 0.0) + n
    return by


def fit(counts: dict[str, dict[Pattern, float]]) -> dict[str, dict[Pattern, float]]:
    """kind -> (votes, features) -> probability."""
    return {k: classifier(c, reliabilities(_by_votes(c), list(LABELERS[k].values()))[0]) for k, c in counts.items()}


def candidate_spans(df: DataFrame, known: Gazetteer) -> DataFrame:
    """(src, id, tipo, inicio, fim, votos, traco) of (src, id, text), as a stage table."""
    held = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(src, i, k, s, e, "".join(str(v + 1) for v in votes), f) for src, i, t in zip(b["src"], b["id"], b["text"]) for k, s, e, votes, f in candidates(t, held.value)]
            yield pd.DataFrame(rows, columns=["src", "id", "tipo", "inicio", "fim", "votos", "traco"])

    return stage(df.select("src", "id", "text").where("text IS NOT NULL").mapInPandas(run, "src string, id long, tipo string, inicio int, fim int, votos string, traco string"), "spans")


def accepted(spans: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The spans whose pattern the classifier accepts."""
    good = [f"{k}:{''.join(str(v + 1) for v in p)}:{f}" for k, ps in model.items() for (p, f), x in ps.items() if x >= least]
    return spans.where(F.concat_ws(":", "tipo", "votos", "traco").isin(good)) if good else spans.where(F.lit(False))


def find(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(src, id, tipo, inicio, fim) of all personal data in (src, id, text)."""
    spans = candidate_spans(df, gazetteer(knowledge))
    return accepted(spans, fit(vote_counts(spans))).drop("votos", "traco")


def reliability(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(tipo, rotulador, votos, confianca): what expectation-maximisation says of each labeler."""
    counts = vote_counts(candidate_spans(df, gazetteer(knowledge)))
    return df.sparkSession.createDataFrame(labeler_report(counts), "tipo string, rotulador string, votos long, confianca double")


def redact(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(src, id, texto): typed placeholders such as [NAME]; a null text stays null.

    The texts are read twice, first for the model and then for the places; they aren't shuffled.
    """
    known = gazetteer(knowledge)
    model = fit(vote_counts(candidate_spans(df, known)))
    held = df.sparkSession.sparkContext.broadcast((known, {(k, *p) for k, ps in model.items() for p, x in ps.items() if x >= 0.5}))

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        g, good = held.value
        out, at = [], 0
        for k, s, e, v, f in sorted(candidates(text, g), key=lambda x: x[1]):
            if (k, v, f) in good and s >= at:
                out += [text[at:s], f"[{k}]"]
                at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"src": b["src"], "id": b["id"], "texto": [one(t) for t in b["text"]]})

    return df.select("src", "id", "text").mapInPandas(run, "src string, id long, texto string")
