"""Personal information in free text.

Patterns propose spans, checksums confirm or weaken numbers, words nearby raise or lower the score; spans whose score
reaches the threshold are kept, longer ones before those inside them, and replaced by typed placeholders.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least score of a span.
THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 40

# Words and patterns in Portuguese and English.
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_HYPHEN = "-\u00ad\u2010\u2011\u00ac"
_BR = rf"(?:[{_HYPHEN}]\n[ ]*)"  # a word broken at the end of a line
_BREAK = re.compile(rf"(?<=\w)[{_HYPHEN}] *\n *(?=\w)")
_CAP = rf"[{_UP}](?:[\w'’!@†]|{_BR})+"
_SP = r"(?:[ \t]+|[ \t]*\n[ ]*)"
_PART = r"(?:d[aeo]s?|del|della|van|von|der)"
_WORD = rf"(?:{_CAP}|[{_UP}]\.(?={_SP}))"  # a word or an initial
_NAME = re.compile(rf"{_WORD}(?:(?:{_SP}{_PART})?{_SP}{_WORD}|,{_SP}{_CAP}){{1,5}}")
_WORDS = re.compile(rf"(?<!\w)(?:{_CAP}|[{_UP}]\.)")
# What stands before a person: titles, greetings, labels, agents and sources of what was said.
_TITLES = r"(?:Sr|Sra|Srta|Srs|Dr|Dra|Drs|Eng|Enga|Prof|Profa|Mr|Mrs|Ms|Miss|Mx|Sir|Dona|Dom|Adv|Des)\b\.?|Senhora?|Doutora?|Professora?"
_GREETINGS = r"Prezad[oa]s?|Car[oa]s?|Querid[oa]s?|Ol[áa]|Oi|Obrigad[oa]|Atenciosamente|Cordialmente|Respeitosamente|Abraços?|Dear|Hello|Hi|Hey|Thanks|Thank\s+you|Cheers|(?:[Bb]est|[Kk]ind|[Ww]arm)?\s*[Rr]egards|Sincerely|Yours(?:\s+(?:sincerely|truly|faithfully))?"
_LABELS = r"Nome|Respons[áa]vel|Ciente|Testemunhas?|Contato|Cliente|Paciente|Titular|Portadora?|Requerente|Requerid[oa]|Solicitante|Destinat[áa]ri[oa]|Remetente|Assinatura|Presentes?|Aluna?|Autora?|Name|Contact(?:\s+person)?|Witness(?:es)?|Client|Customer|Patient|Holder|Applicant|Recipient|Sender|Signature|Author|From|To|De|Para|A/C|c/o|Attn\.?"
_AGENTS = (
    r"(?:assinad|firmad|subscrit|lavrad|redigid|elaborad|emitid|enviad|recebid|entregue|atendid|representad|apresentad|conduzid|acompanhad|acertad|acordad|celebrad|ajustad|pactuad|combinad)[oa]?s?\s+(?:por|a|ao|à|entre|com)|"
    r"(?:signed|issued|sent|received|written|prepared|represented|attended|filed|submitted|made|delivered|agreed|arranged|settled)\s+(?:by|to|between|with)|"
    r"(?:em\s+nome|por\s+ordem|aos\s+cuidados|na\s+presença)\s+de|on\s+behalf\s+of|in\s+the\s+presence\s+of|ficou\s+com|left\s+with|my\s+name\s+is|meu\s+nome\s+é|me\s+chamo|chamad[oa]|named|testemunha|witness|compareceram"
)
_SOURCES = r"segundo|conforme(?:\s+(?:declarou|informou|relatou))?|de\s+acordo\s+com|declarou|informou|afirmou|disse|according\s+to|stated\s+by|said|declared|reported\s+by"
# What persons do, and what joins a person to the rest of a sentence.
_DID = (
    r"compareceu|compareceram|confirmou|declarou|assinou|informou|solicitou|requereu|pediu|afirmou|disse|relatou|apresentou|recebeu|entregou|concordou|acrescentou|aceitou|recusou|assistiu|participou|enviou|ligou|mora|reside|trabalha|"
    r"attended|signed|stated|said|confirmed|declared|kept|received|requested|agreed|added|reported|wrote|called|informed|delivered|accepted|refused|sent|lives|resides|works\s+(?:at|for|in)"
)
_DOES = rf"(?:(?:n[ãa]o|nada|j[áa]|tamb[ée]m|has|had|have|also|nothing)\s+)*(?:{_DID})"
_JOINS = r"e|em|no|na|ao|que|desde|quando|para|and|on|at|in|the|who|when|since|with|from|to"
# Names in lower case are only taken between such a word and what ends the mention.
_SMALL = rf"(?!(?:as|os|the|das|dos|des|uma|por|com|sem|sob|que|nos|nas|aos|and|for|its|seu|sua|esta|este|esse|essa|toda|todo|não|her|his|our|this|that|with|from|when|since|who|desde|quando|para|nada|{_DID})\b)[{_LOW}](?:[{_LOW}'’@!†]|{_BR}){{2,}}"
_SMALL_NAME = rf"{_SMALL}(?:(?:{_SP}{_PART})?{_SP}{_SMALL}){{1,3}}?"
_AFTER_CUE = re.compile(rf"(?:(?<!\w)(?:{_TITLES})|(?<!\w)(?:{_LABELS})\s*:|(?<!\w)(?i:{_AGENTS}|{_SOURCES})){_SP}({_SMALL_NAME})(?=[,.;(]|{_SP}(?:\(|(?:{_JOINS})\b|{_DOES}\b)|\s*$)")
_BEFORE_CUE = re.compile(rf"(?:^|(?<=[.!?;:)•]\s)|(?<=\n\n)|(?<=\n[-•*] ))\s*({_SMALL_NAME})(?={_SP}{_DOES}\b)")
# How those words and verbs begin; an automaton finds all of them in one pass, and the patterns are only tried there.
_CUE_STEMS = (
    "Sr", "Dr", "Eng", "Prof", "Mr", "Ms", "Miss", "Mx", "Sir", "Don", "Dom", "Adv", "Des", "Senhor", "Doutor", "Nome", "Respons", "Ciente", "Testemunha", "Contato", "Cliente", "Paciente", "Titular", "Portador", "Requer", "Solicitante", "Destinat", "Remetente", "Assinatura", "Presente", "Alun", "Autor",
    "Name", "Contact", "Witness", "Client", "Customer", "Patient", "Holder", "Applicant", "Recipient", "Sender", "Signature", "From:", "To:", "De:", "Para:", "A/C", "c/o", "Attn", "assinad", "firmad", "subscrit", "lavrad", "redigid", "elaborad", "emitid", "enviad", "recebid", "entregue", "atendid", "representad", "apresentad",
    "conduzid", "acompanhad", "acertad", "acordad", "celebrad", "ajustad", "pactuad", "combinad", "signed", "issued", "sent", "received", "written", "prepared", "represented", "attended", "filed", "submitted", "made", "delivered", "agreed", "arranged", "settled", "em nome", "por ordem", "aos cuidados", "na presença", "on behalf", "in the presence",
    "ficou", "left", "my name", "meu nome", "me chamo", "chamad", "named", "testemunha", "witness", "comparecer", "segundo", "conforme", "de acordo", "declarou", "informou", "afirmou", "disse",
    "according", "stated", "said", "declared", "reported",
)
_VERBS = tuple(v.partition("\\")[0] for v in _DID.split("|"))
_STARTS = ahocorasick.Automaton()
_CUES = {v for s in _CUE_STEMS for v in (s, s[0].upper() + s[1:])}
for _stem in {*_CUES, *_VERBS}:
    _STARTS.add_word(_stem, (len(_stem), _stem in _CUES, _stem in _VERBS))
_STARTS.make_automaton()
_LOCAL = r"[\w.+%'-]+"
# Plain, spaced, and written so that machines do not read it: (a), [at], arroba ... ponto, at ... dot.
_EMAIL = re.compile(
    rf"{_LOCAL}[ \n]?@[ \n]?(?:[\w-]+\.)+[A-Za-z]{{2,}}|{_LOCAL}\s?[(\[](?:a|at|arroba)[)\]]\s?(?:[\w-]+(?:\.|\s+(?:ponto|dot)\s+))+[A-Za-z]{{2,}}|"
    rf"{_LOCAL}\s+arroba\s+(?:[\w-]+(?:\.|\s+ponto\s+))+[A-Za-z]{{2,}}|{_LOCAL}\s+at\s+(?:[\w-]+\s+dot\s+)+[A-Za-z]{{2,}}"
)
_EMAIL_AT = re.compile(r"@|[(\[](?:a|at|arroba)[)\]]|\sarroba\s|\sdot\s")
_STREET = r"(?:Rua|R\.|Avenida|Av\.|Alameda|Al\.|Travessa|Tv\.|Praça|Pça\.|Estrada|Rodovia|Rod\.|Largo|Ladeira|Viela)"
_STREET_AT = re.compile(rf"\b{_STREET}")
_ADDRESS_PT = re.compile(rf"\b{_STREET}{_SP}(?:(?:{_PART}|[\w'’.!@†]|{_BR}|[ \t]|\n[ ]*){{2,60}}?)(?:,?{_SP}(?:n\.?[º°o]?|nº|km|n[úu]mero){_SP}?\d+|,?{_SP}s/n|,{_SP}\d{{1,5}}|{_SP}\d{{1,5}})\b(?:,{_SP}(?:apto|ap\.|bloco|casa|sala|conj\.){_SP}\w+)?", re.I)
_ADDRESS_EN = re.compile(rf"\b\d{{1,5}}{_SP}(?:{_CAP}{_SP}){{1,4}}(?:Street|Road|Lane|Court|Avenue|Drive|Way|Place|Square|Close|Terrace|Crescent|Boulevard|St\.|Rd\.|Ave\.|Blvd\.)(?!\w)(?:,{_SP}(?:Unit|Apt\.?|Suite|Flat){_SP}\w+)?")
_PHONE = re.compile(
    r"(?<![\w.,/-])(?:"
    rf"\+\d{{1,3}}[ -]?(?:\(\d{{2,3}}\)|\d{{2,3}})[ .-]?(?:\d{_SP}?)?\d{{3,5}}[ .\n-]{{0,2}}\d{{4}}|"
    r"0xx\d{2}[ .-]?\d{4,5}[ .-]?\d{4}|"
    r"\(\d{2,3}\)[ \n]?(?:\d[ ])?\d{3,5}[ .\n-]\d{4}|"
    r"\d{3}([.-])\d{3}\1\d{4}|"
    r"\d{2}[ -]9?\d{4}[ .-]\d{4}"
    r")(?![\w/-]|[.,]\d)"
)
_PHONE_WRAPPED = re.compile(rf"\+\d{{1,3}}{_SP}(?:\(\d{{2,3}}\)|\d{{2,3}}){_SP}(?:\d{_SP})?\d{{3,5}}[ .\n-]{{0,2}}\d{{4}}(?![\w/-])|\(\d{{2,3}}\){_SP}?(?:\d{_SP})?\d{{3,5}}(?:[.-]|{_SP})\d{{4}}(?![\w/-])|(?<![\w.,/-])\d{{2}}(?:-|{_SP})9?\d{{4}}(?:[.-]|{_SP})\d{{4}}(?![\w/-]|[.,]\d)")
_ID = re.compile(
    r"(?<![\w.,/-])(?:"
    rf"(?P<cpf>\d{{3}}(?:\.|{_SP})\d{{3}}(?:\.|{_SP})\d{{3}}(?:[-/]\n?|{_SP})\d{{2}})|"
    r"(?P<rg>\d{1,2}\.\d{3}\.\d{3}-\n?[\dXx])|"
    rf"(?P<ssn>\d{{3}}(?:-|{_SP})\d{{2}}(?:-|{_SP})\d{{4}})|"
    r"(?P<doc>[A-Z]{2}\d{6,8})|"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)|"
    r"(?P<card>\d{4}([ -])\d{4}\g<sep>\d{4}\g<sep>\d{4})|"
    r"(?P<bare>\d{9,11})"
    r")(?![\w/-]|[.,]\d)".replace(r"([ -])\d{4}\g<sep>", r"(?P<sep>[ -])\d{4}(?P=sep)").replace(r"\g<sep>", "(?P=sep)")
)

#: Where a number of any kind can be; the patterns above are only tried there.
_REGION = re.compile(r"(?:[+(]\d|\d|[A-Z]{2}\d)[\dA-Zx().+/ \n-]{4,}")

_ID_FOR = re.compile(r"(?:\bcpf|\brg|\bidentidade|identifica|\bcadastro|identity|\bid no|social (?:security )?number|\bssn|passport|passaporte|\bholder|titular|portador|documento de|\bdoc\.|\bcnh|\bpis|\bnif|personal number|tax number)", re.I)
_ID_NOT = re.compile(r"(?:cnpj|nota fiscal|protocolo|processo|docket|invoice|\bbatch|\blote|\bitem\b|contrato|fatura|pedido|order no|\bpn\b|s[ée]rie|receipt no)[^.;\n]{0,16}$", re.I)
_PHONE_FOR = re.compile(r"(?:\btel|fone|celular|ligar|call\b|phone|whats|recados|contato|d[úu]vida|portaria|atende|mobile|fax|number|n[úu]mero)", re.I)
_PHONE_NOT = re.compile(r"(?:cnpj|nota fiscal|protocolo|processo|docket|invoice|\bbatch|\bitem\b|contrato|cpf|\brg\b|identity|cadastro|identifica|social number|\bid no|r\$|us\$)[^.;\n]{0,16}$", re.I)
_TITLE = re.compile(rf"(?<!\w)(?:{_TITLES})\s*$", re.I)
_NAME_BEFORE = re.compile(rf"(?<!\w)(?:(?:{_GREETINGS})\s*,?|(?:{_LABELS})\s*:|(?i:{_AGENTS}|{_SOURCES}))\s*$")
_NAME_AFTER = re.compile(rf"^[,\s]*(?:{_DOES}\b|\((?:assinatura|signature)|(?:residente|portadora?|domiciliad[oa]|nascid[oa]|inscrit[oa]|brasileir[oa]|born|residing|holder)\b)")
# A number or an address of mail right after a name is that person's.
_REACHED = re.compile(rf"^{_SP}?[,:(-]?{_SP}?(?:[+(]\d{{2}}|(?:tel|fone|cel|phone|call|e-?mail|cpf|rg|id)\b|[\w.+-]+@)", re.I)
_ORG = re.compile(r"^[,.]?\s*(?:Ltda|S\.?\s*A\b|S/A|Ltd|Inc|GmbH|LLC|Corp|Eireli|Cia\b|M\.?E\b|&)")
_ORG_WORD = re.compile(
    r"\b(?:Ltda|Ltd|Inc|GmbH|LLC|Works|Construtora|Construções|Companhia|Empresa|Cia|Grupo|Group|Banco|Instituto|Institute|Associação|Association|Fundação|Foundation|Cooperativa|Prefeitura|Secretaria|Ministério|Ministry|Câmara|Tribunal|Court|Council|Conselho|Comissão|Committee|Departamento|Department|"
    r"Universidade|University|Escola|School|Hospital|Igreja|Church|Sindicato|Union|Company|Bank|Construction|Engenharia|Engineering|Comercial|Comércio|Indústria|Industries|Services?|Serviços|Transportes|Editora|Partners|Holdings?|Systems|Supply|Trading)\b",
    re.I,
)
_PLACE = re.compile(rf"^(?:The|Serra|Bairro|Jardim|Vila|Parque|Rio|Vale|Morro|Monte|Lagoa|Lago|Estado|Município|Cidade|Porto|Ilha|Praia|Baía|Cabo|Fazenda|Sítio|Condomínio|Edifício|Estação|Ponte|Mount|Lake|Port|Cape|Fort|Saint|{_STREET})\b", re.I)
_PLACE_WORD = re.compile(r"\b(?:Basin|Bay|Beach|Bridge|Canyon|Coast|County|Creek|Desert|District|Falls|Field|Forest|Garden|Gulf|Harbou?r|Heights|Hills?|Island|Lake|Mountains?|Park|Peak|Plains?|Plateau|Region|Ridge|River|Station|Street|Road|Lane|Square|Town|Valley|Village|Wood)\b")
_FIRST = {
    # words that begin a sentence and are no part of a name
    "a", "o", "as", "os", "um", "uma", "em", "de", "do", "da", "no", "na", "por", "para", "com", "sem", "sob", "ao", "à", "e", "mas", "se", "the", "in", "on", "at", "by", "for", "from", "of", "and", "but", "this", "that", "segundo", "conforme", "compareceram", "compareceu",
    "presente", "presentes", "ciente", "contato", "responsável", "assinatura", "nome", "declarou", "according", "contact", "witness", "name", "senhor", "senhora", "sr", "sra", "dr", "dra", "eng", "mr", "mrs", "ms", "todavia", "assim", "além", "nesse", "posteriormente", "finally", "then", "later", "moreover", "however", "also", "testemunha",
    "residente", "domicílio", "foram", "ver", "ligar", "celular", "tel", "cpf", "rg", "call", "see", "deliver", "lives", "mail", "anexo", "volume", "item", "objeto", "escopo", "prazos", "conclusão", "metodologia", "deliberações", "constatações", "recebimento", "laudo", "relatório", "contrato", "processo", "ata", "norma", "memorial", "proposta", "uso", "cópia", "arquivo", "página", "page",
    "prezado", "prezada", "prezados", "prezadas", "caro", "cara", "querido", "querida", "olá", "oi", "obrigado", "obrigada", "atenciosamente", "cordialmente", "abraço", "abraços", "dear", "hello", "hi", "hey", "thanks", "thank", "cheers", "regards", "best", "kind", "sincerely", "yours", "my", "meu", "minha", "i", "eu", "cliente", "paciente", "titular", "client", "customer", "patient", "from", "to", "attn",
}


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def luhn(number: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(_digits(number))):
        x = x * 2 if i % 2 else x
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = re.sub(r"\s", "", iban).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod11(number: str, places: int) -> bool:
    """The weighted check digits that end a number of `places` digits."""
    x = _digits(number)
    if len(x) != places:
        return False
    for n in (places - 2, places - 1):
        rest = sum(d * w for d, w in zip(x, range(n + 1, 1, -1))) * 10 % 11 % 10
        if rest != x[n]:
            return False
    return True


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands around a span, words broken at line ends joined."""
    return _BREAK.sub("", text[max(0, start - BEFORE) : start]).replace("\n", " "), _BREAK.sub("", text[end : end + AFTER])


def _numbers(text: str) -> Iterator[tuple[str, int, int, float]]:
    regions = [(m.start(), min(m.end() + 2, len(text))) for m in _REGION.finditer(text)]
    for m in (m for r in regions for m in _ID.finditer(text, *r)):
        if m.group().count("\n") > 1:  # cells of a table
            continue
        before, _ = _near(text, *m.span())
        score = {"cpf": 0.6, "rg": 0.55, "ssn": 0.45, "doc": 0.4, "iban": 0.3, "card": 0.2, "bare": 0.1}[m.lastgroup if m.lastgroup != "sep" else "card"]
        raw = m.group()
        if m.lastgroup == "cpf":  # with a wrong digit only what stands before it can tell that it is one
            score += 0.2 if mod11(raw, 11) else -0.3
        if m.lastgroup == "bare" and mod11(raw, 11):
            score += 0.2
        if m.lastgroup == "card" or m.lastgroup == "sep":
            score += 0.5 if luhn(raw) else -0.2
        if m.lastgroup == "iban":
            score += 0.6 if mod97(raw) else -0.3
        if _ID_FOR.search(before):
            score += 0.5
        if _ID_NOT.search(before):
            score -= 0.8
        yield "id_number", m.start(), m.end(), score
    for pattern in (_PHONE, _PHONE_WRAPPED):
        for m in (m for r in regions for m in pattern.finditer(text, *r)):
            if m.group().count("\n") > 1:
                continue
            before, _ = _near(text, *m.span())
            score = 0.5 if m.group()[0] in "+(0" or m.re is _PHONE else 0.3
            score += 0.3 * bool(_PHONE_FOR.search(before)) - 0.8 * bool(_PHONE_NOT.search(before))
            yield "phone", m.start(), m.end(), score


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of two and more words with capitals. Words that begin sentences, titles and labels are no part of a run."""
    for m in _NAME.finditer(text):
        run: list[tuple[int, int]] = []
        words = [w.span() for w in _WORDS.finditer(text, m.start(), m.end())]
        for a, z in [*words, (m.end(), m.end())]:
            if a < z and text[a:z].lower() not in _FIRST:
                run.append((a, z))
                continue
            if len(run) > 1 and any(z2 - a2 > 2 for a2, z2 in run):
                yield run[0][0], run[-1][1]
            run = []


def _names(text: str) -> Iterator[tuple[str, int, int, float]]:
    for start, end in _runs(text):
        span = text[start:end]
        before, after = _near(text, start, end)
        score = 0.3
        if _TITLE.search(before):
            score += 0.5
        if _NAME_BEFORE.search(before):
            score += 0.4
        if _NAME_AFTER.search(after):
            score += 0.4
        if _REACHED.search(after):
            score += 0.3
        if "," in span and not re.match(rf"(?:[{_UP}](?:[{_UP}'’0-9]|{_BR})+{_SP})*[{_UP}](?:[{_UP}'’0-9]|{_BR})+,{_SP}[{_UP}]", span):
            score -= 0.3
        if _ORG.search(after) or _ORG_WORD.search(span):
            score -= 0.9
        if _PLACE.search(span) or _PLACE_WORD.search(span):
            score -= 0.9
        yield "name", start, end, score


def _small_names(text: str) -> Iterator[tuple[str, int, int, float]]:
    for end, (n, cue, verb) in _STARTS.iter(text):
        at = end - n + 1
        if cue and (m := _AFTER_CUE.match(text, at)):
            yield "name", m.start(1), m.end(1), 0.6
        if verb:  # only the words just before such a verb are read
            for m in _BEFORE_CUE.finditer(text, max(0, at - 90), min(len(text), at + 20)):
                yield "name", m.start(1), m.end(1), 0.6


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Kept spans (kind, start, end, score) in order; none overlaps another."""
    spans: list[tuple[str, int, int, float]] = []
    done = 0
    for at in _EMAIL_AT.finditer(text):  # only the surroundings of a sign are read
        for m in _EMAIL.finditer(text, max(done, at.start() - 100), min(len(text), at.end() + 120)):
            if m.start() < at.end() and m.end() > at.start() and m.start() >= done:
                spans.append(("email", m.start() + len(m.group()) - len(m.group().lstrip(".'-")), m.end(), 0.9))
                done = m.end()
    if re.search(r"\d{3}", text):
        spans += _numbers(text)
    if _STREET_AT.search(text):
        for m in _ADDRESS_PT.finditer(text):
            if m.group()[0].isupper() and re.match(rf"(?:{_PART}{_SP})?[{_UP}]", re.sub(rf"^{_STREET}{_SP}", "", m.group(), flags=re.I)):
                spans.append(("address", m.start(), m.end(), 0.8))
    spans += [("address", m.start(), m.end(), 0.8) for m in _ADDRESS_EN.finditer(text)]
    spans += _names(text)
    spans += _small_names(text)
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 2, "name": 3}
    kept: list[tuple[str, int, int, float]] = []  # in order of their starts; none overlaps another
    for s in sorted((s for s in spans if s[3] >= THRESHOLD), key=lambda s: (rank[s[0]], -s[3], s[1] - s[2], s[1])):
        at = bisect_left(kept, s[1], key=lambda k: k[1])
        if (at == len(kept) or kept[at][1] >= s[2]) and (at == 0 or kept[at - 1][2] <= s[1]):
            kept.insert(at, s)
    return kept


def mask(text: str) -> str:
    """The text with a placeholder such as [NAME] in place of each item."""
    out, at = [], 0
    for kind, start, end, _ in find(text):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def items(df: DataFrame) -> DataFrame:
    """One row per private item: src, doc_id, item_no, kind, start_pos (code point from 1).

    df: src, doc_id, item_no, text; other columns are ignored. Null, empty and blank texts have none. Whole texts are
    read where they lie; only found items are shuffled, to give each once however often a row is repeated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for kind, start, _, _ in find(text) if text else ():
                    at.append(i)
                    kinds.append(kind)
                    starts.append(start + 1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(kinds, pa.string()), pa.array(starts, pa.int32())], names=["src", "doc_id", "item_no", "kind", "start_pos"])

    picked = df.select("src", "doc_id", "item_no", "text").where("text is not null")
    return picked.mapInArrow(rows, "src string, doc_id string, item_no int, kind string, start_pos int").dropDuplicates()


def masked(text: Column) -> Column:
    """The column with placeholders in place of private items; null stays null."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask(t))

    return F.pandas_udf(batch, T.StringType())(text)
