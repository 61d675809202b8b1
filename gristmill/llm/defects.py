"""Problem 1: responses that do not answer, each with one type of defect."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import map_rows
from gristmill.llm.refusals import read_sentence

# fixed values: words that stand for no answer, labels before an answer, reports of a failed pipeline
PLACEHOLDERS = {
    "n/a", "na", "n.a", "n.a.", "none", "null", "nil", "nan", "undefined", "empty", "blank", "void", "tbd", "tba", "todo", "unknown", "missing", "pending", "placeholder",
    "no response", "no answer", "no output", "no content", "no data", "no reply", "not available", "not applicable", "not provided", "empty response", "empty answer", "response here", "answer here", "your answer here",
    "insert answer here", "to be determined", "to be added", "lorem ipsum", "keine antwort", "keine angabe", "sin respuesta", "sans réponse", "pas de réponse", "aucune réponse", "nessuna risposta", "sem resposta", "geen antwoord",
}
LABELS = r"(?:the\s+)?(?:final\s+|short\s+|model\s+|assistant\s+)?(?:answer|response|reply|output|result|completion|assistant|model|a|antwort|réponse|reponse|respuesta|risposta|resposta|antwoord)"
FAILURES = re.compile(
    r"""(?ix)\s*[\[(<{"'*]*\s*(?:
        (?:model|task|api|request|pipeline|generation|network|server|internal|system|runtime|connection)[ _-]?(?:failure|failed|error|exception|timeout|timed\ out)\b
      | (?:\w+)?(?:error|exception)\s*[:\[(\d]
      | (?:error|failure|failed|exception|fatal)\s*(?:$|[:\-–—])
      | time(?:d)?[ -]?out\b\s*(?:$|:|while|after|waiting|error|\()
      | traceback\s*\(
      | http\s*(?:status\s*)?[45]\d\d\b | (?:status|error)\s*(?:code)?\s*[:=]?\s*[45]\d\d\b | [45]\d\d\s+(?:internal|bad|service|gateway|too\ many|not\ found|forbidden|unauthori[sz]ed)
      | (?:rate\s+limit|quota|connection|request|context\s+length|token\s+limit)\s+(?:was\s+)?(?:reached|exceeded|reset|refused|aborted|failed|timed\s+out|cancelled|closed|lost)
      | (?:request|task|job|worker|call)\s+\w*\s*(?:failed|aborted|cancelled|stopped|crashed|killed|timed\s+out)
    )"""
)
ECHO = re.compile(r"(?i)^[\s>*_#\"'“”«»‘’-]*(?:(?:you\s+(?:have\s+)?ask(?:ed)?|you\s+want\s+to\s+know(?:\s+this)?|your\s+question(?:\s+(?:was|is))?|the\s+question(?:\s+(?:was|is))?|question|original\s+question|query|prompt|request|instruction|input|task|user|q|asked|frage|question\s+posée|pregunta|domanda|pergunta|vraag)\b[\s*_]*[:.\-–—]?)?[\s>*_\"'“”«»‘’:]*")
# fixed values: frequent function words of the languages told apart
STOPWORDS = {
    "en": "the of and to in is are be for that this with by on at it its as from not was were which or an has have had must shall should when if who what how where they their there been will would can may each any after before between under over into than then no but does do about your you we our",
    "de": "der die das und ist nicht ein eine einen einem einer eines zu den dem des mit für auf von im in sich werden wird wurde wurden als auch nach bei durch aus an oder dass wenn sind haben hat muss müssen soll kann nur noch über unter vor zwischen wie welche welcher um ob so es sie er wir ich am zum zur weil bis gegen ohne",
    "fr": "le la les des du de un une et est sont pour dans sur avec par que qui ne pas au aux ce cette ces il elle ils elles nous vous leur leurs son sa ses en ou où mais donc se être a ont été sera doit doivent peut après avant entre sous lors lorsque quand afin chaque plus si comme sans y d l qu",
    "es": "el la los las un una unos unas y de del que en es son para por con se no su sus al lo como más pero este esta estos estas ese esa cuando donde debe deben puede después antes entre sobre bajo cada si sin hay ha han fue ser está están desde hasta ya o e",
    "it": "il lo la i gli le un uno una e di del della dei delle degli dello che è sono per con da dal dalla dai nel nella nei nelle in su sul sulla si non al alla ai alle come più ma questo questa questi queste quando dove deve devono può dopo prima tra fra ogni se senza sia ed o anche essere viene sarà ha hanno",
    "pt": "o a os as um uma uns umas e de do da dos das que em no na nos nas é são para por com se não seu sua seus suas ao à aos às como mais mas este esta esse essa quando onde deve devem pode após antes entre sobre sob cada sem há foi ser está estão até ou também pelo pela",
    "nl": "de het een en van in is zijn op te dat die met voor niet aan er om als ook door naar bij uit wordt worden werd moet moeten kan of maar dan nog wel hoe wat wie waar wanneer over onder tussen na tot deze dit zich hun hij zij we ik geen elke",
    "sv": "och att det som en ett är för på med av den till inte har de kan ska vid från eller om men när där alla detta denna efter under mellan varje blir bör måste",
    "da": "og at det som en et er for på med af den til ikke har de kan skal ved fra eller om men når der alle dette denne efter under mellem hver bliver bør",
    "no": "og at det som en et er for på med av den til ikke har de kan skal ved fra eller om men når der alle dette denne etter under mellom hver blir bør må",
    "cs": "a v na se je že to do po za pro jak ale jsou být které který která při pod nad před mezi každý když nebo jako podle musí není také",
    "ro": "și în la cu de pe din pentru este sunt nu că care să se o un au fi prin după între fiecare când sau dar trebuie dacă",
    "tr": "ve bir bu için ile de da olarak olan en çok daha gibi kadar sonra önce her ya veya ancak göre tarafından olmalıdır",
    "fi": "ja on ei se että tai kun niin myös ovat sekä mutta jos joka ennen jälkeen kaikki tämä oli olla voi pitää",
    "hu": "a az és hogy nem is egy van ez meg de ha vagy csak már minden után között kell lehet során által amely",
    "pl": "i w na z się nie do to jest że o od po za przez dla jak ale czy są być oraz który która które przy pod nad po przed między każdy gdy lub",
}
_STOP_LANGUAGES: dict[str, list[str]] = {}
for _language, _list in STOPWORDS.items():
    for _word in set(_list.split()):
        _STOP_LANGUAGES.setdefault(_word, []).append(_language)
# fixed values: words that no finished phrase ends with
OPEN_WORDS = set(
    """the a an of and or to in on at by for from with within without into onto under over between among against through during before after until since about as than that which who whom whose where when while if unless
    because although though so but nor not is are was were be been being has have had do does did will would shall should can could may might must its their his her our your my this these those each every any some such both either neither
    more most less least only also very per via including regarding concerning toward towards upon
    der die das den dem des ein eine einen einem einer und oder zu mit für auf von im in als nach bei durch aus an dass wenn weil um ob ist sind wird werden
    le la les des du de un une et ou pour dans sur avec par que qui ne au aux ce cette ces en afin est sont
    el los las una unos unas y del para por con se su sus al lo como es son
    il gli uno e di della dei delle che per da dal nel nella si alla ai""".split()
)
_LABEL_LINE = re.compile(rf"(?is)^[\s*_#>`\"'“”\[({{<]*{LABELS}[\s*_`\"'\])}}>]*[:：][\s*_`\"']*")
_WRAPPER = re.compile(r"(?s)^\s*<(\w+)[^>]*>\s*</\1>\s*$|^\s*<\w+\s*/>\s*$")
_JSON_EMPTY = re.compile(r"^[\s{}\[\]]*(?:[\"']?\w+[\"']?\s*:\s*(?:\"\s*\"|'\s*'|null|none|\[\s*\]|\{\s*\}))?[\s{}\[\],]*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?;:。！？])[\"'”’)\]]*\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*+•‣◦–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+(?:\[[ xX]\]\s+)?")
_BARE_ITEM = re.compile(r"^\s*(?:[-*+•‣◦–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))\s*$")
_REFERENCE = re.compile(r"(?:^|(?<=[.!?]\s)|(?<=\n))\(?[*_]*[A-ZÀ-Þ][\w-]*(?: [\w-]+){0,3}[*_]*: ?[*_]*(\S[^\n]*)$")
_TURN = re.compile(r"\b(?:but|however|nevertheless|aber|jedoch|mais|cependant|pero|però|tuttavia|porém|maar|echter)\b|[;:]|\s[–—-]\s")
_CONCESSION = re.compile(r"\s*(?:while|whilst|although|though|even\s+(?:if|though)|obwohl|obgleich|bien\s+que|aunque|sebbene|benché|embora|hoewel)\b[^,]*,")
_FENCE = re.compile(r"^\s*(```|~~~)", re.M)
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}, set(")]}”»")
_TERMINAL = set(".!?。！？؟")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class SuffixAutomaton:
    """All substrings of a prompt; states are transitions, suffix link and longest length."""

    def __init__(self, text: str):
        self.next, self.link, self.longest = [{}], [-1], [0]
        last = 0
        for ch in text:
            state = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.longest.append(self.longest[last] + 1)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.longest[q] == self.longest[p] + 1:
                    self.link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.longest.append(self.longest[p] + 1)
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[state] = clone
            last = state

    def coverage(self, text: str, least: int, most_outside: float) -> float:
        """Share of ``text`` inside substrings of the prompt of at least ``least`` characters; 0 once more than ``most_outside`` of it lies outside."""
        if not text:
            return 0.0
        state = length = covered = upto = 0
        allowance = most_outside * len(text)
        for i, ch in enumerate(text, 1):
            while state and ch not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if ch in self.next[state]:
                state, length = self.next[state][ch], length + 1
            if length >= least:
                covered += i - max(upto, i - length)
                upto = i
            elif i - length - covered > allowance:
                return 0.0
        return covered / len(text)


_NO_ASCII = dict.fromkeys(range(128))
_ASCII_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}  # leaves ASCII letters and all beyond ASCII
_ASCII_ONLY = str.maketrans({chr(i): None for i in range(128) if not chr(i).isalnum()})


@lru_cache(maxsize=64)
def squeeze(text: str) -> str:
    """Letters and digits only, without regard to case or width."""
    if text.isascii():
        return text.translate(_ASCII_ONLY).lower()
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


@lru_cache(maxsize=2048)
def _automaton(question: str) -> SuffixAutomaton:
    return SuffixAutomaton(question)


def parts_of(sentence: str) -> list[str]:
    """The parts of a long sentence that may each refuse or answer: a concession before the main clause goes, a turn begins a new part."""
    return _TURN.split(_CONCESSION.sub("", sentence, count=1))


@lru_cache(maxsize=1)
def _unseen() -> dict[int, None]:
    """Characters that do not show, by the character database."""
    return {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Cc", "Cf", "Zs", "Zl", "Zp") or 0xFE00 <= i <= 0xFE0F}


def visible(text: str) -> str:
    return text.translate(_unseen())


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    if FAILURES.match(response):
        return True
    if sum(map(str.isalnum, response[:240])) > 60 or len(seen := visible(response)) > 60:
        return False
    if not seen:
        return True
    if _WRAPPER.match(response) or _JSON_EMPTY.match(response):
        return True
    core = response.strip()
    bare = re.sub(rf"(?i)^{LABELS}$", "", core.strip(" \t\n*_`#>\"'“”‘’«»<>[](){}:.-–—"))
    inner = re.sub(r"(?m)^\s*(?:```|~~~)\w*\s*$", "", _LABEL_LINE.sub("", core))
    word = " ".join(inner.strip(" \t\n​ *_`#>\"'“”‘’«»<>[](){}:.,;…-–—/\\|~=").casefold().split())
    return not bare or not squeeze(inner) or word in PLACEHOLDERS


def without_echo(response: str, question: str) -> str:
    """The response without a leading restatement of the question."""
    if not question:
        return response
    at = ECHO.match(response).end()
    for start in {at, 0}:
        if response[start : start + len(question)].casefold() == question.casefold():
            return re.sub(r"^[\s>*_\"'“”«»‘’:]+", "", response[start + len(question) :])
    return response


def is_refusal(response: str, question: str) -> bool:
    """A refusal sentence, and besides courtesies, echoes and refusals nothing that could answer.

    A sentence of more than 130 letters has room for an answer beside its refusal, so its parts are judged one by one.
    """
    text = without_echo(response, question).replace("’", "'").replace("‘", "'").lower()
    refused, rest, asked, at, end = False, 0, None, 0, len(text)
    while at < end:  # sentence by sentence, as far as needed
        stop = _SENTENCE.search(text, at)
        sentence, at = text[at : stop.start() if stop else end], stop.end() if stop else end
        long = len(sentence) > 130 and len(squeeze(sentence)) > 130
        for part in parts_of(sentence) if long else [sentence]:
            if not part.strip():
                continue
            refuses, polite = read_sentence(part)
            if refuses:
                refused = True
            elif not polite and (given := squeeze(part)):
                asked = squeeze(question) if asked is None else asked
                if len(given) <= 8 or given not in asked:
                    rest += len(given)
                    if rest > 28:
                        return False
    return refused


def is_copied(response: str, question: str, least: int = 6, share: float = 0.86) -> bool:
    """The response is made of stretches of the question, found by walking the question's suffix automaton, and gives back most of it."""
    asked = squeeze(question)
    if not asked:
        return False
    least = min(least, len(asked)) if len(asked) >= 12 else len(asked)  # a part of a short question may be an answer, so only the whole counts
    body = ECHO.sub("", response, count=1)
    for text in dict.fromkeys((body, response)):
        given = squeeze(text)
        if len(given) >= 0.6 * len(asked) and not _mostly_foreign(given, asked, least, 1 - share) and _automaton(asked).coverage(given, least, 1 - share) >= share:
            return True
    return False


def _mostly_foreign(given: str, asked: str, least: int, most_outside: float) -> bool:
    """Whether more than ``most_outside`` of ``given`` surely lies outside: in a stretch without any ``least`` letters of the question, only the ends of it may be covered from beside."""
    width, sure, allowed = 5 * least, 0, most_outside * len(given)
    for at in range(0, len(given) - width + 1, width):
        if not any(given[i : i + least] in asked for i in range(at, at + width - least + 1)):
            sure += width - 2 * (least - 1)
            if sure > allowed:
                return True
    return False


def open_delimiters(text: str) -> list[str]:
    """The stack of opening delimiters that are never closed; closing ones without partner, as in ``a)``, are passed over."""
    stack: list[str] = []
    for c in text:
        if c in _OPENERS:
            stack.append(c)
        elif c in _CLOSERS and stack and _OPENERS[stack[-1]] == c:
            stack.pop()
    return stack


def _unfinished_phrase(text: str) -> bool:
    """A phrase without closing mark that cannot end here."""
    words = _WORD.findall(text)
    tail = text.rstrip()
    if not tail or tail[-1] in ",;:-–—…/&+=(" or tail.endswith("..."):
        return True
    return bool(words) and words[-1].lower() in OPEN_WORDS and tail.endswith(words[-1])


def is_truncated(response: str) -> bool:
    """Whether the last sentence, list item, table row or code block is left unfinished."""
    text = response.rstrip()
    if not text:
        return False
    if len(_FENCE.findall(text)) % 2:
        return True
    lines = text.split("\n")
    last = lines[-1].strip()
    if re.fullmatch(r"```|~~~", last):
        return False
    if last.startswith("|"):
        head = lines[-1:]
        for line in reversed(lines[:-1]):
            if not line.strip().startswith("|"):
                break
            head.append(line)
        return not last.endswith("|") or last.count("|") != head[-1].strip().count("|")
    if _BARE_ITEM.match(lines[-1]):
        return True
    ending = last.rstrip("*_`\"'”’»)]}")
    if last.endswith(("…", "...")) or ending.endswith(("…", "...")):
        return True
    stack = open_delimiters(text)
    if ending and ending[-1] in _TERMINAL:
        return False
    if stack and stack[-1] in "([{":
        return True
    if last[-1] in ")]”»\"" and ending and len(ending) < len(last) and re.search(r"[.!?][\"”»]?\s*[(\[]", last):
        return False  # a bracketed remark after the last sentence
    item = _ITEM.match(lines[-1])
    if item:
        body = lines[-1][item.end() :].strip()
        if not body:
            return True
        peers = [x[m.end() :].strip() for x in lines[:-1] if (m := _ITEM.match(x))]
        closed = sum(bool(p) and p.rstrip("*_`\"'”’»)]}")[-1:] in _TERMINAL for p in peers)
        if peers and closed * 2 > len(peers):
            return True
        return _unfinished_phrase(body) or (not peers and len(body.split()) > 9)
    if found := _REFERENCE.search(last):
        return _unfinished_phrase(found[1]) or len(found[1].split()) > 14
    if last[-1] in "\"”»" and re.search(r"[\"“«][^\"“”«»]*[\"”»]$", last) and not stack:
        return False
    if len(lines) > 1 and all("=" in x or not x.strip() for x in lines[-2:]):
        return _unfinished_phrase(last)
    if _unfinished_phrase(last):
        return True
    if len(lines) == 1 and len(last.split()) <= 6 and not re.search(r"[.!?]\s", last):
        return False  # a complete phrase
    if last.startswith("#"):
        return False
    return True


def language(text: str) -> str | None:
    """The language most stopwords vote for, or the script where it is not Latin; None when there is no clear vote.

    Scripts are counted by letters; Kanji beside Kana are Japanese.
    """
    if not text.isascii():
        scripts: dict[str, int] = {}
        odd = text.translate(_NO_ASCII)
        for c in set(odd):
            script = _script(c)
            scripts[script] = scripts.get(script, 0) + odd.count(c)
        scripts.pop("", None)
        scripts["latin"] = scripts.get("latin", 0) + len(text.translate(_ASCII_LETTERS)) - len(odd)
        if "japanese" in scripts:
            scripts["japanese"] += scripts.pop("cjk", 0)
        most = max(scripts, key=scripts.get)
        if most != "latin":
            return most if scripts[most] * 2 > sum(scripts.values()) else None
    votes: dict[str, int] = {}
    get = _STOP_LANGUAGES.get
    for word in _WORD.findall(text.casefold().replace("’", "'")):
        for part in word.split("'") if "'" in word else (word,):
            if (names := get(part)) and len(part) > 1:  # single letters are also names of columns, items and variables
                for name in names:
                    votes[name] = votes.get(name, 0) + 1
    if not votes:
        return None
    best = max(votes, key=votes.get)
    first = votes.pop(best)
    second = max(votes.values(), default=0)
    return best if first >= 2 and first > second * 1.15 else None


@lru_cache(maxsize=4096)
def _script(char: str) -> str:
    """The script of a letter, nothing for what is none."""
    if not char.isalpha():
        return ""
    if char.isascii():
        return "latin"
    name = unicodedata.name(char, "")
    for script in ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "THAI", "DEVANAGARI", "FULLWIDTH LATIN"):
        if name.startswith(script):
            return "japanese" if script in ("HIRAGANA", "KATAKANA") else script.rpartition(" ")[2].lower()
    return ""


@lru_cache(maxsize=8192)
def _question_language(question: str) -> str | None:
    return language(question)


def _prose(response: str) -> str:
    return re.sub(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1|\Z)|\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|«[^»\n]{0,200}»", " ", response)


def defect(question: str | None, response: str | None) -> str | None:
    """The one type of defect of a response, None if it answers. The first that holds of empty, refusal, copied, truncated, other_language."""
    if is_empty(response):
        return "empty"
    question = question or ""
    if is_refusal(response, question):
        return "refusal"
    if is_copied(response, question):
        return "copied"
    if is_truncated(response):
        return "truncated"
    asked = _question_language(question)
    if asked:
        answered = language(_prose(without_echo(response, question)))
        if answered and answered != asked:
            return "other_language"
    return None


def defective_responses(df: DataFrame, key: str = "response_id", question: str = "question", response: str = "model_response") -> DataFrame:
    """(key, defect) of the responses that do not answer, one row a response; rows loaded twice count once.

    A null or invisible response is empty; a null question leaves only the defects that need none. Only found
    rows are shuffled.
    """
    kinds = pa.schema([("k", pa.string()), ("defect", pa.string())])

    def work(k, asked, given) -> Iterator[tuple]:
        if kind := defect(asked, given):
            yield k, kind

    rows = df.select(F.col(key).alias("_k"), F.col(question).alias("_q"), F.col(response).alias("_r"))
    return map_rows(rows, "k string, defect string", kinds, work).withColumnRenamed("k", key).dropDuplicates([key])
