"""What makes a sentence a refusal: a negated ability, permission, readiness or knowledge of the speaker, by language.

English is read by a finite automaton over classes of words, the other languages by the forms their verbs take in the first person beside a negation. No
wording as a whole is listed, only the parts it is made of.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

# fixed values: English words and the class each stands for; a star leaves the ending open
ENGLISH = {
    "S": "i|me|my|myself|i'm|i've|i'll|i'd|mine|this assistant|this model|this system|this chat|the assistant",  # the speaker
    "W": "we|us|our|we're|we'll|we've",
    "X": "can't|cannot|can not|could not|couldn't|won't be able|will not be able|am unable",
    "M": "won't|will not|wouldn't|would not|don't|do not|didn't|did not|aren't|isn't|may not|must not|mustn't|shall not|should not|shouldn't|never|not|haven't|have not|having not",
    "U": "unable|not able|not allowed|not permitted|not authori*|not qualified|not equipped|not comfortable|not in a position|not at liberty|not going to|not possible|impossible|not be appropriate|not appropriate|not be right|not right|not be responsible|not be proper|inappropriate|irresponsible|improper|no way|not something|not a topic|not a subject|not one|not a question|nothing i|forbidden|not prepared|not willing|unwilling|reluctant|not for me|incapable|not capable|ill placed|not competent",
    "A": "help*|assist*|answer*|provid*|give|giving|discuss*|comment*|say|saying|respond*|compl*|fulfil*|share|sharing|tell|telling|go into|going into|offer*|address*|speak*|advis*|judge|judging|take on|taking on|do that|do this|weigh in|engage|support|handle|reply*|talk*|disclos*|recommend*|confirm*|determin*|decid*|able to|be of|take up|get into|touch|deal with|continue|proceed|elaborate|opine|speculate|express*|know|knowing|be sure|meet|process|accommodate|tackle|settle|work on",
    "D": "decline*|declining|refus*|refrain*|abstain*|pass|stay away|steer clear|keep away|keep out|stay out|avoid|rather not|prefer not|sooner not|leave to others|leave to someone|leave it to|leave this to|leave that to|leave such|leave for others|opt out|hold back|keep silent|stay silent|stay clear|keep clear|turn down|withhold|bow out|back away|shy away|sit out|sit this",
    "E": "must decline|have to decline|must refuse|have to refuse|have to pass|rather not|prefer not to|respectfully decline*|politely decline*",
    "B": "beyond|outside|out of|exceed*|against|violat*|not allow|not permit|prevent*|forbid*|prohibit*|lack*|bar me|stop me|not within|not part of|above|falls short|not cover",
    "L": "guideline*|instruction*|polic*|programming|scope|capabilit*|ability|abilities|knowledge|expertise|remit|competence*|limits|limitations|rules|means|information|data|training|access|reach|authority|purview|mandate|skills|insight|context|details|facts|confidence|certainty",
    "K": "don't know|do not know|didn't know|no idea|not sure|unsure|no information|not enough information|insufficient information|no knowledge|no data|no clue|cannot know|don't have*|do not have*|have no|not aware|not certain|uncertain|not familiar|unfamiliar|wouldn't know|no access",
    "Z": "nothing|no comment*|no answer*|no advice|no response*|no statement*|no help|no reply|no guidance|no opinion|no details|none of this",
    "V": "can be|could be|will be|may be|to be|is to be|be said|be given|be offered|be made|be answered|to offer|to say|to add|to share|to give",
    "Q": "question*|request*|topic*|subject*|matter*|inquir*|enquir*|query|queries|this|that|such",
    "C": "sorry|apolog*|thank*|hello|hi|regret*|unfortunately|afraid|hope you|please|you may|you might|you could|you should|you will have|you'll have|you can|let me know|anything else|feel free|happy to|glad to|if you|understanding|consult|contact|reach out|elsewhere|as an ai|as a language|as a large|as an assistant|as an artificial|as a model|may involve|could touch|might touch|may touch|could concern|may concern|might concern|could involve|might involve|sensitive|advice|someone else|a professional|an expert|appreciate|kindly|good luck|best of luck|regards|take care|another source|another time",
}
# the automaton: a speaker with a negated verb and an act of answering, and its turns without a subject, in the passive, and with limits or knowledge
REFUSING = re.compile(
    r"S.{0,6}[MX].{0,6}A|^(?:C\.{0,2}){0,2}X\.{0,2}A|S.{0,6}U|^.{0,2}U.{0,6}A|U.{0,3}S|S.{0,6}D|^.{0,3}E|B.{0,2}S|S.{0,3}L.{0,3}[BMX]|S.{0,4}B.{0,4}L|S.{0,6}K|^(?:C\.{0,2}){0,2}K(?:\.{0,3}[AQS]|$)|Z.{0,6}V|Z.{0,3}S.{0,5}A|^[.CQ]{0,4}Z[.Q]{0,3}$|V.{0,3}Z|W.{0,4}[MXU].{0,6}A.{0,4}Q|Q.{0,4}[MX].{0,3}A.{0,4}S|A.{0,5}[MX].{0,3}[US]"
)

# by language: words that tell it may be it (with a negation among them), and forms of a refusal
FORMS: dict[str, tuple[str, str]] = {
    "de": ("nicht|nichts|kein*|ablehnen|lehne|verweiger*|außerhalb|übersteigt|unmöglich", r"\b(?:ich|mir|wir)\b(?: \w+){0,8} (?:nicht|nichts|keine?[nmrs]?)\b|\b(?:ich)\b(?: \w+){0,5} (?:ablehn\w*|verweiger\w*|lehne|passen)\b|\b(?:außerhalb|übersteigt|überschreitet) (?:mein\w*|was ich)|\bmein\w*(?: \w+){0,3} (?:nicht|verbiet\w*|untersag\w*|erlaub\w* (?:mir )?nicht)\b|\b(?:nicht|unmöglich)(?: \w+){0,2} (?:mir|mich|ich)\b"),
    "fr": ("ne|n'*|refus*|impossible|dépass*|déclin*|hors|pas", r"\bje(?: \w+){0,2} (?:ne |n')(?:\w+ )?\w+|\b(?:je|j')(?: \w+){0,4} ?(?:refuse\w*|décline\w*|préfère ne|abstien\w*|dois refuser|dois décliner)\b|\bimpossible (?:pour moi )?de\b|\bm'est (?:\w+ )?(?:impossible|interdit)|\b(?:dépasse\w*|hors de|outrepasse\w*) (?:mes|mon|ma|ce que je)\b|\bne me (?:permet\w*|laisse\w*|autorise\w*)"),
    "es": ("no|niego|rechaz*|imposible|fuera|supera*|declin*|abstengo", r"\bno (?:me |lo |le |les |te |os )*(?:puedo|podré|podría|sé|debo|tengo|estoy|soy|dispongo|conozco|quiero|deseo|sabría|cuento|logro|es posible|está permitido|corresponde|permiten?|autoriza\w*)\b|\b(?:me niego|debo (?:rechazar|declinar)|tengo que (?:rechazar|declinar)|prefiero no|rechazo|declino|me abstengo|me es imposible)\b|\b(?:fuera de|supera\w*|excede\w*|más allá de) (?:mi|mis|lo que)\b"),
    "it": ("non|rifiut*|declin*|impossibile|fuori|supera*|oltre|astengo", r"\bnon (?:mi |lo |ti |vi |le |ci )*(?:posso|potrò|potrei|so|sono|ho|dispongo|conosco|voglio|desidero|devo|saprei|riesco|è possibile|è consentito|è permesso|consentono|permettono|permette|spetta)\b|\b(?:mi rifiuto|devo (?:rifiutare|declinare)|preferisco non|rifiuto di|declino|mi astengo|mi è impossibile)\b|\b(?:al di fuori d\w+|super\w+|va oltre|oltre|esula da\w*) (?:le |la |il |i )?(?:mie|mia|mio|miei|ciò che)\b"),
    "pt": ("não|recus*|declin*|impossível|fora|além|abstenho", r"\bnão (?:me |lhe |o |a )*(?:posso|poderei|poderia|consigo|sei|tenho|estou|sou|disponho|conheço|quero|devo|saberia|é possível|é permitido|permitem|permite|cabe)\b|\b(?:recuso|devo (?:recusar|declinar)|tenho de (?:recusar|declinar)|prefiro não|declino|abstenho)\b|\b(?:fora d\w+|além d\w+|excede\w*) (?:minhas?|meus?|que)\b"),
    "nl": ("niet|geen|niets|weiger*|buiten|afwijz*", r"\b(?:ik|mij|me)\b(?: \w+){0,7} (?:niet|niets|geen)\b|\b(?:ik weiger|moet (?:ik )?weigeren|moet (?:ik )?afwijzen|liever niet)\b|\b(?:buiten|boven) mijn\b|\bmijn(?: \w+){0,3} (?:niet toe|verbied\w*|niet)\b"),
    "sv": ("inte|inget|ingen|vägra*|avstå*|utanför|avböj*", r"\b(?:jag|mig)\b(?: \w+){0,6} (?:inte|inget|inga|ingen|avstå\w*|avböj\w*|vägra\w*)\b|\b(?:utanför|över) (?:min|mitt|mina|vad jag)\b"),
    "da": ("ikke|ingen|intet|afvis*|afslå*|uden|udenfor|avslå*|utenfor", r"\b(?:jeg|mig|meg)\b(?: \w+){0,6} (?:ikke|ingen|intet|afslå\w*|afvise|avslå\w*|avstå\w*|nekte\w*)\b|\b(?:uden for|udenfor|utenfor) (?:min|mit|mitt|mine|hvad jeg|det jeg)\b"),
    "pl": ("nie|odmawiam|poza|odmówić", r"\bnie (?:mogę|wiem|potrafię|jestem|mam|chcę|wolno mi|będę|umiem|powinienem|powinnam|znam|zamierzam)\b|\b(?:odmawiam|muszę odmówić|wolę nie)\b|\b(?:poza|przekracza\w*) (?:mo\w+)\b"),
    "cs": ("ne*|odmítám|mimo", r"\b(?:nemohu|nemůžu|nevím|nejsem|nemám|nesmím|nedokážu|neumím|nechci|nebudu)\b|\b(?:odmítám|musím odmítnout)\b|\bmimo (?:mé|moje|mou)\b"),
    "ro": ("nu|refuz", r"\bnu (?:pot|știu|stiu|sunt|am|vreau|voi|mi se permite|îmi este)\b|\b(?:refuz|trebuie să refuz|prefer să nu)\b"),
    "tr": ("yanıt*|cevap*|yardım*|bilmiyorum|bilgim*|üzgün*|reddet*|dışında*|konuda*", r"\b\w+(?:am[ıi]yorum|em[ıi]yorum|amam|emem|[ae]mayaca[ğg]ım|[ae]meyece[ğg]im)\b|\b(?:bilmiyorum|bilgim yok|reddediyorum|reddetmek zorundayım)\b"),
    "fi": ("en|kieltäydyn|valitettavasti", r"\ben (?:voi|pysty|tiedä|saa|osaa|halua|ole|valitettavasti)\b|\bkieltäydyn\b"),
    "hu": ("nem|sajnos", r"\bnem (?:tudok|tudom|tudhatom|válaszolhatok|segíthetek|vagyok|adhatok|szeretnék|áll módomban)\b"),
    "ru": ("не|отказ*|вынужден*|выходит|затруд*|нет", r"\bне (?:могу|смогу|знаю|имею|буду|вправе|уполномочен\w*|готов\w*|в состоянии|располагаю|хочу|умею|стану|хотел\w* бы|обладаю|владею)\b|\b(?:я|мне|меня)\b(?: \w+){0,5} (?:не|нельзя|нет|запрещ\w*)\b|\b(?:отказываюсь|вынужден\w* отказ\w*|затрудняюсь|воздержусь)\b|\b(?:выходит за|вне|за пределами) (?:рамки |пределы )?(?:моих|моей|моего|мои)\b"),
    "uk": ("не|відмов*", r"\bне (?:можу|зможу|знаю|маю|буду|вправі|готов\w*|володію|хочу)\b|\b(?:відмовляюсь|відмовляюся|мушу відмовити|змушен\w* відмовити)\b"),
    "sr": ("ne|nije*|nisam|nemam|odbijam|не|нисам|немам|одбијам|ne*", r"\b(?:ne (?:mogu|znam|smem|smijem|želim|umem)|nisam (?:u|ovlašćen|siguran|sigurna)|nemam|odbijam|moram da odbijem)\b|\b(?:не (?:могу|знам|смем|желим|умем)|нисам (?:у|овлашћен|сигуран|сигурна)|немам|одбијам|морам да одбијем)\b"),
    "el": ("δεν|αρνούμαι|αδυνατώ", r"\bδεν (?:μπορώ|γνωρίζω|ξέρω|είμαι|έχω|επιτρέπεται|θα)\b|\b(?:αρνούμαι|αδυνατώ)\b"),
    "bg": ("не|нямам|отказвам", r"\b(?:не (?:мога|знам|съм|искам|ми е позволено)|нямам|отказвам|трябва да откажа)\b"),
}
WIDE = re.compile(
    r"(?:お|ご)?(?:答え|回答|返答|返事|手伝い|支援|対応|提供|説明|案内|コメント)(?:する(?:こと)?)?(?:は|を|も|が)?(?:いた)?(?:でき(?:ません|ない|かね)|しかね|致しかね|いたしかね|控え|差し控え)|(?:こと|事)(?:は|が|も)(?:でき(?:ません|ない)|かない)|(?:わか|分か|存じ|知)(?:りません|らない|上げません)|許可されていません|遠慮|お断り"
    r"|(?:我|本人|本助手|恕)[^。！？，]{0,6}(?:无法|不能|不便|不会|没办法|拒绝|無法|沒辦法|拒絕|不知道|不清楚|不确定|不確定|没有|沒有)|(?:无法|不能|不便|無法)(?:为您|为你|對此|对此|就此)?(?:回答|提供|协助|協助|帮助|幫助|讨论|討論|评论|評論|回应|回應|作答|解答)|超出[^。]{0,4}(?:我|能力|范围|範圍)"
    r"|(?:답변|대답|도움|도와|제공|말씀|설명|답)[^.!?]{0,8}(?:수\s*없|어렵|곤란|못)|모르겠|알지\s*못|거절|할\s*수\s*없(?:습니다|어요)"
    r"|لا\s+(?:أستطيع|يمكنني|أعرف|أعلم|أملك|يسعني|أقدر)|لست\s|أعتذر\s+عن|لن\s+أ|أرفض|ليس\s+لدي|אינני|איני|אני\s+לא|לא\s+אוכל|אין\s+לי|ไม่(?:สามารถ|ทราบ|รู้)|मैं\s[^।]*(?:नहीं|असमर्थ)"
)
# other languages: what is polite beside a refusal and answers nothing
POLITE = re.compile(
    r"\b(?:leider|entschuldig\w*|tut mir leid|bitte|danke|dank|verständnis|désolée?|malheureusement|merci|veuillez|regrette|siento|lamento|perdón|gracias|por favor|disculp\w*|dispiace|spiacente|purtroppo|grazie|scusa\w*|desculp\w*|obrigad\w*|infelizmente|helaas|bedankt|spijt|tyvärr|ledsen|tack|förlåt|beklager|desværre|dessverre|takk|tak|przepraszam|niestety|dziękuję|proszę|omlouvám|bohužel|děkuji|prosím|îmi pare rău|din păcate|mulțumesc|üzgünüm|maalesef|teşekkür\w*|lütfen|valitettavasti|kiitos|pahoillani|sajnos|köszönöm|sajnálom|извините|простите|сожалению|спасибо|пожалуйста|жаль|вибачте|жаль|дякую|жао|žao|nažalost|hvala|молим|συγγνώμη|λυπάμαι|δυστυχώς|ευχαριστώ|съжалявам|благодаря)\b"
    r"|\b(?:dies\w+ (?:frage|thema|anfrage)|dazu|darüber|(?:ce|cette) (?:sujet|question|demande)|est[ea] (?:tema|pregunta|solicitud|assunto|pergunta|pedido)|quest[oa] (?:argomento|domanda|richiesta)|deze vraag|dit onderwerp|det här|denna fråga|dette spørgsmål|tego pytania|эт(?:от|ом|у) (?:вопрос\w*|тем\w*))\b"
    r"|申し訳|すみません|ご了承|ご理解|ありがとう|抱歉|对不起|對不起|谢谢|謝謝|感谢|请谅解|죄송|감사|양해|عذر|آسف|شكر|סליחה|מצטער|תודה|ขอโทษ|ขออภัย|क्षमा|धन्यवाद"
)


def _keys(words: str):
    for word in words.split("|"):
        yield " " + word.rstrip("*"), word.endswith("*")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """One automaton over all parts, each with its class or, in lower case, its language."""
    kinds: dict[str, list[tuple[str, bool]]] = {}
    for label, words in [*ENGLISH.items(), *((language, triggers) for language, (triggers, _) in FORMS.items())]:
        for key, open_end in _keys(words):
            kinds.setdefault(key, []).append((label, open_end))
    found = ahocorasick.Automaton()
    for key, labels in kinds.items():
        found.add_word(key, (len(key), labels))
    found.make_automaton()
    return found


_FORMS = {language: re.compile(form) for language, (_, form) in FORMS.items()}
_SPACED = re.compile(r"[^\w']+")


def read_sentence(sentence: str) -> tuple[bool, bool]:
    """(refuses, is polite or about the request only) of a lower-case sentence with straight apostrophes."""
    plain = f" {_SPACED.sub(' ', sentence).strip()} ".replace("'m ", " am ").replace("'re ", " are ")
    parts: list[tuple[int, int, str]] = []
    languages: set[str] = set()
    for end, (size, labels) in _automaton().iter(plain):
        whole = end + 1 == len(plain) or plain[end + 1] == " "
        for label, open_end in labels:
            if whole or open_end:
                if label.islower():
                    languages.add(label)
                else:
                    parts.append((end - size + 1, -(end + 1), label))
    classes, at, polite = [], 0, False
    for start, stop, label in sorted(parts):
        if label == "C":
            polite = True
        if start >= at:
            classes.append("." * min(9, plain.count(" ", at, start)) + label)  # a dot for each word between
            at = -stop
    if REFUSING.search("".join(classes) + "." * min(9, plain.count(" ", at, len(plain) - 1))):
        return True, polite
    if any(_FORMS[x].search(plain) for x in languages):
        return True, polite
    if not sentence.isascii() and WIDE.search(sentence):
        return True, polite
    asks = "".join(classes).strip(".")
    return False, polite or POLITE.search(plain) is not None or (bool(asks) and set(asks) <= set("QV.") and "Q" in asks and plain.count(" ") <= 7)
