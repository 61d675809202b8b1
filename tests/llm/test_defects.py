import pytest

from gristmill.llm import defects as D

Q = "Which evidence shows that the network group reviews service tokens within ten days?"


@pytest.mark.parametrize(
    "response, kind",
    [
        (None, "empty"), ("", "empty"), ("\u200b \xa0", "empty"), ("**Answer:**\n\n", "empty"), ("```\n```", "empty"), ('{"answer": ""}', "empty"), ("<answer></answer>", "empty"), ("[no response]", "empty"), ("Error: Model timeout after 3 s", "empty"), ("TASK_FAILURE: worker 4 stopped", "empty"),
        ("Timeout while waiting for slot 9", "empty"), ("n/a", "empty"),
        ("I cannot assist with this. Thank you for understanding.", "refusal"), ("Je ne peux pas répondre à cette question.", "refusal"), ("Diese Frage darf ich nicht beantworten.", "refusal"), (f"You ask: {Q} I don't know.", "refusal"), ("I’M AFRAID I CAN’T GO INTO THAT.", "refusal"),
        ("I can't give legal advice, but the practical steps are these: The network group keeps a signed list of tokens and compares it every week.", None),
        (Q, "copied"), (Q.upper(), "copied"), (f"> {Q}", "copied"), (f"{Q}\n{Q}", "copied"), (Q.replace("network ", ""), "copied"), (f"“{Q}”", "copied"), (f"{Q}\n\nThe tokens are listed in a signed register that the board keeps for two years.", None),
        ("The group keeps a register. It compares the", "truncated"), ("The group keeps a register.\n```\na = 1\nb =", "truncated"), ("1. The group keeps a register.\n2. The board reads it.\n3.", "truncated"), ("| A | B |\n|---|---|\n| x | y |\n| z", "truncated"), ("The group keeps a register (see", "truncated"),
        ("The group keeps a register.\n\n- Review of tokens\n- Review of badges", None), ("| A | B |\n|---|---|\n| x | y |", None), ("The group keeps it.\n```\na = 1\n```", None), ("The group keeps it.\n\nReferences: AC-1, SC-7", None), ("90 days", None), ("AC-2", None), ("Yes.", None), ("The group keeps it. (see AC-5)", None),
        ("Das Register wird von der Fachabteilung geführt und einmal im Jahr geprüft.", "other_language"), ("Мера касается раздела и пересматривается после сбоя.", "other_language"), ("The group keeps a register. A Spanish branch may call it registro de actividades.", None),
    ],
)
def test_types(response, kind):
    assert D.defect(Q, response) == kind


LONG = "Which evidence shows that the group keeps its register? " + "It holds tokens, badges and keys of many branches in several towns. " * 30
REASONS = "because the answer depends on contracts and settings of your company that only a qualified person who has read all of them in full could weigh in a responsible way"


@pytest.mark.parametrize(
    "question, response, kind",
    [
        (LONG, f"You asked: {LONG}\n\nI cannot help with that.", "refusal"), (Q, "I'm sorry, I cannot help with this question. " * 60, "refusal"), (Q, f"I am afraid that I am not able to answer this {REASONS}.", "refusal"), (Q, f"Es tut mir leid, diese Frage kann ich nicht beantworten, {REASONS}.", "refusal"),
        (Q, f"While I see why you ask, I cannot answer this {REASONS}.", "refusal"), (Q, f"Accounts that are unable to enrol are closed by the board {REASONS}.", None), (Q, f"Although I cannot give legal advice, the network group keeps a signed list of tokens {REASONS}.", None), (Q, f"I can't give legal advice, but the group keeps a signed list of tokens {REASONS}.", None),
        (Q, "I cannot give legal advice.\n\n" + "The network group keeps a signed list of tokens. " * 60, None), (Q, "Traceback (most recent call last):\n" + '  File "worker.py", line 4, in run\n    call(x)\n' * 30 + "ValueError: no slot", "empty"),
        ("什么是防火墙？", "什么是防火墙", "copied"), ("Why MFA?", "**why mfa**", "copied"), ("是否需要加密存储？", "需要加密存储。", None), ("Is MFA on?", "MFA is on.", None), ("?", "Yes.", None),
    ],
)
def test_length_alone_decides_nothing(question, response, kind):
    assert D.defect(question, response) == kind


def test_automaton_knows_exactly_the_substrings():
    text = "abcbcabcacbb"
    automaton = D.SuffixAutomaton(text)
    known = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    import itertools

    for n in range(1, 5):
        for letters in itertools.product("abc", repeat=n):
            word = "".join(letters)
            assert (automaton.coverage(word, n, 1.0) == 1.0) == (word in known)


def test_table(spark):
    rows = [("r1", Q, None, "a"), ("r1", Q, None, "a"), ("r2", None, "", "b"), ("r3", Q, "The tokens are kept in a register. " * 2000, "c"), ("r4", None, "A complete answer.", "d"), (None, Q, "n/a", "e")]
    df = spark.createDataFrame(rows, "response_id string, question string, model_response string, k string")
    got = {tuple(r) for r in D.defective_responses(df).collect()}
    assert got == {("r1", "empty"), ("r2", "empty"), (None, "empty")}
    assert D.defective_responses(df.limit(0)).collect() == []


# sentences of nobody's tables, written before they were run
REFUSED = """That is one I will leave to others to address.
I'd sooner not get into that.
I'm not the right tool for this, and I can't weigh in.
That falls outside my remit.
We are unable to process this request.
I do not have access to that information.
My training does not cover this topic.
Nothing I could offer here would be reliable.
I'm going to sit this one out.
Answering that isn't something I'm able to do.
I would prefer not to speculate on this.
No comment.
Unable to answer.
Cannot assist with that.
I haven't been given enough information to respond.
This exceeds my knowledge.
I regret that I must refrain from answering.
Jag kan tyvärr inte svara på den frågan.
Jeg kan desværre ikke hjælpe med det.
Nie mogę odpowiedzieć na to pytanie.
Nažalost, ne mogu da odgovorim na to pitanje.
К сожалению, я не могу ответить на этот вопрос.
Я не знаю ответа.
申し訳ありませんが、この質問にはお答えできません。
抱歉，我无法回答这个问题。
죄송하지만 이 질문에는 답변할 수 없습니다.
Üzgünüm, bu soruya yanıt veremiyorum.
En voi vastata tähän kysymykseen.
Sajnos nem tudok válaszolni erre a kérdésre.
Omlouvám se, ale na tuto otázku nemohu odpovědět.
Îmi pare rău, nu pot răspunde la această întrebare.
Δεν μπορώ να απαντήσω σε αυτή την ερώτηση.
لا أستطيع الإجابة عن هذا السؤال.
Ich möchte mich dazu nicht äußern.
Das übersteigt meine Kenntnisse.
Je préfère ne pas me prononcer.
Il m'est impossible de répondre à cette question.
Lo siento, no estoy autorizado para hablar de eso.
Me niego a responder.
Non ho informazioni sufficienti per rispondere.
Não tenho dados para responder a isso.
Daar mag ik helaas niets over zeggen."""
ANSWERED = """Accounts that are unable to enrol are closed.
The group does not know the tokens; the register holds them.
Users cannot share passwords under the policy.
Do not give tokens to vendors.
The network group keeps a signed list and never shares it.
No answer is recorded after ten days, so the ticket is closed by the lead.
Ask the auditor for the signed log of the last review.
Access is refused after three attempts.
I would keep a signed register and review it weekly.
Avoid sharing tokens with contractors.
The policy prohibits sharing of tokens outside the group.
Requests are declined by the board when a token has lapsed.
It is not possible to enrol without a second factor.
The signed register of tokens shows it."""


def test_refusals_in_many_languages_and_answers_that_negate():
    assert [r for r in REFUSED.split("\n") if D.defect(Q, r) != "refusal"] == []
    assert [a for a in ANSWERED.split("\n") if D.defect(Q, a) is not None] == []


@pytest.mark.parametrize("text, name", [("ネットワーク担当は毎月トークンを確認し、登録簿に記録します。", "japanese"), ("网络小组每月检查令牌并记录在册。", "cjk"), ("네트워크 그룹은 매달 토큰을 검토합니다.", "hangul"), ("Gruppen fører et register over alle nøgler, og det bliver gennemgået hver måned af bestyrelsen.", "da"), ("The group keeps “signed” lists – and reviews them – at the end of each month.", "en")])
def test_languages(text, name):
    assert D.language(text) == name


def test_quick_look_before_the_automaton_rejects_nothing_it_would_find():
    import random

    rng = random.Random(1)
    for _ in range(400):
        asked = "".join(rng.choice("abcd") for _ in range(rng.randint(12, 80)))
        given = "".join(asked[(i := rng.randrange(len(asked))) : i + rng.randint(1, 30)] if rng.random() < 0.8 else rng.choice("xyz") * rng.randint(1, 9) for _ in range(rng.randint(1, 9)))
        for outside in (0.14, 0.5):
            if D.SuffixAutomaton(asked).coverage(given, 6, outside) >= 1 - outside:
                assert not D._mostly_foreign(given, asked, 6, outside)
