import pytest
from ledgerloom.llm.sentences import sentences
from ledgerloom.llm.text_ops import sentence_spans

# Sentences set apart by ‖ in texts whose boundaries were set by hand.
CASES = [
    "The fee was waived.‖ Please call us!‖ Is it safe?‖ Yes.",
    "Mr. Tarkell met Dr. Vostrel at 9 a.m. on Jan. 2.‖ They paid $3.50 (approx. 5 percent).",
    "Their office is in the U.S.‖ It opens at 8 a.m. and closes late.",
    "Wait for J. R. Okanvar of Quarry Co. to sign.‖ Then send it.",
    "I waited... and then it came.‖ Nothing was posted…‖ At noon it was.",
    "She wrote: “Cancel it. I never agreed.”‖ We did.",
    "“Why was I billed twice?” Maress asked at the counter.‖ Nobody knew.",
    "\"Stop the payment!\" J. R. Hespry wrote in the margin.‖ It stopped.",
    "\"Is it safe?\" asked Bram, \"or should I call?\"‖ No answer came.",
    "The merchant says “final sale.”‖ We do not accept that.",
    "(The clerk agreed!)‖ Savings earned 1.75% A.P.Y. from Q4 onward.",
    "It froze as shown on p. 9.‖ Both cards, Nos. 66 and 58, were lost.",
    "frozen by the team.‖Last week it moved.‖ Version 5.4.1 of stmt_2024-03.pdf reads No. 7 as a deposit.",
    "No way!!!‖ Really?!‖ Ok.",
    "It is in the office.‖Dr. Ambrick left.‖J. R. Okanvar stayed!‖M. Tarkell went to the U.S.A. by plane.‖“Why?” Bram asked.",
    "Finished after 21.52 ms.‖ With option --strict it failed.",
    "Am 6. Juni sperrte Fr. Brellin die Karte z. B. lt. S. 25.‖ Die Filiale in der Yorvanestr. 15 hat um 9.30 Uhr geöffnet.",
    "„Bitte stornieren!“, schrieb Fr. Okanvar an die Bank.‖ Danke.",
    "Annulé cf. p. 12.‖ «\xa0Annulez tout !\xa0» a écrit Pell.‖ Pourquoi\xa0?‖ Voilà.",
    "El tipo subió en EE. UU. durante el año.‖ ¿Es seguro?, preguntó Lumi.‖ Llamé a las 9 a. m. y nadie contestó.",
    "«No acepto esto», escribió el Sr. Vostrel.‖ La Sra. Yorvane pagó.",
    "Veja a pág. 8, n.º 45, do extrato.‖ \"Cancelem tudo!\", escreveu a Sra. Hespry.",
    "Расходы на еду и т. д. превысили 5 тыс. руб. в марте 2024 г. без согласия.‖ См. стр. 5, п. 3.‖ «Верните деньги!» — написала клиентка.‖ Ставка выросла.",
    "利率升到4.5%，见第5.1节。‖客户写道：“请取消。我没有同意。”‖“这是谁付的？”她问。‖真的吗？！‖我等了很久……没有变化。",
    "担当者は「確認します。お待ちください。」と言いました。‖本当ですか？！‖ずっと待ちましたが…返金はありません。",
    "명세서 No. 33의 쪽을 보세요.‖ \"취소해 주세요.\" 라고 고객이 적었습니다.‖ 오래 기다렸는데... 환불이 없습니다.",
    "انظر ص. 19 من الكشف رقم 3.‖ كتب د. سالم: «أوقفوا الدفع.»‖ هل هذا آمن؟‖ لا.",
    "अंतिम शेष रु. 9.04 है।‖ “भुगतान रोक दीजिए।” ग्राहक ने लिखा।‖ डॉ. Hespry ने कहा।",
    "รอนานแต่ยังไม่ได้เงินคืนค่ะ‖ ยอดคือ 50.97 บาท ครับ‖ พ.ศ. 2567 ก่อนเวลา 9.30 น. ครับ",
    "Summary of Q2‖\n\nIt rose\nsharply.‖\r\n  \r\nDear Mr. Okanvar",
    "1. Call the branch.‖\n2. Overdraft item, max. 4 per day‖\n3. Keep receipts (e.g. from Books).",
    "* one‖\n* two. And more‖\n\nEnd.",
    "so they closed it at like 3 a.m.‖ got charged twice lol 😂!‖ hmm... not sure.‖ ok thanks",
    "No final mark here",
    # Held out: vocabulary of other domains than the test tables'.
    "“Is it late?” the very old and rather tired keeper of the lighthouse on the northernmost of the three small islands beyond the grey harbour wall of the fishing village asked.‖ The gulls were silent.",
    "“Land ahead!”‖ The crew ran to the rail.‖ Later the captain said nothing.",
    "Prof. Lindqvist found 3.2 mg of copper in sample No. 14.‖ Was it an error?‖ The lab in Apt. 5 on Elm St. says no.",
    "The orchestra (est. 1902) played Op. 5 and an encore.‖ Tickets, incl. fees, cost €12.50.‖ Nobody complained!",
    "Il Sig. Bianchi abita a Torino.‖ L'Ing. Greco arriva alle 9.‖ Perché?",
    "Zakład Młyn Sp. z o.o. działa od 1999 r. bez przerwy.‖ Dyrektor mieszka przy ul. Lipowej 3.",
    "„Komm sofort!“, rief der Bäcker von der anderen Seite des Marktplatzes.‖ Am 3. März regnete es.",
    "The rocket rose at 6 a.m. over Cape Verde.‖ \"Beautiful. Simply beautiful. I could cry. Truly,\" whispered the engineer.‖ Then it was gone.",
    "Le train arrive à 8 h.‖ « Où est Mme Leroux ? » demanda le contrôleur.‖ Personne ne répondit.",
    "La reina habló.‖ «Nunca. Jamás. Ni hoy ni mañana.», dijo.‖ Después calló.",
    "桜が咲いた。‖「きれいだ。本当に。もう一度見たい。」と祖母は言った。‖春だった。",
    "﻿ Leading mark.‖ Next.",
]


@pytest.mark.parametrize("case", CASES)
def test_by_hand(case):
    text = case.replace("‖", "")
    want, at = [], 0
    for part in case.split("‖"):
        a, b = at, at + len(part)
        at = b
        while a < b and (text[a].isspace() or text[a] == "﻿"):
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        want.append((a, b))
    got = sentences(text)
    assert got == want, [text[a:b] for a, b in got]


def test_nothing_visible():
    for t in (None, "", " \n\t ", "﻿", "\n\n\n"):
        assert sentences(t) == []


def test_long_text_without_and_with_marks():
    assert len(sentences("word " * 200_000)) == 1
    assert len(sentences("One ends here. " * 20_000)) == 20_000
    assert len(sentences("An “open quote. " + "One ends here. " * 500)) > 450


def test_sentence_of_many_marks_is_whole():
    many = "They lost cards " + ", ".join(f"No. {i}" for i in range(1, 121)) + " in May."
    text = many + " We know."
    assert [text[a:b] for a, b in sentences(text)] == [many, "We know."]
    assert len(sentences(", ".join(f"No. {i}" for i in range(20_000)))) == 1
    assert len(sentences("An “open. " * 20_000)) > 1


@pytest.mark.parametrize("quoted", ["One came. " * 4 + "Two left.", "No way! " * 3 + "Never!", "One came. " * 300 + "Two left."])
def test_quotation_of_many_sentences_is_whole(quoted):
    for a, b in ("“”", '""', "«»", "„“"):
        text = f"Bram wrote: {a}{quoted}{b} We did. Yes."
        assert [text[x:y] for x, y in sentences(text)] == [text[: -len(" We did. Yes.")], "We did.", "Yes."]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef!", 1), (2, None, 2), (3, "", 3), (1, "Ab cd. Ef!", 4), (4, "😀 ok. Fine.", 5)], "doc_id bigint, text string, start_char int")
    got = sorted(tuple(r) for r in sentence_spans(df, "doc_id", "text").collect())
    assert got == sorted([(1, 0, 6), (1, 7, 10)] * 2 + [(4, 0, 5), (4, 6, 11)])
    assert sentence_spans(df.limit(0), "doc_id", "text").count() == 0
