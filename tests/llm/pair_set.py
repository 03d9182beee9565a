"""Pairs written for the tests alone, of other things than the test tables tell: (question, options, answer, defect or None)."""

EN = [
    "Why did the pilot delay the departure?",
    "Which ingredient goes into the soup first?",
    "How long does the ferry take to the island?",
    "Who signed the rental contract?",
    "What is the capital of Portugal?",
]
REFUSED = """I'd rather not respond to that.
I'm unable to help with this request.
I cannot provide medical advice about this.
Sorry, I can't answer questions about real people.
I won't be able to assist you with that topic.
We are not able to answer this at the moment.
I must decline this request.
I have to decline to comment on that.
I would prefer not to answer.
I don't feel comfortable discussing this.
As a language model, I cannot give legal advice.
My programming does not allow me to share that.
Our policy prohibits me from answering such questions.
Your request has been denied.
This question cannot be answered here.
The response was blocked by the safety filter.
That would be against our guidelines.
I am not permitted to reveal this information.
I'm not going to answer that.
I refuse to speculate about this.
Unfortunately, I cannot comply with your wish.
It is inappropriate for me to comment on private matters.
No comment can be given on this subject.
I am not allowed to identify people.
Sorry, unable to help here.
Non posso rispondere a questa domanda.
Mi dispiace, non sono in grado di fornire questa informazione.
Mi rifiuto di commentare.
Ik kan deze vraag helaas niet beantwoorden.
Sorry, daar kan ik niet bij helpen.
Ik mag hier geen commentaar op geven.
Nie mogę odpowiedzieć na to pytanie.
Przykro mi, ale nie jestem w stanie pomóc.
Odmawiam odpowiedzi.
Üzgünüm, bu konuda yardımcı olamam.
Bu soruya cevap veremiyorum.
Xin lỗi, tôi không thể trả lời câu hỏi này.
Tôi xin từ chối bình luận.
Jag kan tyvärr inte hjälpa till med det.
Jag avböjer att kommentera.
Jeg kan desværre ikke besvare spørgsmålet.
Jeg kan dessverre ikke hjelpe deg med dette.
عذراً، لا أستطيع الإجابة على هذا السؤال.
لا يمكنني مساعدتك في هذا الأمر.
К сожалению, я не могу помочь с этим запросом.
Я отказываюсь отвечать.
Вибачте, я не можу відповісти на це запитання.
죄송하지만 이 요청은 도와드릴 수 없습니다.
이 질문에 대한 답변은 어렵습니다.
Maaf, saya tidak bisa membantu dengan hal ini.
Bohužel vám s tím nemohu pomoci.
Nu pot răspunde la această întrebare.
Sajnálom, ebben nem tudok segíteni.
Valitettavasti en voi auttaa tässä asiassa.
Λυπάμαι, δεν μπορώ να βοηθήσω με αυτό.
माफ़ कीजिए, मैं इसमें मदद नहीं कर सकता।
ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้
מצטער, איני יכול לעזור בנושא זה.
申し訳ございませんが、その件についてはお手伝いできません。
ご質問への回答はいたしかねます。
很抱歉，我不能协助您处理此事。
我无法提供这方面的建议。
恕我不便评论。
Lo siento, no puedo ayudarte con eso.
Me niego a responder.
Desculpe, não consigo ajudar com isso.
Prefiro não comentar o assunto.
Je suis désolé, je ne peux pas vous aider.
Je préfère ne pas répondre.
Leider kann ich Ihnen dabei nicht helfen.
Ich möchte dazu keine Auskunft geben.
Ihre Anfrage wurde abgelehnt.""".splitlines()
#: Whole answers in English to an English question, some with words of refusals, of other languages or of placeholders.
FINE = """I can't see the sign in the dark, so the answer is B.
The pilot refused to take off because of the storm.
He could not answer the call in time.
The offer was declined by the board, so it is C.
I cannot find the first page, but the answer is the onions.
The ferry can't leave before noon; it takes two hours.
She was not allowed to enter the cockpit.
The contract was rejected twice and then signed by Mrs. Ortiz.
They passed on the first offer.
Lisbon.
Lisbon is the capital of Portugal.
the onions
carrots and onions
Two hours.
two hours and ten minutes
about 45 minutes
The landlord
the landlord's daughter
Mrs. Ortiz signed it.
B
(C)
**A**
D.
Answer: B
7
12.5 km
3:45
Yes
No.
No, it was the co-pilot.
Not yet.
Because of fog.
Heavy fog over the runway.
The 6" pipe had burst.
He is 5' 10" tall.
The sign says "Sortie" and hangs above the gate.
The label reads "Vorsicht", so it is German.
It was the crème brûlée that came first.
The déjà vu scene comes first.
red cup on the left table
blue bag near the exit
A. red wine and onions
"Fasten seat belts"
{"answer": "B"}
{"answer": "onions", "sure": true}
<answer>B</answer>
It is ¾ full.
The answer is no.
It can't be helped; the fog was too thick.
The captain said he was unable to land, so they waited.
Nobody could help the passengers until noon.
Pasta
Vienna
A taxi
John Smith
Madrid, then Lisbon.
The soup is called gazpacho.
First the oil, then the garlic.
It was cut short.
The end of the film is missing.
The answer to the question is on page 4.
Question 4 was signed by the tenant.
Why the delay happened is not shown, but fog is likely.
They ran out of fuel!
What a storm!
No answer sheet was signed by the tenant.
The request was signed by Mr. Lee.
The null value was written by the pilot.
None of the passengers signed it.
Nothing else was added before the onions.""".splitlines()
EMPTY = ["", "   ", "\n\t", "​​", "...", "—", "--", "**", "```\n```", "<answer></answer>", '{"answer": null}', '{"answer": ""}', "N/A", "n/a.", "null", "null" + " " * 60, "n/a" + "." * 50,
         "None", "(none)", '"nan"', "undefined", "[]", "{}", "_", "???", "<think>\n</think>\n\n", " ", "*" * 80, "-" * 200, "no_answer", None]
ABRUPT = """The pilot waited because the
They left after the storm had
The onions go in first. Then the co
The ferry takes two hours. It leaves at noon and arr
Heavy fog was over the runway and the crew had to wai
First the oil is heated, and then
The contract was signed by the landlord. The tenant's na
It is B. The fog was so thick that no
The cook adds the onions,
The answer is that the ferry takes
The delay was due to fog. Pass…
The delay was due to fog. Passen [...]
The delay was due to fog. Pas�
The delay was due to fog. The crew would have
La salida se retrasó. El piloto esp
Zuerst die Zwiebeln. Danach das
Le contrat a été signé. Le propr
O barco demora duas horas. Depois che
Eerst de uien. Daarna de kno
最初に玉ねぎを入れます。次に油
先放洋葱。然后再""".splitlines()
UNCLOSED = ["<think>The runway was closed. So", "<think>It was closed.\n</thi", '{"answer": "B", "why": "The runway', '{"answer": "B"', "```\nThe onions go in first.", 'The sign says "Keep out', "It takes two hours (or a bit mo", "**The landlord",
            "<answer>B", "The label reads “Exit", "[{\"a\": 1}, {\"a\":", "It was Mrs. Ortiz (the landlord.", "```json\n{\"answer\": \"B\"}", 'It says "EXIT 4" and "GO', "「出口"]
#: By language of the answer, to an English question.
OTHER = """Der Pilot wartete wegen des Nebels.
Zuerst kommen die Zwiebeln in die Suppe.
Kaffeetasse
Zwei Stunden.
Le pilote attendait à cause du brouillard.
Rouge vif
Deux heures.
C'est le propriétaire qui a signé.
El piloto esperó por la niebla.
Primero se ponen las cebollas.
Dos horas y diez minutos.
O piloto esperou por causa do nevoeiro.
Não.
Duas horas.
Il pilota ha aspettato per la nebbia.
Prima si mettono le cipolle.
De piloot wachtte vanwege de mist.
Eerst gaan de uien in de soep.
Pilot czekał z powodu mgły.
Najpierw cebula, potem czosnek.
Pilot čekal kvůli mlze.
Nejdříve se přidá cibule.
Pilot sis yüzünden bekledi.
Önce soğanlar konur.
Phi công phải chờ vì sương mù.
Hành được cho vào trước.
Pilot menunggu karena kabut.
Bawang dimasukkan lebih dulu.
Piloten väntade på grund av dimman.
Först läggs löken i.
Piloten ventede på grund af tågen.
Først kommer løgene i suppen.
Pilotul a așteptat din cauza ceții.
Mai întâi se pune ceapa.
A pilóta a köd miatt várt.
Először a hagyma kerül bele.
Lentäjä odotti sumun takia.
Ensin laitetaan sipulit.
Пилот ждал из-за тумана.
Сначала кладут лук.
Ο πιλότος περίμενε λόγω ομίχλης.
كان الطيار ينتظر بسبب الضباب.
הטייס חיכה בגלל הערפל.
पायलट कोहरे के कारण रुका रहा।
นักบินรอเพราะหมอก
霧のためパイロットは待ちました。
まず玉ねぎを入れます。
飞行员因为大雾而等待。
先放洋葱。
안개 때문에 조종사가 기다렸습니다.""".splitlines()
#: (question, answer in its language), which is no defect, and (question, answer in another), which is one.
SAME = [("Warum hat der Pilot gewartet?", "Wegen des Nebels."), ("Warum hat der Pilot gewartet?", "Der Nebel war zu dicht."), ("¿Quién firmó el contrato?", "El dueño de la casa."), ("¿Cuánto tarda el barco?", "Dos horas."),
        ("Qui a signé le contrat ?", "Le propriétaire."), ("Quem assinou o contrato?", "O dono da casa."), ("Chi ha firmato il contratto?", "Il proprietario della casa."), ("Wie heeft het contract getekend?", "De eigenaar van het huis."),
        ("Kto podpisał umowę?", "Właściciel domu."), ("Sözleşmeyi kim imzaladı?", "Evin sahibi."), ("誰が契約書に署名しましたか？", "大家さんです。"), ("谁签了合同？", "房东签的。"), ("Кто подписал договор?", "Хозяин дома."), ("누가 계약서에 서명했나요?", "집주인입니다."),
        ("誰が契約書に署名しましたか？", "A" + " " * 30), ("誰が契約書に署名しましたか？", "**A**\n\n\n" + "\n" * 30), ("誰が契約書に署名しましたか？", "2"), ("", "El dueño."), (None, "大家さんです。"), ("12 + 7 = ?", "diecinueve")]
MIXED = [("Warum hat der Pilot gewartet?", "Because of the thick fog."), ("¿Quién firmó el contrato?", "The owner of the house signed it."), ("Qui a signé le contrat ?", "The owner of the house."), ("Quem assinou o contrato?", "El dueño de la casa lo firmó ayer."),
         ("Chi ha firmato il contratto?", "The owner of this house."), ("誰が契約書に署名しましたか？", "The owner."), ("誰が契約書に署名しましたか？", "房东昨天在办公室里签了合同。"), ("谁签了合同？", "Yes, the owner."), ("Кто подписал договор?", "The owner of the house."),
         ("누가 계약서에 서명했나요?", "家主が署名しました。"), ("Wie heeft het contract getekend?", "Le propriétaire de la maison."), ("Kto podpisał umowę?", "The owner of the house."), ("Sözleşmeyi kim imzaladı?", "The owner of the house.")]
COPIES = [lambda q, o: q, lambda q, o: q.upper(), lambda q, o: f"**{q}**", lambda q, o: f"Question: {q}", lambda q, o: f"{q}\nOptions: {o}\nAnswer with the letter only.", lambda q, o: f"{q} {q}"]
OPTIONS = "the tall mast\tthe second wheel\ta wet rope"


def pairs() -> list[tuple[str | None, str | None, str | None, str | None]]:
    """All pairs with what is wrong with each: the kind that names it."""
    out = []
    for lists, kind in ((REFUSED, "refusal"), (FINE, None), (EMPTY, "empty"), (ABRUPT, "abrupt"), (UNCLOSED, "unclosed"), (OTHER, "other_language")):
        for i, text in enumerate(lists):
            q = EN[i % len(EN)]
            if kind == "abrupt" and not text.isascii() or kind == "abrupt" and text.startswith(("Zuerst", "La salida", "Eerst", "O barco")):
                q = ""  # to be judged by its end alone
            out.append((q, None, text, kind))
    out += [(q, None, a, None) for q, a in SAME] + [(q, None, a, "other_language") for q, a in MIXED]
    shown = " ".join(f"{c}. {o};" for c, o in zip("ABC", OPTIONS.split("\t")))
    out += [(q, OPTIONS, f(q, shown), "copies_question") for q in EN for f in COPIES]
    return out
