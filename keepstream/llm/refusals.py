"""Answers that decline to answer, in many languages.

A refusal is a speaker or a service that will not or may not do what answers a
question: a head ("I cannot", "no puedo") with an act ("answer", "describe",
"comentar") in the same sentence, or a phrase that says both by itself. What the
speaker merely cannot see, or what someone else cannot do, has no such head or no
such act. A text that gives an answer besides is no refusal.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

#: Most characters between a head and its act.
REACH = 60


@dataclass(frozen=True)
class Declining:
    """Patterns of one language: heads that need an act after (or, with ``back``, before) them, and phrases of their own.

    ``stems`` begin words of which every refusal of the language has one: a cheap test
    before the patterns.
    """

    stems: tuple[str, ...]
    heads: str
    acts: str
    phrases: str = ""
    back: bool = False
    edge: str = r"\b"

    def patterns(self) -> list[re.Pattern]:
        gap = rf"[^.!?。！？।\n]{{0,{REACH}}}?"
        both = rf"{self.edge}(?:{self.acts}){gap}(?:{self.heads})" if self.back else rf"{self.edge}(?:{self.heads}){gap}{self.edge}(?:{self.acts})"
        return [re.compile(x) for x in (both, self.phrases and rf"{self.edge}(?:{self.phrases})") if x]


DECLINING = {
    "en": Declining(
        ("not", "cannot", "can't", "couldn't", "won't", "wouldn't", "don't", "doesn't", "unable", "declin", "refus", "pass", "against", "outside", "no answer", "no comment", "no response", "no reply", "unanswered", "inappropriate", "denied", "blocked", "rejected", "withheld", "prohibit", "forbid", "prevent", "comfortable", "abstain"),
        r"(?:i|we)(?:'m|'re| am| are| was| were)?(?: \w+){0,2}? (?:can ?not|can't|could not|couldn't|will not|won't|would not|wouldn't|may not|must not|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|not going to|rather not|prefer not to|not comfortable)"
        r"|i'd rather not|i'd prefer not to",
        r"answer\w*|respond\w*|reply\w*|help\w*|assist\w*|provid\w+|give|giving|offer\w*|comment\w*|discuss\w*|describ\w+|identif\w+|recogni[sz]e who|speculat\w+|guess\w*|tell you|share\w*|disclos\w+|reveal\w*|engag\w+|compl[yi]\w*|complet\w+|fulfil\w*|process\w*|support that|judg\w+|do that|do this|view \w+ (?:analy\w+ )?videos?|view (?:or analy[sz]e )?videos?|watch videos?|analy[sz]e \w*\s?videos?|access\w* (?:the )?(?:video|footage|file)s?|say(?= ?(?:$|[.,;!?]))",
        r"(?:i|we)(?:'m| am| are)? (?:\w+ ){0,2}?(?:must|have to|need to|will have to|will)(?: \w+)? (?:decline|refuse|pass on|abstain|take a pass)"
        r"|(?:i|we) (?:\w+ )?(?:decline|refuse) to|(?:i|we) (?:do not|don't) feel comfortable|as an? (?:ai|assistant|language model)[^.!?]{0,40}\b(?:cannot|can't|unable|not able|decline|pass)\b"
        r"|(?:my|our) (?:\w+ )?(?:guidelines|instructions|policies|policy|rules|programming|training)(?: \w+)? (?:prevents?|forbids?|prohibits?|(?:do|does) not (?:allow|permit|let)|(?:don't|doesn't) (?:allow|permit|let))"
        r"|against (?:my|our|the) (?:\w+ )?(?:instructions|guidelines|policy|policies|rules|terms)"
        r"|(?:request|question|content|query|prompt|answer|response|material)s? (?:(?:was|is|were|are|has been|have been|had to be|must be) )?(?:refused|declined|denied|blocked|rejected|withheld)"
        r"|(?:request|question|query|prompt|answer)s? (?:cannot|can't|can not|could not|may not|will not|won't) be (?:\w+ )?(?:answered|completed|processed|fulfilled|given|provided|met|discussed|shown|displayed)"
        r"|no (?:answer|response|reply|comment) (?:will|can|may|could) be (?:\w+ )?(?:given|provided|made|offered)|(?:question|request|this) (?:\w+ )?(?:stays|remains|goes|is left|must stay|must remain) unanswered"
        r"|outside (?:of )?(?:what (?:is|may|can|i|we)|(?:my|our) (?:scope|abilities|capabilities|remit))|not something (?:that |which )?(?:can|may|i|we)\b|(?:would|it is|it's|is) (?:be )?inappropriate (?:for me )?to",
    ),
    "en, no speaker": Declining(
        ("not permitted", "not allowed", "not authori", "unable to", "cannot ", "can't ", "declin", "refusing", "able to", "cannot", "can't"),
        r"(?:(?<=^)|(?<=sorry, )|(?<=sorry )|(?<=but )|(?<=unfortunately, )|(?<=unfortunately ))(?:not (?:permitted|allowed|authori[sz]ed|able) to|unable to|cannot|can't|declining to|refusing to)",
        r"answer\w*|respond\w*|reply\w*|help\w*|assist\w*|provid\w+|give|comment\w*|discuss\w*|describ\w+|identif\w+|speculat\w+|guess\w*|judg\w+|disclos\w+|share|reveal|comply|complete|fulfil\w*",
        edge="",
    ),
    "fr": Declining(
        ("ne p", "ne s", "ne v", "ne m", "refus", "impossible", "interdit", "préfère", "déclin", "pas en mesure", "autoris", "n'est pas possible", "je ne", "nous ne", "m'est", "rejetée", "bloquée", "il ne m'", "il nous", "rejeté", "bloqué", "il m'"),
        r"(?:je|nous) ne (?:\w+ )?(?:peux|puis|pouvons|suis|sommes|souhaite|souhaitons|veux|voulons|dois|saurais)|il (?:m'|nous |ne m')(?:\w+ ){0,2}(?:impossible|interdit|possible|permis)|m'est impossible|je préfère ne pas|il (?:n'est|m'est) pas possible|pas (?:en mesure|autorisée?s?) (?:de|à)",
        r"répond\w*|aid\w+|assist\w*|fourni\w*|donn\w+|comment\w+|décri\w+|identifi\w+|discut\w+|parler|dire|traiter|satisfai\w+|accéder|partager|révéler|analyser|évoquer|prononcer",
        r"(?:je|nous) (?:refus\w+|dois refuser|dois décliner|décline|devons refuser|devons décliner)|(?:demande|question|requête|réponse|contenu)s? (?:est |a été |sont |ont été )?(?:refusée?s?|rejetée?s?|bloquée?s?|déclinée?s?)",
    ),
    "es": Declining(
        ("no pued", "no pode", "no me ", "no es posible", "no estoy", "no estamos", "no tengo perm", "no debo", "no voy a", "no se me", "niego", "prefiero no", "rechaz", "declin", "denega", "deniega", "lamento no", "normas", "directrices", "instrucciones", "no podr", "no quiero", "no vamos", "no tengo", "no debemos", "bloquead", "negarme", "mis "),
        r"no (?:puedo|podemos|podría|me es posible|es posible|estoy autorizad[oa]|estamos autorizad[oa]s|estoy en condiciones|se me permite|me está permitido|tengo permi\w+|tengo permitido|debo|debemos|voy a|vamos a|quiero)|prefiero no|me niego a|lamento no poder",
        r"respond\w+|contest\w+|ayud\w+|asisti\w*|proporcion\w+|ofrec\w+|dar\b|coment\w+|describ\w+|identific\w+|discuti\w*|hablar|decir\w*|atender|compartir|revelar|analizar|completar|opinar|facilitar",
        r"me niego|debo (?:rechazar|declinar|negarme)|(?:solicitud|petición|pregunta|respuesta|contenido)(?: \w+)? (?:ha sido |fue |queda |es |está )?(?:rechazad|denegad|bloquead)\w+|se (?:deniega|rechaza) (?:la|esta|su) (?:solicitud|petición|pregunta)|mis (?:normas|directrices|instrucciones|políticas) (?:me |no )",
    ),
    "pt": Declining(
        ("não p", "não me ", "não é poss", "não estou", "não tenho perm", "não consigo", "não devo", "não vou", "recus", "prefiro não", "declin", "negad", "bloquead", "lamento não", "diretrizes", "instruções", "regras", "não tenho", "não quero", "rejeitad", "políticas", "não estamos", "não conseguimos"),
        r"não (?:posso|podemos|poderia|me é possível|me é permitido|é possível|estou autorizad[oa]|tenho permi\w+|tenho autori\w+|consigo|conseguimos|devo|vou|quero)|prefiro não|lamento não poder",
        r"respond\w+|ajud\w+|auxili\w+|assist\w+|fornec\w+|oferec\w+|dar\b|coment\w+|descrev\w+|identific\w+|discut\w+|falar|dizer|atender|partilhar|compartilhar|revelar|analisar|opinar|prestar",
        r"(?:me )?recuso(?:-me)?|devo (?:recusar|declinar)|(?:pedido|solicitação|pergunta|resposta|conteúdo)(?: \w+)? (?:foi |é |está )?(?:recusad|negad|rejeitad|bloquead)\w+|minhas (?:diretrizes|instruções|regras|políticas) (?:me |não )",
    ),
    "de": Declining(
        ("nicht", "keine", "nichts", "ablehn", "abgelehn", "lehne", "verweiger", "untersagt", "verwehrt", "unmöglich", "zurückgewiesen", "blockiert", "kein", "passen"),
        r"(?:ich|wir) (?:kann|darf|möchte|werde|will|können|dürfen|möchten|werden|wollen)(?: \w+){0,8}? ?\b(?:nicht|keine?n?|nichts)|(?:kann|darf|möchte|werde|können|dürfen) (?:ich|wir)(?: \w+){0,6}? ?\b(?:nicht|keine?n?|nichts)|es ist mir (?:leider )?(?:nicht (?:möglich|erlaubt|gestattet)|untersagt|unmöglich)|ich bin nicht (?:in der lage|befugt|berechtigt)|mir ist es nicht (?:möglich|erlaubt|gestattet)",
        r"(?:be)?antwort\w*|helf\w*|behilflich|unterstütz\w*|kommenti\w+|kommentar\w*|beschreib\w*|identifizi\w+|auskunft|auskünfte|angaben|äußern|sagen|geben|bereitstell\w*|besprech\w*|diskuti\w*|erfüllen|weitergeben|preisgeben|bearbeit\w*|analysi\w+",
        r"(?:ich|wir) (?:lehne|lehnen|verweiger\w+)|(?:ich|wir) (?:muss|müssen)(?: \w+){0,6}? (?:ablehnen|verweigern|passen)|(?:anfrage|frage|antwort|inhalt|bitte)(?: \w+){0,6}? (?:abgelehnt|verweigert|blockiert|zurückgewiesen|nicht beantwortet)|nicht (?:gestattet|erlaubt)[^.!?]{0,40}(?:antwort|beschreib|kommentier|auskunft)\w*",
    ),
    "it": Declining(
        ("non p", "non sono", "non mi ", "non è possibile", "rifiut", "preferisco non", "declin", "respint", "bloccat", "non siamo", "non voglio", "negat"),
        r"non (?:posso|possiamo|potrei|sono in grado di|sono autorizzat[oa] a|siamo in grado|mi è (?:possibile|permesso|consentito)|è possibile|voglio)|preferisco non",
        r"rispond\w+|aiut\w+|assist\w+|forni\w+|dare\b|comment\w+|descriv\w+|identific\w+|discut\w+|parlare|dire\b|soddisf\w+|condivid\w+|rivel\w+|analizz\w+|offr\w+",
        r"mi rifiuto|(?:devo|dobbiamo) (?:rifiutar\w*|declinare)|(?:richiesta|domanda|risposta|contenuto)(?: \w+)? (?:è stat[oa] |è )?(?:rifiutat|respint|negat|bloccat)\w+",
    ),
    "nl": Declining(
        ("niet", "geen", "weiger", "geweigerd", "afgewezen", "geblokkeerd", "ik geef", "liever", "afwijzen", "passen"),
        r"(?:ik|wij|we) (?:kan|mag|wil|zal|kunnen|mogen|willen|zullen)(?: \w+){0,8}? ?\b(?:niet|geen)|(?:kan|mag|wil) ik(?: \w+){0,6}? ?\b(?:niet|geen)|ik ben niet (?:in staat|bevoegd)|het is mij niet (?:mogelijk|toegestaan)|ik geef (?:er de voorkeur|liever)|liever niet",
        r"(?:be)?antwoord\w*|help\w*|assister\w+|bied\w+|geven|commentaar\w*|reager\w+|beschrijv\w+|identificer\w+|besprek\w+|zeggen|uitlat\w+|verstrek\w+|delen|voldoen|ingaan",
        r"ik weiger|(?:ik|wij|we) (?:moet|moeten)(?: \w+){0,6}? (?:weigeren|afwijzen|passen)|(?:verzoek|vraag|aanvraag|inhoud|antwoord)(?: \w+){0,4}? (?:geweigerd|afgewezen|geblokkeerd)",
    ),
    "pl": Declining(
        ("nie mog", "nie możemy", "nie jestem", "nie wolno", "odmawia", "odmówi", "odrzuc", "zablokow", "wolę nie", "nie będę", "nie jesteśmy", "nie mam", "nie chc", "odmówion"),
        r"nie (?:mogę|możemy|jestem w stanie|jesteśmy w stanie|wolno mi|mam prawa|będę|chcę)|wolę nie|odmawiam",
        r"odpow\w+|pomóc|pomoc\w*|pomag\w+|udziel\w+|komentow\w+|skomentow\w+|opis\w+|zidentyfikow\w+|omawi\w+|omówi\w*|powiedzieć|poda[ćc]\w*|spełni\w*|dostarcz\w+|oceni\w*",
        r"odmawiam|muszę odmówić|(?:prośba|żądanie|pytanie|zapytanie|treść)(?: \w+){0,3}? (?:odrzucon|odmówion|zablokowan)\w+",
    ),
    "cs": Declining(
        ("nemoh", "nemůž", "nejsem", "odmít", "nesmím", "raději ne", "zamítnut", "zablokov", "nebudu"),
        r"nemohu|nemůžu|nemůžeme|nejsem (?:schopen|schopna|oprávněn\w*)|nesmím|raději ne\w*|nebudu|odmítám",
        r"odpov\w+|pomoci|pomoct|pomáhat|poskyt\w+|komentov\w+|popsat|popisovat|identifikov\w+|říci|říct|diskutov\w+|sdělit|vyhovět|vyjádřit",
        r"odmítám|musím odmítnout|(?:žádost|dotaz|otázka|obsah)(?: \w+){0,3}? (?:zamítnut|odmítnut|zablokov)\w+",
    ),
    "tr": Declining(
        ("cevap", "yanıt", "yardım", "yorum", "bilgi", "tarif", "tanımla", "betimle", "açıkla", "paylaş", "söyle", "görüş", "belirt", "teşhis", "istek", "talep", "soru", "içerik", "isteğiniz", "talebiniz", "reddediyor"),
        r"\w*(?:amam|emem|amıyor\w*|emiyor\w*|amayız|emeyiz|amayacağ\w*|emeyeceğ\w*|mak istemiyor\w*|mek istemiyor\w*|mem mümkün değil|mamı? tercih eder\w*|memeyi tercih eder\w*|iznim yok|yetkim yok)",
        r"cevap\w*|yanıt\w*|yardım\w*|yorum\w*|bilgi\w*|tarif\w*|tanımla\w*|betimle\w*|açıkla\w*|paylaş\w*|söyle\w*|görüş\w*|belirt\w*|teşhis\w*",
        r"(?:istek|talep|soru|içerik|isteğiniz|talebiniz)(?: \w+){0,3}? reddedil\w+|\w*(?:cevapla|yanıtla)yama\w*|reddediyorum",
        back=True,
    ),
    "vi": Declining(
        ("không thể", "không được phép", "từ chối", "xin phép không", "không muốn", "bị chặn", "không có quyền", "xin phép"),
        r"(?:tôi|chúng tôi|mình|em)(?: \w+){0,5}? (?:không thể|không được phép|không muốn|xin phép không|không có quyền)|(?:xin lỗi|rất tiếc)[^.!?]{0,20}không thể",
        r"trả lời|giúp|hỗ trợ|cung cấp|bình luận|mô tả|xác định|nhận dạng|thảo luận|đưa ra|nói về|tiết lộ|chia sẻ|đáp ứng",
        r"(?:tôi|chúng tôi)(?: \w+){0,3}? từ chối|(?:yêu cầu|câu hỏi|nội dung)(?: \w+){0,3}? bị (?:từ chối|chặn)",
    ),
    "id": Declining(
        ("tidak bisa", "tidak dapat", "tidak boleh", "tidak mampu", "tidak diizinkan", "menolak", "ditolak", "enggan", "lebih baik tidak", "tidak akan", "tidak ingin", "memilih", "diblokir"),
        r"(?:saya|kami)(?: \w+){0,4}? (?:tidak (?:bisa|dapat|boleh|mampu|diizinkan|akan|ingin)|enggan|menolak(?: untuk)?|lebih baik tidak|memilih (?:untuk )?tidak)|(?:maaf|sayangnya)[^.!?]{0,20}\btidak (?:bisa|dapat)",
        r"\w*jawab\w*|\w*bantu\w*|\w*beri\w*|\w*komentar\w*|\w*deskripsi\w*|\w*gambarkan|\w*identifikasi\w*|\w*bahas\w*|\w*sedia\w*|\w*ungkap\w*|\w*bagi\w*|\w*penuhi|\w*tanggap\w*",
        r"(?:permintaan|pertanyaan|konten)(?: \w+){0,3}? (?:ditolak|diblokir)",
    ),
    "sv": Declining(
        ("inte", "avböj", "vägra", "avstå", "avslag", "avslå", "nekat", "avslo", "nekas", "blockerat", "avvisat"),
        r"(?:jag|vi) (?:kan|får|vill|kommer|är)(?: \w+){0,4}? ?\binte|(?:kan|får|vill) (?:jag|vi)(?: \w+){0,4}? ?\binte|(?:jag|vi) (?:avböjer|vägrar|avstår)|(?:jag|vi) (?:måste|väljer)(?: \w+){0,4}? (?:avböja|avstå|att inte)",
        r"(?:be)?svar\w*|hjälp\w*|kommenter\w*|beskriv\w*|ge\b|ger\b|identifier\w*|diskuter\w*|bistå|uttal\w*|tillhandahåll\w*|lämna|säga|dela|uppfylla",
        r"(?:begäran|förfrågan|frågan|innehållet)(?: \w+){0,3}? (?:avslagits|avslogs|avslås|nekats|nekas|blockerats|avvisats)|(?:jag|vi) måste avböja|(?:jag|vi) avböjer",
    ),
    "da": Declining(
        ("ikke", "ikkje", "afvis", "avvis", "nægte", "nekte", "afslå", "avslå", "blokeret", "blokkert"),
        r"(?:jeg|vi) (?:kan|må|vil|får|er)(?: \w+){0,4}? ?\bikke|(?:kan|må|vil) (?:jeg|vi)(?: \w+){0,4}? ?\bikke|(?:jeg|vi) (?:nægter|nekter|afviser|avviser|afslår|avslår)",
        r"(?:be)?svare?\w*|hjælp\w*|hjelp\w*|kommenter\w*|beskriv\w*|give\b|gi\b|identificer\w*|identifiser\w*|diskuter\w*|drøft\w*|bistå|udtal\w*|uttal\w*|sige|si\b|dele|imødekomme",
        r"(?:anmodning|forespørgsel|forespørsel|spørgsmål|spørsmål|indhold|innhold)\w*(?: \w+){0,3}? (?:afvist|avvist|nægtet|nektet|blokeret|blokkert)|(?:jeg|vi) (?:må|bliver nødt til at)(?: \w+){0,3}? (?:afvise|avvise|afslå|avslå)",
    ),
    "ro": Declining(
        ("nu p", "nu sunt", "nu am voie", "nu îmi", "refuz", "respins", "blocat", "prefer să nu", "declin", "nu voi", "nu doresc", "nu suntem"),
        r"nu (?:pot|putem|sunt în măsură|suntem în măsură|am voie|îmi este permis|voi|doresc)|prefer să nu|refuz să",
        r"răspund\w*|ajut\w*|asist\w*|ofer\w*|comentez\w*|coment\w+|descri\w+|identific\w*|discut\w*|spun\w*|da\b|furniz\w*|dezvălui\w*",
        r"refuz să|(?:cererea|solicitarea|întrebarea|conținutul)(?: \w+){0,3}? (?:respins|refuzat|blocat)\w*|trebuie să refuz",
    ),
    "hu": Declining(
        ("nem tud", "nem áll", "nem válaszol", "elutasít", "visszautasít", "nem szeret", "megtagad", "nem kív", "nem vagyok", "letilt"),
        r"nem (?:tudok|tudunk|áll módomban|áll módunkban|szeretnék|kívánok|vagyok jogosult)",
        r"válasz\w*|segít\w*|kommentál\w*|leír\w*|azonosít\w*|megad\w*|nyújt\w*|beszél\w*|mondan\w*|nyilatkoz\w*|teljesít\w*",
        r"nem válaszol\w+|elutasítom|visszautasítom|(?:kérés|kérdés|tartalom)\w*(?: \w+){0,3}? (?:elutasít|visszautasít|letilt)\w+",
    ),
    "fi": Declining(
        ("en voi", "emme voi", "en pysty", "en saa", "en halua", "kieltäydy", "hylätty", "estetty", "en valit", "emme", "evätty"),
        r"en (?:voi|pysty|saa|halua|valitettavasti voi)|emme (?:voi|pysty|saa)|kieltäydyn",
        r"vasta\w+|autta\w*|kommentoi\w*|kuvail\w+|tarjota|tunnista\w*|antaa|keskustella|kertoa|sanoa|jakaa",
        r"kieltäydyn|(?:pyyntö|kysymys|sisältö)\w*(?: \w+){0,3}? (?:hylätty|estetty|evätty)",
    ),
    "ru": Declining(
        ("не мог", "не може", "не в состоянии", "отказ", "не вправе", "не имею права", "предпочитаю не", "не буду", "отклон", "заблокир", "не смог", "не смож", "не хо", "не имею", "вынужден", "не будем"),
        r"(?:я|мы)?\s?не (?:могу|можем|смогу|сможем|в состоянии|вправе|имею права|буду|будем|хочу)|предпочитаю не|отказываюсь",
        r"ответ\w*|отвеч\w*|помо[чг]\w*|комментир\w*|прокомментир\w*|предостав\w*|дать|давать|описа\w*|описыва\w*|опозна\w*|идентифициров\w*|обсужд\w*|обсуд\w*|сказать|выполн\w*|раскры\w*|судить",
        r"отказываюсь|вынужден\w* отказ\w+|(?:запрос|вопрос|просьба|ответ|контент)\w*(?: \w+){0,3}? (?:отклон|отказан|заблокир)\w+",
    ),
    "uk": Declining(
        ("не мож", "відмовля", "відхилен", "заблокован", "не в змозі", "не маю", "не буду"),
        r"не (?:можу|можемо|в змозі|маю права|буду)|відмовляюс\w",
        r"відпов\w*|допом\w*|коментув\w*|прокоментув\w*|надат\w*|надав\w*|опис\w*|ідентифікув\w*|обговор\w*|сказати",
        r"відмовляюс\w|(?:запит|питання|вміст)\w*(?: \w+){0,3}? (?:відхилен|заблокован)\w+",
    ),
    "el": Declining(
        ("δεν μπορ", "αρνούμαι", "απορρίφθηκε", "δεν επιτρέπεται", "προτιμώ να μην", "δεν είμαι", "δεν μου"),
        r"δεν (?:μπορώ|μπορούμε|είμαι σε θέση|μου επιτρέπεται|επιτρέπεται)|προτιμώ να μην|αρνούμαι",
        r"απαντ\w+|βοηθ\w+|σχολι\w+|περιγρ\w+|παρέχ\w*|παράσχ\w*|δώσ\w+|συζητ\w+|αναγνωρ\w+|ταυτοποι\w+|πω\b",
        r"αρνούμαι|το αίτημα(?: \w+){0,3}? απορρίφθηκε",
    ),
    "ar": Declining(
        ("لا أستطيع", "لا يمكن", "لا نستطيع", "غير قادر", "لست قادر", "أرفض", "أعتذر", "غير مسموح", "لا أرغب", "رفض", "يتعذر", "تعذر", "لا استطيع", "لا يسمح", "أفضل عدم", "رُفض"),
        r"لا (?:أستطيع|استطيع|يمكنني|يمكننا|يمكن|نستطيع|أرغب|يسمح لي)|(?:لست|غير) قادر\w*|أعتذر عن|غير مسموح لي|يتعذر علي|أفضل عدم|أرفض",
        r"\w*إجابة|\w*اجابة|\w*أجيب|\w*رد\b|\w*مساعدت?\w*|\w*أساعد\w*|\w*تقديم|\w*أقدم|\w*تعليق|\w*أعلق|\w*وصف|\w*تحديد|\w*مناقشة|\w*توفير|\w*التعرف",
        r"(?:تم رفض|رُفض|رفض) (?:هذا |هذه )?(?:ال)?طلب|أعتذر عن عدم",
        edge="",
    ),
    "he": Declining(
        ("לא יכול", "לא אוכל", "איני יכול", "מסרב", "נדחת", "לא ניתן", "איני", "אינני", "אני לא", "לא רשאי", "מעדיפ"),
        r"(?:איני|אינני|אני לא|לא) (?:יכול|יכולה|אוכל|רשאי|רשאית)|לא ניתן|מסרב\w*|מעדיפ\w* לא|לא אוכל",
        r"לענות|להשיב|לעזור|לסייע|לספק|להגיב|לתאר|לזהות|לדון|לתת|למסור",
        r"הבקשה נדחתה|אני מסרב\w*",
        edge="",
    ),
    "hi": Declining(
        ("नहीं", "असमर्थ", "इनकार", "अस्वीकार"),
        r"नहीं (?:दे|कर|बता|करूँगा|करूंगा|दूँगा|दूंगा)|असमर्थ|इनकार कर\w*|इनकार|अनुमति नहीं",
        r"उत्तर|जवाब|मदद|सहायता|टिप्पणी|जानकारी|वर्णन|पहचान|चर्चा",
        r"अनुरोध (?:को )?अस्वीकार",
        back=True,
        edge="",
    ),
    "th": Declining(
        ("ไม่สามารถ", "ไม่ขอ", "ปฏิเสธ", "ไม่ได้รับอนุญาต", "ขอไม่"),
        r"ไม่สามารถ|ไม่ขอ|ขอปฏิเสธ|ไม่ได้รับอนุญาตให้|ขอไม่",
        r"ตอบ|ช่วย|ให้ข้อมูล|ให้คำตอบ|แสดงความ|อธิบาย|บรรยาย|ระบุ|พูดถึง|ให้ความเห็น",
        r"คำขอ(?:นี้)?ถูกปฏิเสธ|ขอปฏิเสธ",
        edge="",
    ),
    "ja": Declining(
        ("できません", "できかね", "かねます", "控え", "断り", "断る", "できない", "答えられません", "拒否", "差し控え", "応じられません", "ませんので", "出来ない", "出来ません", "出来かね", "わけには", "許可されて", "ブロック", "却下", "られません"),
        r"(?:でき|出来)(?:ません|ない|かね)|(?:いたし|致し|し)?かねます|(?:差し)?控え|お?断り|応じられません|られません|拒否|許可されていません|わけにはいきません",
        r"お?答え|回答|返答|お?応え|お?手伝い|手助け|支援|コメント|説明|提供|特定|識別|描写|評価|お話し|ご案内|対応|処理|要望|リクエスト|依頼|判断|言及|分析",
        r"(?:ご)?(?:質問|リクエスト|依頼|要求)は(?:拒否|却下|ブロック)されました",
        back=True,
        edge="",
    ),
    "zh": Declining(
        ("无法", "無法", "不能", "不便", "拒绝", "拒絕", "不予", "不允许", "不允許", "恕", "不可以", "不愿", "不願", "不会", "不想", "屏蔽", "封锁", "从命", "不愿"),
        r"(?:我|我们|我們|本人|本系统|本系統|本助手)?(?:很遗憾|实在|暂时|暫時)?(?:无法|無法|不能|不便|不可以|不予|恕不|恕难|不愿|不願|不允许|不允許|不想|拒绝|拒絕)",
        r"回答|答复|答覆|回应|回應|提供|帮助|幫助|帮忙|协助|協助|评论|評論|描述|透露|识别|識別|辨认|讨论|討論|查看|满足|滿足|完成|处理|處理|评价|評價|分析|作答|从命",
        r"(?:请求|請求|问题|問題|内容|內容)(?:已|被|已被|遭到?)(?:拒绝|拒絕|屏蔽|封锁)|恕难从命|恕不",
        edge="",
    ),
    "ko": Declining(
        ("수 없", "어렵습니다", "않겠습니다", "거부", "거절", "삼가", "불가", "못합니다", "못해", "수는 없", "수가 없", "어려울", "차단"),
        r"수(?:는|가)? 없|어렵습니다|어려울|않겠습니다|불가(?:능)?|거부|거절|삼가|못합니다|못해",
        r"답변|대답|답을|답해|도움|도와|제공|설명|식별|논의|언급|말씀|응답|처리|평가|묘사|댓글|의견|요청|분석",
        r"요청(?:이|은)? ?(?:거부|거절|차단)",
        back=True,
        edge="",
    ),
}
_PATTERNS = [(d.stems, d.patterns()) for d in DECLINING.values()]

SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।])|\n+")
SPACES = re.compile(r"\s+")
#: An answer that is given besides: a letter named as the answer, or one that starts a sentence as its label.
LETTERED = re.compile(
    r"(?:\b(?:is|be|was|choose|chose|pick|select|option|answer|ist|wähle|est|choisis|es|elijo|é|escolho|è|scelgo|kies)|[は选選是為为:：])\s*[\"'(*]{0,3}[A-H]\b(?![' ]?[a-z])"
    r"|^\W*[A-H]\s*[.):](?:\s|$)"
)
WORDED = re.compile(r"\b(?:the|my) (?:\w+ )?answer (?:is|would be|remains)\b|\bso it is\b|\bit is \d", re.I)
YES_OR_NO = re.compile(r"^\W*(?:yes|no|oui|non|sí|ja|nein|sim|não)\b\s*[,.;]", re.I)


WORDS = re.compile(r"[a-z']+")


class Stems:
    """Which languages' stems a text has. Only scripts without blanks have stems within what looks like one word."""

    def __init__(self):
        self.by: dict[str, set[int]] = {}
        for i, (stems, _) in enumerate(_PATTERNS):
            for s in stems:
                self.by.setdefault(s.strip(), set()).add(i)
        self.seen: dict[str, tuple] = {}

    def begun(self, word: str) -> tuple[frozenset[int], tuple[str, ...]]:
        """The languages with a stem that begins a word, and the stems of several words of which it is the first."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            one = frozenset().union(*(v for s, v in self.by.items() if " " not in s and word.startswith(s)))
            found = self.seen[word] = (one, tuple(s for s in self.by if s.startswith(word + " ")))
        return found

    def languages(self, low: str) -> set[int]:
        out: set[int] = set()
        if not low.isascii():
            return out.union(*(v for s, v in self.by.items() if s in low))
        for word in WORDS.findall(low):
            one, several = self.begun(word)
            if one:
                out |= one
            for s in several:
                if s in low:
                    out |= self.by[s]
        return out


@functools.lru_cache(1)
def stems() -> Stems:
    return Stems()


def refuses(said: str) -> bool:
    """Whether a wording declines to answer, and nothing besides answers."""
    low = " ".join(said.lower().replace("’", "'").split())
    near = [p for i in sorted(stems().languages(low)) for p in _PATTERNS[i][1]]
    if not any(p.search(low) for p in near):
        return False
    found, answered = False, False
    for sentence in SENTENCES.split(said.replace("’", "'")):
        s = SPACES.sub(" ", sentence).strip()
        t = s.lower()
        if any(p.search(t) for p in near):
            found = True
        elif YES_OR_NO.search(s):
            answered = True
        answered |= bool(LETTERED.search(s) or WORDED.search(s))
    return found and not answered
