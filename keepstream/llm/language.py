"""The language a short text is worded in: by script, then by character n-grams.

Each language of the Latin script has a model of the characters of its words, each
given the three before it, built from the sample of everyday prose below. A text's
words are summed up under every model; what decides is by how much one language
explains them better than another, so a few letters decide nothing and a sentence
decides clearly.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np

#: Everyday prose, from which the models are built; colours, numbers, things of the house and words of answers included.
SAMPLES = {
    "en": "the answer is that the man who was standing next to the window put a red cup on the table and then walked away with his dog. she opens the left door because it was closed before, but nobody else has seen them there. what do you think they are doing with this bright blue bag? i would say there were two or three people in the kitchen and one of them took the knife from the lower shelf. yes, no, not yet, never, nothing, something, first, last, after, while, which, where, when, how, why, our, your, their, from, into, about, green, yellow, black, white, brown, small, large, four, five, six, seven, water, coffee, bread, chair, house, street, child, woman, hand, right, looking at the clip it shows how he picks up the towel and washes the pan, which object does, who does it, how many times did, why do they stop, has been done, before, again, during, by, of, off, over, under, behind, near, against, between, through, only, also, very, more, most, other, such, than, if, but, or, so, be, am, being, had, having, could, should, will, may, might, must, can, all, any, both, each, few, some, these, those, its, it, me, my, us, we, whose, whom, one, each of them, touch, hold, move, turn, stop, start, look, find, point, read, write, old, young, worker, person, people, thing, time, part, place, side, end, bottom, top, box, glass, paper, metal, wooden",
    "fr": "la réponse est que l'homme qui se tenait près de la fenêtre a posé une tasse rouge sur la table, puis il est parti avec son chien. elle ouvre la porte de gauche parce qu'elle était fermée avant, mais personne d'autre ne les a vus là. que pensez-vous qu'ils font avec ce sac bleu vif ? je dirais qu'il y avait deux ou trois personnes dans la cuisine et l'une d'elles a pris le couteau sur l'étagère du bas. oui, non, pas encore, jamais, rien, quelque chose, premier, dernier, après, pendant, quel, quelle, où, quand, comment, pourquoi, notre, votre, leur, depuis, vers, vert, jaune, noir, blanc, petit, grand, quatre, cinq, six, sept, fois, eau, café, pain, chaise, maison, rue, enfant, femme, main, droite, c'est, aux, des, les, cette, ces, au, du, et, dans l'image on voit comment il ramasse la serviette et lave la casserole, quel objet, combien de fois, qui est-ce, a fini, déjà, encore, très, plus, moins, aussi, si, mais, ou, car, donc, ni, il, elle, ils, elles, nous, vous, je, tu, on, mon, ma, mes, son, sa, ses, nos, vos, ce, cet, lui, eux, y, en, par, sur, sous, sans, entre, contre, devant, derrière, chez, être, avoir, fait, touche, tient, prend, ouvre, ferme, tourne, vieux, jeune, chose, partie, côté, verre, papier, bois, fille, garçon",
    "es": "la respuesta es que el hombre que estaba junto a la ventana puso una taza roja sobre la mesa y luego se fue con su perro. ella abre la puerta de la izquierda porque antes estaba cerrada, pero nadie más los ha visto allí. ¿qué cree usted que hacen con este bolso azul brillante? yo diría que había dos o tres personas en la cocina y una de ellas tomó el cuchillo del estante de abajo. sí, no, todavía no, nunca, nada, algo, primero, último, después, mientras, cuál, dónde, cuándo, cómo, por qué, nuestro, vuestro, desde, hacia, verde, amarillo, negro, blanco, pequeño, grande, cuatro, cinco, seis, siete, veces, agua, café, pan, silla, casa, calle, niño, niña, mujer, mano, derecha, los, las, del, al, unos, en la imagen se ve cómo recoge la toalla y lava la olla, qué objeto, cuántas veces, quién es, ha terminado, ya, otra vez, muy, más, menos, también, si, pero, o, pues, ni, él, ellos, ellas, nosotros, vosotros, yo, tú, mi, mis, su, sus, ese, esa, eso, le, les, lo, por, sobre, bajo, sin, entre, contra, delante, detrás, cerca, ser, tener, hecho, toca, sostiene, coge, abre, cierra, gira, viejo, joven, cosa, parte, lado, vidrio, papel, madera",
    "de": "die antwort ist, dass der mann, der neben dem fenster stand, eine rote tasse auf den tisch gestellt hat und dann mit seinem hund weggegangen ist. sie öffnet die linke tür, weil sie vorher geschlossen war, aber niemand sonst hat sie dort gesehen. was glauben sie, machen die leute mit dieser hellblauen tasche? ich würde sagen, es waren zwei oder drei personen in der küche und eine von ihnen nahm das messer aus dem unteren regal. ja, nein, noch nicht, nie, nichts, etwas, erste, letzte, danach, während, welche, welcher, wo, wann, wie, warum, unser, euer, ihr, von, zu, grün, gelb, schwarz, weiß, klein, groß, vier, fünf, sechs, sieben, mal, wasser, kaffee, brot, stuhl, haus, straße, kind, frau, hand, rechts, das, des, im, am, auf dem bild sieht man, wie er das handtuch aufhebt und den topf wäscht, welchen gegenstand, wie oft, wer ist das, hat fertig, schon, wieder, sehr, mehr, weniger, auch, wenn, aber, oder, denn, weder, er, wir, du, mein, dein, sein, seine, dieser, dieses, ihm, ihn, ihnen, durch, über, unter, ohne, zwischen, gegen, vor, hinter, nahe, bei, haben, werden, wird, macht, berührt, hält, nimmt, schließt, dreht, alt, jung, ding, teil, seite, glas, papier, holz, mädchen, junge, in der, des, dem, den",
    "pt": "a resposta é que o homem que estava junto à janela pôs uma xícara vermelha em cima da mesa e depois foi embora com o seu cão. ela abre a porta da esquerda porque antes estava fechada, mas ninguém mais os viu ali. o que você acha que eles fazem com esta bolsa azul clara? eu diria que havia duas ou três pessoas na cozinha e uma delas pegou a faca da prateleira de baixo. sim, não, ainda não, nunca, nada, alguma coisa, primeiro, último, depois, enquanto, qual, onde, quando, como, por quê, nosso, vosso, desde, para, verde, amarelo, preto, branco, pequeno, grande, quatro, cinco, seis, sete, vezes, água, café, pão, cadeira, casa, rua, criança, mulher, mão, direita, os, as, dos, das, do, aos, uns, na imagem vê-se como ele apanha a toalha e lava a panela, que objeto, quantas vezes, quem é, já terminou, já acabou, outra vez, muito, mais, menos, também, se, mas, ou, pois, nem, ele, eles, elas, nós, eu, tu, meu, minha, seus, suas, esse, essa, isso, lhe, lhes, por, sobre, sob, sem, entre, contra, diante, atrás, perto, ser, ter, tarefa, feito, toca, segura, pega, fecha, gira, velho, jovem, coisa, parte, lado, vidro, papel, madeira, menino, menina",
    "it": "la risposta è che l'uomo che stava accanto alla finestra ha messo una tazza rossa sul tavolo e poi se n'è andato con il suo cane. lei apre la porta di sinistra perché prima era chiusa, ma nessun altro li ha visti lì. che cosa pensa che facciano con questa borsa azzurra? io direi che c'erano due o tre persone in cucina e una di loro ha preso il coltello dallo scaffale in basso. sì, no, non ancora, mai, niente, qualcosa, primo, ultimo, dopo, mentre, quale, dove, quando, come, perché, nostro, vostro, loro, verso, verde, giallo, nero, bianco, piccolo, grande, quattro, cinque, sei, sette, volte, acqua, caffè, pane, sedia, casa, strada, bambino, donna, mano, destra, gli, della, degli, delle, nella, dal, nell'immagine si vede come raccoglie l'asciugamano e lava la pentola, quale oggetto, quante volte, chi è, ha finito, già, di nuovo, molto, più, meno, anche, se, ma, o, né, egli, essi, noi, voi, io, tu, mio, mia, suo, sua, suoi, quello, quella, ciò, gli, le, per, sopra, sotto, senza, tra, contro, davanti, dietro, vicino, essere, avere, fatto, tocca, tiene, prende, chiude, gira, vecchio, giovane, cosa, parte, lato, vetro, carta, legno, ragazza, ragazzo",
    "nl": "het antwoord is dat de man die naast het raam stond een rood kopje op de tafel heeft gezet en daarna met zijn hond is weggelopen. zij opent de linkerdeur omdat die eerst gesloten was, maar niemand anders heeft hen daar gezien. wat denkt u dat ze doen met deze lichtblauwe tas? ik zou zeggen dat er twee of drie mensen in de keuken waren en een van hen pakte het mes van de onderste plank. ja, nee, nog niet, nooit, niets, iets, eerste, laatste, terwijl, welke, waar, wanneer, hoe, waarom, onze, jullie, hun, van, naar, groen, geel, zwart, wit, klein, groot, vier, vijf, zes, zeven, keer, water, koffie, brood, stoel, huis, straat, kind, vrouw, hand, rechts, dit, deze, wordt, geen, op het beeld ziet men hoe hij de handdoek opraapt en de pan wast",
    "pl": "odpowiedź jest taka, że mężczyzna, który stał obok okna, postawił czerwony kubek na stole, a potem odszedł ze swoim psem. ona otwiera lewe drzwi, ponieważ przedtem były zamknięte, ale nikt inny ich tam nie widział. co pani zdaniem robią z tą jasnoniebieską torbą? powiedziałbym, że w kuchni były dwie albo trzy osoby i jedna z nich wzięła nóż z dolnej półki. tak, nie, jeszcze nie, nigdy, nic, coś, pierwszy, ostatni, po, podczas, który, która, gdzie, kiedy, jak, dlaczego, nasz, wasz, ich, od, do, zielony, żółty, czarny, biały, mały, duży, cztery, pięć, sześć, siedem, razy, woda, kawa, chleb, krzesło, dom, ulica, dziecko, kobieta, ręka, prawo, jest, się, są, przez, dla, na obrazie widać, jak podnosi ręcznik i myje garnek",
    "cs": "odpověď je taková, že muž, který stál vedle okna, položil červený hrnek na stůl a potom odešel se svým psem. ona otevírá levé dveře, protože předtím byly zavřené, ale nikdo jiný je tam neviděl. co si myslíte, že dělají s touto světle modrou taškou? řekl bych, že v kuchyni byli dva nebo tři lidé a jeden z nich vzal nůž ze spodní police. ano, ne, ještě ne, nikdy, nic, něco, první, poslední, po, zatímco, který, která, kde, kdy, jak, proč, náš, váš, jejich, od, do, zelený, žlutý, černý, bílý, malý, velký, čtyři, pět, šest, sedm, krát, voda, káva, chléb, židle, dům, ulice, dítě, žena, ruka, vpravo, je, se, jsou, pro, při, na obraze je vidět, jak zvedá ručník a myje hrnec",
    "tr": "cevap şu ki pencerenin yanında duran adam masanın üzerine kırmızı bir bardak koydu ve sonra köpeğiyle birlikte gitti. kadın sol kapıyı açıyor çünkü kapı daha önce kapalıydı, ama onları orada başka kimse görmedi. sizce bu açık mavi çantayla ne yapıyorlar? mutfakta iki ya da üç kişi olduğunu ve birinin alt raftan bıçağı aldığını söylerdim. evet, hayır, henüz değil, asla, hiçbir şey, bir şey, ilk, son, sonra, iken, hangi, nerede, ne zaman, nasıl, neden, bizim, sizin, onların, yeşil, sarı, siyah, beyaz, küçük, büyük, dört, beş, altı, yedi, kere, su, kahve, ekmek, sandalye, ev, sokak, çocuk, kadın, el, sağ, bu, için, ile, gibi, görüntüde havluyu nasıl aldığı ve tencereyi yıkadığı görülüyor",
    "vi": "câu trả lời là người đàn ông đứng cạnh cửa sổ đã đặt một chiếc cốc đỏ lên bàn rồi đi ra ngoài cùng con chó của mình. cô ấy mở cánh cửa bên trái vì trước đó nó đóng, nhưng không ai khác nhìn thấy họ ở đó. bạn nghĩ họ đang làm gì với chiếc túi màu xanh nhạt này? tôi nghĩ có hai hoặc ba người trong bếp và một người đã lấy con dao từ kệ dưới. có, không, chưa, không bao giờ, không có gì, cái gì đó, đầu tiên, cuối cùng, sau khi, trong khi, nào, ở đâu, khi nào, thế nào, tại sao, của chúng tôi, của họ, từ, đến, màu vàng, đen, trắng, nhỏ, lớn, bốn, năm, sáu, bảy, lần, nước, cà phê, bánh mì, ghế, nhà, đường, trẻ em, phụ nữ, tay, phải, những, các, được, với, trong hình thấy anh ta nhặt khăn và rửa nồi",
    "id": "jawabannya adalah bahwa pria yang berdiri di sebelah jendela menaruh cangkir merah di atas meja lalu pergi bersama anjingnya. dia membuka pintu kiri karena sebelumnya tertutup, tetapi tidak ada orang lain yang melihat mereka di sana. menurut anda apa yang mereka lakukan dengan tas biru muda ini? saya kira ada dua atau tiga orang di dapur dan salah satu dari mereka mengambil pisau dari rak bawah. ya, tidak, belum, tidak pernah, tidak ada apa-apa, sesuatu, pertama, terakhir, setelah, sambil, yang mana, di mana, kapan, bagaimana, mengapa, kami, kalian, mereka, dari, ke, hijau, kuning, hitam, putih, kecil, besar, empat, lima, enam, tujuh, kali, air, kopi, roti, kursi, rumah, jalan, anak, perempuan, tangan, kanan, ini, itu, dengan, untuk, pada gambar terlihat bagaimana dia mengambil handuk dan mencuci panci",
    "sv": "svaret är att mannen som stod bredvid fönstret ställde en röd kopp på bordet och sedan gick iväg med sin hund. hon öppnar den vänstra dörren eftersom den var stängd innan, men ingen annan har sett dem där. vad tror ni att de gör med den här ljusblå väskan? jag skulle säga att det var två eller tre personer i köket och en av dem tog kniven från den nedre hyllan. ja, nej, inte än, aldrig, ingenting, något, första, sista, efter, medan, vilken, var, när, hur, varför, vår, er, deras, från, till, grön, gul, svart, vit, liten, stor, fyra, fem, sex, sju, gånger, vatten, kaffe, bröd, stol, hus, gata, barn, kvinna, hand, höger, det, ett, är, och, på bilden ser man hur han plockar upp handduken och diskar kastrullen",
    "da": "svaret er at manden, som stod ved siden af vinduet, satte en rød kop på bordet og derefter gik væk med sin hund. hun åbner den venstre dør, fordi den var lukket før, men ingen andre har set dem der. hvad tror du, de gør med denne lyseblå taske? jeg vil sige, at der var to eller tre mennesker i køkkenet, og en af dem tog kniven fra den nederste hylde. ja, nej, ikke endnu, aldrig, ingenting, noget, første, sidste, efter, mens, hvilken, hvor, hvornår, hvordan, hvorfor, vores, jeres, deres, fra, til, grøn, gul, sort, hvid, lille, stor, fire, fem, seks, syv, gange, vand, kaffe, brød, stol, hus, gade, barn, kvinde, hånd, højre, det, et, er, og, på billedet ser man, hvordan han samler håndklædet op og vasker gryden",
    "ro": "răspunsul este că bărbatul care stătea lângă fereastră a pus o ceașcă roșie pe masă și apoi a plecat cu câinele său. ea deschide ușa din stânga pentru că înainte era închisă, dar nimeni altcineva nu i-a văzut acolo. ce credeți că fac cu această geantă albastru deschis? aș spune că erau două sau trei persoane în bucătărie și una dintre ele a luat cuțitul de pe raftul de jos. da, nu, încă nu, niciodată, nimic, ceva, primul, ultimul, după, în timp ce, care, unde, când, cum, de ce, nostru, vostru, lor, de la, către, verde, galben, negru, alb, mic, mare, patru, cinci, șase, șapte, ori, apă, cafea, pâine, scaun, casă, stradă, copil, femeie, mână, dreapta, este, sunt, în imagine se vede cum ridică prosopul și spală oala",
    "hu": "a válasz az, hogy a férfi, aki az ablak mellett állt, egy piros csészét tett az asztalra, és aztán elment a kutyájával. a nő kinyitja a bal oldali ajtót, mert előtte zárva volt, de senki más nem látta őket ott. mit gondol, mit csinálnak ezzel a világoskék táskával? azt mondanám, hogy két vagy három ember volt a konyhában, és egyikük elvette a kést az alsó polcról. igen, nem, még nem, soha, semmi, valami, első, utolsó, után, közben, melyik, hol, mikor, hogyan, miért, miénk, tiétek, övék, zöld, sárga, fekete, fehér, kicsi, nagy, négy, öt, hat, hét, alkalommal, víz, kávé, kenyér, szék, ház, utca, gyerek, nő, kéz, jobb, ez, van, volt, és, a képen látszik, ahogy felveszi a törölközőt és elmossa az edényt",
    "fi": "vastaus on, että mies, joka seisoi ikkunan vieressä, laittoi punaisen kupin pöydälle ja lähti sitten pois koiransa kanssa. hän avaa vasemman oven, koska se oli ennen kiinni, mutta kukaan muu ei ole nähnyt heitä siellä. mitä luulette heidän tekevän tällä vaaleansinisellä laukulla? sanoisin, että keittiössä oli kaksi tai kolme ihmistä ja yksi heistä otti veitsen alahyllyltä. kyllä, ei, ei vielä, ei koskaan, ei mitään, jotain, ensimmäinen, viimeinen, jälkeen, kun, mikä, missä, milloin, miten, miksi, meidän, teidän, heidän, vihreä, keltainen, musta, valkoinen, pieni, suuri, neljä, viisi, kuusi, seitsemän, kertaa, vesi, kahvi, leipä, tuoli, talo, katu, lapsi, nainen, käsi, oikea, tämä, on, oli, ja, kuvassa näkyy, miten hän nostaa pyyhkeen ja pesee kattilan",
}
LANGUAGES = tuple(SAMPLES)
#: Characters a model looks back, the weight of the shorter context, and that of all languages' letters under one's own.
ORDER, BACK_OFF, POOLED = 3, 4.0, 60.0
#: Natural logarithms: the most that a word counts for one language over another, by its letters alone or as a word of a sample,
#: and by how much another language must explain an answer better than the question's, and a text better than all languages together.
BY_LETTERS, BY_WORD, MARGIN, OVER_ALL = 2.5, 6.0, 5.5, 1.2
#: What tells the language of a text that is not clearly worded: its lead over the second.
LEAD = 3.0

TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
QUOTED = re.compile(r"\"[^\"\n]{1,40}\"|“[^”\n]{1,40}”|「[^」\n]{1,40}」|«[^»\n]{1,40}»|\\\"[^\"\\]{1,40}\\\"")
SCRIPTS = (("HIRAGANA", "ja"), ("KATAKANA", "ja"), ("HANGUL", "ko"), ("CJK", "zh"), ("CYRILLIC", "ru"), ("ARABIC", "ar"), ("HEBREW", "he"),
           ("GREEK", "el"), ("DEVANAGARI", "hi"), ("THAI", "th"))
OTHER_SCRIPTS = frozenset(lang for _, lang in SCRIPTS)
#: Latin letters with marks reach up to here (Vietnamese has its own block).
LATIN_BLOCKS = (("\u0000", "ɏ"), ("Ḁ", "ỿ"))


def unquoted(text: str) -> str:
    return QUOTED.sub(" ", text) if any(c in text for c in '"“「«') else text


def _model(text: str) -> list[Counter[str]]:
    """Counts of the character runs of a text's words, by length, with the edges of words."""
    counts: list[Counter[str]] = [Counter() for _ in range(ORDER + 2)]
    for w in TOKEN.findall(text):
        s = "^" * ORDER + w + "$"
        for i in range(ORDER, len(s)):
            for n in range(ORDER + 1):
                counts[n + 1][s[i - n : i + 1]] += 1
                counts[n][s[i - n : i] + "\0"] += 1  # how often the context occurs
    return counts


@functools.lru_cache(1)
def models() -> dict[str, list[Counter[str]]]:
    return {lang: _model(text) for lang, text in SAMPLES.items()}


@functools.lru_cache(1)
def letters() -> Counter[str]:
    """How often each character occurs in all samples."""
    return sum((Counter({k: v for k, v in m[1].items()}) for m in models().values()), Counter())


def _word(model: list[Counter[str]], word: str) -> float:
    s, out, pool = "^" * ORDER + word + "$", 0.0, letters()
    total = pool.total()
    for i in range(ORDER, len(s)):
        p = (pool[s[i]] + 1.0) / (total + 200.0)
        for n in range(ORDER + 1):
            weight = BACK_OFF if n else POOLED
            p = (model[n + 1][s[i - n : i + 1]] + weight * p) / (model[n][s[i - n : i] + "\0"] + weight)
        out += math.log(p)
    return out


_WORDS: dict[str, tuple[float, ...]] = {}


def word_scores(word: str) -> tuple[float, ...]:
    """A word's log likelihood in each language, and, last, in all of them together."""
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > 200_000:
            _WORDS.clear()
        by = [_word(m, word) for m in models().values()]
        top = max(by)
        found = (*by, top + math.log(sum(math.exp(x - top) for x in by) / len(by)))
        if len(word) < 40:
            _WORDS[word] = found
    return found


@functools.lru_cache(1)
def vocabularies() -> list[frozenset[str]]:
    return [frozenset(latin_words(text)) for text in SAMPLES.values()]


@functools.lru_cache(50_000)
def worded_in(word: str) -> frozenset[int]:
    """The languages whose sample has a word, or two of four letters or more that make it up."""
    return frozenset(
        i for i, v in enumerate(vocabularies()) if word in v or len(word) < 40 and any(word[:k] in v and word[k:] in v for k in range(4, len(word) - 3))
    )


def scores(words: list[str]) -> list[float]:
    """By how much each language explains words better than a mixture of all does, bounded below for a word."""
    out = [0.0] * len(LANGUAGES)
    for w in words:
        *by, every = word_scores(w)
        out = [a + max(-BY_LETTERS, b - every) for a, b in zip(out, by)]
    return out


class Contrast:
    """By how much each language explains a word better than one language does; rows of a growing matrix."""

    def __init__(self, asked: int):
        self.asked, self.rows, self.table = asked, {}, np.zeros((1024, len(LANGUAGES)))

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            if len(self.rows) > 200_000:
                self.rows.clear()
            at = self.rows[word] = len(self.rows)
            if at >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            by, named = word_scores(word), worded_in(word)
            own, bound = by[self.asked], 0.0 if self.asked in named else BY_LETTERS
            least, most = (-BY_WORD, 0.0) if self.asked in named else (-BY_LETTERS, BY_LETTERS)
            gains = [max(least, min(most, b - own)) for b in by[:-1]]
            for i in named:
                gains[i] = BY_WORD if bound else 0.0
            self.table[at] = gains
        return at

    def most(self, words: list[str], known: frozenset[str]) -> float:
        """What the best language gains. A word of the sample asked in speaks for no other; one merely known from the question says nothing."""
        own = vocabularies()[self.asked]
        strange = [self.row(w) for w in words if w not in own and w not in known]
        if not strange:
            return 0.0
        gains = self.table[strange].sum(0)
        if gains.max() <= MARGIN:
            return float(gains.max())  # words of its own only take away from that
        return float((gains + self.table[[self.row(w) for w in words if w in own]].sum(0)).max())


@functools.lru_cache(len(LANGUAGES))
def contrast(asked: int) -> Contrast:
    return Contrast(asked)


@functools.lru_cache(200_000)
def latin_parts(token: str) -> tuple[str, ...]:
    """The Latin-script words of a token, in lower case: those of an elision apart, a single capital none."""
    if len(token) == 1 and token.isupper() and token.isascii():
        return ()
    parts = token.replace("’", "'").split("'")
    return tuple(x.lower() for x in parts if x and all(any(a <= c <= b for a, b in LATIN_BLOCKS) for c in x))


def latin_words(text: str) -> list[str]:
    """The Latin-script words of a text, in lower case; single capitals are letters of options."""
    return [x for w in TOKEN.findall(text) for x in latin_parts(w)]


def script_language(text: str) -> tuple[str, float] | None:
    """The language of a text most of whose letters are not Latin, and that part."""
    if text.isascii():
        return None
    counts: dict[str, int] = {}
    letters = 0
    for c in text:
        if c.isalpha():
            letters += 1
            if c > "ɏ":
                name = unicodedata.name(c, "")
                for prefix, lang in SCRIPTS:
                    if name.startswith(prefix):
                        counts[lang] = counts.get(lang, 0) + 1
                        break
    if not counts:
        return None
    if "ja" in counts:
        counts["ja"] += counts.pop("zh", 0)
    lang = max(counts, key=counts.__getitem__)
    return (lang, counts[lang] / letters) if counts[lang] / letters >= 0.4 else None


@functools.lru_cache(8192)
def language(text: str | None) -> str | None:
    """The language, or None where nothing tells it; quoted wording is left out."""
    t = unquoted(text or "")
    by_script = script_language(t)
    if by_script:
        return by_script[0]
    if "¿" in t or "¡" in t:  # signs of one language
        return "es"
    by = scores(latin_words(t))
    second, first = sorted(by)[-2:]
    return LANGUAGES[by.index(first)] if first > OVER_ALL or first - second > LEAD else None


@functools.lru_cache(8192)
def own_words(question: str | None, options: str | None) -> frozenset[str]:
    """Words of the question and its options, which are in the question's language whatever they are."""
    return frozenset(latin_words(f"{question or ''} {options or ''}"))


def differs(question: str | None, answer: str, options: str | None = None) -> bool:
    """Whether an answer is worded in another language than its question.

    Words of the question and of its options say nothing, nor do quoted ones.
    """
    q = language(question)
    if q is None:
        return False
    t = unquoted(answer)
    by_script = script_language(t)
    if by_script:
        if (by_script[0], q) == ("zh", "ja"):  # a few ideographs may be either; a sentence without kana is not Japanese
            return sum("㐀" <= c <= "鿿" for c in t) >= 10
        return by_script[0] != q
    words, known = latin_words(t), own_words(question, options)
    if q in OTHER_SCRIPTS:
        return max(scores([w for w in words if w not in known])) > OVER_ALL
    return contrast(LANGUAGES.index(q)).most(words, known) > MARGIN
