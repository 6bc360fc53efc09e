"""Which language a text is in: by script, and among languages in Latin script by frequent words and letter sequences.

For Latin script a naive Bayes model over the letter trigrams of words (with their borders, without
accents, so that missing accents make no difference) is trained, when first used, on the frequent
words and the sample text below. Frequent words count as a whole besides their trigrams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np

from quillspark.functions.unicode_text import fold_words

# Frequent words of each language, without accents.
FREQUENT_WORDS = {
    "vi": "anh ban bang ben bi boi cac can cac cach can cho chi chu co con cua da dang dat de den di dieu do doi don duoc duong gi gia giay hang hoac hoi hop khi khoan khong kia la lai lam len loi luat mat moi mot muc nam nao nay nen neu ngay nghiem ngoai nguoi nha nham nhan nhu nhung noi phai phan quan quyen qua sau so tai tam theo thi thoi thu thuoc thue thuong tien tinh to toi tren trong truoc truong tu va van vao ve vi viec voi xin yeu",
    "en": "about after all also an and any are as at be been before by can could does during for from had has have he her his how i if in into is it its may me more must my no not of on once only or our out shall she should so than that the their them then there these they this to under unless up was we were what when where which while who whose why will with would you your",
    "fr": "afin ainsi apres au aux avant avec ce ces cette comme dans de des doit donc du elle en est et etre fait il ils la le les leur lors lorsque mais ne nous on ou par pas pendant peut plus pour quand que qui sa sans sauf se selon ses si son sont sous sur tant tenu un une vous",
    "es": "al ante antes aunque como con contra cual cuando de debe deben del desde donde durante el ella ellos en entre es esta este estos fue ha hasta hay la las le les lo los mas mientras muy ni no o otro para pero por porque puede que quien se segun ser si sin sobre son su sus tambien tiene toda todo tras un una y ya",
    "pt": "ao aos apos as ate com como contra da das de deve devem do dos durante e ela ele em entre esta este foi ha isso mais mas na nao nas nem no nos o os ou para pela pelo pode por porque quando que quem se sem ser seu seus sua sob sobre sao tambem tem todo um uma",
    "it": "ai al alla alle anche che chi ci come con contro cui da dal dalla degli dei del della delle deve di dopo e ed essere fino fra gli ha hanno i il in la le lo ma nel nella non o ogni per perche piu prima puo quando questa questo se senza si sia sono su sul sulla tra un una",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es fur hat ich im in ist kann kein mit muss nach nicht nur ob oder sein sich sie sind uber um und unter von vor war wenn werden wie wird zu zum zur",
    "nl": "aan als bij dan dat de deze die dit door een en er geen haar had heeft het hij hun ik in is kan maar met moet na naar niet nog of om onder ook op over te tot uit van voor was wat werd wordt zal ze zich zij zijn zonder",
    "sv": "alla att av blir den det detta du efter ej eller en ett for fran genom han har hon i icke inte jag kan med men mot nar och om pa samt sig sin skall ska som till under utan var vid",
    "da": "af at blev den der det efter eller en er et for fra ham han har hun hvis i ikke jeg kan med men mod nar og om over pa sig sin skal som til uden under ved vil",
    "pl": "aby albo ale bez byc byl co czy dla do gdy i ich ich jak jako jego jest jesli juz lub ma moze musi na nad nie o od oraz po pod prawo przed przez przy sa sie tak ten tego to tylko w wedlug wszystkie z za ze",
    "cs": "aby ale ani az bez byl byt co do i ja jak jako je jeho jejich jen jsou k kdyz ktera ktere ktery ma mezi muze musi na nebo neni nez o od po pod podle pred pri pro s se si tak tento to u v vsak z za ze",
    "ro": "acest aceasta al ale are asupra au ca care catre ce cel cu dar de despre din dupa este fara fi fie in intre la mai nu o pe pentru poate prin sa sau se si sunt trebuie un unei unui va",
    "hu": "a az azt csak de egy el ez ezt ha hogy is kell kozott le lehet lesz meg mert mint minden nem ok pedig szerint szamara utan vagy van volt",
    "fi": "ei eika ennen etta han he hyvin ja jalkeen jos joka jotka kaikki kanssa kuin kun kuten mika mutta myos ne niin nyt olla olisi on ovat pitaa sen seka se tai taman tulee vain voi",
    "tr": "ama ancak bir bu cok da daha de degil dir en gibi gore hem her icin ile ise kadar ki mi ne o olan olarak olmak once sonra tarafindan tum uzere var ve veya ya yok",
    "id": "ada adalah agar akan apabila atau atas bagi bahwa baru dalam dan dapat dari dengan di harus hanya ini itu jika juga kami karena ke kepada lain lebih maka mereka namun oleh orang pada para saja saat saya sebagai sebelum secara sesuai setelah sudah telah tentang terhadap tersebut tidak untuk wajib yang",
    "tl": "ang ano at ay ayon bago dahil dapat din ganito hindi ibang ito iyon ka kanilang kanyang kapag kung lahat lamang mga may mula na nang ng ni nito o pagkatapos para sa sila siya tao upang walang",
    "sw": "au baada bila cha hadi hii hiyo huo ili ina kabla kama katika kila kuwa kwa kwamba la lazima na ni pamoja sana si ujenzi wa wake wao ya yake yeye yote za",
}
# A sample of each language, the first article of the Universal Declaration of Human Rights, without accents.
SAMPLES = {
    "vi": "tat ca moi nguoi sinh ra deu duoc tu do va binh dang ve nhan pham va quyen loi moi con nguoi deu duoc tao hoa ban cho ly tri va luong tam va can phai doi xu voi nhau trong tinh anh em",
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood",
    "fr": "tous les etres humains naissent libres et egaux en dignite et en droits ils sont doues de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternite",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como estan de razon y conciencia deben comportarse fraternalmente los unos con los otros",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razao e de consciencia devem agir uns para com os outros em espirito de fraternidade",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignita e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza",
    "de": "alle menschen sind frei und gleich an wurde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der bruderlichkeit begegnen",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen",
    "sv": "alla manniskor ar fodda fria och lika i varde och rattigheter de har utrustats med fornuft och samvete och bor handla gentemot varandra i en anda av gemenskap",
    "da": "alle mennesker er fodt frie og lige i vaerdighed og rettigheder de er udstyret med fornuft og samvittighed og de bor handle mod hverandre i en broderskabets and",
    "pl": "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa",
    "cs": "vsichni lide se rodi svobodni a sobe rovni co do dustojnosti a prav jsou nadani rozumem a svedomim a maji spolu jednat v duchu bratrstvi",
    "ro": "toate fiintele umane se nasc libere si egale in demnitate si in drepturi ele sunt inzestrate cu ratiune si constiinta si trebuie sa se comporte unele fata de altele in spiritul fraternitatii",
    "hu": "minden emberi leny szabadon szuletik es egyenlo meltosaga es joga van az emberek esszel es lelkiismerettel birvan egymassal szemben testveri szellemben kell hogy viseltessenek",
    "fi": "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto ja heidan on toimittava toisiaan kohtaan veljeyden hengessa",
    "tr": "butun insanlar hur haysiyet ve haklar bakimindan esit dogarlar akil ve vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler",
    "id": "semua orang dilahirkan merdeka dan mempunyai martabat dan hak hak yang sama mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan",
    "tl": "ang lahat ng tao ay isinilang na malaya at pantay pantay sa karangalan at mga karapatan sila ay pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa t isa sa diwa ng pagkakapatiran",
    "sw": "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa watendeane kindugu",
}

_SCRIPTS = {"th": re.compile("[ก-๛]"), "hi": re.compile("[ऀ-ॿ]"), "ru": re.compile("[Ѐ-ӿ]"), "kana": re.compile("[぀-ヿ]"), "han": re.compile("[㐀-鿿]"), "ko": re.compile("[가-힯]"), "ar": re.compile("[؀-ۿ]"), "he": re.compile("[֐-׿]"), "el": re.compile("[Ͱ-Ͽ]"), "lo": re.compile("[຀-໿]"), "km": re.compile("[ក-៿]"), "latin": re.compile("[A-Za-zÀ-ɏḀ-ỿ]")}
_OTHER_SCRIPT = re.compile("[Ͱ-᷿⺀-￯\U00010000-\U0010ffff]")
#: Vowels and letters that, among these languages, only Vietnamese has.
_VI_LETTERS = re.compile("[ơưƠƯẠ-ỹ]")
#: What a frequent word weighs against a trigram, and a trigram that a language's training text lacks.
WORD_WEIGHT, UNSEEN = 2.0, 0.3


@lru_cache(None)
def _model() -> tuple[dict[str, dict[str, float]], dict[str, float], dict[str, frozenset]]:
    """Log probabilities of trigrams per language, of an unseen one, and the frequent words."""
    counts = {}
    for lang, words in FREQUENT_WORDS.items():
        n: Counter = Counter()
        for w in (*words.split(), *SAMPLES[lang].split()):
            n.update(_trigrams(w))
        counts[lang] = n
    kinds = len(set().union(*counts.values()))
    seen, unseen = {}, {}
    for lang, n in counts.items():
        total = n.total() + UNSEEN * kinds
        seen[lang] = {t: math.log((c + UNSEEN) / total) for t, c in n.items()}
        unseen[lang] = math.log(UNSEEN / total)
    return seen, unseen, {lang: frozenset(w.split()) for lang, w in FREQUENT_WORDS.items()}


def _trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@lru_cache(1 << 16)
def _word_evidence(word: str) -> np.ndarray:
    """What a word says for each language, in the order of FREQUENT_WORDS, against the mean of all."""
    seen, unseen, frequent = _model()
    if word[0].isdigit():
        return np.zeros(len(frequent))
    grams = _trigrams(word)
    scores = [sum(seen[lang].get(t, unseen[lang]) for t in grams) / len(grams) + WORD_WEIGHT * (word in frequent[lang]) for lang in frequent]
    return np.array(scores) - sum(scores) / len(scores)


def script(text: str) -> tuple[str | None, float]:
    """The language that the script alone tells, "latin", or None; and the share of the letters that it has."""
    if not _OTHER_SCRIPT.search(text):
        return "latin", 1.0
    n = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    # an ideograph or syllable says about as much as two letters
    n["han"] *= 2
    n["kana"] *= 2
    total = sum(n.values())
    if not total:
        return None, 0.0
    if n["kana"] > 0.1 * (n["kana"] + n["han"]) and n["kana"] + n["han"] > total / 2:
        return "ja", (n["kana"] + n["han"]) / total
    if n["han"] > total / 2:
        return "zh", n["han"] / total
    best = max(n, key=n.get)
    return best, n[best] / total


def latin_evidence(text: str, words: list[str]) -> dict[str, float]:
    """Evidence for each language in Latin script, summed over words and letters only Vietnamese has."""
    rows = [_word_evidence(w) for w in words]
    sums = np.add.reduce(rows).tolist() if rows else [0.0] * len(FREQUENT_WORDS)
    out = dict(zip(FREQUENT_WORDS, sums, strict=True))
    if not text.isascii():
        out["vi"] += 0.5 * len(_VI_LETTERS.findall(text))
    return out


def language(text: str | None, words: list[str] | None = None) -> tuple[str | None, float]:
    """The language and how sure it is, from 0 (no evidence) to 1. Letters of quoted foreign terms are outweighed, not excluded. ``words`` are the text's folded words, if known."""
    if not text:
        return None, 0.0
    lang, share = script(text)
    if lang != "latin":
        return lang, share
    words = fold_words(text) if words is None else words
    evidence = latin_evidence(text, words)
    first, second = sorted(evidence.values(), reverse=True)[:2]
    if first <= 0:
        return None, 0.0
    return max(evidence, key=evidence.get), share * (1 - math.exp(second - first))
