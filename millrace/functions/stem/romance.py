"""French, Spanish, Portuguese, Italian and Romanian."""

from __future__ import annotations

from millrace.functions.stem.core import Suffixes, begins, between, cut, past_syllable, regions, romance_region, swapped

# fixed values
_FR_VOWELS = "aeiouyàâèéêëîïôùû"
_FR_MAIN = Suffixes(
    off="ance iqUe isme able iste eux ances iqUes ismes ables istes", ic="atrice ateur ation atrices ateurs ations", log="logie logies", u="usion ution usions utions", ent="ence ences",
    ement="ement ements", ité="ité ités", if_="if ive ifs ives", eau="eaux", al="aux", eux="euse euses", iss="issement issements", ant="amment", ent_="emment", ment="ment ments",
)
_FR_I = Suffixes(
    off="îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_VERB = Suffixes(
    ions="ions", off="é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez",
    e="âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions",
)
_FR_EMENT = Suffixes(iv="iv", eus="eus", abl="abl iqU", ièr="ièr Ièr")
_FR_ITÉ = Suffixes(abil="abil", ic="ic", iv="iv")
_FR_REST = Suffixes(ion="ion", i="ier ière Ier Ière", e="e", ë="ë")
_FR_KEEP_S = "aiouès"
_ES_VOWELS = "aeiouáéíóúü"
_ES_PRONOUN = Suffixes(off="me se sela selo selas selos la le lo las les los nos")
_ES_BEFORE = Suffixes(accent="iéndo ándo ár ér ír", plain="ando iendo ar er ir", yendo="yendo")
_ES_MAIN = Suffixes(
    off="anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    ic="adora ador ación adoras adores aciones ante antes ancia ancias", log="logía logías", u="ución uciones", ente="encia encias", amente="amente", mente="mente", idad="idad idades",
    iva="iva ivo ivas ivos",
)
_ES_Y = Suffixes(off="ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERB = Suffixes(
    gu="en es éis emos",
    off="arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
)
_ES_REST = Suffixes(off="os a o á í ó", e="e é")
_PT_VOWELS = "aeiouáâéêíóôú"
_PT_MAIN = Suffixes(
    off="eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância",
    log="logía logías", u="ución uciones", ente="ência ências", amente="amente", mente="mente", idad="idade idades", iva="iva ivo ivas ivos", ir="ira iras",
)
_PT_VERB = Suffixes(
    off="ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo "
    "indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis áreis "
    "éreis íreis ásseis ésseis ísseis áveis íeis aríeis eríeis iríeis ados idos amos áramos éramos íramos ávamos íamos aríamos eríamos iríamos emos aremos eremos iremos ássemos êssemos íssemos imos "
    "armos ermos irmos ámos arás erás irás eu iu ou ará erá irá"
)
_PT_REST = Suffixes(off="os a i o á í ó")
_IT_VOWELS = "aeiouàèìòù"
_IT_PRONOUN = Suffixes(
    off="ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
)
_IT_BEFORE = Suffixes(off="ando endo", e="ar er ir")
_IT_MAIN = Suffixes(
    off="anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    ic="azione azioni atore atori", log="logia logie", u="uzione uzioni usione usioni", ente="enza enze", amento="amento amenti imento imenti", amente="amente", ità="ità", iva="iva ivo ivi ive",
)
_IT_VERB = Suffixes(
    off="ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete "
    "erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite "
    "iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)
_RO_VOWELS = "aeiouâîă"
_RO_FIRST = Suffixes(off="ul ului", a="aua", e="ea ele elor", i="ii iua iei iile iilor ilor", ile="ile", at="atei", aţi="aţie aţia")
_RO_COMBO = Suffixes(
    abil="abilitate abilitati abilităi abilităţi", ibil="ibilitate", iv="ivitate ivitati ivităi ivităţi",
    ic="icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    at="ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", it="itiv itiva itive itivi itivă iţiune itoare itor itori",
)
_RO_MAIN = Suffixes(
    off="at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori "
    "itate itati ităi ităţi iv iva ive ivi ivă", iune="iune iuni", ist="ism isme ist ista iste isti istă işti",
)
_RO_VERB = Suffixes(
    after="ea ia esc ăsc ind ând are ere ire âre ase ise use âse eşte ăşte eze ai eai iai eşti ăşti ui ezi aşi aseşi iseşi useşi âseşi işi uşi âşi âi eaţi iaţi arăţi aserăţi iserăţi userăţi âserăţi irăţi "
    "urăţi ârăţi am eam iam asem isem usem âsem arăm aserăm iserăm userăm âserăm irăm urăm ârăm au eau iau indu ându ez ească ară aseră iseră useră âseră iră ură âră ează",
    off="se sese sei seşi seseşi aţi eţi iţi serăţi seserăţi âţi em sesem im ăm serăm seserăm âm seră seseră",
)
_RO_REST = Suffixes(off="a e i ie ă")


def _french_marked(word: str) -> str:
    out, i, n = list(word), 0, len(word)
    while i < n:
        c, after = out[i], out[i + 1] if i + 1 < n else ""
        if c in _FR_VOWELS and after in ("u", "i") and after and i + 2 < n and out[i + 2] in _FR_VOWELS:
            out[i + 1] = after.upper()
            i += 3
        elif c in _FR_VOWELS and after == "y":
            out[i + 1] = "Y"
            i += 2
        elif c == "y" and after and after in _FR_VOWELS:
            out[i] = "Y"
            i += 1
        elif c == "q" and after == "u":
            out[i + 1] = "U"
            i += 2
        else:
            i += 1
    return "".join(out)


def _french_region(word: str) -> int:
    n = len(word)
    if n >= 3 and ((word[0] in _FR_VOWELS and word[1] in _FR_VOWELS) or word.startswith(("par", "col", "tap"))):
        return 3
    return next((i + 1 for i in range(1, n) if word[i] in _FR_VOWELS), n)


def _french_main(word: str, verb: int, one: int, two: int) -> tuple[str, bool]:
    """(word, whether a suffix was taken so that verbs need not be tried)."""
    suffix, action = _FR_MAIN.of(word)
    left = cut(word, suffix)
    at = len(left)
    if not action:
        return word, False
    if action == "off":
        return (left, True) if at >= two else (word, False)
    if action in ("log", "u", "ent"):
        return (left + action, True) if at >= two else (word, False)
    if action == "ic":
        if at < two:
            return word, False
        if left.endswith("ic"):
            left = left[:-2] if len(left) - 2 >= two else left[:-2] + "iqU"
        return left, True
    if action == "ement":
        if at < verb:
            return word, False
        s, a = _FR_EMENT.of(left)
        inner = begins(left, s)
        if a == "iv" and inner >= two:
            left = left[:inner]
            if left.endswith("at") and len(left) - 2 >= two:
                left = left[:-2]
        elif a == "eus":
            left = left[:inner] if inner >= two else left[:inner] + "eux" if inner >= one else left
        elif a == "abl" and inner >= two:
            left = left[:inner]
        elif a == "ièr" and inner >= verb:
            left = left[:inner] + "i"
        return left, True
    if action == "ité":
        if at < two:
            return word, False
        s, a = _FR_ITÉ.of(left)
        inner = begins(left, s)
        if a == "abil":
            left = left[:inner] if inner >= two else left[:inner] + "abl"
        elif a == "ic":
            left = left[:inner] if inner >= two else left[:inner] + "iqU"
        elif a == "iv" and inner >= two:
            left = left[:inner]
        return left, True
    if action == "if_":
        if at < two:
            return word, False
        if left.endswith("at") and len(left) - 2 >= two:
            left = left[:-2]
            if left.endswith("ic"):
                left = left[:-2] if len(left) - 2 >= two else left[:-2] + "iqU"
        return left, True
    if action == "eau":
        return left + "eau", True
    if action == "al":
        return (left + "al", True) if at >= one else (word, False)
    if action == "eux":
        return (left, True) if at >= two else (left + "eux", True) if at >= one else (word, False)
    if action == "iss":
        return (left, True) if at >= one and left and left[-1] not in _FR_VOWELS else (word, False)
    # these are taken, and verbs are tried all the same
    if action in ("ant", "ent_"):
        return (left + action.rstrip("_"), False) if at >= verb else (word, False)
    return (left, False) if left and left[-1] in _FR_VOWELS and at - 1 >= verb else (word, False)


def _french_verb(word: str, verb: int, two: int) -> tuple[str, bool]:
    suffix, action = _FR_I.of(word, verb)
    at = begins(word, suffix)
    if action and at - 1 >= verb and word[at - 1] not in _FR_VOWELS:
        return word[:at], True
    suffix, action = _FR_VERB.of(word, verb)
    at = begins(word, suffix)
    if action == "ions":
        return (word[:at], True) if at >= two else (word, False)
    if action:
        left = word[:at]
        if action == "e" and left.endswith("e") and len(left) - 1 >= verb:
            left = left[:-1]
        return left, True
    return word, False


def french(word: str) -> str:
    word = _french_marked(word)
    verb = _french_region(word)
    one, two = regions(word, _FR_VOWELS)
    word, done = _french_main(word, verb, one, two)
    if not done:
        word, done = _french_verb(word, verb, two)
    if done:
        if word.endswith("Y"):
            word = word[:-1] + "i"
        elif word.endswith("ç"):
            word = word[:-1] + "c"
    else:
        if word.endswith("s") and len(word) > 1 and word[-2] not in _FR_KEEP_S:
            word = word[:-1]
        suffix, action = _FR_REST.of(word, verb)
        left = cut(word, suffix)
        if action == "ion":
            word = left if len(left) >= two and left.endswith(("s", "t")) and len(left) - 1 >= verb else word
        elif action == "ë":
            word = left if left.endswith("gu") and len(left) - 2 >= verb else word
        elif action:
            word = left + ("i" if action == "i" else "")
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    end = len(word)
    while end and word[end - 1] not in _FR_VOWELS:
        end -= 1
    if 0 < end < len(word) and word[end - 1] in "éè":
        word = word[: end - 1] + "e" + word[end:]
    return word.replace("I", "i").replace("U", "u").replace("Y", "y")


def _amente(left: str, two: int, others: tuple[str, ...]) -> str:
    """What may stand before an adverb's ending goes too."""
    if left.endswith("iv"):
        if len(left) - 2 >= two:
            left = left[:-2]
            if left.endswith("at") and len(left) - 2 >= two:
                left = left[:-2]
        return left
    for s in others:
        if left.endswith(s):
            return cut(left, s) if begins(left, s) >= two else left
    return left


def _before(left: str, two: int, others: tuple[str, ...]) -> str:
    """The longest of ``others`` at the end goes, where it stands in the second region."""
    for s in sorted(others, key=len, reverse=True):
        if left.endswith(s):
            return cut(left, s) if begins(left, s) >= two else left
    return left


def _iberian(word: str, table: Suffixes, verb: int, one: int, two: int, adverbs: tuple[str, ...]) -> tuple[str, bool]:
    """The derivational suffixes of Spanish, Portuguese and Italian."""
    suffix, action = table.of(word)
    left = cut(word, suffix)
    at = len(left)
    if not action:
        return word, False
    if action == "amente":
        if at < one:
            return word, False
        return _amente(left, two, ("os", "ic", "abil" if table is _IT_MAIN else "ad")), True
    if action == "amento":
        return (left, True) if at >= verb else (word, False)
    if action == "ir":
        return (left + "ir", True) if at >= verb and left.endswith("e") else (word, False)
    if at < two:
        return word, False
    if action in ("log", "u", "ente"):
        return left + action, True
    if action == "ic":
        return _before(left, two, ("ic",)), True
    if action == "mente":
        return _before(left, two, adverbs), True
    if action in ("idad", "ità"):
        return _before(left, two, ("abil", "ic", "iv")), True
    if action == "iva":
        short = _before(left, two, ("at",))
        return (_before(short, two, ("ic",)) if short != left and table is _IT_MAIN else short), True
    return left, True


def spanish(word: str) -> str:
    verb = romance_region(word, _ES_VOWELS)
    one, two = regions(word, _ES_VOWELS)
    plain = str.maketrans("áéíóú", "aeiou")
    pronoun, found = _ES_PRONOUN.of(word)
    if found:
        left = cut(word, pronoun)
        ending, action = _ES_BEFORE.of(left)
        if action and begins(left, ending) >= verb:
            if action == "accent":
                word = cut(left, ending, swapped(ending, plain))
            elif action == "plain" or cut(left, ending).endswith("u"):
                word = left
    word, done = _iberian(word, _ES_MAIN, verb, one, two, ("ante", "able", "ible"))
    if not done:
        suffix, action = _ES_Y.of(word, verb)
        if action and cut(word, suffix).endswith("u"):
            word, done = cut(word, suffix), True
    if not done:
        suffix, action = _ES_VERB.of(word, verb)
        if action:
            word = cut(word, suffix)
            if action == "gu" and word.endswith("gu"):
                word = word[:-1]
    suffix, action = _ES_REST.of(word)
    if action and begins(word, suffix) >= verb:
        word = cut(word, suffix)
        if action == "e" and word.endswith("gu") and len(word) - 1 >= verb:
            word = word[:-1]
    return swapped(word, plain)


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    verb = romance_region(word, _PT_VOWELS)
    one, two = regions(word, _PT_VOWELS)
    word, done = _iberian(word, _PT_MAIN, verb, one, two, ("ante", "avel", "ível"))
    if not done:
        suffix, action = _PT_VERB.of(word, verb)
        if action:
            word, done = cut(word, suffix), True
    if done:
        if word.endswith("ci") and len(word) - 1 >= verb:
            word = word[:-1]
    else:
        suffix, action = _PT_REST.of(word)
        if action and begins(word, suffix) >= verb:
            word = cut(word, suffix)
    if word[-1:] in ("e", "é", "ê") and word:
        if len(word) - 1 >= verb:
            word = word[:-1]
            if word.endswith(("gu", "ci")) and len(word) - 1 >= verb:
                word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


def italian(word: str) -> str:
    word = swapped(word, str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    word = between(word, _IT_VOWELS, {"u": "U", "i": "I"})
    verb = romance_region(word, _IT_VOWELS)
    one, two = regions(word, _IT_VOWELS)
    pronoun, found = _IT_PRONOUN.of(word)
    if found:
        left = cut(word, pronoun)
        ending, action = _IT_BEFORE.of(left)
        if action and begins(left, ending) >= verb:
            word = left + ("e" if action == "e" else "")
    word, done = _iberian(word, _IT_MAIN, verb, one, two, ())
    if not done:
        suffix, action = _IT_VERB.of(word, verb)
        word = cut(word, suffix)
    if word and word[-1] in "aeioàèìò" and len(word) - 1 >= verb:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= verb:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= verb:
        word = word[:-1]
    return word.replace("I", "i").replace("U", "u")


def romanian(word: str) -> str:
    word = between(word, _RO_VOWELS, {"u": "U", "i": "I"})
    verb = romance_region(word, _RO_VOWELS)
    one, two = regions(word, _RO_VOWELS)
    suffix, action = _RO_FIRST.of(word)
    left = cut(word, suffix)
    if action and len(left) >= one:
        if action == "ile":
            word = word if left.endswith("ab") else left + "i"
        else:
            word = left + ("" if action == "off" else action)
    removed = False
    while True:
        suffix, action = _RO_COMBO.of(word)
        if not action or begins(word, suffix) < one:
            break
        word, removed = cut(word, suffix, action), True
    suffix, action = _RO_MAIN.of(word)
    left = cut(word, suffix)
    if action and len(left) >= two:
        if action == "iune":
            if left.endswith("ţ"):
                word, removed = left[:-1] + "t", True
        else:
            word, removed = left + ("ist" if action == "ist" else ""), True
    if not removed:
        suffix, action = _RO_VERB.of(word, verb)
        left = cut(word, suffix)
        if action == "off" or (action and len(left) - 1 >= verb and (left[-1] not in _RO_VOWELS or left[-1] == "u")):
            word = left
    suffix, action = _RO_REST.of(word)
    if action and begins(word, suffix) >= verb:
        word = cut(word, suffix)
    return word.replace("I", "i").replace("U", "u")
