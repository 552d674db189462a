"""The lexicon: word lists of each language, as data.

A lexicon is a long table ``(iso3, kind, key, value)``; ``default_table`` gives the
bundled one, and any table of that shape can stand in its place (``Lexicon.from_rows``).
Languages without an entry have empty lists, which is defined behaviour: texts in
them lose punctuation and numbers only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Results depend on exactly these words.
FUNCTION_ENG = """
    a an the this that these those i you he she it we they me him her us them my your his its our their mine
    yours hers ours theirs myself yourself himself herself itself ourselves themselves who whom whose which
    what in on at to for of with by from into onto upon within without during before after above below between
    among amongst across against around behind beneath beside besides beyond inside near off outside over past
    through toward towards under underneath via per and or but if because although though while whereas unless
    since so yet nor both whether either neither be am is are was were been being have has had having do does
    did doing done will would shall should can could may might must need dare ought not no never as than very
    too quite rather here there where when why how then now just only even also still already indeed however
    therefore otherwise nevertheless maybe perhaps please yes oh ah any some every each all few many much
    several nothing something anything everything someone anyone everyone none such same else other another
    more most less least up down out well
""".split()

# Results depend on exactly these words.
FUNCTION_ITA = """
    il lo la i gli le un uno una questo questa questi queste quel quella quelli quelle io tu lui lei noi voi
    loro mi ti si ci vi ne mio tuo suo nostro vostro mia tua sua nostra vostra miei tuoi suoi nostri vostri
    mie tue sue nostre vostre che cui chi in a da di con su per tra fra del dello della dei degli delle al
    allo alla ai agli alle dal dallo dalla dai dagli dalle nel nello nella nei negli nelle sul sullo sulla sui
    sugli sulle e ed o od ma se come mentre quando dove non neppure nemmeno sono sei siamo siete sia siano ho
    hai ha abbiamo avete hanno sto stai sta stiamo state stanno posso puoi puo possiamo potete possono voglio
    vuoi vuole vogliamo volete vogliono devo devi deve dobbiamo dovete devono qui qua li gia piu meno molto
    poco troppo anche pure ancora sempre mai poi dopo prima ora adesso allora dunque quindi inoltre perche fa
    fanno fare essere avere stare potere volere dovere vorrei avrei sarei potrei dovrei farei darei volevo
    avevo ero stavo abbiate siate perché però oppure neanche forse magari ecco certo sì grazie prego salve
    arrivederci
""".split()

# Results depend on exactly these words.
FUNCTION_FRA = """
    le la les un une des du de ce cet cette ces mon ton son ma ta sa mes tes ses nos vos leurs notre votre
    chaque quelques tout toute tous toutes je tu il elle on nous vous ils elles me te se lui leur moi toi soi
    eux qui que quoi dont ou a dans par pour en vers avec sans sous sur chez entre pendant depuis et mais donc
    car ni lorsque quand puisque si suis es est sommes etes sont ai as avons avez ont ete etre avoir ne pas
    plus tres aussi bien deja encore toujours jamais alors puis ainsi enfin trop assez moins beaucoup peu oui
    non
""".split()

# Results depend on exactly these words.
FUNCTION_DEU = """
    der die das den dem des ein eine einer eines einem einen mein dein sein ihr unser euer meine deine seine
    ihre unsere eure dieser diese dieses diesen diesem ich du er sie es wir mich dich sich uns euch mir dir
    ihm man in auf mit von zu aus bei nach um durch fur gegen ohne uber unter vor hinter neben zwischen an bis
    seit und oder aber denn weil dass wenn als ob wahrend nachdem bevor seitdem bin bist ist sind seid war
    waren habe hast hat haben habt kann kannst konnen konnt muss musst mussen soll sollst sollen sollt will
    willst wollen wollt darf darfst durfen durft mag magst mogen nicht kein keine keinen nichts nie niemals
    sehr viel wenig ganz etwas mehr weniger schon noch immer ja nein auch nur
""".split()

# Results depend on exactly these words.
FUNCTION_SPA = """
    el la los las un una unos unas este esta estos estas ese esa esos esas aquel aquella aquellos aquellas mi
    tu su nuestro vuestro mis tus sus nuestros vuestros yo ella usted nosotros vosotros ellos ellas ustedes me
    te se nos os lo le les a ante bajo con contra de desde durante en entre hacia hasta mediante para por
    segun sin sobre tras y e o u pero sino aunque porque pues como que si cuando mientras soy eres es somos
    sois son he has ha hemos habeis han estoy estamos estais estan tengo tienes tiene tenemos teneis tienen
    puedo puedes puede podemos podeis pueden quiero quieres quiere queremos quereis quieren debo debes debe
    debemos debeis deben no nada nadie ningun ninguna nunca jamas muy mucho poca poco bastante demasiado mas
    menos casi solo solamente tambien siempre ya aun todavia aqui ahi alli bien mal
""".split()

# Results depend on exactly these words.
FUNCTION_POR = """
    o a os as um uma uns umas este esta estes estas esse essa esses essas aquele aquela aqueles aquelas meu
    minha teu tua seu sua nosso nossa vosso vossa meus minhas teus tuas seus suas eu tu ele ela nos vos eles
    elas voce voces me te se lhe lhes ante apos ate com contra de desde em entre para perante por sem sob
    sobre tras e mas ou porque pois como que quando enquanto embora contudo entretanto portanto porem todavia
    sou somos sao estou estamos estao tenho tem temos hei ha havemos hao posso pode podemos podem quero quer
    queremos querem devo deve devemos devem nao nada ninguem nenhum nenhuma nunca jamais muito pouco bastante
    demais mais menos quase so somente tambem sempre ja ainda agora
""".split()

# Results depend on exactly these words.
FUNCTION_NLD = """
    de het een deze dit die dat mijn jouw zijn haar onze ons hun uw ik jij je u hij zij ze wij we jullie mij
    me jou hem hen in op met van naar uit bij door voor over onder tegen tussen tijdens na langs om zonder
    binnen buiten via per en of maar want dus omdat als wanneer terwijl hoewel indien tenzij nadat voordat ben
    bent is was waren heb hebt heeft hebben had hadden kan kunt kunnen moet moeten mag mogen wil wilt willen
    zal zult zullen zou zouden word wordt werd werden geworden niet geen niets niemand nooit heel veel weinig
    erg nog al reeds pas slechts net even bijna haast ja nee ook
""".split()

FUNCTION_WORDS: dict[str, list[str]] = {"eng": FUNCTION_ENG, "ita": FUNCTION_ITA, "fra": FUNCTION_FRA, "deu": FUNCTION_DEU, "spa": FUNCTION_SPA, "por": FUNCTION_POR, "nld": FUNCTION_NLD}

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_ENG = """
    want wants wanted know knows knew make makes made get gets got take takes took taken give gives gave come
    comes came go goes went gone see saw seen think thinks thought say says said tell tells told ask asks
    asked find finds found call calls called time day year way thing person people place world life hand eye
    head face voice long short big small old new good bad great first last next same other work look seem keep
    run move help show try turn today yesterday tomorrow morning afternoon evening night please sorry thank
    hello goodbye welcome
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_ITA = """
    volere potere dovere sapere fare dire dare stare andare venire avere essere chiedere trovare chiamare
    tempo cosa modo parte volta caso giorno notte anno vita gente luogo mondo mano occhio testa persona
    persone casa nome parola lavoro grande piccolo nuovo vecchio bello buono cattivo lungo corto alto basso
    primo ultimo stesso altro molto poco tanto troppo sempre mai spesso ora poi dopo prima oggi ieri domani
    mattina pomeriggio sera grazie prego ciao salve arrivederci
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_FRA = """
    pouvoir vouloir devoir savoir faire dire aller venir avoir etre demander trouver appeler temps chose facon
    partie fois cas jour nuit annee vie gens lieu monde main oeil tete personne maison nom mot travail grand
    petit nouveau vieux beau bon mauvais long court haut bas premier dernier meme autre beaucoup peu toujours
    jamais souvent maintenant puis apres avant hier demain bonjour merci pardon bonsoir bienvenue
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_DEU = """
    sein haben werden koennen muessen wollen duerfen sollen moegen machen sagen geben kommen gehen sehen
    wissen denken finden nehmen lassen bringen halten setzen zeit jahr tag woche monat ding mensch welt gross
    klein neu alt gut schlecht schoen viel wenig lang kurz hoch niedrig immer nie oft jetzt dann heute gestern
    morgen danke bitte hallo tschues willkommen
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_SPA = """
    querer poder deber saber hacer decir dar estar ir venir haber ser tener pedir encontrar llamar tiempo cosa
    modo parte vez caso dia noche anno vida gente lugar mundo mano ojo cabeza persona casa nombre palabra
    trabajo grande pequeno nuevo viejo bueno malo largo corto alto bajo primero ultimo mismo otro mucho poco
    siempre nunca ahora despues antes hoy ayer manana gracias hola adios bienvenido
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_POR = """
    querer poder dever saber fazer dizer dar estar ir vir haver ser ter pedir encontrar chamar tempo coisa
    modo parte vez caso dia noite ano vida gente lugar mundo mao olho cabeca pessoa casa nome palavra trabalho
    grande pequeno novo velho bom mau longo curto alto baixo primeiro ultimo mesmo outro muito pouco sempre
    nunca agora depois antes hoje ontem amanha obrigado ola tchau bem-vindo
""".split()

# Words too general to carry meaning (entries of several words can't match a token and are left out).
GENERIC_NLD = """
    willen kunnen moeten mogen zullen maken zeggen geven komen gaan zien weten denken vinden nemen laten
    brengen houden zetten tijd jaar dag week maand ding mens wereld groot klein nieuw oud goed slecht mooi
    veel weinig lang kort hoog laag altijd nooit vaak nu dan vandaag gisteren morgen dank alsjeblieft hallo
    welkom
""".split()

GENERIC_WORDS: dict[str, list[str]] = {"eng": GENERIC_ENG, "ita": GENERIC_ITA, "fra": GENERIC_FRA, "deu": GENERIC_DEU, "spa": GENERIC_SPA, "por": GENERIC_POR, "nld": GENERIC_NLD}

# Negations are always kept.
NEGATIONS: dict[str, list[str]] = {
    "eng": "not n't no never none nobody nothing neither nor".split(),
    "ita": "non no né neanche nemmeno manco".split(),
    "fra": "ne pas non jamais aucun aucune rien personne".split(),
    "spa": "no nunca jamás ni nadie nada ningún ninguna ninguno".split(),
    "deu": "nicht kein keine keiner keinem keinen keines nie niemals nichts niemand".split(),
    "por": "não nao nunca jamais nem nenhum nenhuma ninguém".split(),
    "zho": "不 没 没有 别 无 非 未 莫".split(),
}

# Used where a language has no generic words.
GENERIC_FALLBACK = "time day year person thing place world life big small new old good bad now then today yesterday tomorrow always never".split()

#: Ties between languages go to the first of these, then by code.
CURATED = ["eng", "ita", "fra", "deu", "spa", "por", "nld"]
ISO1 = {"en": "eng", "it": "ita", "fr": "fra", "de": "deu", "es": "spa", "pt": "por", "nl": "nld"}
KINDS = ("function", "generic", "exclusive", "negation", "lemma", "pos", "proper")


def exclusive_markers(words: dict[str, list[str]]) -> dict[str, list[str]]:
    """Words of one language that no other has: ASCII letters only, three or more."""
    out = {}
    for iso3, own in words.items():
        others = {w for k, v in words.items() if k != iso3 for w in v}
        out[iso3] = [w for w in dict.fromkeys(own) if w not in others and len(w) >= 3 and w.isascii() and w.isalpha()]
    return out


def ambiguous_words(words: dict[str, list[str]]) -> dict[str, list[str]]:
    """Words that a language shares with another."""
    out = {}
    for iso3, own in words.items():
        others = {w for k, v in words.items() if k != iso3 for w in v}
        out[iso3] = [w for w in dict.fromkeys(own) if w in others]
    return out


@dataclass
class Lexicon:
    """Word lists by language, bounded by the dictionary's size and known to the driver."""

    function: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in FUNCTION_WORDS.items()})
    generic: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in GENERIC_WORDS.items()})
    negation: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in NEGATIONS.items()})
    lemma: dict[str, dict[str, str]] = field(default_factory=dict)
    pos: dict[str, dict[str, str]] = field(default_factory=dict)
    proper: dict[str, list[str]] = field(default_factory=dict)
    exclusive: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.exclusive:
            self.exclusive = exclusive_markers(self.function)

    @property
    def languages(self) -> list[str]:
        """Supported languages in the order in which ties are broken."""
        return sorted(self.function, key=lambda k: (CURATED.index(k) if k in CURATED else len(CURATED), k))

    def rows(self) -> list[tuple[str, str, str, str | None]]:
        out: list[tuple[str, str, str, str | None]] = []
        for kind in ("function", "generic", "exclusive", "negation", "proper"):
            out += [(iso3, kind, w, None) for iso3, words in getattr(self, kind).items() for w in words]
        for kind in ("lemma", "pos"):
            out += [(iso3, kind, k, v) for iso3, table in getattr(self, kind).items() for k, v in table.items()]
        return out

    @classmethod
    def from_rows(cls, rows) -> Lexicon:
        """A lexicon of rows (iso3, kind, key, value); of repeated lemma keys the last counts."""
        parts: dict[str, dict] = {k: {} for k in KINDS}
        for iso3, kind, key, value in rows:
            if kind in ("lemma", "pos"):
                parts[kind].setdefault(iso3, {})[key] = value
            else:
                parts[kind].setdefault(iso3, []).append(key)
        return cls(**parts)

    @classmethod
    def from_table(cls, table: DataFrame) -> Lexicon:
        return cls.from_rows(tuple(r) for r in table.select("iso3", "kind", "key", "value").orderBy("iso3", "kind", "key").toLocalIterator())


DEFAULT = Lexicon()


def default_table(spark: SparkSession, lexicon: Lexicon = DEFAULT) -> DataFrame:
    return spark.createDataFrame(lexicon.rows(), "iso3 string, kind string, key string, value string")


def lemma_map(verbs: dict[str, list[str]], lemmas: dict[str, str]) -> dict[str, str]:
    """Form to lemma: verb forms first, explicit lemmas override them."""
    out = {form.lower(): lemma for lemma, forms in verbs.items() for form in forms}
    out.update({k.lower(): v for k, v in lemmas.items()})
    return out


def derived_generic(verbs: dict[str, list[str]], least_verbs: int = 10, top: int = 25, least_forms: int = 4) -> list[str]:
    """Generic words of a language without a list: its verbs of most forms, with the forms."""
    if len(verbs) < least_verbs:
        return list(GENERIC_FALLBACK)
    ranked = sorted((v for v in verbs.items() if len(v[1]) >= least_forms), key=lambda v: -len(v[1]))[:top]
    return list(dict.fromkeys(w.lower() for lemma, forms in ranked for w in (lemma, *forms)))
