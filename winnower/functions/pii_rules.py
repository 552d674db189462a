"""Rules for personal data, as a table.

``Rule`` rows can come from any table of the same shape (``from_table``); these are
the bundled ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    group: str
    category: str
    pattern: str
    weight: int
    validator: str
    high: bool
    keywords: tuple[str, ...]
    tags: tuple[str, ...]


# Group, category, pattern, weight, validator, high confidence, context keywords, compliance tags.
RULES: list[Rule] = [
    Rule("EU", "Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 8, "", False, ("email", "mail", "contatto", "indirizzo", "posta", "adresse", "correo"), ("GDPR Art.4(1)",)),
    Rule("EU", "Phone E.164", r"\b\+?[1-9]\d{6,14}\b", 10, "", False, ("tel", "phone", "cell", "mobile", "fisso", "nummer", "téléphone", "teléfono", "telefon"), ("GDPR Art.4(1)",)),
    Rule("EU", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", 22, "IBAN", False, ("iban", "conto", "bank", "compte", "cuenta", "konto", "rachunek"), ("PCI-DSS", "SEPA")),
    Rule("EU", "Credit Card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 25, "LUHN", False, ("card", "credit", "debit", "tarjeta", "carte", "karta", "pago"), ("PCI-DSS",)),
    Rule("EU", "JWT/Token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 28, "", True, ("token", "jwt", "auth", "bearer"), ("NIST 800-53",)),
    Rule("EU", "Password/Secret", r"\b(?:password|passwd|pwd|secret|token|api_key|apikey|bearer)[\s:=]+\S{8,}\b", 24, "", False, (), ("NIST 800-53",)),
    Rule("EU", "GPS Coordinates", r"\b[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)\b", 10, "", False, ("gps", "location", "posizione", "ubicación", "ortung", "coordonnées", "współrzędne", "locatie", "localização", "lat", "lon", "plus code", "what3words", "geolokacja", "standort"), ("GDPR Art.4(1) - Location Data",)),
    Rule("EU", "EU Vehicle License Plate", r"(?i)(?:targa|kennzeichen|license plate|placa|rejestracja|kenteken|immatriculation)\s*[:=]?\s*[A-Z0-9]{1,4}[-\s.]*[A-Z0-9]{1,4}[-\s.]*[A-Z0-9]{1,4}\b", 12, "", False, ("auto", "veicolo", "car", "vehicle", "kfz", "wozidlo", "samochód"), ("GDPR Art.4(1) - Indirect Identifiers",)),
    Rule("EU", "PNR / Booking Code", r"(?i)(?:pnr|booking code|prenotazione|codice prenotazione|reservation code|codice viaggio|buchungscode|code de réservation|código de reserva|nr rezerwacji|boekingscode)\s*[:=]?\s*[A-Z0-9]{6}\b", 8, "", False, ("volo", "treno", "hotel", "aereo", "flight", "train", "flug", "vlucht", "pociąg", "tren", "amadeus", "sabre", "galileo", "viaje", "reise"), ("GDPR Art.4(1) - Mobility Data",)),
    Rule("EU", "Social / Messenger Handle", r"(?i)(?:@|t\.me\/|instagram\.com\/|x\.com\/|tiktok\.com\/|discord\.gg\/|telegram\.me\/|linkedin\.com\/in\/)[a-zA-Z0-9_\.]{3,32}\b", 6, "", False, ("contattami", "scrivimi", "contact me", "kontakt", "contactez-moi", "contáctame", "skontaktuj się", "neem contact op", "profile", "profil", "perfil", "canale", "channel", "grupo", "group"), ("GDPR Art.4(1) - Digital Identity",)),
    Rule("EU", "Minor Data (<16)", r"(?i)\b(?:minore di|bambino di|ragazzo di|under\s*|minderj[aä]hrig unter|mineur de|menor de|małoletni poniżej)\s*\d{1,2}\s*(?:anni|years|ans|años|lat|jahr|let)\b", 18, "", False, ("scuola", "asilo", "genitore", "tutore", "autorizzazione", "consenso genitori", "pediatra", "école", "crèche", "parent", "guardian", "einverständnis", "consentimiento", "zgoda rodziców", "toestemming ouder"), ("GDPR Art.8 - Enhanced Minor Protection",)),
    Rule("EU", "Legal Case / File Number", r"(?i)(?:rg|r\.g\.|proc\.|fasc\.|causa|sentenza|decreto|verbale|denuncia|aktenzeichen|dossier judiciaire|expediente|nr sprawy|zaaknummer)\s*(?:n\.?)?\s*\d{3,6}[\/-]\d{2,4}\b", 15, "", False, ("avvocato", "tribunale", "causa", "processo", "polizia", "carabinieri", "questura", "procura", "avocat", "tribunal", "police", "gendarmerie", "abogado", "juzgado", "adwokat", "sąd", "advocaat", "rechtbank"), ("GDPR Art.10 - Judicial Data", "ePrivacy Directive")),
    Rule("EU", "Employee / Badge ID", r"(?i)(?:matricola|badge|dipendente|studente|employee id|personalnummer|numéro d'employé|número de empleado|nr pracownika|werknemersnummer|código de funcionário|kennung|identyfikator)\s*[:=]?\s*[A-Z0-9\-]{4,12}\b", 9, "", False, ("azienda", "ufficio", "badge", "timbratura", "turno", "hr", "personale", "tesserino", "entreprise", "bureau", "ressources humaines", "empresa", "oficina", "rrhh", "firma", "biuro", "karty", "zmiana", "werkgever", "kantoor"), ("GDPR Art.4(1) - Employment Data", "EU Directive 2019/1152")),
    Rule("IT", "Italian Tax Code (CF)", r"\b[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]\b", 18, "CF_IT", True, ("cf", "codice fiscale", "tessera", "sostituto imposta"), ("GDPR", "Italian D.Lgs 196/2003")),
    Rule("IT", "Italian VAT Number", r"\bIT?\d{11}\b", 16, "PIVA_IT", False, ("piva", "partita", "iva", "vat"), ("GDPR", "Italian Revenue Agency")),
    Rule("DE", "German Tax ID (Steuer-Id)", r"\b\d{11}\b", 19, "STEUER_ID_DE", True, ("steuer-id", "steueridentifikationsnummer", "steuernummer"), ("DSGVO", "BfDI")),
    Rule("DE", "German ID Card", r"(?-i)\b[CFGHJKLMNPRTVWXYZ]\d{8}\b", 14, "IDCARD_DE", False, ("ausweis", "personalausweis", "reisepass", "id-karte"), ("DSGVO",)),
    Rule("FR", "French Social Security (NIR)", r"\b[12]\s?\d{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{2}\b", 19, "NIR_FR", True, ("nir", "ssn", "sécu", "sécurité sociale", "numéro sécurité"), ("RGPD", "CNIL")),
    Rule("FR", "French Business ID (SIREN/SIRET)", r"\b\d{3}\s?\d{3}\s?\d{3}\b|\b\d{3}\s?\d{3}\s?\d{3}\s?00\d{2}\b", 13, "", False, ("siren", "siret", "entreprise", "société"), ("RGPD", "INSEE")),
    Rule("ES", "Spanish Tax/ID Number (NIF/NIE)", r"\b[XYZ]\d{7}[A-Z]\b|\b\d{8}[A-Z]\b", 18, "NIF_ES", True, ("nif", "nie", "dni", "identificación", "cif"), ("RGPD", "AEPD")),
    Rule("PL", "Polish PESEL", r"\b\d{11}\b", 17, "PESEL_PL", True, ("pesel", "dowód", "identyfikacja", "nr osobisty"), ("RODO", "UODO")),
    Rule("PL", "Polish VAT (NIP)", r"\b\d{2}-\d{3}-\d{2}-\d{2}-\d{1}\b|\b\d{10}\b", 15, "", False, ("nip", "vat", "podatek", "firma"), ("RODO",)),
    Rule("NL", "Dutch BSN", r"\b\d{9}\b", 18, "BSN_NL", False, ("bsn", "sofinummer", "identificatienummer", "persoonsnummer"), ("AVG", "AP")),
    Rule("SE", "Swedish Personal ID", r"\b\d{8}-?\d{4}\b", 19, "PERSONNUMMER_SE", False, ("personnummer", "pnr", "identitet", "folkbokföring"), ("GDPR", "IMY")),
    Rule("FI", "Finnish Personal ID (Hetu)", r"\b\d{6}[A\+\-BCDFGHJKLMNPRSTVWXY]\d{3}[0-9A-Z]\b", 20, "HETU_FI", True, ("hetu", "henkilötunnus", "sotu", "identiteetti"), ("GDPR", "Finnish DPO")),
    Rule("DK", "Danish CPR Number", r"\b\d{6}-?\d{4}\b", 19, "CPR_DK", False, ("cpr", "cpr-nummer", "personnummer", "id"), ("GDPR", "Datatilsynet")),
    Rule("AT", "Austrian Social Insurance", r"\b\d{4}\s?\d{5}\b", 17, "", False, ("sv-nummer", "sozialversicherung", "versichertennummer"), ("DSGVO", "DSB")),
    Rule("AT", "Austrian VAT (UID)", r"\bATU\d{8}\b", 15, "", False, ("uid", "steuer-id", "ust-id"), ("DSGVO",)),
    Rule("BE", "Belgian National Registry", r"\b\d{11}\b", 18, "NN_BE", False, ("numéro national", "rijksregisternummer", "nn", "id"), ("GDPR", "APD")),
    Rule("PT", "Portuguese Tax Number (NIF)", r"\b\d{9}\b", 16, "NIF_PT", False, ("nif", "número contribuinte", "fiscal", "contribuinte"), ("RGPD", "CNPD")),
    Rule("IE", "Irish PPSN", r"\b\d{7}[A-W][A-WX]?\b", 19, "PPSN_IE", False, ("ppsn", "pps number", "social insurance", "id"), ("GDPR", "DPC")),
    Rule("GR", "Greek Tax Number (AFM)", r"\b\d{9}\b", 16, "AFM_GR", False, ("afm", "αφμ", "tax", "fiscale"), ("GDPR", "HDPA")),
    Rule("GR", "Greek Social Security (AMKA)", r"\b\d{11}\b", 18, "", False, ("amka", "αμκα", "ασφάλιση", "υγεία"), ("GDPR",)),
    Rule("CZ", "Czech Birth Number", r"\b\d{6}/\d{4}\b", 18, "RC_CZ", False, ("rodné číslo", "rc", "identifikace"), ("GDPR", "ÚOOÚ")),
    Rule("RO", "Romanian Personal Code (CNP)", r"\b[1-8]\d{12}\b", 19, "CNP_RO", False, ("cnp", "cod numeric personal", "identificare"), ("GDPR", "ANSPDCP")),
    Rule("HU", "Hungarian Tax ID", r"\b\d{10}\b", 15, "", False, ("adóazonosító", "taj", "adózás", "azonosító"), ("GDPR", "NAIH")),
    Rule("BG", "Bulgarian EGN", r"\b\d{10}\b", 18, "EGN_BG", False, ("egn", "егн", "идентификация", "граждан"), ("GDPR", "CPDP")),
    Rule("HR", "Croatian OIB", r"\b\d{11}\b", 16, "OIB_HR", False, ("oib", "identifikacijski broj", "porezni broj"), ("GDPR", "AZOP")),
    Rule("SK", "Slovak Birth Number", r"\b\d{6}/\d{4}\b", 18, "", False, ("rodné číslo", "rc", "identifikácia"), ("GDPR", "ÚOOÚ")),
    Rule("SI", "Slovenian EMSO", r"\b\d{13}\b", 18, "EMSO_SI", False, ("emšo", "ems", "matična številka"), ("GDPR", "IP")),
    Rule("LT", "Lithuanian Personal Code", r"\b[1-6]\d{10}\b", 17, "AK_LT", False, ("asmens kodas", "ak", "identifikacija"), ("GDPR", "VDAI")),
    Rule("LV", "Latvian Personal Code", r"\b\d{6}-\d{5}\b|\b\d{11}\b", 17, "PK_LV", False, ("personas kods", "pk", "identifikācija"), ("GDPR", "DVI")),
    Rule("EE", "Estonian Personal ID", r"\b[1-6]\d{10}\b", 17, "IK_EE", False, ("isikukood", "ik", "identifitseerimine"), ("GDPR", "AKI")),
    Rule("CY", "Cypriot ID Number", r"\b[A-Z]\d{6}[A-Z]\b", 16, "", False, ("id number", "identity", "ταυτότητα"), ("GDPR", "CIPD")),
    Rule("MT", "Maltese ID Number", r"\b\d{7}[A-Z0-9]\b", 15, "", False, ("id number", "identity card", "karta tal-identità"), ("GDPR", "IDPC")),
    Rule("LU", "Luxembourg National ID", r"\b\d{13}\b", 16, "", False, ("numero", "identifikation", "numéro d'identification", "matricule"), ("GDPR", "CNPD")),
    Rule("GB", "UK National Insurance Number (NINO)", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]\b", 17, "NINO_GB", False, ("national insurance", "nino", "ni number"), ("UK GDPR", "Data Protection Act 2018")),
    Rule("CH", "Swiss AHV/AVS Number", r"\b756\.\d{4}\.\d{4}\.\d{2}\b", 18, "AHV_CH", False, ("ahv-nummer", "no avs", "sozialversicherungsnummer", "numero avs"), ("FADP", "nLPD")),
    Rule("CN", "Chinese Resident ID Number", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX]\b", 20, "ID_CN", False, ("身份证", "居民身份证", "id number"), ("PIPL",)),
    Rule("RU", "Russian Taxpayer ID (INN)", r"\b\d{12}\b", 17, "INN_RU", False, ("инн", "налогоплательщик", "taxpayer id"), ("152-FZ",)),
    Rule("UA", "Ukrainian Taxpayer Number (RNOKPP)", r"\b\d{10}\b", 17, "RNOKPP_UA", False, ("рнокпп", "ідентифікаційний номер", "taxpayer number"), ("Law of Ukraine No.2297-VI",)),
]


# What a text must hold for a bundled rule to match at all: so many digits in a row, and one of some words (lower-cased).
_RUN = {
    "Phone E.164": 7, "IBAN": 2, "Credit Card": 13, "GPS Coordinates": 1, "Minor Data (<16)": 1, "Legal Case / File Number": 3, "Italian VAT Number": 11, "German Tax ID (Steuer-Id)": 11, "German ID Card": 8,
    "French Social Security (NIR)": 3, "French Business ID (SIREN/SIRET)": 3, "Spanish Tax/ID Number (NIF/NIE)": 7, "Polish PESEL": 11, "Polish VAT (NIP)": 3, "Dutch BSN": 9, "Swedish Personal ID": 8,
    "Finnish Personal ID (Hetu)": 6, "Danish CPR Number": 6, "Austrian Social Insurance": 5, "Austrian VAT (UID)": 8, "Belgian National Registry": 11, "Portuguese Tax Number (NIF)": 9, "Irish PPSN": 7,
    "Greek Tax Number (AFM)": 9, "Greek Social Security (AMKA)": 11, "Czech Birth Number": 6, "Romanian Personal Code (CNP)": 13, "Hungarian Tax ID": 10, "Bulgarian EGN": 10, "Croatian OIB": 11,
    "Slovak Birth Number": 6, "Slovenian EMSO": 13, "Lithuanian Personal Code": 11, "Latvian Personal Code": 6, "Estonian Personal ID": 11, "Cypriot ID Number": 6, "Maltese ID Number": 7,
    "Luxembourg National ID": 13, "UK National Insurance Number (NINO)": 6, "Swiss AHV/AVS Number": 4, "Chinese Resident ID Number": 17, "Russian Taxpayer ID (INN)": 12, "Ukrainian Taxpayer Number (RNOKPP)": 10,
}
_WORDS = {
    "Email": ["@"], "JWT/Token": ["eyj"], "GPS Coordinates": [","], "Password/Secret": ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "bearer"],
    "EU Vehicle License Plate": ["targa", "kennzeichen", "license plate", "placa", "rejestracja", "kenteken", "immatriculation"],
    "PNR / Booking Code": ["pnr", "booking code", "prenotazione", "reservation code", "codice viaggio", "buchungscode", "code de réservation", "código de reserva", "nr rezerwacji", "boekingscode"],
    "Social / Messenger Handle": ["@", "t.me/", "instagram.com/", "x.com/", "tiktok.com/", "discord.gg/", "telegram.me/", "linkedin.com/in/"],
    "Minor Data (<16)": ["minore di", "bambino di", "ragazzo di", "under", "minderj", "mineur de", "menor de", "małoletni poniżej"],
    "Employee / Badge ID": ["matricola", "badge", "dipendente", "studente", "employee id", "personalnummer", "numéro d'employé", "número de empleado", "nr pracownika", "werknemersnummer", "código de funcionário", "kennung", "identyfikator"],
}
_BUNDLED = {r.pattern: (_RUN.get(r.category, 0), tuple(_WORDS.get(r.category, ()))) for r in RULES}
#: Letters that match s and i where case is ignored, but are not lower-cased to them.
FOLDED = {"ſ": "s", "ı": "i", "İ": "i"}


def needs(rule: Rule) -> tuple[int, tuple[str, ...]]:
    """(digits in a row, words) without which a text has no match of the rule; (0, ()) for one that isn't bundled."""
    return _BUNDLED.get(rule.pattern, (0, ()))


def from_table(table: DataFrame) -> list[Rule]:
    """Rules of a table (group, category, pattern, weight, validator, high, keywords, tags); bounded, so the driver holds them."""
    return [Rule(r.group, r.category, r.pattern, int(r.weight), r.validator or "", bool(r.high), tuple(k.lower() for k in r.keywords or ()), tuple(r.tags or ())) for r in table.toLocalIterator()]


def categories(rules: list[Rule] = RULES) -> list[str]:
    return sorted({r.category for r in rules})
