"""Format-preserving pseudonyms of personal data, in SQL functions alone.

Each piece of personal data that validates (check digits, ranges, calendar) is
replaced by another valid piece of the same format. The replacement is a keyed
Feistel permutation of the format's own domain: equal values get equal pseudonyms
in all documents, different values different ones, and who has the key can go
back (``restore``). What cannot be numbered (the local part of an e-mail address,
a secret) gets a keyed digest of the same shape.

A Feistel network needs no power of two: the domain is cut into a pair (a, b) of
residues modulo (ma, mb), and in turn a keyed hash of one is added to the other.
The pseudonym is one step on in the order that the network gives: it is mapped,
one is added, and it is mapped back, so that no value is its own pseudonym. Hashes
are keyed as in HMAC with SHA-256. All work is done in one pass over the texts that hold a digit or an ``@``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import common

#: For tests and for the registered query; production passes a secret of its own.
DEMO_KEY = "demonstration key, replace it"
ROUNDS = 8
#: Dates from 1900-01-01 to 2099-12-31: 73,049 = 319 x 229 days.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229

#: Lengths of account numbers by country, as registered (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:(?<![a-z])(?:token|password|passwd|secret|api_?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_\-]{8,}+)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./\-][0-9])"
# a number of four parts behind a "v" or "version" is a version
IP = r"(?<![0-9.]|[vV]|[Vv]ersion[ :=]|VERSION[ :=])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ \-])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4})(?![0-9])"
KINDS = [("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ssn", SSN), ("date", DATE), ("ip", IP), ("card", CARD), ("phone", PHONE)]


def _text(s: str) -> str:
    """An SQL string literal; raw, so that patterns keep their backslashes."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, *parts: str) -> str:
    """HMAC-SHA-256 of the parts joined by colons, in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (f"X'{bytes(x ^ pad for x in raw).hex()}'" for pad in (0x36, 0x5C))
    return f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast(concat_ws(':', {', '.join(parts)}) as binary)), 256))), 256)"


def _round(key: str, tweak: str, i: str, x: str, m: str) -> str:
    return f"pmod(cast(conv(substr({_digest(key, tweak, i, x)}, 1, 15), 16, 10) as bigint), {m})"


def _network(pair: str, ma: str, mb: str, key: str, tweak: str, back: bool) -> str:
    """A struct (a, b): the pair of residues modulo (ma, mb) through the network, or back."""
    turns, sign = (f"sequence({ROUNDS}, 1, -1)", "-") if back else (f"sequence(1, {ROUNDS})", "+")
    return (
        f"aggregate({turns}, {pair}, (s, i) -> if(i % 2 = 1,"
        f" named_struct('a', pmod(s.a {sign} {_round(key, tweak, 'i', 's.b', ma)}, {ma}), 'b', s.b),"
        f" named_struct('a', s.a, 'b', pmod(s.b {sign} {_round(key, tweak, 'i', 's.a', mb)}, {mb}))))"
    )


def _feistel(a: str, b: str, ma: str, mb: str, key: str, tweak: str, restore: bool) -> str:
    """A struct (a, b): the permuted pair of residues, never the pair itself (unless ma = mb = 1)."""
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    if restore:
        step = f"named_struct('a', pmod(walk.a - if(walk.b = 0, 1, 0), cast({ma} as bigint)), 'b', pmod(walk.b - 1, cast({mb} as bigint)))"
    else:
        step = f"named_struct('a', pmod(walk.a + if(walk.b = {mb} - 1, 1, 0), cast({ma} as bigint)), 'b', pmod(walk.b + 1, cast({mb} as bigint)))"
    return _let(_network(start, ma, mb, key, tweak, False), "walk", _network(step, ma, mb, key, tweak, True))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _power(n: str) -> str:
    return f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"


def _digits(d: str, key: str, tweak: str, restore: bool) -> str:
    """A permuted string of as many digits, up to 34 of them."""
    n = f"length({d})"
    hi = f"({n} div 2)"
    pair = _feistel(f"if({n} < 2, '0', substr({d}, 1, cast({hi} as int)))", f"substr({d}, cast({hi} as int) + 1)", _power(hi), _power(f"({n} - {hi})"), key, f"concat({tweak}, {n})", restore)
    return _let(pair, "p", f"concat(if({n} < 2, '', lpad(cast(p.a as string), cast({hi} as int), '0')), lpad(cast(p.b as string), cast({n} - {hi} as int), '0'))")


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, d: str) -> str:
    """``m`` with its digits replaced, in order, by those of ``d``."""
    return (
        f"aggregate(split({m}, ''), named_struct('k', 1, 'out', ''), (s, c) -> if(c rlike '^[0-9]$',"
        f" named_struct('k', s.k + 1, 'out', concat(s.out, substr({d}, s.k, 1))), named_struct('k', s.k, 'out', concat(s.out, c))), s -> s.out)"
    )


def _luhn(d: str) -> str:
    """The sum of the Luhn check over a string of digits."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + element_at(if(k % 2 = 1, array(0,1,2,3,4,5,6,7,8,9), array(0,2,4,6,8,1,3,5,7,9)),"
        f" 1 + cast(substr({d}, length({d}) + 1 - k, 1) as int)))"
    )


def _mod97(s: str) -> str:
    return (
        f"aggregate(split({s}, ''), 0, (t, c) -> if(c = '', t, if(c rlike '^[0-9]$', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)))"
    )


def _card(m: str, key: str, restore: bool) -> str:
    body = "substr(d, 1, length(d) - 1)"
    check = f"cast(pmod(10 - {_luhn('concat(x, 0)')} % 10, 10) as string)"
    new = _let(_digits(body, key, "'card'", restore), "x", f"concat(x, {check})")
    return _let(_only_digits(m), "d", f"if({_luhn('d')} % 10 = 0, {_let(new, 'y', _refill(m, 'y'))}, {m})")


def _iban(m: str, key: str, restore: bool) -> str:
    plain = f"replace({m}, ' ', '')"
    ok = f"{_mod97('concat(substr(q, 5), substr(q, 1, 4))')} = 1"
    # the account's digits are permuted among themselves, its letters stay
    inner = _only_digits("substr(q, 5)")
    sized = "case substr(q, 1, 2) " + " ".join(f"when '{c}' then length(q) = {n}" for c, n in IBAN_LENGTHS.items()) + " else false end"
    new = _let(_digits(inner, key, "concat('iban', substr(q, 1, 2))", restore), "x", _let(_refill("substr(q, 5)", "x"), "w", f"concat(substr(q, 1, 2), lpad(cast(98 - {_mod97('concat(w, substr(q, 1, 2), 0, 0)')} as string), 2, '0'), w)"))
    spaced = (
        f"aggregate(split({m}, ''), named_struct('k', 1, 'out', ''), (s, c) -> if(c = ' ', named_struct('k', s.k, 'out', concat(s.out, ' ')),"
        f" named_struct('k', s.k + 1, 'out', concat(s.out, substr(y, s.k, 1)))), s -> s.out)"
    )
    return _let(plain, "q", f"if({sized} and {inner} <> '' and {ok}, {_let(new, 'y', spaced)}, {m})")


def _ip(m: str, key: str, restore: bool) -> str:
    parts = f"transform(split({m}, '[.]'), x -> cast(x as int))"
    new = _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "'ip'", restore)
    text = _let(new, "p", "concat_ws('.', p.a div 256, p.a % 256, p.b div 256, p.b % 256)")
    return _let(parts, "o", f"if(forall(o, x -> x <= 255), {text}, {m})")


def _ssn(m: str, key: str, restore: bool) -> str:
    area, group, serial = (f"cast(substr({m}, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    # areas 001 to 899 without 666 are numbered from 0
    a, b = f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1"
    new = _feistel(a, b, "898", "989901", key, "'ssn'", restore)
    text = _let(new, "p", "concat(lpad(cast(p.a + 1 + if(p.a >= 665, 1, 0) as string), 3, '0'), '-', lpad(cast(p.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(p.b % 9999 + 1 as string), 4, '0'))")
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {text}, {m})"


def _date(m: str, key: str, restore: bool) -> str:
    # a date with slashes is month first, and day first only where that alone is valid
    def read(layout):
        return f"cast(try_to_timestamp({m}, '{layout}') as date)"

    layouts = [("____-__-__", "yyyy-MM-dd"), ("__.__.____", "dd.MM.yyyy"), ("__/__/____", "MM/dd/yyyy"), ("__/__/____", "dd/MM/yyyy")]
    found = "coalesce(" + ", ".join(f"if({m} like '{like}' and {read(layout)} is not null, named_struct('d', {read(layout)}, 'f', '{layout}'), null)" for like, layout in layouts) + ")"
    day = f"datediff(x.d, date'{FIRST_DAY}')"
    new = _feistel(f"{day} div {DAYS_B}", f"{day} % {DAYS_B}", str(DAYS_A), str(DAYS_B), key, "'date'", restore)
    shown = f"date_add(date'{FIRST_DAY}', cast(p.a * {DAYS_B} + p.b as int))"
    # the layout is written out, as date_format wants a constant
    text = "case x.f " + " ".join(f"when '{layout}' then date_format({shown}, '{layout}')" for _, layout in layouts) + " end"
    return _let(found, "x", f"if(x is not null and {day} between 0 and {DAYS_A * DAYS_B - 1}, {_let(new, 'p', text)}, {m})")


def _phone(m: str, key: str, restore: bool) -> str:
    # the country code stays: the first digit of +1 and +7, else the first two after a plus
    keep = f"if({m} like '+%', if(substr({m}, 2, 1) in ('1', '7'), 1, 2), if({m} rlike '^1[ .-]', 1, 0))"
    d = _only_digits(m)
    new = _let(f"named_struct('d', {d}, 'k', {keep})", "v", f"concat(substr(v.d, 1, v.k), {_digits('substr(v.d, v.k + 1)', key, _text('phone'), restore)})")
    return f"if(length({d}) between 8 and 15, {_let(new, 'y', _refill(m, 'y'))}, {m})"


def _email(m: str, key: str) -> str:
    return f"concat('u', substr({_digest(key, _text('email'), f'lower({m})')}, 1, 16), '@example.invalid')"


def _secret(m: str, key: str) -> str:
    tail = f"regexp_extract({m}, '([A-Za-z0-9_-]+)$', 1)"
    long_ = f"substr(repeat({_digest(key, _text('secret'), 'z')}, cast(ceil(length(z) / 64) as int)), 1, length(z))"
    other = _let(tail, "z", f"concat(substr({m}, 1, length({m}) - length(z)), {long_})")
    return f"if({m} rlike '^AKIA[A-Z0-9]{{16}}$', concat('AKIA', upper(substr({_digest(key, _text('secret'), m)}, 1, 16))), {other})"


def _kind(m: str) -> str:
    return "case " + " ".join(f"when {m} rlike {_text('^(?:' + p + ')$')} then '{k}'" for k, p in KINDS) + " end"


def _replaced(m: str, kind: str, key: str, restore: bool) -> str:
    one_way = {"email": _email, "secret": _secret}
    both = {"iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card, "phone": _phone}
    cases = [f"when '{k}' then {m if restore else f(m, key)}" for k, f in one_way.items()] + [f"when '{k}' then {f(m, key, restore)}" for k, f in both.items()]
    return f"case {kind} {' '.join(cases)} end"


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, text: str = "text", restore: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the column pii_counts.

    pii_counts is a map from kind to the number of pieces replaced (empty: none).
    Pieces that don't validate stay and are not counted. A null text stays null, an
    empty one empty; texts, secrets and addresses of any length are taken whole, and
    an empty table gives an empty result. ``restore`` turns the pseudonyms of numbers and dates back;
    those of e-mail addresses and secrets stay. A column named pii_counts is
    replaced, all others pass through, repeated rows give equal rows.
    """
    pattern = _text("|".join(f"(?:{p})" for _, p in KINDS))
    source = common.quoted(text)
    found = f"transform(regexp_extract_all({source}, {pattern}, 0), m -> {_let(_kind('m'), 'k', _let(_replaced('m', 'k', key, restore), 'r', 'named_struct(' + _text('k') + ', if(r <> m, k, null), ' + _text('r') + ', r)'))})"
    some = f"{source} rlike '[0-9@]|AKIA|(?i:token|passw|secret|api_?key)'"
    (hit,) = common.free(docs, "hits")
    hits = docs.select("*", F.expr(f"case when {some} then {found} end").alias(hit))
    gaps = f"split({source}, {pattern}, -1)"
    joined = f"array_join(zip_with({gaps}, {hit}.r, (g, r) -> concat(g, coalesce(r, ''))), '')"
    new = F.expr(f"case when size({hit}) > 0 then {joined} else {source} end")
    kinds = f"filter({hit}.k, x -> x is not null)"
    counts = f"map_from_entries(transform(array_sort(array_distinct({kinds})), x -> struct(x, size(filter({kinds}, y -> y = x)))))"
    counts = F.expr(f"coalesce(case when size({kinds}) > 0 then {counts} end, cast(map() as map<string,int>))")
    return hits.select(*((new.alias(c) if c == text else F.col(common.quoted(c))) for c in docs.columns if c.lower() != "pii_counts"), counts.alias("pii_counts"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms."""
    out = pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.to_json("pii_counts").alias("pii_counts"), "text")
