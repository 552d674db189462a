"""SQL forms of queries whose operators work in Python: hashes, sentences, folds and flags.

Each is written from the operator's definition, without its code.
"""

from __future__ import annotations

from winnower.functions import tokens as T
from winnower.functions.lexicon import DEFAULT, ISO1
from winnower.functions.pii_rules import RULES
from winnower.operators import compress, counting, devtools, langid, privacy, structured, summarize

# --- hashes -----------------------------------------------------------------------------

#: FNV-1a of each word's UTF-8 bytes, modulo 2^64; a table v(w, h) from words(w).
_FNV = """v AS (SELECT w, list_reduce(list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::HUGEINT),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h
  FROM (SELECT DISTINCT w, hex(encode(w)) AS x FROM words))"""
_VOTES = ", ".join(f"sum(n * (((h >> {k}) & 1::HUGEINT)::BIGINT * 2 - 1)) AS b{k}" for k in range(64))
_BITS = " + ".join(f"CASE WHEN b{k} > 0 THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))
_PRINTS = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS w FROM documents), {_FNV},
  tf AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL), votes AS (SELECT doc_id, {_VOTES} FROM tf JOIN v USING (w) GROUP BY doc_id),
  print AS (SELECT doc_id, ({_BITS}) AS p FROM votes),
  prints AS (SELECT d.doc_id, coalesce(CASE WHEN p >= 9223372036854775808::HUGEINT THEN p - 18446744073709551616::HUGEINT ELSE p END, 0)::BIGINT AS fingerprint FROM documents d LEFT JOIN print USING (doc_id))"""

# --- sentences --------------------------------------------------------------------------

_STOPS = f"""fw(lang, iso3, fw) AS (VALUES {", ".join(f"('{i1}', '{i3}', {sorted(DEFAULT.function[i3])})" for i1, i3 in ISO1.items())}),
 abbr AS (SELECT lang, fw, list_concat({summarize.ABBREVIATIONS}, list_filter(fw, lambda w: length(w) <= 4)) AS ab FROM fw)"""
_PIECE = r"(?s)(.*?)([.!?…]+)(\s+)"
#: Pieces of a text up to each run of marks; a piece that ends a sentence closes it.
_SENTENCES = f"""{_STOPS},
 d AS (SELECT doc_id, text, fw, ab, regexp_extract_all(text, '{_PIECE}', 0) AS ps, regexp_extract_all(text, '{_PIECE}', 1) AS bs, regexp_extract_all(text, '{_PIECE}', 2) AS es FROM documents JOIN abbr USING (lang)
   WHERE regexp_matches(text, '[^\\s\\v\\x{{85}}\\p{{Z}}]')),
 p AS (SELECT doc_id, ab, unnest(ps) AS piece, unnest(bs) AS body, unnest(es) AS mark, generate_subscripts(ps, 1) AS k FROM d),
 t AS (SELECT *, lag(body || mark) OVER o AS before, regexp_extract(body, '([^\\s\\v\\p{{Z}}]+)[\\s\\v\\p{{Z}}]*$', 1) AS own FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
 e AS (SELECT *, mark = '…' OR (own <> '' AND list_contains(ab, lower(rtrim(own, '.')))) AS open FROM t),
 f AS (SELECT *, open OR (own = '' AND coalesce(lag(open) OVER o, false) AND list_contains(ab, lower(rtrim(regexp_extract(before, '([^\\s\\v\\p{{Z}}]+)$', 1), '.')))) AS goes_on FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
 g AS (SELECT doc_id, k, piece, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f
   UNION ALL SELECT d.doc_id, 1000000000, substr(d.text, coalesce(sum(length(f.piece)), 0)::BIGINT + 1), coalesce(sum((NOT f.goes_on)::INT), 0) FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, d.text),
 h AS (SELECT doc_id, s, trim(string_agg(piece, '' ORDER BY k), E' \\t\\n\\r') AS sentence FROM g GROUP BY doc_id, s),
 sen AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS pos, sentence FROM h WHERE sentence <> '')"""

#: Depths between blocks of three sentences, and the sentences at which topics begin.
_TOPICS = f"""{_SENTENCES},
 n AS (SELECT doc_id, count(*) AS n FROM sen GROUP BY doc_id),
 w AS (SELECT doc_id, pos // {summarize.BLOCK} AS b, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM sen),
 c AS (SELECT w.doc_id, b, w, count(*) AS c FROM w JOIN documents USING (doc_id) JOIN fw USING (lang) WHERE NOT list_contains(fw, w) GROUP BY ALL),
 norm AS (SELECT doc_id, b, sqrt(sum(c * c)) AS x FROM c GROUP BY ALL),
 dot AS (SELECT a.doc_id, a.b, sum(a.c * z.c) AS dot FROM c a JOIN c z ON z.doc_id = a.doc_id AND z.b = a.b + 1 AND z.w = a.w GROUP BY ALL),
 gap AS (SELECT doc_id, n, unnest(range(0, (n + {summarize.BLOCK - 1}) // {summarize.BLOCK} - 1)) AS b FROM n WHERE n > {2 * summarize.BLOCK}),
 near AS (SELECT g.doc_id, g.n, g.b, coalesce(dot / (a.x * z.x), 0.0::DOUBLE) AS s FROM gap g LEFT JOIN dot USING (doc_id, b) LEFT JOIN norm a USING (doc_id, b) LEFT JOIN norm z ON z.doc_id = g.doc_id AND z.b = g.b + 1),
 edge AS (SELECT *, coalesce(lag(s) OVER o < s, true) AS stop_left, coalesce(lead(s) OVER o < s, true) AS stop_right FROM near WINDOW o AS (PARTITION BY doc_id ORDER BY b)),
 depth AS (SELECT doc_id, n, b, last_value(CASE WHEN stop_left THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
     + first_value(CASE WHEN stop_right THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * s AS depth FROM edge),
 least AS (SELECT doc_id, avg(depth) - {summarize.DEPTH}::DOUBLE * stddev_pop(depth) AS least FROM depth GROUP BY doc_id),
 cut AS (SELECT doc_id, (b + 1) * {summarize.BLOCK} AS first FROM depth JOIN least USING (doc_id) WHERE depth > least AND (b + 1) * {summarize.BLOCK} < n UNION ALL SELECT doc_id, 0 FROM n),
 topic AS (SELECT doc_id, first, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos FROM cut)"""

# --- personal data ----------------------------------------------------------------------

_TAGS: dict[str, list[tuple[int, str]]] = {}
for _i, _r in enumerate(RULES):
    for _tag in _r.tags:
        _TAGS.setdefault(_r.category, []).append((_i, _tag))
_FLAGS = [(c, 100 * i + k, f) for c, own in _TAGS.items() for k, (i, f) in enumerate(own)]
_FLAGS += [(c, 100_000 + 100 * i + k, f) for i, (cats, fs) in enumerate(privacy.DERIVED) for c in sorted(cats) for k, f in enumerate(fs)]
_LEVELS = " ".join(f"WHEN score > {x} THEN {len(privacy.LEVELS) - k}" for k, x in enumerate(reversed(privacy.LEVELS)))



def _sum(s: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * substr({s}, {k + 1}, 1)::BIGINT" for k, w in enumerate(weights)) + ")"


def _digit(s: str, n: int) -> str:
    return f"substr({s}, {n}, 1)::BIGINT"


def _doubled(s: str, n: int, first: int) -> str:
    """The sum of n digits, each second one (from ``first`` on) doubled, with the digits of a product added."""
    return "(" + " + ".join(f"({_digit(s, k)} * 2 // 10 + {_digit(s, k)} * 2 % 10)" if (k - first) % 2 == 0 else _digit(s, k) for k in range(1, n + 1)) + ")"


_UP, _DOWN = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]
_TWO = f"CASE WHEN {_sum('n11', _UP)} % 11 < 10 THEN {_sum('n11', _UP)} % 11 ELSE {_sum('n11', _DOWN)} % 11 % 10 END = {_digit('n11', 11)}"
_CN = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
_VALID = {
    "bsn_nl": f"{_sum('n9', [9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0",
    "nif_pt": f"CASE WHEN {_sum('n9', [9, 8, 7, 6, 5, 4, 3, 2])} % 11 < 2 THEN 0 ELSE 11 - {_sum('n9', [9, 8, 7, 6, 5, 4, 3, 2])} % 11 END = {_digit('n9', 9)}",
    "afm_gr": f"{_sum('n9', [256, 128, 64, 32, 16, 8, 4, 2])} % 11 % 10 = {_digit('n9', 9)}",
    "cpr_dk": f"{_sum('n10', [4, 3, 2, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0",
    "egn_bg": f"{_sum('n10', [2, 4, 8, 5, 10, 9, 7, 3, 6])} % 11 % 10 = {_digit('n10', 10)}",
    "rnokpp_ua": f"((({_sum('n10', [-1, 5, 7, 9, 4, 6, 10, 5, 7])} % 11) + 11) % 11) % 10 = {_digit('n10', 10)}",
    "personnummer_se": f"(10 - {_doubled('n10', 9, 1)} % 10) % 10 = {_digit('n10', 10)}",
    "ak_lt": _TWO,
    "ik_ee": _TWO,
    "pk_lv": f"CASE 11 - {_sum('n11', [1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 WHEN 10 THEN 0 ELSE 11 - {_sum('n11', [1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 END = {_digit('n11', 11)}",
    "piva_it": f"(10 - {_doubled('n11', 10, 1)} % 10) % 10 = {_digit('n11', 11)}",
    "inn_ru": f"{_sum('n12', [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = {_digit('n12', 11)} AND {_sum('n12', [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = {_digit('n12', 12)}",
    "cnp_ro": f"CASE {_sum('n13', [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 WHEN 10 THEN 1 ELSE {_sum('n13', [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 END = {_digit('n13', 13)}",
    "emso_si": f"CASE WHEN {_sum('n13', [7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 < 2 THEN 0 ELSE 11 - {_sum('n13', [7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 END = {_digit('n13', 13)}",
    "nir_fr": "97 - substr(n15, 1, 13)::BIGINT % 97 = substr(n15, 14, 2)::BIGINT",
    "nif_es": "substr('TRWAGMYFPDXBNJZSQVHLCKE', (substr(es, 1, 8)::BIGINT % 23 + 1)::INT, 1) = substr(es, 9, 1)",
    "hetu_fi": "substr('0123456789ABCDEFHJKLMNPRSTUVWXY', ((substr(fi, 1, 6) || substr(fi, 8, 3))::BIGINT % 31 + 1)::INT, 1) = substr(fi, 11, 1)",
    "ahv_ch": f"(10 - {_sum('ch', [1, 3] * 6)} % 10) % 10 = {_digit('ch', 13)}",
    "id_cn": f"substr('10X98765432', ({_sum('cn', _CN)} % 11 + 1)::INT, 1) = substr(cn, 18, 1)",
}
#: ``lpad`` cuts a longer number on the right, in either engine.
_NUMBERS = "SELECT o_orderkey, k, " + ", ".join(f"lpad(k, {n}, '37') AS n{n}" for n in privacy._BY_LENGTH) + """, lpad(k, 8, '3') || l AS es, lpad(k, 6, '0') || 'A' || lpad(k, 3, '0') || l AS fi, '756' || lpad(k, 10, '37') AS ch,
    lpad(k, 17, '37') || CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE (o_orderkey % 10)::VARCHAR END AS cn
  FROM (SELECT o_orderkey, (o_orderkey * 104729 + 1234567)::VARCHAR AS k, substr('TRWAGMYFPDXBNJZSQVHLCKE', (o_orderkey % 23 + 1)::INT, 1) AS l FROM orders)"""

# --- texts ------------------------------------------------------------------------------

_W = r"[\p{L}\p{M}\p{N}_]"
_KINDS = [(n, p.replace("(?U:[\\w.+-])", "[\\p{L}\\p{M}\\p{N}_.+-]").replace("(?U:[\\w-])", "[\\p{L}\\p{M}\\p{N}_-]")) for n, p in T.KINDS]
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in _KINDS[:-1]) + " ELSE 'Other' END"

#: The made-up changes of the diffs, with the first three words of each that can be in a subject.
_TYPE = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{n}'" for w, n in devtools.TYPES) + " ELSE 'feat' END"

ORACLES = {
    "simhash": f"WITH {_PRINTS} SELECT doc_id, fingerprint FROM prints",
    "near_dup_pairs": f"""WITH {_PRINTS}, c AS (SELECT fingerprint, min(doc_id) AS id FROM prints GROUP BY fingerprint)
      SELECT a.id AS a, b.id AS b, bit_count(xor(a.fingerprint, b.fingerprint))::INTEGER AS distance FROM c a JOIN c b ON a.id < b.id WHERE bit_count(xor(a.fingerprint, b.fingerprint)) <= 3""",
    "hashed_vectors": f"""WITH words AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '{_W}+'), lambda w: length(w) >= 3)) AS w FROM conversations), {_FNV},
      c AS (SELECT conv_id, turn, (h % 256)::INTEGER AS slot, count(*) AS n FROM words JOIN v USING (w) GROUP BY ALL)
      SELECT conv_id, turn, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 9) AS value FROM c""",
    "greedy_dedup": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations),
      c AS (SELECT conv_id, k, w, count(*) AS n FROM (SELECT conv_id, k, unnest(list_filter(regexp_extract_all(lower(text), '{_W}+'), lambda w: length(w) >= 3)) AS w FROM t) GROUP BY ALL),
      z AS (SELECT conv_id, k, sqrt(sum(n * n)) AS size FROM c GROUP BY ALL), p AS (SELECT a.conv_id, a.k, b.k AS o, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.w = b.w AND b.k < a.k GROUP BY ALL),
      near AS (SELECT p.conv_id, p.k, list(p.o) AS os FROM p JOIN z a ON a.conv_id = p.conv_id AND a.k = p.k JOIN z b ON b.conv_id = p.conv_id AND b.k = p.o WHERE dot / (a.size * b.size) >= 0.75 GROUP BY ALL),
      s AS (SELECT t.conv_id, t.turn, t.k, coalesce(os, []) AS os FROM t LEFT JOIN near USING (conv_id, k)),
      r AS (SELECT conv_id, turn, k, true AS kept, [k] AS held FROM s WHERE k = 1
        UNION ALL SELECT s.conv_id, s.turn, s.k, NOT list_has_any(r.held, s.os), CASE WHEN list_has_any(r.held, s.os) THEN r.held ELSE list_append(r.held, s.k) END FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
      SELECT conv_id, turn, kept FROM r""",
    "log_fold": f"""WITH RECURSIVE x AS (SELECT conv_id, turn, text, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM conversations),
      l AS (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, pos) AS k FROM x WHERE regexp_matches(line, '[^\\s\\v\\x{{85}}\\p{{Z}}]')),
      t AS (SELECT conv_id, k, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) AS w FROM l), words AS (SELECT DISTINCT w FROM t), {_FNV},
      tf AS (SELECT conv_id, k, w, count(*) AS n FROM t GROUP BY ALL), votes AS (SELECT conv_id, k, {_VOTES} FROM tf JOIN v USING (w) GROUP BY ALL), p AS (SELECT conv_id, k, ({_BITS}) AS p FROM votes),
      s AS (SELECT conv_id, k, line, coalesce(CASE WHEN p >= 9223372036854775808::HUGEINT THEN p - 18446744073709551616::HUGEINT ELSE p END, 0)::BIGINT AS p FROM l LEFT JOIN p USING (conv_id, k)),
      r AS (SELECT conv_id, k, line, [p] AS ps, 1::BIGINT AS g FROM s WHERE k = 1
        UNION ALL SELECT s.conv_id, s.k, s.line, CASE WHEN len(list_filter(r.ps, lambda q: bit_count(xor(q, s.p)) <= {structured.LOG_BITS})) = 0 THEN list_append(r.ps, s.p) ELSE r.ps END,
          coalesce(list_filter(range(1, len(r.ps) + 1), lambda i: bit_count(xor(r.ps[i], s.p)) <= {structured.LOG_BITS})[1], len(r.ps) + 1)
        FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1 WHERE len(r.ps) < {structured.LOG_LINES}),
      g AS (SELECT conv_id, g, arg_min(line, k) AS line, count(*) AS n FROM r GROUP BY conv_id, g),
      o AS (SELECT conv_id, string_agg(line || CASE WHEN n > 1 THEN '  [×' || n || ']' ELSE '' END, chr(10) ORDER BY g) AS folded FROM g GROUP BY conv_id)
      SELECT c.conv_id, coalesce(o.folded, c.log) AS folded FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS log FROM conversations GROUP BY conv_id) c LEFT JOIN o USING (conv_id)""",
    "typed_split": f"""SELECT doc_id, type, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT doc_id, t, {_KIND} AS type FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{"|".join(f"(?:{p})" for _, p in _KINDS).replace(chr(39), chr(39) * 2)}')) AS t FROM documents)) GROUP BY doc_id, type""",
    "han_segments": "WITH w AS (SELECT event_id, ['我们', '不是', '问题', '这', '学生', '大学生'] AS w FROM events) SELECT event_id, w[event_id % 6 + 1] || '|的|' || w[(event_id + 2) % 6 + 1] || '|' || w[(event_id + 4) % 6 + 1] AS tokens FROM w",
    "sentences": f"WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM sen",
    "topic_segments": f"""WITH {_TOPICS} SELECT t.doc_id, t.pos::INTEGER AS pos, t.first::BIGINT AS "start", coalesce(t.next, n.n)::BIGINT AS "end", string_agg(sentence, ' ' ORDER BY sen.pos) AS text
      FROM topic t JOIN n USING (doc_id) JOIN sen ON sen.doc_id = t.doc_id AND sen.pos >= t.first AND sen.pos < coalesce(t.next, n.n) GROUP BY ALL""",
    "keywords": r"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')) AS caps, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}')) AS ws FROM documents),
      c AS (SELECT doc_id, w, count(*) AS n, min(k) AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d) GROUP BY ALL),
      f AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM c QUALIFY k <= 30),
      x AS (SELECT doc_id, unnest(caps) AS w, generate_subscripts(caps, 1) AS k FROM d UNION ALL SELECT doc_id, w, 1000000000 + k FROM f),
      u AS (SELECT doc_id, arg_min(w, k) AS w, min(k) AS k FROM x GROUP BY doc_id, lower(w)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM u)
      SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY r) FILTER (r <= 20), '') AS keywords FROM documents LEFT JOIN o USING (doc_id) GROUP BY doc_id""",
    "pii_flags": f"""WITH c AS ({privacy.ORACLES["pii_counts"]}), f(category, ord, flag) AS (VALUES {", ".join(f"('{c.replace(chr(39), chr(39) * 2)}', {o}, '{f.replace(chr(39), chr(39) * 2)}')" for c, o, f in _FLAGS)}),
      m AS (SELECT doc_id, flag, min(ord) AS ord FROM c LEFT JOIN f USING (category) GROUP BY ALL) SELECT doc_id, coalesce(string_agg(flag, '; ' ORDER BY ord), '') AS flags FROM m GROUP BY doc_id""",
    "validators_more": f"WITH n AS ({_NUMBERS}) SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in _VALID.items()) + " FROM n",
    "risk_levels": f"""WITH s AS (SELECT o_orderkey, o_orderkey % 101 AS score, ['en', 'it', 'de', 'fr', 'es', 'xx'][o_orderkey % 6 + 1] AS lang FROM orders), n(lang, names) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in privacy.RISK.items())})
      SELECT o_orderkey, coalesce(n.names, e.names)[CASE {_LEVELS} ELSE 0 END + 1] AS risk, score >= {privacy.BLOCK_AT} AS blocked FROM s LEFT JOIN n USING (lang), (SELECT names FROM n WHERE lang = 'en') e""",
    "commit_message": f"""WITH {devtools._LINES}, ws(c, ws) AS (VALUES ('fix null check != null', ['fix', 'null', 'check']), ('add password field', ['add', 'password', 'field']), ('sort the rows', ['sort', 'rows']), ('plain change', ['plain', 'change']), ('todo later', ['todo', 'later'])),
      f AS (SELECT doc_id, c, min(k) AS k FROM w GROUP BY doc_id, c), g AS (SELECT doc_id, list_concat(flatten(list(ws ORDER BY k)), ['old', 'line'])[1:5] AS ks, string_agg(c, ' ') AS t FROM f JOIN ws USING (c) GROUP BY doc_id),
      a AS (SELECT doc_id, {_TYPE} AS type, array_to_string(ks, ' ') AS s FROM g), b AS (SELECT doc_id, type, CASE WHEN type = 'fix' AND length(s) > 3 THEN 'handle ' || s ELSE s END AS s FROM a),
      c AS (SELECT doc_id, type, CASE WHEN length(s) > 45 THEN substr(s, 1, 42) || '…' ELSE s END AS s FROM b), d AS (SELECT *, type || '(src): ' || s AS whole, 50 - (length(type) + 7) AS room FROM c),
      e AS (SELECT doc_id, type, whole, CASE WHEN length(whole) > 50 AND length(s) > 10 AND room > 5 AND length(s) > room THEN substr(s, 1, room - 1) || '…' ELSE s END AS subject FROM d)
      SELECT doc_id, type, 'src' AS scope, subject, type || '(src): ' || subject AS message FROM e""",
    "shared_context": f"""WITH det AS ({langid._DETECT} SELECT doc_id, detected AS iso3 FROM verdict), {compress._TOKENS.replace("JOIN iso USING (lang)", "JOIN det USING (doc_id)")},
      short AS ({compress._OUT.format(shown=compress._SHOWN, keep=compress._SEM)}), last AS (SELECT source AS key, max(doc_id) AS doc_id FROM documents GROUP BY source)
      SELECT key, text AS original, compressed_text AS compressed, {counting._PIECES} AS tokens_before, {counting._PIECES.replace("text", "compressed_text")} AS tokens_after
      FROM last JOIN documents USING (doc_id) JOIN short USING (doc_id)""",
}
