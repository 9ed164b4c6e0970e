"""Format-preserving pseudonyms for personal numbers and dates.

Found values are validated (Luhn digit, real date, octets, dialling format) and
permuted inside their format by a keyed Feistel network over mixed radices: the
two halves live in Z_a and Z_b and each round adds a keyed hash of one half to
the other, so every round is a permutation of the format and no value ever
leaves it. Equal values get equal pseudonyms in every document, and the key
holder can invert them. Mailbox names go through the same network, letter by
letter and digit by digit.

All of it is SQL expressions inside one row: one pass of one pattern, no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 10
KEY = "tessera-demo-key"

#: Fixed patterns of the formats, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iso_date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])",
    "dotted_date": r"(?<![\d.])\d\d\.\d\d\.(?:19|20)\d\d(?!\d)",
    "slashed_date": r"(?<![\d/])\d\d/\d\d/(?:19|20)\d\d(?![\d/])",
    "phone": r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d(-])\(?\d{3}\)?[ -]\d{3}-\d{4}(?![\d-])|\+\d{9,15}(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
}
#: A whole run of digit groups, up to one with which another format starts; ``_cards`` looks for the cards in it.
PATTERNS["card"] = r"(?<![\d-])(?=\d(?:[ -]?\d){12})\d(?:(?:[ -](?!" + "|".join(PATTERNS.values()) + r"))?\d){12,}+-?"
#: Usual groupings of a card's digits, besides a single group.
GROUPINGS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
#: Turns of the walk in ``_cards`` at most; a run whose walk hasn't ended by then stays as it is.
WALK = 64
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297.
DAY_RADICES = (17, 4297)


def _q(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, salt: str, i: str, half: str) -> str:
    """60 keyed bits of the round number and one half; ``key``: the column that holds the key."""
    return f"CAST(conv(substr(sha2(concat({key}, '/{salt}/', {i}, '/', {half}, '/', {key}), 256), 1, 15), 16, 10) AS BIGINT)"


def _feistel(left: str, right: str, a: str, b: str, key: str, salt: str, inverse: bool) -> str:
    """SQL of struct(l, r): ``left`` of Z_a and ``right`` of Z_b permuted together."""
    order = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    sign = "-" if inverse else "+"
    one = f"named_struct('l', pmod(s.l {sign} {_hash(key, salt, 'i', 's.r')}, {a}), 'r', s.r)"
    two = f"named_struct('l', s.l, 'r', pmod(s.r {sign} {_hash(key, salt, 'i', 's.l')}, {b}))"
    return f"aggregate({order}, named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> IF(i % 2 = 0, {one}, {two}))"


def _digits(d: str, key: str, salt: str, inverse: bool) -> str:
    """SQL of the decimal string ``d`` (2 to 36 digits) permuted among those of its length."""
    u = f"CAST(length({d}) DIV 2 AS INT)"
    power = lambda n: f"CAST(concat('1', repeat('0', {n})) AS BIGINT)"
    f = _feistel(f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", power(u), power(f"length({d}) - {u}"), key, salt, inverse)
    return let("f", f, f"concat(lpad(CAST(f.l AS STRING), {u}, '0'), lpad(CAST(f.r AS STRING), length({d}) - {u}, '0'))")


def _luhn_sum(d: str, shift: int) -> str:
    """Luhn sum of ``d``; shift 1 if a check digit will be appended."""
    v = f"CAST(c AS INT) * (1 + ((i + {shift}) % 2))"
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> {v} - IF({v} > 9, 9, 0)), 0, (x, y) -> x + y)"


def _refill(m: str, d: str) -> str:
    """The value ``m`` with its digits replaced, in order, by those of ``d``."""
    at = f"length(regexp_replace(substr({m}, 1, j), '[^0-9]', '')) + 1"
    return f"array_join(transform(split({m}, ''), (z, j) -> IF(z BETWEEN '0' AND '9', substr({d}, {at}, 1), z)), '')"


def _cards(m: str, key: str, inverse: bool) -> str:
    """SQL of the run ``m`` with the cards in it permuted, null if there is none.

    A card is 13 to 19 digits of whole groups with a right Luhn digit, not
    followed by a bare dash. Single groups and the usual groupings go first,
    from left to right; then spans whose groups have 3 digits or more, and the
    longest from the run's start, each the longest first. None overlaps an
    earlier one. What is chosen must be chosen again in the result for the
    inverse to find it, so the permutation is repeated until it is.
    A card that overlaps another candidate may so get another pseudonym than alone.
    """
    usual = " OR ".join(f"sl = array({', '.join(map(str, x))})" for x in GROUPINGS)
    first = "ci = 0 AND (get(ln, ck) IS NULL OR aggregate(sl, 0, (x, y) -> x + y) + get(ln, ck) > 19)"
    tier = f"CASE WHEN exists(sl, v -> v = 0) OR coalesce(get(ln, ci + ck), 1) = 0 OR NOT aggregate(sl, 0, (x, y) -> x + y) BETWEEN 13 AND 19 THEN 2 WHEN ck = 1 OR {usual} THEN 0 WHEN forall(sl, v -> v >= 3) OR ({first}) THEN 1 ELSE 2 END"
    one = let("sl", "slice(ln, ci + 1, ck)", f"named_struct('tier', {tier}, 'i', ci, 'less', -ck)")
    spans = f"array_sort(filter(flatten(transform(sequence(0, size(ln) - 1), ci -> transform(sequence(1, least(size(ln) - ci, 19)), ck -> {one}))), v -> v.tier < 2))"
    digits = lambda groups, c: f"array_join(slice({groups}, {c}.i + 1, -{c}.less), '')"

    def chosen(groups: str) -> str:
        taken = "exists(acc, o -> o.i < sp.i - sp.less AND sp.i < o.i - o.less)"
        right = let("d", digits(groups, "sp"), f"{_luhn_sum('d', 0)} % 10 = 0")
        return f"aggregate(cand, filter(cand, v -> false), (acc, sp) -> IF({taken}, acc, IF({right}, concat(acc, array(sp)), acc)))"

    new = let("d", digits("gr", "sp"), let("p", _digits("substr(d, 1, length(d) - 1)", key, "card", inverse), f"concat(p, CAST(pmod(-({_luhn_sum('p', 1)}), 10) AS STRING))"))
    before = "aggregate(slice(ln, sp.i + 1, greatest(gj - sp.i, 0)), 0, (x, y) -> x + y)"
    put = let("nw", new, f"transform(gr, (gv, gj) -> IF(gj >= sp.i AND gj < sp.i - sp.less, substr(nw, {before} + 1, get(ln, gj)), gv))")
    turned = f"aggregate(ch, st.gs, (gr, sp) -> {put})"
    step = let("tu", turned, f"named_struct('gs', tu, 'done', {chosen('tu')} = ch)")
    walked = f"aggregate(sequence(1, {WALK}), named_struct('gs', g0, 'done', false), (st, wn) -> IF(st.done, st, {step}))"
    seps = let("sep", f"regexp_extract_all({m}, '[ -]', 0)", "array_join(transform(w.gs, (gv, gj) -> concat(gv, coalesce(get(sep, gj), ''))), '')")
    body = let("cand", spans, let("ch", chosen("g0"), f"IF(size(ch) = 0, NULL, {let('w', walked, f'IF(w.done, {seps}, NULL)')})"))
    return let("g0", f"split({m}, '[ -]', -1)", let("ln", "transform(g0, v -> length(v))", body))


def _mailbox(m: str, key: str, inverse: bool) -> str:
    """``m`` with letters and digits of its mailbox name permuted, class by class."""
    kinds = (("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("0123456789", 10))

    def shifted(half: str, other: str) -> str:
        h = _hash(key, "mail", "concat(i, '.', j)", other)
        h = f"-({h})" if inverse else h
        cases = " ".join(f"WHEN instr('{abc}', c) > 0 THEN substr('{abc}', CAST(pmod(instr('{abc}', c) - 1 + {h}, {n}) AS INT) + 1, 1)" for abc, n in kinds)
        return f"IF({half} = '', '', array_join(transform(split({half}, ''), (c, j) -> CASE {cases} ELSE c END), ''))"

    order = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    name = f"substring_index({m}, '@', 1)"
    start = f"named_struct('l', substr(n, 1, CAST(length(n) DIV 2 AS INT)), 'r', substr(n, CAST(length(n) DIV 2 AS INT) + 1))"
    turn = f"(s, i) -> IF(i % 2 = 0, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')}))"
    return let("n", name, let("f", f"aggregate({order}, {start}, {turn})", f"concat(f.l, f.r, substr({m}, length(n) + 1))"))


def _date(m: str, iso: str, layout: str, key: str, inverse: bool) -> str:
    """``m`` as another date, null unless it is a real one from 1900 to 2099."""
    a, b = DAY_RADICES
    day = let("d", f"datediff(try_cast({iso} AS DATE), DATE'1900-01-01')", f"IF(d IS NULL, NULL, {_feistel(f'd DIV {b}', f'd % {b}', str(a), str(b), key, 'date', inverse)})")
    return let("f", day, f"IF(f IS NULL, NULL, date_format(date_add(DATE'1900-01-01', CAST(f.l * {b} + f.r AS INT)), '{layout}'))")


def _pseudonym(m: str, key: str, inverse: bool) -> str:
    """SQL of the pseudonym of the found value ``m``; null if it isn't valid."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    full = lambda kind: f"{m} RLIKE {_q('^(?:' + PATTERNS[kind] + ')$')}"
    card = _cards(m, key, inverse)
    # the country code in front of the last ten digits stays
    phone = let("d", d, let("p", _digits("IF(length(d) > 10, right(d, 10), d)", key, "phone", inverse), _refill(m, "concat(IF(length(d) > 10, left(d, length(d) - 10), ''), p)")))
    social = let("d", d, let("p", _digits("d", key, "social", inverse), _refill(m, "p")))
    octets = f"transform(split({m}, '[.]'), o -> CAST(o AS INT))"
    net = _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "ip", inverse)
    plain = "forall(o, v -> v < 256) AND array_join(transform(o, v -> CAST(v AS STRING)), '.') = " + m
    ip = let("o", octets, f"IF({plain}, {let('f', net, chr(39).join(['concat_ws(', '.', ', CAST(f.l DIV 256 AS STRING), CAST(f.l % 256 AS STRING), CAST(f.r DIV 256 AS STRING), CAST(f.r % 256 AS STRING))']))}, NULL)")
    iso = _date(m, m, "yyyy-MM-dd", key, inverse)
    dotted = _date(m, f"concat(right({m}, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2))", "dd.MM.yyyy", key, inverse)
    slashed = _date(m, f"concat(right({m}, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2))", "MM/dd/yyyy", key, inverse)
    mail = _mailbox(m, key, inverse)
    cases = {"email": mail, "iso_date": iso, "dotted_date": dotted, "slashed_date": slashed, "phone": phone, "social": social, "ip": ip, "card": card}
    # inside a whole value the look-arounds have nothing to look at; a run of digits is what is left
    return "CASE " + " ".join(f"WHEN {full(k)} THEN {cases[k]}" for k in PATTERNS if k != "card") + f" ELSE {cases['card']} END"


def pseudonymize(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", key: str | None = None, key_file: str | None = None, inverse: bool = False) -> DataFrame:
    """(doc_id, text, n_found, n_replaced): texts with personal values permuted within their format.

    Values found but not valid (a card number without its Luhn digit, a day that
    doesn't exist) stay as they are. A null text stays null, with counts 0; an
    empty one stays empty. Rows are handled each on its own. ``inverse`` gives
    the original texts back under the same key. Very long texts are arrays of
    their found values and the pieces between them, inside their row.

    ``key_file``: a text file whose first line is the key; the plan holds the
    file's path only, so the key comes into no plan, log or user interface. A
    ``key`` given as a value, or the demo key where none is given, stands in the
    plan.
    """
    if key_file:
        first = docs.sparkSession.read.text(key_file).filter("value <> ''").limit(1).scalar()
        secret = F.coalesce(first, F.raise_error(F.lit("the key file holds no key")))
    else:
        secret = F.lit(key or KEY)
    every = _q("|".join(PATTERNS.values()))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), secret.alias("k"))
    d = d.withColumn("m", F.expr(f"CASE WHEN t RLIKE '[0-9@]' THEN regexp_extract_all(t, {every}, 0) ELSE CAST(array() AS ARRAY<STRING>) END"))
    d = d.withColumn("p", F.expr(f"transform(m, v -> {_pseudonym('v', 'k', inverse)})"))
    filled = f"CASE WHEN size(m) = 0 THEN t ELSE {let('g', f'split(t, {every}, -1)', 'array_join(transform(g, (x, gk) -> concat(x, coalesce(get(p, gk), get(m, gk), ' + repr('') + '))), ' + repr('') + ')')} END"
    return d.select("doc_id", F.expr(filled).alias("text"), F.size("m").cast("long").alias("n_found"), F.expr("CAST(size(filter(p, v -> v IS NOT NULL)) AS BIGINT)").alias("n_replaced"))
