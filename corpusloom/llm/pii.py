"""Format-preserving pseudonyms for personal data and secrets, in SQL expressions only.

One regular expression finds candidates; a candidate must be valid for its kind (Luhn sum of a card, mod-97 sum of an
IBAN, octets of an address, a day that exists) or it stays as it is. A valid value goes through a keyed Feistel network
and comes back in its own format: digits for digits, letters for letters of the same case, separators where they were,
checksums right again. The permutation depends on the key and the kind only, so equal values have equal pseudonyms in
all documents, different values different ones, and ``restore=True`` with the same key turns them back.

Further groups of digits may follow a card (a month, a check code). The card is the shortest run of 13 to 19 whole groups
with a right Luhn sum: whether a shorter run is right can't depend on what follows, so restoring finds the same end. The
few cards with another possible end inside are permuted again until no shorter run is right. An IBAN has the length of its country.

* Strings (cards, phones, social security numbers, IBANs, keys, secrets, the local part of e-mail addresses): the
  characters to permute are taken out, cut in two halves, and in each round one half is shifted, position by position
  and within its character class, by a keyed hash of the other.
* IPv4 addresses: two halves of 16 bits. Dates: the day number from 1900 to 2099, as a pair modulo 229 and 319
  (their product is exactly the number of days).

A permuted value must be valid again, or restoring would not find it: a social security number or a national phone number
that isn't is permuted on until it is (cycle walking; restoring walks back). Valid are area codes and exchanges of phone
numbers from 200 on if nothing but the digits says that it is one, addresses without leading zeros that don't follow
the word version or release, and IBAN check digits from 02 to 98. The domain of an e-mail address stays; its local
part is permuted in the way of its domain.

The key is an argument or the Spark setting ``spark.corpusloom.pseudonym.key``; without one ``pseudonymise`` raises.

Null text stays null, empty text empty; a text without candidates is untouched. There is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTING = "spark.corpusloom.pseudonym.key"
ROUNDS = 10
#: Steps of a cycle walk: of the values met at most 36 in 100 are invalid, so that none is left after these in practice.
WALK = 80

#: IBAN characters by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "TL GI IQ IL AE SO OM", 24: "AD CZ MD PK RO SA SK ES SE TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MR MC SM BI DJ", 28: "AL AZ BY CY DO SV GT HU LB PL NI HN", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
IP = r"(?<!(?i:version|release) )[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
#: A phone number without country code or brackets, and digits that may be one.
BARE = r"^[0-9]{3}[ .\-]"
NATIONAL = r"^[2-9][0-9]{2}[ .\-]?[2-9]"
#: A digit of a card with the sign before it, where no other value begins.
CARD_DIGIT = f"(?:[0-9]|[ \\-](?!{SSN}|{DATE}|{IP}|{PHONE})[0-9])"

#: kind, pattern of a candidate. Order decides where two would begin at the same place.
KINDS = [
    ("secret", r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}(?:[=:]\s{0,3}["']|=\s{0,3}|:(?!\s)|:\s{1,3}(?=[A-Za-z+/_\-]{0,200}(?:[0-9]|[a-z][A-Z])))[A-Za-z0-9+/_\-]{8,}"""),
    ("access_key", r"(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])"),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", IBAN + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", SSN),
    ("date", DATE),
    ("ip", IP),
    ("phone", PHONE),
    ("phone_intl", r"\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"),
    ("card", f"[0-9]{CARD_DIGIT}{{12,18}}(?![0-9])"),
]
ANY = r"(?<![A-Za-z0-9+])(?:" + "|".join(p for _, p in KINDS) + ")"


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, kind: str, i: str, x: str) -> str:
    return f"sha2(concat({quote(key)}, '|', {quote(kind)}, '|', {i}, '|', {x}), 256)"


def _order(restore: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0, -1)" if restore else f"sequence(0, {ROUNDS - 1})"


def _shift(half: str, h: str, sign: str, lower: int, upper: int, low_digit: int) -> str:
    """Each character of ``half`` moved within its class by two hex digits of ``h``. lower, upper: letters in use from a and A on; low_digit: the first digit in use."""
    k = f"{sign}cast(conv(substr(h, 1 + 2 * (j % 32), 2), 16, 10) as int)"
    size = 10 - low_digit if low_digit == 0 else 6
    return _let(
        h,
        "h",
        f"array_join(transform(split({half}, ''), (c, j) -> case when c between '{low_digit}' and '{low_digit + size - 1}' then char({48 + low_digit} + pmod(ascii(c) - {48 + low_digit} + {k}, {size})) "
        f"when ascii(c) between 97 and {96 + lower} then char(97 + pmod(ascii(c) - 97 + {k}, {lower})) when ascii(c) between 65 and {64 + upper} then char(65 + pmod(ascii(c) - 65 + {k}, {upper})) else c end), '')",
    )


def feistel_string(x: str, key: str, kind: str, restore: bool = False, tweak: str | None = None, lower: int = 26, upper: int = 26, low_digit: int = 0) -> str:
    """SQL: the string expression ``x`` permuted, each character within its class; another ``tweak``, another permutation."""
    sign = "-" if restore else ""
    ha, hb = (_hash(key, kind, "i", y if tweak is None else f"concat({tweak}, '|', {y})") for y in ("s.b", "s.a"))
    a = f"named_struct('a', {_shift('s.a', ha, sign, lower, upper, low_digit)}, 'b', s.b)"
    b = f"named_struct('a', s.a, 'b', {_shift('s.b', hb, sign, lower, upper, low_digit)})"
    return f"aggregate({_order(restore)}, named_struct('a', substr({x}, 1, length({x}) div 2), 'b', substr({x}, 1 + length({x}) div 2)), (s, i) -> if(i % 2 = 0, {a}, {b}), s -> concat(s.a, s.b))"


def feistel_pair(a: str, b: str, m: int, n: int, key: str, kind: str, restore: bool = False) -> str:
    """SQL: the pair of bigints (a below m, b below n) permuted, as a struct."""
    f = lambda x: f"cast(conv(substr({_hash(key, kind, 'i', f'cast({x} as string)')}, 1, 15), 16, 10) as bigint)"
    op = "-" if restore else "+"
    return (
        f"aggregate({_order(restore)}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, named_struct('a', pmod(s.a {op} {f('s.b')}, {m}L), 'b', s.b), "
        f"named_struct('a', s.a, 'b', pmod(s.b {op} {f('s.a')}, {n}L))))"
    )


def _let(value: str, name: str, then: str) -> str:
    """SQL has no let: a one-row transform binds ``name``."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _walk(x: str, step: Callable[[str], str], valid: Callable[[str], str]) -> str:
    """SQL: ``x`` permuted until it is valid."""
    return f"aggregate(sequence(1, {WALK}), {step(x)}, (y, turn) -> if({valid('y')}, y, {step('y')}))"


def _refill(m: str, pattern: str, new: str) -> str:
    """The characters of ``m`` that match ``pattern`` (a class) taken in turn from ``new``; the rest stays."""
    return f"array_join(transform(sequence(1, length({m})), j -> if(substr({m}, j, 1) rlike '{pattern}', substr({new}, length(regexp_replace(substr({m}, 1, j), '[^{pattern[1:-1]}]', '')), 1), substr({m}, j, 1))), '')"


def luhn_sum(d: str) -> str:
    """SQL: Luhn sum of a digit string with its check digit last."""
    v = f"cast(substr({d}, length({d}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (acc, j) -> acc + if(j % 2 = 0, {v}, if({v} > 4, 2 * {v} - 9, 2 * {v})))"


def mod97(x: str) -> str:
    """SQL: the IBAN number of ``x`` (letters count as 10 to 35) modulo 97."""
    v = f"cast(conv(substr({x}, j, 1), 36, 10) as bigint)"
    return f"aggregate(sequence(1, length({x})), 0L, (acc, j) -> (acc * if({v} > 9, 100, 10) + {v}) % 97)"


def card_ends(m: str) -> str:
    """SQL: the numbers of digits, from 13 to 19, after which a group of ``m`` ends, least first."""
    return "array_compact(array(" + ", ".join(f"if({m} rlike {quote('^[0-9](?:[ -]?[0-9]){%d}(?![0-9])' % (n - 1))}, {n}, null)" for n in range(13, 20)) + "))"


def card_end(m: str) -> str:
    """SQL: the number of digits of the card with which ``m`` begins, null if there is none."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"try_element_at(filter({card_ends(m)}, e -> {luhn_sum(f'substr({digits}, 1, e)')} % 10 = 0), 1)"


def pseudonym(m: str, key: str, restore: bool = False) -> str:
    """SQL: the pseudonym of the candidate ``m``, or ``m`` itself if it isn't valid."""
    f = lambda x, kind, **k: feistel_string(x, key, kind, restore, **k)
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    secret = quote(r"""^([A-Za-z_\-]+\s*[=:]\s*["']?)(.*)$""")
    value = f"regexp_extract({m}, {secret}, 2)"
    hexed = quote(r"^[0-9a-f]+$")
    iban = f"regexp_replace({m}, ' ', '')"
    body = f(f"substr({iban}, 5)", "iban")
    check = _let(body, "q", f"concat(substr({iban}, 1, 2), lpad(cast(98 - {mod97(f'''concat(q, substr({iban}, 1, 2), '00')''')} as string), 2, '0'), q)")
    new_card = lambda d: _let(f"concat(substr({d}, 1, 1), {f(f'substr({d}, 2, length({d}) - 2)', 'card')}, '0')", "z", f"concat(substr(z, 1, length(z) - 1), cast(pmod(-{luhn_sum('z')}, 10) as string))")
    again = f"aggregate(sequence(1, 200), {new_card('d')}, (y, step) -> if(exists(ends, e -> {luhn_sum('substr(y, 1, e)')} % 10 = 0), {new_card('y')}, y))"
    walked = _let(f"filter({card_ends(m)}, e -> e < n)", "ends", f"if(size(ends) = 0, {new_card('d')}, {again})")
    card = _let(card_end(m), "n", _let(f"substr({digits}, 1, n)", "d", f"concat({walked}, substr({digits}, n + 1))"))
    octet = lambda k: f"cast(split({m}, '[.]')[{k}] as bigint)"
    ip = _let(feistel_pair(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ip", restore), "q", "concat_ws('.', q.a div 256, q.a % 256, q.b div 256, q.b % 256)")
    iso, slash = quote(r"^\d{4}-"), quote(r"/")
    day = f"case when {m} rlike {iso} then try_to_date({m}, 'yyyy-MM-dd') when {m} rlike {slash} then try_to_date({m}, 'dd/MM/yyyy') else try_to_date({m}, 'dd.MM.yyyy') end"
    number = f"datediff({day}, date'1900-01-01')"
    new_day = _let(feistel_pair(f"{number} div 319", f"{number} % 319", 229, 319, key, "date", restore), "q", "date_add(date'1900-01-01', cast(q.a * 319 + q.b as int))")
    date = f"date_format({new_day}, case when {m} rlike {iso} then 'yyyy-MM-dd' when {m} rlike {slash} then 'dd/MM/yyyy' else 'dd.MM.yyyy' end)"
    plus = quote(r"^(\+[0-9]{1,3})?(.*)$")
    lead, rest = f"regexp_extract({m}, {plus}, 1)", f"regexp_extract({m}, {plus}, 2)"
    phone = _let(f(f"regexp_replace({rest}, '[^0-9]', '')", "phone"), "q", f"concat({lead}, {_let(rest, 'r', _refill('r', '[0-9]', 'q'))})")
    bare = _walk(digits, lambda y: f(y, "phone"), lambda y: f"{y} rlike {quote(NATIONAL)}")
    ssn = _walk(digits, lambda y: f(y, "ssn"), ssn_area)
    fill = lambda new: _let(new, "q", _refill(m, "[0-9]", "q"))
    fill_iban = _let(check, "q", _refill(m, "[A-Z0-9]", "q"))
    return f"""case {kind_of(m)}
        when 'secret' then concat(regexp_extract({m}, {secret}, 1), if({value} rlike {hexed}, {f(value, "hex", lower=6)}, {f(value, "secret")}))
        when 'access_key' then concat(substr({m}, 1, 4), {f(f"substr({m}, 5)", "access_key", low_digit=2)})
        when 'email' then concat({f(f"substring_index({m}, '@', 1)", "email", tweak=f"lower(substring_index({m}, '@', -1))")}, '@', substring_index({m}, '@', -1))
        when 'iban' then {fill_iban}
        when 'ssn' then {fill(ssn)}
        when 'date' then {date}
        when 'ip' then {ip}
        when 'phone' then if({m} rlike {quote(BARE)}, {fill(bare)}, {phone})
        when 'card' then {fill(card)}
        else {m} end"""


def ssn_area(x: str) -> str:
    """SQL: can ``x``, digits or a candidate, begin a social security number?"""
    return f"(substr({x}, 1, 3) not in ('000', '666') and substr({x}, 1, 1) <> '9')"


def kind_of(m: str) -> str:
    """SQL: the kind of a candidate, null if it isn't valid."""
    is_ = {k: f"{m} rlike {quote('^(?:' + p + ')$')}" for k, p in KINDS}
    iban = f"regexp_replace({m}, ' ', '')"
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255 and cast(cast(o as int) as string) = o)"
    iso, slash = quote(r"^\d{4}-"), quote(r"/")
    day = f"case when {m} rlike {iso} then try_to_date({m}, 'yyyy-MM-dd') when {m} rlike {slash} then try_to_date({m}, 'dd/MM/yyyy') else try_to_date({m}, 'dd.MM.yyyy') end"
    return f"""case when {is_["secret"]} then 'secret' when {is_["access_key"]} then 'access_key' when {is_["email"]} then 'email'
        when {is_["iban"]} then if({mod97(f"concat(substr({iban}, 5), substr({iban}, 1, 4))")} = 1 and substr({iban}, 3, 2) between '02' and '98', 'iban', null)
        when {is_["ssn"]} then if({ssn_area(m)}, 'ssn', null)
        when {is_["date"]} then if({day} between date'1900-01-01' and date'2099-12-31', 'date', null)
        when {is_["ip"]} then if({octets}, 'ip', null)
        when {is_["phone"]} then if({m} rlike {quote(BARE)} and not {m} rlike {quote(NATIONAL)}, null, 'phone')
        when {is_["phone_intl"]} then 'phone'
        when {is_["card"]} then if({card_end(m)} is not null, 'card', null) end"""


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", restore: bool = False, found_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; with ``found_col`` also the kinds of the valid values, in text order."""
    key = key or docs.sparkSession.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"give a key or set {SETTING}")
    t = f"`{text_col}`"
    any_, hint = quote(ANY), quote("(?i)[0-9@]|passw|pwd|secret|token|api[_-]?key")
    matches = f"if({t} rlike {hint}, regexp_extract_all({t}, {any_}, 0), null)"
    free = next(n for n in (f"__found{i}" for i in range(99)) if n not in docs.columns)
    new = f"array_join(zip_with(split({t}, {any_}, -1), transform({free}, m -> {pseudonym('m', key, restore)}), (g, p) -> concat(g, coalesce(p, ''))), '')"
    kinds = f"filter(transform({free}, m -> {kind_of('m')}), k -> k is not null)"
    found = docs.withColumn(free, F.expr(matches))
    out = {text_col: F.expr(f"if({free} is null or size({free}) = 0, {t}, {new})")}
    if found_col:
        out[found_col] = F.coalesce(F.expr(f"if({free} is null, null, {kinds})"), F.array().cast("array<string>"))
    return found.withColumns(out).drop(free)
