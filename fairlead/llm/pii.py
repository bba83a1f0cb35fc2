"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own check (Luhn, IBAN remainder, octet range, calendar, issued number ranges)
are replaced by another value of the same format that passes it too. The replacement is a keyed Feistel
permutation, so equal values stay equal in all documents, different values stay different, and whoever has the
key can undo it. Everything is DataFrame or SQL functions.

A value is seen as a list of digits, each with a base of its own (10 for a card digit, 256 for an octet, 898
for the first part of a social security number). A round adds a keyed hash of one half of the list to the digits of
the other half, each modulo its base, then swaps the halves: a permutation for any bases, without cycle walking.
Dates are day numbers within 400 years: 146,097 days are exactly 189 times 773.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Kinds in order of preference, with the pattern of a candidate. Java syntax.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "day_date": r"(?<![\d/.])\d{2}([/.])\d{2}\1\d{4}(?![\d/])",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
#: The back-reference of day_date counts groups of the whole pattern; it is the only capturing one.
CANDIDATE = "|".join(PATTERNS.values())

FIRST_DAY, DAYS = "1700-01-01", 146097


def _text(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _kind(v: str) -> str:
    """SQL for the kind of a candidate by its form, before its check."""
    return f"""case when {v} like '%@%' then 'email' when {v} like '+%' then 'phone'
        when {v} rlike '^[A-Z]' then 'iban' when {v} rlike r'^\\d+([.]\\d+){{3}}$' then 'ip'
        when {v} rlike r'^\\d{{3}}-\\d{{2}}-\\d{{4}}$' then 'ssn' when {v} rlike r'^\\d{{4}}-\\d{{2}}-\\d{{2}}$' then 'iso_date'
        when {v} rlike r'^\\d{{2}}[/.]\\d{{2}}[/.]\\d{{4}}$' then 'day_date' else 'card' end"""


def _digits(v: str) -> str:
    return f"transform(split(regexp_replace({v}, r'\\D', ''), ''), d -> cast(d as bigint))"


def _luhn_sum(digits: str) -> str:
    """Sum of digits, every second one from the right, the last not among them, doubled."""
    return f"""aggregate(reverse({digits}), named_struct('s', 0L, 'i', 0), (a, d) -> named_struct(
        's', a.s + if(a.i % 2 = 1, if(d > 4, 2 * d - 9, 2 * d), d), 'i', a.i + 1), a -> a.s)"""


def _mod97(v: str) -> str:
    """Remainder of an IBAN-like text, its first four characters moved to the end, letters as 10 to 35."""
    moved = f"concat(substring({v}, 5), substring({v}, 1, 4))"
    return f"""aggregate(split({moved}, ''), 0L, (a, c) -> if(c between '0' and '9',
        (a * 10 + cast(c as bigint)) % 97, (a * 100 + ascii(c) - 55) % 97))"""


def _date(v: str, kind: str) -> str:
    """The date a candidate names, null if there is none; day first where both readings exist."""
    if kind == "iso_date":
        return f"try_to_date({v}, 'yyyy-MM-dd')"
    flat = f"translate({v}, '/', '.')"
    return f"coalesce(try_to_date({flat}, 'dd.MM.yyyy'), try_to_date({flat}, 'MM.dd.yyyy'))"


def _in_range(date: str) -> str:
    return f"coalesce({date} between date'{FIRST_DAY}' and date_add(date'{FIRST_DAY}', {DAYS - 1}), false)"


def _parts(v: str, sep: str) -> str:
    return f"transform(split({v}, '{sep}'), d -> cast(d as bigint))"


def _valid(v: str, kind: str) -> str:
    if kind == "card":
        return f"{_luhn_sum(_digits(v))} % 10 = 0"
    if kind == "iban":
        return f"{_mod97(v)} = 1"
    if kind == "ip":
        return f"forall({_parts(v, '[.]')}, d -> d < 256)"
    if kind == "ssn":
        return (f"not (substring({v}, 1, 3) in ('000', '666') or substring({v}, 1, 1) = '9' "
                f"or substring({v}, 5, 2) = '00' or substring({v}, 8, 4) = '0000')")
    if kind in ("iso_date", "day_date"):
        return _in_range(_date(v, kind))
    if kind == "phone":
        return f"length(regexp_replace({v}, r'\\D', '')) between 8 and 15"
    return "true"


def _feistel(digits: str, bases: str, kind: str, key: str, undo: bool) -> str:
    """SQL for the permuted digits. The halves and their bases are swapped after each round."""
    k, n = key.replace("\\", "\\\\").replace("'", "\\'"), f"size({digits})"
    mix = lambda k_, half: (
        "cast(conv(substring(sha2(concat('%s|%s|', %s, '|', i, '|', array_join(%s, ',')), 256), 1, 12), 16, 10) as bigint)"
        % (k, kind, k_, half))
    if undo:
        step = f"""named_struct('l', transform(a.r, (x, i) -> pmod(x - {mix(f'({ROUNDS - 1} - k)', 'a.l')}, element_at(a.rb, i + 1))),
            'r', a.l, 'lb', a.rb, 'rb', a.lb)"""
    else:
        step = f"""named_struct('l', a.r, 'r', transform(a.l, (x, i) -> pmod(x + {mix('k', 'a.r')}, element_at(a.lb, i + 1))),
            'lb', a.rb, 'rb', a.lb)"""
    cut = f"({n} div 2)"
    return f"""aggregate(sequence(0, {ROUNDS - 1}), named_struct(
        'l', slice({digits}, 1, {cut}), 'r', slice({digits}, {cut} + 1, {n} - {cut}),
        'lb', slice({bases}, 1, {cut}), 'rb', slice({bases}, {cut} + 1, {n} - {cut})),
        (a, k) -> {step}, a -> concat(a.l, a.r))"""


def _with(value: str, name: str, then: str) -> str:
    """SQL that evaluates a value once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _refill(v: str, digits: str, skip: str = "0") -> str:
    """SQL for a text whose digits, after the first ``skip`` ones, are replaced in order."""
    return f"""aggregate(split({v}, ''), named_struct('t', '', 'i', 0), (a, c) -> if(c between '0' and '9',
        named_struct('t', concat(a.t, if(a.i < {skip}, c, cast(element_at({digits}, a.i - {skip} + 1) as string))), 'i', a.i + 1),
        named_struct('t', concat(a.t, c), 'i', a.i)), a -> a.t)"""


def _replace(v: str, kind: str, key: str, undo: bool) -> str:
    """SQL for the pseudonym of a valid value."""
    same = lambda base, d: f"transform({d}, x -> {base}L)"
    permuted = lambda d, bases: _feistel(d, bases, "date" if kind.endswith("date") else kind, key, undo)
    if kind == "card":
        body = _with(f"slice({_digits(v)}, 1, size({_digits(v)}) - 1)", "b", permuted("b", same(10, "b")))
        check = _with(f"concat({body}, array(0L))", "p", f"concat(slice(p, 1, size(p) - 1), array((10 - {_luhn_sum('p')} % 10) % 10))")
        return _with(check, "q", _refill(v, "q"))
    if kind == "phone":
        # The country code, the digits up to the first separator (the first one if there is none), stays.
        code = f"greatest(1, length(regexp_extract({v}, r'^[+](\\d{{1,3}})(?=\\D)', 1)))"
        return _with(_with(f"slice({_digits(v)}, {code} + 1, size({_digits(v)}) - {code})", "b", permuted("b", same(10, "b"))),
                     "q", _refill(v, "q", code))
    if kind == "ip":
        return _with(permuted(_parts(v, "[.]"), "array(256L, 256L, 256L, 256L)"), "q", "array_join(q, '.')")
    if kind == "ssn":
        # First part: 1 to 899 without 666, as 0 to 897.
        cast = lambda at, n: f"cast(substring({v}, {at}, {n}) as bigint)"
        first = f"{cast(1, 3)} - if({cast(1, 3)} > 666, 2, 1)"
        q = permuted(f"array({first}, {cast(5, 2)} - 1, {cast(8, 4)} - 1)", "array(898L, 99L, 9999L)")
        return _with(q, "q", "format_string('%03d-%02d-%04d', q[0] + if(q[0] >= 665, 2, 1), q[1] + 1, q[2] + 1)")
    if kind in ("iso_date", "day_date"):
        day = f"cast(datediff({_date(v, kind)}, date'{FIRST_DAY}') as bigint)"
        q = permuted(f"array({day} div 773, {day} % 773)", "array(189L, 773L)")
        date = f"date_add(date'{FIRST_DAY}', cast(q[0] * 773 + q[1] as int))"
        if kind == "iso_date":
            return _with(q, "q", f"date_format({date}, 'yyyy-MM-dd')")
        flat = f"translate({v}, '/', '.')"
        order = lambda fmt: f"date_format({date}, '{fmt}')"
        # A date that can only be read month first stays so; its pseudonym must not become day first by chance.
        return _with(q, "q", f"""translate(if(try_to_date({flat}, 'dd.MM.yyyy') is not null, {order('dd.MM.yyyy')},
            {order('MM.dd.yyyy')}), '.', substring({v}, 3, 1))""")
    # email and iban: letters and digits of the local part or account stay of their class.
    if kind == "email":
        head, tail = f"substring_index({v}, '@', 1)", f"concat('@', substring_index({v}, '@', -1))"
    else:
        head, tail = f"substring({v}, 5)", "''"
    base = "if(c between '0' and '9', 10L, if(c rlike '^[A-Za-z]$', 26L, 1L))"
    code = "if(c between '0' and '9', ascii(c) - 48L, if(c between 'a' and 'z', ascii(c) - 97L, if(c between 'A' and 'Z', ascii(c) - 65L, 0L)))"
    q = _with(f"transform(split({head}, ''), c -> named_struct('d', {code}, 'b', {base}))", "s", permuted("s.d", "s.b"))
    back = """transform(split(%s, ''), (c, i) -> if(c between '0' and '9', char(48 + q[i]), if(c between 'a' and 'z',
        char(97 + q[i]), if(c between 'A' and 'Z', char(65 + q[i]), c))))""" % head
    text = _with(q, "q", f"array_join({back}, '')")
    if kind == "email":
        return f"concat({text}, {tail})"
    country = f"substring({v}, 1, 2)"
    return _with(text, "t", f"concat({country}, lpad(cast(98 - {_mod97(f'concat({country}, {chr(39)}00{chr(39)}, t)')} as string), 2, '0'), t)")


def pseudonym(v: str, key: str, undo: bool = False) -> str:
    """SQL for struct(kind, text): a candidate's kind and pseudonym; kind null and text unchanged if its check fails."""
    arms = " ".join(
        f"when '{k}' then if({_valid('v', k)}, named_struct('kind', '{k}', 'text', {_replace('v', k, key, undo)}), "
        "named_struct('kind', cast(null as string), 'text', v))" for k in KINDS)
    return _with(v, "v", f"case {_kind('v')} {arms} end")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and an array ``pii_kinds`` of the kinds in order.

    The parts between candidates are kept as they are, whatever characters they hold. Null stays null with no
    kinds, empty stays empty. All other columns are carried; ``pii_kinds`` replaces one of that name. A number
    that fails its check (a card number without Luhn sum, an octet over 255, 31 February) is left alone.
    A date that exists month first only may, by its pseudonym, also read day first; undoing it then needs
    the order it was written in, all other kinds are undone exactly.
    """
    c = f"`{text}`"
    found = f"transform(regexp_extract_all({c}, {_text(CANDIDATE)}, 0), m -> {pseudonym('m', key, undo)})"
    whole = f"{c} is not null and {c} rlike '[0-9@]'"
    marked = docs.withColumn("pii_kinds", F.expr(f"if({whole}, {found}, null)"))
    joined = f"""if(pii_kinds is null or size(pii_kinds) = 0, {c}, array_join(transform(split({c}, {_text(CANDIDATE)}, -1),
        (p, i) -> concat(p, coalesce(get(pii_kinds, i).text, ''))), ''))"""
    return marked.withColumn(text, F.expr(joined)).withColumn(
        "pii_kinds", F.expr("coalesce(filter(transform(pii_kinds, p -> p.kind), k -> k is not null), cast(array() as array<string>))"))
