"""Texts derived from the test tables, by expressions that Spark and DuckDB read alike, and SQL twins of patterns and validators."""

from __future__ import annotations

from ..functions import pack

_D = "lpad(cast({} as string), {}, '0')"


def _pad(value: str, n: int) -> str:
    """The last ``n`` digits of a whole number."""
    return f"substring(lpad(cast({value} as string), 40, '0'), {41 - n}, {n})"


#: (table, key, text) for each pattern: right and wrong values in turn.
TEXTS: dict[str, tuple[str, str, str]] = {
    "ssn": ("customer", "c_custkey", f"concat('SSN ', {_pad('c_custkey * 37 % 1000', 3)}, '-', {_pad('c_custkey % 50', 2)}, '-', {_pad('c_custkey * 7919 % 10000', 4)}, '; ref ', c_name)"),
    "pan": ("orders", "o_orderkey", f"concat('card 4', {_pad('o_orderkey * 7919', 15)}, ' or 51', {_pad('o_custkey * 104729', 14)}, ' end')"),
    "cui": ("part", "p_partkey", "concat(case when p_partkey % 4 = 0 then 'CUI//SP-PRVCY ' when p_partkey % 4 = 1 then 'for official use only ' when p_partkey % 4 = 2 then 'CUI//BASIC ' else 'cuisine ' end, p_name)"),
    "aws_key": ("part", "p_partkey", f"concat('id AKIA', case when p_partkey % 3 = 0 then 'SHORT' else {_pad('p_partkey * 104729', 16)} end, ' ', p_brand)"),
    "aws_secret": ("part", "p_partkey", f"concat(case when p_partkey % 2 = 0 then 'AWS_SECRET_ACCESS_KEY=' else 'secret_key=' end, {_pad('p_partkey', 40)})"),
    "anthropic": ("part", "p_partkey", f"concat('use sk-ant', '-api', {_pad('p_partkey % 100', 2)}, '-', {_pad('p_partkey', 10)}, case when p_partkey % 2 = 0 then {_pad('p_partkey', 15)} else '' end, ' now')"),
    "openai_proj": ("part", "p_partkey", f"concat('use sk-', 'proj-', {_pad('p_partkey', 10)}, case when p_partkey % 2 = 0 then 'Ab_cd-EfGh12' else '' end, ' now')"),
    "openrouter": ("part", "p_partkey", f"concat('use sk-', 'or-v1-', {_pad('p_partkey', 40)}, case when p_partkey % 2 = 0 then 'abcdefgh12' else '' end, ' now')"),
    "openai_legacy": ("part", "p_partkey", f"concat('use sk-', {_pad('p_partkey', 40)}, case when p_partkey % 2 = 0 then 'abcdefgh12' else '' end, ' now')"),
    "ghp": ("part", "p_partkey", f"concat('use gh', 'p_', {_pad('p_partkey', 35)}, case when p_partkey % 3 = 0 then 'x' when p_partkey % 3 = 1 then 'xyz' else '' end, ' now')"),
    "github_pat": ("part", "p_partkey", f"concat('use github', '_pat_', {_pad('p_partkey', 40)}, '_', {_pad('p_partkey', 40)}, case when p_partkey % 3 = 0 then 'x' else '' end, ' now')"),
    "bearer": ("orders", "o_orderkey", f"concat('Authorization: Bearer ', case when o_orderkey % 5 = 0 then 'process.env.SERVICE_TOKEN_NAME' else {_pad('o_orderkey', 22)} end, ' ', o_orderpriority)"),
    "generic_key": ("orders", "o_orderkey", f"concat(case when o_orderkey % 2 = 0 then 'api_key = ' else 'Access-Token:' end, case when o_orderkey % 7 = 0 then 'DATABASE_URL_HOME=' else concat('k', {_pad('o_orderkey * 104729', 20)}) end)"),
    "iban": ("supplier", "s_suppkey", f"concat('pay DE', {_pad('98 - (cast(s_suppkey * 1000003 as decimal(38,0)) * 1000000 + 131400) % 97 - (case when s_suppkey % 3 = 0 then 1 else 0 end)', 2)}, ' ', {_pad('s_suppkey * 1000003', 18)}, ' today')"),
    "passport": ("customer", "c_custkey", f"concat(case when c_custkey % 3 = 0 then 'Passport: A' when c_custkey % 3 = 1 then 'travel document # AB' else 'ticket C' end, {_pad('c_custkey * 7919', 8)})"),
    "mrn": ("customer", "c_custkey", f"concat('Patient MRN: ', case when c_custkey % 3 = 0 then 'SYSTEMS' else concat('M', {_pad('c_custkey', 8)}) end, '.')"),
    "npi": ("customer", "c_custkey", f"concat('NPI: ', {_pad('1000000000 + c_custkey * 7919', 10)})"),
}
#: The pack's pattern for each.
IDS = dict(zip(TEXTS, [p.id for p in pack.PATTERNS], strict=True))


def pattern(name: str) -> pack.Pattern:
    return next(p for p in pack.PATTERNS if p.id == IDS[name])


def duck(text: str) -> str:
    """Derived text for DuckDB, which parts from Spark in the name of the string type only."""
    return text.replace(" as string)", " as varchar)")


def _luhn(digits: str) -> str:
    """Digits from the right; every second one doubled."""
    d = f"cast(substring({digits}, (length({digits}) - i)::int, 1) as int)"
    return f"(list_sum(list_transform(range(0, length({digits})), lambda i: case when i % 2 = 0 then {d} else {d} * 2 - (case when {d} > 4 then 9 else 0 end) end)) % 10 = 0)"


def _stripped(v: str) -> str:
    return f"regexp_replace({v}, '[\\s-]', '', 'g')"


def _iban(v: str) -> str:
    plain = f"upper(regexp_replace({v}, '\\s', '', 'g'))"
    turned = f"(substring({plain}, 5) || substring({plain}, 1, 4))"
    code = "case when c between 'A' and 'Z' then (ascii(c) - 55)::varchar else c end"
    digits = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: {code}), '')"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({digits}, ''), lambda x: x::int)), lambda a, x: (a * 10 + x) % 97)"
    return f"(length({plain}) between 15 and 34 and {rest} = 1)"


def validator(name: str, v: str) -> str:
    s = _stripped(v)
    issuer = f"({s}[1] = '4' or substring({s}, 1, 2)::int between 51 and 55 or substring({s}, 1, 4)::int between 2221 and 2720 or substring({s}, 1, 2) in ('34', '37', '65') or substring({s}, 1, 4) = '6011' or substring({s}, 1, 3)::int between 644 and 649)"
    return {
        "none": "true",
        "ssnArea": f"(substring({v}, 1, 3) not in ('000', '666') and substring({v}, 1, 1) <> '9' and substring({v}, 5, 2) <> '00' and substring({v}, 8, 4) <> '0000')",
        "luhn": f"(length({s}) between 13 and 19 and {issuer} and {_luhn(s)})",
        "mod97": _iban(v),
        "npiLuhn": _luhn(f"('80840' || {v})"),
        "notEmptyAssignmentTarget": f"not regexp_full_match({v}, '[A-Z][A-Z0-9_]*=')",
        "containsDigit": f"regexp_matches({v}, '[0-9]')",
    }[name]


def quoted(p: pack.Pattern) -> str:
    return (("(?i)" if p.flags else "") + p.source).replace("'", "''")


def reference(v: str) -> str:
    return "regexp_full_match(trim(" + v + "), '" + "|".join(pack.REFERENCES).replace("'", "''") + "')"


def mask(v: str) -> str:
    return f"case when length({v}) <= 8 then repeat('*', length({v})) when length({v}) <= 12 then '...' || right({v}, 2) else '...' || right({v}, 4) end"


def findings(p: pack.Pattern, source: str) -> str:
    """(key, value, start, end) in DuckDB of ``source`` (key, text)."""
    q = quoted(p)
    return f"""
WITH t AS ({source}),
m AS (SELECT key, string_split_regex(text, '{q}') AS gaps, regexp_extract_all(text, '{q}', 0) AS ms, regexp_extract_all(text, '{q}', 1) AS vs FROM t WHERE text IS NOT NULL),
x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
f AS (SELECT key, vs[i] AS v, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::int AS s, length(ms[i])::int AS n FROM x),
k AS (SELECT key, v, s, s + n AS e FROM f WHERE NOT {reference("v")} AND {validator(p.validator, "v")})"""
