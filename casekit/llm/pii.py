"""Personal data in texts, found with built-in functions only.

Regular expressions propose spans, validators (octet range, Luhn, mod-97,
digit counts) confirm them, and words near a span adjust its score.  The four
base kinds are decided by pattern and validator alone; the further kinds need
a score of ``threshold`` or more.

The pattern for account numbers proposes beginnings only, each with the text
that may belong to it; the validator fixes the length, since a number is often
followed by a capital letter or digit.  Of numbers that overlap the first
stands.

Positions come from the pieces between matches: ``split`` by the same pattern
gives the text around each match, and running lengths give the offsets.  The
patterns are written without backtracking (possessive, entered only where a
run begins), so a long run of letters or digits costs linear time; they find
the same leftmost, non-overlapping matches as the plain forms.

Defined results: a null or empty text has no spans.  Spans of different kinds
may overlap; each is reported, and redaction masks their union once.  Repeated
rows and ties give one result per row, an empty table an empty one; extra
columns are carried along (working columns start with ``_p_``).  Finding is
linear in the text; redaction costs the text length per span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import sealed, text_of

_LOCAL = "A-Za-z0-9._%+-"
_BLOCK = 256  # matches whose positions are summed together


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: Callable[[Column], Column]  # cheap condition for a match to be possible
    valid: Callable[[Column, Column, Column], Column]  # match, text before, text after
    score: float
    context: str
    base: bool


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column, before: Column, after: Column) -> Column:
    octet = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return m.rlike(rf"^{octet}(\.{octet}){{3}}$")


def _luhn(m: Column, before: Column, after: Column) -> Column:
    d = _digits(m)
    value = lambda i: F.ascii(F.substring(F.reverse(d), i, 1)) - 48
    doubled = lambda v: 2 * v - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(m: Column, before: Column, after: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _alone(before: Column, after: Column) -> Column:
    """No letter or digit touches the match."""
    return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, "\x20", "")
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, 1))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return m.rlike("^[A-Z0-9\x20]+$") & F.when(F.length(s).between(15, 34), rest == 1).otherwise(F.lit(False))


def _ibans(heads: Column, tails: Column, text: Column) -> Column:
    """Positions of account numbers from those of their first four characters
    and the texts that may go on.

    A number ends before a space or where its tail ends; the length registered
    for its country goes first, then the longest that passes mod-97.
    """
    own = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS.split() for x in (c[:2], int(c[2:]))])

    def settled(head: Column, tail: Column) -> Column:
        words = F.split(tail, "\x20")
        ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)),
                           lambda k: F.concat(head, F.array_join(F.slice(words, 1, k), " ")))
        valid = F.filter(ends, _mod97)
        first = F.filter(valid, lambda v: F.length(F.regexp_replace(v, "\x20", "")) == F.element_at(own, F.left(v, F.lit(2))))
        return F.coalesce(F.get(first, F.lit(0)), F.get(valid, F.lit(0)))

    found = F.zip_with(heads, tails, lambda x, tail: F.struct(
        x["start"].alias("start"), x["before"].alias("before"), settled(x["match"], tail).alias("match")))
    spans = F.transform(F.filter(found, lambda x: x["match"].isNotNull()), lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), x["match"].alias("match"), x["before"].alias("before"),
        F.substring(text, x["start"] + F.length(x["match"]) + 1, F.lit(CONTEXT_CHARS)).alias("after")))
    none = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(spans, none, lambda acc, x: F.when(x["start"] >= acc["pos"], F.struct(
        x["end"].alias("pos"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc))["out"]


def _ssn(m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after) & ~m.rlike("^(000|666|9)|-00-|-0000$")


_HAS_DIGIT = "_p_digit"

KINDS = (
    Kind("email",
         rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), lambda m, b, a: F.lit(True), 0.9, r"(?i)\b(e-?mail|contact|write|reach|mailto)\b", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: F.col(_HAS_DIGIT), _octets, 0.6, r"(?i)\b(ip|address|host|server|login|from)\b", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: F.col(_HAS_DIGIT), _luhn, 0.8, r"(?i)\b(card|visa|credit|debit|payment|cvv)\b", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.col(_HAS_DIGIT) & t.contains("+"), _phone, 0.6, r"(?i)\b(phone|call|tel|mobile|fax)\b", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
         lambda t: F.col(_HAS_DIGIT) & t.rlike("[A-Z]{2}[0-9]{2}"), lambda m, b, a: F.lit(True), 0.9, r"(?i)\b(iban|account|bank|transfer)\b",
         False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda t: F.col(_HAS_DIGIT) & t.contains("-"), _ssn, 0.4, r"(?i)\b(ssn|social|security)\b", False),
)
# Characters of an account number by country (IBAN registry).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
    "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
_SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"


def _positions(pieces: Column, matches: Column) -> Column:
    """(start, end, match, before, after) of every match, in order.

    ``pieces`` are the texts around the matches.  Lengths are summed block by
    block, so appending copies short arrays only.
    """
    n = F.size(matches)
    item = lambda pos, i: F.struct(
        (pos + F.length(F.get(pieces, i))).alias("start"),
        (pos + F.length(F.get(pieces, i)) + F.length(F.get(matches, i))).alias("end"),
        F.get(matches, i).alias("match"),
        F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)).alias("before"),
        F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS)).alias("after"))
    none = F.array().cast(f"array<{_SPAN}>")

    def block(pos: Column, b: Column) -> Column:
        return F.aggregate(
            F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, n) - 1),
            F.struct(pos.alias("pos"), none.alias("out")),
            lambda acc, i: F.struct(
                (acc["pos"] + F.length(F.get(pieces, i)) + F.length(F.get(matches, i))).alias("pos"),
                F.array_append(acc["out"], item(acc["pos"], i)).alias("out")))

    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
        F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")),
        lambda acc, b: F.struct(block(acc["pos"], b)["pos"].alias("pos"),
                                F.array_append(acc["out"], block(acc["pos"], b)["out"]).alias("out")))
    return F.when(n > 0, F.flatten(blocks["out"])).otherwise(none)


def _confirmed(kind: Kind, rank: int, positions: Column, threshold: float) -> Column:
    """The positions that pass the kind's validator, with scores."""
    def span(x: Column) -> Column:
        near = x["before"].rlike(kind.context) | x["after"].rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"),
                        x["end"].alias("end"), F.lit(kind.base).alias("base"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(F.filter(positions, lambda x: kind.valid(x["match"], x["before"], x["after"])), span)
    return spans if kind.base else F.filter(spans, lambda x: x["score"] >= threshold)


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Append ``pii``: spans (start, rank, kind, end, base, score), ordered by
    start, then kind as listed; offsets are code points, ends exclusive.
    """
    df = sealed(df, {"_p_t": text_of(text_col)})
    t = F.col("_p_t")
    df = sealed(df, {_HAS_DIGIT: t.rlike("[0-9]")})
    empty = F.array().cast("array<string>")
    for k in KINDS:
        df = sealed(df, {f"_p_m_{k.name}": F.when(
            k.gate(t), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(empty)})
        m = F.col(f"_p_m_{k.name}")
        df = sealed(df, {f"_p_c_{k.name}": F.when(F.size(m) > 0, F.split(t, k.pattern, -1)).otherwise(empty)})
    for rank, k in enumerate(KINDS):
        df = sealed(df, {f"_p_s_{k.name}": _positions(F.col(f"_p_c_{k.name}"), F.col(f"_p_m_{k.name}"))})
        if k.name == "iban":
            tails = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(1))
            tails = F.when(F.size("_p_m_iban") > 0, tails).otherwise(empty)
            df = sealed(df, {"_p_x_iban": tails})
            df = sealed(df, {"_p_s_iban": _ibans(F.col("_p_s_iban"), F.col("_p_x_iban"), t)}).drop("_p_x_iban")
        df = sealed(df, {f"_p_f_{k.name}": _confirmed(k, rank, F.col(f"_p_s_{k.name}"), threshold)})
        df = df.drop(f"_p_m_{k.name}", f"_p_c_{k.name}", f"_p_s_{k.name}")
    found = [f"_p_f_{k.name}" for k in KINDS]
    return sealed(df, {"pii": F.array_sort(F.concat(*found))}).drop("_p_t", _HAS_DIGIT, *found)


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replace the union of the spans in ``text_col`` by ``[KIND]`` masks.

    Overlapping spans form one mask named after the first of them.
    """
    s, t = F.col(spans_col), F.col(text_col)
    # spans that begin after everything before them has ended open a mask
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fresh = F.array_append(F.array_append(
            acc["out"], F.substring(t, acc["pos"] + 1, x["start"] - acc["pos"])),
            F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"),
                        F.when((x["start"] >= acc["pos"]), fresh).otherwise(acc["out"]).alias("out"))

    df = sealed(df, {"_p_r": F.when(F.size(s) > 0, F.aggregate(s, start, add))})
    r = F.col("_p_r")
    text = F.when(r.isNull(), t).otherwise(F.concat(
        F.array_join(r["out"], ""), F.substring(t, r["pos"] + 1, F.length(t))))
    return sealed(df, {text_col: text}).drop("_p_r")


def digest(df: DataFrame) -> DataFrame:
    """The registered query's columns from :func:`find_pii`'s output."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *[count(k.name) for k in KINDS],
                     F.sha2(joined(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"),
                     joined(F.col("pii")).alias("spans"))


def oracle_sql() -> str:
    """DuckDB rendering: plain patterns, positions by sums over the pieces."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}",  # the heads
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    digit = f"(ascii(substr(reverse({digits}), i, 1)) - 48)"
    luhn = (f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END))")
    turned = "concat(substr(x, 5), substr(x, 1, 4))"
    as_number = (f"list_reduce(list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN "
                 "100 + ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, v: CASE WHEN v >= 100 THEN "
                 "(a * 100 + v - 100) % 97 ELSE (a * 10 + v) % 97 END, 0)")
    alone = "NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]')"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: try_cast(p AS HUGEINT))) <= 255 AND "
              "len(list_filter(string_split(m, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL)) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 14 AND 19 THEN {luhn} % 10 = 0 ELSE false END",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": "NOT regexp_matches(b, '[A-Za-z0-9]$')",
        "ssn": f"{alone} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND "
               r"(regexp_matches(b, '(?i)\b(ssn|social|security)\b') OR regexp_matches(a, '(?i)\b(ssn|social|security)\b'))",
    }
    parts = []
    for rank, (kind, pat) in enumerate(plain.items()):
        parts.append(f"""
  SELECT doc_id, r, s, {rank} AS k, '{kind}' AS kind, s + len(m) AS e
  FROM (SELECT doc_id, r, ms[i] AS m, right(ps[i], 40) AS b, left(ps[i + 1], 40) AS a,
               (list_sum(list_transform(ps[1:i], lambda x: len(x)))
                + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
        FROM (SELECT doc_id, r, ms, ps, unnest(range(1, len(ms) + 1)) AS i
              FROM (SELECT doc_id, r, regexp_extract_all(t, '{pat}') AS ms, regexp_split_to_array(t, '{pat}') AS ps
                    FROM d)))
  WHERE {valid[kind]}""")
    # Account numbers: every end before a space, or where the tail ends, that
    # passes; the country's own length first, then the longest; none inside another.
    lengths = ", ".join(f"('{x[:2]}', {x[2:]})" for x in IBAN_LENGTHS.split())
    tail = r"^((?:\x20?[A-Z0-9]){11,30}[A-Za-z0-9]?)"
    k = list(plain).index("iban")
    ibans = f"""
heads AS ({parts.pop(k)}),
tails AS (SELECT doc_id, r, s, substr(t, s + 1, 4) AS head,
                 string_split(regexp_extract(substr(t, s + 5, 80), '{tail}', 1), ' ') AS words FROM heads JOIN d USING (doc_id, r)),
ends AS (SELECT doc_id, r, s, head || array_to_string(words[1:n], ' ') AS m
         FROM (SELECT *, unnest(range(1, len(words) + 1)) AS n FROM tails)),
passed AS (SELECT doc_id, r, s, m, row_number() OVER (PARTITION BY r, s ORDER BY len(x) = own.n DESC NULLS LAST, len(m) DESC) AS place
           FROM (SELECT *, replace(m, ' ', '') AS x FROM ends) LEFT JOIN (VALUES {lengths}) own(c, n) ON own.c = left(m, 2)
           WHERE regexp_matches(m, '^[A-Z0-9 ]+$') AND CASE WHEN len(x) BETWEEN 15 AND 34 THEN {as_number} = 1 ELSE false END),
apart AS (SELECT doc_id, r, list_reduce(list([{{'s': s, 'e': s + len(m)}}] ORDER BY s), lambda a, x: CASE WHEN x[1].s >= a[len(a)].e
          THEN list_concat(a, x) ELSE a END) AS spans FROM passed WHERE place = 1 GROUP BY doc_id, r),"""
    parts.append(f"""
  SELECT doc_id, r, x.s, {k} AS k, 'iban' AS kind, x.e FROM (SELECT doc_id, r, unnest(spans) AS x FROM apart)""")
    counts = ", ".join(f"(count(*) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in plain)
    named = "string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),{ibans}
f AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts},
       sha256(coalesce({named} FILTER (k < 4), '')) AS base_sha256, coalesce({named}, '') AS spans
FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id"""
