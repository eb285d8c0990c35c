"""Personal data, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for account numbers, ranges for
addresses), and words nearby adjust each span's score. Positions come from splitting a text at a pattern: the pieces'
and the matches' lengths add up, in code points. Sums are taken in blocks and contexts from the pieces next to a match, so
that the time for a text grows with its length and not with the square of its matches.

The four base kinds (email, ip, card, phone) are kept whatever their score; the further kinds (iban, ssn, secret) need
`LEAST`. The patterns are possessive and anchored where a run begins, so that they take time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, BEFORE, AFTER, BLOCK, PART = 0.6, 40, 20, 128, 4096
BASE = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # for Java: without needless backtracking
    plain: str  # the same matches, for other engines
    gate: str  # a text with a match has a match of this
    near: str  # words that raise the score
    score: float  # before context


#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: At its country's length where the number ends there, so that a word after it stays out; any run of 11 to 30 characters otherwise.
_IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Z0-9])"


#: In the order of the reports. Within a kind, matches are leftmost and do not overlap.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", "mail|contact|write", 0.8),
    Kind("ip", r"[0-9]++(?:\.[0-9]++){3}+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]", "ip|host|server|address", 0.6),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", r"[0-9](?:[ -]?[0-9]){15}", "card|visa|pay|credit", 0.7),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", 0.7),
    Kind("iban", _IBAN + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "iban|account|bank|konto|compte|cuenta", 0.7),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security", 0.4),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])", r"[0-9A-Fa-f]{32,}", r"[0-9A-Fa-f]{32}", "token|secret|key|passw|credential", 0.4),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the checksum?"""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.expr("array(0,2,4,6,8,1,3,5,7,9)")[c.try_cast("int")]).otherwise(c.try_cast("int"))),
        F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Is a code 1 modulo 97 with its first four characters moved to the end, A = 10 to Z = 35?"""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(_digits(match))
    return {
        "email": F.lit(True), "ssn": ~match.rlike("^(?:000|666|9)|-00-|-0000$"), "secret": match.rlike("[0-9]") & match.rlike("[A-Fa-f]"),
        "ip": match.rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": n.between(16, 19) & luhn(_digits(match)), "phone": n.between(8, 15), "iban": mod97(F.replace(match, F.lit(" "))),
    }[kind]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _before(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of numbers, the sum (or maximum, by join) of those before it, 0 at first: of the blocks before its own, and within that."""
    fold = lambda x: F.aggregate(x, F.lit(0), join)
    block = lambda i: (i / BLOCK).cast("int")
    totals = lambda x: F.transform(F.sequence(F.lit(0), block(F.size(x))), lambda c: fold(F.slice(x, c * BLOCK + 1, BLOCK)))
    tops = lambda x: _with(totals(x), lambda t: F.transform(t, lambda _, i: fold(F.slice(t, F.lit(1), i))))
    both = lambda x: F.struct(x.alias("x"), tops(x).alias("tops"))
    return _with(_with(xs, both), lambda v: F.transform(v["x"], lambda _, i: join(v["tops"][block(i)], fold(F.slice(v["x"], block(i) * BLOCK + 1, i % BLOCK)))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans_of(text: Column, kind: Kind, least: float) -> Column:
    """array<struct<kind, start, end, score>> of one kind: code points, end exclusive."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))

    def placed(v: Column) -> Column:
        lengths = F.transform(v["m"], lambda m, i: F.length(v["p"][i]) + F.length(m))
        return F.struct(v["m"].alias("m"), v["p"].alias("p"), _before(lengths, _sum).alias("at"))

    def around(v: Column, i: Column) -> Column:
        """The text near a match, from the pieces and matches on both sides: of each no more than can count, of matches (4 characters or more) so many that they suffice."""
        low, high = F.greatest(F.lit(0), i - BEFORE // 4), F.least(F.size(v["m"]), i + 1 + AFTER // 4)
        left = F.transform(F.sequence(low, i), lambda j: F.concat(F.when(j > low, F.right(v["m"][j - 1], F.lit(BEFORE))).otherwise(""), F.right(v["p"][j], F.lit(BEFORE))))
        right = F.transform(F.sequence(i + 1, high), lambda j: F.concat(F.left(v["p"][j], F.lit(AFTER)), F.when(j < F.size(v["m"]), F.left(v["m"][j], F.lit(AFTER))).otherwise("")))
        return F.concat(F.right(F.array_join(left, ""), F.lit(BEFORE)), F.lit(" "), F.left(F.array_join(right, ""), F.lit(AFTER)))

    def spans(v: Column) -> Column:
        start = lambda m, i: v["at"][i] + F.length(v["p"][i])
        good = F.filter(F.transform(v["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i"), start(m, i).alias("s"))), lambda x: _valid(kind.name, x["m"]))
        score = lambda x: F.round(F.lit(kind.score) + F.when(F.lower(around(v, x["i"])).rlike(kind.near), 0.2).otherwise(0.0), 2)
        return F.transform(good, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), score(x).alias("score")))

    found = _with(_with(found, placed), spans)
    if kind.name not in BASE:
        found = F.filter(found, lambda x: x["score"] >= least)
    return F.when(text.rlike(kind.gate), found).otherwise(empty)


def detect(text: Column, least: float = LEAST) -> Column:
    """All spans of a text, kind by kind: array<struct<kind, start, end, score>>. A null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(*(spans_of(text, k, least) for k in KINDS))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; spans that overlap are replaced together, by the kind of the first, and of those the longest. Null stays null.

    The text is cut into parts of `PART` code points, so that a place in it is found without reading the text from its start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def heads(order: Column) -> Column:
        reached = _before(F.transform(order, lambda s: -s["minus_end"]), _most)
        all_ = F.transform(F.arrays_zip(order.alias("s"), reached.alias("reached")), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["reached"].alias("reached")))
        return F.filter(all_, lambda x: x["start"] >= x["reached"])  # none before it reaches it

    def between(parts: Column, a: Column, b: Column) -> Column:
        at = lambda x: F.floor(x / PART).cast("int")
        first, last = (F.coalesce(F.get(parts, at(x)), F.lit("")) for x in (a, b))  # the end of a text of whole parts is past the last
        several = F.concat(F.substr(first, a % PART + 1), F.array_join(F.slice(parts, at(a) + 2, F.greatest(at(b) - at(a) - 1, F.lit(0))), ""), F.substr(last, F.lit(1), b % PART))
        return F.when(at(a) == at(b), F.substr(first, a % PART + 1, b - a)).otherwise(several)

    def joined(v: Column) -> Column:
        done = F.transform(v["heads"], lambda h: F.concat(between(v["parts"], h["reached"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        end = (F.size(v["parts"]) - 1) * PART + F.length(F.element_at(v["parts"], -1))  # for bytes that aren't UTF-8 not the text's own length
        rest = between(v["parts"], F.array_max(F.transform(v["order"], lambda s: -s["minus_end"])), end)
        return F.concat(F.array_join(done, ""), rest)

    laid = _with(order, lambda o: F.struct(o.alias("order"), heads(o).alias("heads"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}+"), F.lit(0)).alias("parts")))
    return F.when(F.size(spans) > 0, _with(laid, joined)).otherwise(text)


def find(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, pii (the spans). Repeated rows each give a row; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), detect(F.col("text"), least).alias("pii"))


def mask(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs' own rows and columns with the spans masked in `text`; n_chars, where there is one, is counted anew for changed texts."""
    if "text" not in docs.columns:
        raise ValueError("a text column is needed")
    new = masked(F.col("text"), detect(F.col("text"), least))
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(new.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(changed)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return find(docs).select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def _sql() -> str:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN [0,2,4,6,8,1,3,5,7,9][CAST(substr(reverse({digits}), i, 1) AS INT) + 1] ELSE CAST(substr(reverse({digits}), i, 1) AS INT) END)) % 10 = 0"
    code = "replace(m, ' ', '')"
    values = f"list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN CAST(c AS INT) ELSE ascii(c) - 55 END)"
    valid = {
        "email": "true", "ip": rf"regexp_full_match(m, '{part}(?:\.{part}){{3}}')", "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn_sql}", "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_prepend(0, {values}), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND NOT regexp_matches(p, '[0-9-]$') AND NOT regexp_matches(q, '^[0-9-]')",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]') AND NOT regexp_matches(p, '[A-Za-z0-9]$') AND NOT regexp_matches(q, '^[A-Za-z0-9]')",
    }
    arms = []
    for at, k in enumerate(KINDS):
        context = "" if k.name in BASE else f" AND round({k.score} + CASE WHEN regexp_matches(lower(substr(t, greatest(0, s - {BEFORE}) + 1, s - greatest(0, s - {BEFORE})) || ' ' || substr(t, e + 1, {AFTER})), '{k.near}') THEN 0.2 ELSE 0 END, 2) >= {LEAST}"
        arms.append(
            f"SELECT r, {at} AS o, '{k.name}' AS kind, s, e FROM (SELECT r, t, m, p, q, CAST(b + length(p) AS BIGINT) AS s, CAST(b + length(p) + length(m) AS BIGINT) AS e FROM (SELECT r, t, ms[i] AS m, ps[i] AS p, ps[i + 1] AS q, "
            f"coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b "
            f"FROM (SELECT r, t, regexp_extract_all(t, '{k.plain}') AS ms, string_split_regex(t, '{k.plain}') AS ps FROM d), unnest(range(1, len(ms) + 1)) u(i))) WHERE {valid[k.name]}{context}"
        )
    spans = "\nUNION ALL ".join(arms)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({spans}),\n"
        f"g AS (SELECT r, {counts}, {listed} FILTER (o < 4) AS base, {listed} AS spans, count(*) AS n_spans FROM f GROUP BY r)\n"
        f"SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN g USING (r)"
    )


SQL = _sql()
