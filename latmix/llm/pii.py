"""Personal data: regular expressions propose, checksums confirm, context words adjust a score.

Kinds: email, ip, card (Luhn), phone, and iban (mod 97), which the base list lacks. Each confirmed
span carries a score: a prior by kind, raised if a context word of its kind, a whole one in either
case, stands within WINDOW code points before it and after the proposal of its kind before it. The score never removes a span of the base list.

One pass over the table, no shuffle, only built-in functions. The patterns are written so that the
regular-expression engine neither retries a run from inside nor recurses once per repetition; they
match exactly what the plain forms in the comments match.

Null or empty text: no spans. Repeated rows: each gets its spans. An empty table: no rows. Other
columns stay as they are; of one called ``pii`` the spans take the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, text_or_empty
from .spans import by_kind, joined, matches

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
KINDS = ("email", "ip", "card", "phone", "iban")
WINDOW = 40
#: kind: prior, gain of a context word, context words
SCORES = {
    "email": (0.9, 0.1, "e?mails?|mailto|contact|write"),
    "ip": (0.6, 0.3, "ip|ipv4|address|server|hosts?"),
    "card": (0.7, 0.3, "cards?|visa|credit|pay|paid|payment"),
    "phone": (0.6, 0.3, "phones?|telephone|call|tel|mobile|fax"),
    "iban": (0.8, 0.2, "iban|accounts?|bank"),
}


def context_words(kind: str) -> str:
    """A context word of the kind in lower-cased text that begins with a code point more."""
    return f"[^a-z0-9](?:{SCORES[kind][2]})(?:[^a-z0-9]|$)"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    split = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(split, lambda d, i: F.when(i % 2 == 1, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)).otherwise(d.cast("int"))),
        F.lit(0).cast("long"),
        lambda a, x: a + x.cast("long"),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's letters and digits leave 1 by 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c >= "A", (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    return rest == 1


def _ok(kind: str, hit: Column) -> Column:
    if kind == "ip":
        # leading zeros count for nothing; longer numbers are too large whatever they are
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(digits(hit))
        return F.when((n >= 13) & (n <= 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column ``pii``: array<struct<order,start,stop,kind,score>>, by kind and start."""
    t = text_or_empty(text)
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}

    def part(order: int, kind: str) -> Column:
        prior, gain, _ = SCORES[kind]

        def scored(m):
            score = F.lit(prior) + F.when(F.lower(m["before"]).rlike(context_words(kind)), gain).otherwise(0.0)
            return F.struct(F.lit(order).alias("order"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), score.alias("score"))

        return F.transform(F.filter(matches(t, patterns[kind], context=WINDOW), lambda m: _ok(kind, m["hit"])), scored)

    return docs.withColumn("pii", F.array_sort(F.concat(*(part(i, k) for i, k in enumerate(KINDS)))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:4]),
        F.sha2(joined(by_kind(base)), 256).alias("base_sha256"),
        joined(by_kind(F.col("pii"))).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


def _oracle() -> str:
    def part(kind, order, pattern, ok, proposed="true"):
        prior, gain, _ = SCORES[kind]
        return f"""
        SELECT rid, '{kind}' AS kind, {order} AS ord, s AS start, s + length(h) AS stop,
               {prior}::DOUBLE + CASE WHEN regexp_matches(lower(CASE WHEN length(g) > {WINDOW} THEN right(g, {WINDOW + 1}) ELSE ' ' || g END), '{context_words(kind)}') THEN {gain}::DOUBLE ELSE 0 END AS score
        FROM (SELECT rid, h, s, substr(t, last + 1, s - last) AS g
              FROM (SELECT rid, t, h, s, coalesce(lag(s + length(h)) OVER (PARTITION BY rid ORDER BY s), 0) AS last
                    FROM (SELECT rid, t, hits[i] AS h, list_sum([length(p) FOR p IN gaps[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0)::BIGINT AS s
                          FROM (SELECT rid, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
                                FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)))
                    WHERE {proposed}))
        WHERE {ok}"""

    num = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn_sql = f"""list_sum([CASE WHEN k % 2 = 0 THEN substr(reverse({num}), k::INT, 1)::INT * 2 % 10 + substr(reverse({num}), k::INT, 1)::INT * 2 // 10
                   ELSE substr(reverse({num}), k::INT, 1)::INT END FOR k IN range(1, length({num}) + 1)]) % 10 = 0"""
    iban = "substr(h, 5) || substr(h, 1, 4)"
    mod_sql = f"""list_reduce(list_prepend(0, [CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END FOR c IN string_split({iban}, '')]),
                  lambda a, v: CASE WHEN v >= 10 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"""
    ip_ok = "len([p FOR p IN string_split(h, '.') IF length(ltrim(p, '0')) > 3 OR ('0' || left(ltrim(p, '0'), 3))::INT > 255]) = 0"
    parts = [
        part("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        part("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ip_ok),
        part("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({num}) BETWEEN 13 AND 19 AND {luhn_sql}"),
        part("phone", 3, PHONE, f"length({num}) BETWEEN 9 AND 15"),
        # RE2 has no look-around: whole runs of letters and digits, of which those in the right shape stay
        part("iban", 4, "[A-Za-z0-9]+", mod_sql, "regexp_full_match(h, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')"),
    ]
    count = lambda k: f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT rid, {", ".join(map(count, KINDS[:4]))},
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (kind <> 'iban') AS base,
                 string_agg(format('{{:.1f}}', score), ',' ORDER BY ord, start) AS scores FROM s GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
    FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op8_pii": op8_pii}
ORACLE = {"op8_pii": _oracle()}
