"""PII spans: patterns propose, checksums confirm, nearby context words adjust the score. DataFrame functions only.

Places are found without a row per match: splitting at a pattern and extracting it give gaps and matches in turn, whose lengths add up
to starts (code points, as ``length`` counts them). The patterns are written so that Java's engine neither rescans a run from each of its
places nor recurses on long ones; the matches equal those of the plain patterns in ``KINDS``.

Defined results. Null text: empty, no spans. Null doc_id: kept. Repeated rows: each on its own. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import require

#: The plain patterns of the base kinds, in the order of the digest.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_RUN = r"[0-9][0-9\x20-]{11,}[0-9]"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Words that make a kind likelier when they stand within CONTEXT code points, and the scores.
CONTEXT = 40
WORDS = {
    "email": "mail|e-mail|email|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
_FIELDS = "array<struct<start:int,value:string>>"


def _walk(text: Column, pattern: str, keep_gaps: bool = False) -> Column:
    """array<struct<start,value>> of the matches of ``pattern``, or of the gaps between them."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FIELDS).alias("out"))

    def step(acc, x):
        gap, end = F.length(x["g"]), F.coalesce(F.length(x["m"]), F.lit(0))
        if keep_gaps:
            more = F.array(F.struct(acc["at"].alias("start"), x["g"].alias("value")))
        else:
            more = F.when(x["m"].isNull(), F.array().cast(_FIELDS)).otherwise(F.array(F.struct((acc["at"] + gap).alias("start"), x["m"].alias("value"))))
        return F.struct((acc["at"] + gap + end).alias("at"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right, every second digit is doubled (less 9 if over 9); the sum must end in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise((F.try_to_number(d, F.lit("9")).cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def mod97(value: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: the number must leave 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)) == 1


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, email, ip, card, phone, iban (arrays of kind, start, end, score)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_FIELDS)
    has_digit = F.col("text").rlike("[0-9]")
    df = require(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    df = df.select(
        "doc_id",
        "text",
        F.when(F.contains("text", F.lit("@")), _walk(F.col("text"), _EMAIL)).otherwise(none).alias("email"),
        F.when(has_digit, _walk(F.col("text"), _IP)).otherwise(none).alias("ip"),
        F.when(has_digit, _walk(F.col("text"), _RUN)).otherwise(none).alias("runs"),
        F.when(F.contains("text", F.lit("+")), _walk(F.col("text"), _PHONE)).otherwise(none).alias("phone"),
        F.when(has_digit, _walk(F.col("text"), _IBAN)).otherwise(none).alias("iban"),
    )
    fits = lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False))
    ip = F.filter("ip", lambda x: F.forall(F.split(x["value"], r"\."), fits))
    pieces = F.flatten(F.transform("runs", lambda r: F.transform(_walk(r["value"], r"[\x20-]{2,}", True), lambda p: F.struct((r["start"] + p["start"]).alias("start"), p["value"].alias("value")))))
    between = lambda x, lo, hi: F.length(_digits(x["value"])).between(lo, hi)
    card = F.filter(pieces, lambda x: between(x, 13, 19) & luhn(_digits(x["value"])))
    df = df.select(
        "doc_id",
        "text",
        _spans("email", F.col("email")).alias("email"),
        _spans("ip", ip).alias("ip"),
        _spans("card", card).alias("card"),
        _spans("phone", F.filter("phone", lambda x: between(x, 9, 15))).alias("phone"),
        _spans("iban", F.filter("iban", lambda x: mod97(x["value"]))).alias("iban"),
    )

    def scored(kind: str) -> Column:
        def score(x):
            lo = F.greatest(x["start"] - CONTEXT, F.lit(0))
            near = F.concat(F.substring(F.col("text"), lo + 1, x["start"] - lo), F.lit(" "), F.substring(F.col("text"), x["end"] + 1, F.lit(CONTEXT)))
            bonus = F.when(F.lower(near).rlike(rf"\b(?:{WORDS[kind]})\b"), F.lit(0.2)).otherwise(F.lit(0.0))
            return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(SCORES[kind]) + bonus, F.lit(1.0)).alias("score"))

        return F.transform(kind, score).alias(kind)

    return df.select("doc_id", *[scored(k) for k in WORDS])


def joined(*kinds: str) -> Column:
    """All spans of the kinds as kind:start:end, comma-joined."""
    parts = F.concat(*[F.col(k) for k in kinds])
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scores(*kinds: str) -> Column:
    """The scores of all spans of the kinds, with two decimals, in the order of ``joined``."""
    return F.array_join(F.transform(F.concat(*[F.col(k) for k in kinds]), lambda x: F.format_number(x["score"], 2)), ",")
