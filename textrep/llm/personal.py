"""Personal data in whole texts, with DataFrame functions only.

Patterns propose spans, checksums confirm them. Words shortly before or after a
span raise its score, words before it, back to the last match, lower it. Places come from the lengths of the pieces between the
matches. All patterns are possessive and start only where a run of their
characters starts, so a long run costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrep.llm.frames import free_name

_LOCAL = "A-Za-z0-9._%+-"
#: Lengths of bank account numbers by country: the registry of ISO 13616, and countries that use them without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM CY DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: Base kinds in the order of the result; the pattern of each finds the same leftmost matches as its plain form.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+(?<=[0-9])(?<!\+[0-9])",
    # Added by the method, after the base kinds.
    # Takes one letter and looks ahead at the number (group 1), so that no candidate hides a number that starts inside it.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN})(?![A-Za-z0-9]))[A-Z]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Characters before and after a span in which words count.
CONTEXT = 40
#: Texts are cut into parts of this many characters, so that a context costs no scan of the whole text.
PART = 256
#: Starting score, words that raise it by 0.4 and words that lower it by 0.4; spans of added kinds need 0.5.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
RAISE = {
    "email": "mail|contact|e-?mail",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|konto|transfer",
    "ssn": "ssn|social|security|sozial|insurance",
}
LOWER = {"email": "example", "ip": "version|release", "card": "order|serial|isbn", "phone": "order|serial", "iban": "serial|product", "ssn": "serial|part|order|version"}
NEEDED = 0.5


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "(?!^)(?=.)")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.struct(d.cast("int").alias("d"), (i % 2).alias("odd"))),
        F.lit(0),
        lambda n, x: n + F.when(x["odd"] == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a bank account number without blanks has the remainder 1, letters counting from 10."""
    turned = F.split(F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4)), "(?!^)(?=.)")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(turned, F.lit(0), lambda n, x: F.when(value(x) < 10, (n * 10 + value(x)) % 97).otherwise((n * 100 + value(x)) % 97)) == 1


def _confirmed(kind: str, span: Column) -> Column:
    digits = F.length(_digits(span))
    if kind == "ip":
        return span.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)){3}$")
    if kind == "card":
        return F.when(digits.between(16, 19), luhn(_digits(span))).otherwise(False)
    if kind == "phone":
        return digits.between(8, 15)
    if kind == "iban":
        return mod97(F.replace(span, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~span.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _found(kind: str, text: Column) -> tuple[Column, Column]:
    """Matches of a kind and the pieces before each of them; both empty without a hint.

    Candidates of ``iban`` may overlap: only their first letter parts the pieces.
    """
    none = F.array().cast("array<string>")
    tried = text.rlike(HINT[kind])
    matches = F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(int(kind == "iban")))).otherwise(none)
    pieces = F.when(tried, F.split(text, PATTERNS[kind], -1)).otherwise(none)
    return matches, pieces


def _part_of(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end``, less than ``PART`` apart, of a text in parts."""
    first = F.floor(start / PART).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, 2), ""), (start % PART + 1).cast("int"), (end - start).cast("int"))


def _spans(kind: str, matches: str, pieces: str, parts: str) -> Column:
    """Confirmed spans as structs of ``start``, ``end``, ``text`` and ``score``."""
    both = F.zip_with(F.col(matches), F.slice(F.col(pieces), 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string>>")
    taken = lambda x: F.lit(1) if kind == "iban" else F.length(x["m"])
    placed = F.aggregate(
        both,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("done")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + taken(x)).alias("at"),
            F.concat(
                acc["done"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["p"])).alias("start"),
                        (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                        x["m"].alias("text"),
                        F.right(x["p"], F.lit(CONTEXT)).alias("before"),
                    )
                ),
            ).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    holds = lambda text, words: F.lower(text).rlike(rf"\b(?:{words})")
    ahead = lambda s: _part_of(F.col(parts), F.greatest(s["start"] - CONTEXT, F.lit(0).cast("long")), s["start"])
    behind = lambda s: _part_of(F.col(parts), s["end"], s["end"] + CONTEXT)
    raised = lambda s: F.when(holds(ahead(s), RAISE[kind]) | holds(behind(s), RAISE[kind]), 0.4).otherwise(0.0)
    lowered = lambda s: F.when(holds(s["before"], LOWER[kind]), 0.4).otherwise(0.0)
    score = lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), START[kind] + raised(s) - lowered(s)))
    right = F.filter(placed, lambda s: _confirmed(kind, s["text"]))
    if kind == "iban":  # the first of those that overlap
        right = F.aggregate(right, empty, lambda acc, s: F.when(s["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)), F.concat(acc, F.array(s))).otherwise(acc))
    scored = F.transform(right, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score(s).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= NEEDED)


def find_personal(df: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``df`` with an array ``into`` of spans ``(kind, start, end, text, score)``, by kind and place.

    Places count code points from 0, the end is not included. Base kinds stay
    whatever their score, added kinds need ``NEEDED``. Null and empty texts
    have no spans.
    """
    out, made = df, []
    whole = F.coalesce(F.col(text), F.lit(""))
    for kind in PATTERNS:
        names = [free_name(df, f"_{kind}_{part}") for part in ("matches", "pieces")]
        made.append((kind, *names))
        out = out.withColumns(dict(zip(names, _found(kind, whole))))
    parts = free_name(df, "_parts")
    out = out.withColumn(parts, F.when(F.greatest(*(F.size(matches) for _, matches, _ in made)) > 0, F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))))
    spans = F.concat(*(F.when(F.size(matches) > 0, _spans(kind, matches, pieces, parts)).otherwise(F.array().cast(SPANS)) for kind, matches, pieces in made))
    return out.withColumn(into, spans).select(*df.columns, into)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span inside or across an earlier one is joined to it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                (-s["back"]).alias("at"),
                F.concat(
                    acc["parts"],
                    F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
                ).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def span_columns(spans: str) -> list[Column]:
    """Counts by base kind and the two digests of the spans."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(F.col(spans), lambda s: s["kind"].isin(*BASE))
    counted = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
    counts = [counted(kind).alias(f"n_{kind}") for kind in BASE]
    return [
        *counts,
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.col(spans), name), ",").alias("spans"),
    ]
