"""Operator 9: personal data, by DataFrame functions alone.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), whole words near a
span, before or after it, adjust its score. Places come from marking the matches: a text is split at its marks and the lengths
of the parts are summed up, in runs of 64 so that a text with many matches costs no square.

Patterns are possessive and anchored at the start of a run of their characters (or at the last match's
end), which finds the same leftmost matches without trying every place of a long run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes it, what confirms it, and what its surroundings add."""

    name: str
    pattern: str
    guard: str
    score: float
    words: str
    valid: str = "true"
    base: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn: from the right, every second digit counts twice, less nine if over nine; ten divides the sum.
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
    f"(int(substr(reverse({_DIGITS}), i, 1)) * if(i % 2 = 0, 2, 1) - if(i % 2 = 0 AND substr(reverse({_DIGITS}), i, 1) >= '5', 9, 0))) % 10 = 0"
)
_IBAN = "regexp_replace(m, ' ', '')"
#: Mod 97: country and check digits go last, letters count 10 to 35; the remainder is 1.
_MOD97 = (
    f"aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (a, c) -> "
    "CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
)

#: How long the IBANs of each country are.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_COUNTRY = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Of a known country by its length, so that capitals and digits after it are no part of it; else the whole run, up to such a one.
_IBAN_PATTERN = rf"(?<![A-Za-z0-9])(?:{_OF_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?:(?! {_OF_COUNTRY}) ?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))"

KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         "mail|email|e-mail|contact|write", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|addresses|host|server|servers",
         r"m rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]|$)){4}$'", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.7, "card|cards|visa|credit|pay|payment",
         f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|telephone|tel|call|mobile",
         f"length({_DIGITS}) BETWEEN 9 AND 15", base=True),
    Kind("iban", _IBAN_PATTERN, "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank",
         f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, "ssn|social|security",
         "m NOT rlike '^(?:000|666|9)|-00-|-0000$'"),
    Kind("secret", r"(?i)(?<![a-z0-9])(?:token|secret|password|api_key)\s{0,3}[=:]\s{0,3}[\x22']?[a-z0-9_+/-]{16,}+",
         "[=:]", 0.6, "token|secret|password|key"),
)
_EMPTY = "cast(array() AS array<bigint>)"
_MARK, _END = "\u0001", "\u0002"


def _running(lengths: str, at: str) -> str:
    return (
        f"aggregate({lengths}, named_struct('at', {at}, 'out', {_EMPTY}), "
        "(a, x) -> named_struct('at', a.at + x, 'out', array_append(a.out, a.at)), a -> a.out)"
    )


def find_pii(
    docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5, near: int = 40,
) -> DataFrame:
    """Add ``pii`` (replaced if there): array of kind, start, end, score, base, sorted by start, then kind.

    Places count code points, end exclusive. Base kinds are kept as their pattern and check give them; of
    the others those with ``threshold`` or more that overlap no base span. A whole word of the kind within
    ``near`` characters before or after a span (up to the next span of its kind) adds 0.2 to its score. A null or empty text has no spans. All rows and
    other columns are returned as they came.
    """
    keep = [c for c in docs.columns if c != "pii"]
    df = docs.select(F.struct(*keep).alias("row"), F.translate(F.coalesce(F.col(text), F.lit("")), _MARK + _END, "\u0003\u0003").alias("body"))
    names = [k.name for k in kinds]
    steps = [
        {f"{k.name}_p": F.when(F.col("body").rlike(k.guard), F.split(F.regexp_replace("body", k.pattern, f"{_MARK}$0{_END}"), _MARK, -1)) for k in kinds},
        {f"{n}_p": F.when(F.size(f"{n}_p") > 1, F.col(f"{n}_p")) for n in names},
        {f"{n}_l": F.expr(f"transform({n}_p, (p, i) -> cast(length(p) - if(i > 0, 1, 0) AS bigint))") for n in names},
        {f"{n}_s": F.expr(f"transform(sequence(0, int((size({n}_l) - 1) div 64)), c -> aggregate(slice({n}_l, c * 64 + 1, 64), 0L, (a, x) -> a + x))") for n in names},
        {f"{n}_b": F.expr(_running(f"{n}_s", "0L")) for n in names},
        {f"{n}_at": F.expr(f"flatten(transform({n}_b, (b, c) -> {_running(f'slice({n}_l, c * 64 + 1, 64)', 'b')}))") for n in names},
        {f"{k.name}_m": F.expr(
            f"filter(transform({k.name}_at, (at, i) -> named_struct('at', at, 'm', substring_index({k.name}_p[i], '{_END}', 1), "
            f"'near', if(i = 0, '', concat_ws(' ', right(substring_index({k.name}_p[i - 1], '{_END}', -1), {near}), "
            f"left(substring_index({k.name}_p[i], '{_END}', -1), {near}))), 'i', i)), x -> x.i > 0)") for k in kinds},
    ]
    for step in steps:
        df = df.select("row", *[c for c in df.columns if c != "row" and c not in step], *[v.alias(k) for k, v in step.items()])
    spans = {}
    for order, k in enumerate(kinds):
        ok = f"exists(array(x.m), m -> {k.valid})"
        score = f"round({k.score} + if(lower(x.near) rlike '(?<![a-z])(?:{k.words})(?![a-z])', 0.2, 0), 2)"
        spans[k.name] = F.expr(
            f"coalesce(transform(filter({k.name}_m, x -> {ok}), x -> named_struct('start', x.at, 'place', {order}, 'kind', '{k.name}', "
            f"'end', x.at + length(x.m), 'score', double({score}), 'base', {str(k.base).lower()})), "
            "cast(array() AS array<struct<start:bigint,place:int,kind:string,end:bigint,score:double,base:boolean>>))")
    df = df.select("row", F.concat(*[spans[k.name] for k in kinds if k.base]).alias("sure"),
                   F.concat(*[spans[k.name] for k in kinds if not k.base], F.expr("cast(array() AS array<struct<start:bigint,place:int,kind:string,end:bigint,score:double,base:boolean>>)")).alias("more"))
    extra = F.filter("more", lambda x: (x["score"] >= threshold) & ~F.exists("sure", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    found = F.transform(F.array_sort(F.concat("sure", extra)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["base"].alias("base")))
    return df.select("row", found.alias("pii")).select(*[F.col("row")[c].alias(c) for c in keep], "pii")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with each span of ``pii`` replaced by [KIND]; of overlapping spans the first one counts."""
    cut_at = F.aggregate(
        "pii", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(a["out"], F.substring(F.col(text), a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))),
    )
    return docs.withColumn("_cut", cut_at).withColumn(
        text, F.when(F.size("pii") > 0, F.concat("_cut.out", F.expr(f"substring({text}, int(_cut.at) + 1)"))).otherwise(F.col(text))
    ).drop("_cut")
