"""Rules proposed from column names and types, and their violation predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import as_ts, col_of
from tidemark.operators.quality.checks import ANY, NUMBER, PATTERNS, TEXT, TIME, outside, trim_blank

# Warn and fail limits in percent of non-null rows.
RULE_LIMITS = {
    "email_validation": (1.0, 5.0),
    "ipv4_validation": (1.0, 5.0),
    "mac_validation": (1.0, 5.0),
    "non_empty": (1.0, 10.0),
    "not_future": (1.0, 5.0),
    "not_too_old": (1.0, 5.0),
    "latitude_range": (1.0, 5.0),
    "longitude_range": (1.0, 5.0),
    "port_range": (1.0, 5.0),
    "age_range": (1.0, 5.0),
    "non_negative": (1.0, 5.0),
    "percentage_range": (1.0, 5.0),
    "not_null": (1.0, 10.0),
}

MAC_PATTERN = r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"

# rule -> (column, as_of) -> violation predicate
RULES = {
    "email_validation": lambda c, now: ~c.rlike(PATTERNS["email"]),
    "ipv4_validation": lambda c, now: ~c.rlike(PATTERNS["ipv4"]),
    "mac_validation": lambda c, now: ~c.rlike(MAC_PATTERN),
    "non_empty": lambda c, now: trim_blank(c),
    "not_future": lambda c, now: c > as_ts(now),
    "not_too_old": lambda c, now: c < as_ts("2000-01-01"),
    "latitude_range": lambda c, now: outside(c, -90, 90),
    "longitude_range": lambda c, now: outside(c, -180, 180),
    "port_range": lambda c, now: outside(c, 1, 65535),
    "age_range": lambda c, now: outside(c, 0, 150),
    "non_negative": lambda c, now: c < 0,
    "percentage_range": lambda c, now: outside(c, 0, 100),
    "not_null": lambda c, now: c.isNull(),
}

#: Column types a rule can run on; numbers where none are named.
RULE_TYPES = {
    **dict.fromkeys(("email_validation", "ipv4_validation", "mac_validation", "non_empty"), TEXT),
    **dict.fromkeys(("not_future", "not_too_old"), TIME),
    "not_null": ANY,
}


def rule_fits(rule: str, dtype: T.DataType) -> bool:
    return rule in RULES and isinstance(dtype, RULE_TYPES.get(rule, NUMBER))

# Name families in order of precedence; the first whose word is in
# the name and whose kind fits the type decides.
FAMILIES = [
    ("string", ["email", "mail", "contact"], ["email_validation"]),
    ("string", ["ip", "ipaddr", "ip_address", "source_ip", "dest_ip"], ["ipv4_validation"]),
    ("string", ["mac", "mac_address"], ["mac_validation"]),
    ("numeric", ["port", "_port"], ["port_range"]),
    ("numeric", ["lat", "latitude"], ["latitude_range"]),
    ("numeric", ["lon", "lng", "longitude"], ["longitude_range"]),
    ("numeric", ["age"], ["age_range"]),
    ("numeric", ["percent", "percentage", "pct", "ratio", "rate", "completion"], ["percentage_range"]),
    ("numeric", ["amount", "price", "cost", "revenue", "salary", "balance", "fee"], ["non_negative"]),
    ("numeric", ["count", "total", "num", "quantity"], ["non_negative"]),
    ("temporal", ["timestamp", "created", "updated", "modified", "date", "time", "event_time", "_at"],
     ["not_future", "not_too_old"]),
]
# Words with "age" that are no ages, rules by kind alone, type names of a kind.
AGE_EXCEPT = ["cage", "page", "stage"]
TYPE_DEFAULTS = {
    "string": ["non_empty"],
    "numeric": ["non_negative"],
    "temporal": ["not_future", "not_too_old"],
}
KIND_WORDS = [
    ("string", ["string", "varchar", "char", "text"]),
    ("numeric", ["int", "long", "float", "double", "decimal", "numeric"]),
    ("temporal", ["timestamp", "date", "time"]),
]


def type_kind(type_name) -> Column:
    """string, numeric, temporal or null from a catalog's type name."""
    t = F.lower(col_of(type_name))
    ladder = F.lit(None).cast("string")
    for kind, words in reversed(KIND_WORDS):
        ladder = F.when(t.rlike("|".join(words)), kind).otherwise(ladder)
    return ladder


def _is_kind(type_name: Column, kind: str) -> Column:
    return F.lower(type_name).rlike("|".join(dict(KIND_WORDS)[kind]))


def rules_for(name, type_name, mode: str = "token") -> Column:
    """Array of rule names for a column given by name and type.

    ``as_written`` looks for a family word anywhere in the name, so "ip" also
    fires on "description". ``token`` (default) wants the word to be a whole part of
    the name between underscores, or its beginning for words of four letters or more.
    """
    n, t = F.lower(col_of(name)), col_of(type_name)

    def named(words: list[str]) -> Column:
        if mode == "as_written":
            return n.rlike("|".join(words))
        longer = [w for w in words if len(w.strip("_")) >= 4]
        exact = [w.strip("_") for w in words]
        pattern = "(^|[_.-])(" + "|".join(exact) + ")([_.-]|$)"
        if longer:
            pattern += "|(^|[_.-])(" + "|".join(w.strip("_") for w in longer) + ")"
        return n.rlike(pattern)

    def as_array(rules: list[str]) -> Column:
        return F.array(*[F.lit(r) for r in rules])

    out = F.when(_is_kind(t, "string"), as_array(TYPE_DEFAULTS["string"]))
    out = out.when(_is_kind(t, "numeric"), as_array(TYPE_DEFAULTS["numeric"]))
    out = out.when(_is_kind(t, "temporal"), as_array(TYPE_DEFAULTS["temporal"]))
    out = out.otherwise(F.array().cast("array<string>"))
    for kind, words, rules in reversed(FAMILIES):
        hit = named(words) & _is_kind(t, kind)
        if rules == ["age_range"]:
            hit = hit & ~n.rlike("|".join(AGE_EXCEPT))
        out = F.when(hit, as_array(rules)).otherwise(out)
    return out


def infer_rules(fields: DataFrame, mode: str = "token") -> DataFrame:
    """Catalog job: one row per field and proposed rule, with limits.

    The rule table is a CASE ladder that runs once for each distinct name and type; fields meet its
    rules by a join, so the work on texts does not grow with the fields that repeat them.
    """
    n, t = F.col("name"), F.col("type")
    known = fields.select(n.alias("_name"), t.alias("_type")).distinct().withColumn("_rules", rules_for("_name", "_type", mode))
    ruled = fields.join(known, n.eqNullSafe(F.col("_name")) & t.eqNullSafe(F.col("_type")))
    limits = F.create_map(*[x for r, (w, f) in RULE_LIMITS.items() for x in (F.lit(r), F.struct(F.lit(w).alias("warn"), F.lit(f).alias("fail")))])
    return (
        # outer, as Catalyst would else move the test for no rules, and with it the ladder, below the distinct
        ruled.select(*fields.columns, F.explode_outer("_rules").alias("rule"))
        .where(F.col("rule").isNotNull())
        .withColumn("_l", F.element_at(limits, F.col("rule")))
        .withColumns({"warn": F.col("_l.warn"), "fail": F.col("_l.fail")})
        .drop("_l")
    )


def schema_kind(data_type: T.DataType) -> str | None:
    """Kind of a Spark column, by type and not by the text of its name."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    return None


def schema_rules(df: DataFrame, mode: str = "token") -> list[tuple[str, str]]:
    """(column, rule) pairs for a table in hand, from its schema alone."""
    import re

    pairs = []
    for field in df.schema:
        kind, name = schema_kind(field.dataType), field.name.lower()
        chosen = TYPE_DEFAULTS.get(kind, [])
        for want, words, rules in FAMILIES:
            if want != kind:
                continue
            if mode == "as_written":
                hit = any(w in name for w in words)
            else:
                parts = re.split(r"[_.-]", name)
                plain = [w.strip("_") for w in words]
                hit = any(p in plain or any(len(w) >= 4 and p.startswith(w) for w in plain) for p in parts)
            if rules == ["age_range"] and any(x in name for x in AGE_EXCEPT):
                hit = False
            if hit:
                chosen = rules
                break
        pairs += [(field.name, rule) for rule in chosen]
    return pairs
