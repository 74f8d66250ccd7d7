"""Tokens, templates and their similarity as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.schema import VARIABLES

# What a whole token has to match, first hit wins.
HEURISTICS = [
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "LOI"),
    (r"\d+", "OBA"),
    (r"0x[0-9a-fA-F]+", "OID"),
    (r"[a-zA-Z0-9_-]+\d+", "OID"),
]
# Masks in their order.
MASKS = [(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"), (r"(?<=pid=)\d+", "<PID>"), (r"0x[0-9a-zA-Z]+", "<HEX>"), (r"\d+", "<NUM>")]
STATUS_WORDS = ("error", "warning", "info", "debug", "failed", "succeeded")
VARIABLE = f"<({'|'.join(VARIABLES)}|\\*)>"


def tokenize(message: Column) -> Column:
    """Words between blanks; none for a blank message, null for null."""
    return F.filter(F.split(F.trim(message), r"\s+"), lambda t: t != "")


def token_type(token: Column) -> Column:
    """The kind of variable a token is by the heuristics; null for a literal."""
    return reduce(lambda acc, h: acc.when(token.rlike(f"^(?:{h[0]})$"), h[1]), HEURISTICS[1:], F.when(token.rlike(f"^(?:{HEURISTICS[0][0]})$"), HEURISTICS[0][1]))


def extract_template(message: Column) -> Column:
    """The message with its variable tokens as <TYPE>."""
    return F.array_join(F.transform(tokenize(message), lambda t: F.coalesce(F.concat(F.lit("<"), token_type(t), F.lit(">")), t)), " ")


def variable_types(message: Column) -> Column:
    """param_{i}_{TYPE} -> TYPE for the variable tokens; i counts from 0."""
    typed = F.transform(tokenize(message), lambda t, i: F.struct(F.concat(F.lit("param_"), i.cast("string"), F.lit("_"), token_type(t)).alias("key"), token_type(t).alias("value")))
    return F.map_from_entries(F.filter(typed, lambda e: e["value"].isNotNull()))


def fallback_template(message: Column) -> Column:
    """Tokens that don't start with a letter as <OTHER_PARAMS>."""
    return F.array_join(F.transform(tokenize(message), lambda t: F.when(t.rlike(r"^[A-Za-z]"), t).otherwise("<OTHER_PARAMS>")), " ")


def is_variable(token: Column) -> Column:
    return token.rlike(VARIABLE)


def variable_positions(tokens: Column) -> Column:
    """0-based positions of the tokens that contain a variable."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(is_variable(t), i)), lambda i: i.isNotNull())


def extract_parameters(template: Column, message: Column) -> Column:
    """param_{i}_{TYPE} -> the message's whole token; empty if the token counts differ."""
    t, m = tokenize(template), tokenize(message)
    both = F.transform(t, lambda x, i: F.struct(F.concat(F.lit("param_"), i.cast("string"), F.lit("_"), F.regexp_extract(x, VARIABLE, 1)).alias("key"), F.get(m, i).alias("value"), x.alias("t")))
    picked = F.transform(F.filter(both, lambda e: is_variable(e["t"])), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.when(F.size(t) == F.size(m), F.map_from_entries(picked)).otherwise(F.create_map().cast("map<string,string>"))


def normalize_template(template: Column, typed_only: bool = False) -> Column:
    """Every <...> (or only those of known kinds) as <*>."""
    return F.regexp_replace(template, VARIABLE if typed_only else r"<[^>]+>", "<*>")


def mask(message: Column) -> Column:
    """Addresses, process ids, hex numbers and numbers as tags, in this order."""
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), MASKS, message)


def structural_key(message: Column) -> Column:
    """Tokens with brackets or separators, without a lower-case letter, or that are status words; else the first
    three. A blocking key, never a template."""
    t = tokenize(message)
    kept = F.filter(t, lambda x: x.rlike(r"[\[\]{}()=:/]") | ~x.rlike(r"[a-z]") | F.lower(x).isin(*STATUS_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.slice(t, 1, 3)), " ")


def event_type(template: Column) -> Column:
    up = F.upper(template)
    has = lambda *w: reduce(lambda a, b: a | b, [up.contains(x) for x in w])
    return F.when(has("ERROR", "FAIL"), "ERROR").when(has("WARN"), "WARNING").when(has("DEBUG"), "DEBUG").when(has("INFO"), "INFO").otherwise("UNKNOWN")


def column_name(name: Column) -> Column:
    """Letters, digits and _ only, lower case, not starting with a digit."""
    plain = F.regexp_replace(name, r"[^A-Za-z0-9]", "_")
    return F.lower(F.when(plain.rlike(r"^\d"), F.concat(F.lit("f_"), plain)).otherwise(plain))


def token_similarity(a: Column, b: Column) -> Column:
    """0.7 * common suffix / longer length + 0.3 * Jaccard of two token arrays; 0 if one is empty."""
    ra, rb = F.reverse(a), F.reverse(b)
    # The first place from the end where the two differ.
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(ra, i) != F.get(rb, i))
    suffix = F.coalesce(F.array_min(differ), n)
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(n <= 0, 0.0).otherwise(0.7 * suffix / F.greatest(F.size(a), F.size(b)) + 0.3 * jaccard)


def template_similarity(first: Column, second: Column) -> Column:
    """Share of common static tokens, with the second's multiplicity: 2 |{t in s2: t in s1}| / (|s1| + |s2|); it is
    not symmetric and may exceed 1. If neither has static tokens, the Jaccard of variable places: places i/n that
    are less than 0.1 apart are paired from left to right."""
    t1, t2 = tokenize(first), tokenize(second)
    s1, s2 = (F.filter(t, lambda x: ~is_variable(x)) for t in (t1, t2))
    shared = F.size(F.filter(s2, lambda x: F.array_contains(s1, x)))
    n1, n2 = F.size(t1), F.size(t2)
    place = F.sequence(F.lit(0), n1 - 1)

    def pair(acc: Column, i: Column) -> Column:
        low = F.greatest(acc["j"], F.floor((i / n1 - 0.1) * n2).cast("int") + 1)
        hit = (low < n2) & (low / n2 < i / n1 + 0.1)
        return F.struct(F.when(hit, low + 1).otherwise(low).cast("int").alias("j"), (acc["c"] + hit.cast("int")).alias("c"))

    paired = F.aggregate(place, F.struct(F.lit(0).alias("j"), F.lit(0).alias("c")), pair)["c"]
    places = F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(paired / (n1 + n2 - paired))
    return F.when((F.size(s1) == 0) & (F.size(s2) == 0), places).when((F.size(s1) == 0) | (F.size(s2) == 0), 0.0).otherwise(2.0 * shared / (F.size(s1) + F.size(s2)))


def template_match(first: Column, second: Column, threshold: float = 0.8) -> Column:
    """struct<type, score, matched, variables>: EXACT, SIMILAR, VARIABLE_ONLY or NO_MATCH, and 0-based positions."""
    t1, t2 = tokenize(first), tokenize(second)
    score = F.when(first == second, 1.0).otherwise(template_similarity(first, second))
    some = lambda t: F.size(variable_positions(t)) > 0
    kind = F.when(first == second, "EXACT").when(score >= threshold, "SIMILAR").when(some(t1) & some(t2), "VARIABLE_ONLY").otherwise("NO_MATCH")
    n = F.least(F.size(t1), F.size(t2))
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(t1, i) == F.get(t2, i)) | is_variable(F.get(t1, i)) | is_variable(F.get(t2, i)))
    return F.struct(kind.alias("type"), score.alias("score"), F.when(n > 0, places).otherwise(F.array().cast("array<int>")).alias("matched"), variable_positions(t1).alias("variables"))


def merged_template(first: Column, second: Column, threshold: float = 0.8) -> Column:
    """The template with fewer variables (the first on a tie) if the two match well enough, else null."""
    count = lambda t: F.size(variable_positions(tokenize(t)))
    fits = template_match(first, second, threshold)["type"].isin("EXACT", "SIMILAR")
    return F.when(fits, F.when(count(first) <= count(second), first).otherwise(second))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def number(text: Column) -> Column:
    """The text as a double if all of it is a number; null for anything else, NaN included."""
    ok = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(ok, F.trim(text).try_cast("double"))
