"""Text and digest functions as column expressions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of a lexical query at most.
MOST_TERMS = 24
#: Characters from here on form words without spaces and are indexed by pairs.
WIDE = 0x2E80
#: Slots, saturation, length norm and average length of the hashed embedding.
SLOTS, K1, B, AVERAGE = 256, 1.2, 0.75, 24.0
#: Words that ask for fresh data.
FRESH_WORDS = ("最新", "现在", "目前", "当前", "实时", "此刻", "今天", "今日", "刚刚", "刚才")


def lex_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits; a run with a wide character, longer than one, by pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    wide = rf"[\x{{{WIDE:X}}}-\x{{10FFFF}}]"
    runs = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{Nd}]+)"))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(wide) & (F.char_length(t) > 1), pairs(t)).otherwise(F.array(t))))
    # most texts have no wide character, and no run of theirs is looked at twice
    return F.when(low.rlike(wide), cut).otherwise(runs)


def lex_text(text: Column) -> Column:
    return F.array_join(lex_tokens(text), " ")


def or_query(text: Column) -> Column:
    """The first terms, joined by a bar; null if there are none."""
    terms = F.slice(lex_tokens(text), 1, MOST_TERMS)
    return F.when(F.size(terms) > 0, F.array_join(terms, "|"))


def has_tokens(text: Column, wanted: str) -> Column:
    """Do all words of ``wanted`` occur? Exact tokens, lower-cased. A blank wish is always met."""
    words = sorted({w.lower() for w in wanted.split()})
    return F.size(F.array_except(F.array(*map(F.lit, words)), lex_tokens(text))) == 0 if words else F.lit(True)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def memory_hash(content: Column) -> Column:
    return sha256_hex(content)


def digit_slots(text: Column) -> Column:
    """Sorted runs of digits."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(\d+)")))


def slot_consistent(a: Column, b: Column) -> Column:
    return digit_slots(a) == digit_slots(b)


def model_tag(model: Column) -> Column:
    return F.when(model.isNull() | (F.trim(model) == ""), "none").otherwise(F.substring(F.sha2(F.trim(model), 256), 1, 8))


def is_fresh_sensitive(text: Column, words: tuple[str, ...] = FRESH_WORDS) -> Column:
    """Does the text contain any of the words, letter by letter?"""
    found = F.lit(False)
    for w in words:
        found = found | F.coalesce(text, F.lit("")).contains(w)
    return found


def java_hash(token: str) -> int:
    """The 31-polynomial over UTF-16 units, as a signed 32-bit number."""
    h = 0
    units = token.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h * 31 + (units[i] | units[i + 1] << 8)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def embed_terms(text: Column) -> Column:
    """Terms of the hashed embedding: of the trimmed, lower-cased text, runs of ASCII letters and digits, and every
    other character together with the one after it, if there is one. Characters count, not UTF-16 units."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.concat(F.regexp_extract_all(t, F.lit("([a-z0-9]+)")), F.regexp_extract_all(t, F.lit("(?s)(?=([^a-z0-9].?))[^a-z0-9]")))


def embed_tokens(tokens: list[str]) -> list[float]:
    """A unit vector of saturated term counts, hashed to slots. Zero if there are no tokens."""
    vector = [0.0] * SLOTS
    norm = K1 * (1 - B + B * len(tokens) / AVERAGE)
    for token, n in Counter(tokens).items():
        vector[java_hash(token) % SLOTS] += n * (K1 + 1) / (n + norm)
    length = sum(x * x for x in vector) ** 0.5
    return [x / length for x in vector] if length else vector


def bm25_embed(text: Column) -> Column:
    """The hashed embedding as a column. Its sums by slot can't be written as one expression without going over all
    terms for each of the slots, so terms are made in the JVM and the vector in an Arrow batch. ``bm25_entries`` needs
    no Python."""

    @F.pandas_udf("array<double>")
    def embed(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: embed_tokens(list(t)))

    return embed(embed_terms(text))


def bm25_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """The hashed embedding as rows (key, slot, x) of what isn't zero: two aggregates by key, in the JVM throughout."""
    terms = df.select(F.col(key), embed_terms(F.col(text)).alias("terms")).select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.first("dl").alias("dl"))
    # UTF-16 units, of which a character beyond the basic plane has two
    unit = lambda h, u: (h * 31 + u) % (1 << 32)
    far = lambda c: F.ascii(c) - 0x10000
    step = lambda h, c: F.when(F.ascii(c) < 0x10000, unit(h, F.ascii(c))).otherwise(unit(unit(h, F.shiftright(far(c), 10) + 0xD800), far(c) % 1024 + 0xDC00))
    code = F.aggregate(F.split("term", ""), F.lit(0).cast("long"), step)
    weight = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("dl") / AVERAGE))
    slots = counts.groupBy(key, (code % SLOTS).cast("int").alias("slot")).agg(F.sum(weight).alias("w"))
    whole = slots.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return slots.join(whole, key).select(key, "slot", (F.col("w") / F.col("norm")).alias("x"))


def usage_percent(chars: Column, threshold: int = 8000) -> Column:
    return F.least(F.lit(100), F.floor(chars * 100 / threshold)).cast("int")


def millis_of(col: Column, kind: str) -> Column:
    """Milliseconds since the epoch; columns without a zone are in UTC, whatever the session's zone is."""
    if kind != "timestamp_ntz":
        return F.unix_millis(col.cast("timestamp"))
    seconds = F.hour(col) * 3600 + F.minute(col) * 60
    return F.unix_date(col.cast("date")).cast("long") * 86_400_000 + seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), col) * 1000)


def normalize_scalar(col: Column, kind: str) -> Column:
    """Text of a value for comparison; instants are milliseconds since the epoch in UTC."""
    if kind.startswith("timestamp"):
        return millis_of(col, kind).cast("string")
    return col.cast("string")


def values_equal(a: Column, b: Column) -> Column:
    """Both null, equal as text, or equal as numbers: as doubles, and as decimals too where both are such."""
    as_double = a.try_cast("double") == b.try_cast("double")
    as_decimal = F.coalesce(a.try_cast("decimal(38,18)") == b.try_cast("decimal(38,18)"), F.lit(True))
    return a.eqNullSafe(b) | F.coalesce(as_double & as_decimal, F.lit(False))


def unwrap_json(text: Column) -> Column:
    """``["x"]`` as ``x``; anything else as it is."""
    return F.coalesce(F.when(text.startswith("["), F.get_json_object(text, "$[0]")), text)
