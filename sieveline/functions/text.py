"""String functions on columns; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weakness numbers with a name of their own.
NAMED_CWES = [20, 22, 77, 78, 79, 89, 119, 120, 121, 122, 124, 125, 126, 131, 134, 170, 189, 190, 191, 200, 252, 253, 254, 264, 269, 276, 284, 285, 287, 295, 310, 311, 327, 330, 362, 369, 399, 400, 401, 404, 415, 416, 434, 457, 476, 502, 617, 665, 703, 704, 732, 754, 772, 787]
#: Pieces of a C token: identifier, number, operators of two characters, any other sign.
C_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+\.?\d*|->|\+\+|--|==|!=|<=|>=|&&|\|\||::|[^\sA-Za-z0-9_]"
#: What counts as no weakness.
NO_CWE = ["none", "null", "n/a", "na", "-", "нет", ""]


def squash(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def bare_hash(c: Column) -> Column:
    """SHA-256 of a text without white space."""
    return F.sha2(F.regexp_replace(c, r"\s+", ""), 256)


def code_normal(c: Column) -> Column:
    """Code without comments, runs of white space as one blank."""
    without = F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.trim(F.regexp_replace(without, r"\s+", " "))


def code_md5(c: Column) -> Column:
    return F.md5(code_normal(c))


def split_identifiers(c: Column) -> Column:
    """Underscores as blanks, camelCase as words."""
    return F.regexp_replace(F.regexp_replace(c, "_", " "), "([a-z0-9])([A-Z])", "$1 $2")


def clip(c: Column, limit: int, notice: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(notice))).otherwise(c)


def trim_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a blank, with an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*$", ""), F.lit("..."))).otherwise(c)


def cwe_canonical(c: Column) -> Column:
    """``CWE-n`` from any notation: a number after the letters CWE, or a bare number at the start; else NULL."""
    text = F.trim(c.cast("string"))
    tagged = F.regexp_extract(text, r"(?i)cwe[\s_:-]*0*(\d+)", 1)
    bare = F.regexp_extract(text, r"^0*(\d+)(?:\.0)?$", 1)
    number = F.when(tagged != "", tagged).when(bare != "", bare)
    return F.when(F.lower(text).isin(NO_CWE), None).otherwise(F.concat(F.lit("CWE-"), number))


def cwe_is_named(c: Column) -> Column:
    return c.isin([f"CWE-{n}" for n in NAMED_CWES])


def c_tokens(c: Column, limit: int | None = None) -> Column:
    """C tokens of the whole text, or of its first ``limit`` characters where a model was fitted so."""
    return F.regexp_extract_all(F.substring(c, 1, limit) if limit else c, F.lit(C_TOKEN), F.lit(0))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def snippet(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text from ``around`` characters before ``start`` to ``around`` after ``end`` (0-based, half-open)."""
    low = F.greatest(start - around, F.lit(0))
    return F.substr(text, low + 1, end + around - low)


def occurrences(text: Column, needle: Column) -> Column:
    """(start, end) of every place where ``needle`` stands in ``text`` as a word of its own, 0-based and half-open; none for
    an empty needle, null for a null one or a null text."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    size = F.length(needle)
    ends = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + i * size)
    free = lambda s: ~F.substr(text, s, F.when(s > 0, 1).otherwise(0)).rlike(r"(?U)\w") & ~F.substr(text, s + size + 1, F.lit(1)).rlike(r"(?U)\w")
    at = F.transform(F.filter(ends, free), lambda s: F.struct(s.cast("long").alias("start"), (s + size).cast("long").alias("end")))
    return F.when(size > 0, at).when(size == 0, F.slice(at, 1, 0))


def extract_json(c: Column) -> Column:
    """The object in a model's answer: without fences, from the first to the last brace; null if that is no JSON."""
    got = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(got).isNotNull(), got)


def cell(c: Column, kind: str) -> Column:
    """A flat cell: lists joined, structs and maps as JSON, else text."""
    if kind.startswith("array<string"):
        return F.array_join(c, "; ")
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return c.cast("string")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def text_features(text: Column) -> dict[str, Column]:
    """Numeric features of one text, ASCII character classes; zeros for an empty or null one."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    share = lambda pattern: F.when(n > 0, count_matches(t, pattern) / n).otherwise(0.0)
    return {
        "char_len": n.cast("long"),
        "word_count": F.size(words).cast("long"),
        "avg_word_len": F.when(F.size(words) > 0, F.length(F.array_join(words, "")) / F.size(words)).otherwise(0.0),
        "non_ascii_ratio": share(r"[^\x00-\x7F]"),
        "digit_ratio": share(r"[0-9]"),
        "upper_ratio": share(r"[A-Z]"),
        "special_char_ratio": share(r"[!-/:-@\[-`{-~]"),
        "hex_run_count": count_matches(t, r"\b(?:0x)?[0-9a-fA-F]{16,}\b"),
        "has_code_block": F.contains(t, F.lit("```")).cast("int"),
        "curly_brace_ratio": share(r"[{}]"),
        "exclaim_count": count_matches(t, "!"),
        "url_count": count_matches(t, r"https?://\S+"),
        "zero_width_count": count_matches(t, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"),
    }


def entropies(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, entropy): Shannon entropy in bits over a text's characters; 0 for an empty or null one.

    Characters are counted per record before the shuffle, so it carries one row per record and distinct character.
    """
    chars = df.select(F.col(record).alias("r"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?s)."), F.lit(0))).alias("ch"))
    n = chars.groupBy("r", "ch").agg(F.count(F.lit(1)).alias("n")).groupBy("r").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    h = n.select(F.col("r").alias(record), (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))
    return df.select(record).join(h, record, "left").select(record, F.round(F.coalesce("entropy", F.lit(0.0)), 6).alias("entropy"))
