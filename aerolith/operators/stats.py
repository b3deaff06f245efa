"""Corpus statistics: counts, shares, keyword presence, field coverage, token templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words counted in texts.
KEYWORDS = (
    "PDC CLEARANCE CLEARED CLRD POSITION POSN POS ETA ETD ETO WAYPOINT DIRECT DCT METAR TAF ATIS WIND TEMP QNH DEPARTURE ARRIVAL LANDING TAKEOFF "
    "GATE TAXI PUSHBACK ROUTE VIA FILED FUEL FOB WEIGHT LOAD FREQ CONTACT SELCAL SQUAWK XPNDR FLIGHT FLT"
).split()
# Record keys that are not fields, token words kept as they are, and token classes in order.
METADATA = ("message_id", "timestamp", "raw_text", "parse_confidence")
LITERALS = (
    "PDC CLRD CLEARED TO VIA OFF RWY RUNWAY SID DEP SQUAWK XPNDR FREQ ATIS CLIMB MAINTAIN EXPECT CONTACT FROM AT ON FOR WITH POS POSITION ETA ETD ROUTE DIRECT DCT ALT FL"
).split()
TOKENS = (
    ("<FREQ>", r"\d{2,3}\.\d{1,3}"),
    ("<TIME>", r"[0-2]\d[0-5]\d"),
    ("<SQWK>", r"[0-7]{4}"),
    ("<FL>", r"FL\d{2,3}"),
    ("<RWY>", r"\d{1,2}[LCR]?"),
    ("<ICAO>", r"[A-Z]{4}"),
    ("<FLIGHT>", r"[A-Z]{2,3}\d{1,4}[A-Z]?"),
    ("<TAIL>", r"[A-Z]{1,2}-?[A-Z]{0,3}\d{1,5}[A-Z]{0,2}"),
    ("<ACFT>", r"[A-Z]\d{2,3}[A-Z]?"),
    ("<NUM>", r"\d+"),
    ("<WPT5>", r"[A-Z]{5}"),
    ("<CODE>", r"[A-Z]{3,4}"),
    ("<ALNUM>", r"[A-Z0-9]{6,}"),
)


def parsed(column: str = "parser_type") -> Column:
    """Whether a row was parsed: its type is neither missing nor a stand-in."""
    return F.coalesce(~F.col(column).isin("", "unparsed"), F.lit(False))


def type_name(column: str = "parser_type") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unparsed"))


def summary(log: DataFrame) -> DataFrame:
    """Totals, parse rate and distinct labels and types, in one pass."""
    return log.agg(
        F.count("*").alias("total_messages"),
        F.count_if(parsed()).alias("parsed_messages"),
        F.count_if(~parsed()).alias("unparsed_messages"),
        F.round(100.0 * F.count_if(parsed()) / F.count("*"), 6).alias("parse_rate"),
        F.countDistinct("label").alias("unique_labels"),
        F.countDistinct(F.when(parsed(), F.col("parser_type"))).alias("unique_parser_types"),
    )


def distribution(log: DataFrame, key: Column, name: str) -> DataFrame:
    """Count and percentage of each value; the total is a sum over the few counted rows."""
    counted = log.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(name, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percentage"))  # one row


def label_parse_rates(log: DataFrame, top: int = 3) -> DataFrame:
    """Per label: totals, parse rate and its most frequent parsers as `type(count)`."""
    by_type = log.groupBy("label", type_name().alias("kind")).agg(F.count("*").alias("n"))
    rank = Window.partitionBy("label").orderBy(F.desc("n"), "kind")
    best = by_type.where("kind <> 'unparsed'").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top)
    names = best.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.format_string("%s(%d)", "kind", "n").alias("name")))), lambda x: x["name"]), ", ").alias("top_parsers"))
    totals = by_type.groupBy("label").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("kind") != "unparsed", F.col("n")).otherwise(0)).alias("parsed"))
    return totals.join(names, "label", "left").select("label", "total", "parsed", (F.col("total") - F.col("parsed")).alias("unparsed"), F.round(100.0 * F.col("parsed") / F.col("total"), 6).alias("parse_rate"), F.coalesce("top_parsers", F.lit("")).alias("top_parsers"))


def missing_counts(log: DataFrame, column: str = "missing_fields") -> DataFrame:
    names = log.select(F.explode(F.split(column, ",")).alias("field")).select(F.trim("field").alias("field")).where("field <> ''")
    return names.groupBy("field").agg(F.count("*").alias("n"))


def keyword_presence(log: DataFrame, keywords: list[str] = KEYWORDS) -> DataFrame:
    """For each label the texts that contain each keyword, counted without exploding: one conditional count a word."""
    upper = F.upper("raw_text")
    counted = log.where("raw_text IS NOT NULL").groupBy("label").agg(F.count("*").alias("total"), *[F.count_if(upper.contains(k)).alias(k) for k in keywords])
    long = counted.select("label", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(k).alias("n")) for k in keywords])).alias("x")).select("label", "total", "x.*")
    return long.where("n > 0").select("label", "keyword", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percentage"))


def field_coverage(log: DataFrame, column: str = "parsed_json") -> DataFrame:
    """For each parser type, how often each field of its records is filled; empty texts, zeros, empty arrays and nulls count as missing."""
    rows = log.where(parsed() & F.try_parse_json(column).isNotNull())
    total = rows.groupBy("parser_type").agg(F.count("*").alias("total"))
    fields = rows.select("parser_type", F.explode(F.from_json(column, "map<string,string>")).alias("field", "value")).where(~F.col("field").isin(*METADATA))
    number = F.col("value").try_cast("double")
    empty = F.col("value").isNull() | F.col("value").isin("", "[]") | F.coalesce(number == 0, F.lit(False))
    counted = fields.groupBy("parser_type", "field").agg(F.count_if(~empty).alias("present"), F.count_if(empty).alias("missing"))
    return counted.join(F.broadcast(total) if total.limit(10_001).count() <= 10_000 else total, "parser_type").select("parser_type", "field", "present", "missing", F.round(100.0 * F.col("present") / F.col("total"), 6).alias("percentage"))


def token_class(token: Column) -> Column:
    out = F.when(token.isin(*LITERALS), token)
    for name, pattern in TOKENS:
        out = out.when(token.rlike(rf"\A(?:{pattern})\z"), F.lit(name))
    return out.when(F.octet_length(token) <= 2, token).otherwise(F.lit("<OTHER>"))


def template(text: Column) -> Column:
    """The text with each token replaced by its class; lines are joined by ' | '."""
    blank = "[ \\t\\f\\r\\x0b]+"
    lines = F.filter(F.transform(F.split(F.upper(text), "\n"), lambda line: F.regexp_replace(line, f"\\A{blank}|{blank}\\z", "")), lambda line: line != "")
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(F.split(line, blank), token_class), " ")), " | ")


def template_histogram(log: DataFrame, top: int = 10, least: int = 10) -> DataFrame:
    """Per label its most frequent templates, each with the text of the first message that has it."""
    counted = log.where("raw_text IS NOT NULL AND raw_text <> ''").groupBy("label", template(F.col("raw_text")).alias("template")).agg(F.count("*").alias("n"), F.min_by("raw_text", "delivery_id").alias("example"))
    rank = Window.partitionBy("label").orderBy(F.desc("n"), "template")
    every = Window.partitionBy("label")
    ranked = counted.withColumn("total", F.sum("n").over(every)).withColumn("unique_templates", F.count("*").over(every)).withColumn("place", F.row_number().over(rank))
    short = F.translate("example", "\n\t", "  ")
    example = F.when(F.octet_length("example") > 100, F.concat(F.substring(short, 1, 100), F.lit("..."))).otherwise(short)
    return ranked.where((F.col("place") <= top) & (F.col("total") >= least)).select("label", "total", "unique_templates", F.col("place").cast("long").alias("place"), "template", "n", example.alias("example"))


def suggested_regex(pattern: str) -> tuple[str, list[str]]:
    """A regular expression with numbered named groups for a template, and the groups' names."""
    import re

    forms = dict(TOKENS) | {"<OTHER>": r"\S+"}
    names: list[str] = []
    lines = []
    for line in pattern.split(" | "):
        parts = []
        for token in line.split(" "):
            if token in forms:
                base = token.strip("<>").lower()
                names.append(base if base not in names else f"{base}_{sum(n == base or n.startswith(base + '_') for n in names) + 1}")
                parts.append(f"(?P<{names[-1]}>{forms[token]})")
            else:
                parts.append(re.escape(token))
        lines.append(r"\s+".join(parts))
    return r"\s*\n\s*".join(lines), names


def hit_rate(log: DataFrame, pattern: str, column: str = "raw_text", examples: int = 5) -> DataFrame:
    """How many texts match a pattern, and the first ids that do and that don't."""
    hit = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    ids = lambda mask: F.array_join(F.slice(F.sort_array(F.collect_set(F.when(mask & (F.col("place") <= examples), F.col("delivery_id")))), 1, examples).cast("array<string>"), ",")
    rows = log.select("delivery_id", hit.alias("hit"))
    counts = rows.agg(F.count("*").alias("total"), F.count_if("hit").alias("matches"))
    # Only the smallest ids of each side are sorted: two top-k queries.
    first = reduce(DataFrame.unionByName, [rows.where(F.col("hit") == side).orderBy("delivery_id").limit(examples) for side in (True, False)]).withColumn("place", F.lit(0))
    samples = first.agg(ids(F.col("hit")).alias("matching_ids"), ids(~F.col("hit")).alias("other_ids"))
    return counts.crossJoin(F.broadcast(samples)).select("total", "matches", F.round(100.0 * F.col("matches") / F.col("total"), 6).alias("rate"), "matching_ids", "other_ids")
