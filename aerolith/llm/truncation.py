"""Problem 7: texts that lost their end, by a trie of the corpus vocabulary.

Texts are cut into lexemes (whole words, runs of digits as their length, `912` for twelve, single signs).
For each kind of text the corpus gives a trie: under a context of two lexemes, how
often a text stops at a lexeme (`ends`), and how often it goes on, be it with a
further lexeme (`goes`) or because a longer lexeme begins with it (`longer`: the
lexeme is a proper prefix of known words). A text is whole if its last lexeme is
one at which texts of its kind stop, ends / (ends + goes + longer) >= STOP; a last
lexeme that is an unknown proper prefix of known words, or one that is known but
is always followed by more, marks a cut. Contexts seen too rarely back off to one
lexeme of context and the shape of the last (`A5` for five letters), then to two
shapes. Kinds whose texts end anyhow (usual endings cover less than REGULAR of
them) are flagged only on positive evidence: an unknown proper prefix as the last
word, or a text that is as long as the field of its source, where lengths pile up,
and ends without a closing sign.

Each decision names its evidence. The method's first part alone, an unknown proper
prefix of known words as the last word, can't see texts cut behind a whole word or
inside a number, which most cuts are; hence the counts of stops in the trie.

Texts that carry a checksum are decided by it: binary payloads (the CRC over the
ten characters of message identifier and registration and the payload) and flight
plans with /WD (the CRC over the text without its last four digits). #M1 without
#MD is a cut.

Defined results: null, empty and blank texts are no cases, nor are rows whose id is
0 or null, though their texts count in the statistics; blanks at the ends of a
text are ignored; null sources and kinds are kinds of their own. Equal rows are
decided alike. Empty tables give empty results. Whole texts are read.
"""

from __future__ import annotations

import binascii
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.sources.tables import spread

STOP = 0.15
REGULAR = 0.5
SEEN = 10  # a context with fewer occurrences backs off
ENDS = 3
SHARE = 0.0003  # endings with at least this share of their kind's texts, so at most 3,334 a kind, are broadcast
FLUSH = 200_000

_lexeme = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_binary = re.compile(r"/([A-Z0-9]{4,7})\.([A-Z]{2,3}[0-9])\.(.+)", re.S)
GOOD = 0x1D0F  # fixed value: the CRC's residue over data with their checksum


def lexemes(text: str) -> list[str]:
    return [f"9{len(w)}" if w[0].isdigit() else w for w in _lexeme.findall(text)]


def context(lexeme: str) -> str:
    """A lexeme as context of the next: there, runs of seven digits and more are alike, as it is complete."""
    return "97" if len(lexeme) > 1 and lexeme[0] == "9" and int(lexeme[1:]) > 7 else lexeme


def shape(lexeme: str) -> str:
    return f"A{len(lexeme)}" if lexeme[:1].isalpha() else lexeme


def checksum(text: str) -> bool | None:
    """True or False where the text carries a checksum or a part mark, None where it does not."""
    if "FPN" in text:
        if "#M1" in text and "#MD" not in text:
            return False
        if "/WD" in text:
            return bool(re.fullmatch("[0-9A-Fa-f]{4}", text[-4:])) and binascii.crc_hqx(text[:-4].encode() + bytes.fromhex(text[-4:]), 0xFFFF) == GOOD
    if m := _binary.fullmatch(text):
        rest = m[3].upper()
        usual = (6, 5, 7, 8)  # lengths of registrations in the order in which they are tried, then those that a checksum of ten characters can hold
        for n in (*usual, *(n for n in range(1, 5) if n not in usual)):
            registration, payload = rest[:n], rest[n:]
            if len(payload) >= 4 and len(payload) % 2 == 0 and re.fullmatch("[0-9A-F]+", payload):
                head = m[2] + f".{registration}".ljust(7)[:7]
                if len(head) == 10 and binascii.crc_hqx(head.encode() + bytes.fromhex(payload), 0xFFFF) == GOOD:
                    return True
        return False
    return None


def _base(messages: DataFrame, columns: dict[str, str]) -> DataFrame:
    c = {k: F.col(f"`{v}`") for k, v in columns.items()}
    return messages.select(
        c["delivery"].cast("bigint").alias("delivery_id"),
        c["id"].cast("bigint").alias("id"),
        c["source"].cast("string").alias("source"),
        F.coalesce(F.nullif(c["kind"], F.lit("")), F.lit("text")).alias("kind"),
        c["text"].cast("string").alias("text"),
    ).where(F.regexp_like("text", F.lit(r"\S")))


COLUMNS = {"delivery": "delivery_id", "id": "id", "source": "source", "kind": "parser_type", "text": "raw_text"}


def _trie(base: DataFrame) -> DataFrame:
    """(kind, c2, c1, word, ends, goes): occurrences of each lexeme under its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter = Counter()
        every: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(every)
            made = pa.RecordBatch.from_arrays(
                [*[pa.array([k[i] for k in keys], pa.string()) for i in range(4)], pa.array([ends[k] for k in keys], pa.int64()), pa.array([every[k] - ends[k] for k in keys], pa.int64())],
                ["kind", "c2", "c1", "word", "ends", "goes"],
            )
            ends.clear()
            every.clear()
            return made

        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ["", "", *lexemes(text)]
                if len(found) > 2:
                    before = [context(w) for w in found]
                    every.update(zip([kind] * len(found), before, before[1:], found[2:]))
                    ends[(kind, *before[-3:-1], found[-1])] += 1
                if len(every) > FLUSH:
                    yield out()
        yield out()

    counted = base.select("kind", "text").mapInArrow(run, "kind string, c2 string, c1 string, word string, ends bigint, goes bigint")
    return counted.groupBy("kind", "c2", "c1", "word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))


def _stops(counts: DataFrame, context: list[str], grows) -> DataFrame:
    """For each (context, word) at which a text ends: ends, and all in which it went on."""
    keys = ["kind", *context]
    at_end = counts.where("ends > 0")
    near = counts.join(at_end.select(*keys).distinct(), keys, "left_semi").withColumn("n", F.col("ends") + F.col("goes"))
    short = near.select(*keys, F.explode(grows(F.col("word"))).alias("word"), "n")
    long = _begun(at_end.select(*keys, "word"), near.select(*keys, "word", "n"), keys).select(*keys, "word", "n")
    longer = short.unionByName(long).groupBy(*keys, "word").agg(F.sum("n").alias("longer"))
    total = F.col("ends") + F.col("goes") + F.coalesce("longer", F.lit(0))
    return at_end.join(longer, [*keys, "word"], "left").select(*keys, "word", "ends", total.alias("total"), (F.col("ends") / total).alias("stop"))


PLAIN = 24  # letters up to which a word's beginnings are listed one by one; longer ones are found by a join, as lists would grow with the square


def _begun(some: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Each of some long words with each longer word that begins with it."""
    head = lambda c: F.substring(c, 1, PLAIN + 1).alias("head")
    long = words.where(F.length("word") > PLAIN + 1).withColumnRenamed("word", "whole").withColumn("head", head(F.col("whole")))
    start = some.where(F.length("word") > PLAIN).withColumn("head", head(F.col("word")))
    return start.join(long, [*keys, "head"]).where((F.length("whole") > F.length("word")) & F.col("whole").startswith(F.col("word")))


def _prefixes(word):
    """The proper prefixes of a lexeme, of words those up to PLAIN letters."""
    letters = F.transform(F.sequence(F.lit(1), F.least(F.length(word) - 1, F.lit(PLAIN))), lambda n: F.substr(word, F.lit(1), n))
    return F.when(word.rlike(r"^9\d+\z"), _shorter(word)).when(F.length(word) > 1, letters).otherwise(F.array().cast("array<string>"))


def _shorter(word):
    """The shapes a shape can be cut to."""
    size = F.when(word.rlike(r"^[A9]\d+\z"), F.substring(word, 2, 9).cast("int")).otherwise(F.lit(1))
    return F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.concat(F.substring(word, 1, 1), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def _shape(column: str):
    return F.when(F.col(column).rlike(r"^\p{L}"), F.concat(F.lit("A"), F.length(column).cast("string"))).otherwise(F.col(column))


def decided(messages: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Every row with a text: delivery_id, id, source, length, whether cut, and the evidence."""
    spark = messages.sparkSession
    from aerolith.session import checkpoint_dir

    checkpoint_dir(spark)
    base = spread(_base(messages, columns))
    counts = _trie(base).checkpoint()  # used by each level

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["delivery_id", "id", "source", "kind", "length", "sound", "c2", "c1", "word", "closed"]
        for batch in batches:
            texts = [t.strip() for t in batch.column(4).to_pylist()]
            ends = [[context(c2), context(c1), word] for c2, c1, word in (["", "", *lexemes(t)][-3:] for t in texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([len(t) for t in batch.column(4).to_pylist()], pa.int64()),
                    pa.array([checksum(t) for t in texts], pa.bool_()),
                    *[pa.array([e[i] for e in ends], pa.string()) for i in range(3)],
                    pa.array([t[-1:] in ".!?=" for t in texts], pa.bool_()),
                ],
                names,
            )

    rows = base.mapInArrow(last, "delivery_id bigint, id bigint, source string, kind string, length bigint, sound boolean, c2 string, c1 string, word string, closed boolean").checkpoint()  # read for the decisions and for both statistics

    whole = (F.col("stop") >= STOP).alias("whole")
    first = _stops(counts, ["c2", "c1"], _prefixes).where(F.col("total") >= SEEN).select("kind", "c2", "c1", "word", "ends", "stop", whole)
    shaped = counts.select("kind", "c1", _shape("word").alias("word"), "ends", "goes").groupBy("kind", "c1", "word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    second = _stops(shaped, ["c1"], _shorter).where(F.col("total") >= SEEN).select("kind", "c1", F.col("word").alias("s0"), whole.alias("whole2"))
    both = counts.select("kind", _shape("c1").alias("s1"), _shape("word").alias("word"), "ends", "goes").groupBy("kind", "s1", "word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    third = _stops(both, ["s1"], _shorter).select("kind", "s1", F.col("word").alias("s0"), (whole & (F.col("ends") >= ENDS)).alias("whole3"))

    word = F.col("word").rlike(r"^\p{L}+\z")
    vocabulary = counts.where(word).groupBy("word").agg(F.sum("goes").alias("goes")).where("goes > 0").select("word")
    long = _begun(rows.where(word & (F.length("word") > PLAIN)).select("word").distinct(), vocabulary, []).select("word")
    inner = vocabulary.select(F.explode(_prefixes(F.col("word"))).alias("word")).unionByName(long).distinct().join(vocabulary, "word", "left_anti").withColumn("prefix", F.lit(True))  # unknown words that begin known ones

    size = counts.groupBy("kind").agg(F.sum("ends").alias("n"))
    usual = first.where("whole").join(size, "kind").where(F.col("ends") >= F.greatest(F.lit(ENDS), F.col("n") * SHARE))
    covered = usual.groupBy("kind").agg(F.sum("ends").alias("covered"))
    # Usual endings are at most 1 / SHARE a kind; broadcast if the kinds are few as well.
    few = counts.select("kind").distinct().limit(1001).count() <= 1000
    hint = F.broadcast if few else (lambda x: x)
    easy = rows.join(hint(usual.select("kind", "c2", "c1", "word", F.lit(True).alias("usual"))), ["kind", "c2", "c1", "word"], "left")
    names = ["delivery_id", "id", "source", "kind", "length", "closed", "sound"]
    ended = easy.where(F.coalesce("sound", "usual").isNotNull()).select(*names, (~F.coalesce("sound", F.lit(True))).alias("odd"), F.lit(False).alias("prefix"))
    doubt = (
        easy.where(F.coalesce("sound", "usual").isNull())
        .drop("usual")
        .withColumns({"s1": _shape("c1"), "s0": _shape("word")})
        .join(first.drop("ends", "stop"), ["kind", "c2", "c1", "word"], "left")
        .join(second, ["kind", "c1", "s0"], "left")
        .join(third, ["kind", "s1", "s0"], "left")
        .join(inner, "word", "left")
        .select(*names, (~F.coalesce("whole", F.when(F.col("prefix"), F.lit(False)), "whole2", "whole3", F.lit(False))).alias("odd"), F.coalesce("prefix", F.lit(False)).alias("prefix"))
    )
    odd = ended.unionByName(doubt)

    # Kinds without regular endings need positive evidence.
    sums = rows.where("sound").groupBy("kind").agg(F.count("*").alias("sound_n"))
    regular = size.join(covered, "kind", "left").join(sums, "kind", "left").select("kind", ((F.coalesce("covered", F.lit(0)) + F.coalesce("sound_n", F.lit(0))) / F.col("n") >= REGULAR).alias("regular"))
    lengths = rows.groupBy("source", "length").agg(F.count("*").alias("n"))
    top = lengths.groupBy("source").agg(F.max(F.struct("length", "n")).alias("top"), F.sum("n").alias("rows"))
    limit = top.where("top.n >= 3 AND top.n >= 0.002 * rows").select(F.col("source").alias("s"), F.col("top.length").alias("field"))
    judged = odd.join(hint(regular), "kind", "left")
    why = F.when(F.col("sound").isNotNull(), "checksum").when(F.col("prefix"), "prefix").otherwise("stop")
    settled = judged.where("sound IS NOT NULL OR regular OR NOT odd").select("delivery_id", "id", "source", "kind", "length", F.col("odd").alias("cut"), F.when(F.col("odd"), why).alias("evidence"))
    rest = (
        judged.where("sound IS NULL AND NOT regular AND odd")
        .join(limit, F.col("source").eqNullSafe(F.col("s")) & (F.col("length") == F.col("field")), "left")
        .withColumn("full", F.col("field").isNotNull() & ~F.col("closed"))
        .select("delivery_id", "id", "source", "kind", "length", (F.col("prefix") | F.col("full")).alias("cut"), F.when(F.col("prefix"), "prefix").when(F.col("full"), "length").alias("evidence"))
    )
    return settled.unionByName(rest)


def found(messages: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """(delivery_id): the rows with a usable id whose text was cut."""
    return decided(messages, columns).where("cut AND id <> 0").select("delivery_id")


def rates(messages: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """One row a source: texts, cut texts, their share, the greatest length, and the cut texts by evidence."""
    return (
        decided(messages, columns)
        .where("id <> 0")
        .groupBy("source")
        .agg(
            F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate"), F.max("length").alias("longest"),
            *[F.count_if(F.col("cut") & (F.col("evidence") == e)).alias(f"by_{e}") for e in ("checksum", "prefix", "stop", "length")],
        )
    )
