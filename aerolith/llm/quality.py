"""Problem 10: statistics of each text, and whether it is prose, a list, a table or junk.

Each line of a text gets statistics of its own and some of its whole text. Three
gradient-boosted models (list, table, junk, each against the rest) are fitted on
lines of texts that rules label weakly, and only where they are sure: plain prose,
enumerations, separated rows, and text nobody wrote to be read. Their probabilities
are calibrated on the hand-checked texts of `holdout`. A text's kind is decided by
its characters: each line's probabilities count with its length, and a text in which
prose holds less than half is of the kind that holds most.

The models are fitted on lines of about TEXTS texts at most, chosen by a hash of the id,
at most LINES of one text and SAMPLE a label, never on a checked text; statistics and
decisions cover whole texts, all of them. Statistics are computed for many texts at
once (see `lines`).

Defined results: null, empty and blank texts have statistics of 0 and no kind. Lines
longer than PIECE characters are judged piece by piece. The language column is not
used, as it may be wrong: common words of all languages count. Repeated rows are
judged alike; an empty table, or one without weakly labelled lines of a kind, gives
no cases of that kind. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.boosting import Boosted
from aerolith.llm.holdout import CHECKED, HELD_OUT
from aerolith.llm.lines import line_statistics, pieces, word_hashes
from aerolith.sources.tables import spread

TEXTS, SAMPLE, LINES = 20_000, 4000, 8
KINDS = ("list", "table", "junk")
AT_ONCE, CHARACTERS = 500, 2_000_000  # texts and their characters whose statistics are computed together


def together(texts: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts small enough to be put into one set of arrays; a text is never split."""
    start, held = 0, 0
    for i, lines in enumerate(texts):
        size = sum(map(len, lines))
        if i > start and (i - start >= AT_ONCE or held + size > CHARACTERS):
            yield start, i
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield start, len(texts)


def statistics_of(texts: list[list[str]], common: np.ndarray) -> list[np.ndarray]:
    """For each text, which must have a line, the statistics of its lines."""
    out = []
    for a, b in together(texts):
        x, starts = line_statistics(texts[a:b], common)
        out += np.split(x, starts[1:])
    return out


def weak_label(lines: list[str], x: np.ndarray) -> str | None:
    """What the text surely is, if rules can tell."""
    size = x[:, 0]
    share = lambda mask: float((size * mask).sum() / size.sum())
    common, unique, packed = x[0, 29], x[0, 25], x[0, 34]
    total = size.sum()
    if total >= 60 and (share(x[:, 19] >= 60) > 0.9 or (unique < 0.1 and len(lines) >= 8) or packed < 0.05 or share(x[:, 23] > 0) > 0.9 or (share(x[:, 18] > 0.15) > 0.9 and x[:, 6].mean() < 0.2)):
        return "junk"
    if total >= 60 and share(x[:, 24] > 0.5) > 0.9:
        return "junk"
    if total >= 60 and share((x[:, 3] > 0.12) & (x[:, 21] > 0.12)) > 0.9 and len(lines) <= 2 and x[:, 8].max() == 0:
        return "junk"
    if len(lines) >= 3:
        if share(x[:, 7] > 0) > 0.9:
            return "list"
        if share((x[:, 8] > 0) | (x[:, 9] > 0) | (x[:, 10] > 1)) > 0.9 and x[0, 27] > 0.8:
            return "table"
        if share(x[:, 13] > 0) > 0.9 or share(x[:, 14] > 0) > 0.9:
            return "table"
        if len(lines) >= 5 and share((x[:, 1] <= 5) & (x[:, 5] == 0) & (x[:, 3] < 0.1)) > 0.9 and common < 0.2 and unique > 0.15:
            return "list"
    if share((x[:, 11] >= 3) & (x[:, 12] <= 4.5)) > 0.9:
        return "list"
    if common > 0.3 and share((x[:, 6] > 0.2) & (x[:, 3] < 0.08) & (x[:, 7] == 0) & (x[:, 11] < 2) & (x[:, 18] < 0.1)) > 0.9 and x[0, 28] >= 5 and packed > 0.08:
        return "prose"
    return None


def _common(words: DataFrame) -> np.ndarray:
    """The hashes of the given list of common words, a parameter that is small by its nature (some thousands a language) and kept as eight bytes a word."""
    found = words.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct().collect()
    return word_hashes(r.word for r in found)


def train(docs: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Boosted]:
    """A calibrated model for each kind of which there are weakly labelled lines."""

    checked = frozenset(text for text, _ in CHECKED + HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, keys, rows = [], [], []

            def take(key: int, part: str, kinds: list[str], x: np.ndarray, most: int) -> None:
                chosen = sorted(range(len(x)), key=lambda i: zlib.crc32(f"{key}/{part}/{i}".encode()))[:most]
                for i in chosen:
                    labels.append(kinds[i])
                    keys.append(zlib.crc32(f"{i}/{part}/{key}".encode()))
                    rows.append(x[i].tolist())

            pure: dict[str, list[list[str]]] = {}
            some = [(key, lines) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text and text not in checked and (lines := pieces(text))]
            mixed = []
            for (key, lines), x in zip(some, statistics_of([lines for _, lines in some], common)):
                if (label := weak_label(lines, x)) is not None:
                    take(key, "own", [label] * len(lines), x, LINES)
                    pure.setdefault(label, []).append(lines[:40])
                    # With some lines of a text of another kind before or behind it, as texts are often mixed.
                    others = [k for k in (("prose",) if label != "prose" else KINDS) if k in pure]
                    if others:
                        other = others[key % len(others)]
                        more = pure[other][key % len(pure[other])][: 2 + key % 20]
                        both, kinds = (lines[:40] + more, [label] * min(40, len(lines)) + [other] * len(more)) if key % 3 else (more + lines[:40], [other] * len(more) + [label] * min(40, len(lines)))
                        mixed.append((key, both, kinds))
                    if len(pure[label]) > 50:
                        pure[label].pop(0)
            for (key, _, kinds), x in zip(mixed, statistics_of([both for _, both, _ in mixed], common)):
                take(key, "mixed", kinds, x, LINES)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(keys, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["label", "key", "x"])

    narrow = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    share = TEXTS / max(1, docs.count())
    if share < 1:
        narrow = narrow.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sized = spread(narrow).mapInArrow(run, "label string, key bigint, x array<double>").persist()
    # One pass: within each label, lines with the least keys; the keys are uniform, so a bound on them cuts before the sort.
    counts = {r.label: r.n for r in sized.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = []
    for label, n in counts.items():
        bound = int(min(1.0, 1.2 * SAMPLE / n + 0.001) * (1 << 32))
        sample += sized.where((F.col("label") == label) & (F.col("key") <= bound)).orderBy("key", "x").limit(SAMPLE).collect()
    sized.unpersist()
    if not sample:
        return {}
    x, y = np.array([r.x for r in sample]), np.array([r.label for r in sample])
    held = [(pieces(text), kind) for text, kind in CHECKED]
    found = statistics_of([lines for lines, _ in held], common)
    hx, hy = np.concatenate(found), np.concatenate([[k] * len(x) for x, (_, k) in zip(found, held)])
    return {k: Boosted().fit(x, (y == k).astype(float)).calibrate(hx, (hy == k).astype(float)) for k in KINDS if (y == k).any() and (y != k).any()}


STATISTICS = ("n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "unique_word_ratio", "prose_share", "list_share", "table_share", "junk_share")


def line_shares(x: np.ndarray, models: dict[str, Boosted]) -> np.ndarray:
    """For each line the shares of prose and of each of KINDS."""
    raw = np.stack([models[k].probability(x) if k in models else np.zeros(len(x)) for k in KINDS], axis=1)
    prose = np.maximum(1.0 - raw.sum(axis=1, keepdims=True), 0.0)
    both = np.concatenate([prose, raw], axis=1)
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-9)


def judged(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the STATISTICS, kind): kind is list, table, junk or prose, null for texts without characters."""
    common = _common(words)
    shared = docs.sparkSession.sparkContext.broadcast((common, train(docs, common, id_col, text_col)))  # the word list given, and the trees
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, models = shared.value
        for batch in batches:
            every = [pieces(t) if t else [] for t in batch.column(1).to_pylist()]
            for a, b in together(every):
                part = batch.slice(a, b - a)
                full = [lines for lines in every[a:b] if lines]
                x, starts = line_statistics(full, known) if full else (np.zeros((0, 36)), np.zeros(0, np.int64))
                held = line_shares(x, models) if len(x) else np.zeros((0, 4))
                sums = lambda v: np.add.reduceat(v, starts, axis=0) if len(starts) else np.zeros((0, *v.shape[1:]))
                size, n_words, n = sums(x[:, 0]), sums(x[:, 1]), np.diff(np.append(starts, len(x)))
                own = sums(held * x[:, :1]) / np.maximum(1, size)[:, None]
                mean = lambda c, w, total: sums(x[:, c] * w) / np.maximum(1e-9, total)
                values = np.column_stack([n, n_words, mean(2, x[:, 1], n_words), mean(3, x[:, 0], size), mean(4, x[:, 0], size), sums(x[:, 5]) / np.maximum(1, n), x[starts, 29], x[starts, 33], own])
                names = ["prose" if p[0] >= 0.5 or not models else KINDS[int(np.argmax(p[1:]))] for p in own]
                rows, at = [], 0
                for lines in every[a:b]:
                    rows.append((*values[at].tolist(), names[at]) if lines else (*[0.0] * len(STATISTICS), None))
                    at += bool(lines)
                columns = list(zip(*rows)) or [()] * (len(STATISTICS) + 1)
                arrays = [pa.array(c, pa.float64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *STATISTICS, "kind"])

    schema = f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS) + ", kind string"
    return spread(narrow).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
