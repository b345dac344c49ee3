"""Operators 2 and 7: how common a line is within its host.

A line is normalised (A-Z lower-cased, white space collapsed). A page is a document by its whole normalised text, in
what counts a line and in what counts the host: exact copies of a document are one page, all others are pages of
their own. The ratio decides at every size of host; the only floor is the few pages that a share needs to mean anything.

A host may hold a third of all rows. Pages are counted per (host, line) with map-side sums, and what goes
back to the pages is one short list per host: a host can have at most (lines per page) / ratio lines above
a ratio, however many pages it has.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, stored, text_slices

_SYMBOLS = "#*$%&|<>"


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    """Hash of a normalised line, as Spark's signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def common_lines(seen: DataFrame, ratio: float, least: int) -> DataFrame:
    """Lines on more than ``ratio`` of a host's pages, ``least`` at least: one row per host with ``common``, an array of hashes.

    ``seen``: host, page (hash of a whole normalised text), lines (array of hashes).
    """
    pages = seen.groupBy("host").agg(F.count_distinct("page").alias("host_pages"))
    per_line = (
        seen.select("host", "page", F.explode(F.array_distinct("lines")).alias("line"))
        .distinct()
        .groupBy("host", "line").agg(F.count("*").alias("line_pages"))
    )
    return (
        per_line.where(F.col("line_pages") >= least).join(pages, "host")
        .where(F.col("line_pages") > F.col("host_pages") * F.lit(ratio))
        .groupBy("host").agg(F.collect_list("line").alias("common"))
    )


def with_common(df: DataFrame, common: DataFrame, row: str, salts: int = 16) -> DataFrame:
    """Give each row its host's ``common`` lines.

    They are written first: Spark knows their size and sends them to the rows where they are small. Where they
    are not, a host's rows go to ``salts`` tasks, each with a copy of its one short list.
    """
    copies = stored(common).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).join(copies, ["host", "salt"], "left").drop("salt")


def drop_boilerplate(
    docs: DataFrame, ratio: float = 0.02, min_pages: int = 3, text: str = "text", host: str = "source",
) -> DataFrame:
    """Drop the lines that more than ``ratio`` of a host's pages contain (``min_pages`` pages at least).

    Returns all rows and columns of ``docs`` with the cleaned text, and ``n_lines_dropped`` (replaced if
    there is such a column). A null text stays null, an empty one empty, rows with a null host count as
    one host. Repeated rows and exact copies are one page. Lines without words are kept. The order of lines is kept.
    """
    keep = [c for c in docs.columns if c != "n_lines_dropped"]
    body = docs.select(
        F.struct(*[F.col(c) for c in keep if c != text], F.lit(True).alias("_row")).alias("row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("body"))

    def see(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages, lines = [], []
        for t in (t for texts in text_slices(batch.column("body")) for t in texts):
            found = [x for x in map(normal, t.split(b"\n")) if x]
            pages.append(line_hash(b"\n".join(found)) if found else None)
            lines.append([line_hash(x) for x in set(found)])
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(pages, pa.int64()), pa.array(lines, pa.list_(pa.int64()))], names=["host", "page", "lines"])

    seen = stored(arrow_rows(body.select("host", "body"), "host string, page bigint, lines array<bigint>", see))
    common = common_lines(seen.where("page IS NOT NULL"), ratio, min_pages)

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, dropped = batch.column("body").to_pylist(), []
        for i, lines in enumerate(batch.column("common")):
            dropped.append(0)
            if texts[i] is not None and lines.is_valid:
                often, raw = set(lines.as_py()), texts[i].encode().split(b"\n")
                stay = [x for x in raw if not ((n := normal(x)) and line_hash(n) in often)]
                dropped[-1] = len(raw) - len(stay)
                if dropped[-1]:
                    texts[i] = b"\n".join(stay).decode()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["row", "body", "n_lines_dropped"])

    joined = with_common(body, common, "body").select("row", "body", "common")
    kind = body.select("row").schema["row"].dataType.simpleString()
    out = arrow_rows(joined, f"row {kind}, body string, n_lines_dropped bigint", drop)
    return out.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in keep], "n_lines_dropped")


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen, again = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (again if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _measure(text: bytes) -> tuple:
    words = text.split()
    raw = text.split(b"\n")
    seen: set[bytes] = set()
    dup, lines, sizes = 0, [], []
    low = text.lower().split(b"\n")
    page = xxhash.xxh3_64()
    for line, folded in zip(raw, low, strict=True):
        parts = folded.split()
        if not parts:
            continue
        dup += line in seen
        seen.add(line)
        joint = b" ".join(parts)
        page.update(joint + b"\n")
        lines.append(line_hash(joint))
        sizes.append(len(parts))
    joined = b"".join(words)
    points = len(joined) if joined.isascii() else len(joined.decode())
    return (
        len(words), points, sum(text.count(s.encode()) for s in _SYMBOLS), dup, _repeat_words(words),
        lines, sizes, page.intdigest() - (1 << 63) if lines else None,
    )


_MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "page")


def line_quality(
    docs: DataFrame, share: float = 0.02, min_docs: int = 3, min_words: int = 20, min_left: float = 0.3,
    text: str = "text", host: str = "source",
) -> DataFrame:
    """Quality rules from cross-document line frequency.

    Lines in more than ``share`` of a host's distinct documents (``min_docs`` at least) are taken out. A document fails the base rules (under 50 words, or over half of its words in repeated 3-word windows),
    or is depleted: under ``min_words`` words or under ``min_left`` of its words are left.

    Returns all rows and columns of ``docs`` but ``text``, with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_words_left (long), base_failed, depleted, kept (boolean); columns of
    these names are replaced. A null text has no words, so it fails; rows with a null host count as one
    host; repeated rows and exact copies are judged alike and count as one document.
    """
    own = {*_MEASURED, "host", "common", "n_words_left", "base_failed", "depleted", "kept"}
    keep = [c for c in docs.columns if c != text and c not in own]
    body = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("body"),
    )
    kind = body.select("row", "host").schema

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*(_measure(t) for texts in text_slices(batch.column("body")) for t in texts), strict=True))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("host"), *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]],
            names=["row", "host", *_MEASURED],
        )

    longs = ", ".join(f"{c} bigint" for c in _MEASURED[:5])
    shape = f"row {kind['row'].dataType.simpleString()}, host string, {longs}, lines array<bigint>, line_words array<bigint>, page bigint"
    measured = stored(arrow_rows(body, shape, measure))
    common = common_lines(measured.where("page IS NOT NULL").select("host", "page", "lines"), share, min_docs)
    lost = F.aggregate(
        F.arrays_zip("lines", "line_words"), F.lit(0).cast("long"),
        lambda a, x: a + F.when(F.array_contains("common", x["lines"]), x["line_words"]).otherwise(F.lit(0)),
    )
    n = F.col("n_words")
    left = n - F.when(F.col("common").isNull(), F.lit(0)).otherwise(lost)
    failed = (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)
    depleted = (F.col("n_words_left") < min_words) | (F.col("n_words_left") < n * min_left)
    return (
        with_common(measured, common, "row")
        .withColumn("n_words_left", left.cast("long"))
        .withColumns({"base_failed": failed, "depleted": depleted})
        .select(*[F.col("row")[c].alias(c) for c in keep], *_MEASURED[:5], "n_words_left", "base_failed", "depleted",
                (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))
    )
