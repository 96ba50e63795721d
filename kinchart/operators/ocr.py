"""Word tables of two recognition engines: matching, confidence, page text and archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions.islands import with_islands
from kinchart.functions.sweep import matched_boxes

FIRST, SECOND = "tesseract", "easyocr"


def ocr_words(results: DataFrame) -> DataFrame:
    """One row per word of nested recognition results (record_id, words[{text, bbox, ...}])."""
    rows = results.select("record_id", F.posexplode_outer("words").alias("word_no", "w")).filter("word_no is not null")
    box = [F.get("w.bbox", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return rows.select(
        "record_id", "word_no", F.col("w.engine").alias("engine"), F.col("w.page").alias("page"),
        F.col("w.text").alias("text"), *box, F.col("w.confidence").alias("confidence"),
    )


BODY = ["text", "x_min", "y_min", "x_max", "y_max", "confidence"]


#: Boxes of a page up to which it is matched as one row.
PAGE = 4096
PAGE_KEY = ["doc_id", "page"]
ENGINES = {"has_first": FIRST, "has_second": SECOND}


def _matched_sides(grouped, threshold: float, *flags: Column, kept: Column | None = None) -> DataFrame:
    """Both engines' words of every group as arrays, and in ``m`` the word each second one takes.

    Each word of the second engine, in order, takes the free word of the first engine with the
    largest IoU of at least the threshold.
    """
    item = F.struct("ord", *BODY)

    def side(engine: str) -> Column:
        own = F.col("engine") == engine
        return F.array_sort(F.collect_list(F.when(own if kept is None else own & kept, item)))

    sides = grouped.agg(*flags, side(SECOND).alias("second"), side(FIRST).alias("first"))
    return sides.withColumn("m", matched_boxes(F.col("second"), F.col("first"), threshold))


def _matched_islands(boxes: DataFrame, threshold: float, width: float) -> DataFrame:
    """Words of a page matched island by island; ``boxes`` has the flags of its page.

    Boxes matter to each other only where they overlap, so the pass runs per island: overlapping rows of the
    page first, overlapping columns inside them.
    """
    rows = with_islands(boxes, PAGE_KEY, "y_min", "y_max", width, "band")
    cells = with_islands(rows, [*PAGE_KEY, "band"], "x_min", "x_max", width, "island")
    flags = [F.first(n).alias(n) for n in ENGINES]
    return _matched_sides(cells.groupBy(*PAGE_KEY, "band", "island"), threshold, *flags).drop("band", "island")


def _matched_pages(words: DataFrame, threshold: float, width: float, most: int = PAGE) -> DataFrame:
    """Words of every page matched, as arrays: a page of up to ``most`` boxes is one row, of a larger one each island.

    Boxes of two islands do not overlap, so a threshold above 0 gives both ways the same matches.  Words without
    a document, a page or a left or upper side are left out, but tell that their engine found words on the page.
    """
    boxes = words.select(*PAGE_KEY, "engine", F.col("word_no").cast("bigint").alias("ord"), *BODY)
    boxes = boxes.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    placed = F.col("x_min").isNotNull() & F.col("y_min").isNotNull()
    flags = [F.max(F.col("engine") == engine).alias(n) for n, engine in ENGINES.items()]
    # a side that is no number has no place among the others
    odd = F.isnan("x_min") | F.isnan("y_min") | F.isnan("x_max") | F.isnan("y_max")
    large = boxes.groupBy(*PAGE_KEY).agg(F.count("*").alias("_n"), F.max(odd).alias("_odd"), *flags)
    large = large.filter((F.col("_n") > (most if threshold > 0 else 0)) | F.col("_odd")).drop("_n", "_odd")
    small = boxes.join(large.select(*PAGE_KEY), PAGE_KEY, "left_anti").groupBy(*PAGE_KEY)
    pages = _matched_sides(small, threshold, *flags, kept=placed)
    islands = _matched_islands(boxes.filter(placed).join(large, PAGE_KEY), threshold, width)
    return pages.unionByName(islands)


def bbox_iou_join(words: DataFrame, threshold: float = 0.3, width: float = 2000.0) -> DataFrame:
    """Matched words (doc_id, page, second_no, first_no, iou)."""
    pair = F.zip_with("second", "m.partner", lambda s, p: F.struct(s["ord"].alias("second_no"), F.get("first", p)["ord"].alias("first_no")))
    told = F.zip_with(pair, "m.affinity", lambda p, v: F.struct(p["second_no"], p["first_no"], v.alias("iou")))
    pages = _matched_pages(words, threshold, width)
    return pages.select("doc_id", "page", F.inline(F.filter(told, lambda p: p["first_no"].isNotNull())))


def merge_ocr_words(words: DataFrame, threshold: float = 0.3, width: float = 2000.0) -> DataFrame:
    """One word list out of two: the surer word of each match (ties to the second engine), unmatched
    words of the second engine at 0.85 of their confidence, unmatched words of the first as they are.
    Where only one engine found words on a page they are kept untouched.

    The merge happens inside the pages, or islands, which hold both words of every match already.
    """
    def word(w: Column, engine: str, matched: bool) -> Column:
        return F.struct(
            w["ord"].alias("word_no"),
            *[w[n].alias(n) for n in BODY],
            F.lit(engine).alias("engine"),
            F.lit(matched).alias("matched"),
        )

    def second(w: Column, i: Column) -> Column:
        f = F.get("first", F.get("m.partner", i))
        return (
            F.when(f.isNull(), word(w, SECOND, False))
            .when(w["confidence"] >= f["confidence"], word(w, SECOND, True))
            .otherwise(word(f, FIRST, True))
        )

    rest = F.filter("first", lambda _, i: ~F.get("m.taken", i))
    merged = F.concat(F.transform("second", second), F.transform(rest, lambda f: word(f, FIRST, False)))
    both = F.col("has_first") & F.col("has_second")
    lone = both & ~F.col("matched")
    lowered = lone & (F.col("engine") == SECOND)
    return (
        _matched_pages(words, threshold, width)
        .select(*PAGE_KEY, "has_first", "has_second", F.inline_outer(merged))
        .withColumn("confidence", F.when(lowered, F.col("confidence") * 0.85).otherwise(F.col("confidence")))
        .withColumn("engine", F.when(lone, F.concat("engine", F.lit("_unmatched"))).otherwise(F.col("engine")))
        .drop("has_first", "has_second", "matched")
    )


def document_confidence(words: DataFrame, first_scale: float = 1.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Confidence-weighted mean confidence per document (or page); ``first_scale`` divides the first engine's."""
    first = F.col("engine") == FIRST
    c = F.when(first, F.col("confidence") / first_scale).otherwise(F.col("confidence"))
    # a document whose words are all dropped scores 0
    used = F.when(~first | (c >= 0), c)
    ratio = F.try_divide(F.sum(used * used), F.sum(used))
    return words.groupBy(*keys).agg(F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))).alias("overall_confidence"))


def reading_lines(words: DataFrame, row_height: float = 20.0) -> DataFrame:
    """Words put in reading order: one row per text line (a band of ``row_height``) of a page."""
    line = F.floor(F.col("y_min") / row_height)
    ordered = F.array_sort(F.collect_list(F.struct("x_min", "word_no", "text")))
    return (
        words.groupBy("doc_id", "page", line.alias("line_no"))
        .agg(ordered.alias("_w"), F.count("*").alias("words"))
        .select("doc_id", "page", "line_no", "words", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("line"))
    )


def reading_order_text(words: DataFrame, row_height: float = 20.0) -> DataFrame:
    """Text of every page: its lines in order, joined by blanks.

    Built in two steps so that words are put together per line first; the text of a page is one
    value in the end and therefore meets in one row.
    """
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return (
        reading_lines(words, row_height)
        .groupBy("doc_id", "page")
        .agg(lines.alias("_l"))
        .select("doc_id", "page", F.array_join(F.transform("_l", lambda x: x["line"]), " ").alias("raw_text"))
    )


def merge_pages(pages: DataFrame) -> DataFrame:
    """Document text and mean confidence from its pages (doc_id, page, raw_text, confidence)."""
    label = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("raw_text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("page").alias("page"), label.alias("part"))))
    return (
        pages.groupBy("doc_id")
        .agg(parts.alias("_p"), F.round(F.avg("confidence"), 3).alias("overall_confidence"), F.count("*").alias("page_count"))
        .select(
            "doc_id",
            F.array_join(F.transform("_p", lambda p: p["part"]), "\n\n").alias("raw_text"),
            "overall_confidence",
            "page_count",
        )
    )


def archive_ocr_result(words: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The archive of recognition results: one head row per record, one row per word.

    ``heads`` has the fields of ``results`` (with record_id) and the number of words and pages;
    ``words`` are keyed by record, page, engine and number, so no row grows with a record.
    """
    box = F.array("x_min", "y_min", "x_max", "y_max").alias("bbox")
    rows = words.select(F.col("doc_id").alias("record_id"), "page", "engine", "word_no", "text", box, "confidence")
    # two plain sums: no set of pages is kept for a record
    pages = rows.groupBy("record_id", "page").agg(F.count("*").alias("n")).groupBy("record_id")
    counts = pages.agg(F.sum("n").alias("word_count"), F.count("*").alias("page_count"))
    heads = results.join(counts, "record_id", "left").fillna(0, ["word_count", "page_count"])
    return {"heads": heads, "words": rows}
