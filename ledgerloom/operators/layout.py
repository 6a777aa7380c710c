"""Word boxes to lines, cells, regions and compact encodings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.streamed import by_key, ordered_pass

WORDS = "doc_id long, page int, text string, left int, top int, width int, height int"


def confident_words(words: DataFrame, least: float = 30.0) -> DataFrame:
    """P5: not blank, and with a confidence of at least ``least`` (no number counts as -1)."""
    return words.filter((F.trim("text") != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= least))


def cluster_by_gap(df: DataFrame, keys: list[str], value: str, gap: float, name: str = "cluster", order: tuple[str, ...] = ()) -> DataFrame:
    """Numbers clusters along an axis; a new one begins where the next value is more than ``gap`` further."""
    over = Window.partitionBy(*keys).orderBy(value, *order)
    jump = F.when(F.col(value) - F.lag(value).over(over) > gap, 1).otherwise(0)
    return df.withColumn("_jump", jump).withColumn(name, F.sum("_jump").over(over.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def _lines(rows: Iterator[tuple], tolerance: int) -> Iterator[tuple[int, list[tuple]]]:
    """(line, words from left to right) of rows (document, page, text, left, top, width, height) in order of top, left, text."""
    key, line, low, high, held = None, -1, 0, 0, []
    for row in rows:
        top, bottom = row[4], row[4] + max(row[6], 1)
        if row[:2] != key or bottom < low - tolerance or top > high + tolerance:
            if held:
                yield line, sorted(held, key=lambda w: w[3])
            line = 0 if row[:2] != key else line + 1
            key, low, high, held = row[:2], top, bottom, []
        else:
            low, high = min(low, top), max(high, bottom)
        held.append(row)
    if held:
        yield line, sorted(held, key=lambda w: w[3])


BOXES = ["text", "left", "top", "width", "height"]


def group_lines(words: DataFrame, tolerance: int = 4) -> DataFrame:
    """Words with ``line`` and ``position``. A word joins the line whose vertical extent (which grows with every
    word) it overlaps within the tolerance; a recurrence, so one ordered pass, which holds a line."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for line, own in _lines(rows, tolerance):
            for position, word in enumerate(own):
                yield (*word, line, position)

    return ordered_pass(words, ["doc_id", "page"], ["top", "left", "text"], BOXES, WORDS + ", line int, position int", fold)


def column_lines(words: DataFrame, tolerance: int = 4, gap: int = 50, inclusive: bool = False) -> DataFrame:
    """D31 and W5/T10 in one pass: (doc_id, page, line, segments, text) of each line; a column begins after a gap of more
    than ``gap`` (or at least, if inclusive) pixels."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for line, own in _lines(rows, tolerance):
            segments, edge = [], None
            for word in own:
                space = 0 if edge is None else word[3] - edge
                if edge is None or (space >= gap if inclusive else space > gap):
                    segments.append([])
                segments[-1].append(word[2])
                edge = word[3] + word[5]
            joined = [" ".join(x) for x in segments]
            yield own[0][0], own[0][1], line, joined, " ".join(joined).strip(" ")

    return ordered_pass(words, ["doc_id", "page"], ["top", "left", "text"], BOXES, "doc_id long, page int, line int, segments array<string>, text string", fold)


def line_segments(lined: DataFrame, gap: int = 50, inclusive: bool = False) -> DataFrame:
    """W5/T10 over words that have lines already: per line its text and its column segments, as :func:`column_lines`."""
    over = Window.partitionBy("doc_id", "page", "line").orderBy("position")
    space = F.col("left") - F.lag(F.col("left") + F.col("width")).over(over)
    jump = F.when((space >= gap) if inclusive else (space > gap), 1).otherwise(0)
    own = lined.withColumn("_j", jump)
    own = own.withColumn("_s", F.sum("_j").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    segments = own.groupBy("doc_id", "page", "line", "_s").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("w"))
    segments = segments.withColumn("segment", F.array_join(F.transform("w", lambda x: x["text"]), " "))
    lines = segments.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("_s", "segment"))).alias("s"))
    lines = lines.withColumn("segments", F.transform("s", lambda x: x["segment"])).drop("s")
    return lines.withColumn("text", F.trim(F.array_join("segments", " ")))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Running number of the lines with text on a page, from 0."""
    return lines.filter("text <> ''").withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line")) - 1)


def json_light(lines: DataFrame) -> DataFrame:
    """One compact JSON object per page: rows of columns as lists, 'key: value' under the cleaned key, other rows as
    text; a key that comes again replaces the value in place. Rows are numbered as in :func:`numbered_lines`."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page, own in by_key(rows, 2):
            out: dict[str, object] = {}
            for row, (_, _, segments, text) in enumerate(own):
                key, colon, value = text.partition(":")
                clean = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", key.strip()).strip())[:30].lower()
                if len(segments) >= 2:
                    out[f"r{row}"] = segments
                elif colon and clean and value.strip():
                    out[clean] = value.strip()
                else:
                    out[f"r{row}"] = text
            yield (*page, json.dumps(out, ensure_ascii=False, separators=(",", ":")))

    return ordered_pass(lines.filter("text <> ''"), ["doc_id", "page"], ["line"], ["segments", "text"], "doc_id long, page int, encoded string", fold)


def markdown(lines: DataFrame) -> DataFrame:
    """Pipe rows for lines with columns, plain text for others, one text per page."""
    row = F.when(F.size("segments") >= 2, F.concat(F.lit("| "), F.array_join("segments", " | "), F.lit(" |"))).otherwise(F.col("text"))
    own = numbered_lines(lines).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row", row.alias("t")))).alias("rows"))
    return own.select("doc_id", "page", F.array_join(F.transform("rows", lambda x: x["t"]), "\n").alias("encoded"))


def grid_cells(words: DataFrame, row_gap: int = 12, column_gap: int = 40, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Cells of the borderless grid that word centres form: rows and columns are clusters of centres, per page (or per
    table box, if that is among the keys)."""
    own = words.withColumns({"cy": F.floor(F.col("top") + F.col("height") / 2), "cx": F.floor(F.col("left") + F.col("width") / 2)})
    own = cluster_by_gap(own, list(keys), "cy", row_gap, "row", ("cx", "text"))
    own = cluster_by_gap(own, list(keys), "cx", column_gap, "col", ("cy", "text"))
    cells = own.groupBy(*keys, "row", "col").agg(F.array_sort(F.collect_list(F.struct("left", "top", "text"))).alias("w"))
    return cells.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")


def table_html(cells: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """A grid as HTML, the first row as headings."""
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), "text", F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))).alias("cells"))
    rows = rows.withColumn("html", F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda x: x["c"]), ""), F.lit("</tr>")))
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "html"))).alias("rows"))
    return pages.select(*keys, F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda x: x["html"]), ""), F.lit("</table>")).alias("html"))


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in a box (edges count), with the box's id. Page keys are equi-keys; the four
    comparisons are a residual filter."""
    w = words.withColumns({"cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2})
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    return w.join(boxes, ["doc_id", "page"]).filter(inside)


def words_outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in no box."""
    cx, cy = words["left"] + words["width"] / 2, words["top"] + words["height"] / 2
    on = (words["doc_id"] == boxes["doc_id"]) & (words["page"] == boxes["page"]) & cx.between(boxes["x1"], boxes["x2"]) & cy.between(boxes["y1"], boxes["y2"])
    return words.join(boxes, on, "left_anti")


def regions(words: DataFrame, page_height: int, row_gap: int = 12, header: float = 0.08, footer: float = 0.05) -> DataFrame:
    """Words to lines to paragraphs, with header and footer by the paragraph's middle."""
    own = words.withColumns({"x2": F.col("left") + F.col("width"), "y2": F.col("top") + F.col("height")}).withColumn("cy", F.floor((F.col("top") + F.col("y2")) / 2))
    own = cluster_by_gap(own, ["doc_id", "page"], "cy", row_gap, "line", ("left", "text"))
    lines = own.groupBy("doc_id", "page", "line").agg(
        F.min("left").alias("x1"), F.min("top").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    lines = cluster_by_gap(lines.withColumn("cy", F.floor((F.col("y1") + F.col("y2")) / 2)), ["doc_id", "page"], "cy", 3 * row_gap, "region", ("line",))
    found = lines.groupBy("doc_id", "page", "region").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("content"),
    )
    middle = (F.col("y1") + F.col("y2")) / 2
    return found.withColumn("kind", F.when(middle < page_height * header, "header").when(middle > page_height * (1 - footer), "footer").otherwise("text"))


def reading_order(kind: str, x1: Column, y1: Column, x2: Column, width: Column) -> list[Column]:
    """L4: sort keys: two columns split at 0.45 of the page's width, or columns of 0.4 of the widest right edge."""
    centre = F.floor((x1 + x2) / 2)
    if kind == "split":
        return [F.when(centre < width * 0.45, 0).otherwise(1), y1, x1]
    return [F.floor(centre / (0.4 * width)), y1]


def payload(found: DataFrame, width: int) -> DataFrame:
    """A page's regions in reading order as one text; headers and footers are marked, empty ones left out."""
    shown = F.when(F.col("kind") == "header", F.concat(F.lit("[HEADER]\n"), "content")).when(F.col("kind") == "footer", F.concat(F.lit("[FOOTER]\n"), "content")).otherwise(F.col("content"))
    keys = [k.alias(f"k{i}") for i, k in enumerate(reading_order("split", F.col("x1"), F.col("y1"), F.col("x2"), F.lit(width)))]
    own = found.filter(F.trim("content") != "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*keys, shown.alias("t")))).alias("parts"))
    return own.select("doc_id", "page", F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n").alias("payload"))


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts joined by a page break, mean of the page confidences above 0, as a share."""
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("c"))
    return own.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n--- PAGE BREAK ---\n\n").alias("text"), F.coalesce(F.col("c") / 100, F.lit(0.0)).alias("confidence"))


def median_angle(angles: DataFrame, least: float = 0.3, most: float = 10.0) -> DataFrame:
    """D37, the data half: the skew to undo is the median line angle if it lies between the limits, else 0."""
    own = angles.groupBy("doc_id", "page").agg(F.percentile("angle", 0.5).alias("m"))
    return own.select("doc_id", "page", F.when(F.abs("m").between(least, most), F.col("m")).otherwise(0.0).alias("angle"))


#: Blocks of a layout model: type, box, table markup or text lines.
BLOCKS = "doc_id long, page int, position int, type string, bbox array<string>, html string, lines array<string>"


def parsed_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, position, kind, content, x1, y1, x2, y2) from BLOCKS: a block whose box is not four whole numbers,
    a table without markup and a block without text are left out; a null type is text."""
    kind = F.lower(F.coalesce("type", F.lit("text")))
    box = [F.get("bbox", F.lit(k)).try_cast("double").cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    lines = F.array_join(F.filter("lines", lambda t: F.trim(t) != ""), "\n")
    own = blocks.select("doc_id", "page", "position", kind.alias("kind"), F.when(kind == "table", F.col("html")).otherwise(lines).alias("content"), *box)
    return own.filter("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL AND trim(content) <> ''")


def block_payload(blocks: DataFrame, share: float = 0.4) -> DataFrame:
    """A page's parsed blocks in reading order as one text, columns by ``share`` of the widest right edge; tables
    are wrapped in their tag where they have none."""
    over = Window.partitionBy("doc_id", "page")
    gap = F.max("x2").over(over) * share
    column = F.when(gap > 0, F.floor(F.floor((F.col("x1") + F.col("x2")) / 2) / gap)).otherwise(0)
    body = F.trim("content")
    shown = F.when((F.col("kind") == "table") & ~F.lower(body).startswith("<table"), F.concat(F.lit("<table>"), body, F.lit("</table>"))).otherwise(body)
    own = blocks.withColumn("_k", column).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("_k", "y1", "position", shown.alias("t")))).alias("parts"))
    return own.select("doc_id", "page", F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n").alias("payload"))


def confident_tokens(tokens: DataFrame, least: float = 0.3) -> DataFrame:
    """Tokens with a confidence of at least ``least``; with 0 or less nothing is filtered."""
    return tokens.filter(F.col("confidence") >= least) if least > 0 else tokens


def separated(tokens: DataFrame, boxes: DataFrame, least: float = 0.3, height: int = 3000) -> dict[str, DataFrame]:
    """D34/D35, the whole page path: tokens filtered by confidence, those inside table boxes as grids of cells with their
    HTML, the others as regions. ``tokens``: doc_id, page, text, left, top, width, height, confidence; ``boxes``: doc_id,
    page, box, x1, y1, x2, y2."""
    own = confident_tokens(tokens, least)
    inside = words_in_boxes(own, boxes)
    keys = ["doc_id", "page", "box"]
    cells = grid_cells(inside, keys=keys)
    return {"cells": cells, "tables": table_html(cells, keys=keys), "regions": regions(words_outside(own, boxes), height)}
