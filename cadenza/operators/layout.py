"""Page layout of structure documents as data: section boxes, bar and dot places, and the flow into columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import dims
from cadenza.functions import theory as th

#: Millimetres of a character in the default wrapping of comments.
CHAR_WIDTH = 1.5


def wrapped(text: str, width: float) -> list[str]:
    """Words to lines of at most ``width``; a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and (len(lines[-1]) + 1 + len(word)) * CHAR_WIDTH <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def line_counter(wrap: Callable[[str, float], list[str]]):
    """Wrapping depends on a font, so it is a Python function that is given; comments are few and short."""

    @F.pandas_udf(T.IntegerType())
    def count(text: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([len(wrap(t, w)) if isinstance(t, str) and t else 0 for t, w in zip(text, width, strict=True)], dtype="int32")

    return count


def section_boxes(sections: DataFrame, page: str, *, wrap: Callable[[str, float], list[str]] = wrapped) -> DataFrame:
    """Sections as rows with n_bars, bars_per_row (or null) and comment get their box; sections without bars go."""
    c = dims.PAGES[page]
    column = (c["pageW"] - c["margin"] * 2 - c["colGap"] * (c["numCols"] - 1)) / c["numCols"]
    per_row = F.coalesce("bars_per_row", F.floor(F.lit(column * 0.45) / F.lit(c["barW"] + c["barGap"])).cast("int"))
    boxed = sections.where("n_bars > 0").withColumn("per_row", per_row)
    boxed = boxed.withColumns(
        {
            "n_rows": F.ceil(F.col("n_bars") / F.col("per_row")),
            "grid_w": F.least("n_bars", "per_row") * F.lit(c["barW"] + c["barGap"]) - c["barGap"],
        }
    ).withColumn("bars_h", F.col("n_rows") * F.lit(c["barH"] + c["barGap"]) - c["barGap"])
    beside = F.lit(column) - F.col("grid_w") - c["commentGap"]
    boxed = boxed.withColumn("beside", beside >= c["commentBesideMinW"])
    boxed = boxed.withColumn("n_lines", line_counter(wrap)(F.col("comment"), F.when(F.col("beside"), beside).otherwise(F.lit(column))))
    comment = F.col("n_lines") * c["commentLineHeight"]
    below = F.when(F.col("n_lines") > 0, comment + 2).otherwise(F.lit(0.0))
    return boxed.withColumn("height", c["barsTopOffset"] + F.when(F.col("beside"), F.greatest("bars_h", comment)).otherwise(F.col("bars_h") + below))


def bar_places(boxes: DataFrame, page: str) -> DataFrame:
    """A row a bar, by its place in the section: column, row and offsets from the section's corner."""
    c = dims.PAGES[page]
    each = boxes.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_bars") - 1).cast("int"))).alias("i"))
    col, row = F.col("i") % F.col("per_row"), F.floor(F.col("i") / F.col("per_row"))
    return each.withColumns({"number": F.col("i") + 1, "x": col * F.lit(c["barW"] + c["barGap"]), "y": F.lit(c["barsTopOffset"]) + row * F.lit(c["barH"] + c["barGap"])})


def dot_places(bars: DataFrame, *, signature: str = "time_signature", accents: str = "accents") -> DataFrame:
    """A row a dot of each bar: whether it is a downbeat (every second) and accented."""
    each = bars.select("*", F.explode(F.sequence(F.lit(0), th.dots(F.col(signature)) - 1)).alias("dot"))
    marked = F.coalesce(F.array_contains(F.col(accents), F.col("dot")), F.lit(False))
    return each.withColumns({"is_downbeat": F.col("dot") % 2 == 0, "is_accent": marked})


def bar_color(bar: Column, section: Column) -> Column:
    return F.coalesce(bar, section)


FLOW = "doc long, section long, page int, col int, x double, y double"


def flow(boxes: DataFrame, page: str, *, header: float = 0.0) -> DataFrame:
    """The page, column and corner of each section (columns doc, section and height).

    Sections fill the columns in order and a section that doesn't fit goes to the next one, whether it fits there or
    not. Each place depends on all before it, so a document is folded in order: Spark deals the documents and sorts them,
    and a task walks over its rows in batches, holding no more than the columns' heights.
    """
    c = dims.PAGES[page]
    width = (c["pageW"] - c["margin"] * 2 - c["colGap"] * (c["numCols"] - 1)) / c["numCols"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, col, number = None, [], 0, 1
        for batch in batches:
            out = []
            for doc, section, height in zip(*(batch.column(x).to_pylist() for x in ("doc", "section", "height")), strict=True):
                if doc != last or not at:
                    last, at, col, number = doc, [c["margin"] + header] * c["numCols"], 0, 1
                if at[col] + height > c["pageH"] - c["margin"]:
                    col += 1
                    if col == c["numCols"]:
                        at, col, number = [c["margin"]] * c["numCols"], 0, number + 1
                out.append((doc, section, number, col, c["margin"] + col * (width + c["colGap"]), float(at[col])))
                at[col] += height + c["sectionGapY"]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, FLOW_TYPES, strict=True)], [x.split()[0] for x in FLOW.split(", ")])

    return boxes.select("doc", "section", "height").repartition("doc").sortWithinPartitions("doc", "section").mapInArrow(fold, FLOW)


FLOW_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
