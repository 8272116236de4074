"""Images of pages: which to keep, which text stands near, which question they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least side, aspects, share of the page's height that is head or foot.
LEAST_SIDE, LEAST_ASPECT, MOST_ASPECT, EDGE = 100, 0.01, 100.0, 0.05


def content_box(spans: DataFrame) -> DataFrame:
    """(source, page, x0, y0, x1, y1): the box around the text spans of each page; spans of blank text don't count."""
    held = spans.filter(F.trim("text") != "")
    return held.groupBy("source", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def near_spans(images: DataFrame, spans: DataFrame, margin: float = 50.0) -> DataFrame:
    """(source, page, image, near): the text whose spans' centres lie in the image's box widened by the margin; an equi-join on the page."""
    s = spans.select("source", "page", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    i = images.select("source", "page", "image", "x0", "y0", "x1", "y1")
    inside = F.col("cx").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("cy").between(F.col("y0") - margin, F.col("y1") + margin)
    # Spans of one page: their list is as long as a page.
    return i.join(s, ["source", "page"], "left").groupBy("source", "page", "image").agg(F.array_join(F.array_sort(F.collect_list(F.when(inside, F.struct("cy", "cx", "text")))).getField("text"), " ").alias("near"))


def kept_images(images: DataFrame, spans: DataFrame, header: str, question: str) -> DataFrame:
    """Images large enough and of a usual aspect; one in the page's head or foot goes where a header word and no question word (patterns) stands near."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = images.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE) & (w > 0) & (h > 0) & (w / h).between(LEAST_ASPECT, MOST_ASPECT))
    centre = (F.col("y0") + F.col("y1")) / 2 / F.col("page_height")
    at_edge = (centre < EDGE) | (centre > 1 - EDGE)
    near = near_spans(sized, spans)
    return sized.join(near, ["source", "page", "image"]).filter(~(at_edge & F.col("near").rlike(header) & ~F.col("near").rlike(question))).drop("near")


def images_of_questions(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Questions with the images of their page by file name: those of the newer naming, only without any those of the older; an empty list without either."""
    name = F.col("image")
    new = F.regexp_extract(name, r"page_(\d+)_img", 1).try_cast("int")
    old = F.regexp_extract(name, r"(?:^|/)p(\d+)_\d+", 1).try_cast("int")
    of = lambda page, alias: files.select(page.alias("page_number"), "image").filter("page_number IS NOT NULL").groupBy("page_number").agg(F.array_sort(F.collect_set("image")).alias(alias))
    none = F.array().cast("array<string>")
    joined = questions.drop("images").join(of(new, "__new"), "page_number", "left").join(of(old, "__old"), "page_number", "left")
    return joined.withColumn("images", F.coalesce("__new", "__old", none)).drop("__new", "__old")


def listed_images(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(image): the names of the image files of a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("image"))


def image_name(page: Column, number: Column, kind: Column) -> Column:
    return F.format_string("page_%d_img_%d.%s", page, number, kind)
