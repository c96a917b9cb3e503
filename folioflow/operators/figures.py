"""Figures and rendered elements: figures from all sources, their sections, those that no section refers to, Markdown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..inference.elements import united
from .structure import PAGE

# Fixed value: the folder of assets beside the Markdown.
ASSETS = "assets"
FIGURE = ("doc_id", "page", "id", "title", "caption", "alt_text", "figure_type", "asset_path")


def of_assets(assets: DataFrame) -> DataFrame:
    """Figures of extracted images (doc_id, page, idx, name): one per image, numbered within its file from 0."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "idx")) - 1
    none = F.lit(None).cast("string")
    return assets.select("doc_id", "page", F.concat(F.lit("fig_asset_"), nth).alias("id"), none.alias("title"), none.alias("caption"), none.alias("alt_text"), F.lit("image").alias("figure_type"), F.col("name").alias("asset_path"))


def collect(answered: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """All figures of the files, each id once: those of answers about pages, then those of images."""
    rows = answered.withColumn("asset_path", F.lit(None).cast("string")) if "asset_path" not in answered.columns else answered
    return united(*[df.select(*FIGURE) for df in (rows, *([of_assets(assets)] if assets is not None else []))])


def references(heads: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, seq, figures_refs: ids of the figures on the page of each heading, in order."""
    by_page = figures.groupBy(*PAGE).agg(F.array_sort(F.collect_set("id")).alias("figures_refs"))
    return heads.select("doc_id", "seq", "page").join(by_page, [*PAGE]).select("doc_id", "seq", "figures_refs")


def unreferenced(figures: DataFrame, heads: DataFrame) -> DataFrame:
    """Figures on pages without a heading: a left anti join."""
    return figures.join(heads.select(*PAGE).distinct(), [*PAGE], "left_anti")


def render_figure(title: Column, caption: Column, alt: Column, path: Column) -> Column:
    """Image, if there is a path, and caption or title below it; empty if there is none of them."""
    full = lambda x: F.nullif(x, F.lit(""))
    image = F.when(full(path).isNotNull(), F.concat(F.lit("!["), F.coalesce(full(alt), full(title), F.lit("Figura")), F.lit(f"]({ASSETS}/"), path, F.lit(")")))
    below = F.concat(F.lit("*"), F.coalesce(full(caption), full(title)), F.lit("*"))
    return F.array_join(F.array(image, below), "\n")


def render_equation(latex: Column, inline: Column, label: Column) -> Column:
    """In single marks, or between lines of double ones with its label below."""
    block = F.array_join(F.array(F.lit("$$"), latex, F.lit("$$"), F.concat(F.lit("*("), F.nullif(label, F.lit("")), F.lit(")*"))), "\n")
    return F.when(inline, F.concat(F.lit("$"), latex, F.lit("$"))).otherwise(block)


def render_table(columns: Column, data: Column, title: Column | None = None, markdown: Column | None = None) -> Column:
    """An answer's own Markdown if there is one, else a grid: rows padded or cut to the header's length, `Col 1` and so on
    without a header, empty without rows and header; the title in bold above."""
    names = F.when(F.size(columns) > 0, columns).otherwise(F.transform(F.coalesce(F.get(data, F.lit(0)), F.array().cast("array<string>")), lambda _, i: F.concat(F.lit("Col "), i + 1)))
    n = F.size(names)
    bar = lambda row: F.concat(F.lit("| "), F.array_join(row, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(names, lambda _: F.lit("---")), "|"), F.lit("|"))
    fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    grid = F.when(n > 0, F.array_join(F.concat(F.array(bar(names), rule), F.transform(data, lambda r: bar(fit(r)))), "\n")).otherwise("")
    if markdown is not None:
        grid = F.coalesce(F.nullif(markdown, F.lit("")), grid)
    return grid if title is None else F.concat(F.coalesce(F.concat(F.lit("**"), F.nullif(title, F.lit("")), F.lit("**\n\n")), F.lit("")), grid)
