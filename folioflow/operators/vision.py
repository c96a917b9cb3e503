"""Pages that plain text cannot give: which to ask a vision model about, the answers, their union with the text's elements."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..inference import answers, elements
from .structure import PAGE

# The least width and height of an image, and the resolution and longest side of a rendered page.
LEAST_SIDE, DPI, LONGEST_SIDE = 50, 150, 2048


def requests(routing: DataFrame, rendered: DataFrame) -> DataFrame:
    """The plan of each page that needs it beside its image: routing (see sections.routing) joined with rendered (doc_id,
    page, image). Only routed pages need be rendered. Pages without image are left out."""
    routed = routing.where((F.size("for_vision") > 0) | F.col("requires_full_page_vision"))
    return routed.select(*PAGE, "for_vision", "requires_full_page_vision", "reason").join(rendered.select(*PAGE, "image"), [*PAGE])


def ask(requested: DataFrame, backend: answers.Backend, prompt: str = "Descreva a página {page} em JSON com content, tables, figures e equations.", retries: int = 3, delay: float = 1.0) -> DataFrame:
    """doc_id, page, answer, answer_error of each request. The backend gets the prompt and, behind an empty line, the image
    in base64."""
    text = F.concat(F.replace(F.lit(prompt), F.lit("{page}"), F.col("page").cast("string")), F.lit("\n\n"), F.base64("image"))
    return answers.ask(requested, text, backend, retries, delay).select(*PAGE, "answer", "answer_error")


def with_text(tables: DataFrame, equations: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, equations, figures): elements of the text, then those of answers (doc_id, page, answer), each id once."""
    read = elements.read_pages(answered)
    return elements.united(tables, elements.tables(read)), elements.united(equations, elements.equations(read)), elements.figures(read)


def totals(pages: DataFrame, answered: DataFrame | None = None, schema: bool = False, extracted: bool = False) -> DataFrame:
    """doc_id, vision_calls, tokens of every file: answers about pages, the tokens they used where given (column tokens),
    and the fixed reckoning for an inferred schema and extracted entities."""
    fixed = answers.SCHEMA_TOKENS * schema + answers.ENTITY_TOKENS * extracted
    docs = pages.select("doc_id").distinct()
    if answered is None:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("vision_calls"), F.lit(fixed).cast("bigint").alias("tokens"))
    used = F.sum("tokens") if "tokens" in answered.columns else F.lit(0).cast("bigint")
    calls = answered.groupBy("doc_id").agg(F.count("*").alias("vision_calls"), used.alias("used"))
    return docs.join(calls, "doc_id", "left").select("doc_id", F.coalesce("vision_calls", F.lit(0)).alias("vision_calls"), (F.coalesce("used", F.lit(0)) + fixed).cast("bigint").alias("tokens"))
