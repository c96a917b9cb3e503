"""The whole conversion over a corpus: pages in, tables out. Every step is a DataFrame; nothing runs before it is used."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..inference import answers as inference
from ..operators import chunks, entities, sections, structure, vision
from ..operators import figures as pictures
from ..sinks import documents
from .runtime import checkpointed


@dataclass(frozen=True)
class Config:
    """Options of a conversion; sizes in tokens."""

    chunk_size: int = chunks.SIZE
    chunk_overlap: int = chunks.OVERLAP
    chunk_most: int = chunks.MOST
    prefer_vision_for_tables: bool = False
    prefer_vision_for_equations: bool = False
    frontmatter: bool = True
    extract_entities: bool = True
    raw_text: bool = False


def convert(
    pages: DataFrame, config: Config = Config(), blocks: DataFrame | None = None, answers: DataFrame | None = None, figures: DataFrame | None = None, page_answers: DataFrame | None = None, assets: DataFrame | None = None, schemas: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables of a corpus of pages (doc_id, page, raw_text). blocks: those with fonts and boxes, where a source gives
    them; else the lines of raw_text. answers (doc_id, answer): a model's entities of the files, to which those by pattern
    are added; page_answers (doc_id, page, answer): a vision model's about pages, whose elements join those of the text;
    figures: more of those of elements.figures(); assets (doc_id, page, idx, name): extracted images; schemas: what
    inference.answers.infer() gave. Backends are asked outside: operators.vision, inference.answers."""
    pages = structure.once(pages)
    block = structure.blocks(pages) if blocks is None else blocks
    classified = structure.classify(block) if blocks is None else structure.classify_calibrated(block)  # lines have no fonts
    # Every line is classified once; headings and paragraphs are read from what was written.
    found = checkpointed(structure.page_elements(classified))
    heads, paras = structure.headings_of(found), structure.contents_of(found)
    tables, equations, notes = structure.tables(pages), structure.equations(pages), structure.footnotes(block)
    seen = figures
    if page_answers is not None:
        tables, equations, looked = vision.with_text(tables, equations, page_answers)
        tables = tables.withColumn("table_no", F.coalesce("table_no", F.lit(1 << 20) + F.row_number().over(W.partitionBy("doc_id").orderBy("page", "id"))))
        equations = equations.withColumn("eq_no", F.coalesce("eq_no", F.lit(1 << 20) + F.row_number().over(W.partitionBy("doc_id").orderBy("page", "id"))))
        seen = looked if figures is None else looked.unionByName(figures, allowMissingColumns=True)
    if assets is not None and seen is None:
        shown = pictures.collect(pictures.of_assets(assets))
    else:
        shown = None if seen is None else pictures.collect(seen, assets)
    tree = sections.sections(heads, paras, tables)
    meta, first = sections.metadata(pages, heads), sections.summary(pages)
    sure = sections.confidence(pages, heads, paras, None if schemas is None else schemas.select("doc_id", "confidence"))
    pieces = chunks.generate(tree, tables, config.chunk_size, config.chunk_overlap, config.chunk_most)
    mined = entities.of_files(pages, answers) if config.extract_entities else None
    structured = None if schemas is None else inference.as_dictionary(schemas).withColumnRenamed("dictionary", "structured_data")
    raw = pages if config.raw_text else None
    return {
        "blocks": block, "headings": structure.headings(classified), "paragraphs": structure.paragraphs(classified), "list_items": structure.list_items(classified), "tables": tables, "equations": equations, "footnotes": notes, "sections": tree,
        "routing": sections.routing(pages, classified, tables, equations, notes, structure.paragraphs(classified), config.prefer_vision_for_tables, config.prefer_vision_for_equations, figures=shown),
        "metadata": meta, "summary": first, "confidence": sure, "chunks": pieces, "totals": vision.totals(pages, page_answers, schemas is not None, config.extract_entities),
        "markdown": documents.markdown(meta, tree, tables, first, notes, config.frontmatter, shown), "json": documents.hybrid_json(meta, tree, tables, pieces, first, sure, structured, mined, shown, raw),
        **({} if mined is None else {"entities": mined}), **({} if shown is None else {"figures": shown}),
    }
