"""Answers about pages and texts to elements and entities: built-in JSON functions, null where an answer is unreadable."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure elements of an answer are.
TABLE_SURE, FIGURE_SURE, EQUATION_SURE = 0.9, 0.85, 0.9

PAGE_ANSWER = (
    "content string, tables array<struct<title:string,headers:array<string>,data:array<array<string>>,has_merged_cells:boolean,markdown:string>>, "
    "figures array<struct<title:string,caption:string,description:string,alt_text:string,type:string>>, equations array<struct<latex:string,label:string,is_inline:boolean>>"
)
ENTITY_ANSWER = (
    "people array<struct<name:string,role:string>>, organizations array<struct<name:string,type:string>>, locations array<struct<name:string,type:string>>, "
    "dates array<struct<original:string,normalized:string,context:string>>, monetary_values array<struct<original:string,value:double,currency:string,context:string>>, technical_terms array<string>"
)

# Words that tell a kind of document.
KEYWORDS = {
    "contrato": ("contrato", "contratante", "contratada", "cláusula", "vigência", "objeto"),
    "laudo_tecnico": ("laudo", "vistoria", "patologia", "constatação", "parecer técnico", "art"),
    "relatorio": ("relatório", "período", "análise", "resultados", "conclusão"),
    "manual": ("manual", "instruções", "procedimento", "passo a passo", "operação"),
    "artigo": ("resumo", "abstract", "introdução", "metodologia", "referências"),
    "ata": ("ata", "reunião", "assembleia", "deliberação", "pauta"),
    "parecer": ("parecer", "análise jurídica", "fundamentação", "conclusão"),
    "proposta": ("proposta", "orçamento", "escopo", "prazo", "investimento"),
    "norma": ("norma", "regulamento", "política", "diretrizes", "procedimentos"),
}


def body(answer: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def _listed(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(F.col(f"a.{field}")).alias("idx", "e"))


def read_pages(answers: DataFrame) -> DataFrame:
    """answers (doc_id, page, answer) with `a`, the parsed answer."""
    return answers.select("doc_id", "page", F.from_json(body(F.col("answer")), PAGE_ANSWER).alias("a"))


def tables(pages: DataFrame) -> DataFrame:
    """Tables of parsed answers: doc_id, page, id, title, columns, data, has_merged_cells, markdown, confidence."""
    t = _listed(pages, "tables", ["doc_id", "page"]).where("e is not null")
    none = F.array().cast("array<string>")
    return t.select(
        "doc_id", "page", F.concat_ws("_", F.lit("table_v"), "page", "idx").alias("id"), "e.title", F.coalesce("e.headers", none).alias("columns"), F.coalesce("e.data", F.array().cast("array<array<string>>")).alias("data"),
        F.coalesce("e.has_merged_cells", F.lit(False)).alias("has_merged_cells"), "e.markdown", F.lit(TABLE_SURE).alias("confidence"),
    )


def figures(pages: DataFrame) -> DataFrame:
    """doc_id, page, id, title, caption, alt_text, figure_type, confidence."""
    f = _listed(pages, "figures", ["doc_id", "page"]).where("e is not null")
    alt = F.coalesce(F.nullif(F.col("e.description"), F.lit("")), F.col("e.alt_text"))
    return f.select("doc_id", "page", F.concat_ws("_", F.lit("fig_v"), "page", "idx").alias("id"), "e.title", "e.caption", alt.alias("alt_text"), F.coalesce("e.type", F.lit("other")).alias("figure_type"), F.lit(FIGURE_SURE).alias("confidence"))


def equations(pages: DataFrame) -> DataFrame:
    """doc_id, page, id, latex, label, is_inline, confidence."""
    q = _listed(pages, "equations", ["doc_id", "page"]).where("e is not null")
    return q.select("doc_id", "page", F.concat_ws("_", F.lit("eq_v"), "page", "idx").alias("id"), F.coalesce("e.latex", F.lit("")).alias("latex"), "e.label", F.coalesce("e.is_inline", F.lit(False)).alias("is_inline"), F.lit(EQUATION_SURE).alias("confidence"))


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all frames; of those with one doc_id and id the one of the earliest frame. Columns that a frame lacks are
    null."""
    every = first.withColumn("_rank", F.lit(0))
    for k, other in enumerate(others, 1):
        every = every.unionByName(other.withColumn("_rank", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("doc_id", "id", "_rank")]
    best = every.groupBy("doc_id", "id").agg(F.min_by(F.struct(*rest), "_rank").alias("r"))
    return best.select("doc_id", "id", "r.*")


def read_entities(answers: DataFrame) -> DataFrame:
    """doc_id and arrays people, organizations, locations, dates, monetary_values, technical_terms of answers (doc_id,
    answer); items without name or original are left out, unreadable answers have empty arrays."""
    a = answers.select("doc_id", F.from_json(body(F.col("answer")), ENTITY_ANSWER).alias("a"))
    named = lambda field, key: F.coalesce(F.filter(F.col(f"a.{field}"), lambda e: F.coalesce(e[key], F.lit("")) != ""), F.from_json(F.lit("[]"), a.select(f"a.{field}").schema[0].dataType)).alias(field)
    return a.select("doc_id", *[named(f, "name") for f in ("people", "organizations", "locations")], *[named(f, "original") for f in ("dates", "monetary_values")], F.coalesce("a.technical_terms", F.array().cast("array<string>")).alias("technical_terms"))


def keyword_type(pages: DataFrame) -> DataFrame:
    """doc_id, document_type, hits: the kind of which most words occur in a file's pages, of equals the first listed; null
    with no hit. One aggregate of booleans per file."""
    low = F.lower(F.coalesce("raw_text", F.lit("")))
    there = [F.bool_or(low.contains(w)).alias(f"{k}:{i}") for k, words in KEYWORDS.items() for i, w in enumerate(words)]
    rows = pages.groupBy("doc_id").agg(*there)
    score = [F.struct(sum((F.col(f"`{k}:{i}`").cast("int") for i in range(1, len(words))), F.col(f"`{k}:0`").cast("int")).alias("hits"), F.lit(-n).alias("rank"), F.lit(k).alias("kind")) for n, (k, words) in enumerate(KEYWORDS.items())]
    best = F.greatest(*score)
    return rows.select("doc_id", F.when(best["hits"] > 0, best["kind"]).alias("document_type"), best["hits"].alias("hits"))
