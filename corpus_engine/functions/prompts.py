"""Tables of messages and prompts for a model that runs elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_GUIDES = {
    "institutional": "Redacta un reporte institucional: resumen, contexto, hallazgos, conclusiones, recomendaciones.",
    "descriptive": "Describe en secciones los datos, cifras y hechos de la evidencia.",
    "summary": "Resume en una página el objetivo, los puntos clave y la conclusión.",
    "evaluation": "Evalúa criterios, fortalezas, debilidades y recomendaciones.",
}
FORMAT_GUIDES = {
    "markdown": "Responde en Markdown.",
    "plain_text": "Responde en texto sin marcas.",
    "csv": "Responde solo con CSV y una fila de encabezados.",
}
DEFAULT_REPORT, DEFAULT_FORMAT = "descriptive", "markdown"

FIELD_QUESTIONS = {
    "title": "¿Qué título lleva el documento?",
    "description": "Resume el documento.",
    "dateIssued": "¿De qué fecha es el documento?",
    "resourceType": "¿Qué tipo de recurso es?",
    "identifier": "¿Qué DOI o UUID lo identifica?",
    "creator": "¿Quiénes son sus autores?",
    "publisher": "¿Qué institución lo publica?",
    "subject": "Enumera sus palabras clave, separadas por comas.",
    "rights": "¿Bajo qué licencia está?",
    "language": "¿En qué idioma está escrito?",
}


def looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(table[default]))


def prompt_format(file_format: Column, output_format: Column) -> Column:
    """CSV and text files decide the format of the answer, other files leave it to the request."""
    return F.when(file_format == "csv", "csv").when(file_format == "txt", "plain_text").otherwise(output_format)


def build_messages(report_type: Column, answer_format: Column, payload: Column) -> Column:
    """System and user message; the payload holds report name, instructions and evidence."""
    system = F.concat_ws(
        "\n\n",
        looked_up(report_type, REPORT_GUIDES, DEFAULT_REPORT),
        looked_up(answer_format, FORMAT_GUIDES, DEFAULT_FORMAT),
    )
    user = F.to_json(payload, {"ignoreNullFields": "false"})
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def metadata_prompts(contexts: DataFrame, key: str, context: str) -> DataFrame:
    """Ten prompts per file, one for each metadata field."""
    asked = F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(q).alias("question")) for f, q in FIELD_QUESTIONS.items()]
    )
    rows = contexts.select(key, context, F.inline(asked))
    prompt = F.concat(
        F.lit("CONTEXTO:\n"), F.col(context), F.lit("\n\nPREGUNTA: "), F.col("question"), F.lit("\n\nRESPUESTA:")
    )
    return rows.select(key, "field", prompt.alias("prompt"))
