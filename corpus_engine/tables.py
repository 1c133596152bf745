"""The given tables and the tables derived from them (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.chunking import fixed_windows
from corpus_engine.session import cut_lineage

# Extension by doc_id % 5, and its media type.
EXTENSIONS = ["json", "csv", "pdf", "docx", "txt"]
MEDIA_TYPES = {
    "json": "application/json",
    "csv": "text/csv",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a table that costly column work follows on.

    A table of fewer files than cores would leave that work to few tasks, so its rows are dealt out to
    the cores; a table of more files is not moved.
    """
    df = load(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores
    return df.select(*columns).repartition(cores) if few else df.select(*columns)


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file, a folder of files, or several of either (``name*.parquet``).

    The pattern stands in the path, as a filter on names would look at the files inside a folder.
    """
    return spark.readStream.schema(load(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")


def pick(options: list[str], index: Column) -> Column:
    """The option at ``index`` (0-based) of a literal list."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def user_of(key: Column) -> Column:
    return F.concat(F.lit("user"), (key % 5).cast("string"))


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(
        k.alias("workspace_id"),
        F.col("n_name").alias("title"),
        user_of(k).alias("user_id"),
        (k % 3 == 0).alias("public"),
        (k % 7 != 0).alias("active"),
    )


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("context_id"),
        F.col("c_nationkey").alias("workspace_id"),
        F.col("c_name").alias("title"),
        user_of(F.col("c_custkey")).alias("user_id"),
        (F.col("c_acctbal") > 0).alias("public"),
        (F.col("c_mktsegment") != "MACHINERY").alias("active"),
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    ext = pick(EXTENSIONS, F.col("doc_id") % 5)
    kind = pick([MEDIA_TYPES[e] for e in EXTENSIONS], F.col("doc_id") % 5)
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.expr("cast(substr(source, 4) as int)").alias("workspace_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        ext.alias("ext"),
        kind.alias("document_type"),
        F.col("lang").alias("language"),
        (F.col("doc_id") % 4 != 0).alias("processed"),
    )


def context_files(spark: SparkSession, d: str) -> DataFrame:
    n = row_count(load(spark, d, "documents"))
    return (
        load(spark, d, "orders")
        .select(F.col("o_custkey").alias("context_id"), (F.col("o_orderkey") % n).alias("file_id"))
        .distinct()
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = load_spread(spark, d, "documents", ["doc_id", "text", "lang"])
    docs = docs.select(F.col("doc_id").alias("file_id"), "text", F.col("lang").alias("language"))
    return fixed_windows(docs, "text", keep=["file_id", "language"])


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return (
        load(spark, d, "embeddings")
        .join(docs, "vec_id")
        .select(F.col("vec_id").alias("file_id"), "embedding", F.col("lang").alias("language"))
    )


def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with a vector: the fact table of a search."""
    emb = load(spark, d, "embeddings")
    cut = chunks(spark, d)
    vec_id = (F.col("file_id") * 31 + F.col("chunk_index")) % row_count(emb)
    return cut.withColumn("vec_id", vec_id).join(emb.select("vec_id", "embedding"), "vec_id").drop("vec_id")


#: Folder of the stored chunk table by application and tables.
_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table as an ingest would have stored it: texts cut and joined with their vectors once a session.

    Every search reads this table; only the first of an application writes it.
    """
    key = spark.sparkContext.applicationId, d
    if key not in _STORED:
        _STORED[key] = cut_lineage(chunk_store(spark, d))
    return _STORED[key]


def question_vectors(asked: DataFrame, emb: DataFrame) -> DataFrame:
    """A vector and a language (by ``qid % 4``) for every question id."""
    placed = asked.select(
        "qid",
        (F.col("qid") % row_count(emb)).alias("vec_id"),
        pick(["es", "en", "fr", "de"], F.col("qid") % 4).alias("qlang"),
    )
    return placed.join(emb.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").drop("vec_id")


def report_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("qid"))
    return question_vectors(asked, load(spark, d, "embeddings"))


def context_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per context."""
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("qid"))
    return question_vectors(asked, load(spark, d, "embeddings"))


def order_docs(spark: SparkSession, d: str) -> DataFrame:
    """One nested JSON record per order line; ``file_id`` is the supplier that sent it.

    The record sits at line grain so that no order, however large, is gathered into one value.
    """
    used = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_returnflag l_linestatus".split()
    # Orders meet their customer first, so that the many lines are moved for two joins, not for three.
    orders = load(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    orders = orders.join(load(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    # Merged, as lines that were sent whole to few files of orders would leave all that follows to as few tasks.
    lines = load_spread(spark, d, "lineitem", used).hint("merge").join(orders, "l_orderkey")
    lines = lines.join(load(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    record = F.struct(
        F.year("o_orderdate").alias("anio"),
        F.col("o_orderstatus").alias("estado"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgente"),
        F.struct(F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("segmento")).alias("cliente"),
        F.array(
            F.struct(F.col("p_name").alias("articulo"), F.col("l_quantity").cast("int").alias("cantidad")),
            F.struct(F.col("p_type").alias("articulo"), F.col("l_linenumber").alias("cantidad")),
        ).alias("partidas"),
        F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>"))
        .otherwise(F.array("o_orderpriority", "p_brand"))
        .alias("etiquetas"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("nota_interna"),
    )
    return lines.select(
        F.col("l_suppkey").alias("file_id"),
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.to_json(record, {"ignoreNullFields": "false"}).alias("doc"),
    )


# Schema of the record above, in record order.
ORDER_DOC_SCHEMA = (
    "anio int, estado string, total double, urgente boolean, "
    "cliente struct<nombre: string, segmento: string>, "
    "partidas array<struct<articulo: string, cantidad: int>>, etiquetas array<string>, nota_interna string"
)


def reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    ext = pick(["pdf", "word", "csv", "pptx", "txt"], k % 5)
    return load(spark, d, "orders").select(
        k.alias("report_id"),
        F.col("o_custkey").alias("context_id"),
        F.when(k % 11 != 0, user_of(k)).alias("user_id"),
        F.col("o_orderpriority").alias("report_type"),
        F.col("o_orderstatus").alias("status"),
        ext.alias("file_format"),
        F.when(k % 2 == 0, "markdown").otherwise("plain_text").alias("output_format"),
        F.col("o_orderdate").alias("created"),
        F.when(k % 3 != 0, F.concat(F.lit("reports/"), k.cast("string"), F.lit("."), ext)).alias("file_path"),
        F.when(k % 4 == 0, F.concat(F.lit("https://maps.example.org/"), k.cast("string"))).alias("external_url"),
    )


def report_files(spark: SparkSession, d: str) -> DataFrame:
    n = row_count(load(spark, d, "documents"))
    return (
        load(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("report_id"), (F.col("l_partkey") % n).alias("file_id"))
        .distinct()
    )


def model_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    titled = F.initcap("p_name")
    name = (
        F.when(k % 11 == 0, F.concat(F.lit("Museo "), titled))
        .when(k % 13 == 0, F.concat(titled, F.lit(" 7")))
        .otherwise(titled)
    )
    kinds = ["país", "estado", "municipio", "localidad", "ciudad", "museo", "edificio"]
    context = (
        F.when(k % 4 == 0, F.concat(F.lit("El viaje pasa por "), name, F.lit(" cada mes.")))
        .when(k % 4 == 1, F.lit("Una frase sin el lugar."))
        .when(k % 4 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Se cita "), F.element_at(F.split(name, " "), -1), F.lit(" en el texto.")))
    )
    return load(spark, d, "part").select(
        (k % 20).alias("file_ord"),
        (k % 7).alias("batch"),
        k.alias("pos"),
        name.alias("name"),
        pick(kinds, F.col("p_size") % 7).alias("type"),
        context.alias("context"),
        F.when(k % 5 == 0, "N/A").when(k % 5 != 1, F.col("p_brand")).alias("estado"),
        F.when(k % 6 == 0, "n/a").when(k % 6 != 1, F.lit("México")).alias("pais"),
        F.when(k % 9 != 0, F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100)).alias(
            "coordenadas"
        ),
    )


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    """One boundary row per known place name."""
    name = F.initcap("p_name")
    shape = F.when(F.length("p_name") % 2 == 0, "Polygon").otherwise("Point")
    return (
        load(spark, d, "part")
        .select(name.alias("name"), shape.alias("geometry_type"))
        .distinct()
        .withColumn("geometry", F.concat("geometry_type", F.lit("("), "name", F.lit(")")))
    )


def model_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata read from the file (``file_*``) and answered by a model (``model_*``)."""
    k = F.col("doc_id")
    docs = load(spark, d, "documents")
    orders = load(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    day = F.col("o_orderdate")
    dates = (
        F.when(k % 4 == 0, F.date_format(day, "yyyy-M-d"))
        .when(k % 4 == 1, F.concat(F.lit("el "), F.date_format(day, "d/M/yyyy")))
        .when(k % 4 == 2, F.date_format(day, "d-M-yyyy"))
        .otherwise(F.concat(F.lit("año "), F.date_format(day, "yyyy")))
    )
    licenses = ["CC BY-SA 4.0", "MIT License", "Creative Commons", "cc-by", "GNU GPL v3", "Uso interno", "CC0", " "]
    kinds = ["Base de datos", "Informe anual", "Mapa base", "Un documento", "Artículo", "Otro", "Estudio y mapa"]
    langs = ["Español", "english", "fr", "Idioma alemán", "?", "No disponible", "PT"]
    return docs.join(orders, "doc_id").select(
        "doc_id",
        F.when(k % 3 != 0, F.concat(F.lit("Archivo "), k.cast("string"))).alias("file_title"),
        F.when(k % 5 != 0, F.concat(F.lit("Informe de "), "o_orderpriority")).alias("model_title"),
        F.when(k % 4 != 0, F.concat(F.lit("Tema "), "source")).alias("file_description"),
        F.when(k % 6 == 0, "No disponible").when(k % 6 == 1, "").otherwise(F.concat(F.lit("Trata de "), "lang")).alias(
            "model_description"
        ),
        F.when(k % 2 == 0, F.concat(F.lit("D:"), F.date_format(day, "yyyyMMdd"), F.lit("120000Z"))).alias("file_date"),
        F.when(k % 7 != 0, dates).alias("model_date"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" Autor "), "source")).alias("file_creator"),
        F.when(k % 4 == 0, F.concat(F.lit("Firmado por: Ana "), "source"))
        .when(k % 4 == 1, F.lit("Luis Pérez, María López y Luis Pérez"))
        .when(k % 4 == 2, F.lit("sin firma de nadie conocido"))
        .alias("model_creator"),
        F.when(k % 5 == 0, "Agua; suelo, AGUA").alias("file_keywords"),
        F.when(k % 3 == 1, F.concat(F.lit("1. Clima\n2. "), "o_orderpriority", F.lit("\n- ríos, mares, lagos")))
        .when(k % 3 == 2, F.lit("temas: Agua, suelo, clima"))
        .alias("model_keywords"),
        F.when(k % 4 == 0, F.concat(F.lit("doi 10.1234/abc."), k.cast("string"), F.lit(" fin")))
        .when(k % 4 == 1, F.lit("ID 0F8FAD5B-D9CB-469F-A165-70867728950E"))
        .when(k % 4 == 2, F.lit("ninguno"))
        .alias("model_identifier"),
        pick(kinds, k % 7).alias("model_type"),
        F.when(k % 3 == 0, "Editor A").alias("file_publisher"),
        F.when(k % 2 == 0, "Instituto B").when(k % 10 == 1, "n/a").alias("model_publisher"),
        pick(licenses, k % 8).alias("model_rights"),
        pick(langs, k % 7).alias("model_language"),
        F.when(k % 5 < 2, F.col("lang")).alias("file_language"),
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions in prose built from every order."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    seg = F.lower("c_mktsegment")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("dame los registros entre "), year, F.lit(" y "), year + 2))
        .when(
            k % 8 == 1,
            F.concat(F.lit("quiero los registros con total mayor a "), F.floor("o_totalprice").cast("string")),
        )
        .when(k % 8 == 2, F.lit("hola"))
        .when(k % 8 == 3, F.concat(F.lit("haz un resumen de "), seg, F.lit(" popular")))
        .when(k % 8 == 4, F.concat(F.lit("¿Cuáles son los documentos sobre "), seg, F.lit(" de "), year, F.lit("?")))
        .when(k % 8 == 5, F.concat(F.lit("lista "), seg, F.lit(" desde "), year, F.lit(" hasta "), year + 1))
        .when(
            k % 8 == 6,
            F.concat(F.lit("mostrar datos con menos de "), F.floor("o_totalprice").cast("string"), F.lit(" en "), seg),
        )
        .otherwise(F.concat(F.lit("Muchas gracias!")))
    )
    orders = load_spread(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    orders = orders.withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(load(spark, d, "customer"), "c_custkey").select(k.alias("qid"), text.alias("text"))


def model_responses(spark: SparkSession, d: str) -> DataFrame:
    """Raw model answers that carry entities, one per part, in six shapes by ``id % 6``."""
    k = F.col("p_partkey")
    item = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "type": "'), "p_type", F.lit('"}'))
    obj = F.concat(F.lit('{"entities": ['), item, F.lit("]}"))
    arr = F.concat(F.lit("["), item, F.lit(", "), item, F.lit("]"))
    return load(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 6 == 0, obj)
        .when(k % 6 == 1, arr)
        .when(k % 6 == 2, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(k % 6 == 3, F.concat(F.lit("Claro, aquí está: "), arr, F.lit(" Espero que sirva.")))
        .when(k % 6 == 4, F.concat(F.lit('{"entities": ['), item))
        .otherwise("")
        .alias("response"),
    )
