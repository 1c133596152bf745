"""SQL texts that check the queries: derived tables as CTEs over the given tables."""

from __future__ import annotations

import re

CTES = {
    "workspaces": """
        SELECT n_nationkey AS workspace_id, n_name AS title, 'user' || (n_nationkey % 5) AS user_id,
               n_nationkey % 3 = 0 AS public, n_nationkey % 7 <> 0 AS active FROM nation""",
    "contexts": """
        SELECT c_custkey AS context_id, c_nationkey AS workspace_id, c_name AS title,
               'user' || (c_custkey % 5) AS user_id, c_acctbal > 0 AS public,
               c_mktsegment <> 'MACHINERY' AS active FROM customer""",
    "files": """
        SELECT doc_id AS file_id, CAST(substr(source, 4) AS INT) AS workspace_id,
               source || '_' || doc_id || '.' || e AS filename, e AS ext,
               CASE e WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv'
                      WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain'
                      ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END
                 AS document_type,
               lang AS language, doc_id % 4 <> 0 AS processed
        FROM (SELECT *, ['json', 'csv', 'pdf', 'docx', 'txt'][doc_id % 5 + 1] AS e FROM documents)""",
    "context_files": """
        SELECT DISTINCT o_custkey AS context_id, o_orderkey % (SELECT count(*) FROM documents) AS file_id
        FROM orders""",
    "chunks": """
        SELECT file_id, CAST(i AS INT) AS chunk_index, substr(t, CAST(i * 800 + 1 AS BIGINT), 1000) AS text,
               language, CAST(length(substr(t, CAST(i * 800 + 1 AS BIGINT), 1000)) AS INT) AS n_chars
        FROM (SELECT doc_id AS file_id, text AS t, lang AS language,
                     unnest(range(greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS i
              FROM documents WHERE length(text) > 0)""",
    "chunk_vectors": """
        SELECT vec_id AS file_id, embedding::DOUBLE[] AS embedding, lang AS language
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "chunk_store": """
        SELECT c.*, e.embedding::DOUBLE[] AS embedding FROM chunks c
        JOIN embeddings e ON e.vec_id = (c.file_id * 31 + c.chunk_index) % (SELECT count(*) FROM embeddings)""",
    "report_questions": """
        SELECT o_orderkey AS report_id, ['es', 'en', 'fr', 'de'][o_orderkey % 4 + 1] AS qlang,
               embedding::DOUBLE[] AS qvec
        FROM orders JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)""",
    "context_questions": """
        SELECT c_custkey AS qid, ['es', 'en', 'fr', 'de'][c_custkey % 4 + 1] AS qlang,
               embedding::DOUBLE[] AS qvec
        FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)""",
    "order_lines": """
        SELECT l_suppkey AS file_id, l_orderkey, l_partkey, l_linenumber,
               CAST(year(o_orderdate) AS INT) AS anio, o_orderstatus AS estado, o_totalprice AS total,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgente, c_name AS nombre,
               c_mktsegment AS segmento, p_name AS art0, CAST(l_quantity AS INT) AS cant0,
               p_type AS art1, l_linenumber AS cant1,
               CASE WHEN l_returnflag = 'N' THEN [] ELSE [o_orderpriority, p_brand] END AS etiquetas,
               CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS nota
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey""",
    "reports": """
        SELECT o_orderkey AS report_id, o_custkey AS context_id,
               CASE WHEN o_orderkey % 11 <> 0 THEN 'user' || (o_orderkey % 5) END AS user_id,
               o_orderpriority AS report_type, o_orderstatus AS status, x AS file_format,
               CASE WHEN o_orderkey % 2 = 0 THEN 'markdown' ELSE 'plain_text' END AS output_format,
               o_orderdate AS created,
               CASE WHEN o_orderkey % 3 <> 0 THEN 'reports/' || o_orderkey || '.' || x END AS file_path,
               CASE WHEN o_orderkey % 4 = 0 THEN 'https://maps.example.org/' || o_orderkey END AS external_url
        FROM (SELECT *, ['pdf', 'word', 'csv', 'pptx', 'txt'][o_orderkey % 5 + 1] AS x FROM orders)""",
    "report_files": """
        SELECT DISTINCT l_orderkey AS report_id, l_partkey % (SELECT count(*) FROM documents) AS file_id
        FROM lineitem""",
    "model_entities": """
        SELECT p_partkey % 20 AS file_ord, p_partkey % 7 AS batch, p_partkey AS pos, name,
               ['país', 'estado', 'municipio', 'localidad', 'ciudad', 'museo', 'edificio'][p_size % 7 + 1] AS type,
               CASE p_partkey % 4 WHEN 0 THEN 'El viaje pasa por ' || name || ' cada mes.'
                    WHEN 1 THEN 'Una frase sin el lugar.' WHEN 2 THEN NULL
                    ELSE 'Se cita ' || string_split(name, ' ')[-1] || ' en el texto.' END AS context,
               CASE WHEN p_partkey % 5 = 0 THEN 'N/A' WHEN p_partkey % 5 <> 1 THEN p_brand END AS estado,
               CASE WHEN p_partkey % 6 = 0 THEN 'n/a' WHEN p_partkey % 6 <> 1 THEN 'México' END AS pais,
               CASE WHEN p_partkey % 9 <> 0 THEN [p_size::DOUBLE, p_retailprice / 100] END
                 AS coordenadas
        FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'Museo ' || tc WHEN p_partkey % 13 = 0 THEN tc || ' 7'
                             ELSE tc END AS name
              FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '),
                              lambda w: upper(w[1]) || lower(w[2:])), ' ') AS tc FROM part))""",
    "boundaries": """
        SELECT DISTINCT name, g AS geometry_type, g || '(' || name || ')' AS geometry
        FROM (SELECT array_to_string(list_transform(string_split(p_name, ' '),
                     lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
                     CASE WHEN length(p_name) % 2 = 0 THEN 'Polygon' ELSE 'Point' END AS g FROM part)""",
    "model_metadata": """
        SELECT doc_id,
          CASE WHEN doc_id % 3 <> 0 THEN 'Archivo ' || doc_id END AS file_title,
          CASE WHEN doc_id % 5 <> 0 THEN 'Informe de ' || o_orderpriority END AS model_title,
          CASE WHEN doc_id % 4 <> 0 THEN 'Tema ' || source END AS file_description,
          CASE doc_id % 6 WHEN 0 THEN 'No disponible' WHEN 1 THEN '' ELSE 'Trata de ' || lang END
            AS model_description,
          CASE WHEN doc_id % 2 = 0 THEN 'D:' || strftime(o_orderdate, '%Y%m%d') || '120000Z' END AS file_date,
          CASE WHEN doc_id % 7 <> 0 THEN
            CASE doc_id % 4 WHEN 0 THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)
              WHEN 1 THEN 'el ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
              WHEN 2 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
              ELSE 'año ' || year(o_orderdate) END END AS model_date,
          CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Autor ' || source END AS file_creator,
          CASE doc_id % 4 WHEN 0 THEN 'Firmado por: Ana ' || source
            WHEN 1 THEN 'Luis Pérez, María López y Luis Pérez'
            WHEN 2 THEN 'sin firma de nadie conocido' END AS model_creator,
          CASE WHEN doc_id % 5 = 0 THEN 'Agua; suelo, AGUA' END AS file_keywords,
          CASE doc_id % 3 WHEN 1 THEN '1. Clima' || chr(10) || '2. ' || o_orderpriority || chr(10)
                                      || '- ríos, mares, lagos'
            WHEN 2 THEN 'temas: Agua, suelo, clima' END AS model_keywords,
          CASE doc_id % 4 WHEN 0 THEN 'doi 10.1234/abc.' || doc_id || ' fin'
            WHEN 1 THEN 'ID 0F8FAD5B-D9CB-469F-A165-70867728950E'
            WHEN 2 THEN 'ninguno' END AS model_identifier,
          ['Base de datos', 'Informe anual', 'Mapa base', 'Un documento', 'Artículo', 'Otro', 'Estudio y mapa']
            [doc_id % 7 + 1] AS model_type,
          CASE WHEN doc_id % 3 = 0 THEN 'Editor A' END AS file_publisher,
          CASE WHEN doc_id % 2 = 0 THEN 'Instituto B' WHEN doc_id % 10 = 1 THEN 'n/a' END AS model_publisher,
          ['CC BY-SA 4.0', 'MIT License', 'Creative Commons', 'cc-by', 'GNU GPL v3', 'Uso interno', 'CC0', ' ']
            [doc_id % 8 + 1] AS model_rights,
          ['Español', 'english', 'fr', 'Idioma alemán', '?', 'No disponible', 'PT'][doc_id % 7 + 1]
            AS model_language,
          CASE WHEN doc_id % 5 < 2 THEN lang END AS file_language
        FROM documents JOIN orders ON doc_id = o_orderkey""",
    "questions": """
        SELECT o_orderkey AS qid, CASE o_orderkey % 8
            WHEN 0 THEN 'dame los registros entre ' || y || ' y ' || (y + 2)
            WHEN 1 THEN 'quiero los registros con total mayor a ' || floor(o_totalprice)::BIGINT
            WHEN 2 THEN 'hola'
            WHEN 3 THEN 'haz un resumen de ' || s || ' popular'
            WHEN 4 THEN '¿Cuáles son los documentos sobre ' || s || ' de ' || y || '?'
            WHEN 5 THEN 'lista ' || s || ' desde ' || y || ' hasta ' || (y + 1)
            WHEN 6 THEN 'mostrar datos con menos de ' || floor(o_totalprice)::BIGINT || ' en ' || s
            ELSE 'Muchas gracias!' END AS text, o_orderkey % 8 AS shape, y, s, floor(o_totalprice) AS price
        FROM (SELECT *, year(o_orderdate) AS y, lower(c_mktsegment) AS s
              FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "model_responses": """
        SELECT p_partkey AS id, CASE p_partkey % 6
            WHEN 0 THEN '{"entities": [' || item || ']}'
            WHEN 1 THEN '[' || item || ', ' || item || ']'
            WHEN 2 THEN '```json' || chr(10) || '{"entities": [' || item || ']}' || chr(10) || '```'
            WHEN 3 THEN 'Claro, aquí está: [' || item || ', ' || item || '] Espero que sirva.'
            WHEN 4 THEN '{"entities": [' || item ELSE '' END AS response, p_name, p_type
        FROM (SELECT *, '{"name": "' || p_name || '", "type": "' || p_type || '"}' AS item FROM part)""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the CTEs it names, directly or through another CTE."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|IN)\s+\(?\s*{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = [f"{name} AS ({known[name]})" for name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body
