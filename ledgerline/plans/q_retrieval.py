"""Policy retrieval queries (J1-J5) over the documents, embeddings and
benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import compact
from ..operators import retrieval as J
from ..operators.registry import no_violations
from ..policy import CHUNK_MIN_CHARS
from ..session import shared_table
from ..sources.tables import read_table
from .catalog import query
from .q_scoring import STORED, invoices

# Fixed policy questions for keyword search (query text is a parameter).
POLICY_QUESTIONS = ("invoice approval policy for amount 5000", "vendor payment terms")

# Fixed words of an invoice's amount query and vendor query.
POLICY_WORDS = {1: "invoice approval policy for amount", 2: "vendor payment terms"}


def markdown_docs(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
                    J.sectioned_markdown(F.col("text")).alias("markdown"))


def chunks(spark, sf):
    return J.chunk_documents(markdown_docs(spark, sf))


def _sections_sql(lines_per_section: int = 5) -> str:
    """``sectioned_markdown`` over ``documents``: (doc_id, source, markdown)."""
    k = lines_per_section
    return f"""sections AS (
  SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS source, string_split(text, chr(10)) AS ls
  FROM documents WHERE text IS NOT NULL),
markdown AS (
  SELECT doc_id, source, array_to_string(list_transform(range(0, greatest(1, (len(ls) + {k - 1}) // {k})),
    lambda i: '## Section ' || CAST(i + 1 AS VARCHAR) || chr(10) || chr(10)
              || array_to_string(ls[i * {k} + 1:i * {k} + {k}], chr(10))), chr(10) || chr(10)) AS md
  FROM sections)"""


# A mark stands before each header sign that a chunk may begin with (the last
# three '#' before a space), so that no look-ahead is needed; a text that begins
# with one has no empty piece before it.
CHUNK_SQL = f"""{_sections_sql()},
marked AS (
  SELECT doc_id, source, replace(replace(replace(md, '# ', chr(1) || '# '), '#' || chr(1) || '# ',
    chr(1) || '#' || chr(1) || '# '), '#' || chr(1) || '#' || chr(1) || '# ',
    chr(1) || '#' || chr(1) || '#' || chr(1) || '# ') AS md FROM markdown),
split AS (
  SELECT doc_id, source, string_split_regex(CASE WHEN starts_with(md, chr(1)) THEN substring(md, 2) ELSE md END,
    '\\n{{2,}}|\\x01') AS parts FROM marked),
pieces AS (
  SELECT doc_id, source, unnest(range(0, len(parts))) AS chunk_index, unnest(parts) AS raw FROM split),
stripped AS (
  SELECT doc_id, source, CAST(chunk_index AS INTEGER) AS chunk_index,
    regexp_replace(raw, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS text FROM pieces),
chunks AS (
  SELECT *, md5(source || ':' || CAST(chunk_index AS VARCHAR) || ':' || substring(text, 1, 50)) AS chunk_id
  FROM stripped WHERE length(text) >= {CHUNK_MIN_CHARS})"""


def _keyword_sql(questions) -> str:
    each = []
    for i, text in enumerate(questions):
        terms = text.lower().split()
        score = " + ".join(f"contains(lower(text), '{t}')::INTEGER" for t in terms)
        each.append(f"SELECT {i} AS query_id, {len(terms)} AS n_terms, chunk_id, doc_id, chunk_index, {score} AS score "
                    "FROM chunks")
    return f"""WITH {CHUNK_SQL},
scores AS ({" UNION ALL ".join(each)}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank
         FROM scores WHERE score > 0)
SELECT query_id, rank, chunk_id, score, CAST(score AS DOUBLE) / n_terms AS relevance_score FROM best WHERE rank <= 3"""


@query("chunk_documents", f"WITH {CHUNK_SQL} SELECT doc_id, chunk_index, chunk_id, length(text) AS n_chars FROM chunks")
def chunk_documents(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id", F.length("text").alias("n_chars"))


@query("chunks_to_index", f"""WITH {CHUNK_SQL},
known AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT chunk_id, doc_id, false AS inserted FROM known
UNION ALL SELECT chunk_id, doc_id, true FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM known)""")
def chunks_to_index(spark, sf):
    """The existing index holds the chunks of labelled documents; the build
    adds every missing chunk id."""
    c = chunks(spark, sf)
    labelled = read_table(spark, sf, "labels", "doc_id")
    existing = c.join(labelled, "doc_id", "left_semi")
    return J.index_chunks(existing, c).select("chunk_id", "doc_id", "inserted")


@query("keyword_topk", _keyword_sql(POLICY_QUESTIONS))
def keyword_topk(spark, sf):
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(POLICY_QUESTIONS)], "query_id int, query string")
    top = J.keyword_topk(qs, shared_table(chunks(spark, sf), "passages"), k=3)
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score",
                      "relevance_score")


def _vec_sql() -> str:
    dot = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"
    qv, ev = "CAST(q.qv AS DOUBLE[])", "CAST(e.embedding AS DOUBLE[])"
    d = (f"1.0 - {dot.format(a=qv, b=ev)} / (sqrt({dot.format(a=qv, b=qv)}) * sqrt({dot.format(a=ev, b=ev)}))")
    return f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
p AS (SELECT q.query_id, e.vec_id, {d} AS d FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
SELECT query_id, vec_id, rank, round(d, 4) + 0.0 AS distance, round(1.0 - d, 4) + 0.0 AS relevance_score
FROM r WHERE rank <= 3"""


@query("vector_topk", _vec_sql())
def vector_topk(spark, sf):
    """Queries: one exemplar per label (its lowest vec_id), against every
    embedding, exactly."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qvec")).withColumnRenamed("label", "query_id")
    top = J.vector_topk(q, e.select("vec_id", "embedding"), k=3)
    return top.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "distance",
                      "relevance_score")


def _policy_sql() -> str:
    terms = "string_split_regex(trim(lower(query)), '\\s+')"
    return f"""{STORED},
qs AS (SELECT invoice_id, 1 AS q_no, 'invoice approval policy for amount ' || CAST(CAST(total AS DOUBLE) AS VARCHAR) AS query
       FROM stored
       UNION ALL SELECT invoice_id, 2, 'vendor payment terms ' || vendor_name FROM stored WHERE vendor_name <> ''),
corpus AS (SELECT item_id AS doc_id, 'benchmark' AS source, text, lower(text) AS low FROM benchmark),
sc AS (SELECT qs.invoice_id, qs.q_no, c.doc_id, c.source, c.text,
         len(list_filter({terms}, lambda t: contains(c.low, t))) AS score FROM qs CROSS JOIN corpus c),
top AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, q_no ORDER BY score DESC, doc_id) AS r
        FROM sc WHERE score > 0),
t2 AS (SELECT * FROM top WHERE r <= 2),
dd AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, text ORDER BY q_no, r) AS d FROM t2),
k AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY q_no, r) AS o FROM dd WHERE d = 1),
ctx AS (SELECT invoice_id, string_agg('[' || source || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
          ORDER BY o) AS context FROM k WHERE o <= 3 GROUP BY invoice_id)
SELECT i.invoice_id, coalesce(ctx.context, 'No relevant policy context found.') AS context
FROM (SELECT DISTINCT invoice_id FROM qs) i LEFT JOIN ctx USING (invoice_id)"""


@query("policy_context", _policy_sql())
def policy_context(spark, sf):
    """Per stored invoice: the amount query and (if a vendor is named) the
    vendor query against the policy corpus (the benchmark passages)."""
    st = invoices(spark, sf).where(no_violations())
    own = compact(
        F.struct(F.lit(1).alias("q_no"), F.col("total").cast("double").cast("string").alias("own")),
        F.when(F.col("vendor_name") != "", F.struct(F.lit(2).alias("q_no"), F.col("vendor_name").alias("own"))))
    asked = st.select("invoice_id", F.inline(own))
    b = read_table(spark, sf, "benchmark", "item_id", "text")
    corpus = b.select(F.md5(F.concat(F.lit("benchmark:"), F.col("item_id").cast("string"))).alias("chunk_id"),
                      F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_index"),
                      F.lit("benchmark").alias("source"), "text")
    return J.policy_context(asked, POLICY_WORDS, corpus)
