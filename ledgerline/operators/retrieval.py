"""Policy retrieval (J1-J5): chunking, incremental index build, exact vector
top-k, keyword top-k and context assembly.

Top-k per query uses ``row_number() <= k`` over a window partitioned by the
query; Spark plans it as a per-partition group limit ahead of the shuffle, so
only k rows per query leave each task. A query term has no white space, so a
passage contains it only inside one of its words: terms are matched with the
distinct words through an index of their character grams, and words lead to
passages. Queries and passages are never paired up: only a query's rare terms
lead to passages, the others are looked up in the passages so found. Vectors
lie in cells around pivots, in rings by their angle to the pivot; the triangle
inequality of angles tells which rings a query need not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..policy import CHUNK_MIN_CHARS, CHUNK_SPLIT
from ..session import shared_table

GRAM = 3  # characters of a gram
PIVOTS = 64  # vectors at the middle of a cell
RING = 0.05  # width of a ring, as an angle
BLOCK = 2048  # vectors of a block, about; also queries
SLACK = 1e-7  # more than rounding adds to an angle


def sectioned_markdown(text: Column, lines_per_section: int = 5) -> Column:
    """The driver's prose has no headers or blank lines: give every
    ``lines_per_section`` lines a '## Section k' header and a blank line."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    k = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / lines_per_section).cast("int") - 1))
    sections = F.transform(k, lambda i: F.concat(
        F.lit("## Section "), (i + 1).cast("string"), F.lit("\n\n"),
        F.array_join(F.slice(lines, i * lines_per_section + 1, lines_per_section), "\n")))
    return F.array_join(sections, "\n\n")


def chunk_documents(docs: DataFrame, text_col: str = "markdown", source_col: str = "source") -> DataFrame:
    """Split on blank lines or before a 1-3 '#' header, strip, drop
    chunks under 50 characters; id = md5(source:index:first 50 chars).
    (Java's split drops a leading empty piece where Python keeps one, so an
    index can be one lower than Python's for a text that starts with '#'.)"""
    parts = docs.select("doc_id", source_col, F.posexplode(F.split(text_col, CHUNK_SPLIT)).alias("chunk_index", "raw"))
    chunks = parts.select("doc_id", source_col, "chunk_index",
                          F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"))
    chunks = chunks.where(F.length("text") >= CHUNK_MIN_CHARS)
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws(":", F.col(source_col), F.col("chunk_index").cast("string"),
                                                          F.substring("text", 1, 50))))


def index_chunks(existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunks whose id the index does not hold, whatever else
    (stale ids included) it holds."""
    new = chunks.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    return (existing.withColumn("inserted", F.lit(False))
            .unionByName(new.withColumn("inserted", F.lit(True)), allowMissingColumns=True))


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _directed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with a direction: a NULL vector, one with a NULL in it and one of
    zeros are left out."""
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    return (df.select(id_col, vec.alias(vec_col))
            .where(F.exists(vec_col, lambda x: x != 0) & ~F.exists(vec_col, lambda x: x.isNull())))


class VectorCells:
    """Vectors in blocks by cell and ring, written once; ``pivots`` and ``rings``
    (cell, ring, number, least and greatest angle) are at most PIVOTS vectors
    and PIVOTS * pi / RING rows, whatever the number of vectors."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, ring: float = RING, block: int = BLOCK):
        spark = vectors.sparkSession
        v = _directed(vectors, "vec_id", "embedding")
        chosen = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        self.pivots = _unit([r.embedding for r in chosen]) if chosen else None
        p = self.pivots

        def place(batches):
            for pdf in batches:
                if len(pdf):
                    angle = _angles(_unit(pdf["embedding"]), p)
                    pdf["cell"] = angle.argmin(axis=1)
                    pdf["angle"] = angle.min(axis=1)
                    pdf["ring"] = (pdf["angle"] / ring).astype("int64")
                    yield pdf

        schema = StructType(list(v.schema.fields))
        for name, kind in (("cell", "long"), ("angle", "double"), ("ring", "long")):
            schema = schema.add(name, kind)
        placed = shared_table(v.mapInPandas(place, schema) if chosen else spark.createDataFrame([], schema), "vector-cells")
        self.rings = (placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"),
                                                         F.max("angle").alias("hi")).toPandas())
        parts = F.broadcast(spark.createDataFrame(  # bounded as ``rings`` is
            [(int(r.cell), int(r.ring), int(-(-r.n // block))) for r in self.rings.itertuples()],
            "cell long, ring long, parts long"))
        # a crowded ring is many blocks; the hash of the id deals its vectors out
        self.blocks = shared_table(
            placed.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
            .groupBy("cell", "ring", "part").agg(F.collect_list("vec_id").alias("vec_ids"),
                                                 F.collect_list("embedding").alias("embeddings")), "vector-blocks")
        self.id_field = vectors.schema["vec_id"]


def _nearest(asked: DataFrame, cells: VectorCells, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors of each (query, ring) in ``asked`` (query_id, qvec,
    cell, ring): blocks of queries meet blocks of vectors, one product each.
    Products choose the candidates; their distances are summed in order."""
    parts = asked.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    q = (asked.join(parts, ["cell", "ring"]).withColumn("_part", F.pmod(F.xxhash64("query_id"), "_parts"))
         .groupBy("cell", "ring", "_part").agg(F.collect_list("query_id").alias("query_ids"),
                                               F.collect_list("qvec").alias("qvecs")))
    pairs = q.join(cells.blocks, ["cell", "ring"]).select("query_ids", "qvecs", "vec_ids", "embeddings")

    def best(batches):
        import pandas as pd
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                qs, vs = np.stack(row.qvecs).astype(np.float64), np.stack(row.embeddings).astype(np.float64)
                ids = np.asarray(row.vec_ids)
                near = _unit(qs) @ _unit(vs).T
                out = []
                for i, sims in enumerate(near):
                    least = np.partition(sims, -min(k, len(sims)))[-min(k, len(sims))]
                    at = np.flatnonzero(sims >= least - 1e-9)
                    norm = np.sqrt(np.cumsum(qs[i] * qs[i])[-1])
                    d = 1.0 - (np.cumsum(vs[at] * qs[i], axis=1)[:, -1]
                               / (norm * np.sqrt(np.cumsum(vs[at] * vs[at], axis=1)[:, -1])))
                    for j in sorted(range(len(at)), key=lambda j: (d[j], ids[at[j]]))[:k]:
                        out.append((row.query_ids[i], ids[at[j]], d[j]))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "_d"])

    schema = StructType([asked.schema["query_id"], StructField("vec_id", cells.id_field.dataType),
                         StructField("_d", DoubleType())])
    return pairs.mapInPandas(best, schema)


def _rings(queries: DataFrame, cells: VectorCells, k: int, first: bool) -> DataFrame:
    """(query_id, qvec, cell, ring) that may hold one of a query's k nearest.
    ``first``: those of its nearest cell, within a bound from the numbers of
    vectors in the rings; else those outside it, within the column ``bound`` (an
    angle, or NULL)."""
    p, r = cells.pivots, cells.rings.sort_values(["cell", "ring"]).reset_index(drop=True)
    cell, lo, hi, n = (r[c].to_numpy() for c in ("cell", "lo", "hi", "n"))

    def choose(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                to = _angles(_unit([row.qvec]), p)[0]
                mine = to[cell]
                far = mine + hi
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(n[order]), k)
                bound = far[order][enough] if enough < len(far) else np.pi
                if not first and not np.isnan(row.bound):
                    bound = min(bound, row.bound)
                home = cell == to.argmin()
                least = np.maximum(0.0, np.maximum(lo - mine, mine - hi))
                for at in np.flatnonzero((least <= bound + SLACK) & (home if first else ~home)):
                    out.append((row.query_id, row.qvec, int(cell[at]), int(r["ring"][at])))
            yield pd.DataFrame(out, columns=["query_id", "qvec", "cell", "ring"])

    schema = StructType([queries.schema["query_id"], queries.schema["qvec"]]).add("cell", "long").add("ring", "long")
    return queries.where(F.lit(p is not None)).mapInPandas(choose, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame | VectorCells, k: int = 3) -> DataFrame:
    """Exact cosine top-k (no ANN). ``queries``: (query_id, qvec), a stated
    set of any size; ``vectors``: (vec_id, embedding), or their ``VectorCells``
    if several calls read them. distance = 1 - cos, relevance = 1 - distance,
    both rounded to 4; ties broken by vec_id. A query or vector without a
    direction (NULL, a NULL in it, all zeros) has no rows.

    A query first reads its own cell; the k-th best angle there bounds what it
    reads of the others. Every ring that may hold a nearer vector is read."""
    cells = vectors if isinstance(vectors, VectorCells) else VectorCells(vectors)
    q = shared_table(_directed(queries, "query_id", "qvec"), "vector-queries")
    here = shared_table(_nearest(_rings(q, cells, k, True), cells, k), "vector-near")
    w = Window.partitionBy("query_id").orderBy("_d", "vec_id")
    kth = (here.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
           .select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - F.col("_d")))).alias("bound")))
    there = _nearest(_rings(q.join(kth, "query_id", "left"), cells, k, False), cells, k)
    top = here.unionByName(there).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # "+ 0.0" folds a rounded -0.0 (self-match) into 0.0
    return top.select("query_id", "vec_id", "rank", (F.round("_d", 4) + F.lit(0.0)).alias("distance"),
                      (F.round(F.lit(1.0) - F.col("_d"), 4) + F.lit(0.0)).alias("relevance_score"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _grams(n) -> Column:
    """The ``n``-character pieces of the word whose characters are in ``_c``."""
    return F.when(F.size("_c") >= n, F.transform(F.sequence(F.lit(1), F.size("_c") - n + 1),
                                                 lambda i: F.array_join(F.slice("_c", i, n), "")))


def _spelled(df: DataFrame, word: str) -> DataFrame:
    return df.withColumn("_c", F.filter(F.split(word, ""), lambda c: c != ""))


class WordTables:
    """What term lookups read: ``postings`` (word, chunk_id) as passages are
    read, and ``vocabulary`` (word, passages that hold it), written once. Small
    tables are written before a join, so that Spark knows their size."""

    def __init__(self, chunks: DataFrame):
        self.postings = chunks.select("chunk_id", F.explode(F.array_distinct(_words("text"))).alias("word"))
        self.vocabulary = shared_table(self.postings.groupBy("word").agg(F.count(F.lit(1)).alias("passages")), "vocabulary")

    def words(self, terms: DataFrame) -> DataFrame:
        """(term, word, passages) for each word that contains the term, written:
        the term is looked up by its gram that the fewest words hold, and each
        candidate word is checked."""
        every = F.concat(*[F.coalesce(_grams(F.lit(n)), F.array().cast("array<string>")) for n in range(1, GRAM + 1)])
        index = _spelled(self.vocabulary, "word").select("word", "passages", F.explode(F.array_distinct(every)).alias("gram"))
        spelled = _spelled(terms.select("term").distinct(), "term")
        asked = shared_table(spelled.select("term", F.explode(F.array_distinct(_grams(F.least(F.lit(GRAM), F.size("_c")))))
                                            .alias("gram")), "asked-grams")
        n_words = index.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = shared_table(asked.join(n_words, "gram").groupBy("term")
                              .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")), "rarest-grams")
        found = rarest.join(index, "gram").where(F.col("word").contains(F.col("term")))
        return shared_table(found.select("term", "word", "passages"), "term-words")


def _best(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best passages of each query (ties keep corpus order)."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id", "chunk_index")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = 3, at_once: int = 1000) -> DataFrame:
    """Stable score-descending top k per query (ties keep corpus order), as
    passage ids; join the passages for their text. The score is the number of
    query terms (lower-cased, split at white space, repeats counted) that the
    lower-cased passage contains; passages with none are left out.

    A query's terms are taken from the rarest on. The first, and those after it
    while their postings are at most ``at_once``, lead to passages, which are
    scored for all terms. Let the k-th best have score L: a passage that holds
    only terms which weigh less than L together cannot be among the best, so of
    the remaining terms only those before that point lead to more passages."""
    tables = WordTables(chunks)
    q = queries.select("query_id", _words("query").alias("_terms")).where(F.size("_terms") > 0)
    times = (q.select("query_id", F.explode("_terms").alias("term")).groupBy("query_id", "term")
             .agg(F.count(F.lit(1)).alias("times")))
    words = tables.words(times)
    order = Window.partitionBy("query_id").orderBy("found", "term")
    asked = times.join(words.groupBy("term").agg(F.sum("passages").alias("found")), "term")
    asked = shared_table(asked.withColumns({
        "early": (F.row_number().over(order) == 1)
                 | (F.sum("found").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= at_once),
        "left": F.sum("times").over(order.rowsBetween(0, Window.unboundedFollowing))}), "asked-terms")
    passages = chunks.select("chunk_id", "doc_id", "chunk_index", F.lower("text").alias("_low"))

    def best_of(terms):
        lead = shared_table(terms.join(words, "term").select("query_id", "word").distinct(), "lead-words")
        at = shared_table(lead.join(tables.postings, "word").select("query_id", "chunk_id").distinct(), "keyword-candidates")
        at = at.join(passages, "chunk_id").join(q, "query_id")
        score = F.size(F.filter("_terms", lambda t: F.col("_low").contains(t)))
        scored = at.select("query_id", "chunk_id", "doc_id", "chunk_index", F.size("_terms").alias("n_terms"),
                           score.alias("score"))
        return _best(scored, ["query_id"], k).drop("rank")

    top = shared_table(best_of(asked.where("early")), "keyword-best")
    kth = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_l"))
    more = asked.where("not early").join(kth, "query_id", "left").where(F.col("left") >= F.coalesce("_l", F.lit(0)))
    if not more.isEmpty():
        again = best_of(more.drop("_l"))
        top = _best(top.unionByName(again).dropDuplicates(["query_id", "chunk_id"]), ["query_id"], k).drop("rank")
    return _best(top, ["query_id"], k).withColumn("relevance_score", F.col("score") / F.col("n_terms"))


def policy_context(invoice_queries: DataFrame, fixed: dict[int, str], corpus: DataFrame, per_query: int = 2,
                   keep: int = 3) -> DataFrame:
    """Per invoice, its queries' top 2 passages each, deduplicated by text
    keeping the first, first 3 kept, '[source] text' joined by a rule; no hit ->
    a fixed sentence. ``invoice_queries``: (invoice_id, q_no, own); query
    ``q_no`` asks for the words ``fixed[q_no]`` and the invoice's ``own`` words.
    ``corpus``: (chunk_id, doc_id, chunk_index, source, text).

    The fixed words are counted in each passage as it is read; the own words
    are looked up once for each distinct own text. A passage without an own
    word can only be among the best if it is among the best for the fixed words
    alone, so only those are added."""
    at = ["chunk_id", "doc_id", "chunk_index"]
    low = F.lower("text")
    counted = [F.struct(F.lit(n).alias("q_no"), sum((low.contains(w).cast("int") for w in words.lower().split()),
                                                    F.lit(0)).alias("base")) for n, words in fixed.items()]
    passages = shared_table(corpus.select(*at, "source", "text", F.sha2("text", 256).alias("same"),
                                          F.array(*counted).alias("_base")), "policy-passages")
    asked = shared_table(invoice_queries.select("invoice_id", "q_no", "own"), "policy-queries")
    tables = WordTables(passages)
    kinds = shared_table(asked.select("q_no", "own").distinct(), "policy-kinds")
    terms = (kinds.select("q_no", "own", F.explode(_words("own")).alias("term")).groupBy("q_no", "own", "term")
             .agg(F.count(F.lit(1)).alias("times")))
    hits = shared_table(tables.words(terms).join(tables.postings, "word").select("term", "chunk_id").distinct(), "policy-hits")
    based = passages.select(*at, "same", F.inline("_base"))
    own = (terms.join(hits, "term").groupBy("q_no", "own", "chunk_id").agg(F.sum("times").cast("int").alias("_own"))
           .join(based, ["q_no", "chunk_id"])
           .select("q_no", "own", *at, "same", (F.col("_own") + F.col("base")).alias("score")))
    own = shared_table(own, "policy-own")
    # at most per_query rows for each of the fixed queries
    plain = _best(based.where("base > 0").withColumnRenamed("base", "score"), ["q_no"], per_query)
    top = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "same"))).alias
    plain_tops = F.broadcast(plain.groupBy("q_no").agg(top("_plain")))
    # own texts that no passage holds have the passages of the fixed words
    hit = own.select("q_no", "own").distinct()
    found = (own.unionByName(hit.join(F.broadcast(plain.drop("rank")), "q_no")).groupBy("q_no", "own", *at, "same")
             .agg(F.max("score").alias("score")))
    tops = shared_table(_best(found, ["q_no", "own"], per_query).groupBy("q_no", "own").agg(top("_top")), "policy-tops")
    # a query without an own text is none
    of_query = F.coalesce("_top", F.when(F.col("own").isNotNull(), F.col("_plain")))
    lists = (asked.join(tops, ["q_no", "own"], "left").join(plain_tops, "q_no", "left")
             .groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("q_no", of_query.alias("top")))).alias("_l")))
    lists = lists.withColumn("_l", F.flatten(F.transform(F.filter("_l", lambda x: x["top"].isNotNull()),
                                                         lambda x: x["top"])))
    lists = lists.withColumn("_s", F.transform("_l", lambda x: x["same"]))
    first = F.filter("_l", lambda x, i: F.array_position("_s", x["same"]) == i + 1)
    kept = shared_table(lists.select("invoice_id", F.transform(F.slice(first, 1, keep), lambda x: x["chunk_id"])
                                     .alias("ids")), "policy-lists")
    # each distinct list of passages is written out once, and stored before the
    # join: few lists go to every task, and of many a common one can be split
    parts = kept.select("ids").distinct().select("ids", F.posexplode("ids").alias("pos", "chunk_id"))
    text = passages.select("chunk_id", F.format_string("[%s] %s", "source", "text").alias("t"))
    context = shared_table(parts.join(text, "chunk_id").groupBy("ids").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n\n---\n\n").alias("context")),
        "policy-contexts")
    return (kept.join(context, "ids", "left")
            .select("invoice_id", F.coalesce("context", F.lit("No relevant policy context found.")).alias("context")))
