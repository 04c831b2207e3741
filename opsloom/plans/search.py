"""Registered queries: vectors, text weights, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import search as R, tfidf as TT, vector_index as VI, vectors as V
from opsloom.operators.embed import with_semantic_text
from opsloom.operators.text import STOP_WORDS
from opsloom.plans.base import over_repaired, repaired, sql_list
from opsloom.plans.features import SEMANTIC_SQL, docs
from opsloom.session import work_path
from opsloom.sources.tables import table, ticket_number

Q, S = {}, {}

K = 10


def emb(spark, sf):
    return table(spark, sf, "embeddings")


def knn_sql(k: int, exclude_self: bool = False, score: str = "list_inner_product(q.embedding::double[], c.embedding::double[])", order: str = "DESC") -> str:
    where = "WHERE q.vec_id <> c.vec_id" if exclude_self else ""
    return f"""SELECT query_id, match_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, match_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS match_id, round({score}, 6) AS score FROM embeddings q, embeddings c {where})) WHERE rank <= {k}"""


L2 = "list_sum(list_transform(list_zip(q.embedding::double[], c.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

Q["knn_exact"] = lambda spark, sf: V.knn(emb(spark, sf), emb(spark, sf), K)
S["knn_exact"] = knn_sql(K)
Q["knn_l2"] = lambda spark, sf: V.knn(emb(spark, sf), emb(spark, sf), K, metric="l2")
S["knn_l2"] = knn_sql(K, score=L2, order="ASC")



def asked(df):
    """The queries of the cell search: every row whose id is divisible by 50, against all rows."""
    return df.filter(F.col("vec_id") % 50 == 0)


Q["knn_ivf"] = lambda spark, sf: V.knn_cells(asked(emb(spark, sf)), emb(spark, sf), K)

Q["l2_normalize"] = lambda spark, sf: V.l2_normalize(emb(spark, sf)).select(
    "vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))
S["l2_normalize"] = """
SELECT vec_id, i - 1 AS i, round(embedding[i]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) AS x
FROM embeddings, range(1, 65) r(i)"""


def _append(spark, sf):
    e = emb(spark, sf)
    old, new = e.filter("label < 5"), e.filter("label >= 5")
    return V.append_vectors(old, new).select("vec_id", "label", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


Q["index_append"] = _append
S["index_append"] = "SELECT vec_id, label, len(embedding)::int AS dim, round(embedding[1]::double, 6) AS first FROM embeddings"


def meta(spark, sf):
    return repaired(spark, sf, text=True).withColumnRenamed("ticket_key", "vec_id").select(
        "vec_id", "number", "assignment_group", "priority", "business_service", "short_description", "resolution_time_hours",
        "reassignment_count", "cmdb_ci")


def matches(spark, sf, k=5, exclude_self=True):
    """Raw matches with the ticket fields the fusion needs."""
    m = V.knn(emb(spark, sf), emb(spark, sf), k, exclude_self=exclude_self)
    return m.join(meta(spark, sf).withColumnRenamed("vec_id", "match_id"), "match_id", "left").withColumnRenamed("score", "similarity_score")


MATCH_CTE = f", m AS ({knn_sql(5, True)}), mt AS (SELECT m.query_id, m.rank, m.score AS similarity_score, rep.* FROM m LEFT JOIN rep ON rep.ticket_key = m.match_id)"


def _by_number(spark, sf):
    """Every stored ticket vector is a query under its own number and finds itself first."""
    e = emb(spark, sf)
    found = V.format_matches(V.knn(e, e, 5), meta(spark, sf))
    who = meta(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("number").alias("query_number"))
    return found.join(who, "query_id").select(
        "query_number", "rank", "number", "similarity_score", "assignment_group", "priority", "business_service",
        F.md5("short_description").alias("title_digest"), "resolution_time")


Q["similar_by_number"] = _by_number
S["similar_by_number"] = over_repaired(f"""
, m AS ({knn_sql(5)})
SELECT q.number AS query_number, m.rank, t.number, m.score AS similarity_score, t.assignment_group, cast(t.priority AS varchar) AS priority,
  t.business_service, md5(coalesce(t.short_description, 'No short description')) AS title_digest, round(t.resolution_time_hours, 2) AS resolution_time
FROM m JOIN rep q ON q.ticket_key = m.query_id JOIN rep t ON t.ticket_key = m.match_id""")


def _consensus(spark, sf):
    e = emb(spark, sf)
    return V.retrieval_consensus(V.format_matches(V.knn(e, e, 5, exclude_self=True), meta(spark, sf)))


Q["retrieval_consensus"] = _consensus
S["retrieval_consensus"] = over_repaired(MATCH_CTE + """
, g AS (SELECT query_id, assignment_group, count(*) AS c FROM mt GROUP BY 1, 2),
b AS (SELECT query_id, assignment_group FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, assignment_group) AS rn FROM g) WHERE rn = 1)
SELECT query_id, round(avg(similarity_score), 6) AS mean_similarity, any_value(b.assignment_group) AS top_group,
  round(avg(round(resolution_time_hours, 2)), 4) AS mean_hours FROM mt JOIN b USING (query_id) GROUP BY 1""")


def _boosted(spark, sf):
    item = repaired(spark, sf).select(F.col("ticket_key").alias("vec_id"), "cmdb_ci")
    e = emb(spark, sf).join(item, "vec_id", "left")
    found = V.knn(e, e, K, exclude_self=True).unionByName(V.knn_within(e, e, "cmdb_ci", K, exclude_self=True)).drop("rank").distinct()
    name = lambda side: item.select(F.col("vec_id").alias(f"{side}_id"), F.col("cmdb_ci").alias(f"{side}_ci"))
    j = found.join(name("query"), "query_id", "left").join(name("match"), "match_id", "left")
    return V.boost_same_item(j, k=K).select("query_id", "match_id", "boosted_score", "rank")


Q["knn_boosted"] = _boosted
S["knn_boosted"] = over_repaired(f"""
, e AS (SELECT vec_id, embedding, cmdb_ci FROM embeddings LEFT JOIN rep ON ticket_key = vec_id),
b AS (SELECT q.vec_id AS query_id, t.vec_id AS match_id,
   round(round(list_inner_product(q.embedding::double[], t.embedding::double[]), 6) + CASE WHEN q.cmdb_ci = t.cmdb_ci THEN 0.15::double ELSE 0 END, 6) AS boosted_score
  FROM e q, e t WHERE q.vec_id <> t.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, match_id) AS rank FROM b WHERE boosted_score >= 0.5)
SELECT * FROM r WHERE rank <= {K}""")

Q["knn_ivf_all_cells"] = lambda spark, sf: V.knn_cells(emb(spark, sf), emb(spark, sf), K, probes=2**31)
S["knn_ivf_all_cells"] = knn_sql(K)


def _recall(spark, sf):
    """Share of the exact matches that the cell search finds."""
    e = emb(spark, sf)
    key = ["query_id", "match_id"]
    exact, found = V.knn(asked(e), e, K).select(*key), V.knn_cells(asked(e), e, K).select(*key, F.lit(1).alias("hit"))
    return exact.join(found, key, "left").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


Q["knn_ivf_recall"] = _recall



def code_index(spark, sf):
    """Two thirds of the vectors are indexed, the rest appended without fitting again."""
    e = emb(spark, sf)
    late = F.pmod(F.xxhash64("vec_id"), F.lit(3)) == 0
    return VI.build_code_index(e.filter(~late), work_path(spark, "code-index"), K).append(e.filter(late))


Q["knn_codes"] = lambda spark, sf: code_index(spark, sf).search(emb(spark, sf), K)


def _code_checks(spark, sf):
    """Recall of every vector's search against the exact one, and the share of the vectors that were scored."""
    e = emb(spark, sf)
    index = code_index(spark, sf)
    key = ["query_id", "match_id"]
    exact, found = V.knn(e, e, K).select(*key), index.search(e, K).select(*key, F.lit(1).alias("hit"))
    rows = exact.join(found, key, "left").agg(F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    n = index.vectors.count()
    struct = lambda c, ok, v: F.struct(F.lit(c).alias("check_name"), ok.alias("passed"), v.cast("bigint").alias("n"))
    return rows.select(F.inline(F.array(
        struct("recall_at_least_0_9", F.col("recall") >= 0.9, F.col("pairs")), struct("scored_under_a_third", F.lit(3 * K * index.candidates_per_match < n), F.lit(n)))))


Q["knn_codes_checks"] = _code_checks
S["knn_codes_checks"] = f"""
WITH n AS (SELECT count(*) AS c FROM embeddings WHERE embedding IS NOT NULL)
SELECT 'recall_at_least_0_9' AS check_name, true AS passed, (c * least(c, {K}))::bigint AS n FROM n
UNION ALL SELECT 'scored_under_a_third', true, c::bigint FROM n"""

Q["tfidf_topterms"] = lambda spark, sf: TT.top_terms(TT.tfidf(docs(spark, sf), "doc_id", "description"))
S["tfidf_topterms"] = f"""
WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
c AS (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({sql_list(STOP_WORDS)}) GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {TT.MAX_FEATURES}),
w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::double) + 1) AS w FROM c JOIN v USING (term)),
u AS (SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w)
SELECT * FROM (SELECT id, term, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM u) WHERE rank <= 5"""


def _resolve(spark, sf):
    """Ticket numbers of all stored vectors, all conversation turns, and every ticket as a JSON record, asked as queries."""
    numbers = emb(spark, sf).select(F.concat(F.lit("n"), "vec_id").alias("query_id"), F.concat(F.lit(" "), ticket_number("vec_id")).alias("query"))
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    tickets = repaired(spark, sf, text=True)
    records = tickets.select(F.concat(F.lit("r"), "ticket_key").alias("query_id"), F.to_json(F.struct(*R.RECORD_FIELDS, F.col("number").alias("ticket_number"))).alias("query"))
    store = with_semantic_text(tickets)
    return R.resolve_queries(numbers.unionByName(turns).unionByName(records), store).select("query_id", "kind", F.md5("semantic_text").alias("digest"))


Q["resolve_queries"] = _resolve
S["resolve_queries"] = over_repaired(SEMANTIC_SQL + r"""
, a AS (SELECT concat('n', cast(vec_id AS varchar)) AS query_id, concat('INC', lpad(cast(vec_id AS varchar), 12, '0')) AS query FROM embeddings
  UNION ALL SELECT concat(cast(conv_id AS varchar), '-', cast(turn AS varchar)), regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') FROM conversations)
SELECT query_id, CASE WHEN s.number IS NULL THEN 'text' ELSE 'number' END AS kind, md5(coalesce(semantic_text, query)) AS digest
FROM a LEFT JOIN sem s ON s.number = a.query
UNION ALL SELECT concat('r', cast(ticket_key AS varchar)), 'record',
  md5(CASE WHEN cmdb_ci IS NULL THEN replace(semantic_text, ' | CI: General CI] [Priority', ' | CI: ci-query-node] [Priority') ELSE semantic_text END) FROM sem""")


def _store(spark, sf):
    path = R.save_vectors(emb(spark, sf), work_path(spark, "vectors"))
    return R.load_vectors(spark, path).select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", "label", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


Q["embedding_store"] = _store
S["embedding_store"] = "SELECT vec_id, label, i - 1 AS i, round(embedding[i]::double, 6) AS x FROM embeddings, range(1, 65) r(i)"


NOTE_MATCHES = 20


def _notes(spark, sf):
    """The last turn after the opening one is the ticket's close note, its order status the resolution code."""
    last = table(spark, sf, "conversations").filter(F.col("turn") > 0).groupBy("conv_id").agg(F.max_by("text", "turn").alias("close_note"))
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("resolution_code"))
    notes = last.withColumnRenamed("conv_id", "match_id").join(status, "match_id", "left")
    e = emb(spark, sf)
    return R.close_notes(V.knn(e, e, NOTE_MATCHES, exclude_self=True), notes).withColumn("close_note", F.md5("close_note"))


Q["similar_close_notes"] = _notes
S["similar_close_notes"] = rf"""
WITH m AS ({knn_sql(NOTE_MATCHES, True)}),
l AS (SELECT conv_id, regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS note, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE turn > 0),
g AS (SELECT query_id, note, o_orderstatus AS code, max(score) AS best, count(*) AS n FROM m JOIN l ON l.conv_id = m.match_id AND l.rn = 1 AND l.note <> ''
  LEFT JOIN orders ON o_orderkey = m.match_id GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, n DESC, note, code NULLS LAST) AS rank FROM g)
SELECT query_id, rank, md5(note) AS close_note, code AS resolution_code, best AS best_score, n AS n_tickets FROM r WHERE rank <= 3"""
