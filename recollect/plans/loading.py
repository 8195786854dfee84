"""Queries of loaders, office formats, JDBC and workflows: each writes what it reads, since the driver's tables have no such files."""
import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from recollect.functions import similarity as Y
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import context as C
from recollect.operators import related as D
from recollect.plans.registry import query
from recollect.session import shared_folder
from recollect.sources import datasets as S
from recollect.sources.tables import MEMORIES, memories, spread, table


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN '_abs' ELSE '' END AS question_id, CASE WHEN r_regionkey % 2 = 0 THEN 'Abstention' ELSE 'single' END AS qtype, 's' || n_nationkey AS session_id, n_name AS content, t::INT AS turn, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END AS role
FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES (0), (1)) v(t)""")
def question_sessions(spark, sf_dir):
    """Regions as questions, their nations as sessions of two turns."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("k"), "n_name")
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.col("n_name").alias("content"), F.lit(False).alias("has_answer"))
    s = n.withColumn("t", F.array(turn("user"), turn("assistant"))).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("s"))
    key = F.col("n_regionkey")
    q = s.select(
        F.concat(key.cast("string"), F.when(key % 2 == 0, "_abs").otherwise("")).alias("question_id"), F.lit("single").alias("question_type"), F.lit("?").alias("question"), F.lit("!").alias("answer"), F.lit("today").alias("question_date"),
        F.transform("s", lambda x: F.lit("2024")).alias("haystack_dates"), F.transform("s", lambda x: F.concat(F.lit("s"), x["k"])).alias("haystack_session_ids"), F.col("s.t").alias("haystack_sessions"), F.array(F.lit("s")).alias("answer_session_ids"),
    )
    path = _place(spark, "questions")
    q.agg(F.to_json(F.collect_list(F.struct(*q.columns))).alias("value")).coalesce(1).write.text(path)  # one document, as the format has it
    return S.load_question_sessions(spark, path).select("question_id", "qtype", "session_id", "content", "turn", "role")


@query("SELECT 'r' || r_regionkey AS sample_id, (n_nationkey + 1)::INT AS session, 0 AS turn, '{\"name\":\"' || n_name || '\"}' AS json FROM region JOIN nation ON n_regionkey = r_regionkey")
def numbered_sessions(spark, sf_dir):
    """Regions as samples, their nations as numbered sessions."""
    n = table(spark, sf_dir, "nation")
    entry = F.struct(F.concat(F.lit("session_"), (F.col("n_nationkey") + 1).cast("string")).alias("k"), F.to_json(F.array(F.struct(F.col("n_name").alias("name")))).alias("v"))
    c = n.groupBy("n_regionkey").agg(F.collect_list(entry).alias("e"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["v"])), ","), F.lit("}"))
    row = F.concat(F.lit('{"sample_id":"r'), F.col("n_regionkey").cast("string"), F.lit('","conversation":'), body, F.lit("}"))
    path = _place(spark, "samples")
    c.agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return S.load_numbered_sessions(spark, path).select("sample_id", "session", F.col("turn").cast("int").alias("turn"), F.trim("json").alias("json"))


@query("SELECT p_partkey, p_name || chr(10) || p_brand AS text FROM part")
def docx_texts(spark, sf_dir):
    """Two paragraphs of each part, as an office document and back."""

    @F.pandas_udf("binary")
    def docx(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document><w:p><w:r><w:t>{x[:3]}</w:t><w:t xml:space='preserve'>{x[3:]}</w:t></w:r></w:p><w:p a='1'><w:t>{y}</w:t></w:p></w:document>")
            return out.getvalue()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return table(spark, sf_dir, "part").select("p_partkey", S.docx_text(docx("p_name", "p_brand")).alias("text"))


@query("SELECT p_partkey, p_name AS text, ['# ' || p_name, '### ' || p_brand] AS headings FROM part")
def marked_up_texts(spark, sf_dir):
    """The plain text of rich text, and the headings of a marked-down one."""
    p = table(spark, sf_dir, "part")
    rich = F.concat(F.lit("{\\rtf1\\ansi \\b "), "p_name", F.lit("\\b0 }"))
    down = F.concat(F.lit("# "), "p_name", F.lit("\ntext # no heading\n### "), "p_brand", F.lit("\n#no"))
    return p.select("p_partkey", F.trim(T.extract_rtf_text(rich)).alias("text"), T.headings(down).alias("headings"))


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_acctbal > 0")
def jdbc_round_trip(spark, sf_dir):
    """Suppliers through a database by JDBC, read in ranges of their key. The database is embedded, so this runs where driver and executors are one process."""
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    S.write_jdbc(s, url, "supplier", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = S.read_jdbc(spark, url, "supplier", "k", 1, 1000, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return back.filter("balance > 0").select("k", "name", "balance")


@query("WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT n_name AS name, round(mean, 6) AS mean FROM a JOIN nation ON n_nationkey = k")
def workflow(spark, sf_dir):
    """Steps in the order of what they need."""
    steps = {
        "named": (lambda a, n: a.join(n, a["k"] == n["n_nationkey"]).select(F.col("n_name").alias("name"), F.round("mean", 6).alias("mean")), ["means", "nation"]),
        "means": (lambda c: c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("mean")), ["solvent"]),
        "solvent": (lambda c: c.filter("c_acctbal > 0"), ["customer"]),
    }
    return C.run_workflow(steps, {t: table(spark, sf_dir, t) for t in ("customer", "nation")})["named"]


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM e), o AS (SELECT e AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM e))
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(list_distance(e, q), 6) AS euclidean, round(-list_dot_product(e, q), 6) AS dot, round(1 - list_cosine_similarity(e, q), 6) AS cosine FROM n, o""")
def normalized_vectors(spark, sf_dir):
    """The sum of each vector scaled to length 1, and its distances by name to the first."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    first = F.broadcast(v.agg(F.min_by("e", "vec_id").alias("q")))  # one row
    d = lambda n: F.round(V.distance(n, F.col("e"), F.col("q")), 6).alias(n)
    return v.join(first).select("vec_id", F.round(F.aggregate(V.normalize(F.col("e")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), d("euclidean"), d("dot"), d("cosine"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: strlen(w) > 2))"


@query(f"""WITH {MEMORIES}, ws AS MATERIALIZED (SELECT key, list_sort({_SET.format("value")}) AS w FROM mem), cl AS (SELECT w, min(key) AS id FROM ws GROUP BY 1), k AS MATERIALIZED (SELECT key, id, ws.w FROM ws JOIN cl USING (w)), u AS (SELECT id, unnest(w) AS t FROM k WHERE key = id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM u x JOIN u y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2), p AS (SELECT a, b, n / (len(x.w) + len(y.w) - n)::DOUBLE AS s FROM c JOIN k x ON x.key = a JOIN k y ON y.key = b),
q AS (SELECT a, b, s FROM p WHERE s >= 0.5 UNION ALL SELECT id, key, 1 FROM k WHERE key <> id), l AS (SELECT a AS key, b AS target, 'similar_to' AS relationship, s AS confidence FROM q UNION ALL SELECT b, a, 'similar_to', s FROM q
 UNION ALL SELECT x.key, y.key, 'temporal_proximity', 1 - abs(date_diff('minute', x.created_at, y.created_at)) / 600::DOUBLE FROM mem x JOIN mem y ON x.key <> y.key AND abs(date_diff('minute', x.created_at, y.created_at)) <= 600)
SELECT key, target, relationship, round(confidence, 9) AS confidence, row_number() OVER (PARTITION BY key ORDER BY round(confidence, 9) DESC, target, relationship) AS rank FROM l WHERE confidence >= 0.5 QUALIFY rank <= 10""")
def cross_links(spark, sf_dir):
    """What two strategies link, by likeness of words and by time, confident enough; ten of each memory."""
    m = spread(memories(spark, sf_dir))
    found = D.best_links([D.text_links(m, 0.5), D.time_links(m, 600, 0.5, 10)], 0.5, 10)
    return found.select("key", "target", "relationship", F.round("confidence", 9).alias("confidence"), "rank")


@query("SELECT p_partkey::VARCHAR AS key, true AS found FROM part WHERE p_partkey IN (1, 7, 9) UNION ALL SELECT 'none', false")
def single_lookups(spark, sf_dir):
    """Rows by key, one at a time, and one that is not there."""
    from recollect.sources.store import MemoryTable

    t = MemoryTable(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_name"))
    out = None
    for k in ("1", "7", "9", "none"):
        r = t.get(k).agg((F.count(F.lit(1)) > 0).alias("found")).select(F.lit(k).alias("key"), "found")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {MEMORIES} SELECT key, memory_type, created_at, last_accessed, access_count, round(importance, 9) AS importance, round(confidence, 9) AS confidence, strlen(value) AS bytes FROM mem")
def all_entries(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select("key", "memory_type", "created_at", "last_accessed", "access_count", F.round("importance", 9).alias("importance"), F.round("confidence", 9).alias("confidence"), F.octet_length("value").cast("long").alias("bytes"))


@query(f"WITH {MEMORIES} SELECT key FROM mem WHERE list_has_all(tags, ['en', 'src3'])")
def keys_with_all_tags(spark, sf_dir):
    two = F.array(F.lit("en"), F.lit("src3"))
    return memories(spark, sf_dir).filter(F.size(F.array_intersect("tags", two)) == 2).select("key")


@query()
def word_semantics(spark, sf_dir):
    """How alike the words of each part's name and type are, by several string measures at once."""
    p = table(spark, sf_dir, "part")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([Y.word_semantic(x, y) for x, y in zip(a, b, strict=True)])

    return p.select("p_partkey", F.round(alike(F.lower("p_name"), F.lower("p_type")), 9).alias("similarity"))
