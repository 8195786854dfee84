"""Queries of stores, filters, versions, duplicates, lifecycle and the SQL surface."""
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import graph as G
from recollect.operators import management as M
from recollect.plans.registry import query
from recollect.session import shared_folder
from recollect.sources import store as S
from recollect.sources.tables import EDGES, MEMORIES, edges, hours_since, hours_sql, memories, table, vectors

_SMALL = ("key", "memory_type", "access_count", "importance")


def _table(spark, sf_dir):
    return S.MemoryTable(memories(spark, sf_dir).select(*_SMALL))


@query(f"""WITH {MEMORIES}, n AS (SELECT key, 'LongTerm' AS memory_type, access_count + 100 AS access_count, importance FROM mem WHERE access_count >= 10 UNION ALL SELECT 'new-' || key, memory_type, access_count, importance FROM mem WHERE access_count = 3)
SELECT key, memory_type, access_count, importance FROM mem WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n""")
def store_upsert(spark, sf_dir):
    t = _table(spark, sf_dir)
    changed = t.rows.filter("access_count >= 10").withColumn("memory_type", F.lit("LongTerm")).withColumn("access_count", F.col("access_count") + 100)
    fresh = t.rows.filter("access_count = 3").withColumn("key", F.concat(F.lit("new-"), "key"))
    return t.store(changed.unionByName(fresh)).rows


@query(f"WITH {MEMORIES} SELECT key, memory_type, access_count, CASE WHEN access_count = 5 THEN 1.0 ELSE importance END AS importance FROM mem")
def store_update(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.update(t.rows.filter("access_count = 5").withColumn("importance", F.lit(1.0))).rows


@query(f"WITH {MEMORIES} SELECT key, memory_type, access_count, importance FROM mem WHERE access_count % 2 = 1")
def store_delete_batch(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.delete(t.rows.filter("access_count % 2 = 0")).rows


@query(f"WITH {MEMORIES}, k(ordinal, key) AS (VALUES (0, '7'), (1, 'missing'), (2, '3'), (3, '7')) SELECT ordinal, k.key, memory_type, access_count, importance FROM k LEFT JOIN mem USING (key)")
def retrieve_batch(spark, sf_dir):
    return _table(spark, sf_dir).get_batch(["7", "missing", "3", "7"])


@query(f"""WITH {MEMORIES}, op AS (SELECT 1 AS ordinal, 'store' AS op, key, memory_type, access_count + 1 AS access_count, importance FROM mem WHERE access_count < 4 UNION ALL SELECT 2, 'delete', key, memory_type, access_count, importance FROM mem WHERE access_count < 2
 UNION ALL SELECT 3, 'update', key, memory_type, 0, importance FROM mem WHERE access_count = 1), l AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1)
SELECT key, memory_type, access_count, importance FROM mem WHERE key NOT IN (SELECT key FROM l) UNION ALL SELECT key, memory_type, access_count, importance FROM l WHERE op <> 'delete'""")
def store_transaction(spark, sf_dir):
    t = _table(spark, sf_dir)
    op = lambda n, name, rows: rows.withColumn("ordinal", F.lit(n)).withColumn("op", F.lit(name))
    ops = op(1, "store", t.rows.filter("access_count < 4").withColumn("access_count", F.col("access_count") + 1))
    ops = ops.unionByName(op(2, "delete", t.rows.filter("access_count < 2"))).unionByName(op(3, "update", t.rows.filter("access_count = 1").withColumn("access_count", F.lit(0).cast("long"))))
    return t.apply(ops).rows


@query(f"WITH {MEMORIES} SELECT key, memory_type, access_count, importance FROM mem")
def backup_restore(spark, sf_dir):
    t, path = _table(spark, sf_dir), f"{shared_folder(spark)}/backup-{abs(hash(sf_dir))}"
    t.backup(path)
    return S.MemoryTable.restore(spark, path, t.rows.schema).rows


for _fmt in ("csv", "json", "parquet"):

    def _round_trip(spark, sf_dir, fmt=_fmt):
        t, path = _table(spark, sf_dir), f"{shared_folder(spark)}/export-{abs(hash(sf_dir))}.{fmt}"
        S.write(t.rows, path, fmt)
        return S.read(spark, path, fmt, t.rows.schema)

    _round_trip.__name__ = f"export_import_{_fmt}"
    query(f"WITH {MEMORIES} SELECT key, memory_type, access_count, importance FROM mem")(_round_trip)


@query(f"""WITH {MEMORIES} SELECT key, memory_type, access_count, CASE WHEN access_count % 3 = 0 THEN importance / 2 ELSE importance END AS importance, list_sort(CASE WHEN access_count % 3 = 0 THEN list_distinct(list_append(tags, 'imported')) ELSE tags END) AS tags FROM mem""")
def import_merge(spark, sf_dir):
    m = memories(spark, sf_dir).select(*_SMALL, "tags", "last_modified")
    other = m.filter("access_count % 3 = 0").withColumn("importance", F.col("importance") / 2).withColumn("tags", F.array(F.lit("imported"))).withColumn("last_modified", F.expr("last_modified + interval '1' day"))
    return S.MemoryTable(m).merge(other, "merge").rows.select(*_SMALL, F.array_sort("tags").alias("tags"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, CASE WHEN count(*) >= 0 THEN 'parquet' END AS format FROM {t}" for t in _TABLES) + " UNION ALL SELECT 'nation_json', 'json' UNION ALL SELECT 'nation_csv', 'csv' UNION ALL SELECT 'nation_tsv', 'tsv'")
def detect_data_format(spark, sf_dir):
    """The format of every table's first file, and of a table written as JSON, CSV and with tabs, by their first bytes."""
    n, path = table(spark, sf_dir, "nation").coalesce(1), f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    n.write.json(f"{path}/nation_json")
    n.write.csv(f"{path}/nation_csv")
    n.write.option("sep", "\t").csv(f"{path}/nation_tsv")
    places = {**{t: f"{sf_dir}/{t}.parquet" for t in _TABLES}, **{t: f"{path}/{t}" for t in ("nation_json", "nation_csv", "nation_tsv")}}
    heads = spark.createDataFrame([(name, bytearray(S.first_bytes(spark, place))) for name, place in places.items()], "name string, content binary")
    return heads.select("name", S.format_of(F.col("content")).alias("format"))


@query(f"""WITH {MEMORIES} SELECT key FROM mem WHERE memory_type = 'ShortTerm' AND list_has_any(tags, ['en', 'src3']) AND importance BETWEEN 0.2 AND 0.9 AND confidence BETWEEN 0.1 AND 1 AND created_at BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-11-01'
 AND access_count >= 2 AND strlen(value) BETWEEN 50 AND 100000 AND bucket = '3'""")
def typed_filters(spark, sf_dir):
    m = memories(spark, sf_dir)
    f = (F.col("memory_type") == "ShortTerm") & F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("src3"))) & F.col("importance").between(0.2, 0.9) & F.col("confidence").between(0.1, 1.0)
    f &= F.expr("created_at between timestamp_ntz'2024-02-01' and timestamp_ntz'2024-11-01'") & (F.col("access_count") >= 2) & F.octet_length("value").between(50, 100_000) & (F.col("custom_fields")["bucket"] == "3")
    return m.filter(f).select("key")


@query(f"""WITH {MEMORIES} SELECT key, list_contains(tags, 'en') AS has_tag, list_has_any(tags, ['fr', 'src1']) AS any_tag, list_has_all(tags, ['fr', 'src1']) AS all_tags, {hours_sql("created_at")} > 24 AS expired,
 (strlen(key) + strlen(value) + strlen(lang) + strlen(source) + strlen('lang') + strlen(lang) + strlen('bucket') + strlen(bucket) + 200)::BIGINT AS estimated_size FROM mem""")
def row_predicates(spark, sf_dir):
    m = memories(spark, sf_dir)
    length = F.aggregate(F.concat("tags", F.map_keys("custom_fields"), F.map_values("custom_fields")), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    two = F.array(F.lit("fr"), F.lit("src1"))
    return m.select(
        "key", F.array_contains("tags", "en").alias("has_tag"), F.arrays_overlap("tags", two).alias("any_tag"), (F.size(F.array_intersect("tags", two)) == 2).alias("all_tags"),
        (hours_since("created_at") > 24).alias("expired"), (F.octet_length("key") + F.octet_length("value") + length + 200).cast("long").alias("estimated_size"),
    )


@query(f"""WITH {MEMORIES} SELECT key, list_sort(list_distinct(list_append(tags, 'x'))) AS added, list_sort(list_filter(tags, lambda t: t <> 'en')) AS removed, bucket AS field, '{{"lang":"' || lang || '","bucket":"9"}}' AS json FROM mem""")
def tag_and_field_edits(spark, sf_dir):
    m = memories(spark, sf_dir)
    put = F.map_concat(F.map_filter("custom_fields", lambda k, v: k != "bucket"), F.create_map(F.lit("bucket"), F.lit("9")))
    return m.select("key", F.array_sort(F.array_union("tags", F.array(F.lit("x")))).alias("added"), F.array_sort(F.array_remove("tags", "en")).alias("removed"), F.try_element_at("custom_fields", F.lit("bucket")).alias("field"), F.to_json(put).alias("json"))


for _name, _order, _by in (("most_accessed", "access_count DESC", "access_count"), ("recently_accessed", "last_accessed DESC", "last_accessed"), ("most_important", "importance DESC", "importance")):

    def _top(spark, sf_dir, by=_by):
        return memories(spark, sf_dir).orderBy(F.desc(by), F.asc("key")).limit(25).select("key", "access_count", "importance")

    _top.__name__ = f"top_{_name}"
    query(f"WITH {MEMORIES} SELECT key, access_count, importance FROM mem ORDER BY {_order}, key LIMIT 25")(_top)


@query(f"WITH {MEMORIES} SELECT key, importance FROM mem ORDER BY importance DESC, key LIMIT 10 OFFSET 20")
def paged_search(spark, sf_dir):
    return memories(spark, sf_dir).select("key", "importance").orderBy(F.desc("importance"), "key").offset(20).limit(10)


_VERS = """ch AS (SELECT user_id::VARCHAR AS key, ts::TIMESTAMP AS ts, event_id, CASE event_type WHEN 'view' THEN 'Accessed' WHEN 'click' THEN 'ContentModified' WHEN 'purchase' THEN 'ImportanceChanged' ELSE 'TagsModified' END AS change_type, props AS content FROM events)"""


def _changes(spark, sf_dir):
    k = F.when(F.col("event_type") == "view", "Accessed").when(F.col("event_type") == "click", "ContentModified").when(F.col("event_type") == "purchase", "ImportanceChanged").otherwise("TagsModified")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", k.alias("change_type"), F.col("props").alias("content"))


@query(f"WITH {_VERS} SELECT key, event_id, row_number() OVER w AS version_number, lag(content) OVER w AS previous, strlen(content) AS size_bytes, sha256(content) AS checksum FROM ch WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)")
def version_history(spark, sf_dir):
    v = M.number_versions(_changes(spark, sf_dir), "key", "ts", "event_id")
    return v.select("key", "event_id", "version_number", "previous", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))


@query(f"""WITH RECURSIVE {_VERS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, change_type) AS i FROM ch), r AS (SELECT key, ts, change_type, i, ts AS last, true AS keep FROM o WHERE i = 1
 UNION ALL SELECT o.key, o.ts, o.change_type, o.i, CASE WHEN o.change_type <> 'Accessed' OR o.ts - r.last >= INTERVAL 60 MINUTE THEN o.ts ELSE r.last END, o.change_type <> 'Accessed' OR o.ts - r.last >= INTERVAL 60 MINUTE FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1),
k AS (SELECT key, change_type, row_number() OVER (PARTITION BY key ORDER BY ts DESC, change_type DESC) AS n FROM r WHERE keep) SELECT key, change_type, count(*) AS n FROM k WHERE n <= 100 GROUP BY 1, 2""")
def version_throttle(spark, sf_dir):
    return M.throttle_versions(_changes(spark, sf_dir), 60.0).groupBy("key", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_VERS}, c AS (SELECT key, change_type, count(*) AS n FROM ch GROUP BY 1, 2), m AS (SELECT key, change_type AS modal_change FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, change_type) = 1),
s AS (SELECT key, count(*) AS versions, count(*) / nullif(date_diff('second', min(ts), max(ts)), 0) * 86400e0 AS r FROM ch GROUP BY 1) SELECT key, versions, round(coalesce(r, 0), 3) AS changes_per_day, modal_change, round(1 / (1 + coalesce(r, 0)), 4) AS stability FROM s JOIN m USING (key)""")
def temporal_summary(spark, sf_dir):
    s = M.version_summary(_changes(spark, sf_dir))
    return s.withColumn("changes_per_day", F.round("changes_per_day", 3)).withColumn("stability", F.round("stability", 4))


@query(f"WITH {_VERS} SELECT key, count(*) AS versions FROM ch GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_active_memories(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("versions")).orderBy(F.desc("versions"), "key").limit(10)


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS n, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS o FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(o, '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(n, '\\s+'), lambda w: w <> '')) AS b FROM t),
k AS (SELECT conv_id, turn, strlen(n) - strlen(o) AS d, CASE WHEN o = n THEN 'none' WHEN o = '' AND n <> '' THEN 'append' WHEN starts_with(n, o) THEN 'append' WHEN ends_with(n, o) THEN 'prepend' WHEN contains(n, o) THEN 'insert' WHEN starts_with(o, n) OR contains(o, n) THEN 'truncate'
 WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE > 0.3 THEN 'modify' ELSE 'replace' END AS change FROM w)
SELECT conv_id, turn, change, round(least(1, CASE change WHEN 'replace' THEN 1.0 WHEN 'modify' THEN 0.7 WHEN 'truncate' THEN 0.6 WHEN 'append' THEN 0.5 WHEN 'prepend' THEN 0.5 WHEN 'insert' THEN 0.4 ELSE 0 END::DOUBLE + 0.3e0 * abs(d) / (abs(d) + 100e0)), 9) AS significance FROM k""")
def content_differences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("n"))
    c = c.withColumn("o", F.coalesce(F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    c = c.withColumn("change", T.change_type(F.col("o"), F.col("n")))
    return c.select("conv_id", "turn", "change", F.round(M.significance(F.col("change"), F.octet_length("n") - F.octet_length("o"), F.lit(False)), 9).alias("significance"))


@query(f"WITH {MEMORIES}, p AS (SELECT key, tags, lag(tags) OVER (PARTITION BY lang ORDER BY key::BIGINT) AS old FROM mem) SELECT key, list_sort(list_filter(tags, lambda t: NOT list_contains(old, t))) AS added, list_sort(list_filter(old, lambda t: NOT list_contains(tags, t))) AS removed, list_sort(list_intersect(tags, old)) AS unchanged FROM p WHERE old IS NOT NULL")
def metadata_differences(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("old", F.lag("tags").over(Window.partitionBy(F.get("tags", F.lit(0))).orderBy(F.col("key").cast("long")))).filter("old IS NOT NULL")
    d = m.select("key", M.tag_diff(F.col("old"), F.col("tags")).alias("d"))
    return d.select("key", "d.added", "d.removed", "d.unchanged")


@query(f"WITH {MEMORIES} SELECT min(key) AS key FROM mem GROUP BY value")
def dedup_exact(spark, sf_dir):
    return M.first_of(memories(spark, sf_dir), F.col("value"), F.asc("key")).select("key")


_CK = "array_to_string([(floor(strlen(value) / 50) * 50)::BIGINT::VARCHAR, len(w)::VARCHAR, array_to_string(w[1:3], '_')], '_')"


@query(f"""WITH {MEMORIES}, a AS (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY value ORDER BY key) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) ORDER BY key) = 1),
c AS (SELECT *, list_filter(regexp_split_to_array(value, '\\s+'), lambda x: x <> '') AS w FROM b) SELECT key FROM c QUALIFY row_number() OVER (PARTITION BY {_CK} ORDER BY importance DESC, key) = 1""")
def dedup_cascade(spark, sf_dir):
    return M.deduplicate(memories(spark, sf_dir)).select("key")


@query()
def dedup_cascade_whole(spark, sf_dir):
    return M.deduplicate_whole(memories(spark, sf_dir), vectors(spark, sf_dir)).select("key")


@query(f"""WITH {MEMORIES}, v AS (SELECT vec_id::VARCHAR AS k, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k < b.k WHERE list_cosine_similarity(a.e, b.e) > 0.95),
g AS (SELECT CASE WHEN y.importance > x.importance THEN a ELSE b END AS key FROM p JOIN mem x ON x.key = a JOIN mem y ON y.key = b) SELECT key FROM mem WHERE key NOT IN (SELECT key FROM g)""")
def dedup_semantic(spark, sf_dir):
    """As the surveyed system: above 0.95."""
    pairs = G.similar_pairs(vectors(spark, sf_dir).select("key", "embedding"), 0.95).filter("similarity > 0.95")
    return M.drop_similar(memories(spark, sf_dir), pairs).select("key")


@query(f"""WITH {MEMORIES}, x AS (SELECT key, importance, {hours_sql("last_modified")} / 24 AS age, {hours_sql("last_accessed")} / 24 AS idle FROM mem)
SELECT key, CASE WHEN importance < 0.1 AND idle > 180 THEN 'delete' WHEN age > 365 AND idle > 90 THEN 'archive' ELSE 'keep' END AS action FROM x""")
def lifecycle_policies(spark, sf_dir):
    return M.lifecycle(memories(spark, sf_dir), hours_since("last_modified") / 24, hours_since("last_accessed") / 24)


@query(f"WITH {MEMORIES} SELECT key, importance < 0.1 OR {hours_sql('created_at')} > 24 AS cleaned FROM mem")
def cleanup_candidates(spark, sf_dir):
    return memories(spark, sf_dir).select("key", ((F.col("importance") < 0.1) | (hours_since("created_at") > 24)).alias("cleaned"))


@query(f"""WITH {MEMORIES}, s AS (SELECT key, value, list_filter(list_transform(regexp_split_to_array(regexp_replace(value, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM mem)
SELECT key, CASE WHEN strlen(value) <= 200 THEN value WHEN len(s) > 1 AND strlen(s[1] || ' ... ' || s[-1]) < strlen(value) / 2 THEN s[1] || ' ... ' || s[-1] ELSE substring(value, 1, 200) END AS summary FROM s""")
def memory_summary(spark, sf_dir):
    return memories(spark, sf_dir).select("key", M.first_last_summary(F.col("value")).alias("summary"))


_SENT = "list_filter(list_transform(regexp_split_to_array(value, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: strlen(s) > 10)"
_TOKS = "list_filter(regexp_split_to_array(lower(sentence), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"""WITH {MEMORIES}, s AS (SELECT key, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT key, {_SENT} AS l FROM mem)),
w AS (SELECT key, pos, sentence, len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) AS n, unnest({_TOKS}) AS w FROM s), tf AS (SELECT key, pos, w, count(*) AS tf, any_value(n) AS n, any_value(sentence) AS sentence FROM w GROUP BY 1, 2, 3),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), k AS (SELECT key, pos, any_value(sentence) AS sentence, round(sum(tf * ln((SELECT count(*) FROM s) / df::DOUBLE)) / any_value(n), 9) AS score FROM tf JOIN df USING (w) GROUP BY 1, 2)
SELECT key, pos, sentence, round(score, 6) AS score, row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) AS rank FROM k WHERE strlen(sentence) BETWEEN 21 AND 199 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) <= 3""")
def key_points(spark, sf_dir):
    return M.key_points(memories(spark, sf_dir)).select("key", "pos", "sentence", F.round("score", 6).alias("score"), "rank")


@query("""WITH e AS (SELECT c_custkey AS subject, 'segment' AS predicate, c_mktsegment AS object, c_name AS content FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS subject, 'segment' AS predicate, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS object, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' longer' ELSE c_name END AS content FROM customer)
SELECT i.subject, i.predicate, i.object, CASE WHEN e.subject IS NULL THEN 'insert' WHEN e.object <> i.object THEN 'supersede' WHEN e.content = i.content THEN 'no_op' WHEN strlen(i.content) > strlen(e.content) THEN 'update' ELSE 'no_op' END AS decision FROM i LEFT JOIN e USING (subject, predicate)""")
def conflict_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"), F.col("c_name").alias("content"))
    new = c.withColumn("object", F.when(F.col("subject") % 5 == 0, "OTHER").otherwise(F.col("object"))).withColumn("content", F.when(F.col("subject") % 2 == 0, F.concat("content", F.lit(" longer"))).otherwise(F.col("content")))
    return M.resolve_facts(c.filter("subject % 3 <> 0"), new)


@query("""WITH t AS (SELECT user_id, value, CASE WHEN value IS NULL THEN 0.0 ELSE value END AS filled FROM events WHERE event_type <> 'error') SELECT user_id, count(*) AS n, round(sum(filled), 6) AS total FROM t WHERE value IS NOT NULL GROUP BY 1 ORDER BY 1""")
def transform_dataframe(spark, sf_dir):
    """filter, drop_na, fill_na, group_by and sort in their order."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'").dropna(subset=["value"]).fillna({"value": 0.0})
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).orderBy("user_id")


# the SQL surface: statements over temporary views
def _sql(name, text, oracle=None, views=("customer", "orders", "nation", "region", "supplier")):
    def run(spark, sf_dir):
        for v in views:
            table(spark, sf_dir, v).createOrReplaceTempView(v)
        return spark.sql(text)

    run.__name__ = name
    query(oracle or text)(run)


for _kind, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _sql(f"sql_join_{_kind}", f"SELECT c.c_custkey, s.s_suppkey, coalesce(c.c_nationkey, s.s_nationkey) AS nation FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c {_join} (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c.c_nationkey = s.s_nationkey")
_sql("sql_semi_anti", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_sql("sql_cte_group_having", "WITH t AS (SELECT c_nationkey AS k, c_acctbal AS b FROM customer) SELECT k, count(*) AS n, round(avg(b), 4) AS mean FROM t GROUP BY k HAVING count(*) > 5 ORDER BY n DESC, k")
_sql("sql_case_in_between_like", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice BETWEEN 50000 AND 300000 AND o_orderstatus IN ('O', 'F')")
_sql("sql_set_operations", "SELECT * FROM ((SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2) t UNION SELECT r_regionkey + 100 FROM region")
_sql("sql_distinct_order_nulls", "SELECT DISTINCT c_mktsegment AS segment, CASE WHEN c_nationkey < 3 THEN NULL ELSE c_nationkey END AS k FROM customer ORDER BY k DESC NULLS LAST, segment LIMIT 40 OFFSET 3")
_sql("sql_scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_sql("sql_operators", "SELECT c_custkey, c_custkey % 7 AS m, -c_custkey AS neg, NOT (c_custkey > 5) AS flag, c_name IS NOT NULL AS present FROM customer", views=("customer",))


@query(f"WITH {EDGES} SELECT a.src AS a, b.src AS b, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'related_to' AND b.rel_type = 'part_of' AND a.strength >= 0.5")
def match_pattern(spark, sf_dir):
    """MATCH (a)-[related_to {strength >= 0.5}]->(b)-[part_of]->(c)."""
    e = edges(spark, sf_dir)
    one = e.filter("rel_type = 'related_to' AND strength >= 0.5").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.join(e.filter("rel_type = 'part_of'").select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").select("a", "b", "c")


