"""Queries on sources, validation and the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import catalog as C
from ..operators import rules as R
from ..sources import files as S
from .registry import register

# sources and sinks
register("scan_catalog", lambda t: t.cases.selectExpr("'case' AS kind", "case_id AS id").union(t.images.selectExpr("'image'", "image_id")).union(t.vectors.selectExpr("'vector'", "vec_id")).groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")),
    "SELECT kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'case' AS kind, case_id AS id FROM cases UNION ALL SELECT 'image', image_id FROM images UNION ALL SELECT 'vector', vec_id FROM vectors) GROUP BY 1")
register("scan_image_dir", lambda t: S.scan_image_dir(S.write_sample_images(t.embeddings)))
register("file_inventory_check", lambda t: S.inventory(t.pages.select(F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.expr("CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' ELSE '' END")).alias("path"), F.length("html").alias("length"))),
    """SELECT reason, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_size FROM (SELECT CASE WHEN NOT regexp_matches(lower(p), '\\.(jpg|jpeg|png|tif|tiff|bmp)$') THEN 'extension' WHEN length > 52428800 THEN 'too large' WHEN length = 0 THEN 'empty' ELSE 'valid' END AS reason, length
    FROM (SELECT regexp_extract(url, '^[^?#]*', 0) || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' ELSE '' END AS p, length(html) AS length FROM pages)) GROUP BY 1""")
register("file_content_hash", lambda t: t.documents.select("doc_id", F.md5("text").alias("digest"), F.sha2("text", 256).alias("sha256")), "SELECT doc_id, md5(text) AS digest, sha256(text) AS sha256 FROM documents")
register("write_evidence_xml", lambda t: S.evidence_records(t.orders, t.lineitem).select("image_id", F.to_xml("record").alias("xml")))
register("read_evidence_xml", lambda t: S.read_evidence(S.evidence_records(t.orders, t.lineitem).select(F.to_xml("record").alias("body")), "xml"))
register("write_evidence_json", lambda t: S.evidence_records(t.orders, t.lineitem).select("image_id", F.to_json("record").alias("json")))
register("read_evidence_json", lambda t: S.read_evidence(S.evidence_records(t.orders, t.lineitem).select(F.to_json("record").alias("body")), "json"),
    "SELECT o_orderkey AS image_id, count(l_orderkey) AS n_features FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
register("export_history_csv", lambda t: t.events.select("event_id", F.col("event_type").alias("type"), F.format_string("%.2fs", F.col("value")).alias("duration")), "SELECT event_id, event_type AS type, printf('%.2fs', value) AS duration FROM events")
register("export_date_range", lambda t: S.date_range(t.events, "2024-01-05", "2024-01-09").select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09'")
register("sink_daily_partitions", lambda t: S.daily_counts(t.events), "SELECT strftime(ts, '%Y%m%d') AS event_date, count(*) AS n FROM events GROUP BY 1")
register("append_cases_batch", lambda t: C.numbered(t.cases.withColumn("updated_at", F.lit("2024-02-01")).withColumn("created_at", F.coalesce("date_created", F.lit("2024-02-01"))), "case_id", 1_000_000).select("case_id", "created_at", "updated_at", "new_id"),
    "SELECT case_id, coalesce(date_created, '2024-02-01') AS created_at, '2024-02-01' AS updated_at, 1000000 + row_number() OVER (ORDER BY case_id) AS new_id FROM cases")
register("append_images_batch", lambda t: C.numbered(t.images, "image_id", 5_000_000).select("image_id", "date_added", "new_id"), "SELECT image_id, date_added, 5000000 + row_number() OVER (ORDER BY image_id) AS new_id FROM images")
register("append_vectors", lambda t: t.vectors.crossJoin(F.broadcast(t.vectors.agg(F.max(F.size("embedding")).alias("dim")))).where("size(embedding) = dim").selectExpr("vec_id", "CAST(size(embedding) AS BIGINT) AS n_dims", "'embedding' AS algorithm"),
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_dims, 'embedding' AS algorithm FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)")

# validation and cleaning
_CASE_ERRORS = """SELECT case_id, coalesce(case_number, '') AS case_number, list_filter([
    CASE WHEN length(case_number) > 20 THEN 'case_number: too long' END, CASE WHEN length(investigator) < 2 THEN 'investigator: too short' END,
    CASE WHEN weapon_type NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 'weapon_type: not allowed' END,
    CASE WHEN date_created IS NULL THEN 'date_created: required' END], lambda e: e IS NOT NULL) AS errors FROM cases"""
register("validate_schema", lambda t: R.validate(t.cases, R.CASE_RULES).select("case_id", "is_valid", F.size("errors").cast("long").alias("n_errors")), f"SELECT case_id, len(errors) = 0 AS is_valid, CAST(len(errors) AS BIGINT) AS n_errors FROM ({_CASE_ERRORS})")
register("validation_summary", lambda t: R.summary(R.validate(t.cases, R.CASE_RULES)), f"SELECT 'error' AS severity, split_part(e, ': ', 1) AS field, split_part(e, ': ', 2) AS message, count(*) AS n FROM (SELECT unnest(errors) AS e FROM ({_CASE_ERRORS})) GROUP BY ALL")
register("quarantine_split", lambda t: (lambda v: v[0].selectExpr("case_id", "'' AS reason").union(v[1].select("case_id", "reason")))(R.quarantine(R.validate(t.cases, R.CASE_RULES))), f"SELECT case_id, array_to_string(errors, '; ') AS reason FROM ({_CASE_ERRORS})")
register("sanitize_strings", lambda t: t.documents.select("doc_id", R.sanitize(F.col("text")).alias("clean")), r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS clean FROM documents")
register("coerce_types", lambda t: t.events.select("event_id", R.coerce(F.get_json_object("props", "$.k"), "integer").alias("k"), R.coerce(F.col("event_type"), "float").isNull().alias("type_is_text"), R.coerce(F.expr("CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' ELSE 'maybe' END"), "boolean").alias("flag")),
    "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) IS NULL AS type_is_text, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events")
register("check_length", lambda t: t.part.select("p_partkey", F.char_length("p_name").between(8, 12).alias("ok")), "SELECT p_partkey, length(p_name) BETWEEN 8 AND 12 AS ok FROM part")
register("check_range", lambda t: t.part.select("p_partkey", F.col("p_size").between(5, 40).alias("ok")), "SELECT p_partkey, p_size BETWEEN 5 AND 40 AS ok FROM part")
register("check_pattern", lambda t: t.customer.select("c_custkey", F.col("c_name").rlike("(?i)^[A-Z0-9_-]+$").alias("raw_ok"), F.expr("replace(c_name, '#', '-')").rlike("(?i)^[A-Z0-9_-]+$").alias("ok")), "SELECT c_custkey, regexp_matches(c_name, '(?i)^[A-Z0-9_-]+$') AS raw_ok, regexp_matches(replace(c_name, '#', '-'), '(?i)^[A-Z0-9_-]+$') AS ok FROM customer")
register("check_allowed", lambda t: t.orders.where(~F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
register("validate_custom", lambda t: R.validate(t.part, (R.Rule("p_size", "integer", custom=lambda c: c % 2 == 0),)).select("p_partkey", "is_valid"), "SELECT p_partkey, p_size % 2 = 0 AS is_valid FROM part")
register("unknown_columns", lambda t: t.events.select(F.explode(F.expr("array_except(json_object_keys(props), array('known'))")).alias("field")).groupBy("field").agg(F.count("*").alias("n")), "SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) WHERE field <> 'known' GROUP BY 1")
register("reject_duplicate_key", lambda t: C.new_keys(t.orders.selectExpr("o_orderkey", "o_custkey"), t.customer.where("c_acctbal < 0").selectExpr("c_custkey AS o_custkey"), "o_custkey", "o_orderkey"), "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 2")
register("disambiguate_hash", lambda t: C.suffix_repeats(t.documents, F.md5("text"), "doc_id").select("doc_id", "hash"), "SELECT doc_id, CASE WHEN rn > 1 THEN h || '_' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) ELSE h END AS hash FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)")
register("check_foreign_key", lambda t: t.images.join(t.cases.where("status = 'active'"), "case_id", "left_anti").select("image_id", "case_id"), "SELECT image_id, case_id FROM images WHERE case_id NOT IN (SELECT case_id FROM cases WHERE status = 'active')")
register("sanitize_filename", lambda t: t.pages.select("page_id", F.substring(F.regexp_replace("url", r'[<>:"/\\|?* ]', "_"), 1, 100).alias("name")), r"""SELECT page_id, substr(regexp_replace(url, '[<>:"/\\|?* ]', '_', 'g'), 1, 100) AS name FROM pages""")
register("redact_sensitive_keys", lambda t: t.events.select("event_id", F.transform_values(F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")), lambda k, v: F.when(F.lower(k).rlike("password|token|key|secret|auth|credential"), "[REDACTED]").when(F.length(v) > 100, F.concat(F.substring(v, 1, 100), F.lit("..."))).otherwise(v)).alias("m")).selectExpr("event_id", "m['api_key'] AS api_key", "m['k'] AS k"),
    "SELECT event_id, '[REDACTED]' AS api_key, props->>'$.k' AS k FROM events")
register("anonymize_user", lambda t: t.events.select("event_id", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("who")), "SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS who FROM events")

# catalog
register("case_by_key", lambda t: t.cases.where("case_id = 7 OR (case_number = 'Customer-000000012' AND status = 'active')"), "SELECT * FROM cases WHERE case_id = 7 OR (case_number = 'Customer-000000012' AND status = 'active')")
register("rows_by_key_list", lambda t: t.cases.join(C.small(t.vectors.where("vec_id % 3 = 0").selectExpr("vec_id AS case_id")), "case_id", "left_semi"), "SELECT * FROM cases WHERE case_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
register("cases_by_status", lambda t: t.cases.where("status = 'active'").orderBy(F.desc("date_created"), "case_id"), "SELECT * FROM cases WHERE status = 'active'")
register("images_by_case", lambda t: t.images.where("case_id = 899").orderBy("date_added", "image_id"), "SELECT * FROM images WHERE case_id = 899")
register("case_dossier", lambda t: t.cases.select("case_id").join(t.images.select("case_id", "image_id"), "case_id", "left").join(t.lineitem.selectExpr("l_orderkey AS image_id", "l_linenumber").groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").groupBy("case_id").agg(F.count("image_id").alias("n_images"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors")),
    "SELECT c.case_id, count(DISTINCT i.image_id) AS n_images, count(l.l_orderkey) AS n_vectors FROM cases c LEFT JOIN images i USING (case_id) LEFT JOIN lineitem l ON l.l_orderkey = i.image_id GROUP BY 1")
register("catalog_stats", lambda t: t.cases.where("status = 'active'").agg(F.lit("active_cases").alias("name"), F.count("*").alias("n")).union(t.vectors.agg(F.lit("vectors"), F.count("*"))).union(t.images.groupBy(F.concat(F.lit("type:"), "evidence_type")).agg(F.count("*"))),
    "SELECT 'active_cases' AS name, count(*) AS n FROM cases WHERE status = 'active' UNION ALL SELECT 'vectors', count(*) FROM vectors UNION ALL SELECT 'type:' || evidence_type, count(*) FROM images GROUP BY 1")
register("search_text", lambda t: t.documents.select("doc_id", C.search(F.col("text"), "The").alias("part"), C.search(F.col("text"), "the", whole_word=True).alias("word"), C.search(F.col("text"), "Th.*and", True, regex=True).alias("pattern"), C.search(F.col("text"), "th*er").alias("wild")),
    "SELECT doc_id, contains(lower(text), 'the') AS part, regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') AS word, regexp_matches(text, 'Th.*and') AS pattern, lower(text) LIKE '%th%er%' AS wild FROM documents")
register("search_facets", lambda t: C.facets(t.images.join(t.cases.select("case_id", "weapon_type", "investigator"), "case_id"), weapon_type="BUILDING", status="O", investigator="all").where("date_added BETWEEN '1995-01-01' AND '1999-12-31'").select("image_id", "case_id"), "SELECT image_id, case_id FROM images JOIN cases c USING (case_id) WHERE weapon_type = 'BUILDING' AND images.status = 'O' AND date_added BETWEEN '1995-01-01' AND '1999-12-31'".replace("JOIN cases c", "JOIN cases"))
register("search_samples", lambda t: t.images.where(F.col("status").isin("O", "P") & F.col("date_added").between("1995-01-01", "1996-12-31")).orderBy(F.desc("file_size"), "image_id").offset(20).limit(20).select("image_id", "file_size"), "SELECT image_id, file_size FROM images WHERE status IN ('O', 'P') AND date_added BETWEEN '1995-01-01' AND '1996-12-31' ORDER BY file_size DESC, image_id LIMIT 20 OFFSET 20")
register("filter_results", lambda t: B.unlike(t.vectors, t.probes, 0.2, "7"), "SELECT id_a, id_b, score FROM pairs WHERE score >= 0.2 AND NOT same AND contains(CAST(id_b AS VARCHAR), '7')")
register("sort_results", lambda t: B.orders(t.vectors, t.probes), "SELECT id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY score DESC, id_b) AS rank FROM pairs")
register("filter_history", lambda t: t.events.join(F.broadcast(t.spark.createDataFrame([("click", "completed"), ("view", "completed"), ("purchase", "success"), ("error", "failed")], "event_type string, status string")), "event_type").where("status <> 'failed'").where((F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-03'")) & (F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-20'"))).select("event_id", "status"),
    "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'success' ELSE 'completed' END AS status FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
register("filter_latest_n", lambda t: C.latest(t.events, "ts", 50, "event_type = 'error'").select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
register("bulk_update", lambda t: C.update(t.images, t.vectors.selectExpr("vec_id AS image_id", "'reviewed' AS status"), "image_id", ["status"], t.vectors.where("vec_id % 5 = 0").selectExpr("vec_id AS image_id")).select("image_id", "status"),
    "SELECT image_id, CASE WHEN v.vec_id IS NOT NULL THEN 'reviewed' ELSE status END AS status FROM images LEFT JOIN embeddings v ON v.vec_id = image_id WHERE v.vec_id IS NULL OR v.vec_id % 5 <> 0")
register("regroup_evidence", lambda t: C.update(t.images, t.images.where("case_id = 899").selectExpr("image_id", "CAST(1 AS BIGINT) AS case_id"), "image_id", ["case_id"]).groupBy("case_id").agg(F.count("*").alias("n")), "SELECT CASE WHEN case_id = 899 THEN 1 ELSE case_id END AS case_id, count(*) AS n FROM images GROUP BY 1")
