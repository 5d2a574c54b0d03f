"""Source and sink queries: derived tables are written in each format and read back."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.detect import RuleConfig
from ..scratch import new_folder, written
from ..sources import artefacts as A, readers as R, writers as Wr
from . import fixtures as fx
from .pose import metrics_sql, verdicts, M, _vg
from .registry import query, rounded, table
from .stream import drained

KINDS = ("click", "view", "error", "signup", "purchase")
_empty = "frame_idx % 13 = 7"  # frames in which nobody is seen
_rows = f"""SELECT p.session_id, p.frame_idx, p.person_idx, CAST(j AS INTEGER) AS joint, ROUND(COALESCE(x, 0), 6) AS x, ROUND(COALESCE(y, 0), 6) + 0.0E0 AS y, ROUND(COALESCE(c, 0), 6) AS c
FROM (SELECT DISTINCT session_id, frame_idx, person_idx FROM people_t WHERE NOT {_empty}) p CROSS JOIN (SELECT UNNEST(RANGE(19)) AS j)
LEFT JOIN people_t k ON k.session_id = p.session_id AND k.frame_idx = p.frame_idx AND k.person_idx = p.person_idx AND k.joint = j
UNION ALL SELECT session_id, frame_idx, NULL, CAST(j AS INTEGER), NULL, NULL, 0 FROM (SELECT DISTINCT session_id, frame_idx FROM people_t WHERE {_empty}), (SELECT UNNEST(RANGE(19)) AS j)"""


def frame_files(spark, sf) -> str:
    path = new_folder(spark, "people-json")
    people = fx.people(spark, sf)
    every = people.select("session_id", "frame_idx").distinct()
    Wr.write_people_json(Wr.people_json(people.where(f"NOT ({_empty})"), 19, every=every), path)
    return path


def named(df):
    parts = F.split("name", "_")
    out = df.select(
        parts[0].cast("bigint").alias("session_id"), parts[1].cast("bigint").alias("frame_idx"), "person_idx", "joint", "x", "y", "c"
    )
    return rounded(out, "x", "y", "c")


@query("src_people_json", _rows)
def _(spark, sf):
    return named(R.read_people_json(spark, frame_files(spark, sf), 19, packed=True))


@query("src_file_stream", _rows)
def _(spark, sf):
    return named(drained(R.stream_people_json(spark, frame_files(spark, sf), 19), "json-stream"))


@query("sink_people_json", f"""SELECT session_id, frame_idx, COUNT(DISTINCT person_idx) FILTER (NOT {_empty}) AS n_people, COUNT(*) FILTER (c > 0 AND NOT {_empty}) AS n_seen FROM people_t GROUP BY ALL""")
def _(spark, sf):
    raw = spark.read.schema(R.PEOPLE_SCHEMA).json(frame_files(spark, sf))
    part = F.split("name", "_")
    conf = F.flatten(F.transform("people", lambda p: F.transform(F.sequence(F.lit(0), F.lit(18)), lambda j: p["pose_keypoints_2d"][j * 3 + 2])))
    return raw.select(
        part[0].cast("bigint").alias("session_id"), part[1].cast("bigint").alias("frame_idx"), F.size("people").cast("bigint").alias("n_people"),
        F.size(F.filter(conf, lambda c: c > 0)).cast("bigint").alias("n_seen"),
    )


@query(
    "src_keypoint_csv",
    f"""WITH r AS (SELECT session_id, frame_idx, joint, x, y, c FROM kp_t WHERE c > 0 AND joint NOT IN (1, 8)),
 g AS (SELECT session_id, f AS frame_idx, CAST(j AS INTEGER) AS joint FROM (SELECT session_id, UNNEST(RANGE(MAX(frame_idx) + 1)) AS f FROM kp_t GROUP BY 1), (SELECT UNNEST(RANGE(25)) AS j)),
 t AS (SELECT session_id, frame_idx, joint AS dst, x, y, c FROM r UNION ALL SELECT session_id, frame_idx, CASE WHEN joint IN (2, 5) THEN 1 ELSE 8 END, x, y, c FROM r WHERE joint IN (2, 5, 9, 12)),
 m AS (SELECT session_id, frame_idx, dst, SUM(x*c)/SUM(c) AS x, SUM(y*c)/SUM(c) AS y, AVG(c) AS c FROM t GROUP BY ALL)
SELECT g.session_id, g.frame_idx, joint, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(COALESCE(c, 0), 6) AS c FROM g LEFT JOIN m ON m.session_id = g.session_id AND m.frame_idx = g.frame_idx AND dst = joint""",
)
def _(spark, sf):
    path = new_folder(spark, "keypoint-csv")
    names = F.create_map(*[v for n, j in R.CSV_PARTS.items() for v in (F.lit(j), F.lit(n))])
    rows = fx.keypoints(spark, sf).where("joint NOT IN (1, 8)").select(
        "session_id", (F.col("frame_idx") + 1).alias("Frame"), names[F.col("joint")].alias("Keypoint"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("c").alias("Confidence")
    )
    Wr.foldered(rows, ["session_id"]).option("header", True).csv(path)
    out = R.read_keypoint_csv(spark, path, ["session_id"]).withColumn("session_id", F.col("session_id").cast("bigint"))
    return rounded(out, "x", "y", "c")


@query("src_manifest_csv", "SELECT doc_id::VARCHAR AS doc_id, source, lang FROM documents")
def _(spark, sf):
    path = new_folder(spark, "manifest")
    table(spark, sf, "documents").select("doc_id", "source", "lang").write.option("header", True).csv(path)
    return R.read_manifest_csv(spark, path)


@query("src_ragged_csv", "SELECT p_partkey || '.mp4' AS name, p_size::VARCHAR AS duration, p_name || ', ' || p_type || ',' || p_brand AS description FROM part WHERE p_partkey % 10 <> 3")
def _(spark, sf):
    path = new_folder(spark, "ragged")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(".mp4 ,"), F.col("p_size").cast("string"), F.lit(", "), "p_name", F.lit(", "), "p_type", F.lit(","), "p_brand")
    part = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 10 == 3, "").otherwise(line).alias("value"))
    part.unionByName(spark.range(1).select(F.lit("name,duration,description").alias("value"))).write.text(path)
    return R.read_ragged_csv(spark, path, "name,duration,description")


@query("src_chat_jsonl", "SELECT conv_id::VARCHAR AS id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
def _(spark, sf):
    path = new_folder(spark, "chats")
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_m")
    )
    turns.select("id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).write.json(path)
    return R.chat_turns(R.read_chat_jsonl(spark, path))


@query("src_box_txt", """SELECT 'hand_' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN 'l' ELSE 'r' END AS stem, CASE WHEN l_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS side,
  CASE WHEN l_linenumber < 7 THEN l_quantity END AS box_x, CASE WHEN l_linenumber < 7 THEN l_discount END AS box_y, CASE WHEN l_linenumber < 7 THEN l_tax END AS box_w,
  CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber AS DOUBLE) END AS box_h, l_linenumber >= 7 AS failed FROM lineitem""")
def _(spark, sf):
    path = new_folder(spark, "boxes")
    text = [F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")]
    stem = F.concat(F.lit("hand_"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "l").otherwise("r"))
    last = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string")).otherwise("x")
    Wr.foldered(table(spark, sf, "lineitem").select(stem.alias("stem"), F.concat_ws(" ", *text, last).alias("value")), ["stem"]).text(path)
    out = R.read_box_txt(spark, path)
    return out.withColumn("failed", F.col("error").isNotNull()).drop("error")


@query("src_camera_xml", """SELECT s_suppkey::VARCHAR AS serial, s_suppkey + 500.0E0 AS p0, 320.0E0 + s_suppkey AS p2, (s_suppkey + 500.0E0)*0.5E0 + 320*2.0E0 AS p3, 240*2.0E0 AS p7, 2.0E0 AS p11 FROM supplier""")
def _(spark, sf):
    path = new_folder(spark, "cameras")
    k = F.col("s_suppkey").cast("string")

    def block(tag, data):
        return F.concat(F.lit(f"<{tag}><rows>3</rows><cols>4</cols><dt>d</dt><data>"), data, F.lit(f"</data></{tag}>"))

    focal = (F.col("s_suppkey") + 500).cast("string")
    doc = F.concat(
        F.lit("<opencv_storage>"), F.concat(F.lit("<serial>"), k, F.lit("</serial>")),
        block("CameraMatrix", F.lit("1. 0. 0. 0.5 0. 1. 0. 0. 0. 0. 1. 2.")),
        block("Intrinsics", F.concat(focal, F.lit(". 0. 320. 0. "), focal, F.lit(". 240. 0. 0. 1."))),
        block("Distortion", F.lit("0. 0. 0. 0. 0. 0. 0. 0.")), F.lit("</opencv_storage>"),
    )
    table(spark, sf, "supplier").select(doc.alias("value")).write.text(path)
    p = F.col("p")
    return R.read_camera_xml(spark, path, packed=True).select("serial", p[0].alias("p0"), (p[2] + F.col("serial").cast("double")).alias("p2"), p[3].alias("p3"), p[7].alias("p7"), p[11].alias("p11"))


@query("src_listing")
def _(spark, sf):
    return R.read_listing(spark, sf, [".parquet"]).select("name", "length")


@query("verify_manifest_files")
def _(spark, sf):
    listed = R.read_listing(spark, sf, [".parquet"]).select("name", "length")
    sizes = spark.read.format("binaryFile").load(sf).select(F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("md5"))
    manifest = listed.join(sizes, "name").select(
        "name", F.when(F.col("name").startswith("o"), F.col("length") + 1).otherwise(F.col("length")).alias("size"),
        F.when(F.col("name").startswith("p"), F.lit("0")).otherwise(F.col("md5")).alias("md5"),
    )
    return R.verify_files(spark, sf, manifest)


@query("sink_coco_results", """SELECT session_id, frame_idx, person_idx, frame_idx AS image_id, 1 AS category_id, COUNT(*) FILTER (c > 0 AND joint NOT IN (1, 8)) AS n_visible,
  ROUND(SUM(CASE WHEN c > 0 THEN x + y + 1 ELSE -2 END) FILTER (joint NOT IN (1, 8)), 4) AS total, ROUND(AVG(c), 6) AS score
FROM people_t GROUP BY ALL HAVING MAX(c) FILTER (joint NOT IN (1, 8)) > 0""")
def _(spark, sf):
    path = new_folder(spark, "results")
    Wr.write_json(Wr.coco_results(fx.people(spark, sf), F.col("frame_idx")), path, "gzip")
    back = spark.read.schema(
        "session_id bigint, frame_idx bigint, person_idx int, image_id bigint, category_id int, keypoints array<double>, score double"
    ).json(path)
    k = F.col("keypoints")
    visible = F.aggregate(F.sequence(F.lit(0), F.lit(16)), F.lit(0.0), lambda a, i: a + k[i * 3 + 2])
    total = F.aggregate(k, F.lit(0.0), lambda a, v: a + v)
    out = back.select(
        "session_id", "frame_idx", "person_idx", "image_id", "category_id", visible.cast("bigint").alias("n_visible"), total.alias("total"), "score"
    )
    return rounded(rounded(out, "score"), "total", digits=4)


@query("sink_summary_csv", "SELECT session_id, label, category, n_frames FROM sessions_t")
def _(spark, sf):
    path = new_folder(spark, "summary")
    Wr.write_summary_csv(fx.sessions(spark, sf).select("session_id", "label", "category", "n_frames"), path)
    return spark.read.schema("session_id bigint, label string, category string, n_frames bigint").option("header", True).csv(path)


@query("sink_report_json", f"""SELECT m.*, 0.3E0 AS min_drop, (SELECT COUNT(*) FROM (SELECT 1 FROM verdict_t WHERE config_id = 0 AND truth <> pred LIMIT 100)) AS n_errors,
 (SELECT MIN(session_id) FROM verdict_t WHERE config_id = 0 AND truth <> pred) AS first_error FROM ({metrics_sql("truth", "pred", "grp", _vg)}) m""")
def _(spark, sf):
    path = new_folder(spark, "report")
    found = written(verdicts(spark, sf), "verdicts")
    grouped = rounded(metrics.metrics_by_group(found, "truth", "pred", "category"), *M)
    errors = metrics.first_n(found.where("truth <> pred"), ["session_id"], 100, "rank").select("rank", "session_id", "category", "truth", "pred")
    rep = Wr.report(grouped, "category", asdict(RuleConfig()), errors)
    Wr.write_json(rep, path)
    back = spark.read.schema(rep.schema).json(path)
    more = [F.col("config.min_drop").alias("min_drop"), F.size("first_errors").cast("bigint").alias("n_errors"), F.get("first_errors", F.lit(0))["session_id"].alias("first_error")]
    one = back.select(F.lit("overall").alias("grp"), "overall.*", *more)
    return one.unionByName(back.select(F.explode("by_category").alias("grp", "m"), *more).select("grp", "m.*", "min_drop", "n_errors", "first_error"))


@query("sink_detections", "SELECT CAST(session_id AS BIGINT) AS session_id, frame_idx, event_type, value FROM frames_t")
def _(spark, sf):
    path = new_folder(spark, "detections")
    Wr.write_detections(fx.frames(spark, sf).select("session_id", "frame_idx", "event_type", "value"), path)
    return spark.read.schema("session_id bigint, frame_idx bigint, event_type string, value double").parquet(path)


@query("sink_artefacts", "SELECT session_id, frame_idx, event_type, value, CASE WHEN session_id % 2 = 0 THEN 1 ELSE 2 END AS turn FROM frames_t")
def _(spark, sf):
    """Every second session first, then all: the second run writes only what is missing."""
    path = new_folder(spark, "artefacts")
    rows = fx.frames(spark, sf).select("session_id", "frame_idx", "event_type", "value")
    A.write_artefacts(rows.where("session_id % 2 = 0").withColumn("turn", F.lit(1)), path)
    A.write_artefacts(rows.withColumn("turn", F.lit(2)), path, existing="skip")
    return A.read_artefacts(spark, path).drop("run")


@query("sink_comparison_jsonl", f"SELECT user_id, {', '.join(f"MAX(event_id) FILTER (event_type = '{k}') AS {k}" for k in KINDS)} FROM events GROUP BY user_id")
def _(spark, sf):
    from ..operators.datasets import pivot_variants

    path = new_folder(spark, "comparison")
    answers = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("response"))
    Wr.write_json(pivot_variants(answers, "user_id", "event_type", "response", list(KINDS)), path)
    return spark.read.schema(", ".join(["user_id bigint", *[f"{k} bigint" for k in KINDS]])).json(path)
