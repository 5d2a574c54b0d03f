"""Dataset, chat, string and telemetry queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from .. import model
from ..functions import columns as C, strings as S
from ..operators import chat, datasets as D, telemetry
from ..operators.chunks import time_bucket
from . import fixtures as fx
from .registry import cte, query, rounded, table

SALT = "clip-split-v1:"


def _r(*names, d=6):
    return ", ".join(f"ROUND({n}, {d}) + 0.0E0 AS {n}" for n in names)


@query("stratified_split", f"""SELECT c_custkey, CASE WHEN rk < ROUND_EVEN(n*0.7E0, 0) THEN 'train'
  WHEN rk < ROUND_EVEN(n*0.7E0, 0) + ROUND_EVEN(n*0.15E0, 0) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_mktsegment, c_nationkey % 2) AS n,
  ROW_NUMBER() OVER (PARTITION BY c_mktsegment, c_nationkey % 2 ORDER BY SHA256('{SALT}' || c_custkey::VARCHAR), c_custkey) - 1 AS rk FROM customer)""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 2).alias("grp"))
    return D.stratified_split(rows, "c_custkey", ["c_mktsegment", "grp"], SALT).select("c_custkey", "split")


@query("subject_split", """SELECT session_id, subject, CASE subject WHEN 1 THEN 'train' WHEN 2 THEN 'train' WHEN 3 THEN 'validation' END AS split,
  CASE WHEN subject NOT IN (1, 2, 3) THEN 'no split for subject ' || subject END AS error FROM sessions_t""")
def _(spark, sf):
    s = fx.sessions(spark, sf).select("session_id", "subject")
    return D.subject_split(s, "subject", {1: "train", 2: "train", 3: "validation"})


@query("append_train", """SELECT clip_id, split, truth, NULL::VARCHAR AS source FROM scores_t
UNION ALL SELECT doc_id, 'train', NULL, source FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    main = fx.clip_scores(spark, sf).select("clip_id", "split", "truth")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    split = F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test")
    return D.append_train(main, docs.select(F.col("doc_id").alias("clip_id"), split.alias("split"), "source"))


@query("dataset_scope", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return D.dataset_scope(table(spark, sf, "documents").select("doc_id", "source"), good, "doc_id")


@query("pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.pending_work(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("missing_artifacts", "SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return D.missing_artifacts(table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels"), "doc_id")


@query("enrich_descriptions", """SELECT d.doc_id, source, COALESCE('quality=' || quality, '') AS description
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    desc = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality="), F.col("quality")).alias("description"))
    return D.enrich_descriptions(table(spark, sf, "documents").select("doc_id", "source"), desc, "doc_id", ["description"])


@query("attach_cameras", """SELECT session_id, frame_idx, v AS camera_id, 500.0E0 AS focal, 640 AS width, 90*v AS yaw
FROM frames_t JOIN (SELECT CAST(UNNEST(RANGE(4)) AS INTEGER) AS v) ON v <= event_id % 4""")
def _(spark, sf):
    from .views import cameras

    views = fx.frames(spark, sf).select(
        "session_id", "frame_idx", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("camera_id")
    )
    return D.attach_cameras(views, cameras(spark)).select("session_id", "frame_idx", "camera_id", "focal", "width", "yaw")


@query("reconcile_frame_counts", """SELECT session_id, n_frames + CAST(session_id % 7 = 0 AS INTEGER) AS declared_frames, n_frames AS found_frames
FROM sessions_t WHERE session_id % 7 = 0""")
def _(spark, sf):
    declared = fx.sessions(spark, sf).select(
        "session_id", (F.col("n_frames") + (F.col("session_id") % 7 == 0).cast("int")).alias("declared_frames")
    )
    return D.reconcile_counts(declared, fx.frames(spark, sf))


@query("pivot_variants", """SELECT user_id, MAX(event_id) FILTER (event_type = 'click')::VARCHAR AS click, MAX(event_id) FILTER (event_type = 'view')::VARCHAR AS view,
  MAX(event_id) FILTER (event_type = 'error')::VARCHAR AS error, MAX(event_id) FILTER (event_type = 'signup')::VARCHAR AS signup, MAX(event_id) FILTER (event_type = 'purchase')::VARCHAR AS purchase FROM events GROUP BY user_id""")
def _(spark, sf):
    variants = ["click", "view", "error", "signup", "purchase"]
    answers = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.max("event_id").cast("string").alias("response")
    )
    return D.pivot_variants(answers, "user_id", "event_type", "response", variants)


@query("duplicate_variants", "SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL HAVING COUNT(*) > 1")
def _(spark, sf):
    return D.duplicate_variants(table(spark, sf, "events"), "user_id", "event_type")


# ---- conversations ---------------------------------------------------------------------------

cte(
    "badturns_t",
    """SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'bot' WHEN conv_id % 10 = 7 AND turn = 0 THEN 'system' ELSE role END AS role,
  CASE WHEN conv_id % 10 = 5 AND turn = 0 THEN '  ' ELSE text END AS text FROM conversations""",
)


def broken_turns(spark, sf):
    c, t = F.col("conv_id") % 10, F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when((c == 3) & (t == 1), "bot").when((c == 7) & (t == 0), "system").otherwise(F.col("role")).alias("role"),
        F.when((c == 5) & (t == 0), "  ").otherwise(F.col("text")).alias("text"),
    )


ERRORS_SQL = r"""SELECT conv_id, turn, error FROM (SELECT *, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown role'
  WHEN NOT regexp_matches(text, '\S') THEN 'no text'
  WHEN role = 'assistant' AND COALESCE(LAG(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> 'user' THEN 'answer without a question before it' END AS error
 FROM badturns_t) WHERE error IS NOT NULL"""
cte("turnerrors_t", ERRORS_SQL)
cte("allturns_t", """SELECT conv_id, turn, role, text FROM badturns_t UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Answer briefly.' FROM badturns_t""")


@query("validate_turns", "SELECT * FROM turnerrors_t")
def _(spark, sf):
    return chat.validate_turns(broken_turns(spark, sf))


@query("expand_assistant_turns", """SELECT conv_id, turn, completion, n AS prompt_turns, prompt FROM (
 SELECT conv_id, turn, text AS completion, role, LAG(role) OVER w AS before, COUNT(*) OVER p AS n, STRING_AGG(role || ': ' || text, chr(10)) OVER p AS prompt
 FROM allturns_t WHERE conv_id NOT IN (SELECT conv_id FROM turnerrors_t)
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE role = 'assistant' AND before = 'user'""")
def _(spark, sf):
    out = chat.expand_assistant_turns(chat.prepend_system(broken_turns(spark, sf), "Answer briefly."))
    lines = F.transform("prompt", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return out.select(
        "conv_id", "turn", "completion", F.size("prompt").cast("bigint").alias("prompt_turns"), F.array_join(lines, "\n").alias("prompt")
    )


@query("valid_questions", """SELECT conv_id, question_id, conv_id > MIN(conv_id) OVER (PARTITION BY question_id) AS duplicate, last_role = 'user' AS ends_with_user
FROM (SELECT conv_id, conv_id % 80 AS question_id, ARG_MAX(role, turn) AS last_role FROM conversations GROUP BY conv_id)""")
def _(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("question_id", F.col("conv_id") % 80)
    return chat.valid_questions(turns)


@query("prepend_system", """SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Answer briefly.' FROM conversations""")
def _(spark, sf):
    return chat.prepend_system(table(spark, sf, "conversations"), "Answer briefly.")


@query("drop_empty_dataset", """SELECT ds, COUNT(*) AS turns, COUNT(*) FILTER (role = 'assistant') AS assistant_turns, COUNT(*) FILTER (role = 'assistant') > 0 AS usable
FROM (SELECT conv_id % 7 AS ds, CASE WHEN conv_id % 7 = 2 THEN 'user' ELSE role END AS role FROM conversations) GROUP BY ds""")
def _(spark, sf):
    ds = F.col("conv_id") % 7
    turns = table(spark, sf, "conversations").select(ds.alias("ds"), F.when(ds == 2, "user").otherwise(F.col("role")).alias("role"))
    return chat.dataset_check(turns, "ds")


@query("parse_variant_label", """SELECT doc_id, CASE WHEN ok THEN TRIM(LEFT(s, i - 1)) END AS label, CASE WHEN ok THEN SUBSTRING(s, i + 1) END AS path FROM (
 SELECT *, i > 0 AND TRIM(LEFT(s, i - 1)) <> '' AND TRIM(SUBSTRING(s, i + 1)) <> '' AS ok FROM (SELECT *, INSTR(s, '=') AS i FROM (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN ' = /m/' || lang WHEN 2 THEN source || '=' ELSE ' ' || source || ' =/m/' || lang || '=x' END AS s FROM documents)))""")
def _(spark, sf):
    d = F.col("doc_id") % 5
    s = (
        F.when(d == 0, F.col("source")).when(d == 1, F.concat(F.lit(" = /m/"), "lang"))
        .when(d == 2, F.concat("source", F.lit("="))).otherwise(F.concat(F.lit(" "), "source", F.lit(" =/m/"), "lang", F.lit("=x")))
    )
    parsed = table(spark, sf, "documents").select("doc_id", S.parse_variant_label(s).alias("v"))
    return parsed.select("doc_id", "v.label", "v.path")


# ---- strings, numbers, names -----------------------------------------------------------------


@query("last_number", "SELECT c_custkey, TRY_CAST(NULLIF(regexp_extract(s, '([0-9]+)$', 1), '') AS BIGINT) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || 'x' ELSE c_name END AS s FROM customer)")
def _(spark, sf):
    s = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", S.last_number(s).alias("n"))


@query("fixed_length", "SELECT o_orderkey, CASE WHEN LENGTH(o_orderkey::VARCHAR) <= 4 THEN LPAD(o_orderkey::VARCHAR, 4, '0') END AS padded FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.fixed_length(F.col("o_orderkey"), 4).alias("padded"))


@query("split_lower_upper", "SELECT page_id, STRING_SPLIT(url, '.')[1] AS head, CAST(LEN(STRING_SPLIT(url, '.')) AS INTEGER) AS pieces, LOWER(url) AS low, UPPER(url) AS up FROM pages")
def _(spark, sf):
    parts = S.split_on(F.col("url"), ".")
    return table(spark, sf, "pages").select("page_id", parts[0].alias("head"), F.size(parts).alias("pieces"), F.lower("url").alias("low"), F.upper("url").alias("up"))


@query("strip_leading_zeros", r"""SELECT s_suppkey, regexp_replace(s, '^0+([0-9])', '\1') AS stripped, regexp_extract(s, '^([0-9]*)', 1) AS leading
FROM (SELECT s_suppkey, SPLIT_PART(s_name, '#', 2) || CASE WHEN s_suppkey % 2 = 0 THEN 'a7' ELSE '' END AS s FROM supplier)""")
def _(spark, sf):
    s = F.concat(F.element_at(S.split_on(F.col("s_name"), "#"), 2), F.when(F.col("s_suppkey") % 2 == 0, "a7").otherwise(""))
    return table(spark, sf, "supplier").select("s_suppkey", S.strip_leading_zeros(s).alias("stripped"), S.leading_number(s).alias("leading"))


_nat = r"array_to_string(list_transform(regexp_extract_all(upper(s), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN chr(1) || lpad(length(regexp_replace(t, '^0+([0-9])', '\1'))::VARCHAR, 4, '0') || regexp_replace(t, '^0+([0-9])', '\1') ELSE t END), '')"


@query("natural_order", f"SELECT page_id, {_nat} AS sort_key FROM (SELECT page_id, url AS s FROM pages)")
def _(spark, sf):
    keyed = table(spark, sf, "pages").select("page_id", "url", S.natural_key(F.col("url")).alias("sort_key"))
    return D.order_frames(keyed, "sort_key", "url", "page_id").drop("url")


@query("path_parts", r"""SELECT page_id, SPLIT_PART(u, '/', -1) AS file, regexp_replace(SPLIT_PART(u, '/', -1), '\.[^.]*$', '') AS stem,
  regexp_extract(SPLIT_PART(u, '/', -1), '\.([^.]*)$', 1) AS ext, regexp_extract(u, '^(.*/)[^/]*$', 1) AS parent,
  LOWER(regexp_extract(SPLIT_PART(u, '/', -1), '\.([^.]*)$', 1)) IN ('jpg', 'png') AS is_image
FROM (SELECT page_id, SPLIT_PART(url, '?', 1) || CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '/frame_01.json' ELSE '' END AS u FROM pages)""")
def _(spark, sf):
    p = F.col("page_id") % 3
    u = F.concat(F.substring_index("url", "?", 1), F.when(p == 0, ".JPG").when(p == 1, "/frame_01.json").otherwise(""))
    return table(spark, sf, "pages").select("page_id", u.alias("u")).select(
        "page_id", S.file_name(F.col("u")).alias("file"), S.stem(F.col("u")).alias("stem"), S.extension(F.col("u")).alias("ext"),
        S.parent(F.col("u")).alias("parent"), S.has_extension(F.col("u"), ["jpg", ".png"]).alias("is_image"),
    )


@query("clean_names", """SELECT c_custkey, LOWER(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g')) AS clean, REPLACE(c_name, '00', '') AS removed, REPLACE(c_name, '#', '-') AS replaced FROM customer""")
def _(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", S.clean_name(n).alias("clean"), S.remove_substring(n, "00").alias("removed"), S.replace_char(n, "#", "-").alias("replaced")
    )


@query("half_up_clamp", "SELECT event_id, CAST(FLOOR(value/7 + 0.5E0) AS BIGINT) AS nearest, LEAST(GREATEST(value, 10.0E0), 40.0E0) AS clamped FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", C.half_up(v / 7).alias("nearest"), C.clamp(v, 10.0, 40.0).alias("clamped"))


@query("wrap_angles", """SELECT event_id, ROUND(b, 6) AS zero_two_pi, ROUND(CASE WHEN b > PI() THEN b - 2*PI() ELSE b END, 6) + 0.0E0 AS plus_minus_pi
FROM (SELECT event_id, v - 2*PI()*FLOOR(v/(2*PI())) AS b FROM (SELECT event_id, value/3 - 20 AS v FROM events))""")
def _(spark, sf):
    v = F.col("value") / 3 - 20
    return rounded(table(spark, sf, "events").select("event_id", C.wrap_2pi(v).alias("zero_two_pi"), C.wrap_pi(v).alias("plus_minus_pi")), "zero_two_pi", "plus_minus_pi")


_names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(model.PART_NAMES["parts25"]))


@query("part_lookup", f"""SELECT session_id, frame_idx, joint, name, name LIKE 'L%' AS is_left, ROUND(c, 6) AS c
FROM kp_t JOIN (VALUES {_names}) AS t(part, name) ON joint = part WHERE name IN ('Nose', 'LWrist', 'RWrist', 'MidHip')""")
def _(spark, sf):
    parts = model.skeleton_parts(spark).where("model = 'parts25'").select(F.col("part").alias("joint"), "name")
    out = fx.keypoints(spark, sf).join(F.broadcast(parts), "joint").where(F.col("name").isin("Nose", "LWrist", "RWrist", "MidHip"))
    return rounded(out.select("session_id", "frame_idx", "joint", "name", F.col("name").startswith("L").alias("is_left"), "c"), "c")


@query("finite_max", "SELECT event_id, COALESCE(GREATEST(CASE WHEN event_id % 3 > 0 THEN value END, CASE WHEN event_id % 5 > 0 THEN 60 - value END), 0) AS best FROM events")
def _(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    nan = F.lit(float("nan"))
    return table(spark, sf, "events").select(
        "event_id", C.finite_max(F.when(e % 3 > 0, v).otherwise(nan), F.when(e % 5 > 0, 60 - v)).alias("best")
    )


@query("stable_hash", f"SELECT doc_id, SHA256('{SALT}' || doc_id::VARCHAR) AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.stable_hash(SALT, F.col("doc_id")).alias("key"))


@query("json_codec", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"id":' || event_id || ',"tags":["' || event_type || '","t"],"box":{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}}' AS encoded FROM events""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k BIGINT").alias("p"))
    return ev.select(
        "event_id", "p.k",
        F.to_json(F.struct(F.col("event_id").alias("id"), F.array("event_type", F.lit("t")).alias("tags"), F.col("p").alias("box"))).alias("encoded"),
    )


def _archive_sql():
    return """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'f' ELSE 'nf' END || '_mask_' || SUBSTRING('bcsx', CAST(doc_id % 4 + 1 AS INTEGER), 1) || '_' || (doc_id % 10)
  || CASE WHEN doc_id % 3 = 0 THEN '_ketpoints_csv' ELSE '_keypoints_csv' END AS a, 'Clip_' || doc_id AS clip FROM documents"""


@query("parse_clip_id", rf"""SELECT doc_id, label, category, archive, CASE WHEN ok THEN 'clip_' || label || '_' || category || '_a' || archive || '_' || LOWER(clip) END AS video_id FROM (
 SELECT doc_id, clip, ok, CASE WHEN ok THEN CASE WHEN a LIKE 'nf%' THEN 'normal' ELSE 'fall' END END AS label,
  CASE WHEN ok THEN CASE regexp_extract(a, '_mask_([bcs])_', 1) WHEN 'b' THEN 'bed' WHEN 'c' THEN 'chair' ELSE 'stand' END END AS category,
  CASE WHEN ok THEN regexp_extract(a, '_([0-9])_', 1) END AS archive
 FROM (SELECT *, regexp_matches(a, '^(nf|f)_mask_([bcs])_([0-9])_(keypoints|ketpoints)_csv$') AS ok FROM ({_archive_sql()})))""")
def _(spark, sf):
    d = F.col("doc_id")
    a = F.concat(
        F.when(d % 2 == 0, "f").otherwise("nf"), F.lit("_mask_"), F.substring(F.lit("bcsx"), (d % 4 + 1).cast("int"), F.lit(1)), F.lit("_"),
        (d % 10).cast("string"), F.when(d % 3 == 0, "_ketpoints_csv").otherwise("_keypoints_csv"),
    )
    clip = S.parse_clip_id(a, F.concat(F.lit("Clip_"), d.cast("string")), "clip")
    return table(spark, sf, "documents").select("doc_id", clip.alias("v")).select("doc_id", "v.label", "v.category", "v.archive", "v.video_id")


@query("label_from_name", """SELECT doc_id, name, CASE WHEN CONTAINS(name, '_fall_') THEN 'fall' ELSE 'normal' END AS label
FROM (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '_fall_' WHEN 1 THEN '_normal_' ELSE '_other_' END || doc_id AS name FROM documents) WHERE name LIKE '%\\_fall\\_%' ESCAPE '\\' OR name LIKE '%\\_normal\\_%' ESCAPE '\\'""")
def _(spark, sf):
    d = F.col("doc_id")
    name = F.concat("source", F.when(d % 3 == 0, "_fall_").when(d % 3 == 1, "_normal_").otherwise("_other_"), d.cast("string"))
    named = table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return named.withColumn("label", S.label_from_name(F.col("name"))).where("label IS NOT NULL")


@query("order_frames", "SELECT session_id, frame_idx, event_id FROM frames_t")
def _(spark, sf):
    return D.order_frames(fx.frames(spark, sf).select("session_id", "frame_idx", "event_id"), "session_id", "frame_idx")


# ---- user functions --------------------------------------------------------------------------


@query("custom_scorer", "SELECT session_id, frame_idx, ROUND(1/(1 + EXP(-(value - 30)/10)), 6) AS probability FROM frames_t WHERE value > 5")
def _(spark, sf):
    @F.pandas_udf(T.DoubleType())
    def logistic(v: pd.Series) -> pd.Series:
        import numpy as np

        return 1.0 / (1.0 + np.exp(-(v - 30.0) / 10.0))

    out = D.apply_steps(
        fx.frames(spark, sf).select("session_id", "frame_idx", "value"),
        lambda df: df.where("value > 5"),
        lambda df: D.with_score(df, logistic, ["value"], "probability"),
    )
    return rounded(out.drop("value"), "probability")


# ---- telemetry -------------------------------------------------------------------------------

JOINTS = 12


def observations(spark, sf):
    """One 35-value vector per event: quat 4, angular velocity 3, positions, velocities, mode, command."""
    e, v = F.col("event_id"), F.col("value")
    norm = F.sqrt(v * v + F.pow(e % 7, 2) + F.pow(e % 5, 2) + 1.0)
    quat = [v / norm, (e % 7) / norm, (e % 5) / norm, 1.0 / norm]
    ang = [((e * k) % 10).cast("double") for k in (3, 5, 7)]
    pos = [((e * (j + 3)) % 200) / 100.0 - 1.0 for j in range(JOINTS)]
    vel = [((e * (j + 5)) % 300) / 100.0 - 1.5 for j in range(JOINTS)]
    tail = [(e % 3).cast("double"), v / 100.0, F.lit(0.0), F.lit(0.5)]
    return table(spark, sf, "events").select("event_id", F.array(*quat, *ang, *pos, *vel, *tail).alias("obs"))


cte(
    "obs_t",
    f"""SELECT event_id, CAST(j AS INTEGER) AS joint_idx, ((event_id*(j + 3)) % 200)/100.0E0 - 1 AS position, ((event_id*(j + 5)) % 300)/100.0E0 - 1.5E0 AS velocity,
  value/n AS quat_w, (event_id % 7)/n AS quat_x, (event_id % 5)/n AS quat_y, 1/n AS quat_z, CAST(event_id % 3 AS DOUBLE) AS mode, value/100 AS command_x
FROM (SELECT *, SQRT(value*value + POWER(event_id % 7, 2) + POWER(event_id % 5, 2) + 1) AS n FROM events), (SELECT UNNEST(RANGE({JOINTS})) AS j)""",
)
OBS = ["position", "velocity", "quat_w", "quat_x", "quat_y", "quat_z", "mode", "command_x"]


def joints(spark, sf):
    return telemetry.unpack_observation(observations(spark, sf), "obs", JOINTS, ["event_id"])


@query("unpack_observation", f"SELECT event_id, joint_idx, {_r(*OBS)} FROM obs_t")
def _(spark, sf):
    return rounded(joints(spark, sf).select("event_id", "joint_idx", *OBS), *OBS)


@query("projected_gravity", f"""SELECT event_id, {_r('gravity_x', 'gravity_y', 'gravity_z')} FROM (SELECT event_id,
  2*qw*qy - 2*qx*qz AS gravity_x, -2*qw*qx - 2*qy*qz AS gravity_y, -(2*qw*qw - 1) - 2*qz*qz AS gravity_z FROM (
  SELECT event_id, value/n AS qw, (event_id % 7)/n AS qx, (event_id % 5)/n AS qy, 1/n AS qz FROM (
   SELECT *, SQRT(value*value + POWER(event_id % 7, 2) + POWER(event_id % 5, 2) + 1) AS n FROM events)))""")
def _(spark, sf):
    o = F.col("obs")
    q = observations(spark, sf).select("event_id", *[o[i].alias(n) for i, n in enumerate(["w", "x", "y", "z"])])
    g = telemetry.projected_gravity(q, "w", "x", "y", "z").drop("w", "x", "y", "z")
    return rounded(g, "gravity_x", "gravity_y", "gravity_z")


@query("pd_torque_saturation", """SELECT joint_idx, COUNT(*) AS samples, ROUND(AVG(CASE WHEN ABS(t) > lim THEN 1.0E0 ELSE 0 END), 6) AS saturation,
  ROUND(AVG(LEAST(GREATEST(t, -lim), lim)), 6) + 0.0E0 AS mean_torque, ROUND(MAX(ABS(LEAST(GREATEST(t, -lim), lim))), 6) AS peak_torque
FROM (SELECT joint_idx, 4.0E0 + joint_idx AS lim, (20.0E0 + joint_idx)*(CASE WHEN joint_idx < 10 THEN (event_id % 4)/10.0E0 ELSE 0 END - position) - 2.0E0*velocity AS t FROM obs_t)
GROUP BY joint_idx""")
def _(spark, sf):
    j = F.col("id").cast("int")
    config = spark.range(JOINTS).select(
        j.alias("joint_idx"), (20.0 + j).alias("kp"), F.lit(2.0).alias("kd"), (4.0 + j).alias("effort_limit")
    )
    aimed = joints(spark, sf).withColumn("target", F.when(F.col("joint_idx") < 10, (F.col("event_id") % 4) / 10.0))
    out = telemetry.torque_saturation(telemetry.pd_torque(aimed, config), ["joint_idx"])
    return rounded(out, "saturation", "mean_torque", "peak_torque")


@query("clutch_delta", """SELECT session_id, frame_idx, pressed, edge, ROUND(CASE WHEN pressed THEN value - LAST_VALUE(CASE WHEN edge THEN value END IGNORE NULLS) OVER w END, 6) + 0.0E0 AS delta
FROM (SELECT *, pressed AND COALESCE(NOT LAG(pressed) OVER (PARTITION BY session_id ORDER BY frame_idx), FALSE) AS edge
 FROM (SELECT *, event_type IN ('click', 'view') AS pressed FROM frames_t)) WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    log = fx.frames(spark, sf).select("session_id", "frame_idx", "value", "event_type")
    out = telemetry.clutch_delta(log, F.col("event_type").isin("click", "view"), "value")
    return rounded(out.select("session_id", "frame_idx", "pressed", "edge", "delta"), "delta")
