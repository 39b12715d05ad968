"""Queries of the operators on pages, choices, tables on disk and checks; inputs are made of the driver's tables.

The SQL twins work out what is expected from the same tables without the library's patterns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline import schemas
from forkline.functions import text as fx
from forkline.operators import constraints as C
from forkline.operators import relational
from forkline.plans import annotate, convert, diff, markov, pregraph, simulate, summary
from forkline.plans import compile as compiling
from forkline.queries import END, ORACLE_SQL, QUERIES, _SPARSE, one_profile, query, sparse, table
from forkline.session import shared_folder
from forkline.sources import html, tables
from forkline.streaming import extract

__all__ = ["ORACLE_SQL", "QUERIES"]


def rows_of(spark: SparkSession, schema: T.StructType | str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """A SELECT of literal rows."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


# texts of choices
_CHOICES = (
    ("If you have the Kai Discipline of {n}, turn to {k}.", "{n}", False, False, None, None, None),
    ("If you possess a {n} and wish to use it, turn to {k}", "", False, False, "has_item", "{n}", None),
    ("If you do not possess a {n}, turn to {k}", "", True, True, None, None, None),
    ("If you have {k} Gold Crowns, pay here", "", False, False, "gold_crowns_at_least", "{k}", None),
    ("If you have {k} or more ENDURANCE points left", "", False, False, "endurance_at_least", "{k}", None),
    ("If you now have less than {k} points", "", False, True, None, None, None),
    ("If the number is 0–4, turn to {k}", "", False, False, None, None, 5),
    ("If it is 7 or higher, turn to {k}", "", False, False, None, None, 3),
    ("If it is 6 or lower, turn to {k}", "", False, False, None, None, 7),
    ("If you have picked a 3, run", "", False, False, None, None, 1),
    ("Go on to {k}", "", False, False, None, None, None),
)
_FILL = lambda x: "NULL" if x is None else "replace(replace('" + x.replace("'", "''") + "', '{n}', n_name), '{k}', CAST(n_nationkey + 10 AS VARCHAR))"


@query(" UNION ALL ".join(f"SELECT {i} AS form, n_nationkey, {_FILL(d)} AS disciplines, {str(a).lower()} AS kai_fallback, {str(b).lower()} AS state_fallback, {_FILL(k)} AS kind, {_FILL(v)} AS value, {'NULL' if g is None else g}::INT AS digits FROM nation" for i, (_, d, a, b, k, v, g) in enumerate(_CHOICES)))
def q35_choice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the wording of choices says: disciplines, conditions, fallbacks, digits of a draw."""
    forms = rows_of(spark, "form int, pattern string", [(i, c[0]) for i, c in enumerate(_CHOICES)])
    filled = F.replace(F.replace("pattern", F.lit("{n}"), F.col("n_name")), F.lit("{k}"), (F.col("n_nationkey") + 10).cast("string"))
    d = table(spark, sf_dir, "nation").crossJoin(F.broadcast(forms)).withColumn("t", filled)
    t, state = F.col("t"), fx.state_condition(F.col("t"))
    return d.select("form", "n_nationkey", F.array_join(fx.disciplines(t), ",").alias("disciplines"), fx.kai_fallback(t).alias("kai_fallback"), fx.condition_fallback(t).alias("state_fallback"), state["kind"].alias("kind"), state["value"].alias("value"), fx.random_outcomes(t).alias("digits"))


@query("""SELECT o_orderkey, regexp_matches(o_orderpriority, '^[A-Za-z0-9_-]+$') AS identifier, o_totalprice > 0 AS positive, o_totalprice / 400000 <= 1 AND o_totalprice >= 0 AS probability, abs(o_totalprice - 150000) <= 1000 AS near,
least(1.0, greatest(0.0, o_totalprice / 200000)) AS clamped, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus || ' | ' || o_orderpriority END AS note, '"' || o_orderpriority || '\\"x"' AS quoted, o_custkey || '->' || o_orderkey AS edge, 'orders:' || o_orderkey AS ref, true AS own, false AS other FROM orders""")
def q36_scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, status = F.col("o_totalprice"), F.col("o_orderstatus")
    note = fx.joined_note(F.when(status == "F", "").otherwise(status), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fx.is_identifier(F.col("o_orderpriority")).alias("identifier"), fx.is_positive(p).alias("positive"), fx.is_probability(p / 400000).alias("probability"), fx.is_close(p, F.lit(150000.0), 1000.0).alias("near"),
        fx.clamp(p / 200000).alias("clamped"), note.alias("note"), fx.quoted(F.concat("o_orderpriority", F.lit('"x'))).alias("quoted"), fx.edge_key(F.col("o_custkey"), F.col("o_orderkey")).alias("edge"),
        (ref := fx.provenance("orders", F.col("o_orderkey"))).alias("ref"), fx.comes_from(ref, "orders").alias("own"), fx.comes_from(ref, "order").alias("other"),
    )


@query("SELECT CAST(n_nationkey AS VARCHAR) AS source_id, CAST(n_regionkey AS VARCHAR) AS target_id, n_name AS edge_text, 'forced' AS transition_type, '' AS warnings, 0 AS position FROM nation WHERE n_nationkey % 5 <> 4")
def q37_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a model's JSON answers (here a rule that reads the prompt); unreadable answers give none."""

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            asked = json.loads(p.split("<|im_start|>user\n")[1].split("<|im_end|>")[0])
            region, name = asked["text"].split(" ", 1)
            edge = {"source_id": asked["id"], "target_id": region, "edge_text": name, "transition_type": "forced"}
            out.append(json.dumps({"edges": [edge]}) if int(asked["id"]) % 5 != 4 else "no json" if int(asked["id"]) % 2 else "{}")
        return out

    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat_ws(" ", F.col("n_regionkey").cast("string"), "n_name").alias("text"))
    found = annotate.annotate_with(pages, "Read.", model)
    return found.select("source_id", "target_id", "edge_text", "transition_type", "warnings", "position")


# pages of nations: a narrative, maybe a fight, choices to other nations
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    link = lambda to: F.concat(F.lit("<a href='sect"), to.cast("string"), F.lit(".htm'>turn</a>"))
    part = lambda when, *x: F.when(when, F.concat(*x)).otherwise("")
    body = F.concat(
        F.lit("<h3>x</h3><p>You see&nbsp;"), name, F.lit(" &amp; rest.</p>"),
        part(k % 4 == 1, F.lit("<p class='combat'>Wolf: <b>COMBAT SKILL</b> "), (k + 5).cast("string"), F.lit(" ENDURANCE 20</p>")),
        part(k % 5 == 2, F.lit("<p>You lose "), k.cast("string"), F.lit(" ENDURANCE points.</p>")),
        part(k % 5 == 3, F.lit("<p>You gain "), k.cast("string"), F.lit(" ENDURANCE points.</p>")),
        part(k % 6 == 5, F.lit("<p class='deadend'>The end.</p><img src='"), name, F.lit(".png'>")),
        part(k % 6 != 5, F.lit("<p class='choice'>Go "), link(F.col("n_regionkey")), F.lit("</p><p class='choice'>Or <a href='map.htm'>see</a> "), link(k + 1), F.lit("</p>")),
        part(k % 7 == 6, F.lit("<p class='choice'>Nothing here</p>")),
    )
    whole = F.concat(F.when(k == 24, "<div class='other'>").otherwise("<div class='maintext x'>"), body, F.lit("</div><p class='choice'>outside</p>"))
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("page_id"), whole.alias("html"))


_TEXT = """'You see ' || n_name || ' & rest.' || CASE WHEN n_nationkey % 4 = 1 THEN ' Wolf: COMBAT SKILL ' || (n_nationkey + 5) || ' ENDURANCE 20' ELSE '' END || CASE WHEN n_nationkey % 5 = 2 THEN ' You lose ' || n_nationkey || ' ENDURANCE points.' WHEN n_nationkey % 5 = 3 THEN ' You gain ' || n_nationkey || ' ENDURANCE points.' ELSE '' END || CASE WHEN n_nationkey % 6 = 5 THEN ' The end.' ELSE '' END"""


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS source_id, 0 AS position, CAST(n_regionkey AS VARCHAR) AS target_id, 'Go turn' AS edge_text FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey <> 24
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1, CAST(n_nationkey + 1 AS VARCHAR), 'Or see turn' FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey <> 24""")
def q38_page_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.choices(html.parse_pages(pages(spark, sf_dir)))


_HEALTH = "(CASE n_nationkey % 5 WHEN 2 THEN -n_nationkey WHEN 3 THEN n_nationkey ELSE 0 END)"


@query(f"""SELECT CAST(n_nationkey AS VARCHAR) AS node_id, {_TEXT} AS text_content, CASE WHEN {_HEALTH} < 0 THEN 'potential_death' WHEN n_nationkey % 6 = 5 THEN 'death' WHEN n_nationkey % 4 = 1 THEN 'potential_death' WHEN n_nationkey = 16 THEN 'win' ELSE 'none' END AS absorbing_status,
CASE WHEN n_nationkey % 4 = 1 THEN '[{{"name":"Wolf","cs":' || (n_nationkey + 5) || ',"ep":20}}]' END AS enemies, {_HEALTH}::INT AS health_modifier, CASE WHEN n_nationkey % 6 = 5 THEN n_name || '.png' END AS image_refs FROM nation WHERE n_nationkey <> 24""")
def q39_page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.nodes(html.parse_pages(pages(spark, sf_dir)), 16)
    return found.select("node_id", "text_content", "absorbing_status", "enemies", "health_modifier", "image_refs")


@query(f"""SELECT CAST(n_nationkey AS VARCHAR) AS id, {_TEXT} || CASE WHEN n_nationkey % 6 <> 5 THEN ' <choice>Go turn</choice> <choice>Or see turn</choice>' ELSE '' END AS text FROM nation WHERE n_nationkey <> 24""")
def q40_tagged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.tagged_paragraphs(html.parse_pages(pages(spark, sf_dir)))


@query("SELECT '24' AS page_id, 'no main text' AS problem UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'choice without address' FROM nation WHERE n_nationkey % 7 = 6 AND n_nationkey <> 24")
def q41_skipped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.skipped(html.parse_pages(pages(spark, sf_dir)))


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small file in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS page_id, r_name AS title, 5 AS n_pages FROM region""")
def q42_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from files, their ids from the names; other files are left out."""
    folder = shared_folder(spark, "pages")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        put(spark, f"{folder}/sect{r['r_regionkey']}.htm", f"<div class='maintext'><p>{r['r_name']}</p></div>")
    put(spark, f"{folder}/toc.htm", "<p>contents</p>")
    found = html.scan_pages(spark, folder)
    return html.parse_pages(found).crossJoin(F.broadcast(found.agg(F.count("*").alias("n_pages")))).select("page_id", html.narrative().alias("title"), "n_pages")


# tables on disk
_SUPPLIER = T.StructType([T.StructField(n, t) for n, t in (("s_suppkey", T.LongType()), ("s_name", T.StringType()), ("quoted", T.StringType()), ("s_acctbal", T.DoubleType()))])


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(' "a", '), "s_name", F.lit("\n2 "))).when(F.col("s_suppkey") % 3 == 1, "")
    return table(spark, sf_dir, "supplier").withColumn("quoted", quoted)


_CSV = """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN '"a", ' || s_name || chr(10) || '2' ELSE '' END AS quoted, s_acctbal FROM supplier"""


@query(_CSV)
def q43_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with exactly the fields of a layout, read back with its exact header: trimmed, null as empty."""
    path = shared_folder(spark, "csv")
    tables.write_csv(supplier_rows(spark, sf_dir), path, _SUPPLIER.names, [F.col("s_suppkey")])
    return tables.read_csv(spark, path, _SUPPLIER)


@query("SELECT s_suppkey, s_name, s_acctbal > 0 AS positive, 's_suppkey,s_name,s_acctbal' AS header, true AS refused_columns, true AS refused_header FROM supplier")
def q44_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred, lines ended by CR and LF; extra columns and other headers are refused."""
    path, d = shared_folder(spark, "csv"), table(spark, sf_dir, "supplier")
    fields = ["s_suppkey", "s_name", "s_acctbal"]

    def refused(f) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    extra = refused(lambda: tables.write_csv(d, path, fields, strict=True))
    tables.write_csv(d.select(fields), path, fields, line="\r\n", strict=True)
    other = refused(lambda: tables.read_csv(spark, path, _SUPPLIER))
    found = tables.infer_csv(spark, path)
    return found.select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("positive"), F.lit(",".join(tables.header(spark, path))).alias("header"), F.lit(extra).alias("refused_columns"), F.lit(other).alias("refused_header"))


@query("SELECT conv_id AS id, turn, role, length(text)::INT AS n_chars FROM conversations")
def q45_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a nested list, written as JSON, read with a layout and flattened."""
    path = shared_folder(spark, "json")
    nested = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("edges"))
    tables.write_json(nested.select("id", F.struct("edges").alias("output")), path)
    layout = T.StructType.fromDDL("id long, output struct<edges: array<struct<turn: long, role: string, text: string>>>")
    flat = tables.nested_edges(tables.read_json(spark, path, layout, lines=True)).select("id", "turn", "role", F.length("text").alias("n_chars"))
    tables.write_csv(flat, f"{path}-flat", flat.columns)
    return tables.read_csv(spark, f"{path}-flat", flat.schema)


@query("SELECT n_nationkey, n_name, n_regionkey, 25 AS n_rows, true AS reported FROM nation")
def q46_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as one indented array and a report as one object, both read back."""
    path, d = shared_folder(spark, "documents"), table(spark, sf_dir, "nation")
    tables.write_json_array(d.select("n_name", "n_nationkey", "n_regionkey"), f"{path}/array", ["n_nationkey"])
    tables.write_report(d.agg(F.count("*").cast("int").alias("n_rows"), F.lit(None).cast("string").alias("none")), f"{path}/report")
    report = tables.read_json(spark, f"{path}/report", T.StructType.fromDDL("n_rows int, none string"))
    return tables.read_json(spark, f"{path}/array", d.schema).crossJoin(F.broadcast(report)).select("n_nationkey", "n_name", "n_regionkey", "n_rows", F.col("none").isNull().alias("reported"))


@query("SELECT n_regionkey, n_name, 1 AS folders, true AS created, true AS kept, true AS refused FROM nation WHERE n_regionkey = 2")
def q47_folders_and_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per key, of which one is read; a template made once, kept, and refused with another header."""
    path = shared_folder(spark, "folders")
    tables.write_by_profile(table(spark, sf_dir, "nation"), tables.book_path(path + "/{book}", "by"), "n_regionkey")
    made, again, refused = tables.create_template(spark, f"{path}/t", schemas.SUPERVISION), tables.create_template(spark, f"{path}/t", schemas.SUPERVISION), False
    try:
        tables.create_template(spark, f"{path}/t", schemas.REVIEW)
    except ValueError:
        refused = True
    one = spark.read.parquet(f"{path}/by").where("n_regionkey = 2")
    folders = F.count_distinct(F.regexp_extract(F.col("_metadata.file_path"), "n_regionkey=([0-9]+)", 1)).alias("folders")
    return one.select("n_regionkey", "n_name").crossJoin(F.broadcast(one.agg(folders))).select("n_regionkey", "n_name", F.col("folders").cast("int").alias("folders"), F.lit(made).alias("created"), F.lit(not again).alias("kept"), F.lit(refused).alias("refused"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS line FROM orders")
def q48_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of a file of several partitions, in its order."""
    markov.checkpoint_folder(spark)
    ordered = table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").checkpoint()
    return tables.with_line(ordered)


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def q49_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and type of an event stream, the whole result kept up to date."""
    path = shared_folder(spark, "stream")
    layout = table(spark, sf_dir, "events").schema
    # the table is a file, or a folder of files, of the driver's folder
    stream = spark.readStream.schema(layout).parquet(f"{sf_dir}/events.parque[t]")
    keep = lambda d, n: d.write.mode("overwrite").parquet(f"{path}/out")
    extract.event_shares(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("v", 4).alias("v"))


# checks: one fault for each remainder of a nation's key
_FAULTS = (
    ("weight_rule", "guess", ("unknown weight rule",)),
    ("weight_value", "", ("constant without a value alone",)),
    ("weight_value", "1.2", ("constant outside 0..1",)),
    ("weight_value", "half", ("constant outside 0..1",)),
    ("weight_expression", "combat_win(1)", ("constant without a value alone",)),
    ("transition_kind", "complex", ("unknown transition kind",)),
    ("transition_kind", "manual", ()),
    ("condition_kind", "has_item", ("condition kind and value not together",)),
    ("weight_rule", "profile_choice", ("choice with a value or expression", "choice without its axes")),
    ("weight_rule", "formula", ("formula without an expression alone",)),
)


@query(" UNION ALL ".join(f"""SELECT '{name}' AS "check", n_nationkey || '->' || n_regionkey AS key FROM nation WHERE n_nationkey % {len(_FAULTS)} = {i}""" for i, (_, _, names) in enumerate(_FAULTS) for name in names))
def q50_edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.col("n_nationkey") % len(_FAULTS)
    plain = {"weight_rule": "constant", "weight_value": "0.5", "transition_kind": "forced"}

    def cell(c: str) -> Column:
        out = F.lit(plain.get(c, ""))
        for i, (where, what, _) in enumerate(_FAULTS):
            out = F.when(fault == i, F.lit(what)).otherwise(out) if where == c else out
        return out

    d = table(spark, sf_dir, "nation")
    edges = d.select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_regionkey").cast("string").alias("target_id"), *(cell(c).alias(c) for c in schemas.SUPERVISION.names[2:]))
    return C.edge_rules(edges).select("check", "key")


_PROFILE_ROWS = [("a_1", "cautious", "noble", "tactical"), ("a_1", "neutral", "noble", "physical"), ("b 2", "neutral", "neutral", "neutral"), ("c", "brave", "neutral", "neutral")]


@query(values([("profile twice", "a_1"), ("profile outside the design", "b 2"), ("profile outside the design", "c"), ("no profile", ""), ("profile keys", "risk"), ("profile keys", "courage"), ("not a probability", "escape_probability"), ("not a positive number", "opposed"), ("settings keys", "luck")], '"check", key'))
def q51_profiles_and_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of designed tables: repeated, odd or no profiles, other keys, values out of range."""
    good = rows_of(spark, schemas.PROFILES, _PROFILE_ROWS)
    keys = C.keys(good.withColumnRenamed("risk", "courage"), schemas.PROFILES.names, "profile keys")
    settings = rows_of(spark, schemas.SETTINGS, [(0.5, 0.8, 1.5, 0.0, (2.0, 1.0, 0.0))]).withColumn("luck", F.lit(1))
    return C.all_of(C.profiles(good), C.profiles(good.limit(0)), keys, C.settings(settings)).select("check", "key")


@query(f"""WITH w AS ({_SPARSE}) SELECT 'largest_error' AS metric, '' AS key, max(abs(s - 1)) < 1e-12 AS holds FROM (SELECT sum(w) AS s FROM w GROUP BY source_id)
UNION ALL SELECT 'outgoing weights don''t sum to one', 'all:' || source_id, true FROM w GROUP BY source_id HAVING abs(sum(CASE WHEN target_id = 'click' THEN w / 2 ELSE w END) - 1) > 1e-9
UNION ALL SELECT 'another node absorbs', 'all:purchase', true UNION ALL SELECT 'outcome without a row', 'all:Death', true UNION ALL SELECT 'target without a row', 'all:view', true UNION ALL SELECT 'weight not finite', 'all:click->view', true""")
def q52_matrix_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of rows, absorbing nodes and the shape of a transition matrix."""
    w = one_profile(sparse(spark, sf_dir))
    halved = w.withColumn("w", F.when(F.col("target_id") == "click", F.col("w") / 2).otherwise(F.col("w")))
    broken = w.where("source_id <> 'view'").withColumn("w", F.when((F.col("source_id") == "click") & (F.col("target_id") == "view"), float("inf")).otherwise(F.col("w")))
    found = C.all_of(C.row_sums(halved), C.absorbing(w, ("error", "win")), C.matrix(w, (*END, "Death")), C.matrix(broken, END), C.row_sums(w))
    error = C.largest_error(w).select(F.lit("largest_error").alias("metric"), F.lit("").alias("key"), (F.col("error") < 1e-12).alias("holds"))
    return error.unionAll(found.select(F.col("check").alias("metric"), "key", F.lit(True).alias("holds")))


@query("""SELECT detail, count(*) AS n FROM (SELECT l_orderkey, l_partkey, 'first only' AS detail FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5 EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09)
UNION ALL SELECT l_orderkey, l_partkey, 'second only' FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09 EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5)) GROUP BY 1""")
def q53_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    pair = ["l_orderkey", "l_partkey"]
    return C.same_rows(l.where("l_quantity > 5").select(pair), l.where("l_discount < 0.09").select(pair), "pairs").groupBy("detail").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), b AS (SELECT c_custkey AS k, c_name AS y, 1 AS place FROM customer)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.place, b.place)::INT AS place, x, y FROM a FULL JOIN b ON a.k = b.k AND a.place = b.place""")
def q54_zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("y"))
    return relational.zip_rows(o, c, ["k"], ["x"], ["y"])


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name || coalesce(string_agg(' <choice>' || n_name || '</choice>', '' ORDER BY n_nationkey), '') AS text FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3 GROUP BY r_regionkey, r_name""")
def q55_tagged_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("node_id"), F.col("r_name").alias("text_content"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("source_id"), F.col("n_name").alias("edge_text"), F.col("n_nationkey").alias("position"))
    return relational.tagged_from_tables(nodes, edges, ["0", "1", "2", "4"])


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both""")
def q56_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return relational.set_counts(l.where("l_quantity > 5"), l.where("l_discount < 0.09"), ["l_orderkey", "l_partkey"])


# conversion: every row of the decision table
_SOURCES = (
    ("1", "", [("forced", "")], [("constant", "1", "")], None),
    ("2", "", [("explicit_choice", ""), ("explicit_choice", "")], [("profile_choice", "", "")] * 2, None),
    ("3", "", [("stochastic", "0-4"), ("stochastic", "5 or higher")], [("constant", "0.5", "")] * 2, None),
    ("4", "", [("stochastic", "0-4"), ("stochastic", "6 or higher")], [], "unsupported_random_rule: random branches cover 9/10 outcomes"),
    ("5", "", [("conditional", "If you have the Discipline of Sixth Sense"), ("conditional", "If you do not")], [("formula", "", 'kai_available("Sixth Sense")'), ("formula", "", '1 - kai_available("Sixth Sense")')], None),
    ("6", "", [("conditional", "If you possess a rope"), ("explicit_choice", "")], [("formula", "", 'condition_available("has_item", "rope")'), ("formula", "", '1 - condition_available("has_item", "rope")')], None),
    ("7", "[]", [("forced", "")], [("formula", "", "combat_win(7)"), ("formula", "", "1 - combat_win(7)")], None),
    ("8", "[]", [("stochastic", "0-6"), ("stochastic", "7 or higher")], [("formula", "", "combat_win(8) * 0.7"), ("formula", "", "combat_win(8) * 0.3"), ("formula", "", "1 - combat_win(8)")], None),
    ("9", "[]", [("conditional", "If you win within 4 rounds"), ("conditional", "else")], [], "combat_outcome_depends_on_duration"),
    ("10", "[]", [("explicit_choice", ""), ("forced", "")], [], "combat_with_escape_or_postcombat_choice"),
    ("11", "", [("forced", ""), ("forced", "")], [], "unsupported_transition_combination: ['forced']"),
    ("12", "", [("conditional", "If you have the Discipline of Healing"), ("conditional", "If you have the Discipline of Tracking")], [], "multiple_kai_disciplines"),
    ("13", "", [("conditional", "If you possess a rope"), ("conditional", "If you have 5 Gold Crowns")], [], "multiple_or_unrecognized_state_conditions"),
    ("14", "", [("conditional", "If you have the Discipline of Hunting"), ("explicit_choice", ""), ("explicit_choice", "")], [("formula", "", 'kai_available("Hunting")'), *[("formula", "", f'(1 - kai_available("Hunting")) * choice_share(14, n{k})') for k in (1, 2)]], None),
)


def converted(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(annotated edges, nodes, automatic edges, review queue) of the sources above and two endings."""
    axis = lambda kind: "neutral" if kind == "explicit_choice" else ""
    rows = [(s, f"n{i}", "x", kind, rule, *[axis(kind)] * 3, "", i) for s, _, edges, _, _ in _SOURCES for i, (kind, rule) in enumerate(edges)]
    edges = rows_of(spark, ", ".join(f"{n} string" for n in schemas.EDGES.names) + ", position int", rows)
    nodes = rows_of(spark, "node_id string, text_content string, absorbing_status string, enemies string", [(s, "t", "none", e) for s, e, *_ in _SOURCES] + [("20", "t", "Death", ""), ("21", "t", "win", "")])
    auto, review = convert.convert(edges, nodes)
    return edges, nodes, auto, review


@query(values([(s, r, v, e) for s, _, _, out, _ in _SOURCES for r, v, e in out] + [("20", "constant", "1", ""), ("21", "constant", "1", "")], "source_id, weight_rule, weight_value, weight_expression"))
def q57_converted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(spark)[2].select("source_id", "weight_rule", "weight_value", "weight_expression")


@query(values([(s, r, len(e)) for s, _, e, _, r in _SOURCES if r], "source_id, review_reason, n_edges"))
def q58_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tables.decode("phase1_edges_json", T.ArrayType(schemas.EDGES))
    return converted(spark)[3].select("source_id", "review_reason", F.size(packed).alias("n_edges"))


@query(values([(f"e{i:04d}", s, t, o) for i, (s, t, o) in enumerate([("1", "n0", "auto"), ("4", "n0", "supervised"), ("4", "n1", "supervised"), ("20", "Death", "auto"), ("21", "Win", "auto")], 1)], "edge_id, source_id, target_id, origin"))
def q59_pregraph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both origins in one numbering, by numeric source."""
    auto = converted(spark)[2].where("source_id in ('1', '20', '21')")
    hand = rows_of(spark, ", ".join(f"{n} string" for n in schemas.SUPERVISION.names) + ", line int", [("4", f"n{i}", "random", "constant", "0.5", *[""] * 6, "why", i + 2) for i in range(2)])
    return pregraph.merge(auto, hand).select("edge_id", "source_id", "target_id", "origin")


_BROKEN = [("review without supervision", "5"), ("supervision without review", "9"), ("source both converted and reviewed", "5"), ("source not converted", "3"), ("reference not traced once", "edges:2"), ("reference not traced once", "edges:4"), ("reference not traced once", "edges:5"), ("supervised edge without a note", "e3"), ("node without a way out", "8"), ("source reviewed twice", "4"), ("constants don't sum to one", "6"), ("ending not linked to its outcome alone", "6"), ("unknown source", "99"), ("unknown target", "98"), ("edges lost or added", "phase1_edges")]


@query(values(_BROKEN, '"check", key'))
def q60_pregraph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged pregraph with one fault of each kind."""
    nodes = rows_of(spark, schemas.PREGRAPH_NODES, [(n, "narrative", "", "false", "") for n in ("1", "2", "3", "4", "5", "8")] + [("6", "preterminal", "death", "false", ""), ("Death", "terminal", "death", "true", ""), ("Win", "terminal", "win", "true", "")])
    edge = lambda i, s, t, rule, value, origin, ref, note="n": (i, s, t, "forced", rule, value, "" if rule != "formula" else "combat_win(1)", "", "", *["neutral"] * 3, origin, ref, note)
    edges = rows_of(spark, schemas.PREGRAPH_EDGES, [edge("e1", "1", "2", "constant", "1", "auto", "edges:1"), edge("e2", "2", "98", "formula", "", "auto", "edges:2"), edge("e2b", "2", "1", "formula", "", "auto", "edges:2"), edge("e3", "4", "5", "formula", "", "supervised", "supervision:2", ""), edge("e4", "5", "6", "constant", "1", "auto", "edges:5"), edge("e5", "6", "Win", "constant", "0.9", "auto", "nodes:6"), edge("e6", "99", "1", "formula", "", "supervised", "supervision:3"), edge("e7", "3", "1", "formula", "", "supervised", "supervision:4")])
    phase1 = rows_of(spark, "source_id string, source_ref string", [("1", "edges:1"), ("2", "edges:2"), ("3", "edges:4"), ("4", "edges:3"), ("5", "edges:5")])
    review = rows_of(spark, schemas.REVIEW, [(s, "r", "t", "[]") for s in ("4", "4", "5")])
    hand = rows_of(spark, "source_id string", [("4",), ("9",)])
    return pregraph.checks(nodes, edges, phase1, review, hand).select("check", "key")


@query("""SELECT 'nodes' AS metric, count(*) AS value FROM (SELECT n_name AS n FROM nation UNION SELECT r_name FROM region) UNION ALL SELECT 'death', count(*) FILTER (n_nationkey % 5 = 0) FROM nation UNION ALL SELECT 'none', count(*) FILTER (n_nationkey % 5 <> 0) FROM nation
UNION ALL SELECT 'targets', count(*) FROM (SELECT n_name FROM nation UNION SELECT r_name FROM region) UNION ALL SELECT 'unreachable', (SELECT count(*) FROM (SELECT n_name AS n FROM nation UNION SELECT r_name FROM region)) - 1 - (SELECT count(*) FROM nation WHERE n_regionkey = 1)""")
def q61_nodes_and_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(F.col("r_name").alias("source_id"), F.col("n_name").alias("target_id"))
    nodes, start = relational.unique_nodes(edges), r.where("r_regionkey = 1").select(F.col("r_name").alias("node_id"))
    one = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    endings = diff.ending_counts(n.select(F.when(F.col("n_nationkey") % 5 == 0, "death").otherwise("none").alias("absorbing_status")))
    targets = one(C.union_keys((n, "n_name"), (r, "r_name"), (n, "n_name")), "targets")
    return one(nodes, "nodes").unionAll(targets).unionAll(endings.select(F.col("absorbing_status").alias("metric"), F.col("n").alias("value"))).unionAll(one(markov.unreachable(spark, edges, start, nodes), "unreachable"))


@query(values([("duplicate pair", "1->2", "2"), ("source outside the corpus", "9", ""), ("target outside the corpus", "77", ""), ("edges differ from choices", "1", "3/2"), ("edges differ from choices", "2", "0/1"), ("edges differ from choices", "4", "2/1"), ("no way out", "2", "?"), ("no way out", "3", "win"), ("value does not fit the type", "1->77", ""), ("axes do not fit the type", "4->1", ""), ("only choice not forced", "4->1", ""), ("never a target", "4", "")], '"check", key, detail'))
def q62_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction with one fault of each kind."""
    rows = [("1", "2", "explicit_choice", "", "neutral"), ("1", "2", "explicit_choice", "", "neutral"), ("1", "77", "conditional", "", ""), ("4", "1", "explicit_choice", "", ""), ("4", "3", "forced", "", ""), ("9", "1", "forced", "", "")]
    edges = rows_of(spark, schemas.EDGES, [(s, t, "x", k, v, a, a, a, "") for s, t, k, v, a in rows])
    tag = " <choice>x</choice>"
    paragraphs = rows_of(spark, schemas.PARAGRAPHS, [("1", "t" + 2 * tag), ("2", "t" + tag), ("3", "t"), ("4", "t" + tag)])
    nodes = rows_of(spark, "node_id string, absorbing_status string", [("1", "none"), ("3", "win"), ("4", "none")])
    return diff.quality_report(edges, paragraphs, nodes)


@query("""WITH p AS (SELECT n_nationkey AS ord, n_name AS profile_id, n_regionkey / 10.0 + 0.1 AS win, n_nationkey + 1.0 AS steps FROM nation), n AS (SELECT win AS w0, steps AS s0 FROM p WHERE profile_id = (SELECT n_name FROM nation WHERE n_nationkey = 7))
SELECT 'summary' AS kind, profile_id, round(win, 9) AS win, round(win - w0, 9) AS delta_win, round(steps - s0, 9) AS delta_steps FROM p, n
UNION ALL SELECT 'least', arg_min(profile_id, (win, ord)), round(min(win), 9), round(max(win) - min(win), 9), count(*) FROM p UNION ALL SELECT 'most', arg_max(profile_id, (win, -ord)), round(max(win), 9), round(max(win) - min(win), 9), count(*) FROM p""")
def q63_profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles against a neutral one, and the manifest of the extremes; the first of equals."""
    n = table(spark, sf_dir, "nation")
    win = F.col("n_regionkey") / 10 + 0.1
    solved = n.select(F.col("n_name").alias("profile_id"), F.lit("1").alias("node_id"), (1 - win).alias("p_death"), win.alias("p_win"), (F.col("n_nationkey") + 1.0).alias("expected_steps"))
    profiles = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("profile_id"), *(F.lit("neutral").alias(a) for a in schemas.LEVELS))
    neutral = n.where("n_nationkey = 7").first()["n_name"]
    done = summary.profile_summary(solved.unionByName(solved.withColumn("node_id", F.lit("2"))), profiles, neutral=neutral)
    own = done.select(F.lit("summary").alias("kind"), "profile_id", F.round("win_probability", 9).alias("win"), F.round("delta_win_vs_neutral", 9).alias("delta_win"), F.round("delta_steps_vs_neutral", 9).alias("delta_steps"))
    m = summary.manifest(done)
    end = lambda kind, low: m.select(F.lit(kind), f"{low}_win_profile", F.round(f"{low}_win_probability", 9), F.round("win_probability_range", 9), F.col("profile_count").cast("double"))
    return own.unionAll(end("least", "min")).unionAll(end("most", "max"))


@query(values([("fight without a continuation", "2"), ("no way out has weight", "3"), ("not a digit", "10"), ("chances don't sum to one", "p:4")], '"check", key'))
def q64_simulation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would stop a simulation or a summary, as rows."""
    edges = rows_of(spark, "source_id string, target_id string, compiled_weight double, condition_kind string, condition_value string", [("1", "2", 1.0, "", ""), ("2", "Death", 0.5, "combat_outcome", "death"), ("2", "1", 0.5, "combat_outcome", "escape"), ("3", "1", 0.0, "", ""), ("4", "Win", 0.9, "combat_outcome", "survive")])
    solved = rows_of(spark, "profile_id string, node_id string, p_death double, p_win double", [("p", "1", 0.25, 0.75), ("p", "4", 0.25, 0.5)])
    return C.all_of(C.continuations(edges, rows_of(spark, "node_id string", [("2",), ("4",)])), C.digits(spark.range(11), "id"), C.absorption(solved)).select("check", "key")


@query("SELECT * FROM (VALUES ('share of deaths', true), ('share of escapes', true), ('first endurance', true), ('second endurance lower', true), ('fresh losses fewer', true)) v(metric, agrees)")
def q65_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated readings against what the rules imply: one fight in ten thousand runs, with an escape of 0.3."""
    creation = {"combat_skill_base": 10, "endurance_base": 20, "random_values": list(range(10)), "disciplines_chosen": 5, "disciplines": ["Healing", "Mindblast", "Weaponskill", *"abcdefg"], "starting_weapons": ["Axe"], "weaponskill_table": {str(i): "Axe" for i in range(10)}, "equipment_table": {str(i): {"endurance_bonus": 2 * (i == 9)} for i in range(10)}}
    config = {"seed": 5, "simulations": 10_000, "max_steps": 50, "character_creation": creation, "combat_rules": {"mindblast_bonus": 2, "weaponskill_bonus": 2, "healing_potion_points": 4, "healing_potion_use_threshold": 4}}
    rows = [("1", "2", 1.0, "", ""), ("2", "3", 0.6, "combat_outcome", "survive"), ("2", "Death", 0.1, "combat_outcome", "death"), ("2", "Win", 0.3, "combat_outcome", "escape"), ("3", "Win", 0.5, "combat_outcome", "survive"), ("3", "Death", 0.5, "combat_outcome", "death")]
    edges = rows_of(spark, "source_id string, target_id string, compiled_weight double, condition_kind string, condition_value string", rows)
    found = simulate.encounters(spark, edges, {"2": [(16, 14)], "3": [(16, 14)]}, config, 0.5)
    rates = simulate.rates(found, "ordinal")
    # mean endurance of a new character: 20, a digit, and 2 in one of ten finds
    first = F.abs(F.max(F.when(F.col("ordinal") == 1, F.col("mean_starting_endurance"))) - 24.7) < 0.2
    second = F.max(F.when(F.col("ordinal") == 2, F.col("mean_starting_endurance"))) < F.max(F.when(F.col("ordinal") == 1, F.col("mean_starting_endurance")))
    sane = F.bool_and(F.col("loss_probability").between(F.col("ci95_low"), F.col("ci95_high")))
    by = rates.agg(sane.alias("share of deaths"), first.alias("first endurance"), second.alias("second endurance lower"))
    pooled = simulate.calibration(found).select((F.abs(F.col("escaped") / 10_000 - 0.3) < 0.023).alias("share of escapes"), (F.col("fresh_losses") <= F.col("losses")).alias("fresh losses fewer"))
    names = ["share of deaths", "share of escapes", "first endurance", "second endurance lower", "fresh losses fewer"]
    return by.crossJoin(pooled).unpivot([], [F.col(f"`{n}`") for n in names], "metric", "agrees")


@query("""WITH RECURSIVE e AS (SELECT source_id, target_id, w FROM (""" + _SPARSE + """) WHERE source_id NOT IN ('error', 'purchase')),
m(step, state, mass) AS (SELECT 0, 'signup', CAST(1.0 AS DOUBLE) UNION ALL SELECT step + 1, target_id, sum(mass * w) FROM m JOIN e ON m.state = e.source_id WHERE step < 200 GROUP BY step, target_id),
v AS (SELECT state AS node_id, sum(mass) AS visits FROM m GROUP BY 1) SELECT node_id, round(visits, 7) AS visits, round(sum(visits * w), 7) AS outflow, round(sum(-w * log2(w)) * visits, 7) AS entropy FROM v JOIN e ON node_id = source_id GROUP BY node_id, visits""")
def q66_visits_and_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected visits, flow over outgoing edges and weighted entropy of every node of the event graph."""
    rename = lambda c: F.when(F.col(c) == "error", "Death").when(F.col(c) == "purchase", "Win").otherwise(F.col(c)).alias(c)
    w = one_profile(sparse(spark, sf_dir)).select("profile_id", rename("source_id"), rename("target_id"), "w").where("source_id NOT IN ('Death', 'Win')")
    visits = markov.fundamental(w, "signup").select("profile_id", "node_id", "expected_visits")
    flow = markov.edge_flow(w, visits).groupBy(F.col("source_id").alias("node_id")).agg(F.sum("flow").alias("outflow"))
    entropy = markov.local_entropy(w).select(F.col("source_id").alias("node_id"), "entropy")
    return visits.join(flow, "node_id").join(entropy, "node_id").select("node_id", F.round("expected_visits", 7).alias("visits"), F.round("outflow", 7).alias("outflow"), F.round(F.col("entropy") * F.col("expected_visits"), 7).alias("entropy"))


@query(f"""WITH RECURSIVE e AS (SELECT source_id, target_id, w FROM ({_SPARSE}) WHERE source_id NOT IN ('error', 'purchase')),
m(step, state, mass) AS (SELECT 0, 'signup', CAST(1.0 AS DOUBLE) UNION ALL SELECT step + 1, target_id, sum(mass * w) FROM m JOIN e ON m.state = e.source_id WHERE step < 200 GROUP BY step, target_id)
SELECT state, round(sum(mass), 8) AS mass FROM m WHERE state IN ('error', 'purchase') GROUP BY 1""")
def q67_propagated_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chances of the endings by joins alone, for graphs beyond one task."""
    return markov.propagate(spark, one_profile(sparse(spark, sf_dir)), "signup", END).select("state", F.round("mass", 8).alias("mass"))


@query(values([("1", "forced", ""), ("2", "stochastic", ""), ("2", "stochastic", ""), ("3", "conditional", ""), ("3", "conditional", ""), ("4", "explicit_choice", "neutral"), ("4", "explicit_choice", "neutral")], "source_id, transition_type, semantic_risk"))
def q68_annotated_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule annotator on one source of each type."""
    rows = [("1", 0, "2", "Turn to 2"), ("2", 0, "3", "If it is 0-4"), ("2", 1, "4", "If it is 5-9"), ("3", 0, "5", "If you have the Discipline of Healing"), ("3", 1, "6", "If you do not"), ("4", 0, "7", "Left"), ("4", 1, "8", "Right")]
    nodes = rows_of(spark, "node_id string, text_content string", [(s, "Use the Random Number Table." if s == "2" else "t") for s in "1234"])
    return annotate.rule_annotator(rows_of(spark, "source_id string, position int, target_id string, edge_text string", rows), nodes).select("source_id", "transition_type", "semantic_risk")


@query("""SELECT o_orderpriority AS profile_id, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def q69_selected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by a list of ids that is read from a file."""
    path = shared_folder(spark, "profiles")
    put(spark, f"{path}/p.json", json.dumps([{"profile_id": p} for p in ("5-LOW", "1-URGENT")]))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("profile_id")).agg(F.count("*").alias("n"))
    return tables.select_profiles(d, tables.load_profile_ids(spark, f"{path}/p.json"))


@query("""SELECT 'edge' AS kind, CAST(n_nationkey AS VARCHAR) AS a, CAST(n_regionkey AS VARCHAR) AS b, 'Go turn' AS text FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey <> 24 UNION ALL SELECT 'edge', CAST(n_nationkey AS VARCHAR), CAST(n_nationkey + 1 AS VARCHAR), 'Or see turn' FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey <> 24
UNION ALL SELECT 'node', CAST(n_nationkey AS VARCHAR), '', """ + _TEXT + """ FROM nation WHERE n_nationkey <> 24""")
def q70_simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a bare graph."""
    nodes, edges = html.simple_graph(html.parse_pages(pages(spark, sf_dir)))
    return edges.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edge_text").alias("text")).unionAll(nodes.select(F.lit("node"), "node_id", F.lit(""), "text_content"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, 'pending' AS state FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'no list of edges' FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0""")
def q71_resumed_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a broken-off run still has to ask, and the stored answers that can't be read."""
    n = table(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey").cast("string"))
    stored = n.where("n_regionkey = 2").select("id", F.when(F.col("n_nationkey") % 2 == 0, "broken {").otherwise('{"edges": []}').alias("answer"))
    left = annotate.pending(n.select("id", F.col("n_name").alias("text")), stored)
    return left.select("id", F.lit("pending").alias("state")).unionAll(annotate.quarantine(stored).select("id", "error"))
