"""Source and sink queries: tables written by Spark into the shared folder, then read back.

Each run writes into a fresh sub-folder of ``spark.checkpoint.dir`` (the
cluster's shared folder), so nothing depends on a machine-local path and no
folder is ever cleared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silverline.operators import catalog as C
from silverline.plans.fixtures import derived, read_table
from silverline.plans.registry import register
from silverline.session import shared_dir
from silverline.sources import readers as RD
from silverline.sources.sinks import write_dataset


def _fresh(spark, name: str) -> str:
    return shared_dir(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


@register("csv_roundtrip_customer", ["SRC1"], """
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer""")
def q_csv(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    path = _fresh(spark, "csv")
    cust.write.option("header", True).csv(path)
    return RD.read_csv(spark, path, schema=cust.schema)


@register("json_roundtrip_events_flattened", ["SRC2", "SRC3"], """
select event_id, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as propsk from events""")
def q_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    nested = ev.select("event_id", "user_id", "event_type", "value",
                       F.from_json("props", "k bigint").alias("props"))
    path = _fresh(spark, "json")
    nested.write.json(path)
    return RD.read_json_flat(spark, path).select("event_id", "user_id", "event_type", "value", "propsk")


@register("whole_text_documents_by_source", ["SRC5"], """
select source, cast(sum(length(text) + 1) as bigint) as chars from documents group by source""")
def q_whole_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    path = _fresh(spark, "text")
    docs.select("source", "text").write.partitionBy("source").text(path)
    files = RD.read_whole_text(spark, path)
    return files.select(F.regexp_extract("_source_file", "source=([^/]+)/", 1).alias("source"),
                        F.length("content").alias("n")).groupBy("source").agg(F.sum("n").alias("chars"))


@register("ingest_directory_mixed", ["SRC6", "SRC4"], """
select 'csv' as source_type, count(*) as rows, cast(sum(length(c_name)) as bigint) as chars from customer
union all select 'json', count(*), cast(sum(length(s_name)) as bigint) from supplier
union all select 'parquet', count(*), cast(sum(length(n_name)) as bigint) from nation
union all select 'txt', null, cast(sum(length(text) + 1) as bigint) from documents""")
def q_ingest(spark, sf_dir):
    root = _fresh(spark, "ingest")
    read_table(spark, sf_dir, "customer").write.option("header", True).csv(f"{root}/a")
    read_table(spark, sf_dir, "supplier").write.json(f"{root}/b")
    read_table(spark, sf_dir, "nation").write.parquet(f"{root}/c")
    read_table(spark, sf_dir, "documents").select("text").write.text(f"{root}/d")
    frames, _errors = RD.ingest_files(spark, root)
    parts = [
        frames["csv"].select(F.lit("csv").alias("source_type"), F.length("c_name").alias("n")),
        frames["json"].select(F.lit("json").alias("source_type"), F.length("s_name").alias("n")),
        frames["parquet"].select(F.lit("parquet").alias("source_type"), F.length("n_name").alias("n")),
    ]
    tab = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").cast("bigint").alias("chars"))
    txt = frames["txt"].agg(F.sum(F.length("content")).cast("bigint").alias("chars")).select(
        F.lit("txt").alias("source_type"), F.lit(None).cast("bigint").alias("rows"), "chars")
    return tab.unionByName(txt)


def _rename_text(spark, path: str, ext: str) -> None:
    """Give text files that Spark wrote another extension."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files, names = fs.listFiles(where(path), True), []
    while files.hasNext():
        names.append(files.next().getPath().toString())
    for name in names:
        if name.endswith(".txt"):
            fs.rename(where(name), where(name.removesuffix(".txt") + ext))


_BROKEN = "case when n_nationkey % 2 = 0 then concat('N', n_nationkey) else concat('N', n_nationkey, ',1,2,3,', n_name) end"


@register("ingest_mixed_schemas", ["SRC6", "SRC2", "SRC4", "SET1"], f"""
select 'csv' as kind, c_custkey as key, c_name as name, c_acctbal as amount, case when c_custkey % 3 = 1 then c_mktsegment end as extra from customer
union all select 'csv', 1000000000 + n_nationkey, n_name, n_regionkey + 0.5, null from nation
union all select 'json', s_suppkey, s_name, s_acctbal, case when s_suppkey % 2 = 1 then cast(s_nationkey as varchar) end from supplier
union all select 'parquet', p_partkey, p_name, p_retailprice, case when p_partkey % 2 = 1 then cast(p_size as varchar) else p_brand end from part
union all select 'error', null, {_BROKEN}, null, 'malformed record' from nation""")
def q_ingest_mixed(spark, sf_dir):
    """Files of one directory with columns in different orders, extra columns, two types, JSON arrays and broken rows."""
    root = _fresh(spark, "mixed")
    customer, supplier, part = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    for i, cols in enumerate((["c_custkey", "c_name", "c_acctbal"], ["c_acctbal", "c_mktsegment", "c_custkey", "c_name"], ["c_name", "c_acctbal", "c_custkey"])):
        customer.where(F.pmod("c_custkey", F.lit(3)) == i).select(cols).write.option("header", True).csv(f"{root}/customer[{i}]")
    nation = read_table(spark, sf_dir, "nation")  # a file each: header, a good row, a broken one
    good = F.concat_ws(",", F.lit(1_000_000_000) + F.col("n_nationkey"), "n_name", F.col("n_regionkey") + F.lit(0.5))
    nation.select(F.concat_ws("\n", F.lit("c_custkey,c_name,c_acctbal"), good, F.expr(_BROKEN)).alias("value"), "n_nationkey") \
        .write.partitionBy("n_nationkey").text(f"{root}/nation bad")
    _rename_text(spark, f"{root}/nation bad", ".csv")
    supplier.where("s_suppkey % 2 = 0").select("s_acctbal", "s_name", "s_suppkey").write.json(f"{root}/lines")
    rows = supplier.where("s_suppkey % 2 = 1").withColumn("block", F.expr("s_suppkey div 2000"))  # arrays of 1,000 at most
    arrays = rows.groupBy("block").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").alias("extra")))).alias("value"))
    arrays.write.partitionBy("block").text(f"{root}/arrays")
    _rename_text(spark, f"{root}/arrays", ".json")
    part.where("p_partkey % 2 = 0").select("p_name", "p_partkey", "p_retailprice", F.col("p_brand").alias("extra")).write.parquet(f"{root}/part/0")
    part.where("p_partkey % 2 = 1").select("p_partkey", "p_retailprice", "p_name", F.col("p_size").alias("extra")).write.parquet(f"{root}/part/1")
    frames, errors = RD.ingest_files(spark, root)
    columns = {"csv": ("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "json": ("s_suppkey", "s_name", "s_acctbal", "extra"),
               "parquet": ("p_partkey", "p_name", "p_retailprice", "extra")}
    out = errors.where("reason = 'malformed record'").select(F.lit("error").alias("kind"), F.lit(None).cast("bigint").alias("key"), F.col("record").alias("name"),
                                                             F.lit(None).cast("double").alias("amount"), F.col("reason").alias("extra"))
    for kind, (key, name, amount, extra) in columns.items():
        out = out.unionByName(frames[kind].select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), F.col(name).alias("name"),
                                                  F.col(amount).cast("double").alias("amount"), F.col(extra).cast("string").alias("extra")))
    return out


@register("write_dataset_partitioned", ["SNK1", "SRC8", "CAT1", "CAT2"], """
select source as view_name, count(*) as n, count(*) as max_row_number from documents group by source""")
def q_write_dataset(spark, sf_dir):
    from silverline.plans.queries_docs import provenance_docs

    root = _fresh(spark, "datasets")
    write_dataset(provenance_docs(spark, sf_dir), root)
    stored = spark.read.parquet(root)
    ids = [r["id"] for r in derived(spark, sf_dir, "datasets").select("id").orderBy("id").collect()]  # catalog rows
    C.register_views({i: stored.where(F.col("_dataset_id") == i) for i in ids})
    sql = " union all ".join(
        f"select '{i}' as view_name, count(*) as n, max(_row_number) as max_row_number from `{i}`" for i in ids)
    return C.run_sql(spark, sql)


@register("stored_file_stats", ["SRC8", "SNK1"])
def q_file_stats(spark, sf_dir):
    from silverline.plans.queries_docs import provenance_docs

    root = _fresh(spark, "stats")
    write_dataset(provenance_docs(spark, sf_dir), root)
    return RD.file_stats(spark.read.parquet(root))


def _duck_gold_customer_columns():
    from silverline.functions import patterns as P
    from silverline.plans import duck as D
    from silverline.plans.fixtures import duck_with
    from silverline.plans.queries_quality import DIRTY_CUSTOMER_COLUMNS

    sql_type = ("case expected_type " + " ".join(f"when '{a}' then '{b}'" for a, b in P.SEMANTIC_SQL_TYPES)
                + " else 'VARCHAR' end")
    return duck_with("dirty_customer") + f"""
select 'dirty_customer' as table_name, column_name, expected_type as column_type, {sql_type} as sql_type,
  round(valid_percentage, 4) as valid_percentage
from ({D.column_stats_sql("dirty_customer", DIRTY_CUSTOMER_COLUMNS)}) s"""


@register("promote_write_gold_customer", ["SNK2", "CAT5", "CAT3", "CAT4"], _duck_gold_customer_columns())
def q_write_gold(spark, sf_dir):
    from silverline.sources.sinks import write_gold

    gold, tables, columns = C.promote(derived(spark, sf_dir, "dirty_customer"), "dirty_customer")
    root = _fresh(spark, "gold")
    out = write_gold(gold, tables, columns, root, "dirty_customer")
    return spark.read.parquet(out["columns"]).select("table_name", "column_name", "column_type", "sql_type",
                                                     F.round("valid_percentage", 4).alias("valid_percentage"))


@register("gold_ledger_runs", ["CAT5", "SNK2", "AGG8", "CAT3"], """
with d as (select source, count(*) as n from documents group by source), one as (select min(source) as s from documents)
select 1 as run, 'promoted' as action, count(*) as datasets, cast(sum(n) as bigint) as rows from d
union all select 2, 'skipped', count(*), cast(sum(n) as bigint) from d
union all select 3, 'promoted', count(*), cast(sum(n + 1) as bigint) from d, one where source = s
union all select 3, 'skipped', count(*), cast(sum(n) as bigint) from d, one where source is distinct from s
union all select 4, 'promoted', count(*), cast(sum(n + case when source = s then 1 else 0 end) as bigint) from d, one
union all select 5, 'stored', (select count(*) from d), (select count(*) + 1 from documents)""")
def q_gold_ledger(spark, sf_dir):
    """Four promotions: all new, nothing changed, a row more in one dataset, all forced; then what is stored."""
    from silverline.operators.ledger import promote_changed

    docs = read_table(spark, sf_dir, "documents")
    root = _fresh(spark, "ledger")
    info = docs.select("source").distinct().select(F.col("source").alias("dataset_id"), F.lit("s1").alias("space_id"),
                                                   F.concat("source", F.lit(".txt")).alias("source_file"), F.lit("txt").alias("source_type"))
    first = docs.agg(F.min("source")).first()[0]
    more = docs.unionByName(docs.where(F.col("source") == first).orderBy("doc_id").limit(1))
    runs = None
    for run, (rows, force) in enumerate(((docs, False), (docs, False), (more, False), (more, True)), 1):
        done = promote_changed(rows, "source", root, force, info).groupBy("action").agg(F.count("*").alias("datasets"), F.sum("rows").alias("rows"))
        done = done.select(F.lit(run).alias("run"), "action", "datasets", "rows")
        runs = done if runs is None else runs.unionByName(done)
    rows = spark.read.parquet(f"{root}/tables").groupBy("source").agg(F.count("*").alias("rows"))
    tables = spark.read.parquet(f"{root}/meta/gold_tables").select(F.col("dataset_id").alias("source"), "row_count")
    same = rows.join(tables, rows["source"].eqNullSafe(tables["source"]) & (F.col("rows") == F.col("row_count")), "left_semi")
    return runs.unionByName(same.agg(F.count("*").alias("datasets"), F.sum("rows").alias("rows")).select(F.lit(5).alias("run"), F.lit("stored").alias("action"), "datasets", "rows"))
