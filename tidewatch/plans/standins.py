"""Flow data derived from the supplied tables, which hold no network traffic.

Expressions use text both Spark SQL and plain SQL read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import FLOW_SCHEMA, TAXONOMY
from tidewatch.session import spread

ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORY = ["l_returnflag", "l_linestatus"]

# The taxonomy's names, one unknown one, one in mixed case with dots.
RAW_LABELS = [*TAXONOMY, "zeroday", "Nep.tune."]

FLOW_EXPRESSIONS = {
    "duration": "cast(l_quantity as bigint)",
    "protocol_type": "case l_returnflag when 'A' then 'tcp' when 'R' then 'udp' else 'icmp' end",
    "service": "case l_partkey % 5 when 0 then 'http' when 1 then 'ftp' when 2 then 'smtp' "
               "when 3 then 'domain' else 'private' end",
    "flag": "case when l_linestatus = 'F' then 'SF' when l_suppkey % 3 = 0 then 'REJ' "
            "else 'S0' end",
    "src_bytes": "cast(floor(l_extendedprice) as bigint)",
    "dst_bytes": "cast(floor(l_extendedprice * l_tax) as bigint)",
    "land": "case when l_partkey % 50 = l_suppkey % 50 then 1 else 0 end",
    "wrong_fragment": "case when l_partkey % 40 = 0 then 3 when l_partkey % 40 = 1 then 1 "
                      "else 0 end",
    "urgent": "case when l_orderkey % 97 = 0 then 1 else 0 end",
    "hot": "cast(l_orderkey % 7 as int)",
    "num_failed_logins": "cast(l_suppkey % 6 as int)",
    "logged_in": "cast(l_orderkey % 2 as int)",
    "num_compromised": "cast(l_partkey % 9 as int)",
    "root_shell": "case when l_orderkey % 31 = 0 then 1 else 0 end",
    "su_attempted": "case when l_orderkey % 29 = 0 then 1 else 0 end",
    "num_root": "cast(l_partkey % 11 as int)",
    "num_file_creations": "cast(l_suppkey % 13 as int)",
    "num_shells": "cast(l_orderkey % 3 as int)",
    "num_access_files": "cast(l_partkey % 4 as int)",
    "num_outbound_cmds": "0",
    "is_host_login": "case when l_partkey % 83 = 0 then 1 else 0 end",
    "is_guest_login": "case when l_partkey % 17 = 0 then 1 else 0 end",
    "count": "cast((l_orderkey + l_suppkey) % 512 as int)",
    "srv_count": "cast((l_orderkey + l_partkey) % 512 as int)",
    "serror_rate": "cast(l_orderkey % 101 as double) / 100",
    "srv_serror_rate": "cast(l_partkey % 101 as double) / 100",
    "rerror_rate": "cast(l_suppkey % 101 as double) / 100",
    "srv_rerror_rate": "cast((l_orderkey + 2 * l_suppkey) % 101 as double) / 100",
    "same_srv_rate": "l_discount",
    "diff_srv_rate": "1 - l_discount",
    "srv_diff_host_rate": "cast((l_orderkey + l_linenumber) % 101 as double) / 100",
    "dst_host_count": "cast(l_partkey % 256 as int)",
    "dst_host_srv_count": "cast(l_suppkey % 256 as int)",
    "dst_host_same_srv_rate": "cast((l_partkey + l_linenumber) % 101 as double) / 100",
    "dst_host_diff_srv_rate": "cast((l_partkey + 2 * l_linenumber) % 101 as double) / 100",
    "dst_host_same_src_port_rate": "cast((3 * l_partkey + l_suppkey) % 101 as double) / 100",
    "dst_host_srv_diff_host_rate": "cast((l_partkey + 5 * l_suppkey) % 101 as double) / 100",
    "dst_host_serror_rate": "cast((7 * l_orderkey + 1) % 101 as double) / 100",
    "dst_host_srv_serror_rate": "cast((7 * l_partkey + 2) % 101 as double) / 100",
    "dst_host_rerror_rate": "cast((11 * l_orderkey + 3) % 101 as double) / 100",
    "dst_host_srv_rerror_rate": "cast((11 * l_partkey + 4) % 101 as double) / 100",
    "difficulty": "cast(l_linenumber as int)",
}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def raw_label(number: str) -> F.Column:
    names = F.array(*[F.lit(n) for n in RAW_LABELS])
    return F.element_at(names, (F.col(number) % len(RAW_LABELS) + 1).cast("int"))


def flow_records(spark: SparkSession, sf_dir: str, keep: list[str] = ()) -> DataFrame:
    """One 43-column flow record per lineitem row, in flow-file order."""
    rows = spread(lineitem(spark, sf_dir)).withColumn("label", raw_label("l_orderkey"))
    return rows.select(*keep, *[
        (F.col("label") if f.name == "label" else F.expr(FLOW_EXPRESSIONS[f.name]))
        .cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA])


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a raw attack name as label."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", raw_label("event_id").alias("label"))


def connections(events: DataFrame) -> DataFrame:
    """Events as a raw connection log; the user is the destination host."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("conn_id"),
        (F.col("event_id") * 7 % 40).cast("string").alias("src_ip"), k.alias("src_port"),
        F.col("user_id").cast("string").alias("dst_ip"), (k % 5 * 10).alias("dst_port"),
        (k % 5).cast("string").alias("service"),
        F.when(F.col("event_type") == "error", "S0").when(F.col("event_type") == "signup", "REJ")
        .otherwise("SF").alias("flag"),
        F.col("value").alias("bytes"))


def request_vectors(embeddings: DataFrame) -> DataFrame:
    """Embeddings as detection requests of 50 vectors, one second apart."""
    return embeddings.select(
        F.expr("vec_id div 50").alias("request_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, vec_id)")
        .cast("timestamp").alias("ts"),
        (F.col("vec_id") % 50).cast("int").alias("pos"),
        F.col("embedding").cast("array<double>").alias("features"), "vec_id", "label")
