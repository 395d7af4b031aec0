"""Windowed traffic features of a raw connection log.

Both kinds of window are split so that one flooded host or service is many tasks, by fixed cells
that no row can change for another:

* time windows are the same for all connections of a key at one time. They are counted per key
  and time first, so a burst at one instant is one row of sums; these enter a running sum at their
  time and leave it after the window. A task holds one key for one cell of time; what is open at
  the start of a cell comes in as one row, from totals per (key, cell).
* windows over the last n connections of a host need its connections numbered: those at earlier
  times by the same running sums, those at the same time by cells of ``conn_id``. Numbers cut a
  host into blocks of equal size, each with the n - 1 rows before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Connection states that count as a SYN error or a rejection.
SYN_ERROR_FLAGS = ["S0", "S1", "S2", "S3"]
REJECT_FLAGS = ["REJ"]

MICROS = 1_000_000
BLOCK = 10_000
# A cell of time holds at most so many seconds' distinct microseconds of a key, a cell of numbers
# at most so many connections of a host at one time.
CELL_SECONDS = 2.0
CELL_IDS = 1_000_000

TIME_FEATURES = ["count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate",
                 "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate"]
HOST_FEATURES = ["dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
                 "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
                 "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
                 "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate"]


def syn_error(flag: Column) -> Column:
    return F.coalesce(flag.isin(SYN_ERROR_FLAGS), F.lit(False)).cast("int")


def rejected(flag: Column) -> Column:
    return F.coalesce(flag.isin(REJECT_FLAGS), F.lit(False)).cast("int")


def flow_features(conns: DataFrame, window_seconds: float = 2.0, last_n: int = 100,
                  cell_seconds: float = CELL_SECONDS, block: int = BLOCK,
                  time_windows: bool = True, cell_ids: int = CELL_IDS, since: int | None = None,
                  stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The connections plus the 9 time-window and 10 last-n host features.

    Without ``time_windows`` the last-n host features only, by a shorter plan. ``since`` (microseconds)
    is for a caller that has no use for the connections before it but as the last n of later ones:
    time windows hold none of them and are not worked out for them. ``stored`` may write the tables
    on the way and give them back, so that a step's shuffle files need not last till the end.

    Needs ``conn_id`` (unique), ``ts``, ``src_ip``, ``src_port``, ``dst_ip``, ``service``, ``flag``.
    ``cell_seconds``, ``cell_ids`` and ``block`` only set the size of tasks, never a result.
    Connections without a time come back with NULL features.
    """
    if last_n > block:
        raise ValueError("last_n must not exceed block")
    timed = _flow_features(conns.filter(F.col("ts").isNotNull()), window_seconds, last_n,
                           cell_seconds, block, time_windows, cell_ids, since, stored)
    names = TIME_FEATURES + HOST_FEATURES if time_windows else HOST_FEATURES
    # A connection without a time is in no window, its own included.
    untimed = conns.filter(F.col("ts").isNull())
    return timed.unionByName(untimed.select(*conns.columns, *[
        F.lit(None).cast(timed.schema[n].dataType).alias(n) for n in names]))


def _flow_features(conns: DataFrame, window_seconds: float, last_n: int, cell_seconds: float,
                   block: int, time_windows: bool, cell_ids: int, since: int | None,
                   stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    payload = conns.columns
    base = conns.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))) \
        .withColumn("_syn", syn_error(F.col("flag"))).withColumn("_rej", rejected(F.col("flag")))
    span, cell = int(window_seconds * MICROS), max(1, int(cell_seconds * MICROS))
    totals = [F.count(F.lit(1)).alias("_n"), F.sum("_syn").alias("_syn"), F.sum("_rej").alias("_rej")]
    sums = [F.sum(c).alias(c) for c in ("_n", "_syn", "_rej")]
    reached = base if since is None else base.filter(F.col("_t") >= since)
    pairs = stored(reached.groupBy("dst_ip", "service", "_t").agg(*totals))
    # The host's sums number its connections too, so they are of all.
    peers = pairs.groupBy("dst_ip", "_t").agg(*sums) if since is None else base.groupBy("dst_ip", "_t").agg(*totals)
    hosts = stored(_window_sums(peers, ["dst_ip"], span, cell, "_h"))
    if not time_windows:
        return _last_connections(_numbered(base, hosts, cell_ids), last_n, block).select(
            *payload, *_host_features())
    services = stored(_window_sums(pairs.groupBy("service", "_t").agg(*sums), ["service"], span, cell, "_s"))
    both = _window_sums(pairs, ["dst_ip", "service"], span, cell, "_p").select(
        "dst_ip", "service", "_t", "_p_n")
    # A service's sums are joined to its pairs, of which there are fewer than connections.
    both = stored(_attached(both, services.drop("_s_before"), ["service", "_t"]))
    numbers = stored(_numbered(base, hosts, cell_ids))
    timed = stored(_attached(numbers, both, ["dst_ip", "service", "_t"], "inner" if since is None else "left"))
    counted = _last_connections(timed, last_n, block)
    return counted.select(*payload, *window_features())


def window_features() -> list[Column]:
    """The 19 features from the sums of a row's windows."""
    n_host, n_srv, n_pair = F.col("_h_n"), F.col("_s_n"), F.col("_p_n")
    return [
        n_host.alias("count"), n_srv.alias("srv_count"),
        (F.col("_h_syn") / n_host).alias("serror_rate"),
        (F.col("_s_syn") / n_srv).alias("srv_serror_rate"),
        (F.col("_h_rej") / n_host).alias("rerror_rate"),
        (F.col("_s_rej") / n_srv).alias("srv_rerror_rate"),
        (n_pair / n_host).alias("same_srv_rate"),
        ((n_host - n_pair) / n_host).alias("diff_srv_rate"),
        ((n_srv - n_pair) / n_srv).alias("srv_diff_host_rate"),
        *_host_features(),
    ]


def _host_features() -> list[Column]:
    n_last, n_same = F.col("_l_n"), F.col("_ls_n")
    return [
        n_last.alias("dst_host_count"), n_same.alias("dst_host_srv_count"),
        (n_same / n_last).alias("dst_host_same_srv_rate"),
        ((n_last - n_same) / n_last).alias("dst_host_diff_srv_rate"),
        (F.col("_lp_n") / n_last).alias("dst_host_same_src_port_rate"),
        ((n_same - F.col("_li_n")) / n_same).alias("dst_host_srv_diff_host_rate"),
        (F.col("_l_syn") / n_last).alias("dst_host_serror_rate"),
        (F.col("_ls_syn") / n_same).alias("dst_host_srv_serror_rate"),
        (F.col("_l_rej") / n_last).alias("dst_host_rerror_rate"),
        (F.col("_ls_rej") / n_same).alias("dst_host_srv_rerror_rate"),
    ]


def _attached(rows: DataFrame, sums: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the sums of their keys, which may be NULL; Spark splits a key with many rows."""
    renamed = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys],
                          *[c for c in sums.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(renamed, same, how).drop(*[f"_of_{k}" for k in keys])


def _window_sums(peers: DataFrame, keys: list[str], span: int, cell: int, prefix: str) -> DataFrame:
    """Per key and time what the window that ends there holds, and how many came before that time.

    ``peers`` has one row per key and time. Each enters at its time and leaves just after ``span``;
    in a cell of time the running sum begins with what the totals of earlier cells leave open.
    """
    measures = ["_n", "_syn", "_rej", "_before"]
    edge = F.explode(F.array(
        F.struct(F.col("_t").alias("_at"), F.lit(1).alias("_sign")),
        F.struct((F.col("_t") + span + 1).alias("_at"), F.lit(-1).alias("_sign"))))
    edges = peers.select("*", edge.alias("_edge")).select(
        *keys, "_edge.*", F.floor(F.col("_edge._at") / cell).alias("_cell"),
        *[(F.col("_edge._sign") * F.col(m)).alias(m) for m in measures[:3]],
        F.when(F.col("_edge._sign") == 1, F.col("_n")).otherwise(0).alias("_before"))
    totals = edges.groupBy(*keys, "_cell").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    opened = totals.select(*keys, "_cell", (F.col("_cell") * cell).alias("_at"), F.lit(0).alias("_sign"),
                           *[F.sum(m).over(before).alias(m) for m in measures]).filter("_before > 0")
    now = Window.partitionBy(*keys, "_cell").orderBy("_at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    own = F.col("_n").alias("_own")
    running = edges.unionByName(opened).select(
        *keys, F.col("_at").alias("_t"), "_sign", own, *[F.sum(m).over(now).alias(m) for m in measures])
    return running.filter("_sign = 1").select(
        *keys, "_t", *[F.col(m).alias(prefix + m) for m in measures[:3]],
        (F.col("_before") - F.col("_own")).alias(f"{prefix}_before"))


def _numbered(base: DataFrame, hosts: DataFrame, ids: int) -> DataFrame:
    """Each connection's number in its host, and its host's sums: by a shuffle on (host, time, cell).

    A cell holds ``ids`` neighbouring ``conn_id``; of a host at one time that is mostly all.
    """
    keys = ["dst_ip", "_t", "_ids"]
    rows = base.withColumn("_ids", F.floor(F.col("conn_id") / ids))
    before = Window.partitionBy("dst_ip", "_t").orderBy("_ids").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_in")).select(
        *keys, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_lower"))
    first = _attached(cells, hosts, ["dst_ip", "_t"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("conn_id"))
    return _attached(rows.withColumn("_place", place), first, keys).withColumn(
        "_number", F.col("_place") + F.col("_lower") + F.col("_h_before")).drop(
        "_ids", "_place", "_lower", "_h_before")


def _last_connections(rows: DataFrame, last_n: int, block: int) -> DataFrame:
    """Sums over the last n connections of the host, by a shuffle on (host, block)."""
    place = F.col("_number") - 1
    own = F.floor(place / block)
    late = place % block >= block - (last_n - 1)
    homes = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_own", own).withColumn("_block", F.explode(homes))
    by_number = Window.partitionBy("dst_ip", "_block").orderBy("_number")
    # A frame that slides is summed anew for each row; a running sum less an earlier one is not.
    so_far = by_number.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = spread.withColumns({"_l_n": F.least(F.row_number().over(by_number), F.lit(last_n)).cast("long"),
                                 "_all_syn": F.sum("_syn").over(so_far), "_all_rej": F.sum("_rej").over(so_far)})

    def recent(*keys: str) -> Window:
        return Window.partitionBy("dst_ip", "_block", *keys).orderBy("_number").rangeBetween(
            -(last_n - 1), Window.currentRow)

    same = recent("service")
    out = spread.select(
        "*",
        *[(F.col(f"_all_{c}") - F.coalesce(F.lag(f"_all_{c}", last_n).over(by_number), F.lit(0))).alias(f"_l_{c}")
          for c in ("syn", "rej")],
        F.count(F.lit(1)).over(same).alias("_ls_n"),
        F.sum("_syn").over(same).alias("_ls_syn"),
        F.sum("_rej").over(same).alias("_ls_rej"),
        F.count(F.lit(1)).over(recent("service", "src_ip")).alias("_li_n"),
        F.count(F.lit(1)).over(recent("src_port")).alias("_lp_n"),
    )
    return out.filter(F.col("_block") == F.col("_own")).drop("_own", "_block", "_all_syn", "_all_rej")
