"""The engine's surface: ingest, reduce_noise, enrich, baselines and their store, detect, report, export."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import baselines, detectors, enrich as enriching, forest, noise, report as reporting
from .plans.dialect import SPARK, apply, written
from .schema import event_table
from .shipping import ship
from .sources import mmdb, readers
from .sources.store import Store, exists


def ingest(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The event table of a file or folder."""
    return readers.ingest(spark, path, start, end)


def unparsed(spark: SparkSession, path: str) -> DataFrame:
    """Text records that their file's format does not fit."""
    return readers.unparsed(spark, path)


def reduce_noise(logs: DataFrame, threshold: int = 5) -> DataFrame:
    return apply(lambda d: noise.reduce_noise(d, threshold), logs=logs)


def enrich(
    logs: DataFrame,
    indicators: DataFrame | None = None,
    assets: DataFrame | None = None,
    people: DataFrame | None = None,
    leases: DataFrame | None = None,
    ranges: DataFrame | None = None,
    mask: bool = True,
    common_schema: bool = False,
    country_file: str | None = None,
    network_file: str | None = None,
) -> DataFrame:
    """The whole chain: address scope, masking, and what the given tables add, in this order.

    ranges (lo, hi, country) of addresses or ``country_file`` and ``network_file`` in the MaxMind DB
    format (columns geoip_country and asn_org), indicators (kind, value), assets (ip, name),
    people (username, department, role), leases (ip, mac, start, stop).
    ``common_schema`` adds the columns of the common schema under their dotted names.
    """
    out = logs.withColumn("ip_scope", F.expr(enriching.ipf.scope(SPARK, "source_ip"))).withColumn("ip_private", F.expr(enriching.ipf.private_strict(SPARK, "source_ip")))
    if mask:
        out = out.withColumn("message", F.expr(enriching.mask(SPARK, "message")))
    more = []
    if ranges is not None:
        more.append(apply(enriching.geo, logs=logs, ranges=ranges).withColumnRenamed("country", "geo_country"))
    for file, column, way in ((country_file, "geoip_country", mmdb.COUNTRY), (network_file, "asn_org", mmdb.NETWORK)):
        if file is not None:
            more.append(mmdb.located(logs, file, {column: way}))
    if common_schema:
        more.append(apply(enriching.ecs, logs=logs))
    if indicators is not None:
        more.append(apply(enriching.threat_intel, logs=logs, indicators=indicators))
    if assets is not None:
        more.append(apply(enriching.assets, logs=logs, assets=assets))
    if people is not None:
        more.append(apply(enriching.identity, logs=logs, people=people))
    if leases is not None:
        points = logs.select("row_id", "timestamp", F.col("source_ip").alias("ip"))
        more.append(apply(enriching.leases, points=points, leases=leases).withColumnRenamed("mac", "source_mac"))
    for table in more:
        out = out.join(table, "row_id", "left")
    return out


def read_leases(spark: SparkSession, path: str) -> DataFrame:
    """(ip, mac, start, stop) of a lease file: CSV with columns ip, mac, start, end; instants that can't be read are null."""
    rows = readers.read_csv(spark, path)
    return rows.select("ip", "mac", F.try_to_timestamp("start").alias("start"), F.try_to_timestamp("end").alias("stop"))


# ---------------------------------------------------------------- baselines

#: Tables of the store and the key by which a new training replaces old rows (None: no key, only snapshots).
STORE = {
    "user_stats": "username", "device_stats": "host", "group_stats": "grp", "global_stats": None, "download_daily": "username", "login_time": "username",
    "group_members": "grp", "user_to_group": "username", "device_to_group": "device", "models": "entity",
}


def train_baselines(logs: DataFrame, rules: list[dict] | None = None) -> dict[str, DataFrame]:
    """All baseline tables of some logs; ``rules`` map rows to groups."""
    rules = baselines.RULES if rules is None else rules
    grouped = apply(lambda d: baselines.group_mapped(d, rules), logs=logs)
    members = apply(lambda d: f"select grp, {d.texts('nullif(username, ' + chr(39) * 2 + ')')} as users, {d.texts('source_ip')} as source_ips, {d.texts('host')} as hosts from @grouped group by grp", grouped=grouped)
    most = lambda d: "select username, grp from (select username, grp, row_number() over (partition by username order by count(*) desc, grp) as rk from @grouped where username is not null group by username, grp) as r where rk = 1"
    return {
        "user_stats": apply(baselines.user_stats, logs=logs), "device_stats": apply(baselines.device_stats, logs=logs), "group_stats": apply(baselines.group_stats, logs=logs), "global_stats": apply(baselines.global_stats, logs=logs),
        "download_daily": apply(baselines.download_daily, logs=logs), "login_time": apply(baselines.login_time, logs=logs),
        "group_members": members, "user_to_group": apply(most, grouped=grouped), "device_to_group": apply(lambda d: baselines.majority_group(d, rules), logs=logs),
    }


def load_baseline(spark: SparkSession, path: str, name: str, log_type: str) -> DataFrame | None:
    """A table of the last commit; None if there is none."""
    return Store(spark, path, log_type).table(name)


def load_baselines(spark: SparkSession, path: str, log_type: str, fallback: str | None = None) -> dict[str, DataFrame]:
    """The tables of the last commit, all of one moment; from the store ``fallback`` if this one has none of this type."""
    store = Store(spark, path, log_type)
    last = store.manifest()
    found = {name: store.table(name, last) for name in STORE if name in last["tables"]}
    return load_baselines(spark, fallback, log_type) if not found and fallback else found


def save_baselines(tables: dict[str, DataFrame], path: str, log_type: str, trained_at: str | None = None) -> str:
    """Commit a snapshot: new rows, and old rows whose key is not among them; returns its ``trained_at``.

    All tables are committed at once (``sources.store``); earlier snapshots stay as they are.
    """
    at = trained_at or dt.datetime.now(dt.timezone.utc).strftime("T%Y%m%d%H%M%S%f")

    def merge(name: str, old: DataFrame, new: DataFrame) -> DataFrame | None:
        if name == "models":  # an entity's model is several rows, which belong together
            return replace_by_key(old, new, ["kind", "entity"])
        return merge_by_key(old, new, STORE[name]) if STORE.get(name) else None

    if tables:
        Store(next(iter(tables.values())).sparkSession, path, log_type).commit(tables, merge, at)
    return at


#: Entities that have models of their own: kind -> key of the daily features.
ENTITIES = {"user": baselines.UNKNOWN, "device": "coalesce(host, source_ip)", "group": "coalesce(dept, '(unknown)')"}


def entity_points(logs: DataFrame, kind: str) -> DataFrame:
    """(entity, key, x): daily features of each entity, the day as key; of a group the days of its users."""
    if kind == "group":
        daily = apply(lambda d: f"select g.grp as entity, concat(x.entity, '@', cast(x.day as string)) as key, x.* from ({baselines.daily(d, baselines.UNKNOWN)}) as x join ({baselines.user_groups(d)}) as g on g.username = x.entity", logs=logs)
        daily = daily.toDF("entity", "key", "user", *daily.columns[3:])
    else:
        daily = apply(lambda d: f"select x.*, cast(day as string) as key from ({baselines.daily(d, ENTITIES[kind])}) as x", logs=logs)
    measures = ("unique_users", *baselines.MEASURES) if kind == "device" else baselines.MEASURES
    return forest.points(daily, F.col("entity"), F.col("key"), [F.col(m) for m in measures])


def train_models(logs: DataFrame, kinds: tuple[str, ...] = tuple(ENTITIES), **how) -> DataFrame:
    """The table ``models`` (kind, entity, trees as flat arrays, cutoff), in order of entity, by which readers skip files."""
    ship(logs.sparkSession)
    made = []
    for kind in kinds:
        rows = written(entity_points(logs, kind))
        model = written(forest.fit(rows, **how))
        cutoffs = forest.thresholds(forest.score(rows, model))
        made.append(model.join(cutoffs, "entity").select(F.lit(kind).alias("kind"), "*"))
    return reduce(DataFrame.unionByName, made).repartitionByRange("kind", "entity").sortWithinPartitions("kind", "entity", "first_tree")


def score_models(logs: DataFrame, models: DataFrame, kind: str = "user") -> DataFrame:
    """(entity, key, score, outlier) of each day of each entity; null where the entity has no model."""
    ship(logs.sparkSession)
    mine = models.where(F.col("kind") == kind)
    scored = forest.score(entity_points(logs, kind), mine.drop("kind", "cutoff"))
    cutoffs = mine.groupBy("entity").agg(F.first("cutoff").alias("cutoff"))
    return scored.join(cutoffs, "entity", "left").select("entity", "key", "score", (F.col("score") > F.col("cutoff")).alias("outlier"))


def train(spark: SparkSession, paths: list[str], path: str, log_type: str | None = None, rules: list[dict] | None = None) -> tuple[str, str]:
    """Train baselines and models on the files of several paths and commit a snapshot; (log type, trained_at).

    Without ``log_type`` it is that of the logs (``log_type_of``), else ``generic``.
    """
    logs = [ingest(spark, p) for p in paths]
    # each path's rows are numbered by themselves; their place keeps the numbers apart
    table = written(reduce(DataFrame.unionByName, [x.withColumn("row_id", F.col("row_id") * len(logs) + k) for k, x in enumerate(logs)]))
    kind = log_type or log_type_of(table) or "generic"
    return kind, save_baselines(train_baselines(table, rules) | {"models": train_models(table)}, path, kind)


def log_type_of(logs: DataFrame, columns: tuple[str, ...] = ()) -> str | None:
    """The class of a table of logs; ``columns`` are those of the file that it comes from."""
    return apply(lambda d: reporting.table_class(d, columns), logs=logs).first()[0]


def store_state(spark: SparkSession, path: str, log_type: str, sample: int = 5) -> DataFrame:
    """(name, snapshots, trained_at, rows, sample): what the store holds of a log type, a few rows as JSON."""
    store = Store(spark, path, log_type)
    last = store.manifest()
    parts = []
    for name in STORE:
        entry, table = last["tables"].get(name), store.table(name, last)
        if entry is None:
            continue
        some = table.select(F.to_json(F.struct("*")).alias("j")).orderBy("j").limit(sample).agg(F.collect_list("j").alias("sample"))
        rows = table.agg(F.count("*").alias("rows")).crossJoin(some)  # two single rows
        parts.append(rows.select(F.lit(name).alias("name"), F.lit(entry["snapshots"]).cast("long").alias("snapshots"), F.lit(entry["trained_at"]).alias("trained_at"), "rows", "sample"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "name string, snapshots long, trained_at string, rows long, sample array<string>"))


def migrate_json(spark: SparkSession, folder: str, path: str, log_type: str = "generic") -> list[str]:
    """Bring baselines from JSON files (an array of rows each; of a global one every snapshot) into the store."""
    done = []
    for file, name in (("user_stats", "user_stats"), ("device_stats", "device_stats"), ("group_stats", "group_stats"), ("global_baseline", "global_stats")):
        at = f"{folder}/{file}.json"
        if not exists(spark, at):
            continue
        rows = spark.read.option("multiLine", True).json(at).withColumnsRenamed({"group": "grp"})
        if not rows.columns:
            continue
        if "trained_at" in rows.columns:
            stamps = [r[0] for r in rows.select("trained_at").distinct().orderBy("trained_at").collect()]  # one per training
            for stamp in stamps:
                save_baselines({name: rows.where(F.col("trained_at") == stamp).drop("trained_at")}, path, log_type, "T" + "".join(c for c in stamp if c.isdigit())[:20])
        else:
            save_baselines({name: rows}, path, log_type)
        done.append(name)
    return done


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks; columns by name; null keys go."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    return fresh.unionByName(old.where(F.col(key).isNotNull()).join(fresh.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose keys new lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


#: Detectors whose alerts came twice in the tool that these follow.
TWICE = ("deny_burst_ip", "deny_burst_minute", "deny_distributed", "exfil_sum", "fw_port_scan", "policy_evasion", "exfil_row", "exfil_outlier", "lsass_dump", "win_privesc", "dhcp_scope_conflict", "dhcp_rogue_server", "dhcp_device_user_mismatch")


def detect(logs: DataFrame, stats: DataFrame | None = None, names: list[str] | None = None, min_score: float = reporting.MIN_SCORE, compat_duplicates: bool = False) -> DataFrame:
    """Alerts (type, subject, severity, score, detector, evidence as JSON) of all detectors.

    The event table is written once, as some sixty detectors read it, each task's rows in order
    of program: a detector's filter on the program then skips pages of its files.
    ``compat_duplicates`` gives the alerts of the detectors in TWICE twice.
    """
    logs = written(logs.sortWithinPartitions("program"))
    events = written(apply(detectors.router_events, logs=logs))
    frames = []
    chosen = detectors.PLAIN | (detectors.WITH_STATS if stats is not None else {})
    for name, text in chosen.items():
        if names is not None and name not in names:
            continue
        inputs = {"logs": logs} | ({"ev": events} if name in detectors.ON_EVENTS else {}) | ({"stats": stats} if name in detectors.WITH_STATS else {})
        found = apply(text, **inputs)
        extra = [c for c in found.columns if c not in ("type", "subject", "severity", "score")]
        evidence = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
        found = found.select("type", "subject", "severity", "score", F.lit(name).alias("detector"), evidence.alias("evidence"))
        frames += [found] * (2 if compat_duplicates and name in TWICE else 1)
    return reduce(DataFrame.unionByName, frames).where(F.col("score") >= min_score)


def report(alerts: DataFrame) -> dict[str, DataFrame]:
    alerts = written(alerts)
    return {"subjects": apply(reporting.subject_rollup, alerts=alerts), "summary": apply(reporting.summary, alerts=alerts), "payloads": apply(reporting.webhook_payload, alerts=alerts)}


def export_csv(logs: DataFrame, path: str) -> None:
    """Rows numbered from 1 by time."""
    apply(reporting.export_rows, logs=logs).orderBy("log_index").write.mode("overwrite").option("header", True).csv(path)


def write_report(alerts: DataFrame, path: str) -> None:
    """The alerts and what ``report`` makes of them, as JSON."""
    for name, df in ({"alerts": alerts} | report(alerts)).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of a report that was written."""
    return spark.read.schema("type string, subject string, severity string, score double, detector string, evidence string").json(f"{path}/alerts")
