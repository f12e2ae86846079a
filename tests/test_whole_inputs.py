"""The inputs that the catalogue's queries read hold every event, not a part."""

import pytest

from logloom.plans import catalogue, dialect, rendered
from logloom.plans.dialect import bind
from logloom.plans.projection import logs
from logloom.sources import adapters, parsers

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.catalogue()


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").count()


@pytest.mark.parametrize("name", sorted(parsers.FORMATS))
def test_a_line_for_every_event(spark, events, name):
    lines = dialect.query(bind(rendered.lines(name), logs=logs))(spark, SF)
    assert lines.where("line is not null").select("line_no").distinct().count() == lines.count() == events


def test_all_rendered_variants_occur(spark):
    def found(name, pattern):
        lines = dialect.query(bind(rendered.lines(name), logs=logs))(spark, SF)
        return {r[0] for r in lines.selectExpr(f"regexp_extract(line, r'{pattern}', 1)").distinct().collect()}

    assert found("netflow", r"action=(\w+)") == {"permit", "Deny", "ALLOW"}
    assert found("config_change", r"configuration ([a-z ]+) by") == {"updated", "rolled back", "applied"}
    assert found("sysmon", r"EventID=(\w+)") == {"3", "1", "x"}
    assert found("keyvalue", r"action=(\w+)") == {"ALLOW", "DENY", "established"}
    assert found("linux", r" (\w+): ") == {"kernel", "systemd", "network"}


@pytest.mark.parametrize("name", sorted(adapters.LAYOUTS))
def test_a_row_of_every_layout_for_every_event(spark, events, name):
    assert dialect.query(QUERIES[f"adapt_{name}"])(spark, SF).count() == events


def test_all_classifications_of_a_layout_occur(spark):
    rows = dialect.query(bind(lambda d: catalogue.layout_rows(d)["suricata_csv"](d), logs=logs))(spark, SF)
    assert {r[0] for r in rows.select("classification").distinct().collect()} == {"Attempted Recon", "Policy", "x"}


def test_multiline_merges_every_line(spark):
    sf = "/root/testdata/sf0.01"
    rows = dialect.query(QUERIES["multiline_merge"])(spark, sf)
    per = [r.k for r in rows.selectExpr("file", "size(split(line, '\\n')) as k").groupBy("file").agg({"k": "sum"}).withColumnRenamed("sum(k)", "k").collect()]
    assert sum(per) == spark.read.parquet(f"{sf}/events.parquet").count() and max(per) <= 1000 and len(per) > 7


def test_reports_take_the_alerts_of_all_detectors(spark):
    kept = {(r.type, r.subject, r.score) for r in dialect.query(QUERIES["report_kept"])(spark, SF).collect()}
    for name in ("new_user", "attack_chain", "suspicious_process"):
        found = {(r.type, r.subject, r.score) for r in dialect.query(QUERIES[f"detect_{name}"])(spark, SF).where("score >= 3.5").collect()}
        assert found and found <= kept, name


def test_all_alerts_take_events_before_the_split(spark):
    alerts = dialect.query(QUERIES["all_alerts"])(spark, SF).where("detector = 'ssh_lateral' or detector = 'off_hours'")
    for name in ("ssh_lateral", "off_hours"):
        own = dialect.query(QUERIES[f"detect_{name}"])(spark, SF).select("type", "subject", "severity", "score")
        got = alerts.where(f"detector = '{name}'").drop("detector")
        assert own.count() and own.exceptAll(got).count() == got.exceptAll(own).count() == 0


def test_every_address_and_day_has_a_lease(spark):
    leases = dialect.query(catalogue.lease_table)(spark, SF).selectExpr("ip", "date_trunc('day', start) as day")
    days = dialect.query(logs)(spark, SF).selectExpr("source_ip as ip", "date_trunc('day', timestamp) as day").distinct()
    assert days.exceptAll(leases).count() == leases.exceptAll(days).count() == 0
    found = dialect.query(QUERIES["lease_lookup"])(spark, SF)
    assert found.where("mac is null").count() and found.where("mac is not null").count()
