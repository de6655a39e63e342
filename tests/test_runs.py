"""Configuration, planning and whole runs over files; rendering, storage and alerts."""

import json
import os
import time
from datetime import datetime, timezone

import pytest

from plumbline import cli
from plumbline.plans import loading
from plumbline.plans.checks import CHECKS
from plumbline.plans.config import ConfigError, MismatchCsv, Partitions, config_of
from plumbline.plans.planner import build
from plumbline.plans.results import CheckResult, RunResult, check_row, csv_links, run_row, summed
from plumbline.sinks import alerts, render
from plumbline.sinks.artifacts import Artifacts, shaped, write_csv
from plumbline.sources import uri
from plumbline.sources.sides import Query, Source, connector

NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


@pytest.fixture
def csvs(tmp_path, monkeypatch):
    s, t = tmp_path / "s.csv", tmp_path / "t.csv"
    s.write_text("id,name,score\n1,oak,9.1\n2,elm,8.4\n3,fir,7.2\n")
    t.write_text("id,name,score\n1,oak,9.1\n2,elm,8.5\n4,ash,1.0\n5,yew,2.0\n")
    monkeypatch.setenv("SRC", str(s))
    monkeypatch.setenv("TGT", str(t))
    monkeypatch.setenv("PLUMBLINE_ARTIFACTS_DIR", str(tmp_path / "artifacts"))
    return tmp_path


def planned(checks, table=None, **more):
    raw = {"connections": {"source_env_var": "SRC", "target_env_var": "TGT"}, "tables": [{"name": "people", "source": {}, "target": {}, "checks": checks, **(table or {})}], **more}
    config, variables = loading.normalize(config_of(raw), {"env": "test"}, now=NOW)
    return build(config, variables)


def test_passing_run(spark, csvs, monkeypatch):
    monkeypatch.setenv("TGT", str(csvs / "s.csv"))
    checks = [{"type": "row_count"}, {"type": "join_rowdiff", "join_keys": {"source": ["id"], "target": ["id"]}, "include": ["name", "score"]}, {"type": "hash_diff", "include": ["id", "name", "score"]}, {"type": "schema_drift"}, {"type": "what"}]
    run = planned(checks).run(spark)
    assert [c.status for c in run.checks] == ["PASS"] * 4 + ["SKIP"]
    assert run.overall_status == "PASS" and run.overall_severity is None


def test_failing_run(spark, csvs):
    checks = [
        {"type": "row_count", "id_column": "id", "mismatch_sampling": {"mode": "chunk", "chunk_size": 2}},
        {"type": "join_rowdiff", "join_keys": {"source": ["id"], "target": ["id"]}, "include": ["name", "score"]},
        {"type": "aggregations", "rules": [{"method": "sum", "column": "score", "tolerance_pct": 300}, {"method": "count", "id_column": "id", "mismatch_sampling": {"mode": "binary", "max_depth": 3}}]},
        {"type": "group_aggregations", "include_map": {"p": {"source": "name", "target": "name"}}},
        {"type": "partitions", "include": ["name"]},
        {"type": "domain", "column": "name", "allowed_values": ["oak", "elm"], "on": "target"},
        {"type": "freshness", "column": "timestamp'2024-03-01 11:00:00'", "max_lag_minutes": 30},
        {"type": "custom_sql", "sql": "SELECT count(*) FROM source_file WHERE score < 8"},
        {"type": "custom_sql", "mode": "dual", "sql_source": "SELECT count(*) FROM source_file", "sql_target": "SELECT count(*) + 0 FROM source_file", "tolerance_abs": 1},
        {"type": "domain"},
    ]
    storage = {"mismatch_csv": {"enabled": True}, "runs": {"enabled": True, "table": str(csvs / "runs")}, "checks": {"enabled": True, "table": str(csvs / "checks")}}
    run = planned(checks, results_storage=storage).run(spark)
    assert [c.status for c in run.checks] == ["FAIL"] * 8 + ["PASS", "FAIL"]
    by = {c.check_type: c.details for c in run.checks[:7]}
    assert by["row_count"]["mismatch_sampling"]["ranges"][0]["range_start"] == 5
    assert by["join_rowdiff"]["missing_on_target"] == [{"k1": 3}] and len(by["join_rowdiff"]["extra_on_target"]) == 2
    assert by["join_rowdiff"]["mismatch_sample"] == [{"k1": 2, "column": "score", "source": "8.4", "target": "8.5"}]
    assert [r["pass"] for r in by["aggregations"]["rules"]] == [True, False] and by["aggregations"]["rules"][1]["mismatch_sampling"]["ranges"]
    assert by["group_aggregations"]["failed_partitions"] == 3 and by["partitions"]["target_partitions"] == 4
    assert "required" in run.checks[-1].details["error"]
    assert run.overall_severity == "WARNING"
    links = csv_links([c.details for c in run.checks])
    assert len(links) == 2 and open(links[0]).readline().startswith("range_start,range_end")
    assert spark.read.parquet(str(csvs / "checks")).count() == 10
    assert spark.read.parquet(str(csvs / "runs")).first()["fail_count"] == 9


@pytest.mark.parametrize(("order", "want"), [({"order_by": ["score desc"]}, [5, 4]), ({"order_by": "score"}, [4, 5]), ({"order_by_target": ["name DESC"]}, [5, 4]), ({}, [4, 5])])
def test_previews_are_ordered(spark, csvs, order, want):
    check = {"type": "join_rowdiff", "join_keys": {"source": ["id"], "target": ["id"]}, "include": ["name", "score"], **order}
    found = planned([check]).run(spark).checks[0].details
    assert [r["k1"] for r in found["extra_on_target"]] == want and found["missing_on_target"] == [{"k1": 3}]


def test_documented_names():
    base = {"connections": {"source_env_var": "A", "target_env_var": "B"}}
    rules = [{"condition": "old", "older_than_days": 30, "severity": "CRITICAL"}, {"newer_than_days": 2, "tolerance_pct_exceeded_gte": 1, "tolerance_pct_exceeded_lt": 2, "tolerance_abs_exceeded_gte": 1, "tolerance_abs_exceeded_lt": 2, "severity": "INFO"}]
    store = {"runs": {"enabled": True, "backend": "bigquery", "table": "d.runs", "project": "p"}, "checks": {"enabled": False, "table": "d.checks"}}
    config = config_of({**base, "tables": [{"name": "t", "checks": [{"type": "stats_compare", "severity_rules": rules}]}], "results_storage": store})
    assert [r.older_than_days for r in config.tables[0].checks[0].severity_rules()] == [30, None]
    assert (config.results.runs.backend, config.results.runs.project) == ("bigquery", "p") and config.results.checks is None
    with pytest.raises(ConfigError):
        config_of({**base, "tables": [], "results_storage": {"runs": {"enabled": True, "table": "t", "backend": "what"}}})


def test_connections(spark, tmp_path):
    @connector("grove")
    class Grove:
        def __init__(self, spark, uri, options):
            self.spark = spark

        def table(self, name):
            return self.spark.createDataFrame([(name,)], "name string")

        def sql(self, query):
            return self.spark.sql(query)

    try:
        source = Source(spark, "grove://anywhere")
        assert source.read(Query(table="oak")).first()["name"] == "oak" and source.sql("SELECT 1 AS x").first()["x"] == 1
    finally:
        uri.PLUGINS.clear()
    assert uri.engine_of("pg://u@h/d") == "postgres"
    with pytest.raises(NotImplementedError):
        uri.engine_of("x", "rest_api")
    assert uri.jdbc_url("snowflake://u:p@acct.host/DB/SC?warehouse=W", "snowflake") == ("jdbc:snowflake://acct.host/?db=DB&schema=SC&warehouse=W", {"user": "u", "password": "p"})
    assert uri.bigquery_options("bigquery://proj/ds") == {"parentProject": "proj", "dataset": "ds"}
    bad = MismatchCsv(enabled=True, backend="hadoop", bucket="nowhere://x")
    df = spark.createDataFrame([(1,)], "a int")
    os.environ["PLUMBLINE_ARTIFACTS_DIR"] = str(tmp_path)
    try:
        assert str(tmp_path) in Artifacts(bad).write(df, "l", {}, "r")  # the store is out of reach
    finally:
        del os.environ["PLUMBLINE_ARTIFACTS_DIR"]


def test_stats_loop(spark, csvs):
    storage = {"table": str(csvs / "stats")}
    common = {"time_column": "timestamp'2024-02-10'", "metrics": [{"method": "count", "name": "rows"}, {"method": "sum", "column": "score"}], "stats_storage": storage}
    compare = {"type": "stats_compare", "metrics": ["rows", "sum:score"], "compare_on": [{"period_granularity": "day", "lookback_days": 30}], "stats_storage": storage, "severity_rules": [{"severity": "CRITICAL", "tolerance_pct_exceeded_gte": 20}], "tolerance_abs": 0.5}
    run = planned([compare, {"type": "table_stats", "time_granularity": "day", **common}]).run(spark)
    assert [c.status for c in run.checks] == ["FAIL", "RECORDED"]
    assert run.checks[0].severity == "CRITICAL" and run.checks[1].details["rows"] == 4
    assert planned([{"type": "stats_compare"}, {"type": "table_stats"}]).run(spark).overall_status == "PASS"


def test_third_party_vocabularies(spark, csvs):
    ge = {"type": "ge_expectations", "rules": [{"expectations": [{"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "name"}}, {"type": "expect_other"}]}]}
    soda = {"type": "soda_checks", "rules": [{"on": "target", "checks_yaml": "checks for t:\n  - row_count > 10\n  - invalid_count(name) = 0:\n      valid values: [oak]\n"}]}
    run = planned([ge, soda, {"type": "ge_expectations"}]).run(spark)
    assert [c.status for c in run.checks] == ["PASS", "FAIL", "SKIP"]
    assert run.checks[0].details["skipped"] == ["expect_other"]


def test_timeouts_cancel(spark, csvs, monkeypatch):
    def slow(context):
        context.spark.range(10).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()

    monkeypatch.setitem(CHECKS, "slow", slow)
    plan = planned([{"type": "slow"}, {"type": "row_count"}])
    plan.variables["check_timeout_sec"] = 1
    began = time.monotonic()
    run = plan.run(spark)
    assert time.monotonic() - began < 15
    assert "Timeout" in run.checks[0].details["error"] and run.checks[1].check_type == "row_count"


def test_disabled_checks(spark, csvs, monkeypatch):
    monkeypatch.setenv("PLUMBLINE_DISABLE_CHECKS", "row_count,domain")
    assert planned([{"type": "row_count"}]).run(spark).checks[0].details == {"reason": "disabled"}


def test_configuration_errors():
    base = {"connections": {"source_env_var": "A", "target_env_var": "B"}, "tables": []}
    for bad in ({"tables": []}, {**base, "extra": 1}, {**base, "connections": {"source_env_var": "A"}}, {**base, "tables": [{"name": "t", "checks": [{}]}]}, {**base, "planning": {"partitions": {"mode": "daily"}}}, {**base, "defaults": {"hashing": {"algorithm": "crc"}}}):
        with pytest.raises(ConfigError):
            config_of(bad)


def test_yaml(tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", "x")
    file = tmp_path / "c.yaml"
    file.write_text("connections: {source_env_var: '${HERE}', target_env_var: '${NOT_SET_ANYWHERE}'}\ntables:\n  - name: t\n    checks:\n      - {type: domain, on: target, rules: [{on: source}]}\n")
    config = config_of(loading.load(str(file)))
    assert config.connections.source_env_var == "x" and config.connections.target_env_var == "${NOT_SET_ANYWHERE}"
    assert config.tables[0].checks[0].options == {"on": "target", "rules": [{"on": "source"}]}
    code = tmp_path / "c.py"
    code.write_text("def build(v):\n    return {'connections': {'source_env_var': v['a'], 'target_env_var': 'B'}, 'tables': []}\n")
    assert config_of(loading.load(str(code), "py", {"a": "S"})).connections.source_env_var == "S"


@pytest.mark.parametrize(("text", "want"), [("41", 41), ("false", False), ("0.25", 0.25), ("007", "007"), ("null", None), ("-2", -2), ("1e3", 1000.0), ("x", "x"), ("0", 0)])
def test_coercion(text, want):
    assert loading.coerce(text) == want and type(loading.coerce(text)) is type(want)


def test_templates_and_windows():
    assert loading.render("a {{ x }} {{y}}", {"x": 1, "y": None}) == "a 1 "
    with pytest.raises(ConfigError):
        loading.render("{{ z }}", {})
    w = loading.window
    assert w(Partitions(), NOW) == (datetime(2024, 3, 1, tzinfo=timezone.utc), NOW)
    assert w(Partitions("rolling_days", 2), NOW)[0] == datetime(2024, 2, 28, 12, tzinfo=timezone.utc)
    assert w(Partitions("range", start="2024-01-01", end="2024-01-02T00:00:00Z"), NOW)[1] == datetime(2024, 1, 2, tzinfo=timezone.utc)


def test_command_line(monkeypatch):
    a = cli.parse(["--config-file", "c", "--filetype", "yaml", "--vars", "depth=12,dry=false", "share=0.25", "--env", "prod", "--alerts", "gchat:webhook=https://chat.invalid/q,mode=card", "email:to=leaf@trees.invalid", "--concurrency", "2"])
    assert a.variables == {"env": "prod", "depth": "12", "dry": "false", "share": "0.25"}
    assert a.routes == [{"kind": "gchat", "webhook": "https://chat.invalid/q", "mode": "card"}, {"kind": "email", "to": "leaf@trees.invalid"}]
    assert a.overrides["concurrency"] == 2 and a.overrides["max_rows_preview"] == 1000
    with pytest.raises(ValueError):
        cli.pairs(["novalue"])


def test_main(spark, csvs, capsys):
    file = csvs / "c.yaml"
    file.write_text("connections: {source_env_var: SRC, target_env_var: TGT}\ntables:\n  - name: t\n    source: {}\n    target: {}\n    checks: [{type: row_count}]\n")
    assert cli.main(["--config-file", str(file), "--filetype", "yaml"]) == 1
    assert "FAIL (WARNING): 0 passed, 1 failed" in capsys.readouterr().out


RUN = RunResult("FAIL", [CheckResult("t", "row_count", "FAIL", {"a": {"mismatch_csv_uri": "u1"}, "missing_on_target": [{"k": 1}]}), CheckResult("t", "aggregations", "FAIL", {"rules": [{"method": "sum"}, {"method": "max"}]}, "CRITICAL"), CheckResult("u", "domain", "PASS")], "CRITICAL")


def test_rendering():
    text = render.summarize_run(RUN)
    assert "aggregation[max]" in text and "row_count WARNING" in text and text.startswith("FAIL (CRITICAL): 1 passed, 2 failed, 0 skipped")
    assert render.summarize_run(RunResult("PASS", [])) == "PASS: 0 passed, 0 failed, 0 skipped"
    assert render.markdown_table(RUN, max_rows=2).endswith("... and 2 more")
    card = render.chat_card(RUN)
    assert len(card["cards"][0]["sections"]) == 2 and "u1" in json.dumps(card)
    assert "u/domain" not in render.chat_text(RUN)["text"] and "u/domain" in render.chat_text(RUN, all_checks=True)["text"]


def test_alerts(monkeypatch):
    sent = []
    monkeypatch.setitem(alerts.ALERTS, "email", lambda run, *, recipients: sent.append(recipients))
    monkeypatch.setitem(alerts.ALERTS, "gchat", lambda run, *, route, mode: sent.append((route["webhook"], mode)))
    monkeypatch.setenv("DQ_EMAILS", "ops@trees.invalid; night@trees.invalid")
    seen = []
    alerts.dispatch([{"kind": "email"}, {"kind": "smoke"}, {"kind": "gchat", "webhook": "https://chat.invalid/q"}, {"kind": "email", "to": ["c@x"]}], RUN, log=lambda *a, **k: seen.append(k))
    assert sent == [["ops@trees.invalid", "night@trees.invalid"], ("https://chat.invalid/q", "text"), ["c@x"]] and len(seen) == 1
    mail = alerts.email_message(RUN, ["leaf@trees.invalid"], "b@x")
    assert [p.get_filename() for p in mail.iter_attachments()] == ["t-row_count-missing_on_target.csv"]


def test_rows_and_files(tmp_path):
    row = run_row(RUN, run_id="r", env=None, run_label="l", started=NOW, finished=NOW)
    assert (row["pass_count"], row["fail_count"], row["table_count"]) == (1, 2, 2)
    check = CheckResult("t", "stats_compare", "FAIL", {"mismatches": [{"period_key": "2024-01"}], "stats_table": "s", "x": "y" * 2000})
    got = check_row(check, run_id="r")
    assert got["period_key"] == "2024-01" and got["stats_table_ref"] == "s" and len(got["extra_context"]) == 1024
    assert summed([CheckResult("t", "c", "RECORDED"), CheckResult("t", "c", "SKIP")]).overall_status == "PASS"
    assert shaped([{"a": 1}, (2, 3), 4])[0] == ["a", "column_1", "column_2", "value"]
    assert open(write_csv([{"a": 1}, {"b": 2}], tmp_path / "x" / "f.csv")).read().split() == ["a,b", "1,", ",2"]
